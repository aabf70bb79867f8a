"""Calendar days from the forms that scene metadata uses."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_day(x: Column) -> Column:
    """A DATE from a date, timestamp or text: yyyy-MM-dd, yyyyMMdd or yyyyDDD, each with anything after a T; else NULL.

    A time with an offset from UTC gives the day that it is in UTC.
    """
    said = F.trim(x.cast("string"))
    s = F.regexp_extract(said, r"^([0-9-]+)(?:[T ].*)?$", 1)
    part = lambda k: F.regexp_extract(said, r"^[0-9-]+[T ]([0-9]{2}):?([0-9]{2})(?::?[0-9]{2}(?:[.,][0-9]+)?)?\s*([+-])([0-9]{2}):?([0-9]{2})?$", k)
    minutes = lambda h, m: F.coalesce(part(h).try_cast("int"), F.lit(0)) * 60 + F.coalesce(part(m).try_cast("int"), F.lit(0))
    utc = minutes(1, 2) - F.when(part(3) == "-", -1).otherwise(1) * minutes(4, 5)
    forms = (("^[0-9]{4}-[0-9]{2}-[0-9]{2}$", "yyyy-MM-dd"), ("^[0-9]{8}$", "yyyyMMdd"), ("^[0-9]{7}$", "yyyyDDD"))
    day = F.coalesce(*[F.when(s.rlike(p), F.try_to_timestamp(s, F.lit(f)).cast("date")) for p, f in forms])
    return F.date_add(day, F.when(part(3) == "", 0).otherwise(F.floor(utc / 1440)).cast("int"))
