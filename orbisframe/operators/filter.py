"""Declarative filters that become one boolean Column, never NULL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.dates import to_day

DATE_NAMES = ("date", "datetime", "timestamp", "time_start")


class Filter:
    """A predicate over the columns of a frame; columns that the frame lacks are NULL."""

    def __init__(self, build: Callable[[Callable[[str], Column]], Column], description: str = "custom"):
        self.build, self.description = build, description

    def column(self, df: DataFrame) -> Column:
        """The Column over df."""
        kinds = {f.name: f.dataType for f in df.schema.fields}
        props = next((c for c in ("properties", "metadata") if isinstance(kinds.get(c), T.MapType)), None)

        def of(name: str) -> Column:
            if name in kinds:
                c = F.col(f"`{name}`")
                return F.when(~F.isnan(c), c) if isinstance(kinds[name], (T.DoubleType, T.FloatType)) else c
            return F.element_at(props, name) if props else F.lit(None).cast("string")

        return F.coalesce(self.build(of).cast("boolean"), F.lit(False))

    def apply(self, df: DataFrame) -> DataFrame:
        return df.filter(self.column(df))

    def __and__(self, other: Filter) -> Filter:
        return Filter.and_(self, other)

    def __or__(self, other: Filter) -> Filter:
        return Filter.or_(self, other)

    def __invert__(self) -> Filter:
        return Filter.not_(self)

    def __repr__(self) -> str:
        return f"Filter({self.description})"

    @staticmethod
    def _typed(c: Column, value) -> Column:
        """c as numbers for a numeric value; what isn't one is NULL."""
        return c.try_cast("double") if isinstance(value, (int, float)) and not isinstance(value, bool) else c

    @staticmethod
    def _leaf(name: str, value, test, missing: bool, said: str) -> Filter:
        return Filter(lambda of: F.coalesce(test(Filter._typed(of(name), value)), F.lit(missing)), f"{name} {said} {value!r}")

    @staticmethod
    def eq(name: str, value) -> Filter:
        return Filter._leaf(name, value, lambda c: c == value, False, "==")

    @staticmethod
    def neq(name: str, value) -> Filter:
        """Missing values match."""
        return Filter._leaf(name, value, lambda c: c != value, True, "!=")

    @staticmethod
    def gt(name: str, value) -> Filter:
        return Filter._leaf(name, value, lambda c: c > value, False, ">")

    @staticmethod
    def gte(name: str, value) -> Filter:
        return Filter._leaf(name, value, lambda c: c >= value, False, ">=")

    @staticmethod
    def lt(name: str, value) -> Filter:
        return Filter._leaf(name, value, lambda c: c < value, False, "<")

    @staticmethod
    def lte(name: str, value) -> Filter:
        return Filter._leaf(name, value, lambda c: c <= value, False, "<=")

    equals, notEquals, greaterThan, greaterThanOrEquals, lessThan, lessThanOrEquals = eq, neq, gt, gte, lt, lte

    @staticmethod
    def rangeContains(name: str, low, high) -> Filter:
        return Filter(lambda of: Filter._typed(of(name), low).between(low, high), f"{low!r} <= {name} <= {high!r}")

    @staticmethod
    def _date(of, names=DATE_NAMES) -> Column:
        return F.coalesce(*[F.nullif(of(n).cast("string"), F.lit("")) for n in names])

    @staticmethod
    def date(start=None, end=None) -> Filter:
        """Days from start to end, both included; items without a date stay, unreadable dates go."""

        def build(of) -> Column:
            raw = Filter._date(of)
            day = to_day(raw)
            inside = day.isNotNull()
            inside = inside & (day >= to_day(F.lit(str(start)))) if start is not None else inside
            inside = inside & (day <= to_day(F.lit(str(end)))) if end is not None else inside
            return raw.isNull() | F.coalesce(inside, F.lit(False))

        return Filter(build, f"date in [{start}, {end}]")

    @staticmethod
    def calendarRange(start: int, end: int, field: str = "month") -> Filter:
        """Month, or else day of year, from start to end; wraps over the year's end where start > end."""

        def build(of) -> Column:
            raw = Filter._date(of, DATE_NAMES[:3])
            day = to_day(raw)
            n = F.month(day) if field == "month" else F.dayofyear(day)
            inside = n.between(start, end) if start <= end else (n >= start) | (n <= end)
            return raw.isNull() | F.coalesce(inside, F.lit(False))

        return Filter(build, f"{field} in [{start}, {end}]")

    @staticmethod
    def dayOfYear(start: int, end: int) -> Filter:
        return Filter.calendarRange(start, end, "day_of_year")

    @staticmethod
    def bounds(geometry) -> Filter:
        """Rows whose point (x, y) or box (minx, miny, maxx, maxy) meets the geometry; rows with neither stay."""

        def build(of) -> Column:
            x0, y0 = F.coalesce(of("minx").try_cast("double"), of("x").try_cast("double")), F.coalesce(of("miny").try_cast("double"), of("y").try_cast("double"))
            x1, y1 = F.coalesce(of("maxx").try_cast("double"), x0), F.coalesce(of("maxy").try_cast("double"), y0)
            return x0.isNull() | y0.isNull() | geometry.meets_box(x0, y0, x1, y1)

        return Filter(build, "bounds")

    intersects = bounds

    @staticmethod
    def inList(name: str, values) -> Filter:
        values = list(values)
        first = values[0] if values else ""
        return Filter(lambda of: Filter._typed(of(name), first).isin(values), f"{name} in {values!r}")

    @staticmethod
    def notInList(name: str, values) -> Filter:
        """Missing values match."""
        return Filter.not_(Filter.inList(name, values))

    @staticmethod
    def _text(name: str, value: str, method: str, case_sensitive: bool = True) -> Filter:
        def build(of) -> Column:
            c = F.when(F.typeof(of(name)) == "string", of(name).cast("string"))  # what isn't text doesn't match
            return F.coalesce(getattr(c if case_sensitive else F.lower(c), method)(value if case_sensitive else value.lower()), F.lit(False))

        return Filter(build, f"{name} {method} {value!r}")

    @staticmethod
    def stringContains(name: str, value: str, case_sensitive: bool = True) -> Filter:
        return Filter._text(name, value, "contains", case_sensitive)

    @staticmethod
    def stringStartsWith(name: str, value: str) -> Filter:
        return Filter._text(name, value, "startswith")

    @staticmethod
    def stringEndsWith(name: str, value: str) -> Filter:
        return Filter._text(name, value, "endswith")

    @staticmethod
    def and_(*filters: Filter) -> Filter:
        return Filter._joined(filters, lambda a, b: a & b, True)

    @staticmethod
    def or_(*filters: Filter) -> Filter:
        return Filter._joined(filters, lambda a, b: a | b, False)

    @staticmethod
    def _joined(filters, join, empty: bool) -> Filter:
        def build(of) -> Column:
            made = F.lit(empty)
            for f in filters:
                made = join(made, F.coalesce(f.build(of), F.lit(False)))
            return made

        return Filter(build, f" {'and' if empty else 'or'} ".join(f"({f.description})" for f in filters))

    @staticmethod
    def not_(f: Filter) -> Filter:
        return Filter(lambda of: ~F.coalesce(f.build(of), F.lit(False)), f"not ({f.description})")

    @staticmethod
    def metadata(name: str, op: str, value) -> Filter:
        """By operator spelling; ValueError for an unknown one."""
        for make, spellings in _SPELLINGS.items():
            if op.lower() in spellings:
                return make(name, value)
        raise ValueError(f"unknown operator {op!r}")

    @staticmethod
    def quality(max_cloud: float = 30) -> Filter:
        """Cloud of at most max_cloud (a cover of 0 falls through to the next name), and a quality flag other than 0."""

        def build(of) -> Column:
            cloud = F.coalesce(*[F.nullif(of(n).try_cast("double"), F.lit(0.0)) for n in ("CLOUDY_PIXEL_PERCENTAGE", "cloud_cover")])
            return (cloud.isNull() | (cloud <= max_cloud)) & F.coalesce(of("quality_flag").try_cast("double") != 0, F.lit(True))

        return Filter(build, f"cloud <= {max_cloud}")


#: The spellings of each operator.
_SPELLINGS = {
    Filter.eq: ("equals", "=", "=="),
    Filter.neq: ("not_equals", "!="),
    Filter.gt: ("greater_than", ">"),
    Filter.gte: ("greater_than_or_equals", ">="),
    Filter.lt: ("less_than", "<"),
    Filter.lte: ("less_than_or_equals", "<="),
    Filter.stringContains: ("contains",),
    Filter.stringStartsWith: ("starts_with",),
}
