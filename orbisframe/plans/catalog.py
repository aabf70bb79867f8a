"""Registered queries over the driver's tables, with their DuckDB twins.

The tables hold no geometry, so views make rasters, stacks and points of them by arithmetic that both engines do alike. Each
query runs the library's operators over a whole view; results are rounded alike in both texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import inference, spatial, validation
from ..operators.collection import ImageCollection
from ..operators.filter import Filter
from ..operators.geometry import Geometry
from ..operators.raster import Grid, Image
from ..operators.reducer import Reducer, histogram
from ..operators.vector import FeatureCollection, block
from ..sources import features
from ..sources.gedi import GEDI
from ..streaming.composite import running_composite

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# views: the same text runs in both engines
PX = """select cast(floor(event_id / 1e2) as int) as r, cast(event_id % 100 as int) as c,
    case when event_id % 17 = 0 then null else user_id / 1e3 end as B2, (user_id * 3 % 101 + 5) / 1e3 as B3, (value + 1) / 1e3 as B4,
    (value + user_id + 1) / 1e3 as B8, (user_id % 37) / 1e2 as B11, (user_id % 23) / 1e2 as B12,
    cast(event_id % 16 as double) as Fmask, cast(event_id % 64 as double) as QA_PIXEL, cast(event_id % 12 as double) as SCL,
    case when event_id % 5 = 0 then 1024e0 when event_id % 7 = 0 then 2048e0 when event_id % 11 = 0 then null else 0e0 end as QA60,
    cast(floor(event_id / 1e2) * 13 + event_id % 100 * 7 + event_id % 11 as double) as elev from events"""
PTS = """select c_custkey as id, (c_custkey * 7919 % 10007) / 10007e0 as x, (c_custkey * 104729 % 10009) / 10009e0 as y, c_acctbal as v, c_mktsegment as g,
    c_nationkey as nation from customer"""
SUP = "select s_suppkey as id, (s_suppkey * 7919 % 10007) / 10007e0 as x, (s_suppkey * 104729 % 10009) / 10009e0 as y, s_acctbal as v from supplier"
CELLS = """select cast(n_nationkey as bigint) as k, (n_nationkey % 5) / 5e0 as minx, floor(n_nationkey / 5e0) / 5e0 as miny,
    (n_nationkey % 5 + 1) / 5e0 as maxx, (floor(n_nationkey / 5e0) + 1) / 5e0 as maxy, n_regionkey as region from nation"""
STACK = """select cast(cast(ts as date) as varchar(10)) as image_id, cast(floor(user_id / 15e0) as int) as r, cast(user_id % 15 as int) as c,
    avg(value) as v, cast(count(*) as double) as q from events group by user_id, cast(ts as date)"""
SCENES = """select o_orderkey as id, cast(cast(o_orderdate as date) as varchar(10)) as date, o_orderstatus as platform, cast(o_custkey % 101 as double) as CLOUDY_PIXEL_PERCENTAGE,
    cast(o_custkey % 53 as double) as cloud_cover, cast(o_orderkey % 9 as int) as quality_flag, o_orderpriority as priority,
    case when o_orderkey % 6 = 0 then null else o_totalprice end as price from orders"""
SHOTS = """select l_orderkey * 8 + l_linenumber as shot_number, (l_partkey * 31 % 18001) / 1e2 - 90 as lat_lowestmode, (l_suppkey * 7919 % 36007) / 1e2 - 180 as lon_lowestmode,
    8e-1 + l_discount * 2 as sensitivity, case when l_returnflag = 'R' then 0 else 1 end as quality_flag, cast(l_linenumber % 5 = 0 as int) as degrade_flag,
    date_diff('day', date '2018-01-01', cast(l_shipdate as date)) * 864e2 + l_quantity as delta_time, l_extendedprice as agbd from lineitem"""


def view(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A view's text over the tables that it names."""
    for t in ("events", "customer", "supplier", "nation", "orders", "lineitem"):
        if f"from {t}" in text:
            spark.read.parquet(f"{sf_dir}/{t}.parquet").createOrReplaceTempView(f"__{t}")
            text = text.replace(f"from {t}", f"from __{t}")
    text = text.replace("date_diff('day', date '2018-01-01', cast(l_shipdate as date))", "datediff(cast(l_shipdate as date), date '2018-01-01')")
    return spark.sql(text)


def pixels(spark: SparkSession, sf_dir: str, bands: list[str] | None = None, epsg: int = 4326, transform=(0.001, 0.0, 90.0, 0.0, -0.001, 23.0)) -> Image:
    """The raster view: 100 columns, a row of pixels for each 100 events."""
    df = view(spark, sf_dir, PX).withColumnsRenamed({"r": "row", "c": "col"})
    rows = -(-spark.read.parquet(f"{sf_dir}/events.parquet").agg(F.max("event_id")).first()[0] // 100)
    image = Image.from_table(df, Grid(100, rows, transform, epsg))
    return image.select(bands) if bands else image


def stack(spark: SparkSession, sf_dir: str) -> ImageCollection:
    """Days of mean values by user; sparse in time."""
    df = view(spark, sf_dir, STACK).withColumnsRenamed({"r": "row", "c": "col"})
    scenes = df.select("image_id").distinct().select("image_id", F.datediff(F.col("image_id").cast("date"), F.lit("2024-01-01").cast("date")).alias("ord"), F.col("image_id").alias("date"))
    return ImageCollection(df, scenes, Grid(15, 1000))


def _gaps(spark: SparkSession, sf_dir: str, by: str = "5e-2") -> DataFrame:
    """The cells, each shrunk at its upper and right side."""
    return view(spark, sf_dir, CELLS).selectExpr("k", "region", "minx", "miny", f"maxx - {by} as maxx", f"maxy - {by} as maxy")


def round_like_sql(x: Column, digits: int) -> Column:
    """round() as DuckDB does it: x * 10^digits to the nearest whole number, halves away from zero, over 10^digits.

    Spark rounds the decimal text of a double instead. The two part where x * 10^digits is no exact product, as for large values.
    """
    scale = float(10**digits)
    big = F.abs(x) * scale
    near = F.rint(big)  # halves to even
    made = F.when(big - near == 0.5, near + 1).otherwise(near) / scale
    return F.when(made < float("inf"), F.signum(x) * made).otherwise(x)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded; row and col under the names of the SQL texts."""
    names = {"row": "r", "col": "c"}
    return df.select(*[(round_like_sql(F.col(f"`{n}`"), digits) + 0.0 if t == "double" else F.col(f"`{n}`")).alias(names.get(n, n)) for n, t in df.dtypes])


def query(sql: str | None = None, name: str | None = None):
    """Register a function, and SQL in which {px}, {pts} and so on stand for the views."""

    def add(f):
        key = name or f.__name__
        QUERIES[key] = f
        if sql:
            views = {"px": PX, "pts": PTS, "sup": SUP, "cells": CELLS, "stack": STACK, "scenes": SCENES, "shots": SHOTS}
            used = [f"{k} as ({v})" for k, v in views.items() if f"{{{k}}}" in sql]
            body = sql
            for k in views:
                body = body.replace(f"{{{k}}}", k)
            body = body.strip()
            if body.lower().startswith("with "):
                ORACLES[key] = f"with {', '.join([*used, body[5:]])}"
            else:
                ORACLES[key] = f"with {', '.join(used)} {body}" if used else body
        return f

    return add


def raster_query(name: str, make: Callable[[Image], Image], columns: str, digits: int = 6) -> None:
    """A per-pixel query: columns is the SQL of its bands."""
    query(f"select r, c, {columns} from {{px}}", name)(lambda spark, d: rounded(make(pixels(spark, d)).df, digits))


# projections
@query("select r, round(avg(nd), 6) + 0.0 as mean, round(stddev_pop(nd), 6) + 0.0 as sd, count(nd) as n from (select r, case when cast(Fmask as int) & 14 = 0 and B8 + B4 <> 0 then (B8 - B4) / (B8 + B4) end as nd from {px}) group by r")
def ndvi_rowstats(spark, d):
    """The flagship: QA masking, NDVI, statistics of each row of pixels."""
    df = pixels(spark, d).mask_clouds("Fmask").ndvi(nir="B8", red="B4").df
    return rounded(df.groupBy("row").agg(F.avg("ndvi").alias("mean"), F.stddev_pop("ndvi").alias("sd"), F.count("ndvi").alias("n")))


raster_query(
    "band_arith", lambda i: i.select(["B2", "B8"]) * 2 + 1 - i.select(["B3", "B4"]) / i.select(["B11", "B12"]),
    "round(case when B11 = 0 then (case when B3 = 0 then null else B2 * 2 + 1 - 'inf'::double end) else B2 * 2 + 1 - B3 / B11 end, 10) + 0.0 as B2, "
    "round(case when B12 = 0 then (case when B4 = 0 then null else B8 * 2 + 1 - 'inf'::double end) else B8 * 2 + 1 - B4 / B12 end, 10) + 0.0 as B8",
    10,
)
raster_query(
    "band_compare", lambda i: Image.from_images([i.select("B2") > 0.05, i.select("B2") != 0.05, i.select("B2") <= i.select("B3"), i.select("B2") == i.select("B3")], ["gt", "ne", "le", "eq"]),
    "coalesce(cast(B2 > 5e-2 as double), 0) as gt, coalesce(cast(B2 <> 5e-2 as double), 1) as ne, coalesce(cast(B2 <= B3 as double), 0) as le, coalesce(cast(B2 = B3 as double), 0) as eq",
)
raster_query("band_unary", lambda i: Image.from_images([i.select("B4").sqrt(), i.select("B4").log(), i.select("B8").sin().round(), (i.select("B2") ** 2).exp(), (-i.select("B2")).floor()], ["s", "l", "q", "e", "f"]),
             "round(sqrt(B4), 6) + 0.0 as s, round(ln(B4), 6) + 0.0 as l, round_even(sin(B8), 0) + 0.0 as q, round(exp(B2 * B2), 6) + 0.0 as e, floor(-B2) + 0.0 as f")
raster_query("expr_evi", lambda i: i.expression("2.5 * (N - R) / (N + 6 * R - 7.5 * B + 1) if N > 0.1 and not R > 0.4 else min(N, B) % 0.3", {"N": "B8", "R": "B4", "B": "B2"}),
             "round(case when B8 > 1e-1 and not B4 > 4e-1 then 2.5 * (B8 - B4) / (B8 + 6 * B4 - 7.5 * B2 + 1) when B2 is not null then least(B8, B2) - 3e-1 * floor(least(B8, B2) / 3e-1) end, 6) + 0.0 as expression")
for _name, _make, _a, _b in (
    ("nd_ndvi", lambda i: i.ndvi(), "B8", "B4"), ("nd_ndwi", lambda i: i.ndwi(), "B3", "B8"),
    ("nd_ndbi", lambda i: i.ndbi(), "B11", "B8"), ("nd_nbr", lambda i: i.nbr(), "B8", "B12"),
):
    raster_query(_name, _make, f"case when {_a} + {_b} <> 0 then round(({_a} - {_b}) / ({_a} + {_b}), 6) + 0.0 end as {_name[3:]}")
raster_query("idx_evi", lambda i: i.evi(), "case when B8 + 6 * B4 - 75e-1 * B2 + 1 <> 0 then round(25e-1 * (B8 - B4) / (B8 + 6 * B4 - 75e-1 * B2 + 1), 6) + 0.0 end as evi")
raster_query("idx_savi", lambda i: i.savi(), "round((B8 - B4) / (B8 + B4 + 5e-1) * 15e-1, 6) + 0.0 as savi")
raster_query("norm_minmax", lambda i: i.select(["B2", "B8"]).normalize(), "round((B2 - min(B2) over ()) / (max(B2) over () - min(B2) over ()), 6) + 0.0 as B2, round((B8 - min(B8) over ()) / (max(B8) over () - min(B8) over ()), 6) + 0.0 as B8")
raster_query("clamp", lambda i: i.select(["B2", "B8"]).clamp(0.05, 0.1), "case when B2 is not null then round(greatest(least(B2, 1e-1), 5e-2), 6) end as B2, round(greatest(least(B8, 1e-1), 5e-2), 6) as B8")
raster_query("update_mask", lambda i: i.select(["B8"]).updateMask(i.select("QA60")), "case when QA60 = 0 then null else round(B8, 6) + 0.0 end as B8")
raster_query("unmask", lambda i: i.select(["B2"]).unmask(-1), "round(coalesce(B2, -1), 6) + 0.0 as B2")
raster_query("where", lambda i: i.select(["B8"]).where(i.select("QA60"), 9), "case when QA60 is null or QA60 <> 0 then 9e0 else round(B8, 6) + 0.0 end as B8")
raster_query("mask", lambda i: i.select(["B2", "B8"]).mask(), "cast(B2 is not null as double) as mask")
raster_query("auto_scale", lambda i: i.select(["B4", "Fmask"]).auto_scale(dataset="LANDSAT_C2"), "round(B4 * 2.75e-5 + -2e-1, 6) + 0.0 as B4, Fmask")
raster_query("mask_fmask", lambda i: i.select(["B4", "Fmask"]).mask_clouds(), "case when cast(Fmask as int) & 14 = 0 then round(B4, 6) end as B4, case when cast(Fmask as int) & 14 = 0 then Fmask end as Fmask")
raster_query("mask_landsat_c2", lambda i: i.select(["B4", "QA_PIXEL"]).mask_clouds(keep_clear=False), "case when cast(QA_PIXEL as int) & 30 <> 0 then round(B4, 6) end as B4, case when cast(QA_PIXEL as int) & 30 <> 0 then QA_PIXEL end as QA_PIXEL")
raster_query("mask_scl", lambda i: i.select(["B4", "SCL"]).mask_clouds(), "case when SCL in (4, 5, 6, 7) then round(B4, 6) end as B4, case when SCL in (4, 5, 6, 7) then SCL end as SCL")
raster_query("mask_qa60", lambda i: i.select(["B4", "QA60"]).mask_clouds(), "case when cast(QA60 as int) & 3072 = 0 then round(B4, 6) end as B4, case when cast(QA60 as int) & 3072 = 0 then QA60 end as QA60")
raster_query("clip_box", lambda i: i.select(["B8"]).clip(Geometry.Rectangle(90.01, 22.95, 90.05, 22.99)), "case when 90e0 + (c + 5e-1) * 1e-3 between 9001e-2 and 9005e-2 and 23e0 - (r + 5e-1) * 1e-3 between 2295e-2 and 2299e-2 then round(B8, 6) end as B8")
raster_query(
    "clip_polygon", lambda i: i.select(["B8"]).clip(Geometry.Polygon([(90.0, 23.0), (90.08, 23.0), (90.0, 22.9203)])),
    "case when c + 5e-1 <= 80 and r + 5e-1 <= 797e-1 and (r + 5e-1) / 797e-1 + (c + 5e-1) / 8e1 <= 1 then round(B8, 6) end as B8",
)
raster_query(
    "visualize_stretch", lambda i: i.select(["B4", "B8"]).visualize(bands=["B8"]),
    "cast(floor(coalesce(greatest(least((B8 - quantile_cont(B8, 2e-2) over ()) / (quantile_cont(B8, 98e-2) over () - quantile_cont(B8, 2e-2) over ()), 1), 0) * 255, 0)) as int) as B8",
)


# filters
def filter_query(name: str, f: Filter, where: str) -> None:
    query(f"select id, platform, round(price, 4) + 0.0 as price from {{scenes}} where {where}", name)(
        lambda spark, d: rounded(f.apply(view(spark, d, SCENES)).select("id", "platform", "price"), 4)
    )


filter_query("flt_eq_neq", Filter.eq("platform", "F") & Filter.neq("price", 1000.0), "platform = 'F' and price is distinct from 1000")
filter_query("flt_range", Filter.rangeContains("price", 1e5, 2e5) | Filter.lt("price", 5e4), "coalesce(price between 1e5 and 2e5, false) or coalesce(price < 5e4, false)")
filter_query("flt_compare", Filter.gte("price", 1e5) & ~Filter.gt("price", 3e5) & Filter.lte("quality_flag", 6), "price >= 1e5 and not coalesce(price > 3e5, false) and quality_flag <= 6")
filter_query("flt_date", Filter.date("1996-02-01", "1997-01-15"), "date between '1996-02-01' and '1997-01-15'")
filter_query("flt_calendar_wrap", Filter.calendarRange(11, 2), "month(cast(date as date)) >= 11 or month(cast(date as date)) <= 2")
filter_query("flt_day_of_year", Filter.dayOfYear(100, 130), "dayofyear(cast(date as date)) between 100 and 130")
filter_query("flt_inlist", Filter.inList("platform", ["F", "P"]) & Filter.notInList("price", [1.0, 2.0]), "platform in ('F', 'P') and (price is null or price not in (1, 2))")
filter_query("flt_string", Filter.stringContains("priority", "urgent", False) | Filter.stringStartsWith("priority", "5") | Filter.stringEndsWith("priority", "UM"), "contains(lower(priority), 'urgent') or starts_with(priority, '5') or ends_with(priority, 'UM')")
filter_query("flt_not_null", ~Filter.gt("price", 1e5), "not coalesce(price > 1e5, false)")
filter_query("flt_metadata", Filter.metadata("CLOUDY_PIXEL_PERCENTAGE", "less_than_or_equals", 12), "CLOUDY_PIXEL_PERCENTAGE <= 12")
filter_query("flt_quality", Filter.quality(), "coalesce(coalesce(nullif(CLOUDY_PIXEL_PERCENTAGE, 0), nullif(cloud_cover, 0)) <= 30, true) and quality_flag <> 0")


# reducers
@query("select round(avg(B2), 6) as B2, round(avg(B8), 6) as B8 from {px} where 90e0 + (c + 5e-1) * 1e-3 between 9001e-2 and 9005e-2 and 23e0 - (r + 5e-1) * 1e-3 between 2295e-2 and 2299e-2")
def reduce_region(spark, d):
    return rounded(pixels(spark, d, ["B2", "B8"]).reduce_region(Reducer.mean(), Geometry.Rectangle(90.01, 22.95, 90.05, 22.99)))


@query("select round(sum(v), 2) as total, round(stddev_pop(v), 6) as sd, round(var_pop(v), 4) as var, count(v) as n, round(min(v), 6) as low, round(max(v), 6) as high, round(median(v), 6) as mid from {pts}")
def reduce_columns(spark, d):
    df = view(spark, d, PTS)
    r = lambda x, name, digits=6: F.round(x.column("v"), digits).alias(name)
    return df.agg(r(Reducer.sum(), "total", 2), r(Reducer.stdDev(), "sd"), r(Reducer.variance(), "var", 4), Reducer.count().column("v").alias("n"), r(Reducer.min(), "low"), r(Reducer.max(), "high"), r(Reducer.median(), "mid"))


@query("select round(quantile_cont(v, 2e-2), 6) as p2, round(quantile_cont(v, 5e-1), 6) as p50, round(quantile_cont(v, 98e-2), 6) as p98 from {pts}")
def reduce_percentile(spark, d):
    p = Reducer.percentile([2, 50, 98]).column("v")
    return view(spark, d, PTS).agg(p.alias("p")).select(*[F.round(F.col("p")[k], 6).alias(n) for k, n in enumerate(("p2", "p50", "p98"))])


@query("select r, B11 as mode from (select r, B11, row_number() over (partition by r order by count(*) desc, B11) as n from {px} where B11 is not null group by r, B11) where n = 1")
def reduce_mode(spark, d):
    return rounded(pixels(spark, d, ["B11"]).df.groupBy("row").agg(Reducer.mode().column("B11").alias("mode")))


@query("""with e as (select min(v) as lo, max(v) as hi from {pts}), b as (select cast(least(floor((v - lo) / ((hi - lo) / 20)), 19) as int) as bin, count(*) as n from {pts}, e group by 1)
    select cast(i.range as int) as bin, round(lo + i.range * ((hi - lo) / 20), 4) as low, round(lo + (i.range + 1) * ((hi - lo) / 20), 4) as high, coalesce(n, 0) as n from range(20) i cross join e left join b on b.bin = i.range""")
def reduce_histogram(spark, d):
    return rounded(histogram(view(spark, d, PTS), "v", 20), 4)


@query("select g, arg_min(v, id) as first, arg_max(v, id) as last, round(min(v), 4) as low, round(max(v), 4) as high, count(v) as n from {pts} group by g")
def reduce_first_last(spark, d):
    both = Reducer.minMax().column("v")
    df = view(spark, d, PTS).groupBy("g").agg(Reducer.first().column("v", "id").alias("first"), Reducer.last().column("v", "id").alias("last"), both.alias("m"), Reducer.count().column("v").alias("n"))
    return df.select("g", "first", "last", F.round("m.min", 4).alias("low"), F.round("m.max", 4).alias("high"), "n")


# stacks
for _name, _sql in (("mean", "avg(v)"), ("median", "median(v)"), ("min", "min(v)"), ("max", "max(v)"), ("sum", "sum(v)")):
    query(f"select r, c, round({_sql}, 9) as v from {{stack}} group by r, c", f"comp_{_name}")(lambda spark, d, n=_name: rounded(getattr(stack(spark, d).select(["v"]), n)().df, 9))


@query("select r, c, round(arg_max(v, image_id), 6) as v, arg_max(q, image_id) as q from {stack} group by r, c")
def mosaic(spark, d):
    return rounded(stack(spark, d).mosaic().df)


@query("select r, c, round(v, 6) as v, q from (select *, row_number() over (partition by r, c order by q desc, image_id) as n from {stack}) where n = 1")
def quality_mosaic(spark, d):
    return rounded(stack(spark, d).qualityMosaic("q").df)


@query("select r, c, round(avg(v), 9) as v from {stack} where image_id in (select distinct image_id from {stack} order by image_id desc limit 5) group by r, c")
def col_sort_limit(spark, d):
    return rounded(stack(spark, d).sort("ord", ascending=False).limit(5).select(["v"]).mean().df, 9)


@query("select r, c, round(max(v), 4) as v from {stack} where image_id between '2024-01-05' and '2024-01-12' group by r, c")
def col_filter_date(spark, d):
    return rounded(stack(spark, d).filterDate("2024-01-05", "2024-01-12").select(["v"]).max().df, 4)


@query("select image_id as time, round(-(r + 5e-1), 6) as y, round(c + 5e-1, 6) as x, band, round(value, 6) as value from (select image_id, r, c, 'v' as band, v as value from {stack} union all select image_id, r, c, 'q', q from {stack})")
def col_long(spark, d):
    return stack(spark, d).to_xarray().select("time", F.round("y", 6).alias("y"), F.round("x", 6).alias("x"), "band", F.round("value", 6).alias("value"))


# neighbourhoods: the SQL reads mirrored positions by join, the engine sends pixels out
_MIRROR = """n as (select max(r) + 1 as h from {px}), o as (select a.range - K as dr, b.range - K as dc from range(2 * K + 1) a, range(2 * K + 1) b WHERE_K),
    t as (select p.r, p.c, exp(-(dr * dr + dc * dc) / (K * K / 2e0)) as w, p.B2 as mid, case when p.r + dr < 0 then -p.r - dr - 1 when p.r + dr >= h then 2 * h - 1 - p.r - dr else p.r + dr end as rr,
        case when p.c + dc < 0 then -p.c - dc - 1 when p.c + dc >= 100 then 199 - p.c - dc else p.c + dc end as cc from {px} p, o, n),
    j as (select t.r, t.c, t.mid, t.w, q.B2 as b from t join {px} q on q.r = t.rr and q.c = t.cc)"""


def _near(k: int, circle: bool) -> str:
    return "with " + _MIRROR.replace("WHERE_K", f"where (a.range - {k}) * (a.range - {k}) + (b.range - {k}) * (b.range - {k}) <= {k * k}" if circle else "").replace("K", str(k))


for _name, _k, _circle, _out, _make in (
    ("focal_mean", 2, True, "case when max(mid) is not null then round(avg(b), 6) end as B2", lambda i: i.focal_mean(2)),
    ("focal_median", 1, False, "round(median(b), 6) as B2", lambda i: i.focal_median(1)),
    ("focal_min", 2, False, "round(min(b), 6) as B2", lambda i: i.focal_min(2)),
    ("focal_max", 2, False, "round(max(b), 6) as B2", lambda i: i.focal_max(2)),
    ("focal_mean_square", 3, False, "case when max(mid) is not null then round(avg(b), 9) end as B2", lambda i: i.focal_mean(3, "square")),
    ("focal_mean_gaussian", 2, False, "case when max(mid) is not null then round(sum(w * b) / sum(case when b is not null then w end), 6) end as B2", lambda i: i.focal_mean(2, "gaussian")),
    ("focal_std", 2, True, "case when max(mid) is not null then round(sqrt(greatest(avg(b * b) - avg(b) * avg(b), 0)), 4) end as B2_std", lambda i: i.focal_std(2)),
):
    query(f"{_near(_k, _circle)} select r, c, {_out} from j group by r, c", _name)(lambda spark, d, f=_make, n=_name: rounded(f(pixels(spark, d, ["B2"])).df, {"focal_std": 4, "focal_mean_square": 9}.get(n, 6)))

_TERRAIN = """with n as (select max(r) as h from {px}), w as (select r, c, elev, lag(elev) over a as u, lead(elev) over a as v, lag(elev) over b as s, lead(elev) over b as t from {px} window a as (partition by c order by r), b as (partition by r order by c)),
    g as (select r, c, case when r = 0 then v - elev when r = h then elev - u else (v - u) / 2 end / 10 as gy, case when c = 0 then t - elev when c = 99 then elev - s else (t - s) / 2 end / 10 as gx from w, n)"""
for _name, _out in (
    ("slope", "degrees(atan(sqrt(gx * gx + gy * gy)))"),
    ("aspect", "case when degrees(atan2(-gx, gy)) < 0 then degrees(atan2(-gx, gy)) + 360 else degrees(atan2(-gx, gy)) end"),
    ("hillshade", "greatest(least(255 * (sin(radians(45)) * cos(atan(sqrt(gx * gx + gy * gy))) + cos(radians(45)) * sin(atan(sqrt(gx * gx + gy * gy))) * cos(radians(315) - atan2(-gx, gy))), 255), 0)"),
):
    query(f"{_TERRAIN} select r, c, round({_out}, 4) + 0.0 as {_name} from g", _name)(
        lambda spark, d, n=_name: rounded(getattr(pixels(spark, d, ["elev"], 32645, (10.0, 0.0, 5e5, 0.0, -10.0, 4e6)), n)().df, 4)
    )


@query("select cast(r / 2 as int) as r, cast(c / 2 as int) as c, round(B8, 6) as B8 from {px} where r % 2 = 1 and c % 2 = 1".replace("r / 2", "floor(r / 2)").replace("c / 2", "floor(c / 2)"))
def resample_nearest(spark, d):
    return rounded(pixels(spark, d, ["B8"]).resample(0.5).df)


@query()
def reproject_utm(spark, d):
    return rounded(pixels(spark, d, ["B8"]).reproject(32646, 100.0).df)


# vector
@query("select id, round(x, 9) as x, round(y, 9) as y, round(v, 4) as v from {pts} where x between 25e-2 and 5e-1 and y between 1e-1 and 6e-1")
def bounds_filter(spark, d):
    fc = FeatureCollection(view(spark, d, PTS).select("id", "x", "y", "v"), fid="id").filterBounds(Geometry.Rectangle(0.25, 0.1, 0.5, 0.6))
    return fc.df.select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"), F.round("v", 4).alias("v"))


@query("select id, round(v, 4) as v, round(B8, 6) as B8, round(B2, 6) as B2 from {pts} left join {px} on r = cast(floor(1e2 - y * 1e2) as int) and c = cast(floor(x * 1e2) as int)")
def sample_raster(spark, d):
    image = pixels(spark, d, ["B8", "B2"], 4326, (0.01, 0.0, 0.0, 0.0, -0.01, 1.0))
    fc = FeatureCollection(view(spark, d, PTS).select("id", "x", "y", "v"), fid="id").sample_raster(image)
    return fc.df.select("id", F.round("v", 4).alias("v"), F.round("B8", 6).alias("B8"), F.round("B2", 6).alias("B2"))


@query("select id, k, region, k as index_right from {pts} join {cells} on x between minx and maxx and y between miny and maxy")
def spatial_join(spark, d):
    left, right = FeatureCollection(view(spark, d, PTS).select("id", "x", "y"), fid="id"), FeatureCollection(view(spark, d, CELLS), fid="k")
    return left.spatial_join(right).select("id", "k", "region", "index_right")


@query("select id, round(v, 4) as v from (select id, case when id % 10 = 0 then null else v end as v from {pts}) order by v desc nulls last, id limit 40")
def fc_sort_limit(spark, d):
    fc = FeatureCollection(view(spark, d, PTS).select("id", "x", "y", F.expr("if(id % 10 = 0, null, v)").alias("v")), fid="id")
    return fc.sort("v", ascending=False).df.limit(40).select("id", F.round("v", 4).alias("v"))


@query("select id, k, region, k as index_right from {pts} left join {cells} on x between minx and maxx - 5e-2 and y between miny and maxy - 5e-2")
def spatial_join_left(spark, d):
    """All cells, each shrunk so that points lie between them."""
    left, right = FeatureCollection(view(spark, d, PTS).select("id", "x", "y"), fid="id"), FeatureCollection(_gaps(spark, d), fid="k")
    return left.spatial_join(right, "left").select("id", "k", "region", "index_right")


@query("select id, k, region, k as index_right from {sup} right join {cells} on x between minx and maxx - 15e-2 and y between miny and maxy - 15e-2")
def spatial_join_right(spark, d):
    left, right = FeatureCollection(view(spark, d, SUP).select("id", "x", "y"), fid="id"), FeatureCollection(_gaps(spark, d, "15e-2"), fid="k")
    return left.spatial_join(right, "right").select("id", "k", "region", "index_right")


@query("select a.k as k_left, b.k as k_right, b.k as index_right from {cells} a join {cells} b on a.minx >= b.minx - 1e-1 and a.maxx <= b.maxx + 2e-1 and a.miny >= b.miny - 1e-1 and a.maxy <= b.maxy + 2e-1")
def spatial_join_within(spark, d):
    cells = view(spark, d, CELLS).select("k", "minx", "miny", "maxx", "maxy")
    wide = cells.selectExpr("k", "minx - 1e-1 as minx", "miny - 1e-1 as miny", "maxx + 2e-1 as maxx", "maxy + 2e-1 as maxy")
    return FeatureCollection(cells, fid="k").spatial_join(FeatureCollection(wide, fid="k"), predicate="within").select("k_left", "k_right", "index_right")


@query("select a.k as k_left, b.id as id, b.id as index_right from {cells} a join {pts} b on b.x between a.minx and a.maxx and b.y between a.miny and a.maxy".replace("a.k as k_left", "a.k as k"))
def spatial_join_contains(spark, d):
    left, right = FeatureCollection(view(spark, d, CELLS), fid="k"), FeatureCollection(view(spark, d, PTS).select("id", "x", "y"), fid="id")
    return left.spatial_join(right, predicate="contains").select("k", "id", "index_right")


@query("select cast(min(k) as bigint) as k, round(avg(region), 6) as region, cast(max(region) as int) as most from {cells}")
def reduce_columns_method(spark, d):
    """FeatureCollection.reduceColumns itself; its values become a row again."""
    fc = FeatureCollection(view(spark, d, CELLS), fid="k")
    row = (fc.reduceColumns(Reducer.min(), ["k"])["k"], fc.reduceColumns(Reducer.mean(), ["region", "absent"])["region"], fc.reduceColumns(Reducer.max(), ["region"])["region"])
    return rounded(spark.createDataFrame([row], "k long, region double, most int"))


@query("select region, cast(min(k) as bigint) as k, round(min(minx), 6) as minx, round(min(miny), 6) as miny, round(max(maxx), 6) as maxx, round(max(maxy), 6) as maxy from {cells} group by region")
def dissolve_bbox(spark, d):
    return rounded(FeatureCollection(view(spark, d, CELLS), fid="k").dissolve("region").df)


@query("""select cast(i * 12 + j as int) as block_id, round(i * 9e-2, 6) as minx, round(j * 9e-2, 6) as miny, round(i * 9e-2 + 9e-2, 6) as maxx, round(j * 9e-2 + 9e-2, 6) as maxy from (select a.range as i, b.range as j from range(12) a, range(12) b)""")
def block_square(spark, d):
    return rounded(block(Geometry.Rectangle(0, 0, 1, 1, crs=3857), spark, 0.09).df)


@query("""with k as (select a.range * 15 + b.range as id, b.range * 9e-2 + (0 - 9e-2) + (a.range % 2) * 45e-3 as cx, a.range * (15e-1 * (9e-2 / sqrt(3))) + (0 - 15e-1 * (9e-2 / sqrt(3))) as cy from range(16) a, range(15) b),
    m as (select *, greatest(0, -cx, cx - 1) as dx, greatest(0, -cy, cy - 1) as dy from k where cx < 1 + 9e-2 and cy < 1 + 15e-1 * (9e-2 / sqrt(3)))
    select round(cx, 6) as cx, round(cy, 6) as cy, round(cx - 45e-3, 6) as minx, round(cy - 9e-2 / sqrt(3), 6) as miny, round(cx + 45e-3, 6) as maxx, round(cy + 9e-2 / sqrt(3), 6) as maxy, cast(row_number() over (order by id) - 1 as int) as block_id
    from m where dx <= 45e-3 + 1e-9 and dy * (sqrt(3) / 2) + dx / 2 <= 45e-3 + 1e-9""")
def block_hex(spark, d):
    return rounded(block(Geometry.Rectangle(0, 0, 1, 1, crs=3857), spark, 0.09, shape="hexagonal").df)


@query("""select id, arg_min(b, (dist, b)) as block_id from (select p.id, k as b, sqrt(greatest(minx - x, x - maxx, 0) * greatest(minx - x, x - maxx, 0) + greatest(miny - y, y - maxy, 0) * greatest(miny - y, y - maxy, 0)) as dist
    from {pts} p, (select k, minx, miny, maxx - 5e-2 as maxx, maxy - 5e-2 as maxy from {cells})) group by id""".replace("arg_min(b, (dist, b))", "min({'d': dist, 'b': b}).b"))
def assign_blocks(spark, d):
    """All cells, each shrunk, so that points between them go to the nearest."""
    cells = _gaps(spark, d).withColumnRenamed("k", "block_id")
    return validation.assign_blocks(view(spark, d, PTS).select("id", "x", "y"), cells).select("id", "block_id")


_HEX = """h as (select a.range * 15 + b.range as id, b.range * 9e-2 + (0 - 9e-2) + (a.range % 2) * 45e-3 as cx, a.range * (15e-1 * (9e-2 / sqrt(3))) + (0 - 15e-1 * (9e-2 / sqrt(3))) as cy from range(16) a, range(15) b),
    n as (select *, row_number() over (order by id) - 1 as block_id from h where cx < 1 + 9e-2 and cy < 1 + 15e-1 * (9e-2 / sqrt(3)) and greatest(0, -cx, cx - 1) <= 45e-3 + 1e-9
        and greatest(0, -cy, cy - 1) * (sqrt(3) / 2) + greatest(0, -cx, cx - 1) / 2 <= 45e-3 + 1e-9)"""


@query(f"with {_HEX} select id, cast(arg_min(block_id, d) as int) as block_id from (select p.id, n.block_id, (p.x - cx) * (p.x - cx) + (p.y - cy) * (p.y - cy) as d from {{pts}} p, n) group by id")
def assign_hexagons(spark, d):
    """The hexagon a point lies in is the one with the nearest centre."""
    hexagons = block(Geometry.Rectangle(0, 0, 1, 1, crs=3857), spark, 0.09, shape="hexagonal").df
    return validation.assign_blocks(view(spark, d, PTS).select("id", "x", "y"), hexagons).select("id", "block_id")


# spatial statistics
_EDGES = "e as (select i, j, 125e-3 as w from (select a.id as i, b.id as j, row_number() over (partition by a.id order by sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)), b.id) as n from {pts} a join {pts} b on a.id <> b.id) where n <= 8)"
_Z = "z as (select id, v - avg(v) over () as z, count(*) over () * 1e0 as n from {pts})"


@query(f"with {_EDGES} select i, j, w from e")
def knn_weights(spark, d):
    return rounded(spatial.knn_weights(view(spark, d, PTS), 8))


@query("with e as (select a.id as i, b.id as j from {pts} a join {pts} b on a.id <> b.id and sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) <= 3e-2) select i, j, round(1e0 / count(*) over (partition by i), 6) as w from e")
def distance_weights(spark, d):
    return rounded(spatial.distance_weights(view(spark, d, PTS), 0.03))


_MORAN = f"""with {_EDGES}, {_Z}, m as (select max(n) as n, sum(z * z) as ss, sum(z * z * z * z) as m4 from z),
    x as (select sum(w) as s0, sum(w * a.z * b.z) as num from e join z a on a.id = i join z b on b.id = j),
    s1 as (select sum(w * w) as s1 from (select sum(w) as w from e group by least(i, j), greatest(i, j))),
    s2 as (select sum(w * w) as s2 from (select sum(w) as w from (select i as k, w from e union all select j, w from e) group by k)),
    a as (select *, (m4 / n) / pow(ss / n, 2) as b2, -1 / (n - 1) as expected from m, x, s1, s2),
    v as (select *, n / s0 * num / ss as I, (n * ((n * n - 3 * n + 3) * s1 - n * s2 + 3 * s0 * s0) - b2 * ((n * n - n) * s1 - 2 * n * s2 + 6 * s0 * s0)) / ((n - 1) * (n - 2) * (n - 3) * s0 * s0) - expected * expected as variance from a)"""


@query(f"{_MORAN} select cast(n as bigint) as n, round(I, 6) + 0.0 as I, round(expected, 6) as expected, round(variance, 9) as variance, round((I - expected) / sqrt(variance), 5) + 0.0 as z_score from v")
def morans_i(spark, d):
    p = view(spark, d, PTS)
    df = spatial.moran_frame(p, "v", spatial.knn_weights(p, 8))
    return df.select("n", (F.round("I", 6) + 0.0).alias("I"), F.round("expected", 6).alias("expected"), F.round("variance", 9).alias("variance"), (F.round("z_score", 5) + 0.0).alias("z_score"))


@query(f"with {_EDGES}, {_Z} select cast(max(a.n) as bigint) as n, round((max(a.n) - 1) * sum(w * pow(a.z - b.z, 2)) / (2 * sum(w) * (select sum(z * z) from z)), 6) as C from e join z a on a.id = i join z b on b.id = j")
def gearys_c(spark, d):
    p = view(spark, d, PTS)
    return rounded(spatial.geary_frame(p, "v", spatial.knn_weights(p, 8)))


@query(f"""with {_EDGES}, {_Z}, l as (select i, sum(w * z) as lag, sum(w) as wr, sum(w * w) as wq from e join z on id = j group by i),
    s as (select avg(z * z) as s2, avg(z * z * z * z) as m4, max(n) as n from z),
    o as (select id, z, lag, wr, wq, s.*, z / s2 * lag as li, -wr / (s.n - 1) as ex, m4 / (s2 * s2) as b2 from z join l on i = id, s)
    select id, round(z, 4) + 0.0 as v_std, round(li, 5) + 0.0 as I, round((li - ex) / sqrt(greatest(wq * (n - b2) / (n - 1) + (wr * wr - wq) * (2 * b2 - n) / ((n - 1) * (n - 2)) - ex * ex, 1e-10)), 4) + 0.0 as z_score from o""")
def lisa(spark, d):
    df = spatial.local_morans_i(view(spark, d, PTS).select("id", "x", "y", "v"), "v")
    return df.select("id", (F.round("v_std", 4) + 0.0).alias("v_std"), (F.round("I", 5) + 0.0).alias("I"), (F.round("z_score", 4) + 0.0).alias("z_score"))


@query(f"""with {_EDGES}, {_Z}, l as (select i, sum(w * z) as lag, sum(w) as wr, sum(w * w) as wq from e join z on id = j group by i),
    s as (select avg(z * z) as s2, avg(z * z * z * z) as m4, max(n) as n from z),
    o as (select id, z, lag, wr, wq, s.*, z / s2 * lag as li, -wr / (s.n - 1) as ex, m4 / (s2 * s2) as b2 from z join l on i = id, s)
    select id, case when abs((li - ex) / sqrt(greatest(wq * (n - b2) / (n - 1) + (wr * wr - wq) * (2 * b2 - n) / ((n - 1) * (n - 2)) - ex * ex, 1e-10))) < 1959963984540054e-15 then 'not significant'
        when z > 0 and lag > 0 then 'HH' when z < 0 and lag < 0 then 'LL' when z > 0 and lag < 0 then 'HL' else 'LH' end as cluster from o""")
def lisa_clusters(spark, d):
    """Clusters at p = 0.05, the two-sided tail of z = 1.96."""
    return spatial.local_morans_i(view(spark, d, PTS).select("id", "x", "y", "v"), "v").select("id", "cluster")


@query("""with q as (select sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2)) as dd, pow(a.v - b.v, 2) / 2 as s from {pts} a join {pts} b on a.id < b.id)
    select cast(floor(dd / (5e-2 / 10)) as int) as lag, round(avg(dd), 6) as distance, round(avg(s), 2) as semivariance, count(*) as pairs from q where dd < 5e-2 group by 1""")
def variogram(spark, d):
    df = spatial.variogram(view(spark, d, PTS), "v", 10, 0.05)
    return df.select("lag", F.round("distance", 6).alias("distance"), F.round("semivariance", 2).alias("semivariance"), "pairs")


@query(f"{_MORAN} select cast(n as bigint) as n, round(n * (1 - greatest(0, least(99e-2, I))) / (1 + greatest(0, least(99e-2, I))), 3) as effective_n, round(n / greatest(1, n * (1 - greatest(0, least(99e-2, I))) / (1 + greatest(0, least(99e-2, I)))), 5) as design_effect from v")
def ess(spark, d):
    p = view(spark, d, PTS)
    row = spatial.moran_frame(p, "v", spatial.knn_weights(p, 8))
    effective, design = spatial.ess_column(F.col("I"), F.col("n"))
    return row.select("n", F.round(effective, 3).alias("effective_n"), F.round(design, 5).alias("design_effect"))


@query("""with q as (select min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as m from {pts} a join {pts} b on a.id <> b.id group by a.id), s as (select avg(m) as m from q),
    t as (select count(*) as n, greatest(1e-5, (max(x) - min(x)) * (max(y) - min(y))) as area from {pts})
    select n as sample_size, round(m, 6) as mean_nn_distance, round(m / (5e-1 / sqrt(n / area)), 5) as clark_evans_r, case when m / (5e-1 / sqrt(n / area)) < 9e-1 then 'Clustered' when m / (5e-1 / sqrt(n / area)) > 11e-1 then 'Dispersed' else 'Random' end as spatial_pattern from s, t""")
def bias_report(spark, d):
    df = spatial.bias_report(view(spark, d, PTS))
    return df.select("sample_size", F.round("mean_nn_distance", 6).alias("mean_nn_distance"), F.round("clark_evans_r", 5).alias("clark_evans_r"), "spatial_pattern")


@query("""with q as (select min(sqrt(pow(a.x - b.x, 2) + pow(a.y - b.y, 2))) as m from {sup} a, {pts} b group by a.id)
    select (select count(*) from {pts}) as train_count, (select count(*) from {sup}) as test_count, round(min(m), 6) as min_distance, count(case when m < 1e-7 then 1 end) as duplicate_count, min(m) < 1e-2 as buffer_violation from q""")
def leakage_report(spark, d):
    return rounded(validation.leakage_frame(view(spark, d, PTS), view(spark, d, SUP), 0.01))


@query(f"""with p as (select id, x, y, v, v * 9e-1 + id % 7 * 1e1 as f from {{pts}}), {_EDGES}, z as (select id, (v - f) - avg(v - f) over () as z from p)
    select (select count(*) from p) as n, round((select sqrt(avg(pow(v - f, 2))) from p), 4) as rmse, round((select avg(abs(v - f)) from p), 4) as mae,
    round((select 1 - sum(pow(v - f, 2)) / (var_pop(v) * count(*)) from p), 6) as r2, round(count(distinct i) / sum(w) * sum(w * a.z * b.z) / (select sum(z * z) from z), 6) + 0.0 as moran_i from e join z a on a.id = i join z b on b.id = j""")
def evaluate_spatial(spark, d):
    p = view(spark, d, PTS).withColumn("f", F.expr("v * 9e-1 + id % 7 * 1e1"))
    df = validation.evaluate_spatial(p, "v", "f")
    return df.select("n", F.round("rmse", 4).alias("rmse"), F.round("mae", 4).alias("mae"), F.round("r2", 6).alias("r2"), (F.round("moran_i", 6) + 0.0).alias("moran_i"))


# inference
@query("""with s as (select count(*) filter (g = 'BUILDING') as n1, avg(v) filter (g = 'BUILDING') as m1, var_samp(v) filter (g = 'BUILDING') as v1, count(*) filter (g = 'MACHINERY') as n2, avg(v) filter (g = 'MACHINERY') as m2, var_samp(v) filter (g = 'MACHINERY') as v2 from {pts})
    select round((m1 - m2) / sqrt(v1 / n1 + v2 / n2), 6) + 0.0 as statistic, round((m1 - m2) / sqrt(((n1 - 1) * v1 + (n2 - 1) * v2) / (n1 + n2 - 2)), 6) + 0.0 as effect from s""")
def welch_t(spark, d):
    m = {k: inference.group_moments(view(spark, d, PTS), "v", "g").filter(F.col("g") == k).select(*[F.col(c).alias(f"{c}{i}") for c in ("n", "mean", "var")]) for i, k in ((1, "BUILDING"), (2, "MACHINERY"))}
    row = m["BUILDING"].crossJoin(m["MACHINERY"])  # one row each
    diff = F.col("mean1") - F.col("mean2")
    pooled = ((F.col("n1") - 1) * F.col("var1") + (F.col("n2") - 1) * F.col("var2")) / (F.col("n1") + F.col("n2") - 2)
    return rounded(row.select((diff / F.sqrt(F.col("var1") / F.col("n1") + F.col("var2") / F.col("n2"))).alias("statistic"), (diff / F.sqrt(pooled)).alias("effect")))


@query("""with s as (select g, round(v / 100) as q from {pts} where g in ('BUILDING', 'MACHINERY')), k as (select g, rank() over (order by q) + (count(*) over (partition by q) - 1) / 2e0 as rk from s)
    select g, count(*) as n, round(sum(rk), 3) as ranks, round(sum(rk) - count(*) * (count(*) + 1) / 2e0, 3) as u from k group by g""")
def mann_whitney(spark, d):
    df = view(spark, d, PTS).filter("g in ('BUILDING', 'MACHINERY')").withColumn("q", F.round(F.col("v") / 100))
    return rounded(inference.rank_sums(df, "q", "g").select("g", "n", "ranks", (F.col("ranks") - F.col("n") * (F.col("n") + 1) / 2).alias("u")), 3)


@query("""with m as (select g, count(*) as n, avg(v) as m, var_samp(v) as s from {pts} group by g), t as (select avg(v) as a, count(*) as n from {pts}),
    q as (select sum(m.n * pow(m - a, 2)) as b, sum((m.n - 1) * s) as w, count(*) as k, max(t.n) as n from m, t)
    select round((b / (k - 1)) / (w / (n - k)), 6) as statistic, round(b / (b + w), 6) as effect from q""")
def anova(spark, d):
    m = inference.group_moments(view(spark, d, PTS), "v", "g")
    t = m.agg(F.sum(F.col("n") * F.col("mean")).alias("s"), F.sum("n").alias("t"))
    q = m.crossJoin(t).agg(F.sum(F.col("n") * (F.col("mean") - F.col("s") / F.col("t")) ** 2).alias("b"), F.sum((F.col("n") - 1) * F.col("var")).alias("w"), F.count("*").alias("k"), F.max("t").alias("t"))  # one row
    return rounded(q.select(((F.col("b") / (F.col("k") - 1)) / (F.col("w") / (F.col("t") - F.col("k")))).alias("statistic"), (F.col("b") / (F.col("b") + F.col("w"))).alias("effect")))


# sampling and splits
@query()
def stratified(spark, d):
    return rounded(validation.stratified(pixels(spark, d, ["SCL", "B8"]).df, "SCL", 50))


@query()
def min_distance(spark, d):
    return validation.min_distance(view(spark, d, PTS).select("id", "x", "y"), 500, 0.02).select("id")


@query()
def spatial_cv(spark, d):
    cells = view(spark, d, CELLS).withColumnRenamed("k", "block_id")
    return validation.SpatialCV(cells).folds(view(spark, d, PTS).select("id", "x", "y")).select("id", "block_id", "fold")


_FOLDS = """b as (select p.id, x, y, min(k) as block_id from {pts} p join {cells} on x between minx and maxx and y between miny and maxy group by p.id, x, y),
    g as (select block_id, ntile(5) over (order by block_id) - 1 as fold from (select distinct block_id from b))"""


@query(f"with {_FOLDS} select id, block_id, cast(fold as int) as fold from b join g using (block_id)")
def spatial_cv_in_order(spark, d):
    """Folds of blocks in the order of their ids."""
    cells = view(spark, d, CELLS).withColumnRenamed("k", "block_id")
    return validation.SpatialCV(cells, shuffle=False).folds(view(spark, d, PTS).select("id", "x", "y")).select("id", "block_id", "fold")


@query(f"with {_FOLDS}, f as (select id, x, y, fold from b join g using (block_id)) select distinct p.id, cast(q.fold as int) as fold from f p join f q on p.fold <> q.fold and sqrt(pow(p.x - q.x, 2) + pow(p.y - q.y, 2)) <= 2e-2")
def buffered_cv_in_order(spark, d):
    cv = validation.BufferedSpatialCV(0.02, blocks=view(spark, d, CELLS).withColumnRenamed("k", "block_id"), shuffle=False)
    return cv.excluded(cv.folds(view(spark, d, PTS).select("id", "x", "y")))


@query(f"""with f as (select id, x, y, cast(id % 5 as int) as fold from {{pts}}) select distinct p.id, q.fold from f p join f q on p.fold <> q.fold
    and 6378137 * sqrt(pow(radians(p.x - q.x), 2) + pow(ln(tan(pi() / 4 + radians(p.y) / 2)) - ln(tan(pi() / 4 + radians(q.y) / 2)), 2)) <= 2e3""")
def buffered_cv_mercator(spark, d):
    """Points in degrees, buffered in metres of the Mercator projection."""
    from ..functions import crs

    x, y = crs.transform(F.col("x"), F.col("y"), 4326, 3857)
    points = view(spark, d, PTS).select("id", x.alias("x"), y.alias("y"), (F.col("id") % 5).cast("int").alias("fold"))
    return validation.BufferedSpatialCV(2000.0, crs=3857).excluded(points)


@query()
def buffered_cv(spark, d):
    cv = validation.BufferedSpatialCV(0.02, blocks=view(spark, d, CELLS).withColumnRenamed("k", "block_id"))
    return cv.excluded(cv.folds(view(spark, d, PTS).select("id", "x", "y")))


@query("""with h as (select max(r) + 1 as h from {px}), k as (select a.range * 4 as r0, b.range * 4 as c0 from range(100000) a, range(24) b, h where a.range * 4 + 8 <= h and b.range * 4 + 8 <= 100)
    select cast(r0 / 4 * 24 + c0 / 4 as bigint) as patch_id, cast(r0 as int) as r, cast(c0 as int) as c, count(B2) as n_valid from k join {px} on r >= r0 and r < r0 + 8 and {px}.c >= c0 and {px}.c < c0 + 8 group by r0, c0 having count(B2) > 64 * 2e-1""")
def patch_grid(spark, d):
    return rounded(validation.PatchDataset(pixels(spark, d, ["B2"]), patch_size=8, stride=4).windows())


@query()
def patch_split(spark, d):
    return rounded(validation.PatchDataset(pixels(spark, d, ["B2"]), patch_size=8, stride=8).split(block_size=0.024))


# sources and sinks
@query("""select lat_lowestmode as latitude, lon_lowestmode as longitude, shot_number, round(sensitivity, 6) as sensitivity, round(agbd, 4) as agbd from {shots}
    where quality_flag = 1 and degrade_flag = 0 and sensitivity >= 9e-1 and lon_lowestmode between -90 and 90 and lat_lowestmode between -45 and 45
    and delta_time >= date_diff('day', date '2018-01-01', date '1996-01-01') * 864e2 and delta_time < date_diff('day', date '2018-01-01', date '1998-07-01') * 864e2""")
def gedi_shots(spark, d):
    q = GEDI(shots=view(spark, d, SHOTS)).filterBounds(Geometry.Rectangle(-90, -45, 90, 45)).filterDate("1996-01-01", "1998-06-30").filterQuality()
    df = q.select(["shot_number", "sensitivity", "agbd"]).to_frame()
    return df.select("latitude", "longitude", "shot_number", F.round("sensitivity", 6).alias("sensitivity"), F.round("agbd", 4).alias("agbd"))


@query("""select '{"type":"Feature","geometry":{"type":"Point","coordinates":[' || cast(id % 64 as varchar) || '.5,' || cast(id % 32 as varchar) || '.25]},"properties":{"g":"' || g || '"}}' as value from {pts}""")
def sink_geojson(spark, d):
    df = view(spark, d, PTS).select("id", (F.col("id") % 64 + 0.5).cast("double").alias("x"), (F.col("id") % 32 + 0.25).cast("double").alias("y"), "g")
    return features.geojson(FeatureCollection(df, fid="id"))


@query("select cast(cast(ts as date) as varchar(10)) as day, event_type, round(avg(value), 9) as mean, count(value) as n from events group by 1, 2")
def stream_composite(spark, d):
    """The running composite over all events at once, as a batch."""
    df = running_composite(spark.read.parquet(f"{d}/events.parquet"), "value", ["event_type"])
    return df.select(F.date_format("start", "yyyy-MM-dd").alias("day"), "event_type", F.round("mean", 9).alias("mean"), F.col("count").alias("n"))


@query("select id, 'POINT (' || cast(id % 64 as varchar) || '.5 ' || cast(id % 32 as varchar) || '.25)' as wkt from {pts}")
def sink_wkt(spark, d):
    df = view(spark, d, PTS).select("id", (F.col("id") % 64 + 0.5).cast("double").alias("x"), (F.col("id") % 32 + 0.25).cast("double").alias("y"))
    return df.select("id", features.wkt(FeatureCollection(df, fid="id")).alias("wkt"))
