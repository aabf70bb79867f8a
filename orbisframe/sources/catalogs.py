"""Scene catalogues: local STAC items and granule listings. Searches over the network are not part of this library."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.crs import transform_bounds
from ..functions.dates import to_day
from ..operators.geometry import Geometry

_ITEM = "id string, collection string, bbox array<double>, properties map<string, string>, assets map<string, struct<href: string>>"
#: Dataset names by which users know the collections of NASA's catalogue.
SHORT_NAMES = {"HLS_L30": "HLSL30", "HLS_S30": "HLSS30", "GEDI_L2A": "GEDI02_A", "GEDI_L2B": "GEDI02_B", "GEDI_L4A": "GEDI_L4A_AGB_Density_V2_1_2056"}
SUFFIXES = (".tif", ".tiff", ".h5", ".hdf", ".hdf5", ".nc", ".zip")


def read_items(spark: SparkSession, path: str) -> DataFrame:
    """STAC items, one JSON a line: (id, collection, bbox, datetime, cloud_cover, properties, assets)."""
    rows = spark.read.schema(_ITEM).json(path)
    cloud = F.element_at("properties", "eo:cloud_cover").try_cast("double")
    return rows.select("id", "collection", "bbox", F.element_at("properties", "datetime").alias("datetime"), cloud.alias("cloud_cover"), "properties", "assets")


def search_stac(items: DataFrame, collection: str, geometry: Geometry | None = None, start: str = "2000-01-01", end: str = "2030-01-01", limit: int = 100, cloud_cover: float | None = None) -> DataFrame:
    """Items of a collection whose box meets the geometry's (in degrees) and whose day lies in [start, end]; the first limit by time, id."""
    day = to_day(F.col("datetime"))
    keep = (F.col("collection") == collection) & day.between(to_day(F.lit(start)), to_day(F.lit(end)))
    if geometry is not None:
        x0, y0, x1, y1 = transform_bounds(geometry.bounds, geometry.crs, 4326)
        b = F.col("bbox")
        keep = keep & (b[0] <= x1) & (b[2] >= x0) & (b[1] <= y1) & (b[3] >= y0)
    if cloud_cover is not None:
        keep = keep & (F.coalesce("cloud_cover", F.lit(0.0)) <= cloud_cover)
    return items.filter(keep).orderBy("datetime", "id").limit(limit)


def nearest_items(slices: DataFrame, items: DataFrame, seconds: int = 86400) -> DataFrame:
    """(time, id): for each time slice the item nearest in time within seconds; by day buckets, then the nearest."""
    t = F.unix_seconds(F.col("time").cast("timestamp"))
    s = slices.select("time", t.alias("t")).withColumn("__b", F.explode(F.array(*[F.floor(t / seconds) + k for k in (-1, 0, 1)])))
    u = F.unix_seconds(F.col("datetime").cast("timestamp"))
    i = items.select("id", u.alias("u"), F.floor(u / seconds).alias("__b"))
    near = s.join(i, "__b").filter(F.abs(F.col("t") - F.col("u")) <= seconds)
    return near.groupBy("time").agg(F.min(F.struct(F.abs(F.col("t") - F.col("u")), "id"))["id"].alias("id"))


def granule_key(path: Column) -> Column:
    """The first four dot-separated parts of a file's name: files of one granule share it."""
    return F.array_join(F.slice(F.split(F.element_at(F.split(path, "/"), -1), r"\."), 1, 4), ".")


def granules(files: DataFrame, path_col: str = "path") -> DataFrame:
    """(granule, day, files): a row for each granule, its day from the key's last part, its files in order."""
    key = granule_key(F.col(path_col))
    grouped = files.filter(F.lower(path_col).rlike("(" + "|".join(s.replace(".", r"\.") for s in SUFFIXES) + ")$")).groupBy(key.alias("granule"))
    return grouped.agg(F.sort_array(F.collect_list(path_col)).alias("files")).select("granule", to_day(F.element_at(F.split("granule", r"\."), -1)).alias("day"), "files")
