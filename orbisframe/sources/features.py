"""Features from and to GeoJSON, CSV with WKT, and Parquet with WKB; points and boxes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.vector import BOX, FeatureCollection

_FEATURE = "type string, geometry struct<type: string, coordinates: string>, properties map<string, string>"
_COLLECTION = "features array<struct<type: string, geometry: struct<type: string, coordinates: string>, properties: map<string, string>>>"
_NUMBER = r"(-?[0-9.]+(?:[eE][-+]?[0-9]+)?)"


def read_geojson(spark: SparkSession, path: str, crs=None) -> FeatureCollection:
    """Feature collections, one document a file: properties as text, and the box of each geometry. fid is the position in the
    file, and with several files the file's place by name times 2^32 more, so that no two features share one."""
    docs = spark.read.option("wholetext", True).text(path).select(F.from_json("value", _COLLECTION).alias("d"), F.input_file_name().alias("file"))
    names = sorted(r["file"] for r in docs.select("file").distinct().collect())  # names only
    place = F.array_position(F.lit(names), F.col("file")) - 1 if len(names) > 1 else F.lit(0).cast("long")
    rows = docs.select(place.alias("n"), F.posexplode("d.features").alias("at", "f"))
    return _located(rows.select((F.col("n") * F.lit(1 << 32).cast("long") + F.col("at")).alias("fid"), F.col("f.geometry.type").alias("geometry_type"), F.col("f.geometry.coordinates").alias("c"), F.col("f.properties").alias("properties")), crs)


def read_geojson_lines(spark: SparkSession, path: str, crs=None) -> FeatureCollection:
    """One feature a line; splittable, so the form for large files. fid numbers the rows by split and place in it, equal features apart."""
    rows = spark.read.schema(_FEATURE).json(path).withColumn("fid", F.monotonically_increasing_id()).filter("geometry is not null")
    located = rows.select("fid", F.col("geometry.type").alias("geometry_type"), F.col("geometry.coordinates").alias("c"), "properties")
    return _located(located, crs)


def _located(rows: DataFrame, crs) -> FeatureCollection:
    pair = F.regexp_extract_all("c", F.lit(rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}"), F.lit(0))
    xs = F.transform(pair, lambda p: F.regexp_extract(p, rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}", 1).cast("double"))
    ys = F.transform(pair, lambda p: F.regexp_extract(p, rf"\[\s*{_NUMBER}\s*,\s*{_NUMBER}", 2).cast("double"))
    boxed = rows.withColumn("__x", xs).withColumn("__y", ys)
    box = [F.array_min("__x").alias("minx"), F.array_min("__y").alias("miny"), F.array_max("__x").alias("maxx"), F.array_max("__y").alias("maxy")]
    return FeatureCollection(boxed.select("fid", "geometry_type", "properties", *box), crs)


def wkt(fc: FeatureCollection) -> Column:
    """The geometry of each row as WKT."""
    if fc.kind is not BOX:
        return F.concat(F.lit("POINT ("), F.col("x").cast("string"), F.lit(" "), F.col("y").cast("string"), F.lit(")"))
    x0, y0, x1, y1 = (F.col(c).cast("string") for c in BOX)
    corners = [F.concat_ws(" ", a, b) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1), (x0, y0))]
    return F.concat(F.lit("POLYGON (("), F.concat_ws(", ", *corners), F.lit("))"))


def _little_endian(x: Column) -> Column:
    """A double as the eight bytes of WKB, from its Java bits by way of the sign, exponent and fraction."""
    size = F.abs(x)
    normal = size >= 2.2250738585072014e-308
    power = F.when(normal, F.floor(F.log2(F.when(normal, size)))).cast("long")
    scaled = size / F.pow(F.lit(2.0), power)
    power = power + F.when(scaled >= 2, 1).when(scaled < 1, -1).otherwise(0)
    fraction = ((size / F.pow(F.lit(2.0), power) - 1) * float(1 << 52)).cast("long")
    bits = F.when(normal, F.shiftleft(power + 1023, 52) + fraction).otherwise(F.lit(0).cast("long"))
    hexed = F.lpad(F.hex(bits + F.when(x < 0, F.lit(-(1 << 63))).otherwise(F.lit(0))), 16, "0")
    return F.unhex(F.concat(*[F.substring(hexed, 2 * k + 1, 2) for k in range(7, -1, -1)]))


def wkb(fc: FeatureCollection) -> Column:
    """The geometry of each row as little-endian WKB."""
    flat = lambda *names: F.concat(*[_little_endian(F.col(n)) for n in names])
    if fc.kind is not BOX:
        return F.concat(F.lit(b"\x01\x01\x00\x00\x00"), flat("x", "y"))
    head = b"\x01\x03\x00\x00\x00\x01\x00\x00\x00\x05\x00\x00\x00"
    return F.concat(F.lit(head), flat("minx", "miny", "maxx", "miny", "maxx", "maxy", "minx", "maxy", "minx", "miny"))


def geojson(fc: FeatureCollection) -> DataFrame:
    """One column, value: a GeoJSON feature a row."""
    if fc.kind is BOX:
        ring = F.array(*[F.array(F.col(a), F.col(b)) for a, b in (("minx", "miny"), ("maxx", "miny"), ("maxx", "maxy"), ("minx", "maxy"), ("minx", "miny"))])
        shape = F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates"))
    else:
        shape = F.struct(F.lit("Point").alias("type"), F.array("x", "y").alias("coordinates"))
    props = F.struct(*[F.col(c) for c in fc.columns]) if fc.columns else F.lit(None).cast("map<string,string>")
    return fc.df.select(F.to_json(F.struct(F.lit("Feature").alias("type"), shape.alias("geometry"), props.alias("properties")), {"ignoreNullFields": "false"}).alias("value"))


def write_geojson(fc: FeatureCollection, path: str) -> None:
    """GeoJSON lines."""
    geojson(fc).write.mode("overwrite").text(path)


def write_csv(fc: FeatureCollection, path: str) -> None:
    fc.df.withColumn("geometry", wkt(fc)).drop(*fc.kind).write.mode("overwrite").csv(path, header=True)


def write_parquet(fc: FeatureCollection, path: str) -> None:
    fc.df.withColumn("geom", wkb(fc)).write.mode("overwrite").parquet(path)


def read_parquet(spark: SparkSession, path: str, crs=None, fid: str = "fid") -> FeatureCollection:
    """What write_parquet wrote; geom holds the WKB."""
    return FeatureCollection(spark.read.parquet(path), crs, fid)
