"""Feature collections: attribute columns plus x and y (points) or minx, miny, maxx, maxy (boxes), and fid for order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import crs as crs_
from .base import EarthObject
from .filter import Filter
from .geometry import Geometry
from .raster import Image
from .reducer import Reducer

POINT, BOX = ("x", "y"), ("minx", "miny", "maxx", "maxy")


class FeatureCollection(EarthObject):
    """A frame of features; geometry columns are those of points or boxes."""

    def __init__(self, df: DataFrame, crs=None, fid: str = "fid", metadata: dict | None = None):
        super().__init__(metadata)
        self.df, self.crs, self.fid = df, crs_.CRS(crs), fid
        self.kind = BOX if all(c in df.columns for c in BOX) else POINT
        if any(c not in df.columns for c in self.kind):
            raise ValueError("the frame needs x and y, or minx, miny, maxx and maxy")

    def _of(self, df: DataFrame) -> FeatureCollection:
        return type(self)(df, self.crs, self.fid, dict(self._metadata))

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c not in (*self.kind, self.fid)]

    def center(self) -> tuple[Column, Column]:
        """Columns of the centroid."""
        if self.kind is POINT:
            return F.col("x"), F.col("y")
        return (F.col("minx") + F.col("maxx")) / 2, (F.col("miny") + F.col("maxy")) / 2

    @property
    def bounds(self) -> tuple[float, float, float, float]:
        x0, y0, x1, y1 = self.kind if self.kind is BOX else (*POINT, *POINT)
        return tuple(self.df.agg(F.min(x0), F.min(y0), F.max(x1), F.max(y1)).first())

    def size(self) -> int:
        return self.df.count()

    __len__ = size

    def first(self):
        return self.df.orderBy(self.fid).first()

    def __iter__(self):
        return self.df.orderBy(self.fid).toLocalIterator()

    # relational operators
    def filter(self, f: Filter) -> FeatureCollection:
        return self._of(f.apply(self.df))

    def filterBounds(self, geometry: Geometry) -> FeatureCollection:
        """Features that meet the geometry; touching counts."""
        return self.filter(Filter.bounds(geometry.reproject(self.crs)))

    def select(self, columns: list[str]) -> FeatureCollection:
        """Those of the columns that exist, and the geometry."""
        names = [c for c in ([columns] if isinstance(columns, str) else columns) if c in self.df.columns]
        return self._of(self.df.select(*dict.fromkeys([*([self.fid] if self.fid in self.df.columns else []), *names, *self.kind])))

    def sort(self, column: str, ascending: bool = True) -> FeatureCollection:
        c = F.col(column)
        return self._of(self.df.orderBy(c.asc_nulls_last() if ascending else c.desc_nulls_last(), self.fid))

    def limit(self, n: int) -> FeatureCollection:
        return self._of(self.df.orderBy(self.fid).limit(n))

    def reduceColumns(self, reducer: Reducer, selectors: list[str]) -> dict:
        """One value for each of the columns that exist."""
        names = [c for c in selectors if c in self.df.columns]
        return self.df.agg(*[reducer.column(F.col(c), F.col(self.fid)).alias(c) for c in names]).first().asDict(recursive=True) if names else {}

    def dissolve(self, by: str | None = None, aggfunc: str = "first") -> FeatureCollection:
        """One feature a key: the box around its members; attributes by first, sum, mean, min, max or count."""
        made = {"first": lambda c: F.min_by(F.struct(F.col(c).alias("v")), F.col(self.fid))["v"], "sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "count": F.count}[aggfunc]
        x0, y0, x1, y1 = self.kind if self.kind is BOX else (*POINT, *POINT)
        box = [F.min(x0).alias("minx"), F.min(y0).alias("miny"), F.max(x1).alias("maxx"), F.max(y1).alias("maxy")]
        rest = [made(c).alias(c) for c in self.columns if c != by]
        return self._of(self.df.groupBy(*([by] if by else [])).agg(F.min(self.fid).alias(self.fid), *rest, *box))

    # geometry per row
    def centroid(self) -> FeatureCollection:
        x, y = self.center()
        return self._of(self.df.select(*[c for c in self.df.columns if c not in self.kind], x.alias("x"), y.alias("y")))

    def buffer(self, d: float) -> FeatureCollection:
        """The boxes around the buffers of the features; tests of membership use exact distances instead."""
        x0, y0, x1, y1 = self.kind if self.kind is BOX else (*POINT, *POINT)
        box = [(F.col(x0) - d).alias("minx"), (F.col(y0) - d).alias("miny"), (F.col(x1) + d).alias("maxx"), (F.col(y1) + d).alias("maxy")]
        return self._of(self.df.select(*[c for c in self.df.columns if c not in self.kind], *box))

    def simplify(self, tolerance: float) -> FeatureCollection:
        """Points and boxes are as simple as they get."""
        return self

    def reproject(self, dst) -> FeatureCollection:
        if self.crs == dst:
            return self
        rest = [c for c in self.df.columns if c not in self.kind]
        if self.kind is BOX:  # the box around the moved edges, each taken at 21 points
            share = F.transform(F.sequence(F.lit(0), F.lit(20)), lambda k: k / 20)
            x0, y0, x1, y1 = (F.col(c) for c in BOX)
            place = lambda x, y: F.struct(x.alias("x"), y.alias("y"))
            across, up = (lambda s: x0 + (x1 - x0) * s), (lambda s: y0 + (y1 - y0) * s)
            edge = F.concat(*[F.transform(share, f) for f in (lambda s: place(across(s), y0), lambda s: place(across(s), y1), lambda s: place(x0, up(s)), lambda s: place(x1, up(s)))])
            moved = F.transform(edge, lambda p: place(*crs_.transform(p["x"], p["y"], self.crs, dst)))
            made = self.df.select(*rest, moved.alias("__edge"))
            ends = [f(f"__edge.{c}").alias(n) for f, c, n in ((F.array_min, "x", "minx"), (F.array_min, "y", "miny"), (F.array_max, "x", "maxx"), (F.array_max, "y", "maxy"))]
            made = made.select(*rest, *ends)
        else:
            x, y = crs_.transform(F.col("x"), F.col("y"), self.crs, dst)
            made = self.df.select(*rest, x.alias("x"), y.alias("y"))
        return type(self)(made, dst, self.fid, dict(self._metadata))

    def metric(self) -> FeatureCollection:
        """In the UTM zone of the bounds' centre where the coordinates are degrees."""
        if not self.crs.is_geographic:
            return self
        x0, y0, x1, y1 = self.bounds
        return self.reproject(crs_.utm_epsg((x0 + x1) / 2, (y0 + y1) / 2))

    # joins
    def spatial_join(self, other: FeatureCollection, how: str = "inner", predicate: str = "intersects", cell: float | None = None) -> DataFrame:
        """Pairs by predicate (intersects, contains, within). Columns of both that clash get _left and _right; index_right is
        the other's fid. Both sides are dealt into grid cells that they touch, joined on the cell, and each pair is kept in one
        cell only: that of the upper right of the two boxes' lower left corners."""
        x0, y0, x1, y1 = other.bounds if other.kind is BOX else self.bounds
        if cell is None:
            wide = other.df.agg(F.avg(F.col("maxx") - F.col("minx")), F.avg(F.col("maxy") - F.col("miny"))).first() if other.kind is BOX else (0, 0)
            cell = max(wide[0] or 0, wide[1] or 0) or max(((x1 or 0) - (x0 or 0)) / 64, ((y1 or 0) - (y0 or 0)) / 64) or 1.0

        def dealt(fc: FeatureCollection, side: str) -> DataFrame:
            a, b, c, d = fc.kind if fc.kind is BOX else (*POINT, *POINT)
            clash = (set(self.df.columns) & set(other.df.columns)) - {"geometry"}
            named = fc.df.select(*[F.col(f"`{n}`").alias(f"{n}_{side}" if n in clash else n) for n in fc.df.columns])
            of = lambda n: F.col(f"`{n}_{side}`" if n in clash else f"`{n}`")
            box = named.withColumns({f"__{side}{k}": of(n) for k, n in enumerate((a, b, c, d))})
            span = lambda lo, hi: F.sequence(F.floor(F.col(lo) / cell), F.floor(F.col(hi) / cell))
            return box.withColumn("__i", F.explode(span(f"__{side}0", f"__{side}2"))).withColumn("__j", F.explode(span(f"__{side}1", f"__{side}3")))

        left, right = dealt(self, "left"), dealt(other, "right")
        l, r = ([F.col(f"__{s}{k}") for k in range(4)] for s in ("left", "right"))
        meets = (l[0] <= r[2]) & (l[2] >= r[0]) & (l[1] <= r[3]) & (l[3] >= r[1])
        within = (l[0] >= r[0]) & (l[2] <= r[2]) & (l[1] >= r[1]) & (l[3] <= r[3])
        contains = (r[0] >= l[0]) & (r[2] <= l[2]) & (r[1] >= l[1]) & (r[3] <= l[3])
        test = {"intersects": meets, "within": meets & within, "contains": meets & contains}[predicate]
        once = (F.floor(F.greatest(l[0], r[0]) / cell) == F.col("__i")) & (F.floor(F.greatest(l[1], r[1]) / cell) == F.col("__j"))
        pairs = left.join(right, ["__i", "__j"]).filter(test & once)
        work = {"__i", "__j", *(f"__{s}{k}" for s in ("left", "right") for k in range(4))}
        keep = [c for c in pairs.columns if c not in work]
        fid_right = f"{other.fid}_right" if other.fid in self.df.columns else other.fid
        fid_left = f"{self.fid}_left" if self.fid in other.df.columns else self.fid
        out = pairs.select(*keep, F.col(f"`{fid_right}`").alias("index_right"))
        if how == "inner":
            return out
        base, base_fid, side = (self, fid_left, "left") if how == "left" else (other, fid_right, "right")
        clash = set(self.df.columns) & set(other.df.columns)
        alone = base.df.select(*[F.col(f"`{n}`").alias(f"{n}_{side}" if n in clash else n) for n in base.df.columns]).join(out.select(base_fid).distinct(), base_fid, "left_anti")
        return out.unionByName(alone if how == "left" else alone.withColumn("index_right", F.col(f"`{fid_right}`")), allowMissingColumns=True)

    def sample_raster(self, image: Image, bands: list[str] | None = None, scale=None) -> FeatureCollection:
        """The image's values under each feature's centroid; outside the grid they are missing."""
        x, y = self.center()
        if not self.crs == image.crs:
            x, y = crs_.transform(x, y, self.crs, image.crs)
        r, c = image.grid.pixel(x, y)
        bands = bands or image.bands
        right = image.df.select(F.col("row").alias("__row"), F.col("col").alias("__col"), *[F.col(f"`{b}`") for b in bands])
        at = self.df.drop(*bands).withColumn("__row", F.floor(r).cast("int")).withColumn("__col", F.floor(c).cast("int"))
        return self._of(at.join(right, ["__row", "__col"], "left").drop("__row", "__col"))


Vector = FeatureCollection


def block(aoi: Geometry, spark, size: float = 5000.0, unit: str = "meters", shape: str = "square") -> FeatureCollection:
    """Squares or pointy-top hexagons over an area, numbered in scan order; only cells that meet it, touching included.

    Squares come as boxes; hexagons as boxes with their centre (cx, cy) and circumradius. An area in degrees with a size in
    metres is worked on in its UTM zone and the cells stay in it.
    """
    work = aoi
    if unit.lower() in ("meters", "m") and aoi.crs.is_geographic:
        x0, y0, x1, y1 = aoi.bounds
        work = aoi.reproject(crs_.utm_epsg((x0 + x1) / 2, (y0 + y1) / 2))
    x0, y0, x1, y1 = work.bounds
    if shape.lower() in ("square", "grid"):
        nx, ny = (max(0, -int(-(hi - lo) // size)) for lo, hi in ((x0, x1), (y0, y1)))
        cells = spark.range(nx * ny).select(F.floor(F.col("id") / ny).alias("i"), (F.col("id") % ny).alias("j"), "id")
        cells = cells.select("id", (F.col("i") * size + x0).alias("minx"), (F.col("j") * size + y0).alias("miny"))
        cells = cells.select("*", (F.col("minx") + size).alias("maxx"), (F.col("miny") + size).alias("maxy"))
        cells = cells.filter(work.meets_box(*[F.col(c) for c in BOX]))
    elif shape.lower() == "hexagonal":
        radius = size / 3**0.5
        step = 1.5 * radius
        nx, ny = int((x1 - x0) / size) + 4, int((y1 - y0) / step) + 4
        cells = spark.range(nx * ny).select(F.floor(F.col("id") / nx).alias("r"), (F.col("id") % nx).alias("c"), "id")
        cells = cells.select("id", (F.col("c") * size + (x0 - size) + (F.col("r") % 2) * (size / 2)).alias("cx"), (F.col("r") * step + (y0 - step)).alias("cy"))
        cells = cells.filter((F.col("cx") < x1 + size) & (F.col("cy") < y1 + step))
        cells = cells.select("*", (F.col("cx") - size / 2).alias("minx"), (F.col("cy") - radius).alias("miny"), (F.col("cx") + size / 2).alias("maxx"), (F.col("cy") + radius).alias("maxy"))
        if not work.is_box:
            cells = cells.filter(work.meets_box(*[F.col(c) for c in BOX]))
        else:  # the distance from the hexagon's slanted sides to the nearest corner of the box decides
            dx = F.greatest(F.lit(0.0), F.lit(x0) - F.col("cx"), F.col("cx") - x1)
            dy = F.greatest(F.lit(0.0), F.lit(y0) - F.col("cy"), F.col("cy") - y1)
            cells = cells.filter((dx <= size / 2 + 1e-9) & (dy * (3**0.5 / 2) + dx / 2 <= size / 2 * (1 + 1e-12) + 1e-9))
    else:
        raise ValueError(f"unknown block shape {shape!r}")
    from pyspark.sql import Window

    ordered = cells.withColumn("block_id", F.row_number().over(Window.orderBy("id")) - 1)  # as many rows as the area has cells
    return FeatureCollection(ordered.drop("id"), work.crs, "block_id")
