"""Stacks of rasters: one pixel frame with image_id, and a scenes frame with image_id, ord and properties."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.crs import transform_bounds
from .base import EarthObject
from .filter import Filter
from .raster import Grid, Image
from .reducer import Reducer


class ImageCollection(EarthObject):
    """pixels: (image_id, row, col, bands...) on one grid; scenes: (image_id, ord, properties...)."""

    def __init__(self, pixels: DataFrame, scenes: DataFrame, grid: Grid, dataset_name: str | None = None, metadata: dict | None = None):
        super().__init__(metadata)
        self.pixels, self.scenes, self.grid, self.dataset_name = pixels, scenes, grid, dataset_name

    @classmethod
    def from_images(cls, images: list[Image], dataset_name: str | None = None) -> ImageCollection:
        """Images in order; those on other grids are resampled (nearest) to the union of the extents on the first's grid."""
        if isinstance(images, str) or not images:
            raise TypeError("a list of images is needed")
        spark, grid = images[0].df.sparkSession, common_grid([i.grid for i in images])
        if any(i.count != images[0].count for i in images):
            raise ValueError("the images differ in their number of bands")
        frames = []
        for n, i in enumerate(images):
            i = (i if i.grid == grid else i.on_grid(grid)).rename(images[0].bands)
            frames.append(i.df.select(F.lit(str(n)).alias("image_id"), *i.df.columns))
        pixels = frames[0]
        for f in frames[1:]:
            pixels = pixels.unionByName(f)
        rows = [(str(n), n, {str(k): None if v is None else str(v) for k, v in i.metadata.items()}) for n, i in enumerate(images)]
        return cls(pixels, spark.createDataFrame(rows, "image_id string, ord int, properties map<string,string>"), grid, dataset_name)

    def _of(self, scenes: DataFrame | None = None, pixels: DataFrame | None = None) -> ImageCollection:
        return type(self)(self.pixels if pixels is None else pixels, self.scenes if scenes is None else scenes, self.grid, self.dataset_name, self._metadata)

    @property
    def bands(self) -> list[str]:
        return [c for c in self.pixels.columns if c not in ("image_id", "row", "col")]

    def _stack(self) -> Image:
        return Image(self.pixels, self.grid, keys=("image_id", "row", "col"))

    def kept(self) -> DataFrame:
        """The pixels of the scenes that are left, with their ord; the scenes are joined once, here."""
        return self.pixels.join(self.scenes.select("image_id", "ord"), "image_id")

    # filters
    def filter(self, f: Filter) -> ImageCollection:
        return self._of(f.apply(self.scenes))

    def filterMetadata(self, name: str, operator: str, value) -> ImageCollection:
        return self.filter(Filter.metadata(name, operator, value))

    def filterDate(self, start, end=None) -> ImageCollection:
        return self.filter(Filter.date(start, end))

    def filterBounds(self, geometry) -> ImageCollection:
        return self.filter(Filter.bounds(geometry))

    def filterQuality(self) -> ImageCollection:
        return self.filter(Filter.quality())

    def sort(self, prop: str, ascending: bool = True) -> ImageCollection:
        """Stable; by number, then as text; missing counts as 0. ord is given anew, without holes."""
        value = F.col(prop) if prop in self.scenes.columns else F.element_at("properties", prop)
        by = [F.coalesce(value.cast("string").try_cast("double"), F.lit(0.0)), value.cast("string")]
        order = Window.orderBy(*[b.asc() if ascending else b.desc() for b in by], "ord")  # one row for each scene
        return self._of(self.scenes.withColumn("ord", F.row_number().over(order) - 1))

    def limit(self, n: int) -> ImageCollection:
        return self._of(self.scenes.orderBy("ord").limit(n))

    def size(self) -> int:
        return self.scenes.count()

    __len__ = size

    def ids(self) -> list[str]:
        return [r.image_id for r in self.scenes.orderBy("ord").select("image_id").collect()]

    def image(self, image_id: str) -> Image:
        """One image by id."""
        return Image(self.pixels.filter(F.col("image_id") == image_id).drop("image_id"), self.grid, {"image_id": image_id})

    def first(self) -> Image:
        return self.image(self.limit(1).ids()[0])

    def to_list(self) -> list[Image]:
        return [self.image(i) for i in self.ids()]

    def __getitem__(self, n: int) -> Image:
        return self.image(self.ids()[n])

    def __iter__(self):
        return iter(self.to_list())

    # per image
    def map(self, f) -> ImageCollection:
        """f takes and returns an Image; it runs once, over the pixels of all images."""
        made = f(self._stack())
        return type(self)(made.df, self.scenes, made.grid, self.dataset_name)

    def select(self, bands, new_names=None) -> ImageCollection:
        return self.map(lambda i: i.select(bands, new_names))

    def mask_clouds(self, **options) -> ImageCollection:
        return self._of(pixels=self._stack().mask_clouds(**options).df)

    def auto_scale(self, **options) -> ImageCollection:
        options.setdefault("dataset", self.dataset_name)
        return self._of(pixels=self._stack().auto_scale(**options).df)

    # composites
    def reduce(self, reducer: Reducer) -> Image:
        """One shuffle on (row, col), partial aggregates first where the reducer has them."""
        out = self.kept().groupBy("row", "col").agg(*[reducer.column(F.col(f"`{b}`"), F.col("ord")).alias(b) for b in self.bands])
        return Image(out, self.grid)

    def mean(self) -> Image:
        return self.reduce(Reducer.mean())

    def median(self) -> Image:
        return self.reduce(Reducer.median())

    def min(self) -> Image:
        return self.reduce(Reducer.min())

    def max(self) -> Image:
        return self.reduce(Reducer.max())

    def sum(self) -> Image:
        return self.reduce(Reducer.sum())

    def mosaic(self) -> Image:
        """For each band the last image's value that is there."""
        top = lambda b: F.max_by(F.col(f"`{b}`"), F.when(F.col(f"`{b}`").isNotNull(), F.col("ord")))
        return Image(self.kept().groupBy("row", "col").agg(*[top(b).alias(b) for b in self.bands]), self.grid)

    def qualityMosaic(self, quality: str) -> Image:
        """All bands of the image with the best quality; the first image wins ties, and without any quality all is missing."""
        all_bands, q = F.struct(*[F.col(f"`{b}`") for b in self.bands]), F.col(f"`{quality}`")
        best = F.max_by(all_bands, F.when(q.isNotNull(), F.struct(q, -F.col("ord"))))
        out = self.kept().groupBy("row", "col").agg(best.alias("__best"))
        return Image(out.select("row", "col", *[F.col("__best")[b].alias(b) for b in self.bands]), self.grid)

    def to_xarray(self) -> DataFrame:
        """Long pixels (time, band, y, x, value); time is the date, or T and the place in the order."""
        g = self.grid
        dates = [F.col(c).cast("string") for c in ("date", "datetime", "timestamp") if c in self.scenes.columns]
        if "properties" in self.scenes.columns:
            dates += [F.element_at("properties", c) for c in ("date", "datetime", "timestamp")]
        time = F.coalesce(*dates, F.concat(F.lit("T"), F.col("ord").cast("string")))
        x, y = g.center(F.col("row"), F.col("col"))
        stack = ", ".join(f"'{b}', `{b}`" for b in self.bands)
        rows = self.pixels.join(self.scenes.select("image_id", time.alias("time")), "image_id")
        return rows.select("time", y.alias("y"), x.alias("x"), F.expr(f"stack({len(self.bands)}, {stack}) as (band, value)"))

    to_dataset = to_xarray


def common_grid(grids: list[Grid]) -> Grid:
    """The first grid, widened to hold all."""
    first = grids[0]
    if all(g == first for g in grids):
        return first
    boxes = [transform_bounds(g.bounds, g.epsg, first.epsg) for g in grids]
    x0, y0, x1, y1 = min(b[0] for b in boxes), min(b[1] for b in boxes), max(b[2] for b in boxes), max(b[3] for b in boxes)
    rx, ry = abs(first.transform[0]), abs(first.transform[4])
    return Grid(math.ceil((x1 - x0) / rx - 1e-9), math.ceil((y1 - y0) / ry - 1e-9), (rx, 0.0, x0, 0.0, -ry, y1), first.epsg)


RasterCollection = ImageCollection
