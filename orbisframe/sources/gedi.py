"""LiDAR footprints: a deferred query over flat shots (Parquet with a row for each shot, or any frame of that shape)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import to_day
from ..operators.geometry import Geometry
from ..operators.vector import FeatureCollection

#: Shots that lack a flag count as good.
DEFAULTS = {"quality_flag": 1, "degrade_flag": 0, "sensitivity": 1.0}
EPOCH = "2018-01-01"


class GEDI:
    """filterBounds, filterDate, filterQuality and select each give a new query; to_frame() plans it.

    Shots have lat_lowestmode, lon_lowestmode, delta_time (seconds since 2018-01-01), and may have shot_number, beam, quality_flag,
    degrade_flag, sensitivity, elev_lowestmode, rh (an array of 101 heights in metres), rh100_cm, agbd.
    """

    def __init__(self, level: str = "L2A", shots: DataFrame | None = None):
        self.level, self.shots = level, shots
        self._bounds, self._dates, self._quality, self._columns = None, None, False, None

    def _clone(self, **changes) -> GEDI:
        made = GEDI(self.level, self.shots)
        made.__dict__.update(self.__dict__ | changes)
        return made

    def filterBounds(self, geometry: Geometry) -> GEDI:
        return self._clone(_bounds=geometry)

    def filterDate(self, start: str, end: str) -> GEDI:
        """Days from start to end, both included."""
        return self._clone(_dates=(start, end))

    def filterQuality(self, quality: bool = True) -> GEDI:
        return self._clone(_quality=quality)

    def select(self, columns: list[str]) -> GEDI:
        return self._clone(_columns=list(columns))

    def load(self, spark: SparkSession, path: str, region: Geometry | None = None, start: str | None = None, end: str | None = None) -> GEDI:
        """From Parquet; a region is needed, here or by filterBounds."""
        made = self._clone(shots=spark.read.parquet(path))
        made = made.filterBounds(region) if region is not None else made
        made = made.filterDate(start, end) if start and end else made
        if made._bounds is None:
            raise ValueError("a region is needed")
        return made

    def to_frame(self) -> DataFrame:
        """(latitude, longitude, and what is selected of shot_number, beam, elevation, quality_flag, sensitivity, rh50, rh98, rh100, agbd, delta_time)."""
        df = self.shots
        of = lambda c: F.col(c) if c in df.columns else F.lit(DEFAULTS.get(c))
        keep = F.col("lat_lowestmode").isNotNull() & F.col("lon_lowestmode").isNotNull() & ~F.isnan("lat_lowestmode") & ~F.isnan("lon_lowestmode")
        if self._quality:
            flag = F.coalesce(of("quality_flag"), F.lit(1)) == 1
            keep = keep & flag & (F.coalesce(of("degrade_flag"), F.lit(0)) == 0) & (F.coalesce(of("sensitivity"), F.lit(1.0)) >= 0.9)
        if self._bounds is not None:
            x0, y0, x1, y1 = self._bounds.reproject(4326).bounds
            keep = keep & F.col("lon_lowestmode").between(x0, x1) & F.col("lat_lowestmode").between(y0, y1)
        if self._dates:
            first, last = (F.datediff(to_day(F.lit(d)), F.lit(EPOCH).cast("date")) * 86400.0 for d in self._dates)
            keep = keep & (F.col("delta_time") >= first) & (F.col("delta_time") < last + 86400.0)
        made = {"elevation": ("elev_lowestmode", None)}
        cols = {c: F.col(made.get(c, (c,))[0]) for c in ("shot_number", "beam", "elevation", "quality_flag", "sensitivity", "agbd", "delta_time") if made.get(c, (c,))[0] in df.columns}
        if "rh" in df.columns:
            cols |= {f"rh{p}": F.try_element_at("rh", F.lit(p + 1)) for p in (50, 98, 100)}
        elif "rh100_cm" in df.columns:
            cols["rh100"] = F.col("rh100_cm") / 100.0
        names = [c for c in cols if self._columns is None or c in self._columns]
        return df.filter(keep).select(F.col("lat_lowestmode").alias("latitude"), F.col("lon_lowestmode").alias("longitude"), *[cols[c].alias(c) for c in names])

    to_geodataframe = to_frame

    def to_feature_collection(self) -> FeatureCollection:
        df = self.to_frame()
        fid = "shot_number" if "shot_number" in df.columns else "fid"
        df = df if fid in df.columns else df.withColumn("fid", F.monotonically_increasing_id())
        return FeatureCollection(df.withColumn("x", F.col("longitude")).withColumn("y", F.col("latitude")), 4326, fid)

    to_fc = to_feature_collection
