"""Tables that cut lineage, written where every executor can read them.

The folder is the one the cluster names in ``spark.checkpoint.dir``. Only where that setting is absent and the master is
local (tests, a laptop) a temporary folder stands in for it.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder; ValueError on a cluster that names none."""
    conf = spark.sparkContext.getConf()
    root = conf.get("spark.checkpoint.dir")
    if root:
        return root.rstrip("/")
    master = conf.get("spark.master", "")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    root = getattr(spark, "_orbis_scratch", None)
    if root is None:
        root = spark._orbis_scratch = "file://" + tempfile.mkdtemp(prefix="orbisframe-")
    return root


_OPEN: list[Scratch] = []


@contextmanager
def released() -> Iterator[None]:
    """Deletes, at the end, the folders of every Scratch made inside."""
    mark = len(_OPEN)
    yield
    for made in _OPEN[mark:]:
        made.drop()
    del _OPEN[mark:]


class Scratch:
    """A folder of Parquet tables for one run of one operator; what is left goes when the driver ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.path = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"
        atexit.register(self._leave)
        _OPEN.append(self)

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write df and return what was written, with no lineage beyond the files."""
        df.write.mode("overwrite").parquet(f"{self.path}/{name}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{name}")

    def drop(self, name: str = "") -> None:
        """Delete one table, or all."""
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def _leave(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                self.drop()
            except Exception:  # the JVM may have ended before Python does
                return
