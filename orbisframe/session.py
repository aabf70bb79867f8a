"""A session with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.ansi.enabled": "true"}


def get_spark(app: str = "orbisframe", **conf) -> SparkSession:
    """conf: further settings, with underscores for dots."""
    made = SETTINGS | {k.replace("_", "."): str(v) for k, v in conf.items()}
    return SparkSession.builder.appName(app).config(map=made).getOrCreate()


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a checkpoint in the folder that the cluster names in spark.checkpoint.dir; only persisted where none is named."""
    sc = df.sparkSession.sparkContext
    folder = sc.getConf().get("spark.checkpoint.dir")
    if folder and not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(folder)
    return df.checkpoint() if folder else df.persist()
