"""Session helpers: recommended settings and checkpoints."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def session(app: str = "shoal", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; the master and sizes come from the environment or `settings`."""
    builder = SparkSession.builder.appName(app).config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true").config("spark.sql.adaptive.skewJoin.enabled", "true")
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_root(spark: SparkSession) -> str:
    """The folder that the session's spark.checkpoint.dir names, which all executors share. Where it is unset, a folder of this machine,
    but only for a session that runs on this machine alone."""
    sc = spark.sparkContext
    if own := sc.getConf().get("spark.checkpoint.dir"):
        return own
    if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return tempfile.mkdtemp(prefix="shoal-")


def materialise(df: DataFrame) -> DataFrame:
    """checkpoint() into that folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(checkpoint_root(df.sparkSession))
    return df.checkpoint()
