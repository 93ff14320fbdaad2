"""A session set up for this engine."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def session(name: str = "logtide", **conf: str) -> SparkSession:
    """UTC, adaptive plans, Arrow; what the caller sets wins."""
    base = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    builder = SparkSession.builder.appName(name)
    for k, v in (base | conf).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package, wherever the driver found it."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    env = spark.sparkContext.environment
    have = env.get("PYTHONPATH", "").split(os.pathsep)
    if root not in have:
        env["PYTHONPATH"] = os.pathsep.join([root, *filter(None, have)])


def scratch_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir. Where that is unset, a local session takes a
    temporary folder; on a cluster it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = scratch_dir.fallback = getattr(scratch_dir, "fallback", None) or tempfile.mkdtemp(prefix="scratch-")
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """Writes the rows to the folder in spark.checkpoint.dir and reads them back: what is
    parsed once is used often, and a lost executor costs only its tasks."""
    spark = df.sparkSession
    path = scratch_dir(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
