"""Tables kept between the steps of an iteration, on storage that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def ready(spark: SparkSession) -> None:
    """Set the checkpoint folder: the configured one; a temporary one only on a single machine."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isDefined():
        return
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    sc.setCheckpointDir(configured or f"file://{tempfile.mkdtemp(prefix='splitframe-')}")


def kept(df: DataFrame) -> DataFrame:
    """``df`` worked out once and written, without lineage."""
    ready(df.sparkSession)
    return df.checkpoint()
