"""Tables that a job writes for itself, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

FREE = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def freed(spark: SparkSession) -> Iterator[None]:
    """What is run within leaves no shuffle files: they go as soon as an action is done, not when the driver collects garbage."""
    before = spark.conf.get(FREE, "false")
    spark.conf.set(FREE, "true")
    try:
        yield
    finally:
        spark.conf.set(FREE, before)


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir, or the folder set for checkpoints. A session on one machine may do without; on a cluster that is
    an error, as each machine would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hyperloom-"))
    return named or spark.sparkContext.getCheckpointDir()


def written(df: DataFrame) -> DataFrame:
    """The rows as a Parquet table: read many times, made once, and there when an executor is lost."""
    path = f"{folder(df.sparkSession)}/hyperloom-{uuid.uuid4().hex}"
    with freed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
