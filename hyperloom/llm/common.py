"""What the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir. Where it is unset, a temporary folder serves a session on one
    machine; on a cluster that is an error, as each machine would write to its own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.sparkContext.getCheckpointDir():
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="hyperloom-"))
    return named or spark.sparkContext.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write the rows to the shared folder as a checkpoint and go on from there."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written_to(df: DataFrame, compression: str = "snappy") -> tuple[DataFrame, str]:
    """The same, as Parquet: smaller, and later reads take the columns they need. And its folder, for `discard`."""
    path = f"{shared_folder(df.sparkSession)}/hyperloom-{uuid.uuid4().hex}"
    df.write.option("compression", compression).parquet(path)
    return df.sparkSession.read.parquet(path), path


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    return written_to(df, compression)[0]


def discard(spark: SparkSession, path: str | None) -> None:
    """Remove a folder that `written_to` made, when nothing will read it any more."""
    if path:
        place = spark._jvm.org.apache.hadoop.fs.Path(path)
        place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Number of a row, the only key that tells apart rows of one id, equal rows and rows without an id.
ROW = "_row"


def numbered(df: DataFrame) -> DataFrame:
    """The rows with a number each, written with it, so that it stays the same however often they are read."""
    return written(df.withColumn(ROW, F.monotonically_increasing_id()), "zstd")


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(n)


def share(key: Column, salt: str) -> Column:
    """A number in [0, 1) that depends on the key's text and the salt only."""
    digits = F.substring(F.md5(F.concat_ws("|", F.lit(salt), key.cast("string")).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("double") / F.lit(float(1 << 52))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Each name with as many underscores before it as it takes to clash with no column of df."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


WORD = r"[^\x20\x09-\x0D]+"


def word_count(text: Column) -> Column:
    """Number of words; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")
