"""Exact histogram of encoded lengths: operator 7.

Documents are summed by their number of tokens under a public byte-level vocabulary; running sums over the
lengths then answer, for every context limit at once, how many documents and tokens fit, exceed it, or are left
after truncation.

Defined results: a null or empty text has 0 tokens and is counted. An empty table gives no rows. Other columns
are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.llm import kernels as k
from hyperloom.llm.common import cut, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the vocabulary's split into pieces.
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Lengths that one block of running sums spans.
BLOCK = 128


def read_vocabulary(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def with_lengths(docs: DataFrame, vocabulary: str = VOCABULARY) -> DataFrame:
    """doc_id and tokens. The vocabulary has a fixed size and is broadcast."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks.value, special_tokens={})
        for batch in k.slices(batches):
            n = [len(own.encode_ordinary(t)) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.array(n, np.int64))], ["doc_id", "tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(encode, "doc_id long, tokens long")


def histogram(lengths: DataFrame) -> DataFrame:
    """tokens, docs. It is small and read several times, so it is written once."""
    return cut(lengths.groupBy("tokens").agg(F.count("*").alias("docs")))


def running_sums(hist: DataFrame) -> DataFrame:
    """For every length L that occurs: documents and tokens of it, up to it and from it on, the tokens left if
    all documents are cut at L, and the share of documents that fit. Summed in blocks of lengths, then within."""
    blocked = hist.withColumn("block", F.floor(F.col("tokens") / BLOCK)).withColumn("sum", F.col("tokens") * F.col("docs"))
    blocks = blocked.groupBy("block").agg(F.sum("docs").alias("d"), F.sum("sum").alias("t"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select("block", *(F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}_before") for c in "dt"), *(F.sum(c).over(every).alias(f"{c}_all") for c in "dt"))
    upto = Window.partitionBy("block").orderBy("tokens").rowsBetween(Window.unboundedPreceding, 0)
    docs_upto, tokens_upto = F.sum("docs").over(upto) + F.col("d_before"), F.sum("sum").over(upto) + F.col("t_before")
    summed = blocked.join(blocks, "block").withColumns({"docs_upto": docs_upto, "tokens_upto": tokens_upto})
    return summed.select(
        "tokens", "docs", "docs_upto", "tokens_upto",
        (F.col("d_all") - F.col("docs_upto") + F.col("docs")).alias("docs_from"),
        (F.col("t_all") - F.col("tokens_upto") + F.col("sum")).alias("tokens_from"),
        (F.col("tokens_upto") + (F.col("d_all") - F.col("docs_upto")) * F.col("tokens")).alias("truncated_total"),
        (F.col("docs_upto") / F.col("d_all")).alias("share_upto"),
    )


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for any context limit: the documents that fit and the tokens left after truncation."""
    total = sums.agg(F.max("docs_upto").alias("docs_all"))
    own = sums.where(F.col("tokens") <= limit).agg(F.coalesce(F.max("docs_upto"), F.lit(0)).alias("docs_upto"), F.coalesce(F.max("tokens_upto"), F.lit(0)).alias("tokens_upto"))
    return own.crossJoin(total).select("docs_upto", (F.col("tokens_upto") + (F.coalesce("docs_all", F.lit(0)) - F.col("docs_upto")) * limit).alias("truncated_total"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The smallest length that at least this share of the documents doesn't exceed."""
    return sums.where(F.col("share_upto") >= share).agg(F.min("tokens").alias("tokens"))


def op7_length_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return running_sums(histogram(with_lengths(table(spark, sf_dir, "documents"))))
