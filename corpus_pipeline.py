"""From raw documents to sharded training data, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame of what it keeps, with the columns of docs; the
last one writes the shards, to the folder that the setting spark.hyperloom.shards then names, and returns each
document's place. Nulls and empty texts: a text without a letter has no language and goes
in the first stage, so later stages see texts with letters; ids and sources may be null. An empty table passes
through as an empty one. Extra columns pass through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import decontaminate, language, mixing, neardup, sharding
from hyperloom.llm.common import ROW, cut, discard, numbered, table, written_to

#: Language scores below this say nothing: the texts are rejected.
LEAST_LANGUAGE_SCORE = 0.3
#: Numbers of dropped documents that are broadcast at most (8 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
SHARDS = 8


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that have a language; the network learns from those with a lang."""
    return language.in_a_language(docs, language.learn(docs, F.lit(True))[0], LEAST_LANGUAGE_SCORE)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document, the one of the smallest id, of each group with five-word shingles alike by 0.8. Rows are
    compared by a number of their own, so those that share an id, or have none, are told apart; no id comes last."""
    rows = numbered(docs)
    found = neardup.near_duplicates(rows.select(F.col(ROW).alias("doc_id"), "text"), shingle=5, percent=80)
    members = cut(found.select(F.col("doc_id").alias(ROW), "component_id").join(rows.select(ROW, "doc_id"), ROW))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", ROW))
    kept = members.groupBy("component_id").agg(first[ROW].alias(ROW)).select(ROW)
    dropped = cut(members.join(kept, ROW, "left_anti").select(ROW))
    return rows.join(F.broadcast(dropped) if dropped.count() <= BROADCAST_IDS else dropped, ROW, "left_anti").select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that hold no benchmark item."""
    return decontaminate.decontaminated(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that each source comes to its target."""
    return mixing.emit(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes every row to its shard's files and gives its shard and its slot there."""
    return sharding.reshard(docs, SHARDS, sharding.by_source(SHARDS))


STAGES = [
    ("language", identify_language),
    ("near_dedup", drop_near_duplicates),
    ("decontaminate", drop_benchmark_leaks),
    ("mix", mix_sources),
    ("shard", shard),
]

#: SQL expresses neither the network nor the signatures; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; what a stage wrote is removed once the next one has written what it kept."""
    docs, before = table(spark, sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, path = written_to(docs)
            discard(spark, before)
            before = path
    return docs
