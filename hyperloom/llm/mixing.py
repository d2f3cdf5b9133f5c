"""Mixing sources to target weights: operator 1.

Tokens (words) are summed by source; a source's rate is its target over its size. Each document is emitted
floor(rate) times, and once more with a chance equal to the rate's fraction, drawn by a seeded hash.

The draws of a source depend on each other, so that its total comes near its target although each document has the
chance exactly. Its documents stand in strata of about equal length, the longest first. A stratum gets as many extra
copies as whole numbers lie between fraction * (documents before it) and fraction * (those and its own), both moved by
one seeded number in [0, 1) of the source; the copies go to the documents of the stratum with the smallest hashes. Of a
source of one document, the seeded number alone decides.

Defined results: a null or empty text has size 0 and is emitted like any other; a null source is a source of its
own, after all others. A document's hash is made of its id and text, so rows of one id, or without one, are drawn one
by one; rows equal in both share their draw. Other columns pass through `emit`, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.llm.common import cut, fresh, share, table, word_count

SEED = "mix"
#: A table of sources or strata of at most so many rows is broadcast; a larger one is joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Ranges of hashes that a stratum is counted in to find the largest hash that gets a copy.
BINS = 4096


def stratum(text: Column) -> Column:
    """Number of binary digits of the text's bytes and the first four of them: strata of at most an eighth of their
    length. As a text that sorts by length."""
    size = F.bin(F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
    return F.concat(F.lpad(F.length(size).cast("string"), 2, "0"), F.substring(size, 1, 4))


def drawn(doc_id: Column, text: Column) -> Column:
    """A document's number in [0, 1)."""
    return share(F.concat_ws("|", F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary"))), SEED)


def targets(sizes: DataFrame, weights: list[int], share: float, most: float) -> DataFrame:
    """source, source_size, target: weights go round over the sources by code point, null last.

    A target stops at `most` times its source; the excess goes to the others by weight. Sources sorted by
    most * size / weight fill up in that order, so running sums say which are full.
    """
    every = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*(F.lit(w) for w in weights)), (rank % len(weights) + 1).cast("int"))
    ranked = sizes.withColumns({"rank": rank, "weight": weight}).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    filled = ranked.withColumns(
        {"total": F.sum("source_size").over(every) * F.lit(float(share)), "weights": F.sum("weight").over(every), "caps_before": F.coalesce(F.sum("cap").over(before), F.lit(0.0)), "weights_before": F.coalesce(F.sum("weight").over(before), F.lit(0))}
    )
    level = (F.col("total") - F.col("caps_before")) / (F.col("weights") - F.col("weights_before"))
    full = filled.withColumn("full", level * F.col("weight") > F.col("cap"))
    used = full.withColumns({"caps": F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0.0)).over(every), "left": F.sum(F.when(F.col("full"), 0).otherwise(F.col("weight"))).over(every)})
    even = (F.col("total") - F.col("caps")) / F.when(F.col("left") > 0, F.col("left")) * F.col("weight")
    return used.select("source", "source_size", F.when(F.col("full"), F.col("cap")).otherwise(even).alias("target"))


def thresholds(light: DataFrame, weights: list[int], share_of_all: float, most: float) -> DataFrame:
    """source, stratum, source_size, target, whole, below for each stratum of light (source, size, stratum, number): a
    document is taken `whole` times, and once more if its number is not above `below`."""
    strata = cut(light.groupBy("source", "stratum").agg(F.sum("size").alias("size"), F.count("*").alias("n")))
    sizes = strata.groupBy("source").agg(F.sum("size").alias("source_size"))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    wanted = targets(sizes, weights, share_of_all, most).withColumn("rate", rate)
    wanted = wanted.withColumns({"whole": F.floor("rate"), "fraction": F.col("rate") - F.floor("rate"), "start": share(F.concat_ws("", F.lit("source "), "source"), SEED)})
    order = Window.partitionBy("source").orderBy(F.desc("stratum"))  # strata of a source: a few hundred
    before = F.coalesce(F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = strata.withColumn("before", before).alias("s").join(wanted.alias("w"), F.col("s.source").eqNullSafe(F.col("w.source")))
    upto = lambda rows: F.floor(rows * F.col("fraction") + F.col("start"))
    extra = upto(F.col("before") + F.col("n")) - upto(F.col("before"))
    planned = cut(numbered.select("s.source", "stratum", "source_size", "target", "whole", "n", extra.alias("extra")))
    asked = planned.where("extra > 0 and extra < n").select("source", "stratum", "extra")
    bin_ = F.floor(F.col("number") * BINS).cast("int")
    own = _with(light, asked, ["source", "stratum"]).select("source", "stratum", "number", "extra", bin_.alias("bin"))
    bins = own.groupBy("source", "stratum", "bin").agg(F.count("*").alias("n"), F.first("extra").alias("extra"))
    upto_bin = F.sum("n").over(Window.partitionBy("source", "stratum").orderBy("bin"))
    edge = bins.withColumn("left", F.col("extra") - (upto_bin - F.col("n"))).where("left > 0 and left <= n").select("source", "stratum", "bin", "left")
    rank = F.row_number().over(Window.partitionBy("source", "stratum").orderBy("number"))
    last = _with(own.drop("extra"), edge, ["source", "stratum", "bin"]).withColumn("rank", rank).where("rank = left").select("source", "stratum", F.col("number").alias("last"))
    below = F.when(F.col("extra") <= 0, -1.0).when(F.col("extra") >= F.col("n"), 1.0).otherwise(F.col("last"))
    found = _with(planned, last, ["source", "stratum"], "left")
    return cut(found.select("source", "stratum", "source_size", "target", "whole", below.alias("below")))


def _with(rows: DataFrame, few: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """rows with few's other columns, joined null-safe by the keys; broadcast if few has a checked number of rows."""
    few = cut(few)
    other = few.select(*(F.col(c).alias(f"few_{c}") if c in keys else F.col(c) for c in few.columns))
    other = F.broadcast(other) if few.count() <= BROADCAST_ROWS else other
    on = [rows[c].eqNullSafe(other[f"few_{c}"]) for c in keys]
    return rows.join(other, on, how).drop(*(f"few_{c}" for c in keys))


def _light(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), stratum(F.col("text")).alias("stratum"), drawn(F.col("doc_id"), F.col("text")).alias("number"))


def _times(whole: Column, number: Column, below: Column) -> Column:
    return (whole + (number <= below).cast("long")).cast("long")


def mix(docs: DataFrame, weights: list[int] = (5, 2, 1), share_of_all: float = 1.5, most: float = 2.0) -> DataFrame:
    """doc_id, source, size, source_size, target, copies for every row of docs."""
    light = cut(_light(docs))
    mixed = _with(light, thresholds(light, list(weights), share_of_all, most), ["source", "stratum"])
    return mixed.select("doc_id", "source", "size", "source_size", "target", _times(F.col("whole"), F.col("number"), F.col("below")).alias("copies"))


def emit(docs: DataFrame, weights: list[int] = (5, 2, 1), share_of_all: float = 1.5, most: float = 2.0) -> DataFrame:
    """The mixed rows themselves: each row of docs, all columns, as often as the mix takes it. Texts aren't shuffled
    unless there are more strata than may be broadcast."""
    light = cut(_light(docs).drop("doc_id"))
    found = thresholds(light, list(weights), share_of_all, most).select("source", "stratum", "whole", "below")
    names = fresh(docs, "source_", "stratum_", "whole_", "below_", "number_", "copy_")
    source, own, whole, below, number, copy = names
    few = found.toDF(source, own, whole, below)
    few = F.broadcast(few) if found.count() <= BROADCAST_ROWS else few
    keyed = docs.withColumns({number: drawn(F.col("doc_id"), F.col("text"))})
    mixed = keyed.join(few, F.col("source").eqNullSafe(F.col(source)) & (stratum(F.col("text")) == F.col(own)))
    return mixed.withColumn(copy, F.explode(F.array_repeat(F.lit(1), _times(F.col(whole), F.col(number), F.col(below)).cast("int")))).drop(*names)


def op1_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


_SHARE_SQL = lambda key: f"(('0x' || substr(md5('{SEED}|' || {key}), 1, 13))::BIGINT / 4503599627370496.0)"
OP1_SQL = rf"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size, bin(strlen(coalesce(text, ''))) AS b,
  {_SHARE_SQL("coalesce(CAST(doc_id AS VARCHAR), '') || '|' || md5(coalesce(text, ''))")} AS number FROM documents),
e AS (SELECT *, lpad(CAST(length(b) AS VARCHAR), 2, '0') || b[1:4] AS stratum FROM d),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS weight, source_size * 2e0 AS cap FROM s),
f AS (SELECT *, sum(source_size) OVER () * 1.5e0 AS total, sum(weight) OVER () AS weights,
  coalesce(sum(cap) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
  coalesce(sum(weight) OVER (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS weights_before FROM r),
g AS (SELECT *, (total - caps_before) / (weights - weights_before) * weight > cap AS is_full FROM f),
h AS (SELECT *, sum(CASE WHEN is_full THEN cap ELSE 0e0 END) OVER () AS caps, sum(CASE WHEN is_full THEN 0 ELSE weight END) OVER () AS remaining FROM g),
t AS (SELECT source, source_size, CAST(CASE WHEN is_full THEN cap ELSE (total - caps) / nullif(remaining, 0) * weight END AS DOUBLE) AS target FROM h),
q AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0e0 END AS rate, {_SHARE_SQL("'source ' || coalesce(source, '')")} AS start FROM t),
n AS (SELECT source, stratum, count(*) AS n, coalesce(sum(count(*)) OVER (PARTITION BY source ORDER BY stratum DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM e GROUP BY source, stratum),
x AS (SELECT n.source, stratum, source_size, target, floor(rate) AS whole, floor((before + n) * (rate - floor(rate)) + start) - floor(before * (rate - floor(rate)) + start) AS extra FROM n JOIN q ON n.source IS NOT DISTINCT FROM q.source),
k AS (SELECT e.*, source_size, target, whole, extra, rank() OVER (PARTITION BY e.source, e.stratum ORDER BY number) AS place FROM e JOIN x ON e.source IS NOT DISTINCT FROM x.source AND e.stratum = x.stratum)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN place <= extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM k
"""
