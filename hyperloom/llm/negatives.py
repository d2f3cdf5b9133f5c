"""Hard-negative mining by segment summaries: operator 12.

A vector is cut into segments, and each segment keeps its mean and its deviation. The inner product of two vectors lies
between the sum of length * (mean * mean' - deviation * deviation') and the same with a plus, over their segments. Few
long segments are asked first, then more and shorter ones (SEGMENTS), and only pairs whose bounds still allow them among
the best are scored. Bounds only rule out; scores are exact whole numbers, so the result is that of comparing all.

Rows lie in blocks of about BLOCK_ROWS vectors with their summaries, those of a bucket of labels together; anchors in
blocks of about BLOCK_ANCHORS. For positives, blocks of one bucket meet; for negatives, each block of anchors meets all
blocks of rows, GROUP at a time: pairs of blocks are dealt out by a shuffle, so no label, however common, is one task's,
and nothing passes through the driver or is broadcast but a table of at most MOST_BUCKETS rows. A group of blocks hands
on its own best of each anchor; they are ranked by a window.

Defined results: rows without vec_id, label or vector, or with a null or non-finite component, take no part. Rows that
share an anchor's vec_id are the anchor itself, never its positive or negative; each such row is an anchor of its own.
Other repeated rows count one by one. Shorter vectors count as filled up with zeros, an empty one as all zeros.
Components are held to the largest whole number whose products can't leave 64 bits. Extra columns are ignored, an empty
table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.llm.common import table, written

BLOCK_ROWS, BLOCK_ANCHORS, GROUP = 1024, 2048, 8
#: Buckets of labels at most; more rows mean more blocks in a bucket.
MOST_BUCKETS = 1 << 16
#: Numbers of segments of a vector, coarsest first; vectors are filled up to a multiple of the last.
SEGMENTS = (1, 4, 16)
#: Share of pairs below which those left are scored one by one instead of as a matrix.
SPARSE = 0.01
NONE = np.iinfo(np.int64).min
BEST = "row long, anchor_id long, vec_id long, score long"


def whole(embedding: Column, scale: int = 256) -> Column:
    return F.transform(embedding, lambda x: F.floor(F.lit(scale) * x.cast("double")))


def taking_part(rows: DataFrame) -> DataFrame:
    """vec_id, label and x of the rows (vec_id, embedding, label) that take part."""
    finite = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(finite)
    return kept.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), whole(F.col("embedding")).alias("x"))


# --- in a task ---------------------------------------------------------------------------------------------------------


def summaries(x: np.ndarray) -> list[np.ndarray]:
    """For each number of segments, the means and the deviations of each vector's segments, times the root of their length."""
    out = []
    for n in SEGMENTS:
        parts = x.astype(np.float64).reshape(len(x), n, -1)
        out.append((np.concatenate([parts.mean(2), parts.std(2)], 1) * math.sqrt(parts.shape[2])).astype(np.float32))
    return out


class Block:
    """Vectors with their ids, labels and summaries, kept as bytes in a table."""

    def __init__(self, row, width: int, kind: str):
        read = lambda name, dtype: np.frombuffer(getattr(row, name), dtype)
        self.rows, self.ids, self.labels = read("rows", np.int64), read("ids", np.int64), read("labels", np.int64)
        self.x = read("x", kind).reshape(len(self.ids), width)
        self.parts, at = [], 0
        summed = read("summaries", np.float32)
        for n in SEGMENTS:
            size = 2 * n * len(self.ids)
            self.parts.append(summed[at : at + size].reshape(len(self.ids), 2 * n))
            at += size
        self.length = np.sqrt((self.parts[0].astype(np.float64) ** 2).sum(1))


def exact(width: int, most: int) -> type:
    """The fastest type of number in which inner products of such vectors are exact."""
    return np.float32 if width * most * most < 1 << 24 else np.float64 if width * most * most < 1 << 53 else np.int64


def between(a: Block, r: Block, least: np.ndarray, most: np.ndarray | None, number: type) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, rows, scores) of all pairs with scores of at least least[anchor] and, if given, at most most[anchor]."""
    slack = 1 + 1e-5 * a.length * r.length.max(initial=0)  # more than float32 can be wrong by
    low, high = least - slack, None if most is None else most + slack
    cols = np.arange(len(r.ids))
    for level, n in enumerate(SEGMENTS):
        own, other = a.parts[level], r.parts[level][cols]
        keep = own @ other.T >= low[:, None]
        if high is not None:
            flipped = np.concatenate([own[:, :n], -own[:, n:]], 1)
            keep &= flipped @ other.T <= high[:, None]
        alive = keep.any(0)
        cols, keep = cols[alive], keep[:, alive]
        if keep.mean() < SPARSE if keep.size else True:
            return one_by_one(a, r, *(lambda i, j: (i, cols[j]))(*np.nonzero(keep)), level + 1, low, least, most)
    scores = a.x.astype(number) @ r.x[cols].astype(number).T
    hit = scores >= least[:, None].astype(number)
    if most is not None:
        hit &= scores <= most[:, None].astype(number)
    i, j = np.nonzero(hit)
    return i, cols[j], scores[i, j].astype(np.int64)


def one_by_one(a: Block, r: Block, i: np.ndarray, j: np.ndarray, level: int, low: np.ndarray, least: np.ndarray, most: np.ndarray | None):
    for parts, other in zip(a.parts[level:], r.parts[level:]):
        keep = np.einsum("nd,nd->n", parts[i], other[j]) >= low[i]
        i, j = i[keep], j[keep]
    scores = np.einsum("nd,nd->n", a.x[i].astype(np.int64), r.x[j].astype(np.int64))
    keep = scores >= least[i]
    if most is not None:
        keep &= scores <= most[i]
    return i[keep], j[keep], scores[keep]


class Best:
    """The k best of each of n lists so far, ties by id."""

    def __init__(self, n: int, k: int):
        self.scores, self.ids = np.full((n, k), NONE), np.full((n, k), -1, np.int64)

    def bound(self) -> np.ndarray:
        """What a score must reach to matter."""
        return self.scores[:, -1]

    def add(self, at: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(at):
            return
        k = self.scores.shape[1]
        lists, count = np.unique(at, return_counts=True)
        if count.max() > 4 * k and len(at) > 10_000:  # only what reaches the k-th of its list is put in order
            begin = np.concatenate([[0], np.cumsum(count)])
            by = np.argsort(at, kind="stable")
            bounds = np.array([np.partition(scores[by[b:e]], -k)[-k] if e - b > k else NONE for b, e in zip(begin[:-1], begin[1:])])
            keep = scores >= np.repeat(bounds, count)[np.argsort(by, kind="stable")]
            at, scores, ids = at[keep], scores[keep], ids[keep]
        at = np.concatenate([np.repeat(lists, k), at])
        scores = np.concatenate([self.scores[lists].ravel(), scores])
        ids = np.concatenate([self.ids[lists].ravel(), ids])
        order = np.lexsort((ids, ~scores, at))  # ~ turns the order round and can't overflow
        at, scores, ids = at[order], scores[order], ids[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        top = rank < k
        self.scores[at[top], rank[top]], self.ids[at[top], rank[top]] = scores[top], ids[top]


# --- tables of blocks --------------------------------------------------------------------------------------------------


def packed(rows: DataFrame, keys: list[str], width: int, kind: str) -> DataFrame:
    """One row for each group by keys of rows (row, vec_id, label, x): ids in ascending order and everything as bytes."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "row"])
        x = np.zeros((len(group), width), kind)
        for at, own in enumerate(group["x"]):
            x[at, : len(own)] = own
        parts = b"".join(p.tobytes() for p in summaries(x))
        ints = lambda name: group[name].to_numpy(np.int64).tobytes()
        return pd.DataFrame([[*key, ints("row"), ints("vec_id"), ints("label"), x.tobytes(), parts]])

    schema = ", ".join([*(f"{k} long" for k in keys), "rows binary, ids binary, labels binary, x binary, summaries binary"])
    return written(rows.groupBy(*keys).applyInPandas(pack, schema), "zstd")


def ranked(best: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k best of what tasks handed on, with rank from 1."""
    order = Window.partitionBy(*by).orderBy(F.desc("score"), "vec_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def positives_of(blocks: DataFrame, anchors: DataFrame, plan: DataFrame, k: int, width: int, kind: str, number: type) -> DataFrame:
    """row, anchor_id, vec_id, score, rank: each anchor's k best other rows of its label."""

    def best(_: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for a in (Block(r, width, kind) for r in own.itertuples()):
            found = Best(len(a.ids), k)
            for r in (Block(r, width, kind) for r in rows.itertuples()):
                i, j, s = between(a, r, found.bound(), None, number)
                same = (a.labels[i] == r.labels[j]) & (a.ids[i] != r.ids[j])
                found.add(i[same], s[same], r.ids[j][same])
            i, j = np.nonzero(found.scores > NONE)
            out.append(pd.DataFrame({"row": a.rows[i], "anchor_id": a.ids[i], "vec_id": found.ids[i, j], "score": found.scores[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "anchor_id", "vec_id", "score")})

    left = blocks.join(F.broadcast(plan), "bucket").withColumn("asub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("anchor_blocks") - 1))).withColumn("part", F.floor(F.col("sub") / GROUP))
    right = anchors.join(F.broadcast(plan), "bucket").withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("row_blocks") - 1) / GROUP))))
    keys, sizes = ["bucket", "asub", "part"], plan.columns[1:]
    left, right = left.drop(*sizes), right.drop(*sizes)
    return ranked(left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, BEST), ["row"], k)


def negatives_of(blocks: DataFrame, anchors: DataFrame, parts: int, anchor_blocks: int, k: int, low: int, high: int, width: int, kind: str, number: type) -> DataFrame:
    """row, anchor_id, pos (0 for the first positive), vec_id, score, rank: for each positive the k best rows of other labels whose
    score is from low to high percent of the positive's. anchors: blocks with `positives`, the positives' scores."""

    def best(_: tuple, rows: pd.DataFrame, own: pd.DataFrame) -> pd.DataFrame:
        out = []
        for given in own.itertuples():
            a = Block(given, width, kind)
            scores = np.frombuffer(given.positives, np.int64).reshape(len(a.ids), -1)
            least, most = np.full(scores.shape, 1 << 62), np.full(scores.shape, NONE + 1)
            for i, j in np.argwhere(scores > NONE):
                score = int(scores[i, j])  # Python's whole numbers, as 100 times a score may need more than 64 bits
                least[i, j], most[i, j] = -(-low * score // 100), high * score // 100
            found = [Best(len(a.ids), k) for _ in range(scores.shape[1])]
            for r in (Block(r, width, kind) for r in rows.itertuples()):
                bounds = np.stack([np.maximum(least[:, p], f.bound()) for p, f in enumerate(found)], 1)
                i, j, s = between(a, r, bounds.min(1), most.max(1), number)
                other = a.labels[i] != r.labels[j]
                i, j, s = i[other], j[other], s[other]
                for p, f in enumerate(found):
                    fits = (s >= bounds[i, p]) & (s <= most[i, p])
                    f.add(i[fits], s[fits], r.ids[j[fits]])
            for p, f in enumerate(found):
                i, j = np.nonzero(f.scores > NONE)
                out.append(pd.DataFrame({"row": a.rows[i], "anchor_id": a.ids[i], "pos": p, "vec_id": f.ids[i, j], "score": f.scores[i, j]}))
        return pd.concat(out) if out else pd.DataFrame({c: np.zeros(0, np.int64) for c in ("row", "anchor_id", "pos", "vec_id", "score")})

    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = blocks.withColumn("part", F.pmod(F.xxhash64("bucket", "sub"), F.lit(parts))).withColumn("ablock", every(anchor_blocks))
    right = anchors.withColumn("part", every(parts))
    keys = ["ablock", "part"]
    mined = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(best, "row long, anchor_id long, pos long, vec_id long, score long")
    return ranked(mined, ["row", "pos"], k)


def mine(rows: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score of rows (vec_id, label, x: whole numbers)."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    rows = written(rows.withColumn("row", F.monotonically_increasing_id()), "zstd")
    count, longest, most = rows.agg(F.count("*"), F.max(F.size("x")), F.max(F.array_max(F.transform("x", F.abs)))).first()
    if not count:
        return empty
    width = max(1, -(-longest // SEGMENTS[-1])) * SEGMENTS[-1]
    limit = math.isqrt((1 << 63) // width - 1)
    most = min(most or 0, limit)
    if most == limit:
        rows = rows.withColumn("x", F.transform("x", lambda v: F.greatest(F.least(v, F.lit(limit)), F.lit(-limit))))
    kind, number = np.min_scalar_type(-most - 1).str, exact(width, most)
    buckets = min(-(-count // BLOCK_ROWS), MOST_BUCKETS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("label"), F.lit(buckets)))
    sizes = rows.groupBy("bucket").agg(F.count("*").alias("rows"), F.count_if(is_anchor).alias("anchors"))
    every = written(sizes.select("bucket", F.ceil(F.col("rows") / BLOCK_ROWS).alias("row_blocks"), F.ceil(F.col("anchors") / BLOCK_ANCHORS).alias("anchor_blocks"), "anchors"))
    plan = every.where("anchors > 0")
    all_anchors, row_blocks = every.agg(F.sum("anchors"), F.sum("row_blocks")).first()
    if not all_anchors:
        return empty
    dealt = lambda n, salt: F.pmod(F.xxhash64("row", F.lit(salt)), n)
    blocks = packed(rows.join(F.broadcast(every.select("bucket", "row_blocks")), "bucket").withColumn("sub", dealt(F.col("row_blocks"), 1)), ["bucket", "sub"], width, kind)
    anchors = rows.where(is_anchor)
    own = packed(anchors.join(F.broadcast(plan.select("bucket", "anchor_blocks")), "bucket").withColumn("asub", dealt(F.col("anchor_blocks"), 2)), ["bucket", "asub"], width, kind)
    found = written(positives_of(blocks, own, plan, positives, width, kind, number))
    anchor_blocks, parts = -(-all_anchors // BLOCK_ANCHORS), -(-row_blocks // GROUP)
    scored = found.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("rank", "score"))).getField("score").alias("scores"))
    asked = packed_anchors(anchors.join(scored, "row").withColumn("ablock", dealt(F.lit(anchor_blocks), 3)), positives, width, kind)
    mined = negatives_of(blocks, asked, parts, anchor_blocks, negatives, low, high, width, kind, number)
    pairs = mined.join(found.select("row", (F.col("rank") - 1).cast("long").alias("pos"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score")), ["row", "pos"])
    return pairs.select("anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))


def packed_anchors(anchors: DataFrame, positives: int, width: int, kind: str) -> DataFrame:
    """Blocks of anchors (with scores, their positives') by ablock, as `packed` makes them, with `positives`."""

    def pack(key: tuple, group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["vec_id", "row"])
        x, scores = np.zeros((len(group), width), kind), np.full((len(group), positives), NONE)
        for at, (own, best) in enumerate(zip(group["x"], group["scores"])):
            x[at, : len(own)], scores[at, : len(best)] = own, best
        ints = lambda name: group[name].to_numpy(np.int64).tobytes()
        return pd.DataFrame([[*key, ints("row"), ints("vec_id"), ints("label"), x.tobytes(), b"".join(p.tobytes() for p in summaries(x)), scores.tobytes()]])

    return written(anchors.groupBy("ablock").applyInPandas(pack, "ablock long, rows binary, ids binary, labels binary, x binary, summaries binary, positives binary"), "zstd")


def op12_segment_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = taking_part(table(spark, sf_dir, "embeddings"))
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return mine(rows.withColumn("label", shifted), F.col("vec_id") % 50 == 0)


OP12_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS anchor_id, a.label AS anchor_label, v.vec_id, v.label, CAST(list_inner_product(a.x, v.x) AS BIGINT) AS score FROM v a JOIN v ON a.vec_id <> v.vec_id WHERE a.vec_id % 50 = 0),
p AS (SELECT anchor_id, anchor_label, vec_id AS positive_id, score AS positive_score FROM s WHERE label = anchor_label QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, p.positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.vec_id) AS INTEGER) AS rank, s.vec_id AS negative_id, p.positive_score, s.score AS negative_score
FROM p JOIN s ON p.anchor_id = s.anchor_id AND s.label <> p.anchor_label AND 50 * p.positive_score <= 100 * s.score AND 100 * s.score <= 95 * p.positive_score QUALIFY rank <= 3
"""
