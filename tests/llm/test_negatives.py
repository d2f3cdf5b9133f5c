"""Operator 12 against plain loops over all pairs."""

import math
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int, score double, row string, anchor_id int"


def brute(rows, positives=5, most=3):
    """Of rows (vec_id, embedding, label)."""
    finite = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    kept = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v, label in rows if i is not None and label is not None and finite(v)]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    out = Counter()
    for a, la, va in kept:
        if a % 50:
            continue
        scored = sorted((-dot(va, v), i, label) for i, label, v in kept if i != a)
        for s, p, _ in [x for x in scored if x[2] == la][:positives]:
            found = [x for x in scored if x[2] != la and 50 * -s <= 100 * -x[0] <= 95 * -s][:most]
            out.update((a, p, rank, n, -s, -score) for rank, (score, n, _) in enumerate(found, 1))
    return out


def run(spark, tmp_path, rows):
    spark.createDataFrame([(i, v, label, 0.5, "r", 3) for i, v, label in rows], SCHEMA).write.parquet(f"{tmp_path}/embeddings.parquet")
    found = negatives.op12_segment_negatives(spark, str(tmp_path))
    assert dict(found.dtypes) == {"anchor_id": "bigint", "positive_id": "bigint", "rank": "int", "negative_id": "bigint", "positive_score": "bigint", "negative_score": "bigint"}
    return Counter(tuple(r) for r in found.collect())


def clustered(n, dim, labels, seed=3):
    """Rows about a few centres, so that bounds rule most pairs out; one label holds a third of them."""
    rng = np.random.default_rng(seed)
    centres = np.repeat(rng.normal(0, 1, (12, 4)), dim // 4, axis=1)
    return [(i, (centres[rng.integers(12)] + rng.normal(0, 0.05, dim)).tolist(), 0 if i % 3 == 0 else int(rng.integers(labels))) for i in range(n)]


def test_odd_rows(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(0, 0.2, 6).tolist(), int(rng.integers(3))) for i in range(160)]
    nan, inf = float("nan"), float("inf")
    rows += [(200, None, 1), (250, [0.1] * 6, None), (300, [nan] * 6, 1), (350, [inf, 0.0, 0.0, 0.0, 0.0, 0.0], 1), (400, [None, 1.0, 1.0, 1.0, 1.0, 1.0], 1), (None, [0.3] * 6, 1)]
    rows += [(450, [], 1), (500, [0.5, 0.5], 2), (550, [0.0] * 6, 0), (601, rows[3][1], 2), (602, rows[3][1], 2), (603, rows[3][1], 1), rows[4], rows[4], (50, rows[7][1], 1)]
    assert run(spark, tmp_path, rows) == brute(rows)


def test_many_blocks(spark, tmp_path, monkeypatch):
    """Small blocks, so that labels share buckets, anchors fill several blocks and groups of blocks meet."""
    for name, n in (("BLOCK_ROWS", 40), ("BLOCK_ANCHORS", 5), ("GROUP", 2), ("MOST_BUCKETS", 3)):
        monkeypatch.setattr(negatives, name, n)
    rows = clustered(900, 16, 6)
    assert run(spark, tmp_path, rows) == brute(rows)


@pytest.mark.parametrize("rows", [[], [(1, [0.5], 1), (2, [0.5], 2)], [(50, [0.5, 0.1], 1)], [(50, [0.5], 1), (51, [0.5], 2)]])
def test_little(spark, tmp_path, rows):
    """No rows, no anchor, an anchor alone, and one without a positive."""
    assert not run(spark, tmp_path, rows)


def test_large_components(spark, tmp_path):
    """Scores beyond what floats hold exactly."""
    rng = np.random.default_rng(2)
    rows = [(i, (rng.normal(0, 1, 8) * 10_000).tolist(), i % 2) for i in range(120)]
    assert run(spark, tmp_path, rows) == brute(rows)


def block(x, ids):
    x = np.asarray(x, np.int16)
    ints = np.asarray(ids, np.int64).tobytes()
    row = SimpleNamespace(rows=ints, ids=ints, labels=ints, x=x.tobytes(), summaries=b"".join(p.tobytes() for p in negatives.summaries(x)))
    return negatives.Block(row, x.shape[1], "<i2")


def test_bounds_hold_and_rule_out(monkeypatch):
    x = np.floor(64 * np.array([v for _, v, _ in clustered(400, 64, 5)]))
    a, r = block(x[:50], range(50)), block(x[50:], range(350))
    scores = x[:50].astype(int) @ x[50:].T.astype(int)
    for n, own, other in zip(negatives.SEGMENTS, a.parts, r.parts):
        upper, lower = own @ other.T, np.concatenate([own[:, :n], -own[:, n:]], 1) @ other.T
        assert (upper >= scores - 1).all() and (lower <= scores + 1).all()
    least = np.sort(scores, 1)[:, -6]
    assert (a.parts[1] @ r.parts[1].T >= least[:, None]).mean() < 0.5  # few segments are enough for most pairs
    most = least + (scores.max(1) - least) // 2
    want = {(i, j, scores[i, j]) for i, j in np.argwhere((scores >= least[:, None]) & (scores <= most[:, None]))}
    for sparse in (0.0, 0.01, 1.1):  # pairs left as a matrix, by their share, and one by one
        monkeypatch.setattr(negatives, "SPARSE", sparse)
        assert set(zip(*(v.tolist() for v in negatives.between(a, r, least, most, np.float32)))) == want


def test_best_keeps_ties_by_id():
    best = negatives.Best(2, 3)
    rng = np.random.default_rng(5)
    rows = [(int(rng.integers(2)), int(rng.integers(40)), i) for i in range(30_000)]
    for part in (rows[:20_000], rows[20_000:20_003], rows[20_003:]):
        best.add(*np.array([(a, s, i) for a, s, i in part]).T)
    for a in range(2):
        want = sorted((-s, i) for b, s, i in rows if a == b)[:3]
        assert list(zip((-best.scores[a]).tolist(), best.ids[a].tolist())) == want


def test_rows_are_dealt_out(spark):
    """A label with all rows is cut into blocks of bounded size, equal rows and all."""
    rows = spark.range(5000).select(F.lit(7).cast("long").alias("vec_id"), F.lit(1).cast("long").alias("label"), F.array(F.lit(1).cast("long")).alias("x"))
    kept = rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.lit(0)).withColumn("sub", F.pmod(F.xxhash64("row", F.lit(1)), F.lit(5)))
    sizes = [len(r.ids) // 8 for r in negatives.packed(kept, ["bucket", "sub"], 16, "<i2").collect()]
    assert len(sizes) == 5 and max(sizes) < 1.3 * 1000
