"""Operator 11 against a tree built node by node."""

import hashlib
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hyperloom.llm import merkle
from tests.llm.conftest import make


def digest(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(*values):
    return digest("".join("-" if x is None else f"{len(str(x).encode())}:{x}" for x in values))


def tree(nodes):
    """The top of a tree and each node's siblings, level by level."""
    paths, owner, level = [[] for _ in nodes], list(range(len(nodes))), nodes
    while len(level) > 1:
        for path, o in zip(paths, owner):
            run = o // 3 * 3
            path.append(("".join(level[run:o]), "".join(level[o + 1 : run + 3])))
        owner = [o // 3 for o in owner]
        level = [digest("".join(level[i : i + 3])) for i in range(0, len(level), 3)]
    return level[0], paths


def brute(rows):
    """Of rows (doc_id, source, lang, n_chars, text)."""
    by = {}
    for r in rows:
        by.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    for own in by.values():
        own.sort(key=lambda x: x[:3])
    built = {s: tree([x[2] for x in by[s]]) for s in names}
    root, tops = tree([built[s][0] for s in names])
    out = []
    for s, top in zip(names, tops):
        for (_, _, node, (doc_id, source, lang, n_chars, text)), path in zip(by[s], built[s][1]):
            if doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0 and text is not None:
                text = text.replace("\n", "")
            at = leaf(doc_id, source, lang, n_chars, text)
            for a, b in path + top:
                at = digest(a + at + b)
            out.append((doc_id, node, built[s][0], root, digest("".join(a + b for a, b in path + top)), at, at == root))
    return Counter(out)


def run(spark, tmp_path, docs):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    found = merkle.op11_merkle_manifest(spark, str(tmp_path))
    want = {"doc_id": "bigint", "leaf": "string", "subroot": "string", "root": "string", "proof_sha256": "string", "folded_root": "string", "verified": "boolean"}
    assert dict(found.dtypes) == want
    return Counter(tuple(r) for r in found.collect())


def columns(docs):
    return [tuple(r) for r in docs.select(*merkle.COLUMNS).collect()]


def test_odd_rows(spark, edge, tmp_path):
    lines = make(spark, [(i, f"line\n{i}\n", "en", "a") for i in range(300, 312)] + [(None, "a\nb", None, None)] * 2)
    docs = edge.unionByName(lines).withColumn("n_chars", F.length("text").cast("long"))
    got = run(spark, tmp_path, docs)
    assert got == brute(columns(docs))
    altered = {(i, r) for i, _, _, _, _, r, ok in got if not ok}
    assert altered and all(i is not None and zlib.crc32(str(i).encode()) % 2 == 0 for i, _ in altered)


@pytest.mark.parametrize("sizes", [(1,), (3, 1), (4, 10), (merkle.BLOCK, merkle.BLOCK + 1), (2 * merkle.BLOCK + 3, 1, 82)])
def test_heights(spark, tmp_path, sizes):
    """Trees of one node, of a full block, of a block and one node, and of several blocks."""
    rows = [(1000 * s + i, f"t{i}\n", "en", f"s{s}") for s, n in enumerate(sizes) for i in range(n)]
    docs = make(spark, rows)
    assert run(spark, tmp_path, docs) == brute(columns(docs))


def test_three_rounds_and_many_sources(spark, tmp_path, monkeypatch):
    """With blocks of three leaves, 40 rows take four rounds, and so do 40 sources."""
    monkeypatch.setattr(merkle, "BLOCK", 3)
    monkeypatch.setattr(merkle, "LEVELS", 1)
    for name in ("_HEIGHT", "_FLANKS"):
        monkeypatch.setattr(merkle, name, getattr(merkle, name).replace("243", "3").replace("when n <= 3 then 1 when n <= 9 then 2 when n <= 27 then 3 when n <= 81 then 4 else 5", "else 1"))
    docs = make(spark, [(i, f"t{i}", "en", "hot") for i in range(40)] + [(100 + i, "x\n", "en", f"s{i}") for i in range(40)])
    assert run(spark, tmp_path, docs) == brute(columns(docs))


def test_no_rows(spark, empty, tmp_path):
    assert not run(spark, tmp_path, empty)


def test_equal_rows_are_dealt_out(spark):
    """Rows alike in everything don't all land in one part."""
    docs = make(spark, [(None, "same", "en", "a")] * 4000)
    placed = merkle.placed(merkle.leaves(docs), "doc_id", "leaf")
    assert placed.select(F.count_distinct("at"), F.min("at"), F.max("at"), F.max("n")).first() == (4000, 0, 3999, 4000)


def test_a_changed_sibling_is_found(spark, tmp_path):
    docs = make(spark, [(i, f"t{i}", "en", "a") for i in range(30)])
    path = F.transform("path", lambda p, i: F.when(i == 1, F.struct(F.lit("0").alias("left"), p["right"].alias("right"))).otherwise(p))
    wrong = merkle.manifest(docs).select((merkle.folded(F.col("leaf"), path) == F.col("root")).alias("ok"))
    assert wrong.where("ok").count() == 0
