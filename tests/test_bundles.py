"""Bundles of words in generated code against numpy's."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.functions import vectors
from hyperloom.operators import bundles, search
from hyperloom.sources.seed import seed
from hyperloom.sources.store import Store


def bits(words, dim):
    return np.array([1 if (w >> b) & 1 else -1 for w in words for b in range(64)], np.int8)[:dim]


def odd(spark):
    """Seed experiments, one without entities, one with many, one whose relation's end is no entity, and a repeat of another."""
    rows = seed(spark)
    first = rows.limit(1)
    none = F.array().cast(f"array<{schema.ENTITY}>")
    bare = first.withColumns({"id": F.lit("bare"), "input_entities": none, "process_entities": none, "output_entities": none, "relations": F.array().cast(f"array<{schema.RELATION}>")})
    lost = first.withColumns({"id": F.lit("lost"), "relations": F.array(F.struct(F.lit("nobody").alias("source"), F.lit("located_at").alias("type"), F.lit("nowhere").alias("target")))})
    two = first.withColumns({"id": F.lit("two"), "input_entities": F.expr("array(named_struct('type', 'Facility', 'value', 'a'), named_struct('type', 'Equipment', 'value', 'b'))"), "process_entities": none, "output_entities": none, "relations": F.array().cast(f"array<{schema.RELATION}>")})
    return rows.unionByName(bare).unionByName(lost).unionByName(two).unionByName(first.withColumn("id", F.lit("again")))


@pytest.mark.parametrize("dim,places", [(64, 24), (128, 24), (100, 24), (100, 2)])
def test_equal_to_numpy(spark, monkeypatch, dim, places):
    """Ties, weights and permutation included, side by side and, with few places, by rows."""
    monkeypatch.setattr(bundles, "MOST_PLACES", places)
    rows = odd(spark)
    want = {r.id: vectors.unpack(r.hv, dim) for r in search.encode_experiments(rows, dim, False, make=vectors.digest_vector).collect()}
    got = {r.id: bits(r.hv, dim) for r in bundles.as_arrays(search.encode_words(rows, dim, bundles.digest_word), dim).collect()}
    assert set(got) == set(want) - {"bare"} | {"bare"} and len(got) == rows.count()
    for k in want:
        assert (got[k] == want[k]).all(), k


def test_question_and_similarity(spark):
    dim, rows = 100, odd(spark)
    asked = spark.createDataFrame([("Facility", "a"), ("Equipment", "b"), ("Property", "pH: 2.0")], "type string, value string")
    q = search.query_words(asked, dim, bundles.digest_word)
    assert (bits(q, dim) == search.query_hv(asked, dim, False, vectors.digest_vector)).all()
    got = {r.id: r.similarity for r in bundles.similarities(search.encode_words(rows, dim, bundles.digest_word), q, dim).collect()}
    want = {r.id: r.similarity for r in search.encode_experiments(rows, dim, False, against=bits(q, dim), make=vectors.digest_vector).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
    assert search.query_words(asked.limit(0), dim) is None


def test_hashed_words_at_full_dimension(spark):
    """A bundle is like its parts and unlike others; 10 000 is no multiple of 64."""
    rows = odd(spark)
    held = bundles.as_arrays(search.encode_words(rows), vectors.FULL).collect()
    hv = {r.id: bits(r.hv, vectors.FULL) for r in held}
    assert all(len(r.hv) == 157 and (r.hv[-1] >> 16) == 0 for r in held)
    assert vectors.similarity(hv["again"], hv[seed(spark).first().id]) == 1.0 and abs(vectors.similarity(hv["bare"], hv["two"])) < 0.05
    asked = spark.createDataFrame([("Facility", "a")], "type string, value string")
    near = {r.id: r.similarity for r in bundles.similarities(search.encode_words(rows), search.query_words(asked), vectors.FULL).collect()}
    assert max(near, key=near.get) == "two" and near["two"] > 0.3 and sorted(near.values())[-2] < 0.1


def test_no_python(spark):
    plan = bundles.similarities(search.encode_words(seed(spark)), [0] * 157, vectors.FULL)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_many_weights(spark):
    """Adders over up to 200 planes of weights 1 to 5 give the sums' signs."""
    rng = np.random.default_rng(4)
    names = [f"k{i}" for i in range(20)]
    rows = [(str(r), [f"B\u0001Role\u0001E\u0002{n}" for n in names[: rng.integers(1, 20)]]) for r in range(30)]
    rows = [(i, p, rng.integers(1, 6, len(p)).tolist()) for i, p in rows]
    parts = spark.createDataFrame(rows, "id string, parts array<string>, weights array<int>")
    got = {r.id: bits(r.hv, 64) for r in bundles.as_arrays(bundles.bundled_words(parts, 64, "experiments", bundles.digest_word), 64).collect()}
    tie = vectors.tie("experiments", 64, vectors.digest_vector)
    role = vectors.digest_vector("Role:Role", 64)
    for i, own, weights in rows:
        total = sum(w * role.astype(int) * vectors.digest_vector(p.rpartition("\u0002")[2], 64) for p, w in zip(own, weights))
        assert (got[i] == np.where(total == 0, tie, np.sign(total))).all()


def test_semantic_codebook(spark, tmp_path):
    """The same vectors as one key at a time, kept in a store: a second load makes new keys' vectors only."""
    made = spark.sparkContext.accumulator(0)

    def embed(values):
        made.add(len(values))
        return bundles.trigrams(values)

    dim, store = 200, Store(spark, str(tmp_path))
    semantic = bundles.Semantic(dim, store, embed)
    rows = odd(spark)
    got = {r.id: bits(r.hv, dim) for r in bundles.as_arrays(search.encode_words(rows, dim, bundles.digest_word, semantic), dim).collect()}
    known = {r.key: bits(r.hv, dim) for r in store.load("codebook").collect()}
    first = made.value
    assert first == len(known) and all(k.partition(":")[0] not in ("Role", "RelationType", "NumericBase") for k in known)
    matrix = vectors.projection(dim=dim)
    for key, hv in known.items():
        assert (hv == vectors.project(vectors.trigram_embedding(key.partition(":")[2]), matrix)).all()
    asked = spark.createDataFrame([("Facility", "a"), ("Equipment", "brand new thing")], "type string, value string")
    assert len(search.query_words(asked, dim, bundles.digest_word, semantic)) == 4
    assert made.value == first + 1 and store.load("codebook").count() == first + 1
    plain = {r.id: bits(r.hv, dim) for r in bundles.as_arrays(search.encode_words(rows, dim, bundles.digest_word), dim).collect()}
    assert all((got[k] == plain[k]).all() == (k in ("bare",)) for k in got)  # entities alone differ
