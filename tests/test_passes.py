"""Steps that large tables need: what is read once, what stays unshuffled, what is freed and how files are written."""

import os
import random

import pytest
from pyspark.sql import functions as F

from hyperloom.functions import vectors
from hyperloom.operators import browse, bundles, counterfactual, gaps, graph, search
from hyperloom.plans import storage, sync
from hyperloom.plans.adapter import experiments, lines, spread
from hyperloom.sources import scratch
from hyperloom.sources.seed import seed

DATA = "/root/testdata/sf0.001"


@pytest.fixture()
def counting(spark):
    """(a column's rows as they are made, how many were made so far)."""
    made = spark.sparkContext.accumulator(0)

    def seen(x):
        made.add(1)
        return x

    return F.udf(seen, "string").asNondeterministic(), lambda: made.value


def test_gaps_read_experiments_once(spark, counting):
    count, made = counting
    rows = seed(spark).withColumn("geography", count("geography"))
    assert gaps.analyze(rows, ["Material", "Facility"]).count() > 0 and made() == 6


def test_hits_are_made_once(spark, counting):
    count, made = counting
    rows = lines(spark, DATA).select("id", "material", "process", "facility").limit(500).cache()
    asked = spark.createDataFrame([("a", *rows.select("material", "process", "facility").first())], "question string, material string, process string, facility string")
    hits = search.top_hits(rows.withColumn("id", count("id")), asked, 5)
    before = made()
    assert hits.join(hits.select("id"), "id").count() == 5 and hits.first().hits == 500 and made() == before


def test_line_items_meet_orders_as_narrow_rows(spark):
    """The join with orders lies below those that add texts, and amounts are whole numbers there."""
    tree = lines(spark, DATA).select("id", "material", "facility", "price", "expert")._jdf.queryExecution().optimizedPlan().toString().split("\n")
    joined = lambda key: next(i for i, x in enumerate(tree) if "Join Inner" in x and key in x)
    assert joined("s_suppkey") < joined("p_partkey") < joined("o_orderkey") < next(i for i, x in enumerate(tree) if "l_extendedprice" in x)


def test_many_tasks_are_not_dealt_out_again(spark, tmp_path):
    spark.range(1000).repartition(1).write.parquet(str(tmp_path / "few"))
    one = spark.read.parquet(str(tmp_path / "few"))
    many = one.repartition(9)
    assert spread(one, one).rdd.getNumPartitions() > 1 and spread(many, many) is many


def test_written_frees_its_shuffles(spark):
    asked = []
    held = spark.conf.get(scratch.FREE, "false")
    with scratch.freed(spark):
        asked.append(spark.conf.get(scratch.FREE))
    assert asked == ["true"] and spark.conf.get(scratch.FREE) == held
    files = lambda: sum(x.startswith("shuffle_") and x.endswith(".data") for top in {os.path.dirname(d) for d in local_folders(spark)} for _, _, names in os.walk(top) for x in names)
    before = files()
    table = scratch.written(spark.range(1000).groupBy(F.col("id") % 7).count())
    assert files() <= before and table.count() == 7


def local_folders(spark):
    return [f.getAbsolutePath() + "/x" for f in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()]


def test_neighbours_by_words_are_those_by_packed_vectors(spark):
    rows = experiments(spark, DATA)
    cells = lines(spark, DATA).select(F.col("material").alias("d0"), F.col("facility").alias("d1")).distinct().orderBy("d0", "d1").limit(4)
    packed = search.encode_experiments(rows, 64, False, make=vectors.digest_vector)
    words = bundles.as_arrays(search.encode_words(rows, 64, bundles.digest_word), 64)
    assert "Exchange" not in words._jdf.queryExecution().executedPlan().toString().replace("BroadcastExchange", "")  # a bundle is a row
    told = [sorted(map(tuple, gaps.neighbours(rows, e, cells, ["Material", "Facility"], 64, False, make=vectors.digest_vector).collect())) for e in (packed, words)]
    assert told[0] == told[1] and len(told[0]) == 4 * 5 * 2


def test_words_of_several_are_compared_too(spark):
    rows = seed(spark)
    words = search.encode_words(rows, 200, bundles.hashed_word)
    query = bundles.as_arrays(words.where("id = 'EXP-NI-01'"), 200).first().hv
    assert {r.id: r.similarity for r in bundles.similarities(words, query, 200).collect()}["EXP-NI-01"] == 1.0


def test_effects_seek_outputs_of_pairs_alone(spark, monkeypatch):
    rows, sought, outputs = experiments(spark, DATA), [], counterfactual.outputs
    ids = [r.id for r in rows.orderBy("id").limit(2).collect()]
    monkeypatch.setattr(counterfactual, "outputs", lambda found: (sought.append(found.count()), outputs(found))[1])
    found = counterfactual.effects(spark.createDataFrame([tuple(ids)], "id string, other string"), rows).collect()
    assert {(r.id, r.other) for r in found} == {tuple(ids)} and sought == [2]


def test_semantic_edges_are_those_of_relations(spark):
    rows = seed(spark)
    every = {tuple(r) for r in graph.edges(rows).collect()}
    assert {tuple(r) for r in graph.semantic_edges(rows).collect()} == {e for e in every if not e[1].startswith("HAS_") and e[1] != "EVIDENCE_FROM"} != set()


def test_expand_reads_edges_twice(spark, counting):
    count, made = counting
    edges = graph.edges(seed(spark)).select("source", "type", "target").cache()
    ids = seed(spark).select("id").where("id like 'EXP-NI%'")
    want = sorted(map(tuple, graph.expand(edges, ids).collect()))
    got = sorted(map(tuple, graph.expand(edges.withColumn("target", count("target")), ids).collect()))
    assert got == want and made() <= 2 * edges.count()


def test_within_drops_edges_before_a_shuffle(spark, monkeypatch):
    rng = random.Random(5)
    edges = spark.createDataFrame([(f"n{rng.randrange(30)}", "t", f"n{rng.randrange(30)}") for _ in range(200)], "source string, type string, target string")
    shown = spark.createDataFrame([(f"n{i}",) for i in range(0, 30, 3)], "node string")
    own = {f"n{i}" for i in range(0, 30, 3)}
    want = sorted(tuple(r) for r in edges.collect() if r.source in own and r.target in own)
    few = browse.within(edges, shown)
    assert sorted(map(tuple, few.collect())) == want
    monkeypatch.setattr(browse, "BROADCAST_TARGETS", 0)
    assert sorted(map(tuple, browse.within(edges, shown).collect())) == want


@pytest.mark.parametrize(("module", "name"), [(storage, "json_experiments"), (sync, "stream_graph_sync")])
def test_texts_go_out_compressed(spark, tmp_path, monkeypatch, module, name):
    monkeypatch.setattr(module, "shared_folder", lambda _, kind="stream": str(tmp_path / kind))
    assert getattr(module, name)(spark, DATA).count() > 0
    texts = [x for d, _, names in os.walk(tmp_path) for x in names if ".json" in x and x.startswith("part-")]
    assert texts and all(x.endswith(".json.gz") for x in texts)
