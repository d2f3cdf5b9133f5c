"""Tables merged by buckets and the worker on a log: what a step writes, and that breaking off does no harm."""

import os
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from hyperloom.sources.graph_store import GraphStore
from hyperloom.sources.seed import seed
from hyperloom.sources.store import Store
from hyperloom.streaming import outbox, relay, worker

NOW = lambda minute: F.lit(f"2024-03-01 00:{minute:02d}:00").cast("timestamp")


def files(root):
    return {os.path.join(d, f) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def read_from(df):
    return {p.removeprefix("file://").removeprefix("file:") for p in df.inputFiles()}


def test_a_merge_writes_the_buckets_it_touches(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=16)
    rows = lambda ids, v: spark.createDataFrame([(i, v) for i in ids], "id long, v string")
    assert store.load("t") is None
    first = store.upsert("t", rows(range(1000), "a"))
    before = read_from(store.load("t"))
    store.upsert("t", rows([7], "b"))
    after = read_from(store.load("t"))
    assert {(r.id, r.v) for r in store.load("t").collect()} == {(i, "b" if i == 7 else "a") for i in range(1000)}
    assert len({os.path.dirname(p) for p in before - after}) == 1 and len({os.path.dirname(p) for p in after}) == 16
    assert before <= files(tmp_path)  # the older version can still be read
    assert {r.v for r in store.load("t", first).collect()} == {"a"}
    store.upsert("t", spark.createDataFrame([(7, "c"), (5000, "c")], "id int, v string"))  # a key of another type is the same key
    got = Counter(r.v for r in store.load("t").collect())
    assert got == {"a": 999, "c": 2}
    assert store.upsert("t", rows([], "x")) and store.load("t").count() == 1001


def test_merges_of_odd_keys(spark, tmp_path):
    store = Store(spark, str(tmp_path), buckets=3)
    store.upsert("t", spark.createDataFrame([], "id string, v int"))
    assert store.load("t").count() == 0 and store.load("t").columns == ["id", "v"]
    store.upsert("t", spark.createDataFrame([(None, 1), ("", 2), ("é", 3)], "id string, v int"))
    store.upsert("t", spark.createDataFrame([("é", 4)], "id string, v int"))
    assert sorted(r.v for r in store.load("t").collect()) == [1, 2, 4]
    store.save("t", spark.createDataFrame([("x", 9)], "id string, v int"))  # saved whole in between
    store.upsert("t", spark.createDataFrame([("y", 8)], "id string, v int"))
    assert {r.id: r.v for r in store.load("t").collect()} == {"x": 9, "y": 8}


def test_graph_merges_touch_few_files(spark, tmp_path):
    store = GraphStore(Store(spark, str(tmp_path), buckets=32))
    store.insert(seed(spark))
    nodes, edges = read_from(store.nodes()), read_from(store.edges())
    counts = store.nodes().count(), store.edges().count()
    store.insert(seed(spark))  # again: nothing is new
    assert (store.nodes().count(), store.edges().count()) == counts
    nodes, edges = read_from(store.nodes()), read_from(store.edges())
    store.insert_ontology(spark.createDataFrame([("Material", "unheard of")], "type string, value string"))
    assert len(nodes - read_from(store.nodes())) <= 8 and read_from(store.edges()) == edges and store.nodes().count() == counts[0] + 1
    store.check_unique()


@pytest.fixture()
def events(spark):
    good = outbox.encode(seed(spark)).select("event_id", "payload")
    return good.unionByName(spark.createDataFrame([("bad", "{broken")], "event_id string, payload string"))


def statuses(w):
    return {r[0]: (r[1], r[2]) for r in w.state().groupBy("status").agg(F.count("*"), F.sum("attempts")).collect()}


def test_turns(spark, tmp_path, events):
    """The same states as the outbox that is rewritten: failures, stale events, acks, dead letters, requeues."""
    store, broken = Store(spark, str(tmp_path)), [True]
    graph = GraphStore(store)

    def apply(rows):
        if broken[0]:
            raise OSError("no graph")
        graph.insert(rows)

    w = worker.Worker(store, apply, compact_every=3)
    w.enqueue_payloads(events, NOW(0))
    w.enqueue_payloads(events, NOW(0))  # known already
    n = events.count() - 1
    assert statuses(w) == {"pending": (n + 1, 0)}
    assert w.turn(NOW(1)) == {"published": n, "failed": 1, "acked": 0}
    assert statuses(w) == {"published": (n, n), "pending": (1, 1)}
    broken[0] = False
    assert w.turn(NOW(2)) == {"published": 0, "failed": 1, "acked": 0}  # not stale yet
    assert w.turn(NOW(10)) == {"published": n, "failed": 1, "acked": n}
    assert statuses(w) == {"acked": (n, n), "pending": (1, 3)} and graph.nodes().count() > 0
    assert w.run(NOW(11)) == {"published": 0, "failed": 2, "acked": 0}
    assert statuses(w) == {"acked": (n, n), "dead_letter": (1, 5)}
    w.requeue_dead(NOW(12))
    assert statuses(w)["pending"] == (1, 0)
    with pytest.raises(RuntimeError, match="could not be relayed"):
        w.turn(NOW(13), strict=True)
    bad = w.state().where("event_id = 'bad'").first()
    assert (bad.status, bad.attempts, bad.error) == ("pending", 1, "bad_payload")


def test_a_turn_writes_its_batch_only(spark, tmp_path):
    """Bytes and files of a turn don't grow with the outbox."""
    wrote = {}
    for n in (100, 3000):
        store = Store(spark, str(tmp_path / str(n)))
        payload = outbox.encode(seed(spark).limit(1)).first().payload
        rows = spark.range(n).select(F.format_string("e%06d", "id").alias("event_id"), F.lit(payload).alias("payload"))
        w = worker.Worker(store, lambda rows: rows.count(), batch=10)
        w.enqueue_payloads(rows, NOW(0))
        before = files(tmp_path)
        w.turn(NOW(1))
        wrote[n] = files(tmp_path) - before
        assert w.turn(NOW(1))["acked"] == 10
    assert len(wrote[3000]) <= len(wrote[100]) + 4 and sum(map(os.path.getsize, wrote[3000])) < 2 * sum(map(os.path.getsize, wrote[100]))


def test_breaking_off_and_compaction(spark, tmp_path, events):
    store = Store(spark, str(tmp_path))
    w = worker.Worker(store, lambda rows: rows.count(), compact_every=100)
    w.enqueue_payloads(events, NOW(0))
    w.turn(NOW(1))
    want = {tuple(r) for r in w.state().collect()}
    store.save("outbox_state", w.state())  # a compaction that broke off before it said how far it came
    assert {tuple(r) for r in w.state().collect()} == want
    w.compact()
    assert {tuple(r) for r in w.state().collect()} == want
    parts = store.log_parts("outbox_log")
    w._append(w.next_turn() - 1, "relay", store.log("outbox_log", [parts[-1]]).select("event_id", "kind", "message_id", "error"), NOW(2))  # a step repeated after its snapshot
    assert {tuple(r) for r in w.state().collect()} == want


def test_fold_equals_the_log_fold(spark):
    """Random logs, cut anywhere by a snapshot, give what `outbox.state` gives for the whole."""
    rng = random.Random(9)
    kinds = ["published", "acked", "failed", "consume_failed", "requeued"]
    log = [(f"e{e}", s, "enqueued" if s == 0 else rng.choice(kinds)) for e in range(40) for s in range(rng.randrange(1, 12))]
    df = spark.createDataFrame([(e, s, k, None, None) for e, s, k in log], "event_id string, seq long, kind string, message_id string, error string").withColumn("at", NOW(0) + F.make_dt_interval(secs=F.col("seq").cast("double")))
    want = {(r.event_id, r.status, r.attempts) for r in outbox.state(df, 3).collect()}
    empty = spark.createDataFrame([], worker.STATE)
    for at in (0, 3, 99):
        snapshot = worker.folded(empty, df.where(F.col("seq") < at), 3)
        got = worker.folded(snapshot, df, 3)  # transitions that the snapshot has come again
        assert {(r.event_id, r.status, r.attempts) for r in got.collect()} == want


def test_messages_of_relay_are_the_same(spark, events):
    """The worker's transitions are those of `relay.relayed`."""
    rows = events.select("event_id", "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), NOW(0).alias("created_at"), NOW(0).alias("updated_at"))
    assert {r.kind for r in relay.relayed(rows).collect()} == {"published", "failed"}


def test_a_large_merge_takes_its_buckets_in_passes(spark, tmp_path, monkeypatch):
    """Few rows at a time give the same table as all at once, over a merged table and one that was saved whole."""
    from hyperloom.sources import store as stores

    seen, write = [], Store._write
    monkeypatch.setattr(Store, "_write", lambda self, df, path, *by: (seen.append(by), write(self, df, path, *by))[1])
    rows = lambda a, b, v: spark.range(a, b).select("id", F.lit(v).alias("v"))
    for most in (stores.MERGED_TOGETHER, 20):
        monkeypatch.setattr(stores, "MERGED_TOGETHER", most)
        store = Store(spark, str(tmp_path / str(most)), buckets=4)
        store.upsert("a", rows(0, 60, "old"))
        store.upsert("a", rows(40, 90, "new"))
        store.save("b", rows(0, 60, "old"))
        store.upsert("b", rows(40, 90, "new"))
        for name in "ab":
            assert sorted(map(tuple, store.load(name).collect())) == [(i, "old" if i < 40 else "new") for i in range(90)]
    assert seen.count(("_bucket",)) == 3 + 3 + 4 + 4  # a pass for each merge, then as many as there are buckets or 20 rows
