"""Queries of the graph sync: relay, consumer, lag, backfill, and the whole way as a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.operators import graph
from hyperloom.plans.adapter import LINES_SQL, experiments, table
from hyperloom.plans.registry import query
from hyperloom.plans.stream import shared_folder
from hyperloom.sources.scratch import freed
from hyperloom.sources.store import Store
from hyperloom.streaming import outbox, relay, worker

X = f"WITH {LINES_SQL}"
NOW = "2024-03-01 00:00:00"


def _event(row: DataFrame, *keep: str) -> DataFrame:
    """events as payloads of experiments of one entity; every fifth user's can't be read, every seventh's is of a version
    that nobody knows."""
    u = F.col("user_id")
    entity = F.array(F.struct(F.lit("Material").alias("type"), F.col("event_type").alias("value")))
    own = F.struct(F.concat(F.lit("EXP-"), F.col("event_id").cast("string")).alias("id"), F.col("event_type").alias("name"), entity.alias("input_entities"))
    body = F.struct(F.lit("experiment_upsert").alias("event_type"), own["id"].alias("experiment_id"), F.when(u % 7 == 0, 9).otherwise(1).alias("payload_version"), F.lit("api").alias("source"), own.alias("experiment"))
    payload = F.when(u % 5 == 0, "{broken").otherwise(F.to_json(body))
    return row.select(*keep, F.col("event_id").cast("string").alias("event_id"), payload.alias("payload"), F.col("ts").cast("timestamp").alias("created_at"))


def _outbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as an outbox: some pending with up to four attempts behind them, some published, some acked."""
    u = F.col("user_id")
    status = F.when(u % 3 == 0, "published").when(u % 3 == 1, "pending").otherwise("acked")
    events = table(spark, sf_dir, "events").withColumns({"status": status, "attempts": (u % 6).cast("int")})
    rows = _event(events, "status", "attempts")
    message = F.when(F.col("status") != "pending", F.concat(F.lit("m-"), "event_id"))
    return rows.select("event_id", "payload", "status", F.least("attempts", F.lit(4)).alias("attempts"), message.alias("message_id"), F.lit(None).cast("string").alias("error"), "created_at", F.col("created_at").alias("updated_at"))


_OUTBOX_SQL = """o AS (SELECT CAST(event_id AS VARCHAR) AS event_id, user_id, event_type, ts, CASE user_id % 3 WHEN 0 THEN 'published' WHEN 1 THEN 'pending' ELSE 'acked' END AS status, least(user_id % 6, 4) AS attempts, user_id % 5 <> 0 AND user_id % 7 <> 0 AS good FROM events)"""


@query(f"""WITH {_OUTBOX_SQL}, b AS (SELECT * FROM o WHERE status = 'pending' ORDER BY ts, event_id LIMIT 2000)
 SELECT event_id, CASE WHEN good THEN 'published' ELSE 'failed' END AS kind, CASE WHEN good THEN 'm-' || event_id END AS message_id, CASE WHEN NOT good THEN 'bad_payload' END AS error FROM b""")
def relay_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The oldest pending events: published, or failed where nobody can read them."""
    return relay.relayed(_outbox(spark, sf_dir), 2000)


@query(f"""WITH {_OUTBOX_SQL}, b AS (SELECT event_id FROM o WHERE status = 'pending' ORDER BY ts, event_id LIMIT 2000)
 SELECT status, count(*) AS events, CAST(sum(attempts) AS BIGINT) AS attempts, count(message) AS messages FROM (SELECT CASE WHEN b.event_id IS NULL THEN status WHEN good THEN 'published' WHEN attempts + 1 >= 5 THEN 'dead_letter' ELSE 'pending' END AS status,
 attempts + CASE WHEN b.event_id IS NOT NULL AND NOT good THEN 1 ELSE 0 END AS attempts, CASE WHEN o.status <> 'pending' OR (b.event_id IS NOT NULL AND good) THEN 1 END AS message FROM o LEFT JOIN b USING (event_id)) GROUP BY status""")
def relay_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The outbox after a relay: the fifth failure makes a dead letter."""
    rows = _outbox(spark, sf_dir)
    after = relay.marked(rows, relay.relayed(rows, 2000), F.lit(NOW).cast("timestamp"))
    return after.groupBy("status").agg(F.count("*").alias("events"), F.sum("attempts").alias("attempts"), F.count("message_id").alias("messages"))


@query(f"""WITH {_OUTBOX_SQL} SELECT status, count(*) AS events, CAST(sum(attempts) AS BIGINT) AS attempts FROM (SELECT CASE WHEN attempts + 1 >= 5 THEN 'dead_letter' WHEN good THEN 'published' ELSE 'pending' END AS status, attempts + 1 AS attempts FROM o WHERE status = 'published') GROUP BY status""")
def consume_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Published events whose graph can't be written, and poison among them: one attempt more; a consumer's stay
    published, poison waits to be relayed again, the fifth time ends both."""

    def broken(_: DataFrame) -> None:
        raise OSError("no graph")

    rows = _outbox(spark, sf_dir).where("status = 'published'")
    after = relay.marked(rows, relay.consumed(rows, broken), F.lit(NOW).cast("timestamp"))
    return after.groupBy("status").agg(F.count("*").alias("events"), F.sum("attempts").alias("attempts"))


@query(f"""WITH {_OUTBOX_SQL} SELECT event_id, attempts + 1 AS attempts, CASE WHEN attempts + 1 >= 3 THEN 'dead_letter' ELSE 'pending' END AS relay, CASE WHEN attempts + 1 >= 3 THEN 'dead_letter' ELSE 'published' END AS consumer FROM o""")
def failed_once_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _outbox(spark, sf_dir)
    own = outbox.failed_once_more(rows, 3).select("event_id", F.col("attempts").cast("long").alias("attempts"), F.col("status").alias("relay"))
    return own.join(outbox.failed_once_more(rows, 3, "published").select("event_id", F.col("status").alias("consumer")), "event_id")


@query(f"""WITH {_OUTBOX_SQL}, l AS (SELECT * FROM o WHERE CAST(event_id AS BIGINT) IN (SELECT l_orderkey FROM lineitem)) SELECT count(*) FILTER (status = 'pending') AS pending, count(*) FILTER (status = 'published') AS published, count(*) FILTER (status <> 'acked') > 0 AS has_lag FROM l""")
def sync_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many of some experiments' events are still under way."""
    ids = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").cast("string").alias("id")).distinct()
    return outbox.lag(_outbox(spark, sf_dir), ids)


@query(f"""WITH {_OUTBOX_SQL}, f AS (SELECT min(event_id) FILTER (status = 'published') AS m, max(event_id) AS e FROM o) SELECT o.event_id, o.status FROM o, f WHERE o.event_id = f.m OR o.event_id = f.e""")
def outbox_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One event by its id and one by its message's."""
    rows = _outbox(spark, sf_dir)
    message, event = rows.agg(F.min(F.when(F.col("status") == "published", F.col("message_id"))), F.max("event_id")).first()
    found = relay.lookup(rows, message_id=message).unionByName(relay.lookup(rows, event_id=event))
    return found.select("event_id", "status").distinct()


@query("""SELECT count(*) AS events, count(*) FILTER (user_id % 5 <> 0 AND user_id % 7 <> 0) AS readable, count(DISTINCT CASE WHEN user_id % 5 <> 0 AND user_id % 7 <> 0 THEN event_type END) AS names FROM events""")
def event_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads read back; another version or a broken text is no event."""
    read = outbox.decode(_event(table(spark, sf_dir, "events")))
    return read.agg(F.count("*").alias("events"), F.count("event").alias("readable"), F.count_distinct(F.col("event.experiment.input_entities")[0]["value"]).alias("names"))


@query("""SELECT count(*) AS known, count(*) FILTER (event_type <> 'click') AS waiting FROM events""")
def events_enqueued(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events enqueued twice and once more among others: each is there once."""
    rows = _outbox(spark, sf_dir)
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("event_id").cast("string").alias("event_id"))
    old = rows.join(clicks, "event_id", "left_semi")
    every = relay.enqueued(old, rows.unionByName(rows))
    return every.agg(F.count("*").alias("known")).crossJoin(every.join(clicks, "event_id", "left_anti").agg(F.count("*").alias("waiting")))


@query("""WITH d AS (SELECT DISTINCT user_id FROM events), b AS (SELECT count(*) AS n FROM d WHERE user_id % 4 <> 0), s AS (SELECT * FROM d WHERE user_id % 4 <> 0)
 SELECT b.n AS backfilled, b.n AS published, CAST(0 AS BIGINT) AS failed, b.n AS acked, (SELECT count(*) FROM d) AS experiments FROM b""")
def backfill_and_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments without an event get one; a turn of the worker publishes, applies and acknowledges them."""
    store = Store(spark, shared_folder(spark, "sync"))
    now = F.lit(NOW).cast("timestamp")
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    entity = F.array(F.struct(F.lit("Material").alias("type"), F.col("user_id").cast("string").alias("value")))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    rows = users.select(
        F.concat(F.lit("U-"), F.col("user_id").cast("string")).alias("id"), F.col("user_id").alias("ord"), F.lit("user").alias("name"), entity.alias("input_entities"), none(schema.ENTITY).alias("process_entities"), none(schema.ENTITY).alias("output_entities"),
        none(schema.RELATION).alias("relations"), none("string").alias("evidence"), F.lit(1.0).alias("confidence"), F.lit(2024).alias("year"), F.lit("RU").alias("geography"), F.lit("report").alias("source_type"), F.lit(False).alias("is_sensitive"),
    )
    done = relay.waiting(rows.where("ord % 4 = 0"), now).withColumn("status", F.lit("acked"))
    store.save("outbox", done)
    new = relay.backfilled(rows, store.load("outbox"), now)
    store.save("outbox", store.load("outbox").unionByName(new))
    count = store.load("outbox").where("status = 'pending'").count()
    moved = relay.sync_once(store, lambda experiments: store.save("applied", experiments), now, batch=count, strict=True)
    every = rows.agg(F.count("*").alias("experiments"))
    return every.select(F.lit(count).cast("long").alias("backfilled"), *(F.lit(moved[k]).cast("long").alias(k) for k in ("published", "failed", "acked")), "experiments")


@query("""WITH o AS (SELECT user_id % 5 <> 0 AND user_id % 7 <> 0 AS good, row_number() OVER (ORDER BY CAST(event_id AS VARCHAR)) AS r FROM events)
 SELECT CASE WHEN r > 600 THEN 'pending' WHEN good THEN 'acked' ELSE 'dead_letter' END AS status, count(*) AS events, count(*) FILTER (r <= 600 AND good) AS messages, count(*) FILTER (r <= 600 AND NOT good) AS attempts FROM o GROUP BY 1""")
def worker_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three turns of the worker on a log of all events, the last after a compaction: the oldest are applied, those that
    can't be read end as dead letters, the rest waits."""
    store, now = Store(spark, shared_folder(spark, "worker")), F.lit(NOW).cast("timestamp")
    turns = worker.Worker(store, lambda experiments: store.upsert("applied", experiments.select("id", "name")), batch=200, most=1, compact_every=2)
    turns.enqueue_payloads(_event(table(spark, sf_dir, "events")), now)
    for _ in range(3):
        turns.turn(now)
    return turns.state().groupBy("status").agg(F.count("*").alias("events"), F.count("message_id").alias("messages"), F.sum("attempts").alias("attempts"))


@query(f"""{X} SELECT 'HAS_INPUT' AS type, count(*) * 4 AS edges FROM x UNION ALL SELECT 'HAS_PROCESS', count(*) * 2 FROM x UNION ALL SELECT 'HAS_OUTPUT', count(*) * 2 FROM x UNION ALL SELECT 'EVIDENCE_FROM', count(*) FROM x
 UNION ALL SELECT 'USES_MATERIAL', count(*) FROM x UNION ALL SELECT 'LOCATED_AT', count(*) FROM x""")
def stream_graph_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every experiment's event published to a folder of messages, read as a stream, decoded and applied as edges."""
    messages = shared_folder(spark, "messages")
    with freed(spark):
        outbox.encode(experiments(spark, sf_dir), "migration").write.option("compression", "gzip").json(messages)
    stream = spark.readStream.schema("event_id string, payload string").json(messages)
    read = outbox.decode(stream).where("event is not null").select("event.experiment.*")
    return outbox.run_to_end(graph.edges(read).drop("experiment_id"), shared_folder(spark, "stream")).groupBy("type").agg(F.count("*").alias("edges"))
