"""Queries over the events table: outbox states, windows, and both as real streams."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.plans.adapter import table
from hyperloom.plans.registry import query
from hyperloom.streaming import outbox, windows

_LOG_SQL = "l AS (SELECT user_id, event_id AS seq, ts, CASE event_type WHEN 'signup' THEN 'enqueued' WHEN 'view' THEN 'published' WHEN 'purchase' THEN 'acked' WHEN 'error' THEN 'failed' ELSE 'requeued' END AS kind FROM events)"
_STATE_SQL = f"""WITH {_LOG_SQL}, q AS (SELECT *, count(*) FILTER (kind = 'requeued') OVER (PARTITION BY user_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS r FROM l),
 f AS (SELECT user_id, count(*) FILTER (kind = 'failed' AND r = 0) AS attempts, arg_max(kind, seq) AS kind, min(ts) AS created, max(ts) AS updated FROM q GROUP BY 1),
 s AS (SELECT CAST(user_id AS VARCHAR) AS event_id, CASE WHEN kind IN ('enqueued', 'requeued') THEN 'pending' WHEN kind IN ('published', 'acked') THEN kind WHEN attempts >= 2 THEN 'dead_letter' ELSE 'pending' END AS status, attempts, created, updated FROM f)"""
_KINDS = {"signup": "enqueued", "view": "published", "purchase": "acked", "error": "failed"}


def _log(events: DataFrame) -> DataFrame:
    """One row of events is one transition of the event named by its user."""
    kind = F.lit("requeued")
    for name, k in _KINDS.items():
        kind = F.when(F.col("event_type") == name, k).otherwise(kind)
    return events.select(F.col("user_id").cast("string").alias("event_id"), F.col("event_id").alias("seq"), F.col("ts").cast("timestamp").alias("at"), kind.alias("kind"))


def _state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.state(_log(table(spark, sf_dir, "events")), most=2)


@query(f"{_STATE_SQL} SELECT event_id, status, attempts FROM s")
def outbox_latest_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _state(spark, sf_dir).select("event_id", "status", "attempts")


@query(f"""{_STATE_SQL} SELECT k.status, count(s.event_id) AS events, CAST(epoch((SELECT date_trunc('second', max(ts)) FROM events)) - epoch(date_trunc('second', min(s.created))) AS BIGINT) AS oldest_seconds
 FROM (SELECT unnest(['pending', 'published', 'acked', 'dead_letter']) AS status) k LEFT JOIN s USING (status) GROUP BY k.status""")
def outbox_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return outbox.metrics(_state(spark, sf_dir), F.lit(now))


@query(f"{_STATE_SQL} SELECT CAST(c_custkey AS VARCHAR) AS id FROM customer WHERE CAST(c_custkey AS VARCHAR) NOT IN (SELECT event_id FROM s WHERE status <> 'dead_letter')")
def outbox_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.orphans(table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("id")), _state(spark, sf_dir))


@query(f"{_STATE_SQL} SELECT event_id, 'pending' AS status, 0 AS attempts FROM s WHERE status = 'dead_letter'")
def dead_letters_requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    dead = _state(spark, sf_dir).where("status = 'dead_letter'")
    return outbox.requeue_dead(dead).select("event_id", "status", F.col("attempts").cast("int").alias("attempts"))


@query(f"{_STATE_SQL} SELECT event_id, CASE WHEN status = 'published' AND updated < (SELECT max(ts) FROM events) - INTERVAL 1 DAY THEN 'pending' ELSE status END AS status FROM s")
def stale_requeued(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = table(spark, sf_dir, "events").agg(F.max(F.col("ts").cast("timestamp"))).first()[0]
    return outbox.requeue_stale(_state(spark, sf_dir), F.lit(now), 86_400).select("event_id", "status")


@query(f"{_STATE_SQL} SELECT event_id FROM s WHERE status = 'pending' ORDER BY created, event_id LIMIT 50")
def outbox_fifo_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return outbox.pending(_state(spark, sf_dir)).select("event_id")


@query("SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY user_id, event_type, time_bucket(INTERVAL 1 HOUR, ts)")
def events_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    hour = F.window(F.col("ts").cast("timestamp"), "1 hour")
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type", hour).agg(F.min("event_id").alias("event_id")).select("user_id", "event_type", "event_id")


_CENTS = "CAST(sum(CAST(round(value * 100) AS BIGINT)) AS BIGINT) AS cents"


@query(f"SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS events, {_CENTS} FROM events GROUP BY 1, 2")
def events_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(windows.timed(table(spark, sf_dir, "events")), "1 hour", None, "event_type").withColumn("start", F.unix_timestamp("start"))


@query(f"""SELECT CAST(epoch(s) AS BIGINT) AS start, count(*) AS events, {_CENTS} FROM (SELECT unnest([time_bucket(INTERVAL 15 MINUTE, ts), time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 15 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 30 MINUTE, time_bucket(INTERVAL 15 MINUTE, ts) - INTERVAL 45 MINUTE]) AS s, value FROM events) GROUP BY 1""")
def events_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.windowed(windows.timed(table(spark, sf_dir, "events")), "1 hour", "15 minutes").withColumn("start", F.unix_timestamp("start"))


@query("""WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 6 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
 SELECT user_id, CAST(epoch_us(min(ts)) AS BIGINT) AS start, count(*) AS events FROM s GROUP BY user_id, n""")
def events_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.sessions(windows.timed(table(spark, sf_dir, "events")), "6 hours", "user_id").withColumn("start", F.unix_micros("start"))


# --- as streams -----------------------------------------------------------------------------------------------------------


def shared_folder(spark: SparkSession, name: str = "stream") -> str:
    """A new folder below the one that the cluster shares (spark.checkpoint.dir). Where that is unset, a temporary one
    serves a session on one machine; on a cluster that is an error."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None and not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
    return f"{shared}/{name}-{uuid.uuid4().hex}" if shared else f"{tempfile.mkdtemp(prefix='hyperloom-')}/{name}"


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{sf_dir}/events.parquet"
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path + "*")


@query(f"SELECT CAST(epoch(time_bucket(INTERVAL 1 HOUR, ts)) AS BIGINT) AS start, event_type, count(*) AS events, {_CENTS} FROM events GROUP BY 1, 2")
def stream_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = windows.windowed(windows.timed(_stream(spark, sf_dir), "31 days"), "1 hour", None, "event_type").withColumn("start", F.unix_timestamp("start"))
    return outbox.newest(outbox.run_to_end(counted, shared_folder(spark), "update"), ["start", "event_type"])


@query("SELECT CAST(user_id AS VARCHAR) AS event_id, count(*) AS n FROM (SELECT DISTINCT user_id FROM events) GROUP BY 1")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    once = outbox.deduplicated(_log(_stream(spark, sf_dir)).select("event_id", "at"), "at", "62 days")
    return outbox.run_to_end(once, shared_folder(spark)).groupBy("event_id").agg(F.count("*").alias("n"))


@query(f"{_STATE_SQL} SELECT event_id, status, attempts FROM s")
def stream_outbox_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = outbox.attempts(_log(_stream(spark, sf_dir)).select("event_id", "seq", "kind"), most=2)
    return outbox.newest(outbox.run_to_end(states, shared_folder(spark), "update"), ["event_id"])
