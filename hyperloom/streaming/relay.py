"""Relay and consumer between the outbox and the graph: publish, apply, acknowledge, give up.

A step maps tables to transitions (event_id, kind, message_id, error); `marked` folds them into the outbox. Steps may be
repeated: published messages have ids of their own events, and applying an experiment twice changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.streaming import outbox

NEW = "event_id string, payload string, status string, attempts int, message_id string, error string, created_at timestamp, updated_at timestamp"
Apply = Callable[[DataFrame], None]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], NEW)


def waiting(experiments: DataFrame, now: Column, source: str = "api") -> DataFrame:
    """Outbox rows of experiments that wait to be published."""
    return outbox.encode(experiments, source).select("event_id", "payload", F.lit("pending").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("message_id"), F.lit(None).cast("string").alias("error"), now.alias("created_at"), now.alias("updated_at"))


def enqueued(rows: DataFrame, new: DataFrame) -> DataFrame:
    """The outbox with new events, each once."""
    return rows.unionByName(outbox.enqueue(rows, new))


def backfilled(experiments: DataFrame, rows: DataFrame, now: Column) -> DataFrame:
    """Outbox rows for the experiments that no event under way or done stands for."""
    own = outbox.decode(rows.where("status <> 'dead_letter'")).select(F.col("event.experiment_id").alias("id")).where("id is not null").distinct()
    return waiting(experiments.join(own, "id", "left_anti"), now, "migration")


def relayed(rows: DataFrame, most: int = outbox.BATCH, ids: list[str] | None = None) -> DataFrame:
    """Transitions of the oldest pending events: published, or failed where the payload can't be read."""
    batch = outbox.pending(rows if ids is None else rows.where(F.col("event_id").isin(ids)), most)
    good = F.col("event").isNotNull()
    return outbox.decode(batch).select("event_id", F.when(good, "published").otherwise("failed").alias("kind"), F.when(good, F.concat(F.lit("m-"), "event_id")).alias("message_id"), F.when(~good, "bad_payload").alias("error"))


def consumed(messages: DataFrame, apply: Apply) -> DataFrame:
    """Transitions of messages (event_id, message_id, payload): acked once their experiments are applied, consume_failed
    if that fails, and failed for poison, which isn't seen again."""
    read = outbox.decode(messages)
    try:
        apply(read.where("event is not null").select("event.experiment.*").dropDuplicates(["id"]))
        kind, error = F.lit("acked"), F.lit(None).cast("string")
    except Exception as e:  # noqa: BLE001 - whatever keeps the graph from being written
        kind, error = F.lit("consume_failed"), F.lit(f"{type(e).__name__}")
    good = F.col("event").isNotNull()
    return read.select("event_id", F.when(good, kind).otherwise("failed").alias("kind"), "message_id", F.when(good, error).otherwise("bad_payload").alias("error"))


def marked(rows: DataFrame, transitions: DataFrame, now: Column, most: int = outbox.MOST_ATTEMPTS) -> DataFrame:
    """The outbox after one transition of each event at most. The `most`-th failure makes a dead letter; before it, what a
    relay failed on waits again and what a consumer failed on stays published."""
    t = transitions.select("event_id", F.col("kind").alias("_kind"), F.col("message_id").alias("_message"), F.col("error").alias("_error"))
    fails = F.col("_kind").isin("failed", "consume_failed")
    n = F.col("attempts") + F.when(fails, 1).otherwise(0)
    status = F.when(fails & (n >= most), "dead_letter").when(F.col("_kind") == "failed", "pending").when(F.col("_kind") == "consume_failed", "published").otherwise(F.coalesce("_kind", "status"))
    out = rows.join(t, "event_id", "left").withColumns({"status": status, "attempts": n.cast("int"), "message_id": F.coalesce("_message", "message_id"), "error": F.when(F.col("_kind").isNotNull(), F.col("_error")).otherwise(F.col("error")), "updated_at": F.when(F.col("_kind").isNotNull(), now).otherwise(F.col("updated_at"))})
    return out.select(*rows.columns)


def lookup(rows: DataFrame, event_id: str | None = None, message_id: str | None = None) -> DataFrame:
    """The outbox row of an event or of a message."""
    return rows.where(F.col("event_id") == event_id) if event_id is not None else rows.where(F.col("message_id") == message_id)


def sync_once(store, apply: Apply, now: Column, batch: int = outbox.BATCH, strict: bool = False, stale: int = outbox.STALE_SECONDS) -> dict[str, int]:
    """One turn of the worker over the store's outbox: requeue what was published long ago, relay, consume. If strict, a
    failed relay is an error. Each step's outbox is a new version of the table, so a turn that breaks off is taken up."""
    rows = store.load("outbox")
    if rows is None:
        return {"published": 0, "failed": 0, "acked": 0}
    store.save("outbox", outbox.requeue_stale(rows, now, stale))
    rows = store.load("outbox")
    store.save("transitions", relayed(rows, batch))
    moved = store.load("transitions")
    found = {r["kind"]: r["count"] for r in moved.groupBy("kind").count().collect()}
    store.save("outbox", marked(rows, moved, now))
    if strict and found.get("failed"):
        raise RuntimeError(f"{found['failed']} events could not be relayed")
    rows = store.load("outbox")
    messages = rows.join(moved.where("kind = 'published'").select("event_id"), "event_id", "left_semi").select("event_id", "message_id", "payload")
    store.save("transitions", consumed(messages, apply))
    done = store.load("transitions")
    acked = done.where("kind = 'acked'").count()
    store.save("outbox", marked(rows, done, now))
    return {"published": found.get("published", 0), "failed": found.get("failed", 0), "acked": acked}
