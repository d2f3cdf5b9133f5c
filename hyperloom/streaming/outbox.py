"""Graph sync as a log of transitions: pending, published, acked, dead letter.

The log is append-only; the state of an event is a fold over its transitions, so every step may be replayed. The
streaming parts are at least once with idempotent writes: each micro-batch owns a folder that a replay overwrites.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from hyperloom import schema
from hyperloom.sources.scratch import freed

MOST_ATTEMPTS, BATCH, STALE_SECONDS = 5, 50, 300


def state(log: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """event_id, status, attempts, created_at, updated_at of a log (event_id, seq, at, kind).

    kind: enqueued, published, acked, failed, consume_failed, requeued. Attempts are the failures since the last requeue;
    a failure that makes them `most` leaves a dead letter, another one waits again or, if a consumer's, stays published."""
    by = Window.partitionBy("event_id").orderBy("seq")
    later = by.rowsBetween(1, Window.unboundedFollowing)
    rows = log.withColumn("requeues", F.coalesce(F.count_if(F.col("kind") == "requeued").over(later), F.lit(0)))
    folded = rows.groupBy("event_id").agg(F.count_if(F.col("kind").isin("failed", "consume_failed") & (F.col("requeues") == 0)).alias("attempts"), F.max_by("kind", "seq").alias("kind"), F.min("at").alias("created_at"), F.max("at").alias("updated_at"))
    status = F.when(F.col("kind").isin("enqueued", "requeued"), "pending").when(F.col("kind").isin("published", "acked"), F.col("kind")).when(F.col("attempts") >= most, "dead_letter").when(F.col("kind") == "consume_failed", "published").otherwise("pending")
    return folded.select("event_id", status.alias("status"), "attempts", "created_at", "updated_at")


def enqueue(outbox: DataFrame, new: DataFrame) -> DataFrame:
    """new events that aren't there yet, once each."""
    return new.dropDuplicates(["event_id"]).join(outbox.select("event_id"), "event_id", "left_anti")


def pending(outbox: DataFrame, most: int = BATCH) -> DataFrame:
    """First in, first out."""
    return outbox.where("status = 'pending'").orderBy("created_at", "event_id").limit(most)


def failed_once_more(outbox: DataFrame, most: int = MOST_ATTEMPTS, keep: str = "pending") -> DataFrame:
    """After a failure: one more attempt, and a dead letter at `most`; a relay's rows wait, a consumer's stay published."""
    n = F.col("attempts") + 1
    return outbox.withColumns({"attempts": n, "status": F.when(n >= most, "dead_letter").otherwise(keep)})


def requeue_stale(outbox: DataFrame, now: Column, seconds: int = STALE_SECONDS) -> DataFrame:
    old = (F.col("status") == "published") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(seconds)))
    return outbox.withColumn("status", F.when(old, "pending").otherwise(F.col("status")))


def requeue_dead(outbox: DataFrame) -> DataFrame:
    dead = F.col("status") == "dead_letter"
    return outbox.withColumns({"attempts": F.when(dead, 0).otherwise(F.col("attempts")), "status": F.when(dead, "pending").otherwise(F.col("status"))})


def metrics(outbox: DataFrame, now: Column) -> DataFrame:
    """status, events, oldest_seconds for every status, zeros included."""
    known = outbox.sparkSession.createDataFrame([(s,) for s in schema.OUTBOX_STATUSES], "status string")
    counted = outbox.groupBy("status").agg(F.count("*").alias("events"), F.min("created_at").alias("oldest"))
    return known.join(counted, "status", "left").select("status", F.coalesce("events", F.lit(0)).alias("events"), (F.unix_timestamp(now) - F.unix_timestamp("oldest")).alias("oldest_seconds"))


def orphans(experiments: DataFrame, outbox: DataFrame) -> DataFrame:
    """Experiments without an event that is under way or done."""
    return experiments.join(outbox.where("status <> 'dead_letter'").select(F.col("event_id").alias("id")), "id", "left_anti")


def lag(outbox: DataFrame, ids: DataFrame) -> DataFrame:
    own = outbox.join(ids, outbox["event_id"] == ids["id"], "left_semi")
    return own.agg(F.count_if(F.col("status") == "pending").alias("pending"), F.count_if(F.col("status") == "published").alias("published")).withColumn("has_lag", F.col("pending") + F.col("published") > 0)


# --- events ------------------------------------------------------------------------------------------------------------


def encode(experiments: DataFrame, source: str = "api") -> DataFrame:
    """event_id and payload of each experiment; the id is a digest of it, so a repeat is the same event."""
    payload = F.to_json(F.struct(F.lit("experiment_upsert").alias("event_type"), F.col("id").alias("experiment_id"), F.lit(1).alias("payload_version"), F.lit(source).alias("source"), F.struct(*experiments.columns).alias("experiment")))
    return experiments.select(F.sha2(payload.cast("binary"), 256).alias("event_id"), payload.alias("payload"))


def decode(messages: DataFrame, payload: str = "payload", version: int = 1) -> DataFrame:
    """messages with `event`, null for what isn't a payload of this version (poison: to be marked failed and acked)."""
    event = F.from_json(payload, f"event_type string, experiment_id string, payload_version int, source string, experiment struct<{_nested(schema.EXPERIMENT)}>")
    return messages.withColumn("_e", event).withColumn("event", F.when((F.col("_e.payload_version") == version) & F.col("_e.experiment_id").isNotNull(), F.col("_e"))).drop("_e")


def _nested(ddl: str) -> str:
    """A table's columns as a struct's fields."""
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in _parse(ddl).fields)


def _parse(ddl: str):
    from pyspark.sql.types import StructType

    return StructType.fromDDL(ddl)


def deduplicated(stream: DataFrame, at: str = "at", delay: str = "10 minutes") -> DataFrame:
    """A stream's events once each, as long as repeats come within the delay."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark(["event_id"])


def attempts(stream: DataFrame, most: int = MOST_ATTEMPTS) -> DataFrame:
    """The same fold as `state`, kept for each event across micro-batches: (event_id, seq, kind) in, states out."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], kept: GroupState) -> Iterator[pd.DataFrame]:
        status, n = kept.get if kept.exists else ("pending", 0)
        for kind in pd.concat(list(batches)).sort_values("seq")["kind"]:
            if kind in ("failed", "consume_failed"):
                n += 1
                status = "dead_letter" if n >= most else "pending" if kind == "failed" else "published"
            elif kind == "requeued":
                status, n = "pending", 0
            else:
                status = "pending" if kind == "enqueued" else kind
        kept.update((status, n))
        yield pd.DataFrame({"event_id": [key[0]], "status": [status], "attempts": [n]})

    return stream.groupBy("event_id").applyInPandasWithState(step, "event_id string, status string, attempts long", "status string, attempts long", "update", GroupStateTimeout.NoTimeout)


def run_to_end(stream: DataFrame, folder: str, mode: str = "append", then: Callable[[DataFrame, int], None] | None = None) -> DataFrame:
    """Runs all that the source has now and returns what was written, with `batch`. A replayed batch overwrites its own
    folder. Give the query a folder that all executors share; checkpoints live beside the results."""

    def write(rows: DataFrame, batch: int) -> None:
        with freed(rows.sparkSession):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/rows/batch={batch}")
        if then:
            then(rows, batch)

    query = stream.writeStream.foreachBatch(write).outputMode(mode).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.read.parquet(f"{folder}/rows")


def newest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of update-mode results: each key's row of the last batch that has one."""
    rest = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(*keys, "_r.*")
