"""The worker between outbox and graph, on a log: a turn reads states and appends its own transitions.

Three tables in a Store: `outbox_events` (event_id, payload, created_at) and `outbox_log` (event_id, seq, at, kind,
message_id, error) are logs in parts, one for each turn's step, that nobody changes; `outbox_state` is a snapshot of the
states up to a turn. A state is the snapshot's row folded over the transitions since. Compaction folds them into a new
snapshot, so a turn reads no more of the log than was written since. What a turn writes is as large as its batch, however
many events there are. Parts are named by turn and step: a turn that is repeated after a breakdown replaces its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom.streaming import outbox, relay

STATE = "event_id string, status string, attempts int, message_id string, error string, created_at timestamp, updated_at timestamp, seq long"
LOG = "event_id string, seq long, at timestamp, kind string, message_id string, error string"
COMPACT_EVERY = 20
#: Steps of a turn; they order the transitions of an event within it.
STEPS = ("enqueue", "stale", "relay", "consume", "dead")


def folded(snapshot: DataFrame, log: DataFrame, most: int = outbox.MOST_ATTEMPTS) -> DataFrame:
    """States after the transitions of a log, one aggregate for each event: a failure counts, the `most`-th makes a dead
    letter; what a relay failed on waits again, what a consumer failed on stays published; `stale` waits again with its
    attempts, `requeued` without."""
    own = F.sort_array(F.collect_list(F.struct("seq", "kind", "at", "message_id", "error")))
    steps = log.groupBy("event_id").agg(own.alias("steps"))
    base = F.struct(F.coalesce("status", F.lit("pending")).alias("status"), F.coalesce("attempts", F.lit(0)).alias("attempts"), "message_id", "error", F.coalesce("created_at", F.get("steps", F.lit(0))["at"]).alias("created_at"), "updated_at", F.coalesce("seq", F.lit(-1).cast("long")).alias("seq"))

    def step(s: Column, t: Column) -> Column:
        fails = t["kind"].isin("failed", "consume_failed")
        n = F.when(t["kind"] == "requeued", 0).otherwise(s["attempts"] + fails.cast("int"))
        status = F.when(fails & (n >= most), "dead_letter").when(t["kind"].isin("enqueued", "requeued", "stale", "failed"), "pending").when(t["kind"] == "consume_failed", "published").otherwise(t["kind"])
        # A transition that the snapshot has seen already changes nothing.
        return F.when(t["seq"] <= s["seq"], s).otherwise(F.struct(status.alias("status"), n.alias("attempts"), F.coalesce(t["message_id"], s["message_id"]).alias("message_id"), t["error"].alias("error"), s["created_at"].alias("created_at"), t["at"].alias("updated_at"), t["seq"].alias("seq")))

    joined = snapshot.join(steps, "event_id", "full")
    none = F.array().cast("array<struct<seq:bigint,kind:string,at:timestamp,message_id:string,error:string>>")
    return joined.select("event_id", F.aggregate(F.coalesce("steps", none), base, step).alias("s")).select("event_id", "s.*")


class Worker:
    def __init__(self, store, apply: relay.Apply, batch: int = outbox.BATCH, most: int = outbox.MOST_ATTEMPTS, stale: int = outbox.STALE_SECONDS, compact_every: int = COMPACT_EVERY):
        self.store, self.apply, self.batch, self.most, self.stale, self.compact_every = store, apply, batch, most, stale, compact_every

    # --- the log ---------------------------------------------------------------------------------------------------

    def _turns(self) -> list[int]:
        return sorted({int(p.partition("-")[0]) for p in self.store.log_parts("outbox_log")})

    def next_turn(self) -> int:
        return max([*self._turns(), self._through()], default=-1) + 1

    def _through(self) -> int:
        """The last turn that the snapshot holds."""
        found = self.store.load("outbox_through")
        return found.first()[0] if found is not None else -1

    def _append(self, turn: int, step: str, moved: DataFrame, now: Column) -> None:
        """Transitions (event_id, kind, message_id, error) of a step."""
        seq = F.lit(turn * len(STEPS) + STEPS.index(step)).cast("long")
        self.store.appended("outbox_log", moved.select("event_id", seq.alias("seq"), now.alias("at"), "kind", F.col("message_id").cast("string").alias("message_id"), F.col("error").cast("string").alias("error")), f"{turn:012d}-{step}")

    def state(self) -> DataFrame:
        """Every event's status, without payloads."""
        spark, through = self.store.spark, self._through()
        snapshot = self.store.load("outbox_state") if through >= 0 else None
        since = [p for p in self.store.log_parts("outbox_log") if int(p.partition("-")[0]) > through]
        log = self.store.log("outbox_log", since) if since else None
        return folded(spark.createDataFrame([], STATE) if snapshot is None else snapshot, spark.createDataFrame([], LOG) if log is None else log, self.most)

    def compact(self) -> None:
        """A new snapshot of the states; then only later transitions are read. A breakdown between its two steps leaves the
        older `through`, and transitions that the snapshot has are passed over."""
        turns = self._turns()
        if turns:
            self.store.save("outbox_state", self.state())
            self.store.save("outbox_through", self.store.spark.range(1).select(F.lit(turns[-1]).alias("turn")))

    # --- steps -----------------------------------------------------------------------------------------------------

    def enqueue(self, experiments: DataFrame, now: Column, source: str = "api") -> None:
        """Events of experiments, each once; those that are known already are left out."""
        turn = self.next_turn()
        new = outbox.encode(experiments, source).dropDuplicates(["event_id"]).join(self.state().select("event_id"), "event_id", "left_anti")
        self._enqueue(turn, new, now)

    def enqueue_payloads(self, events: DataFrame, now: Column) -> None:
        """Events (event_id, payload) as they are."""
        turn = self.next_turn()
        self._enqueue(turn, events.select("event_id", "payload").dropDuplicates(["event_id"]).join(self.state().select("event_id"), "event_id", "left_anti"), now)

    def _enqueue(self, turn: int, new: DataFrame, now: Column) -> None:
        self.store.appended("outbox_events", new, f"{turn:012d}")
        stored = self.store.log("outbox_events", [f"{turn:012d}"])
        seq = F.lit(turn * len(STEPS)).cast("long")
        none = F.lit(None).cast("string")
        self.store.appended("outbox_log", stored.select("event_id", seq.alias("seq"), now.alias("at"), F.lit("enqueued").alias("kind"), none.alias("message_id"), none.alias("error")), f"{turn:012d}-enqueue")

    def _moved(self, turn: int, step: str) -> DataFrame:
        return self.store.log("outbox_log", [f"{turn:012d}-{step}"])

    def turn(self, now: Column, strict: bool = False) -> dict[str, int]:
        """Requeue what was published long ago, relay the oldest pending events, consume what was relayed. If strict, a failed
        relay is an error. How many events were published, failed and acked."""
        turn, none = self.next_turn(), F.lit(None).cast("string")
        state = self.state()
        old = (F.col("status") == "published") & (F.col("updated_at") < now - F.make_dt_interval(secs=F.lit(self.stale)))
        self._append(turn, "stale", state.where(old).select("event_id", F.lit("stale").alias("kind"), none.alias("message_id"), none.alias("error")), now)
        picked = outbox.pending(self.state().select("event_id", "status", "created_at"), self.batch).select("event_id")
        self.store.appended("outbox_batch", picked, f"{turn:012d}")
        batch = F.broadcast(self.store.log("outbox_batch", [f"{turn:012d}"]))  # self.batch ids at most
        events = self.store.log("outbox_events")
        payloads = events.join(batch, "event_id", "left_semi") if events is not None else self.store.spark.createDataFrame([], "event_id string, payload string")
        read, good = outbox.decode(payloads), F.col("event").isNotNull()
        sent = read.select("event_id", F.when(good, "published").otherwise("failed").alias("kind"), F.when(good, F.concat(F.lit("m-"), "event_id")).alias("message_id"), F.when(~good, "bad_payload").alias("error"))
        self._append(turn, "relay", sent, now)
        relayed = self._moved(turn, "relay")
        found = {r["kind"]: r["count"] for r in relayed.groupBy("kind").count().collect()}
        if strict and found.get("failed"):
            raise RuntimeError(f"{found['failed']} events could not be relayed")
        messages = payloads.join(F.broadcast(relayed.where("kind = 'published'").select("event_id", "message_id")), "event_id")
        self._append(turn, "consume", relay.consumed(messages, self.apply), now)
        acked = self._moved(turn, "consume").where("kind = 'acked'").count()
        if turn - self._through() >= self.compact_every:
            self.compact()
        return {"published": found.get("published", 0), "failed": found.get("failed", 0), "acked": acked}

    def requeue_dead(self, now: Column) -> None:
        """Dead letters wait again, with no attempts behind them."""
        none = F.lit(None).cast("string")
        self._append(self.next_turn(), "dead", self.state().where("status = 'dead_letter'").select("event_id", F.lit("requeued").alias("kind"), none.alias("message_id"), none.alias("error")), now)

    def run(self, now: Column, most_turns: int = 1000) -> dict[str, int]:
        """Turns until one finds nothing to do."""
        total = {"published": 0, "failed": 0, "acked": 0}
        for _ in range(most_turns):
            moved = self.turn(now)
            if not any(moved.values()):
                break
            total = {k: total[k] + v for k, v in moved.items()}
        return total
