"""What is kept: versioned Parquet snapshots behind a pointer, tables merged by buckets, logs in parts, audit, reports."""

from __future__ import annotations

import json
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators.ingest import upsert
from hyperloom.sources.scratch import freed


#: Parts by hash of the key that a merged table is kept in; one that is rewritten when any of its keys changes.
BUCKETS = 64
#: Rows, old and new ones, that a merge shuffles at a time, more or less; it takes its buckets in several passes beyond that.
MERGED_TOGETHER = 40_000_000
Combine = Callable[[DataFrame | None, DataFrame], DataFrame]


class Store:
    """Tables below one folder that all executors reach. A save writes a new version and then adds it to the table's
    list, so readers see a whole version or the one before.

    A merged table lies in buckets by a hash of its key. A merge writes the buckets that its keys touch and lists, for
    every bucket, the version that holds it: the files of the others stay as they are and are read from where they lie."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    def _versions(self, name: str) -> list[dict]:
        """Each version's entry, in order: its name, and of a merged table where its buckets lie."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/versions")
        if not path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(path):
            return []
        lines = [r[0] for r in self.spark.read.text(f"{self.root}/{name}/versions").collect()]
        return sorted((json.loads(x) if x.startswith("{") else {"version": x} for x in lines), key=lambda e: e["version"])

    def _list(self, name: str, entry: str) -> None:
        self.spark.range(1).select(F.lit(entry)).coalesce(1).write.mode("append").text(f"{self.root}/{name}/versions")

    def save(self, name: str, df: DataFrame) -> str:
        version = f"v{time.time_ns():020d}"
        self._write(df, f"{self.root}/{name}/{version}")
        self._list(name, version)
        return version

    def _write(self, df: DataFrame, path: str, *by: str) -> None:
        with freed(self.spark):
            out = df.write.mode("append").option("compression", "zstd")
            (out.partitionBy(*by) if by else out).parquet(path)

    def _read(self, name: str, entry: dict, buckets: list[int] | None = None) -> DataFrame | None:
        """A version's rows, or those of some of its buckets; None if it has none of them."""
        if "at" not in entry:
            return self.spark.read.parquet(f"{self.root}/{name}/{entry['version']}")
        own = [(b, v) for b, v in entry["at"].items() if buckets is None or int(b) in buckets]
        return self.spark.read.parquet(*(f"{self.root}/{name}/{v}/_bucket={b}" for b, v in own)) if own else None

    def load(self, name: str, version: str | None = None) -> DataFrame | None:
        """The newest version, None if there is none."""
        entries = [e for e in self._versions(name) if version is None or e["version"] == version]
        return self._read(name, entries[-1]) if entries else None

    def merge(self, name: str, new: DataFrame, keys: list[str], combine: Combine) -> str:
        """combine(old, new) in place of the old rows of the buckets that the new rows' keys fall in. Rows of one key must
        come together in what `combine` does; a null key has a bucket like any other."""
        entries = self._versions(name)
        last = entries[-1] if entries else None
        n = last["buckets"] if last and "at" in last else self.buckets
        key = [F.col(k).cast("string") for k in keys]  # the same whatever whole number's type a key comes in
        placed = lambda df: df.withColumn("_bucket", F.pmod(F.xxhash64(*key), F.lit(n)).cast("int"))
        version = f"v{time.time_ns():020d}"
        new = self._staged(name, version, new)  # read twice below, made once
        if last and "at" not in last:  # saved whole before: every bucket is written once
            touched, old = list(range(n)), self._read(name, last)
        else:
            touched = [r[0] for r in placed(new).select("_bucket").distinct().collect()]  # n numbers at most
            old = self._read(name, last, touched) if last else None
        if not touched:
            return last["version"] if last else self.save(name, new)
        rows = new.count() + (0 if old is None else old.count())
        passes = min(len(touched), -(-rows // MERGED_TOGETHER))  # what is shuffled at a time is bounded
        for group in (sorted(touched)[i::passes] for i in range(passes)):
            spread = max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")) // len(group))  # large buckets have several files
            own = old if old is None or passes == 1 else self._read(name, last, group) if "at" in last else placed(old).where(F.col("_bucket").isin(group)).drop("_bucket")
            given = new if passes == 1 else placed(new).where(F.col("_bucket").isin(group)).drop("_bucket")
            merged = placed(combine(own, given)).repartition("_bucket", F.pmod(F.xxhash64(*key, F.lit("file")), F.lit(spread)))
            self._write(merged, f"{self.root}/{name}/{version}", "_bucket")
        held = self._held(f"{self.root}/{name}/{version}")
        at = {b: v for b, v in (last or {}).get("at", {}).items() if int(b) not in touched} | {str(b): version for b in held}
        self._list(name, json.dumps({"version": version, "buckets": n, "at": at}))
        staged = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}/staged/{version}")
        staged.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(staged, True)
        return version

    def _staged(self, name: str, version: str, new: DataFrame) -> DataFrame:
        path = f"{self.root}/{name}/staged/{version}"
        self._write(new, path)
        return self.spark.read.schema(new.schema).parquet(path)

    def _held(self, folder: str) -> list[int]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        names = (f.getPath().getName() for f in path.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(path))
        return sorted(int(x.partition("=")[2]) for x in names if x.startswith("_bucket="))

    def upsert(self, name: str, new: DataFrame, key: str = "id") -> str:
        return self.merge(name, new, [key], lambda old, rows: rows if old is None else upsert(old, rows, key))

    def appended(self, name: str, df: DataFrame, part: str) -> None:
        """Rows added to a log as a part of its own, which a repeated call with the same name replaces."""
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/part={part}")

    def log(self, name: str, parts: list[str] | None = None) -> DataFrame | None:
        """All parts of a log, or some; None if there are none."""
        folder, known = f"{self.root}/{name}", self.log_parts(name)
        own = [p for p in known if parts is None or p in parts]
        return self.spark.read.option("basePath", folder).parquet(*(f"{folder}/part={p}" for p in own)).drop("part") if own else None

    def log_parts(self, name: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(f.getPath().getName().removeprefix("part=") for f in files.listStatus(path) if f.getPath().getName().startswith("part=")) if files.exists(path) else []

    def append_audit(self, username: str, role: str, action: str, details: str) -> None:
        now = F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss.SSS")  # UTC
        entry = self.spark.range(1).select(now.alias("timestamp"), F.lit(username).alias("username"), F.lit(role).alias("role"), F.lit(action).alias("action"), F.lit(details).alias("details"))
        entry.coalesce(1).write.mode("append").json(f"{self.root}/audit")

    def audit(self) -> DataFrame:
        """Entries once for each timestamp and action, newest first."""
        from hyperloom.sources.readers import read_audit

        return read_audit(self.spark, f"{self.root}/audit").dropDuplicates(["timestamp", "action"]).orderBy(F.desc("timestamp"))

    def append_entries(self, entries: DataFrame) -> None:
        """Many audit entries (timestamp, username, role, action, details) at once."""
        entries.select("timestamp", "username", "role", "action", "details").write.mode("append").json(f"{self.root}/audit")

    def report(self, name: str, df: DataFrame) -> None:
        """A report's few rows as one JSON file."""
        df.coalesce(1).write.mode("overwrite").json(f"{self.root}/reports/{name}")

    def read_report(self, name: str) -> DataFrame:
        return self.spark.read.json(f"{self.root}/reports/{name}")

    def run_report(self, run: str, summary: DataFrame, failures: DataFrame) -> str:
        """A run's summary and the questions it lists, as JSON, and both as a text to read, whose path is returned."""
        self.report(f"{run}/summary", summary)
        self.report(f"{run}/failures", failures)
        names = self.spark.createDataFrame([(c,) for c in sorted(summary.columns)], "name string")
        values = summary.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, summary.columns)), F.array(*(F.coalesce(F.col(c).cast("string"), F.lit("-")) for c in summary.columns)))).alias("name", "value"))
        head = self.spark.createDataFrame([(0, f"# Run {run}"), (1, ""), (2, "## Metrics"), (4, ""), (5, "## Failed or skipped")], "part int, line string")
        metrics = names.join(values, "name").select(F.lit(3).alias("part"), F.concat(F.lit("- **"), "name", F.lit(":** "), "value").alias("line"))
        listed = failures.select(F.lit(6).alias("part"), F.concat(F.lit("- `"), "id", F.lit("` "), "status", F.lit(": "), "reason").alias("line"))
        path = f"{self.root}/reports/{run}/summary.md"
        head.unionByName(metrics).unionByName(listed).orderBy("part", "line").coalesce(1).select("line").write.mode("overwrite").text(path)
        return path

    def save_layers(self, run: str, layers: DataFrame) -> None:
        """What each layer of a run gave, one folder for each stage."""
        layers.write.mode("overwrite").partitionBy("stage").parquet(f"{self.root}/layers/{run}")

    def load_layers(self, run: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/layers/{run}")
