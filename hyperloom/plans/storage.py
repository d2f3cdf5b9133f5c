"""Queries of sources and sinks: rows go out to the shared folder, come back and are counted."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.operators import graph, ingest
from hyperloom.plans.adapter import LINES_SQL, as_experiments, experiments, lines, table
from hyperloom.plans.registry import query
from hyperloom.plans.stream import shared_folder
from hyperloom.sources import readers
from hyperloom.sources.graph_store import GraphStore
from hyperloom.sources.scratch import freed, written
from hyperloom.sources.store import Store

X = f"WITH {LINES_SQL}"


def _store(spark: SparkSession) -> Store:
    return Store(spark, shared_folder(spark, "store"))


@query("""SELECT user_id AS id, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY user_id""")
def snapshot_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two loads of a table, the second over the first, by way of a store."""
    store = _store(spark)
    last = lambda rows: rows.groupBy(F.col("user_id").alias("id")).agg(F.max("event_id").alias("event_id"), F.max_by("value", "event_id").alias("value"))
    events = table(spark, sf_dir, "events")
    half = events.agg(F.percentile_approx("event_id", 0.5)).first()[0]
    store.upsert("latest", last(events.where(F.col("event_id") <= half)))
    store.upsert("latest", last(events.where(F.col("event_id") > half)))
    return store.load("latest")


@query(f"""{X} SELECT geography, count(*) AS experiments, CAST(sum(8) AS BIGINT) AS entities, CAST(sum(2) AS BIGINT) AS relations, round(avg(confidence), 9) AS confidence FROM x GROUP BY geography""")
def json_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments written as JSON lines and read by the model's schema; a null geography or confidence has its default."""
    folder = shared_folder(spark, "json")
    with freed(spark):
        experiments(spark, sf_dir).write.option("compression", "gzip").json(folder)
    back = readers.read_experiments(spark, folder)
    size = F.size("input_entities") + F.size("process_entities") + F.size("output_entities")
    return back.groupBy("geography").agg(F.count("*").alias("experiments"), F.sum(size).alias("entities"), F.sum(F.size("relations")).alias("relations"), F.round(F.avg("confidence"), 9).alias("confidence"))


@query("""SELECT CAST(conv_id AS VARCHAR) || '-' || turn AS id, CASE WHEN turn % 3 = 0 THEN 'Global' ELSE 'RU' END AS geography, CASE WHEN turn % 2 = 0 THEN 0.5e0 END AS min_recall, turn AS expected FROM conversations WHERE turn > 0 AND turn % 4 <> 3""")
def golden_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Golden questions out to JSON lines with blank ones between, back, and those that retrieval is measured by."""
    from hyperloom.operators import evaluate

    folder, turn = shared_folder(spark, "golden"), F.col("turn")
    rows = table(spark, sf_dir, "conversations").select(
        F.concat_ws("-", F.col("conv_id").cast("string"), turn.cast("string")).alias("id"), F.col("text").alias("query"), F.when(turn % 4 == 3, "e2e_only").otherwise("full").alias("eval_mode"),
        F.transform(F.slice(F.sequence(F.lit(0), F.lit(50)), F.lit(1), turn.cast("int")), lambda i: F.concat(F.lit("EXP-"), i.cast("string"))).alias("expected_experiment_ids"),
        F.when(turn % 3 == 0, "Global").otherwise("RU").alias("geography"), F.struct(F.when(turn % 2 == 0, 0.5).alias("min_recall_at_5")).alias("success_criteria"),
    )
    rows.select(F.explode(F.array(F.to_json(F.struct(*rows.columns)), F.lit("  "))).alias("value")).write.text(folder)
    asked = evaluate.asked(readers.read_golden(spark, folder))
    return asked.select("id", "geography", F.col("success_criteria.min_recall_at_5").alias("min_recall"), F.size("expected_experiment_ids").cast("long").alias("expected"))


@query("""SELECT event_type AS action, count(*) AS entries FROM (SELECT DISTINCT ts, event_type FROM events) GROUP BY 1""")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit entries appended twice and read back once each."""
    store = _store(spark)
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    entries = table(spark, sf_dir, "events").select(at.alias("timestamp"), F.col("user_id").cast("string").alias("username"), F.lit("Analyst").alias("role"), F.col("event_type").alias("action"), F.lit("").alias("details"))
    store.append_entries(entries)
    store.append_entries(entries)
    return store.audit().groupBy("action").agg(F.count("*").alias("entries"))


@query(f"""{X}, e AS (SELECT material, facility, process, expert FROM x),
 n AS (SELECT 'Experiment' AS name, count(*) AS n FROM x UNION ALL SELECT 'Material', count(DISTINCT lower(material)) FROM x UNION ALL SELECT 'Facility', count(DISTINCT lower(facility)) FROM x UNION ALL SELECT 'Process', count(DISTINCT lower(process)) FROM x
  UNION ALL SELECT 'Equipment', count(DISTINCT floor(size / 10)) FROM x UNION ALL SELECT 'Publication', count(DISTINCT evidence) FROM x
  UNION ALL SELECT 'Property', count(*) FROM (SELECT 'quantity: ' || quantity FROM x UNION SELECT 'discount: ' || discount FROM x UNION SELECT 'price: ' || price FROM x UNION SELECT 'tax: ' || tax FROM x)
  UNION ALL SELECT 'Expert', count(DISTINCT lower(c_name)) FROM customer),
 g AS (SELECT 'HAS_INPUT' AS name, count(*) * 4 AS n FROM x UNION ALL SELECT 'HAS_PROCESS', count(*) * 2 FROM x UNION ALL SELECT 'HAS_OUTPUT', count(*) * 2 FROM x UNION ALL SELECT 'EVIDENCE_FROM', count(*) FROM x
  UNION ALL SELECT 'USES_MATERIAL', count(*) FROM (SELECT DISTINCT lower(process), lower(material) FROM x) UNION ALL SELECT 'LOCATED_AT', count(*) FROM (SELECT DISTINCT lower(process), lower(facility) FROM x))
 SELECT 'node' AS kind, name, CAST(n AS BIGINT) AS n FROM n UNION ALL SELECT 'edge', name, CAST(n AS BIGINT) FROM g""")
def graph_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Experiments merged into a stored graph, a third of them twice, and a vocabulary with types that are none."""
    store = GraphStore(_store(spark))
    rows = written(experiments(spark, sf_dir))  # read by every part of both inserts
    store.insert(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) < 2))
    store.insert(rows.where(F.pmod(F.xxhash64("id"), F.lit(3)) > 0))
    entity = lambda kind, value: F.struct(F.lit(kind).alias("type"), value.alias("value"))
    names = table(spark, sf_dir, "customer").select(F.explode(F.array(entity("Expert", F.col("c_name")), entity("Ghost", F.col("c_name")), entity("Expert", F.lit(" ")))).alias("e"))
    store.insert_ontology(names.select("e.*"))
    store.check_unique()
    return graph.counts(store.nodes(), store.edges())


@query("""SELECT count(*) AS given, (SELECT count(*) FROM (SELECT DISTINCT lower(n_name) FROM nation)) AS nodes, CAST(0 AS BIGINT) AS left_over FROM nation""")
def graph_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A vocabulary merged into the graph, and the graph emptied."""
    store = GraphStore(_store(spark))
    own = table(spark, sf_dir, "nation").select(F.lit("Facility").alias("type"), F.col("n_name").alias("value"))
    given = store.insert_ontology(own)
    nodes, _ = store.clear()
    left = store.nodes().agg(F.count("*").alias("left_over"))
    return left.select(F.lit(given).cast("long").alias("given"), F.lit(nodes).cast("long").alias("nodes"), "left_over")


@query("""SELECT type, count(*) AS n FROM (SELECT DISTINCT 'Facility' AS type, n_name AS value FROM nation UNION SELECT DISTINCT 'Material', p_brand FROM part) GROUP BY type""")
def ontology(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A static vocabulary as entities; blank values are dropped."""
    values = lambda kind, t, c: table(spark, sf_dir, t).select(F.lit(kind).alias("type"), F.explode(F.array(F.col(c), F.lit(" "), F.lit(""))).alias("value"))
    return readers.read_ontology(spark, values("Facility", "nation", "n_name").unionByName(values("Material", "part", "p_brand"))).groupBy("type").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN user_id % 4 = 0 THEN 'validation_failed' WHEN user_id % 4 = 1 THEN 'empty' WHEN user_id % 4 = 2 THEN 'ok' ELSE 'moderation' END AS status, count(*) AS chunks FROM events GROUP BY 1
 UNION ALL SELECT unnest(['skipped', 'restored', 'graph_sync_failed', 'graph_sync_deferred']), 0""")
def ingestion_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome counts of chunks as a report that is written and read."""
    store, k = _store(spark), F.col("user_id") % 4
    outcomes = table(spark, sf_dir, "events").select(F.when(k == 0, "validation_failed").when(k == 1, "empty").when(k == 2, "ok").otherwise("moderation").alias("status"))
    store.report("ingestion", ingest.outcome_counts(outcomes))
    return store.read_report("ingestion").select("status", "chunks")


@query("""SELECT '- **' || name || ':** ' || n AS line FROM (SELECT 'errors' AS name, count(*) FILTER (event_type = 'error') AS n FROM events UNION ALL SELECT 'questions', count(*) FROM events)
 UNION ALL SELECT '- `' || event_id || '` error: [REDACTED]' FROM (SELECT event_id FROM events WHERE event_type = 'error') UNION ALL SELECT unnest(['# Run r1', '', '## Metrics', '', '## Failed or skipped'])""")
def run_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a run's report as a reader sees them."""
    from hyperloom.functions import text

    store, events = _store(spark), table(spark, sf_dir, "events")
    summary = events.agg(F.count("*").alias("questions"), F.count_if(F.col("event_type") == "error").alias("errors"))
    failed = events.where("event_type = 'error'").select(F.col("event_id").cast("string").alias("id"), F.col("event_type").alias("status"), text.redact(F.lit("sk-abcdefghijklmnopqrstuvwxyz")).alias("reason"))
    return spark.read.text(store.run_report("r1", summary, failed)).select(F.col("value").alias("line"))


@query(f"""{X} SELECT 'L0' AS stage, count(*) AS rows FROM x UNION ALL SELECT 'L1', count(*) FROM x WHERE NOT is_sensitive""")
def stored_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _store(spark)
    rows = lines(spark, sf_dir).select(F.col("material").alias("question"), F.col("quantity").alias("pos"), "is_sensitive", F.lit("{}").alias("payload"))
    layers = rows.select("question", F.lit("L0").alias("stage"), "pos", "payload").unionByName(rows.where("not is_sensitive").select("question", F.lit("L1").alias("stage"), "pos", "payload"))
    store.save_layers("r1", layers)
    return store.load_layers("r1").groupBy("stage").agg(F.count("*").alias("rows"))


@query(f"""{X} SELECT count(*) AS total, CAST(sum(7 + CASE WHEN 'quantity: ' || quantity = 'discount: ' || discount THEN 0 ELSE 1 END) AS BIGINT) AS planned_entities, count(*) * 2 AS planned_relations FROM x""")
def backfill_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return graph.backfill_plan(as_experiments(lines(spark, sf_dir)))


@query("""SELECT source AS filename, count(*) AS chunks, count(*) FILTER (l.doc_id IS NULL) AS new FROM documents d LEFT JOIN (SELECT doc_id FROM labels WHERE quality = 1) l USING (doc_id) GROUP BY source HAVING count(*) FILTER (l.doc_id IS NULL) > 0""")
def files_with_news(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of documents that have chunks not known yet."""
    id_ = F.col("doc_id").cast("string").alias("id")
    return ingest.files_with_news(table(spark, sf_dir, "documents").select(id_, F.col("source").alias("filename")), table(spark, sf_dir, "labels").where("quality = 1").select(id_))
