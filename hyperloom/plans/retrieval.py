"""Queries of a few questions against all experiments: parse, gate, rerank, pages, answers' texts, judges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.functions import text
from hyperloom.operators import answers, counterfactual, entities, evaluate, gaps, graph, search
from hyperloom.plans.adapter import LINES_SQL, as_experiments, experiments, lines, table
from hyperloom.plans.experiments import _BIT, _KEY, _PAIRS_SQL, DIM, _anchor
from hyperloom.plans.registry import query
from hyperloom.sources.scratch import freed, written

X = f"WITH {LINES_SQL}"
POOL = 40
#: The questions' entities; M, P and F stand for the smallest brand, type and nation.
QUESTIONS = {
    "known": [("Material", "M"), ("Process", "P"), ("Facility", "F"), ("Property", "quantity: 17")],
    "unknown place": [("Material", "M"), ("Process", "P"), ("Facility", "nowhere")],
    "generic": [("Material", "руда"), ("Process", "пицца"), ("Facility", "завод")],
    "one word": [("Material", "M")],
    "no domain": [("Expert", "someone"), ("Publication", "a book")],
}


def _asked(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(question, pos, type, value) and (question, material, process, facility), blank where a question names none."""
    names = dict(zip("MPF", _anchor(spark, sf_dir)))
    rows = [(q, i, t, names.get(v, v)) for q, own in QUESTIONS.items() for i, (t, v) in enumerate(own)]
    value = lambda q, kind: next((v for x, _, t, v in rows if x == q and t == kind), "")
    triples = [(q, *(value(q, t) for t in ("Material", "Process", "Facility"))) for q in QUESTIONS]
    return spark.createDataFrame(rows, "question string, pos int, type string, value string"), spark.createDataFrame(triples, "question string, material string, process string, facility string")


_SQL_NAMES = {"M": "qm", "P": "qp", "F": "qf"}
_SQL_VALUE = lambda v: _SQL_NAMES.get(v, f"'{v}'")
_ENTITIES = " UNION ALL ".join(f"SELECT '{q}' AS question, {i} AS pos, '{t}' AS type, {_SQL_VALUE(v)} AS value FROM a" for q, own in QUESTIONS.items() for i, (t, v) in enumerate(own))
_TRIPLES = " UNION ALL ".join("SELECT '{}' AS question, {} AS m, {} AS p, {} AS f FROM a".format(q, *(_SQL_VALUE(next((v for t, v in own if t == kind), "")) for kind in ("Material", "Process", "Facility"))) for q, own in QUESTIONS.items())
_BOUND = lambda kind, c: f"({_BIT(repr(f'Role:{kind}'))}) * ({_BIT(_KEY(kind, c))})"
#: The best hits of each question as h, with the overlap of their keys with the question's.
HITS_SQL = f"""{X}, i AS (SELECT unnest(range({DIM})) AS i), a AS (SELECT (SELECT min(p_brand) FROM part) AS qm, (SELECT min(p_type) FROM part) AS qp, (SELECT min(n_name) FROM nation) AS qf),
asked AS ({_ENTITIES}), triples AS ({_TRIPLES}),
q AS (SELECT question, i, sign({_BOUND('Material', 'm')} + {_BOUND('Process', 'p')} + {_BOUND('Facility', 'f')}) AS q FROM triples, i),
combos AS (SELECT DISTINCT material, process, facility FROM x),
bm AS (SELECT material, i, {_BOUND('Material', 'material')} AS b FROM (SELECT DISTINCT material FROM combos), i),
bp AS (SELECT process, i, {_BOUND('Process', 'process')} AS b FROM (SELECT DISTINCT process FROM combos), i),
bf AS (SELECT facility, i, {_BOUND('Facility', 'facility')} AS b FROM (SELECT DISTINCT facility FROM combos), i),
v AS (SELECT material, process, facility, i, sign(2 * bm.b + 2 * bp.b + bf.b) AS b FROM combos JOIN bm USING (material) JOIN bp USING (process, i) JOIN bf USING (facility, i)),
s AS (SELECT question, material, process, facility, sum(v.b * q.q) / {DIM}e0 AS similarity FROM v JOIN q USING (i) GROUP BY ALL),
keys AS (SELECT question, list(DISTINCT lower(type || ':' || value)) AS keys, list(DISTINCT CASE WHEN type = 'Property' THEN lower(split_part(value, ':', 1)) END) FILTER (type = 'Property') AS names FROM asked GROUP BY question),
top AS (SELECT question, x.*, similarity, row_number() OVER (PARTITION BY question ORDER BY similarity DESC, id) AS rank, count(*) OVER (PARTITION BY question) AS hits FROM x JOIN s USING (material, process, facility) QUALIFY rank <= {POOL}),
h AS (SELECT top.*, len(list_intersect(keys, ['material:' || lower(material), 'facility:' || lower(facility), 'property:quantity: ' || quantity, 'property:discount: ' || discount, 'process:' || lower(process),
  'equipment:band ' || CAST(floor(size / 10) AS INT), 'property:price: ' || price, 'property:tax: ' || tax])) / len(keys) AS overlap,
  coalesce(len(list_intersect(names, ['quantity', 'discount', 'price', 'tax'])) / len(names), 0e0) AS metric FROM top JOIN keys USING (question))"""


def _hits(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the questions' entities, each question's best hits as experiments with rank, hits, similarity and overlap)."""
    asked, triples = _asked(spark, sf_dir)
    best = search.top_hits(lines(spark, sf_dir), triples, POOL, dim=DIM)
    rows = as_experiments(best, "question", "rank", "hits", "similarity")
    keyed = rows.join(F.broadcast(search.query_keys(asked, "question").drop("query_names")), "question")
    return asked, keyed.withColumn("overlap", search.entity_overlap(F.col("query_keys"), search.own_keys())).drop("query_keys")


def _signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return search.scope_signals(asked, schema.GENERIC_VALUES, "question").join(search.confidence_signals(hits, "question"), "question")


_GENERIC = ", ".join(f"'{w}'" for w in schema.GENERIC_VALUES)
_SIGNALS_SQL = f"""{HITS_SQL}, scope AS (SELECT question, count(*) AS n, count(*) FILTER (type IN ('Material', 'Process', 'Equipment', 'Property', 'Facility')) AS domain, count(*) FILTER (lower(value) IN ({_GENERIC})) AS generic, avg(length(value)) AS mean_length FROM asked GROUP BY question),
conf AS (SELECT question, max(similarity) FILTER (rank = 1) AS top1, avg(similarity) FILTER (rank <= 5) AS top5_mean, max(similarity) FILTER (rank = 1) - max(similarity) FILTER (rank = 2) AS margin, max(overlap) FILTER (rank <= 5) AS overlap,
 count(DISTINCT regexp_extract(id, '^([^-]*-[^-]*-[^-]*)', 1)) FILTER (rank <= 5) AS families, any_value(hits) AS hits FROM h GROUP BY question)"""


@query(f"""{_SIGNALS_SQL} SELECT question, n, domain, round(domain / n, 6) AS domain_ratio, generic, round(generic / n, 6) AS generic_ratio, round(mean_length, 6) AS mean_length, round(top1, 6) AS top1, round(top5_mean, 6) AS top5_mean, round(margin, 6) AS margin, round(overlap, 6) AS overlap, families, hits FROM scope JOIN conf USING (question)""")
def gate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = lambda c: F.round(c, 6).alias(c)
    return _signals(spark, sf_dir).select("question", "n", "domain", r("domain_ratio"), "generic", r("generic_ratio"), r("mean_length"), r("top1"), r("top5_mean"), r("margin"), r("overlap"), "families", "hits")


@query(f"""{_SIGNALS_SQL}, r AS (SELECT question, CASE WHEN n = 0 THEN 'no_entities' WHEN domain = 0 OR (n >= 3 AND mean_length < 4) THEN 'weak_parse' WHEN 1 - domain / n >= 0.5 AND hits > 0 AND top1 < 0.12 THEN 'ood_scope'
 WHEN generic >= 1 AND domain / n <= 0.5 AND top1 < 0.15 AND n <= 6 THEN 'ood_scope' WHEN generic / n >= 0.5 AND n <= 4 AND overlap <= 0 THEN 'ood_scope' WHEN hits > 0 AND overlap <= 0 AND top1 < 0.25 THEN 'ood_scope'
 WHEN hits = 0 THEN 'no_hits' WHEN top1 < 0.08 THEN 'low_confidence' WHEN margin < 0.02 AND overlap < 0.05 AND top1 < 0.2 THEN 'low_confidence' WHEN families <= 1 AND top1 < 0.1 AND overlap < 0.2 AND hits >= 3 THEN 'low_confidence'
 WHEN n <= 1 AND top1 >= 0.08 AND top1 < 0.15 AND overlap < 0.2 THEN 'needs_clarification' ELSE '' END AS reason FROM scope JOIN conf USING (question))
 SELECT question, reason, CASE WHEN reason IN ('no_entities', 'weak_parse', 'ood_scope') THEN 'scope' WHEN reason = '' THEN '' ELSE 'confidence' END AS stage, reason <> '' AS should_empty FROM r""")
def gate_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.gate(_signals(spark, sf_dir)).select("question", "reason", "stage", "should_empty")


_RERANK_SQL = f"""{HITS_SQL}, p AS (SELECT *, 0.72e0 * similarity + 0.12e0 * overlap + 0.05e0 * metric + 0.05e0 + 0.03e0 * least(1e0, 0.3e0 + 0.4e0 * confidence + 0.05e0) AS hybrid FROM h)"""


def _reranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked, hits = _hits(spark, sf_dir)
    return search.rerank(hits.drop("overlap"), asked, search.graph_flags(graph.edges(hits), hits), "question")


@query(f"{_RERANK_SQL} SELECT question, id, rank, round(hybrid, 9) AS hybrid, place FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(hybrid, 9) DESC, rank) AS place FROM p) WHERE place <= 5")
def hybrid_rerank(spark: SparkSession, sf_dir: str) -> DataFrame:
    place = F.row_number().over(Window.partitionBy("question").orderBy(F.desc(F.round("hybrid", 9)), "rank"))
    rows = _reranked(spark, sf_dir).withColumn("place", place).where("place <= 5")
    return rows.select("question", "id", F.col("rank").cast("long").alias("rank"), F.round("hybrid", 9).alias("hybrid"), F.col("place").cast("long").alias("place"))


@query(f"{_RERANK_SQL} SELECT question, id, rank, CASE WHEN rank <= 20 THEN 0 ELSE 1 END AS segment, round(CASE WHEN rank <= 20 THEN hybrid ELSE similarity END, 9) AS shown FROM p")
def pool_and_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = search.pool_and_tail(_reranked(spark, sf_dir))
    return rows.select("question", "id", F.col("rank").cast("long").alias("rank"), "segment", F.round("shown", 9).alias("shown"))


# --- parse -----------------------------------------------------------------------------------------------------------

_QUESTION = "Какой выход дает BRAND#11 и economy anodized steel в united kingdom при pH 2.5 и 45 °C: медный шлак, электролит, завод в Brazil"
_WORDS = ", ".join(f"('{a}', '{b}', '{c}')" for a, b, c in text.VOCABULARY)


@query(f"""WITH t AS (SELECT lower('{_QUESTION}') AS t), k AS (SELECT DISTINCT 'Material' AS type, lower(p_brand) AS value FROM part UNION SELECT DISTINCT 'Process', lower(p_type) FROM part UNION SELECT DISTINCT 'Facility', lower(n_name) FROM nation),
 f AS (SELECT type, value, 0 AS source FROM k, t WHERE contains(t, value) OR (length(value) > 4 AND contains(t, left(value, length(value) - 2))) OR (len(string_split(value, ' ')) > 1 AND len(list_filter(string_split(value, ' '), lambda w: length(w) >= 3)) > 0
  AND len(list_filter(list_filter(string_split(value, ' '), lambda w: length(w) >= 3), lambda w: NOT (contains(t, w) OR (length(w) > 4 AND contains(t, left(w, length(w) - 2)))))) = 0)),
 n AS (SELECT 'Property' AS type, upper(regexp_extract(t, '(ph\\s*[:=<>≤≥]?\\s*\\d+([.,]\\d+)?)', 1)) AS value, 1 AS source FROM t UNION ALL SELECT 'Property', 'Температура: ' || upper(regexp_extract(t, '(\\d+\\s*°c)', 1)), 1 FROM t),
 v AS (SELECT v.* FROM (VALUES {_WORDS}) v(term, type, value), t WHERE contains(t, term) OR (length(term) > 4 AND contains(t, left(term, length(term) - 2)))),
 every AS (SELECT * FROM f UNION ALL SELECT * FROM n UNION ALL SELECT type, value, 2 FROM v)
 SELECT type, value FROM (SELECT *, row_number() OVER (PARTITION BY type || ':' || lower(value) ORDER BY source * 10000 - length(value)) AS r FROM every WHERE length(value) >= 3) WHERE r = 1""")
def query_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question's entities from the tables' values, from numbers and from the small vocabulary."""
    part, nation = table(spark, sf_dir, "part"), table(spark, sf_dir, "nation")
    own = lambda df, kind, c: df.select(F.lit(kind).alias("type"), F.col(c).alias("value")).distinct()
    known = own(part, "Material", "p_brand").unionByName(own(part, "Process", "p_type")).unionByName(own(nation, "Facility", "n_name"))
    return search.parse(_QUESTION, known)


# --- answers ---------------------------------------------------------------------------------------------------------


def _told(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = experiments(spark, sf_dir)
    with freed(spark):
        target = lines(spark, sf_dir).agg(F.min("id")).first()[0]
    pairs = written(counterfactual.for_target(rows, target))
    return answers.effect_texts(pairs, counterfactual.effects(pairs, rows))


_TOLD_SQL = f"""{X}, {_PAIRS_SQL.format(on='AND a.id = (SELECT min(id) FROM x)')}, o AS (SELECT id, 'price' AS property, CAST(price AS VARCHAR) AS v FROM x UNION ALL SELECT id, 'tax', CAST(tax AS VARCHAR) FROM x),
 ef AS (SELECT diff.id, other, string_agg(printf('{answers.CHANGED}', a.property, a.v, b.v), ', ' ORDER BY a.property) AS effects FROM diff JOIN o a ON a.id = diff.id JOIN o b ON b.id = other AND a.property = b.property WHERE a.v IS DISTINCT FROM b.v GROUP BY ALL),
 told AS (SELECT diff.*, coalesce(effects, '{answers.NO_EFFECT}') AS effects FROM diff LEFT JOIN ef USING (id, other))""".replace("'%s'", "''%s''")


@query(f"""{_TOLD_SQL} SELECT id, string_agg(printf('{answers.IF_CHANGED.replace("'", "''")}', parameter, from_value, to_value, effects), chr(10) ORDER BY other) AS text FROM (SELECT *, row_number() OVER (ORDER BY other) AS r FROM told) WHERE r <= 2 GROUP BY id""")
def counterfactual_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.counterfactual_lines(_told(spark, sf_dir))


@query(f"""{_TOLD_SQL} SELECT id, other, '- Сравнение с опытом ' || other || ':' || chr(10) || '  Изменен параметр ''' || parameter || ''' с ''' || from_value || ''' на ''' || to_value || '''.' || chr(10) || '  Наблюдаемые эффекты: ' || effects || '.' AS text FROM told""")
def causal_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return answers.reasons(_told(spark, sf_dir))


@query(f"""{X}, n AS (SELECT material, facility, count(*) AS n, count(*) FILTER (geography = 'EUROPE') AS h FROM x GROUP BY ALL)
 SELECT material, facility, CASE WHEN n < 100 THEN '- Данная область слабо освещена (найдено всего ' || n || ' экспериментов).' WHEN h = 0 THEN '{answers.GAP_TEXTS["foreign_only"]}' ELSE '{answers.GAP_TEXTS["domestic_only"]}' END AS text
 FROM n WHERE n < 100 OR h = 0 OR h = n""")
def gap_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All combinations of brand and nation that are gaps, in words."""
    rows = as_experiments(lines(spark, sf_dir))
    cells = lines(spark, sf_dir).select(F.col("material").alias("d0"), F.col("facility").alias("d1")).distinct()
    found = gaps.analyze(rows, ["Material", "Facility"], 100, domestic=F.col("geography") == "EUROPE", cells=cells)
    return found.select(F.col("d0").alias("material"), F.col("d1").alias("facility"), answers.gap_line(F.col("gap_type"), F.col("experiments")).alias("text"))


@query(f"""{HITS_SQL}, b AS (SELECT * FROM h WHERE question = 'known' AND rank <= 2), n AS (SELECT count(*) AS pubs FROM (SELECT DISTINCT id, evidence FROM h WHERE question = 'known')),
 p AS (SELECT string_agg(evidence, ', ' ORDER BY evidence) AS names FROM (SELECT DISTINCT evidence FROM h WHERE question = 'known' ORDER BY evidence LIMIT 5)), m AS (SELECT count(*) AS ids FROM h WHERE question = 'known')
 SELECT (SELECT string_agg('Опыт ' || id || ': Property: price: ' || price || ', Property: tax: ' || tax || ' (Сходство с запросом: ' || printf('%.1f', similarity * 100) || '%)', chr(10) ORDER BY rank) FROM b) AS similar,
 '{answers.NO_PAIRS}' AS counterfactuals, (SELECT 'Связанные публикации: ' || names FROM p) || chr(10) || 'Графовые пути: ' || ((SELECT pubs FROM n) + (SELECT ids FROM m)) AS graph""")
def answer_synthesis(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an answer to the first question is written from, without counterfactuals."""
    _, hits = _hits(spark, sf_dir)
    own = hits.where("question = 'known'")
    expanded = graph.expand(graph.edges(own), own.select("id"))
    none = own.select("id", F.lit("").alias("text")).limit(0)
    return answers.synthesis(own, none, answers.graph_lines(expanded)).select("similar", "counterfactuals", "graph")


@query(f"""{HITS_SQL}, t AS (SELECT unnest([2, 20]) AS best), few AS (SELECT t.best, count(*) FILTER (similarity > 0.05) < 3 AS few FROM t JOIN h ON h.question = 'generic' AND h.rank <= t.best GROUP BY t.best)
 SELECT best, type, value FROM asked, few WHERE few AND question = 'generic' AND type IN ('Material', 'Process', 'Equipment', 'Property', 'Facility')""")
def gap_of_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a question asks gaps for: with its two best hits, which are too few, and with all of them."""
    asked, hits = _hits(spark, sf_dir)
    asked, hits = asked.where("question = 'generic'"), hits.where("question = 'generic'")
    of = lambda best: answers.asks_for_gaps(hits.where(F.col("rank") <= best), asked).select(F.lit(best).alias("best"), "type", "value")
    return of(2).unionByName(of(20))


@query(f"""{X} SELECT count(*) FILTER (NOT is_sensitive) AS visible, count(*) AS every FROM x""")
def visible_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = lines(spark, sf_dir)
    seen = entities.visible(rows, True).agg(F.count("*").alias("visible"))
    return seen.crossJoin(entities.visible(rows, False).agg(F.count("*").alias("every")))


# --- judges and runs -------------------------------------------------------------------------------------------------


@query(r"""WITH t AS (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations),
 p AS (SELECT conv_id, turn, t, len(list_filter(['onatth', 'thereas', 'eauxtions'], lambda w: contains(t, w) OR contains(t, left(w, greatest(5, length(w) - 5))))) / 3e0 AS a, CASE WHEN turn % 3 > 0 THEN least(1e0, (turn % 3) / 2e0 / 0.75e0) END AS b, CASE WHEN turn % 2 = 0 THEN CASE WHEN conv_id % 2 = 0 THEN 1e0 ELSE 0e0 END END AS c FROM t)
 SELECT conv_id, turn, CASE WHEN t = '' THEN 0e0 ELSE round((a + coalesce(b, 0) + coalesce(c, 0)) / (1 + CASE WHEN b IS NULL THEN 0 ELSE 1 END + CASE WHEN c IS NULL THEN 0 ELSE 1 END), 9) END AS score, t <> '' AND a >= 1 AND coalesce(b, 1) >= 1 AND coalesce(c, 1) >= 1 AS passed FROM p""")
def rule_judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, c = F.col("turn") % 3, F.col("conv_id")
    rows = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.col("text").alias("answer"), F.array(*map(F.lit, ("onatth", "thereas", "eauxtions"))).alias("keywords"), F.when(turn > 0, turn / 2).alias("recall"), F.when(turn > 0, F.lit(0.75)).alias("min_recall"),
        (c % 2).alias("retrieved"), (F.col("turn") % 2 == 0).alias("expect_empty"),
    )
    return evaluate.rule_judge(rows).select("conv_id", "turn", F.round("score", 9).alias("score"), "passed")


@query("""SELECT event_id, CASE WHEN user_id % 5 < 4 THEN round(greatest(0e0, least(1e0, value / 20)), 4) END AS score, CASE WHEN user_id % 5 < 4 THEN greatest(0e0, least(1e0, value / 20)) >= 0.5 END AS passed, CASE WHEN user_id % 5 < 4 THEN event_type END AS reasoning FROM events""")
def judge_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.to_json(F.struct((F.col("value") / 20).alias("score"), F.col("event_type").alias("reasoning")))
    kind = F.col("user_id") % 5
    answer = F.when(kind == 0, said).when(kind == 1, F.concat(F.lit("{as asked}\n```json\n"), said, F.lit("\n```\n{done}"))).when(kind < 4, F.concat(F.lit("My verdict: "), said, F.lit(" as asked"))).otherwise(F.lit("no verdict"))
    rows = evaluate.judge_verdicts(table(spark, sf_dir, "events").select("event_id", answer.alias("verdict")))
    return rows.select("event_id", "score", "passed", "reasoning")


@query("""WITH q AS (SELECT CAST(event_id AS VARCHAR) AS id, event_type, user_id FROM events)
 SELECT id, CASE WHEN event_type = 'view' THEN 'retrieval_skipped' WHEN event_type = 'error' THEN 'error' ELSE 'judge_fail' END AS status,
 CASE WHEN event_type = 'view' THEN 'no expected_experiment_ids' WHEN event_type = 'error' THEN 'call with [REDACTED] failed' ELSE 'user ' || user_id END AS reason FROM q WHERE event_type IN ('view', 'error') OR (event_type = 'click' AND user_id % 3 = 0)""")
def run_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    rows = table(spark, sf_dir, "events").select(
        F.col("event_id").cast("string").alias("id"), (kind == "view").alias("retrieval_skipped"), F.lit(None).cast("string").alias("skip_reason"), F.when(kind == "error", F.lit("call with Bearer abc.def failed")).alias("error"),
        F.when(kind == "click", F.col("user_id") % 3 > 0).otherwise(F.when(kind == "purchase", F.lit(True))).alias("judge_pass"), F.concat(F.lit("user "), F.col("user_id").cast("string")).alias("judge_details"),
    )
    return evaluate.failures(rows)


@query("""SELECT count(*) AS questions, round(avg(user_id % 50), 4) AS mean_ttft_s, round(avg(value), 4) AS mean_llm_judge_score, round(count(*) FILTER (value >= 10) / count(*), 4) AS llm_judge_pass_rate FROM events""")
def run_model_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = F.lit(None).cast("double")
    rows = table(spark, sf_dir, "events").select(F.lit(None).cast("boolean").alias("judge_pass"), *(none.alias(c) for c in ("e2e_ms", "vector_ms", "graph_ms")), (F.col("user_id") % 50).cast("double").alias("ttft_s"), F.col("value").alias("llm_judge_score"), (F.col("value") >= 10).alias("llm_judge_pass"))
    return evaluate.run_rollup(rows).select("questions", "mean_ttft_s", "mean_llm_judge_score", "llm_judge_pass_rate")


@query(f"""{_RERANK_SQL}, b AS (SELECT *, row_number() OVER (PARTITION BY question ORDER BY round(hybrid, 9) DESC, rank) AS place FROM p)
 SELECT 'L0' AS stage, count(*) AS rows FROM asked UNION ALL SELECT 'L1_pre_rerank', count(*) FROM h UNION ALL SELECT 'L1', count(*) FROM b UNION ALL SELECT 'L2', count(*) FROM b WHERE place <= 5 UNION ALL SELECT 'L4', count(DISTINCT question) FROM h""")
def layer_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each layer of a run over the questions gave, counted by stage."""
    asked, hits = _hits(spark, sf_dir)
    reranked = search.rerank(hits.drop("overlap"), asked, None, "question")
    pairs = hits.select("question", "id", F.col("id").alias("other"), F.lit("").alias("parameter")).limit(0)
    said = hits.where("rank = 1").select("question", F.col("name").alias("answer"), F.lit(1.0).alias("e2e_ms"))
    return evaluate.layers(asked, hits, reranked, pairs, said).groupBy("stage").agg(F.count("*").alias("rows"))
