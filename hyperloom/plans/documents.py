"""Queries over documents, pages and conversations: text functions, chunks, ingestion."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import text
from hyperloom.operators import chunks, ingest
from hyperloom.plans.adapter import table
from hyperloom.plans.registry import query

# Words of the tables' invented languages, in the places of the model's own word lists.
HERE, ABROAD = ["des", "und", "les"], ["the", "and", "that"]
OUTPUTS = ["tion", "heit"]


@query(r"SELECT doc_id, lower(regexp_replace(trim(source || '  ' || lang, ' '), '\s+', ' ', 'g')) AS value, 'Material:' || lower(regexp_replace(source || '  ' || lang, '\s+', ' ', 'g')) AS key FROM documents")
def entity_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    both = F.concat("source", F.lit("  "), "lang")
    return table(spark, sf_dir, "documents").select("doc_id", text.normalize_value(both).alias("value"), text.entity_key(F.lit("Material"), both).alias("key"))


@query("""WITH v AS (SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'pH < ' WHEN 1 THEN 'temp: ' WHEN 2 THEN 'density ≥ ' ELSE 'yield >= ' END AS head, CASE event_id % 4 WHEN 0 THEN '<' WHEN 1 THEN '' ELSE '≥' END AS op, CAST(round(value * 100) AS BIGINT) AS c FROM events),
 n AS (SELECT event_id, op, c // 100 + (c % 100) / 100e0 AS number, CASE event_id % 4 WHEN 0 THEN 14e0 WHEN 1 THEN 1200e0 ELSE 1000e0 END AS high FROM v)
 SELECT event_id, op, round(number, 2) AS number, round(greatest(0e0, least(1e0, CASE WHEN op = '<' THEN number / 2 WHEN op = '≥' THEN (number + high) / 2 ELSE number END / high)), 6) AS position FROM n""")
def numeric_property_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    cents = F.round(F.col("value") * 100).cast("long")
    number = F.concat(F.floor(cents / 100).cast("string"), F.lit(","), F.lpad((cents % 100).cast("string"), 2, "0"), F.lit(" u"))
    head = F.element_at(F.array(*map(F.lit, ("pH < ", "temp: ", "density ≥ ", "yield >= "))), (F.col("event_id") % 4 + 1).cast("int"))
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(head, number).alias("v")).withColumn("n", text.numeric_property("v"))
    return rows.select("event_id", "n.op", F.round("n.number", 2).alias("number"), F.round(text.position_in_range(F.col("n")), 6).alias("position"))


@query(r"SELECT page_id, rtrim(substr(CASE WHEN s = '' THEN 'DOC' ELSE s END, 1, 32), '-') AS slug FROM (SELECT page_id, trim(regexp_replace(upper(regexp_replace(regexp_extract(url, '([^/]*)$', 1), '(.)\.[^.]*$', '\1')), '[^A-Za-z0-9Ѐ-ӿ]+', '-', 'g'), '-') AS s FROM pages)")
def slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", text.slug("url").alias("slug"))


@query("SELECT event_id, upper(event_type) || '-' || CASE WHEN user_id < 10 THEN '0' ELSE '' END || user_id || '-2024' AS code FROM events")
def document_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.col("event_type"), F.lit(" – "), F.col("user_id").cast("string"), F.lit(" - 2024"))
    return table(spark, sf_dir, "events").select("event_id", text.normalize_code(raw).alias("code"))


_HITS = lambda words: " + ".join(f"CASE WHEN contains(lower(text || ' ' || source), '{w}') THEN 1 ELSE 0 END" for w in words)


@query(f"SELECT doc_id, CASE WHEN {_HITS(HERE)} > {_HITS(ABROAD)} THEN 'RU' ELSE 'Global' END AS geography FROM documents")
def geography_guess(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.guess_geography("text", "source", HERE, ABROAD).alias("geography"))


@query(r"""WITH b AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents), l AS (SELECT doc_id, b, list_filter(list_transform(string_split_regex(b, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 2) AS l FROM b),
 k AS (SELECT *, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) ELSE b END AS k FROM l)
 SELECT doc_id, CASE WHEN length(b) < 50 THEN 'too_short' WHEN regexp_full_match(k, '[\d.,\s\-–—]+') THEN 'slide_number' WHEN len(regexp_extract_all(k, '[A-Za-zА-Яа-яЁё0-9]{2,}')) < 4 THEN 'too_few_tokens'
 WHEN length(k) < 180 AND NOT regexp_matches(k, '(?i)(pH|°C|ore|anode|slag|nickel|copper|filter|furnace|cathode|leaching|smelting|electrolyte|electrowinning)') AND NOT regexp_matches(k, '(?i)\d+([.,]\d+)?\s*(°C|К|мг/л|г/л|%|МПа|HB|А/м)') THEN 'low_domain_signal' END AS reason FROM k""")
def low_signal_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.low_signal_reason("text").alias("reason"))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^\pL\pN_])(U|Pu|UF6|уран|плутоний|plutonium|uranium)($|[^\pL\pN_])') AS sensitive FROM documents")
def sensitive_flag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.is_sensitive("text").alias("sensitive"))


@query(r"""WITH t AS (SELECT doc_id, (CASE doc_id % 3 WHEN 0 THEN 'import os' || chr(10) || 'def f(x):' || chr(10) WHEN 1 THEN 'class A: x = {};' || chr(10) ELSE '' END) || text AS t FROM documents),
 c AS (SELECT doc_id, t, len(regexp_extract_all(t, '(?i)(?:^|\n)\s*(?:import\s+\w+|from\s+\w+\s+import|def\s+\w+\s*\(|class\s+\w+\s*[:\(]|function\s+\w+\s*\(|console\.log|#!/usr/bin|package\s+\w+)')) AS words,
 len(regexp_extract_all(t, '[{};=<>]|::|->|=>')) AS marks FROM t)
 SELECT doc_id, words >= 2 OR (words >= 1 AND marks > 0) AS code FROM c""")
def code_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    head = F.when(F.col("doc_id") % 3 == 0, "import os\ndef f(x):\n").when(F.col("doc_id") % 3 == 1, "class A: x = {};\n").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", text.is_code_like(F.concat(head, "text")).alias("code"))


@query(f"""SELECT role, count(*) AS words FROM (SELECT CASE WHEN doc_id % 5 IN (1, 2) THEN 'process' WHEN doc_id % 5 = 4 THEN 'input' WHEN contains(lower(w), '{OUTPUTS[0]}') OR contains(lower(w), '{OUTPUTS[1]}') THEN 'output' ELSE 'input' END AS role
 FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w FROM documents) WHERE w <> '' AND trim(w, chr(10)) <> '') GROUP BY role""")
def role_classification(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", " ")).alias("w")).where(text.strip("w") != "")
    kind = F.element_at(F.array(*map(F.lit, ("Material", "Process", "Equipment", "Property", "Expert"))), (F.col("doc_id") % 5 + 1).cast("int"))
    return words.groupBy(text.entity_role(kind, "w", OUTPUTS, OUTPUTS).alias("role")).agg(F.count("*").alias("words"))


@query(r"""WITH t AS (SELECT event_id, 'at ' || user_id || ' °C and pH ' || (user_id % 14) || ', load ' || user_id || ' А/м² gives ' || (user_id % 100) || ' % or > ' || user_id || ' мг/л' AS t, user_id FROM events)
 SELECT event_id, concat_ws('|', user_id || ' °C', 'pH ' || (user_id % 14), user_id || ' А/м²', (user_id % 100) || ' %', user_id || ' мг/л', '> ' || user_id || ' мг/л') AS mentions FROM t""")
def numeric_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id").cast("string")
    t = F.concat(F.lit("at "), u, F.lit(" °C and pH "), (F.col("user_id") % 14).cast("string"), F.lit(", load "), u, F.lit(" А/м² gives "), (F.col("user_id") % 100).cast("string"), F.lit(" % or > "), u, F.lit(" мг/л"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.numeric_mentions(t), "|").alias("mentions"))


@query(r"""SELECT doc_id, length(r) AS n_after, len(regexp_extract_all(r, '\[REDACTED\]')) AS marks FROM (SELECT doc_id, regexp_replace(regexp_replace(regexp_replace(text, 'sk-[A-Za-z0-9]{20,}', '[REDACTED]', 'g'), '(?i)api[_-]?key', '[REDACTED]', 'g'), '(?i)Bearer\s+[A-Za-z0-9._-]+', '[REDACTED]', 'g') AS r FROM documents)""")
def redaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "documents").select("doc_id", text.redact("text").alias("r"))
    return rows.select("doc_id", F.length("r").cast("long").alias("n_after"), F.regexp_count("r", F.lit(r"\[REDACTED\]")).cast("long").alias("marks"))


@query("""SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, CASE event_type WHEN 'click' THEN 'located_at' WHEN 'view' THEN 'uses_material' WHEN 'error' THEN 'contradicts' END AS relation FROM events""")
def json_repair_relation_alias(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", F.concat(F.lit("Sure:\n```json\n"), F.regexp_replace("props", r"\}$", ",}"), F.lit("\n```")).alias("answer"))
    name = F.when(F.col("event_type") == "click", "Located in").when(F.col("event_type") == "view", " used-with ").when(F.col("event_type") == "error", "CONTRADICTS").otherwise(F.col("event_type"))
    return rows.select("event_id", F.get_json_object(text.repair_json("answer"), "$.k").cast("long").alias("k"), text.relation_type(name).alias("relation"))


@query("""WITH p AS (SELECT event_id, event_type, user_id % 3 AS kind FROM events)
 SELECT event_id, CASE kind WHEN 0 THEN 2 ELSE 0 END AS entities, CASE kind WHEN 2 THEN 0 ELSE 2 END AS dropped, CASE kind WHEN 1 THEN 'tolerant_drop_all' WHEN 2 THEN 'parse_error' END AS failure FROM p""")
def payload_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = F.concat(F.lit('{"entities":[{"type":"material","value":"'), "event_type", F.lit('"},{"type":"PROCESS","value":"x"},{"type":"Ghost","value":"y"}],"relations":[{"source":"a","type":"nonsense","target":"b"}]}'))
    bad = F.lit('{"entities":[{"type":"Ghost","value":"y"},{"type":"Material","value":" "}]}')
    kind = F.col("user_id") % 3
    rows = table(spark, sf_dir, "events").select("event_id", F.when(kind == 0, good).when(kind == 1, bad).otherwise(F.lit("no json")).alias("payload"))
    return ingest.parse_payload(rows).select("event_id", F.size("entities").alias("entities"), "dropped", "failure")


@query("""WITH b AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
 SELECT CASE WHEN contains(body, '|') THEN 'table' ELSE 'text' END AS kind, count(*) AS blocks, CAST(sum(length(body)) AS BIGINT) AS chars FROM b WHERE trim(body, ' ' || chr(9) || chr(13)) <> '' GROUP BY kind""")
def text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.blocks_of_text(table(spark, sf_dir, "documents")).groupBy("kind").agg(F.count("*").alias("blocks"), F.sum(F.length("body")).alias("chars"))


_HTML_PATHS = ", ".join(f"last_value(CASE WHEN level = {i} THEN pos END IGNORE NULLS) OVER w AS p{i}, last_value(CASE WHEN level = {i} THEN body END IGNORE NULLS) OVER w AS b{i}" for i in range(1, 7))
_HTML_PARTS = ", ".join(f"CASE WHEN p{i} > greatest(-1, {', '.join(f'coalesce(p{j}, -1)' for j in range(1, i)) or -1}) THEN b{i} END" for i in range(1, 7))


@query(rf"""WITH c AS (SELECT page_id, regexp_replace(html, '(?is)<(script|style)\b.*?</(script|style)>|<!--.*?-->', '', 'g') AS c FROM pages),
 s AS (SELECT page_id, string_split(regexp_replace(c, '(?i)(</?(?:h[1-6]|p|li|ul|article|div|body)\b)', chr(1) || '\1', 'g'), chr(1)) AS s FROM c),
 f AS (SELECT page_id, list_filter(s[:-2], lambda x: regexp_matches(x, '(?i)^<(?:h[1-6]|p|li)\b[^>]*>')) AS f FROM s),
 r AS (SELECT page_id, unnest(f) AS raw, unnest(range(len(f))) AS pos FROM f),
 b AS (SELECT page_id, CAST(pos AS INT) AS pos, lower(regexp_extract(raw, '<(\w+)', 1)) AS tag, trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(raw, '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '\s+', ' ', 'g')) AS body FROM r),
 k AS (SELECT page_id, pos, CASE WHEN tag LIKE 'h%' THEN 'heading' WHEN tag = 'li' THEN 'item' ELSE 'text' END AS kind, TRY_CAST(nullif(regexp_extract(tag, 'h(\d)', 1), '') AS INT) AS level, body FROM b WHERE body <> ''),
 p AS (SELECT *, {_HTML_PATHS} FROM k WINDOW w AS (PARTITION BY page_id ORDER BY pos ROWS UNBOUNDED PRECEDING))
 SELECT page_id, pos, kind, body, array_to_string(list_filter([{_HTML_PARTS}], lambda x: x IS NOT NULL), ' / ') AS section FROM p""")
def page_text_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.section_paths(chunks.blocks_of_html(table(spark, sf_dir, "pages")), "page_id").select("page_id", "pos", "kind", "body", F.array_join("section_path", " / ").alias("section"))


@query("""WITH RECURSIVE l AS (SELECT doc_id, list_transform(string_split(text, chr(10)), lambda x: length(x)) AS n FROM documents),
 r(doc_id, i, part, used) AS (SELECT doc_id, 1, 0, n[1] FROM l UNION ALL SELECT r.doc_id, i + 1, CASE WHEN used + n[i + 1] + 1 > 600 THEN part + 1 ELSE part END, CASE WHEN used + n[i + 1] + 1 > 600 THEN n[i + 1] ELSE used + n[i + 1] + 1 END FROM r JOIN l USING (doc_id) WHERE i < len(n))
 SELECT doc_id, CAST(max(part) + 1 AS BIGINT) AS parts, CAST(max(used) AS BIGINT) AS longest_end FROM r GROUP BY doc_id""")
def chunk_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    lengths = F.transform(F.split("text", "\n"), F.length)
    rows = table(spark, sf_dir, "documents").select("doc_id", lengths.alias("n"), chunks.packed(lengths, 600).alias("parts")).select("doc_id", "parts", F.explode(F.arrays_zip("n", F.col("parts").alias("p"))).alias("z"), F.monotonically_increasing_id().alias("row"))
    return _pack_ends(rows)


def _pack_ends(rows: DataFrame) -> DataFrame:
    """The number of parts, and the fullest that a part was while it was filled."""
    per = rows.groupBy("doc_id", F.col("z.p").alias("p")).agg((F.sum(F.col("z.n") + 1) - 1).alias("used"))
    return per.groupBy("doc_id").agg((F.max("p") + 1).cast("long").alias("parts"), F.max("used").cast("long").alias("longest_end"))


@query(r"""WITH RECURSIVE l AS (SELECT doc_id, pos, body, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS i FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS body, unnest(range(len(string_split(text, chr(10))))) AS pos FROM documents)
  WHERE regexp_replace(body, '^\s+|\s+$', '', 'g') <> ''),
 r(doc_id, i, pos, body, is_table, piece, used, start) AS (SELECT doc_id, i, pos, body, contains(body, '|'), 0, length(body) + 1, pos FROM l WHERE i = 1
  UNION ALL SELECT r.doc_id, l.i, l.pos, l.body, contains(l.body, '|'), CASE WHEN contains(l.body, '|') OR r.is_table OR used + length(l.body) + 1 > 1800 THEN piece + 1 ELSE piece END,
   CASE WHEN contains(l.body, '|') OR r.is_table OR used + length(l.body) + 1 > 1800 THEN length(l.body) + 1 ELSE used + length(l.body) + 1 END, CASE WHEN contains(l.body, '|') OR r.is_table THEN l.pos ELSE start END
  FROM r JOIN l ON l.doc_id = r.doc_id AND l.i = r.i + 1),
 c AS (SELECT doc_id, piece, any_value(is_table) AS is_table, min(start) AS start, CASE WHEN any_value(is_table) THEN '| ' || array_to_string(list_transform(string_split_regex(any_value(body), '\s*\|\s*'), lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))), ' | ') || ' |' ELSE string_agg(body, chr(10) ORDER BY i) END AS t FROM r GROUP BY doc_id, piece)
 SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY piece) - 1 AS INT) AS index, 'Введение' AS section, CASE WHEN is_table THEN 'table' ELSE 'text' END AS content_type, CAST(start AS INT) AS source_block, CASE WHEN is_table THEN 1 END AS table_part, sha256(t) AS digest FROM c WHERE is_table OR length(t) >= 40""")
def document_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = chunks.chunks_of(chunks.blocks_in_rows(table(spark, sf_dir, "documents")))
    return made.select("doc_id", "index", "section", "content_type", "source_block", "table_part", F.sha2(F.col("text").cast("binary"), 256).alias("digest"))


@query("""SELECT CAST(event_id AS VARCHAR) AS path, CASE WHEN user_id % 4 = 0 THEN 'text' WHEN user_id % 4 = 1 THEN 'heading' WHEN user_id % 4 = 2 THEN 'code' ELSE 'table' END AS kind, CAST(CASE user_id % 4 WHEN 1 THEN 2 END AS INT) AS level FROM events""")
def document_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw blocks of files as code, headings, text and tables."""
    u = F.col("user_id") % 4
    body = F.when(u == 2, "import os").otherwise(F.col("event_type"))
    raw = F.struct(F.when(u == 3, "table").otherwise("paragraph").alias("kind"), F.when(u == 1, "Heading 2").otherwise("Normal").alias("style"), (u == 2).alias("monospace"), body.alias("body"), F.when(u == 3, F.array(F.array(body))).alias("rows"))
    rows = table(spark, sf_dir, "events").select(F.col("event_id").cast("string").alias("path"), F.array(raw).alias("raw"))
    return rows.select("path", F.explode(chunks.structured(F.col("raw"))).alias("b")).select("path", "b.kind", "b.level")


@query(r"""WITH v AS (SELECT DISTINCT lower(w) AS value FROM (SELECT unnest(regexp_split_to_array(text, '\s+')) AS w FROM benchmark) WHERE length(w) >= 6),
 d AS (SELECT doc_id, list_distinct(string_split(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), ' ')) AS w FROM documents) SELECT doc_id, value FROM (SELECT doc_id, unnest(w) AS value FROM d) JOIN v USING (value)""")
def vocab_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The longer words of all benchmark items, looked for in all documents."""
    values = table(spark, sf_dir, "benchmark").select(F.explode(F.split("text", r"\s+")).alias("value")).where(F.length("value") >= 6)
    return ingest.match_vocabulary(table(spark, sf_dir, "documents"), values, "doc_id", "text")


@query(r"""WITH v AS (SELECT DISTINCT lower(a || ' ' || b) AS value FROM (SELECT w[i] AS a, w[i + 1] AS b FROM (SELECT w, unnest(range(1, len(w))) AS i FROM (SELECT regexp_split_to_array(text, '\s+') AS w FROM benchmark))) WHERE length(a) >= 4 AND length(b) >= 4),
 d AS (SELECT doc_id, string_split(lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')), ' ') AS w FROM documents), p AS (SELECT DISTINCT doc_id, w[i] || ' ' || w[i + 1] AS value FROM (SELECT doc_id, w, unnest(range(1, len(w))) AS i FROM d)) SELECT doc_id, value FROM p JOIN v USING (value)""")
def phrase_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same for pairs of neighbouring words."""
    words = F.split("text", r"\s+")
    pairs = F.transform(F.sequence(F.lit(1), F.size(words) - 1), lambda i: F.struct(F.element_at(words, i).alias("a"), F.element_at(words, i + 1).alias("b")))
    values = table(spark, sf_dir, "benchmark").where(F.size(words) > 1).select(F.explode(pairs).alias("p")).where("length(p.a) >= 4 and length(p.b) >= 4").select(F.concat_ws(" ", "p.a", "p.b").alias("value"))
    return ingest.match_vocabulary(table(spark, sf_dir, "documents"), values, "doc_id", "text")


@query("SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def ingest_idempotent_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.new_rows(table(spark, sf_dir, "documents").select("doc_id", "source"), table(spark, sf_dir, "labels"), "doc_id")


@query("""SELECT doc_id, CASE WHEN toxic = 1 THEN d.n_chars ELSE coalesce(CAST(quality AS BIGINT), d.n_chars) END AS value, CASE WHEN toxic = 1 THEN 'restored' WHEN quality IS NULL THEN 'skipped' ELSE 'ok' END AS status FROM documents d LEFT JOIN labels USING (doc_id)""")
def relabel_restore(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "documents").select("doc_id", F.col("n_chars").alias("value"))
    new = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").cast("long").alias("value"), (F.col("toxic") == 1).alias("failed"))
    return ingest.relabel(old, new, "doc_id", "value", "failed")


@query("""WITH s AS (SELECT unnest(['ok', 'skipped', 'restored', 'validation_failed', 'moderation', 'empty', 'graph_sync_failed', 'graph_sync_deferred']) AS status),
 o AS (SELECT CASE role WHEN 'user' THEN 'ok' WHEN 'assistant' THEN 'skipped' ELSE 'unknown' END AS status FROM conversations) SELECT s.status, count(o.status) AS chunks FROM s LEFT JOIN o USING (status) GROUP BY s.status""")
def outcome_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.when(F.col("role") == "user", "ok").when(F.col("role") == "assistant", "skipped").otherwise("unknown")
    return ingest.outcome_counts(table(spark, sf_dir, "conversations").select(status.alias("status")))


@query(r"SELECT doc_id, regexp_replace(substr(t, 1, 240), '', '') || CASE WHEN length(t) > 240 THEN '...' ELSE '' END AS preview FROM (SELECT doc_id, regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s*\n\s*', ' ', 'g') AS t FROM documents)")
def text_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.preview("text").alias("preview"))


@query(r"""SELECT conv_id, turn, len(list_filter(['onatth', 'thereas', 'eauxtions'], lambda w: contains(t, w) OR contains(t, left(w, greatest(5, length(w) - 5))))) AS hits FROM (SELECT conv_id, turn, lower(regexp_replace(regexp_replace(text, '^\s+|\s+$', '', 'g'), '\s+', ' ', 'g')) AS t FROM conversations)""")
def answer_keywords(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = sum((text.keyword_in_answer(F.col("text"), F.lit(w)).cast("long") for w in ("onatth", "thereas", "eauxtions")), F.lit(0).cast("long"))
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", hits.alias("hits"))


@query()
def ingest_experiments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents read without a model: numbers with units are what they say."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.format_string("EXP-%s-%s-%02d", text.slug("source"), F.lit("cn_v1"), F.col("doc_id")).alias("id"), F.col("source").alias("filename"), "text", text.document_year("source", "text").alias("year"), F.array("lang").alias("experts"))
    known = table(spark, sf_dir, "labels").where("toxic = 1").join(docs.select("doc_id", "source"), "doc_id").select(F.format_string("EXP-%s-%s-%02d", text.slug("source"), F.lit("cn_v1"), F.col("doc_id")).alias("id"))
    made = ingest.experiments_of(ingest.process_chunks(own, known))
    return made.select("id", "geography", "year", "is_sensitive", F.size("input_entities").alias("inputs"), F.size("output_entities").alias("outputs"))


_REASON = r"""CASE WHEN length(b) < 50 THEN 'too_short' WHEN regexp_full_match(k, '[\d.,\s\-–—]+') THEN 'slide_number' WHEN len(regexp_extract_all(k, '[A-Za-zА-Яа-яЁё0-9]{2,}')) < 4 THEN 'too_few_tokens'
 WHEN length(k) < 180 AND NOT regexp_matches(k, '(?i)(pH|°C|ore|anode|slag|nickel|copper|filter|furnace|cathode|leaching|smelting|electrolyte|electrowinning)') AND NOT regexp_matches(k, '(?i)\d+([.,]\d+)?\s*(°C|К|мг/л|г/л|%|МПа|HB|А/м)') THEN 'low_domain_signal' END"""


@query(rf"""WITH b AS (SELECT doc_id, lang, source, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS b FROM documents), l AS (SELECT *, list_filter(list_transform(string_split_regex(b, '\r?\n'), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: length(x) > 2) AS l FROM b),
 k AS (SELECT *, CASE WHEN len(l) > 0 THEN array_to_string(l, chr(10)) ELSE b END AS k FROM l), r AS (SELECT *, {_REASON} AS low FROM k),
 s AS (SELECT r.*, t.doc_id IS NOT NULL AS known FROM r LEFT JOIN (SELECT doc_id FROM labels WHERE toxic = 1) t USING (doc_id)),
 o AS (SELECT *, CASE WHEN known THEN 'skipped' WHEN low IS NOT NULL THEN 'empty' WHEN doc_id % 7 = 0 THEN 'moderation' WHEN doc_id % 7 IN (1, 2) THEN 'validation_failed' WHEN doc_id % 7 = 3 THEN 'empty' ELSE 'ok' END AS status FROM s)
 SELECT doc_id, status, CASE WHEN known THEN NULL WHEN low IS NOT NULL THEN low WHEN status = 'empty' THEN 'weak_domain_evidence' END AS reason,
 CASE WHEN status = 'empty' THEN 'empty' WHEN status = 'validation_failed' THEN CASE WHEN doc_id % 7 = 1 THEN 'parse_error' ELSE 'tolerant_drop_all' END END AS failure_class,
 CASE WHEN status = 'ok' THEN 3 END AS inputs, CASE WHEN status = 'ok' THEN 2 END AS processes, CASE WHEN status = 'ok' THEN 1 END AS outputs, CASE WHEN status = 'ok' THEN 1 END AS relations, CASE WHEN status = 'ok' THEN regexp_matches(text, '(?i)(^|[^\pL\pN_])(U|Pu|UF6|уран|плутоний|plutonium|uranium)($|[^\pL\pN_])') END AS is_sensitive FROM o""")
def ingest_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as chunks that a model has read: answers with entities and relations, some in a fence between braces, refusals, broken ones, ones of which
    nothing is left, and ones without a domain's entity. Numbers with units in the texts count as entities too, so those
    are taken out of the numbers shown."""
    docs = table(spark, sf_dir, "documents")
    own = docs.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit(".docx")).alias("filename"), F.concat_ws("\u0001", F.col("doc_id").cast("string"), "source", "lang", "text").alias("tagged"), "text", F.lit(2024).alias("year"), F.array("lang").alias("experts"))
    known = table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").cast("string").alias("id"))
    entity = lambda kind, v: F.concat(F.lit('{"type":"' + kind + '","value":"'), v, F.lit('"}'))
    k = F.crc32(F.col("text").cast("binary")) * 0 + F.col("year") * 0 + F.col("id").cast("long") % 7
    several = F.concat(F.lit('Found: {"entities":['), entity("material", F.col("id")), F.lit(","), entity("Facility", F.lit("plant")), F.lit(","), entity("Process", F.lit("leaching")), F.lit(","), entity("Property", F.lit("выход по току 95")), F.lit(","), entity("Ghost", F.lit("x")),
                       F.lit('],"relations":[{"source":"leaching","type":"uses","target":"plant"},{"source":"a","type":"nonsense","target":"b"},],}'))
    several = F.when(k == 4, F.concat(F.lit("{see below}\n```json\n"), several, F.lit("\n```\n{neutron moderation}"))).otherwise(several)
    answer = F.when(k == 0, F.when(F.col("id").cast("long") % 2 == 0, "I cannot discuss this topic").otherwise("I can't discuss this")).when(k == 1, "no idea").when(k == 2, '{"entities":[{"type":"Ghost","value":"x"}]}').when(k == 3, '{"entities":[{"type":"Publication","value":"x"}]}').otherwise(several)
    made = ingest.process_chunks(own.drop("tagged"), known, lambda body: F.when(body.isNotNull(), answer))
    ok = F.col("status") == "ok"
    count = lambda c: F.when(ok, F.size(F.filter(c, lambda e: (e["type"] != "Property") | e["value"].startswith("выход")))).alias(c.split("_")[0] + ("es" if c.startswith("process") else "s"))
    return made.select(F.col("id").cast("long").alias("doc_id"), "status", "reason", "failure_class", *map(count, ("input_entities", "process_entities", "output_entities")), F.when(ok, F.size("relations")).alias("relations"), F.when(ok, F.col("is_sensitive")).alias("is_sensitive"))


@query("""WITH p AS (SELECT event_id, user_id % 6 AS kind FROM events)
 SELECT event_id, CASE kind WHEN 0 THEN 1 WHEN 5 THEN 0 ELSE 0 END AS strict_entities, CASE kind WHEN 0 THEN NULL WHEN 4 THEN 'parse_error' WHEN 5 THEN NULL ELSE 'schema_error' END AS strict,
 CASE kind WHEN 0 THEN NULL WHEN 1 THEN NULL WHEN 2 THEN 'tolerant_drop_all' WHEN 3 THEN 'schema_error' WHEN 4 THEN 'parse_error' ELSE 'tolerant_drop_all' END AS tolerant,
 CASE kind WHEN 1 THEN 'unknown type Ghost|empty value|unknown relation nonsense' WHEN 2 THEN 'empty value' ELSE '' END AS reasons FROM p""")
def strict_and_tolerant(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same answers under both kinds of validation."""
    kind, payload = F.col("user_id") % 6, F.lit("nothing")
    good = '{"entities":[{"type":"material","value":"a"}],"relations":[{"source":"a","type":"used with","target":"b"}]}'
    mixed = '{"entities":[{"type":"Material","value":"a"},{"type":"Ghost","value":"b"},{"type":"Process","value":" "}],"relations":[{"source":"a","type":"nonsense","target":"b"}]}'
    for i, text_ in enumerate((good, mixed, '{"entities":[{"type":"Material","value":""}]}', '{"entities":"a, b"}', "[1, 2]", '{"relations":[]}')):
        payload = F.when(kind == i, text_).otherwise(payload)
    rows = table(spark, sf_dir, "events").select("event_id", payload.alias("payload"))
    strict = ingest.parse_payload(rows, strict=True).select("event_id", F.size("entities").alias("strict_entities"), F.col("failure").alias("strict"))
    return strict.join(ingest.parse_payload(rows).select("event_id", F.col("failure").alias("tolerant"), F.array_join("reasons", "|").alias("reasons")), "event_id")


@query("""WITH o AS (SELECT event_id, event_type FROM events WHERE event_type IN ('error', 'view', 'click') ORDER BY event_id LIMIT 20) SELECT event_id, CASE event_type WHEN 'error' THEN 'validation_failed' WHEN 'view' THEN 'moderation' ELSE 'empty' END AS status FROM o""")
def failed_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first failed outcomes of a report."""
    kind = F.col("event_type")
    status = F.when(kind == "error", "validation_failed").when(kind == "view", "moderation").when(kind == "click", "empty").otherwise("ok")
    return ingest.failed_samples(table(spark, sf_dir, "events").select("event_id", status.alias("status")), "event_id")


@query("""SELECT event_id, CASE WHEN user_id % 4 < 3 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k FROM events""")
def model_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers in parts: plain, fenced, fenced with braces around, and none."""
    k = F.col("user_id") % 4
    part = lambda kind, said: F.struct(F.lit(kind).alias("type"), said.alias("text"))
    half = F.length("props") - 3
    cut = (F.substring("props", F.lit(1), half), F.substring(F.col("props"), half + 1, F.lit(99)))
    whole = F.concat(F.lit("{see below}\n```json\n"), "props", F.lit("\n```\n{done}"))
    parts = F.when(k == 0, F.array(part("text", cut[0]), part("image", F.lit("x")), part("text", cut[1]))).when(k == 1, F.array(part("text", F.concat(F.lit("```\n"), "props", F.lit("```"))))).when(k == 2, F.array(part("text", whole))).otherwise(F.array(part("text", F.lit("none"))))
    rows = table(spark, sf_dir, "events").select("event_id", text.joined_content(parts).alias("answer"))
    return rows.select("event_id", F.get_json_object(text.json_object("answer"), "$.k").cast("long").alias("k"))
