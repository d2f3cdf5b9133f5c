"""Queries of text functions and vector functions over the tables' columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import text, vectors
from hyperloom.plans.adapter import table
from hyperloom.plans.registry import query


@query(r"""WITH t AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'Heading ' || (user_id % 9) WHEN 1 THEN 'Heading' WHEN 2 THEN 'Normal' END AS style, CASE WHEN user_id % 3 = 0 THEN (user_id % 7) || '.' || (user_id % 5) || ' ' || upper(event_type) ELSE event_type END AS body, user_id FROM events)
 SELECT event_id, CAST(CASE WHEN user_id % 4 = 0 THEN greatest(1, least(6, user_id % 9)) WHEN user_id % 4 = 1 THEN 1 WHEN user_id % 3 = 0 THEN 2 END AS INT) AS level FROM t""")
def heading_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    style = F.when(u % 4 == 0, F.concat(F.lit("Heading "), (u % 9).cast("string"))).when(u % 4 == 1, "Heading").when(u % 4 == 2, "Normal")
    body = F.when(u % 3 == 0, F.concat((u % 7).cast("string"), F.lit("."), (u % 5).cast("string"), F.lit(" "), F.upper("event_type"))).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", style.alias("style"), body.alias("body"))
    return rows.select("event_id", text.heading_level("style", "body").alias("level"))


@query(r"""SELECT p_partkey, '| ' || p_name || ' | ' || p_brand || ' |' || chr(10) || '| ' || regexp_replace(p_type, '\s+', ' ', 'g') || ' |  |' AS lines FROM part""")
def table_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    cell = lambda c: F.concat(F.lit(" \t"), F.regexp_replace(c, " ", " \n "), F.lit(" "))
    rows = F.array(F.array(cell(F.col("p_name")), cell(F.col("p_brand"))), F.array(cell(F.col("p_type")), F.lit(None).cast("string")))
    return table(spark, sf_dir, "part").select("p_partkey", text.table_rows(rows).alias("lines"))


@query(r"""WITH t AS (SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN []::VARCHAR[] ELSE string_split(p_type, ' ') END AS path, CASE WHEN p_partkey % 4 = 1 THEN replace(p_type, ' ', chr(10)) || ' ' || p_name ELSE p_name END AS body FROM part)
 SELECT p_partkey, coalesce(path[-1], 'Введение') AS section, CASE WHEN len(path) = 0 OR starts_with(body, array_to_string(path, chr(10))) THEN body ELSE array_to_string(path, chr(10)) || chr(10) || chr(10) || body END AS body FROM t""")
def section_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 4
    path = F.when(k == 0, F.array().cast("array<string>")).otherwise(F.split("p_type", " "))
    body = F.when(k == 1, F.concat(F.replace("p_type", F.lit(" "), F.lit("\n")), F.lit(" "), F.col("p_name"))).otherwise(F.col("p_name"))
    rows = table(spark, sf_dir, "part").select("p_partkey", path.alias("path"), body.alias("body"))
    return rows.select("p_partkey", text.section_label("path").alias("section"), text.with_section("body", "path").alias("body"))


@query(r"""WITH t AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 'ТИ - ' || (doc_id % 20) || ' – 20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') || '.docx' ELSE source || '.docx' END AS file, CASE WHEN doc_id % 3 = 1 THEN 'of 2019: ОИП-7-2018 ' ELSE '' END || text AS body FROM documents)
 SELECT doc_id, CAST(coalesce(nullif(regexp_extract(file, '(20\d{2})', 1), ''), nullif(regexp_extract(body, '(20\d{2})', 1), ''), '2024') AS INT) AS year,
 CASE doc_id % 3 WHEN 0 THEN 'ТИ-' || CASE WHEN doc_id % 20 < 10 THEN '0' ELSE '' END || (doc_id % 20) || '-20' || lpad(CAST(doc_id % 30 AS VARCHAR), 2, '0') WHEN 1 THEN 'ОИП-07-2018' END AS code FROM t""")
def document_years_and_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    file = F.when(d % 3 == 0, F.concat(F.lit("ТИ - "), (d % 20).cast("string"), F.lit(" – 20"), two(d % 30), F.lit(".docx"))).otherwise(F.concat("source", F.lit(".docx")))
    body = F.concat(F.when(d % 3 == 1, "of 2019: ОИП-7-2018 ").otherwise(""), F.col("text"))
    rows = table(spark, sf_dir, "documents").select("doc_id", file.alias("file"), body.alias("body"))
    return rows.select("doc_id", text.document_year("file", "body").alias("year"), text.document_code("file", "body").alias("code"))


@query("""SELECT doc_id, 'EXP-' || CASE WHEN doc_id % 2 = 0 THEN 'TI-07-2020' ELSE upper(source) END || '-' || CASE WHEN doc_id % 3 = 0 THEN 'v' || (doc_id % 4) ELSE 'cn_v1' END || '-' || CASE WHEN doc_id < 10 THEN '0' ELSE '' END || doc_id AS id FROM documents""")
def experiment_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("doc_id")
    code, version = F.when(d % 2 == 0, "TI-07-2020").otherwise(""), F.when(d % 3 == 0, F.concat(F.lit("v"), (d % 4).cast("string")))
    return table(spark, sf_dir, "documents").select("doc_id", text.experiment_id(code, text.slug("source"), version, d).alias("id"))


@query(r"""WITH s AS (SELECT conv_id, turn, CASE turn % 8 WHEN 0 THEN 'Content_Filter: ' WHEN 1 THEN 'Я НЕ  МОГУ ОБСУЖДАТЬ это. ' WHEN 2 THEN 'I can''t discuss that. ' WHEN 3 THEN 'neutron moderation ' WHEN 4 THEN 'You CANNOT discuss it ' WHEN 5 THEN 'I cannot assist ' WHEN 6 THEN 'can''t' || chr(10) || 'Discuss ' ELSE '' END || text AS said FROM conversations)
 SELECT conv_id, turn, regexp_matches(said, '(?i)я\s+не\s+могу\s+обсуждать|can''t\s+discuss|cannot\s+discuss') AS refused FROM s""")
def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("turn") % 8
    said = F.lit("")
    for n, words in enumerate(("Content_Filter: ", "Я НЕ  МОГУ ОБСУЖДАТЬ это. ", "I can't discuss that. ", "neutron moderation ", "You CANNOT discuss it ", "I cannot assist ", "can't\nDiscuss ")):
        said = F.when(k == n, words).otherwise(said)
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", text.is_refusal(F.concat(said, "text")).alias("refused"))


@query("""WITH i AS (SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'exp-raw-' || user_id WHEN 1 THEN 'A-raw-' || user_id WHEN 2 THEN 'EXP-' || event_type || '-cn_v1-0' || (user_id % 9) ELSE event_type END AS id FROM events)
 SELECT event_id, starts_with(upper(id), 'EXP-RAW') OR list_contains(string_split(upper(id), '-')[1:2], 'RAW') AS noise, CASE WHEN len(string_split(id, '-')) >= 3 THEN array_to_string(string_split(id, '-')[1:3], '-') ELSE id END AS family FROM i""")
def noise_and_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    n = u.cast("string")
    id_ = F.when(u % 4 == 0, F.concat(F.lit("exp-raw-"), n)).when(u % 4 == 1, F.concat(F.lit("A-raw-"), n)).when(u % 4 == 2, F.concat(F.lit("EXP-"), "event_type", F.lit("-cn_v1-0"), (u % 9).cast("string"))).otherwise(F.col("event_type"))
    rows = table(spark, sf_dir, "events").select("event_id", id_.alias("id"))
    return rows.select("event_id", text.raw_noise("id").alias("noise"), text.source_family("id").alias("family"))


@query("""SELECT p_partkey, array_to_string(['Material=' || p_brand, 'Process=' || p_type || ':x', 'Property=' || p_size], ';') AS pairs FROM part""")
def typed_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.concat(F.lit("Material: "), "p_brand", F.lit(" ,, Process :"), "p_type", F.lit(":x, "), F.col("p_size").cast("string"), F.lit(" "))
    joined = F.array_join(F.transform(text.parse_pairs(F.col("said")), lambda e: F.concat_ws("=", e["type"], e["value"])), ";")
    return table(spark, sf_dir, "part").select("p_partkey", said.alias("said")).select("p_partkey", joined.alias("pairs"))


@query(r"""WITH l AS (SELECT p_partkey, lower(p_type || CASE p_partkey % 6 WHEN 0 THEN ' Flotation plant' WHEN 1 THEN ' FURNACE, mine' WHEN 2 THEN ' Harbour' WHEN 3 THEN ' Рудник' WHEN 4 THEN ' milling' ELSE '' END) AS t FROM part), w AS (SELECT p_partkey, regexp_extract_all(t, '[a-zа-яё0-9]+') AS w FROM l)
 SELECT p_partkey, CASE WHEN list_has_any(w, ['процесс', 'выщелачивание', 'плавка', 'extraction', 'leaching', 'smelting', 'flotation', 'electrowinning']) THEN 'Process' WHEN list_has_any(w, ['печь', 'мельница', 'ванна', 'furnace', 'mill', 'bath', 'cell', 'autoclave']) THEN 'Equipment'
 WHEN list_has_any(w, ['рудник', 'завод', 'гмк', 'mine', 'plant', 'harbour', 'facility']) THEN 'Facility' ELSE 'Material' END AS type FROM w""")
def label_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, label = F.col("p_partkey") % 6, F.lit("")
    for i, tail in enumerate((" Flotation plant", " FURNACE, mine", " Harbour", " Рудник", " milling")):
        label = F.when(k == i, tail).otherwise(label)
    return table(spark, sf_dir, "part").select("p_partkey", text.label_type(F.concat("p_type", label)).alias("type"))


@query("""SELECT event_id, concat_ws('|', CASE WHEN user_id % 2 = 0 THEN 'PH < ' || (user_id % 14) || '.5' END, CASE WHEN user_id % 3 = 0 THEN 'Температура: ' || user_id || ' °C' END, CASE WHEN user_id % 5 = 0 THEN 'плотность тока: ' || user_id || ' А/М2' END) AS found FROM events""")
def question_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    u = F.col("user_id")
    part = lambda holds, *pieces: F.when(holds, F.concat(*pieces)).otherwise("")
    said = F.concat(F.lit("Что при "), part(u % 2 == 0, F.lit("pH < "), (u % 14).cast("string"), F.lit(".5, ")), part(u % 3 == 0, u.cast("string"), F.lit(" °C и ")), part(u % 5 == 0, u.cast("string"), F.lit(" А/м2 ")), F.lit("выходит"))
    return table(spark, sf_dir, "events").select("event_id", F.array_join(text.query_properties(said), "|").alias("found"))


_TERM = lambda t, w: f"(contains({t}, lower({w})) OR (length({w}) > 4 AND contains({t}, left(lower({w}), length({w}) - 2))))"


@query(f"""WITH p AS (SELECT p_partkey, lower(p_name || ' ' || p_type) AS t, CASE p_partkey % 3 WHEN 0 THEN 'steely' WHEN 1 THEN 'tin' ELSE 'anodized brasses' END AS w FROM part)
 SELECT p_partkey, {_TERM("t", "w")} AS term, {_TERM("t", "w")} OR (p_partkey % 3 = 2 AND {_TERM("t", "'anodized'")} AND {_TERM("t", "'brasses'")}) AS value FROM p""")
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey") % 3
    rows = table(spark, sf_dir, "part").select("p_partkey", F.lower(F.concat("p_name", F.lit(" "), "p_type")).alias("t"), F.when(k == 0, "steely").when(k == 1, "tin").otherwise("anodized brasses").alias("w"))
    return rows.select("p_partkey", text.contains_term(F.col("t"), F.col("w")).alias("term"), text.matches_value(F.col("t"), F.col("w")).alias("value"))


@query("""SELECT event_id, user_id % 4 IN (0, 3) AS semantic FROM events""")
def semantic_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("user_id") % 4
    key = F.when(k == 0, F.concat(F.lit("Material:"), "event_type")).when(k == 1, F.concat(F.lit("NumericBase:"), "event_type", F.lit(":max"))).when(k == 2, F.col("event_type")).otherwise(F.concat(F.lit("Process:Role:"), "event_type"))
    return table(spark, sf_dir, "events").select("event_id", text.is_semantic_key(key).alias("semantic"))


# --- vectors ---------------------------------------------------------------------------------------------------------

_DIM = 128
_AT = lambda key, i: f"(CASE WHEN ascii(md5({key} || '|' || ({i}))) % 2 = 1 THEN 1 ELSE 0 END)"


@query(f"""WITH i AS (SELECT unnest(range({_DIM})) AS i), n AS (SELECT n_nationkey, 'Facility:' || lower(n_name) AS k FROM nation)
 SELECT n_nationkey, CAST(sum({_AT('k', f'(i + {_DIM - 1}) % {_DIM}')} * (i + 1)) AS BIGINT) AS checksum, 1 - 2 * sum(CASE WHEN {_AT('k', f'(i + {_DIM - 1}) % {_DIM}')} = {_AT('k', 'i')} THEN 0 ELSE 1 END) / {_DIM}e0 AS similarity FROM n, i GROUP BY n_nationkey""")
def permuted_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = vectors.word_vector(text.entity_key(F.lit("Facility"), "n_name"), _DIM)
    rows = table(spark, sf_dir, "nation").select("n_nationkey", own.alias("v")).withColumn("p", vectors.permute_words(F.col("v")))
    bit = lambda i: F.call_function("shiftrightunsigned", F.element_at("p", F.floor(i / 64).cast("int") + 1), (i % 64).cast("int")).bitwiseAND(F.lit(1))
    checksum = F.aggregate(F.sequence(F.lit(0), F.lit(_DIM - 1)), F.lit(0).cast("long"), lambda acc, i: acc + bit(i) * (i + 1))
    return rows.select("n_nationkey", checksum.alias("checksum"), vectors.similarity_words(F.col("v"), F.col("p"), _DIM).alias("similarity"))


@query(f"""WITH i AS (SELECT unnest(range(64)) AS i), v AS (SELECT n_nationkey, i, 2 * {_AT("('Facility:' || lower(n_name))", 'i')} - 1 AS b FROM nation, i),
 s AS (SELECT r_name, i, sum(b * (s_suppkey % 3 + 1)) AS total, count(*) AS vectors FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey JOIN v USING (n_nationkey) GROUP BY ALL)
 SELECT r_name AS key, CAST(sum(CASE WHEN total > 0 THEN i + 1 ELSE 0 END) AS BIGINT) AS checksum, CAST(count(*) FILTER (total = 0) AS BIGINT) AS ties, any_value(vectors) AS vectors FROM s GROUP BY r_name HAVING count(*) FILTER (total = 0) = 0""")
def bundled_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The bundle of each region's suppliers' nations, by weight; regions without a tie."""
    t = lambda name: table(spark, sf_dir, name)
    rows = t("supplier").join(t("nation"), F.col("s_nationkey") == F.col("n_nationkey")).join(t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
    hv = vectors.packed_vectors(64, vectors.digest_vector)(text.entity_key(F.lit("Facility"), "n_name"))
    own = rows.select(F.col("r_name").alias("key"), hv.alias("hv"), (F.col("s_suppkey") % 3 + 1).cast("long").alias("weight"))
    got = vectors.bundled(own, 64, "weight")
    other = vectors.bundled(own.unionByName(own.limit(0)), 64, "weight")  # the same, as a check that it repeats
    ties = _ties(own)
    byte = lambda i: F.conv(F.substring(F.hex("hv"), (F.floor(i / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = lambda i: F.call_function("shiftright", byte(i), (7 - i % 8).cast("int")).bitwiseAND(F.lit(1))
    checksum = F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, i: acc + bit(i) * (i + 1))
    return got.join(other.select("key", "hv"), ["key", "hv"]).join(ties, "key").where("ties = 0").select("key", checksum.alias("checksum"), "ties", "vectors")


def _ties(own: DataFrame) -> DataFrame:
    """key, ties: positions at which a key's weighted vectors cancel out."""
    byte = lambda i: F.conv(F.substring(F.hex("hv"), (F.floor(i / 8) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")
    bit = lambda i: F.call_function("shiftright", byte(i), (7 - i % 8).cast("int")).bitwiseAND(F.lit(1))
    at = own.select("key", "weight", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(63)), bit)).alias("i", "b"))
    sums = at.groupBy("key", "i").agg(F.sum((F.col("b") * 2 - 1) * F.col("weight")).alias("total"))
    return sums.groupBy("key").agg(F.count_if(F.col("total") == 0).alias("ties"))


@query("""WITH w AS (SELECT DISTINCT lower(p_type) AS text FROM part), c AS (SELECT DISTINCT lower(p_type) AS text FROM part WHERE p_partkey % 2 = 0)
 SELECT text, c.text IS NOT NULL AS cached, CASE WHEN c.text IS NOT NULL THEN 1e0 ELSE CAST(length(w.text) AS DOUBLE) END AS first FROM w LEFT JOIN c USING (text)""")
def embedding_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Embeddings from a cache where it has them, else from an embedder that is passed in."""
    part = table(spark, sf_dir, "part")
    cache = part.where("p_partkey % 2 = 0").select(F.col("p_type").alias("text"), F.array(F.lit(1.0).cast("float")).alias("embedding")).distinct()
    found = vectors.embedded(part.select(F.concat(F.lit("  "), "p_type").alias("text")), cache, lambda c: F.array(F.length(c).cast("float")))
    return found.select("text", "cached", F.col("embedding")[0].cast("double").alias("first"))
