"""From chunks to experiments: what is known is skipped, what says nothing is left out, the rest is extracted."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.functions import text


def new_rows(found: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows whose key isn't known yet."""
    return found.join(known.select(key).distinct(), key, "left_anti")


def upsert(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """new's rows replace old's of the same key; the columns are old's."""
    return old.join(new.select(key).distinct(), key, "left_anti").unionByName(new.select(*old.columns))


def relabel(old: DataFrame, new: DataFrame, key: str, value: str, failed: str) -> DataFrame:
    """key, value, status: the new value, or the old one restored where the new one failed."""
    joined = old.select(key, F.col(value).alias("_old")).join(new.select(key, F.col(value).alias("_new"), F.col(failed).alias("_failed")), key, "full_outer")
    bad = F.coalesce("_failed", F.lit(False))
    status = F.when(bad & F.col("_old").isNotNull(), "restored").when(bad, "validation_failed").when(F.col("_new").isNull(), "skipped").otherwise("ok")
    return joined.select(key, F.when(bad, F.col("_old")).otherwise(F.coalesce("_new", "_old")).alias(value), status.alias("status"))


def outcome_counts(outcomes: DataFrame) -> DataFrame:
    """status, chunks: every known status, zeros included; unknown ones are ignored."""
    known = outcomes.sparkSession.createDataFrame([(s,) for s in schema.CHUNK_STATUSES], "status string")
    return known.join(outcomes.groupBy("status").agg(F.count("*").alias("chunks")), "status", "left").na.fill(0)


def validation_summary(outcomes: DataFrame) -> DataFrame:
    """failure_class (null: none), failed, dropped_entities, dropped_relations of chunk outcomes. A chunk counts as failed
    by its status, whatever its class."""
    failed = F.count_if(F.coalesce(F.col("status").isin("validation_failed", "moderation", "empty"), F.lit(False)))
    dropped = [F.sum(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in ("dropped_entities", "dropped_relations")]
    return outcomes.groupBy("failure_class").agg(F.count("*").alias("chunks"), failed.alias("failed"), *dropped)


def failed_samples(outcomes: DataFrame, order: str, most: int = 20) -> DataFrame:
    """The first failed outcomes, for a report."""
    return outcomes.where(F.col("status").isin("validation_failed", "moderation", "empty")).orderBy(order).limit(most)


def valid_entities(entities: Column) -> Column:
    """Of array<struct<type, value>>: those of a known type, in its right case, with a value."""
    fixed = F.transform(entities, lambda e: F.struct(text.entity_type(e["type"]).alias("type"), text.strip(e["value"]).alias("value")))
    return F.filter(fixed, lambda e: e["type"].isNotNull() & F.coalesce(e["value"] != "", F.lit(False)))


def valid_relations(relations: Column) -> Column:
    fixed = F.transform(relations, lambda r: F.struct(text.strip(r["source"]).alias("source"), text.relation_type(r["type"]).alias("type"), text.strip(r["target"]).alias("target")))
    return F.filter(fixed, lambda r: r["type"].isNotNull() & F.coalesce((r["source"] != "") & (r["target"] != ""), F.lit(False)))


PAYLOAD = f"struct<entities:array<{schema.ENTITY}>,relations:array<{schema.RELATION}>>"
#: Reasons that are kept for each list of a payload.
MOST_REASONS = 5


def _entity_reason(e: Column) -> Column:
    """Why an entity is dropped, null if it isn't."""
    unknown = F.concat(F.lit("unknown type "), F.coalesce(e["type"], F.lit("(none)")))
    return F.when(text.entity_type(e["type"]).isNull(), unknown).when(F.coalesce(text.strip(e["value"]) == "", F.lit(True)), "empty value")


def _relation_reason(r: Column) -> Column:
    unknown = F.concat(F.lit("unknown relation "), F.coalesce(r["type"], F.lit("(none)")))
    blank = lambda c: F.coalesce(text.strip(c) == "", F.lit(True))
    return F.when(text.relation_type(r["type"]).isNull(), unknown).when(blank(r["source"]) | blank(r["target"]), "empty end")


def parse_payload(df: DataFrame, payload: str = "payload", strict: bool = False) -> DataFrame:
    """entities, relations, dropped_entities, dropped_relations, dropped, reasons and failure of a model's JSON answer.

    failure: parse_error where it is no object, schema_error where a list is none, tolerant_drop_all where no entity is
    left. If strict, one bad item is a schema_error and nothing is left of the answer; missing lists are empty."""
    out = df.withColumn("_root", text.json_root(payload)).withColumn("_p", F.from_json("_root", PAYLOAD))
    part = lambda name: F.get_json_object("_root", f"$.{name}")
    listed = lambda name: part(name).isNull() | (part(name) == "null") | part(name).startswith("[")
    none = lambda kind: F.array().cast(f"array<{kind}>")
    offered = lambda name: F.coalesce(F.json_array_length(part(name)), F.lit(0))
    given = {"entities": (F.coalesce("_p.entities", none(schema.ENTITY)), valid_entities, _entity_reason), "relations": (F.coalesce("_p.relations", none(schema.RELATION)), valid_relations, _relation_reason)}
    bad = F.concat(*(F.slice(F.filter(F.transform(items, why), lambda x: x.isNotNull()), 1, MOST_REASONS) for items, _, why in given.values()))
    out = out.withColumns({name: valid(items) for name, (items, valid, _) in given.items()} | {"reasons": bad})
    out = out.withColumns({f"dropped_{name}": (offered(name) - F.size(name)).cast("int") for name in given})
    any_bad = (F.col("dropped_entities") > 0) | (F.col("dropped_relations") > 0)
    failure = F.when(~F.coalesce(F.col("_root").startswith("{"), F.lit(False)), "parse_error").when(~listed("entities") | ~listed("relations"), "schema_error")
    failure = failure.when(any_bad, "schema_error") if strict else failure.when(F.size("entities") == 0, "tolerant_drop_all")
    out = out.withColumn("failure", failure).withColumn("dropped", F.col("dropped_entities") + F.col("dropped_relations"))
    kept = {name: F.when(F.col("failure") == "schema_error", none(kind)).otherwise(F.col(name)) for name, kind in (("entities", schema.ENTITY), ("relations", schema.RELATION))}
    return (out.withColumns(kept) if strict else out).drop("_p", "_root")


def payload_entities(df: DataFrame, payload: str = "payload") -> DataFrame:
    """Adds `entities` of an answer that is a list of entities, an object that has them, or one entity; null for
    anything else."""
    whole = F.regexp_extract(payload, r"(\[\s*\{[\s\S]*\}\s*,?\s*\])", 1)
    listed = F.from_json(F.when(whole != "", F.regexp_replace(whole, r",\s*([}\]])", "$1")), f"array<{schema.ENTITY}>")
    held = F.from_json(text.json_object(payload), PAYLOAD)["entities"]
    one = F.from_json(text.json_object(payload), schema.ENTITY)
    single = F.when(one["type"].isNotNull(), F.array(one))
    return df.withColumn("entities", valid_entities(F.coalesce(listed, held, single)))


def with_mentions(entities: Column, body: Column) -> Column:
    """Entities and, as properties, the numbers with units of the text that no property of theirs says already."""
    said = F.transform(F.filter(entities, lambda e: e["type"] == "Property"), lambda e: F.lower(e["value"]))
    found = F.filter(text.numeric_mentions(body), lambda v: ~F.array_contains(said, F.lower(v)))
    return F.concat(entities, F.transform(found, lambda v: F.struct(F.lit("Property").alias("type"), v.alias("value"))))


Reader = Callable[[Column], Column]
#: Fixed value: an author that is none.
NO_AUTHOR = "Не указан"


def process_chunks(chunks: DataFrame, known: DataFrame, reader: Reader | None = None) -> DataFrame:
    """chunks (id, filename, text, year, experts array; title, section, index, content_type if there) as experiments with
    their outcome: status, reason, failure and what validation dropped.

    What is known is skipped, what says nothing is empty, and only the rest is read: `reader` maps the text column, null
    for chunks that aren't to be read, to a model's JSON answer, and may be a UDF. Without one, numbers with units are
    what a text says. A refusal is moderation, an answer that doesn't validate has failed, and one without a domain's
    entity is empty."""
    old = known.select(F.col("id").alias("_old")).distinct()
    tested = chunks.join(old, chunks["id"] == F.col("_old"), "left").withColumn("low_signal", text.low_signal_reason("text"))
    read = F.col("_old").isNull() & F.col("low_signal").isNull()
    none = F.array().cast(f"array<{schema.ENTITY}>")
    if reader is None:
        found = tested.withColumns({"entities": none, "relations": F.array().cast(f"array<{schema.RELATION}>"), "failure": F.lit(None).cast("string"), "refused": F.lit(False), "dropped_entities": F.lit(0), "dropped_relations": F.lit(0)})
    else:
        answered = tested.withColumn("payload", reader(F.when(read, F.col("text"))))
        found = parse_payload(answered).withColumn("refused", text.is_refusal("payload")).drop("payload")
    own = F.when(read & F.col("failure").isNull(), with_mentions(F.col("entities"), F.col("text"))).otherwise(none)
    found = found.withColumn("entities", own)
    domain = F.exists("entities", lambda e: e["type"].isin(schema.DOMAIN_TYPES))
    status = F.when(F.col("_old").isNotNull(), "skipped").when(F.col("low_signal").isNotNull(), "empty").when(F.col("refused"), "moderation").when(F.col("failure").isNotNull(), "validation_failed").when(domain, "ok").otherwise("empty")
    reason = F.when(F.col("_old").isNotNull(), None).when(F.col("low_signal").isNotNull(), F.col("low_signal")).when(~F.col("refused") & F.col("failure").isNull() & ~domain, "weak_domain_evidence")
    failure = F.when(status == "validation_failed", F.col("failure")).when(status == "empty", "empty")
    has = lambda name, default: F.col(name) if name in chunks.columns else default
    title = has("title", F.col("filename"))
    name = F.format_string("%s (Раздел %s, Чанк %s, %s, %s)", title, has("section", F.lit("Введение")), has("index", F.lit(0)).cast("string"), has("chunk_version", F.lit("cn_v1")), has("content_type", F.lit("text")))
    role = lambda r: F.filter("entities", lambda e: text.entity_role(e["type"], e["value"]) == r)
    people = F.transform(F.filter("experts", lambda x: x != NO_AUTHOR), lambda e: F.struct(F.lit("Expert").alias("type"), e.alias("value")))
    return found.select(
        "id", F.lit(0).cast("long").alias("ord"), name.alias("name"), F.concat(role("input"), F.array(F.struct(F.lit("Publication").alias("type"), title.alias("value")))).alias("input_entities"),
        F.concat(role("process"), people).alias("process_entities"), role("output").alias("output_entities"), "relations", F.array("filename").alias("evidence"), F.lit(0.95).alias("confidence"), "year",
        text.guess_geography("text", "filename").alias("geography"), F.lit("report").alias("source_type"), text.is_sensitive("text").alias("is_sensitive"),
        status.alias("status"), reason.alias("reason"), failure.alias("failure_class"), "dropped_entities", "dropped_relations", "filename",
    )


def experiments_of(outcomes: DataFrame) -> DataFrame:
    """The experiments that came of chunks."""
    return outcomes.where("status = 'ok'").select("id", "ord", "name", "input_entities", "process_entities", "output_entities", "relations", "evidence", "confidence", "year", "geography", "source_type", "is_sensitive")


def files_with_news(chunks: DataFrame, known: DataFrame, most: int | None = None) -> DataFrame:
    """filename, chunks, new: files in order (filename) that have chunks not known yet; at most so many of them."""
    flagged = chunks.join(known.select(F.col("id").alias("_old")).distinct(), chunks["id"] == F.col("_old"), "left")
    files = flagged.groupBy("filename").agg(F.count("*").alias("chunks"), F.count_if(F.col("_old").isNull()).alias("new")).where("new > 0").orderBy("filename")
    return files if most is None else files.limit(most)


def _run(n: int) -> Callable[[Column], Column]:
    return lambda i: F.concat_ws(" ", F.slice("_w", i, F.lit(n)))


#: Words that values may begin with so that they are looked for within a text's row.
MOST_FIRST_WORDS = 10_000


def match_vocabulary(texts: DataFrame, vocabulary: DataFrame, id_: str, column: str) -> DataFrame:
    """id, value for each vocabulary value that a text holds as whole words in order.

    A text's runs that begin like a value are found within its row, and only these meet the values in an equi-join; with
    more first words than that is good for, all runs do. So work goes with the texts' size and not with texts times
    values, and no row beside the text's own carries it."""
    values = vocabulary.select(text.normalize_value("value").alias("value")).where("value <> ''").distinct().withColumns({"_n": F.size(F.split("value", " ")), "_first": F.substring_index("value", " ", 1)})
    firsts = values.select("_n", "_first").distinct().limit(MOST_FIRST_WORDS + 1).collect()
    own = texts.select(id_, F.split(text.normalize_value(column), " ").alias("_w"))
    few = len(firsts) <= MOST_FIRST_WORDS
    lengths = sorted({r[0] for r in firsts} if few else {r[0] for r in values.select("_n").distinct().collect()})
    parts = []
    for n in lengths:
        runs = _runs_of(n, [r[1] for r in firsts if r[0] == n] if few else None)
        parts.append(own.where(F.size("_w") >= n).select(id_, F.explode(F.array_distinct(runs)).alias("value")).join(values.where(F.col("_n") == n).select("value"), "value"))
    return reduce(DataFrame.unionByName, parts).select(id_, "value") if parts else texts.select(id_, F.lit("").alias("value")).limit(0)


def _runs_of(n: int, begin: list[str] | None) -> Column:
    """The runs of n words of the array _w, of those that begin like this if given."""
    if n == 1:
        return F.col("_w") if begin is None else F.filter("_w", lambda w: w.isin(begin))
    if begin is None:
        return F.transform(F.sequence(F.lit(1), F.size("_w") - n + 1), _run(n))
    places = F.transform("_w", lambda w, i: F.when(w.isin(begin) & (i <= F.size("_w") - n), i + 1))
    return F.transform(F.filter(places, lambda i: i.isNotNull()), _run(n))
