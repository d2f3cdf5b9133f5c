"""Similarity search with metadata filters, evidence gate, hybrid reranking and paging."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.functions import text, vectors
from hyperloom.operators import bundles
from hyperloom.sources.scratch import written


def metadata_filter(df: DataFrame, f: schema.SearchFilter) -> DataFrame:
    """Rows whose attribute is null pass; only a present attribute that doesn't match rejects. Plain columns, so
    the conditions reach the scan."""
    if f.exclude_sensitive:
        df = df.where(~F.col("is_sensitive"))
    tests = []
    if f.year_start is not None:
        tests.append(("year", F.col("year") >= f.year_start))
    if f.year_end is not None:
        tests.append(("year", F.col("year") <= f.year_end))
    if f.geography:
        tests.append(("geography", F.contains(F.lower("geography"), F.lit(f.geography.lower()))))
    if f.source_type:
        tests.append(("source_type", F.lower("source_type") == f.source_type.lower()))
    for name, ok in tests:
        df = df.where(F.col(name).isNull() | ok)
    return df


def sanitize(query: DataFrame, least: int = 3) -> DataFrame:
    """Query entities (pos, type, value) with normalised values of some length, the first of each key."""
    key = text.entity_key("type", "value")
    first = Window.partitionBy("key").orderBy("pos")
    return query.withColumn("key", key).where(F.length(text.normalize_value("value")) >= least).withColumn("n", F.row_number().over(first)).where("n = 1").drop("n")


def parse(question: str, known: DataFrame) -> DataFrame:
    """type, value: the entities that a question names, from known values (type, value), number patterns and a small
    vocabulary; the first of each key, longer values first."""
    spark = known.sparkSession
    low = F.lower(F.lit(question))
    values = known.where(F.col("type").isin(schema.ENTITY_TYPES)).select("type", text.normalize_value("value").alias("value")).distinct()
    found = values.where(text.matches_value(text.normalize_value(F.lit(question)), F.col("value"))).withColumn("source", F.lit(0))
    numbers = spark.range(1).select(F.explode(text.query_properties(F.lit(question))).alias("value")).select(F.lit("Property").alias("type"), "value", F.lit(1).alias("source"))
    words = spark.createDataFrame(text.VOCABULARY, "term string, type string, value string").where(text.contains_term(low, F.col("term"))).select("type", "value", F.lit(2).alias("source"))
    every = found.unionByName(numbers).unionByName(words).withColumn("pos", F.col("source") * 10_000 - F.length("value"))
    return sanitize(every).select("type", "value")


# --- three-part vectors in the JVM ---------------------------------------------------------------------------------


def role_filler(kind: str, value: Column | str, dim: int = 256) -> Column:
    return vectors.bind_words(vectors.word_vector(F.lit(f"Role:{kind}"), dim), vectors.word_vector(text.entity_key(F.lit(kind), value), dim))


def encode_triples(rows: DataFrame, dim: int = 256) -> DataFrame:
    """(material, process, facility, hv) for each combination that occurs: Material and Process weigh 2, Facility 1.

    Vectors depend on the combination only, so they are made once for each value and combined once for each
    combination, never once for each experiment."""
    combos = rows.select("material", "process", "facility").distinct()
    return _encoded_combos(combos, dim).select("material", "process", "facility", "hv")


def _encoded_combos(combos: DataFrame, dim: int) -> DataFrame:
    """combos (material, process, facility and more) with hv; without those that lack a value."""
    parts = {k: combos.select(k).distinct().withColumn(f"{k}_hv", role_filler(k.capitalize(), k, dim)) for k in ("material", "process", "facility")}
    for k, codebook in parts.items():
        combos = combos.join(codebook, k)
    return combos.withColumn("hv", vectors.majority_words(F.col("material_hv"), F.col("process_hv"), F.col("facility_hv"))).drop("material_hv", "process_hv", "facility_hv")


def query_vector(material: str, process: str, facility: str, dim: int = 256) -> Column:
    """Unweighted: three vectors have a majority whatever their order."""
    return vectors.majority_words(*(role_filler(k, F.lit(v), dim) for k, v in (("Material", material), ("Process", process), ("Facility", facility))))


#: Combinations (of 32 bytes and three names) whose similarities are broadcast at most; beyond it, they are joined by
#: a shuffle.
BROADCAST_COMBINATIONS = 1_000_000


def search_triples(rows: DataFrame, material: str, process: str, facility: str, f: schema.SearchFilter, dim: int = 256) -> DataFrame:
    """rows with their similarity to the query. Filters apply before anything else. The combinations are found by one
    pass over three columns and written; if they are few, as usual, the rows themselves aren't shuffled."""
    kept = metadata_filter(rows, f)
    query = kept.sparkSession.range(1).select(query_vector(material, process, facility, dim).alias("q"))
    combos = written(kept.select("material", "process", "facility").distinct())
    scored = encode_triples(combos, dim).crossJoin(F.broadcast(query)).select("material", "process", "facility", vectors.similarity_words(F.col("hv"), F.col("q"), dim).alias("similarity"))
    few = combos.count() <= BROADCAST_COMBINATIONS
    return kept.join(F.broadcast(scored) if few else scored, ["material", "process", "facility"])


def top_hits(rows: DataFrame, questions: DataFrame, k: int, f: schema.SearchFilter = schema.SearchFilter(), dim: int = 256) -> DataFrame:
    """question, rank, hits and the rows' columns with their similarity: the k best rows of each of a few questions
    (question, material, process, facility), ties by id; `hits` is the number of all rows that pass the filter.

    Rows of one combination are alike, so a combination that k others are ahead of has no row among the best. Only
    rows of the combinations left are ranked. The combinations are counted by one pass and written, and so is what is found
    by another: k rows for each question, which later steps read as often as they like."""
    kept = metadata_filter(rows, f)
    hv = vectors.majority_words(*(role_filler(x, F.col(x.lower()), dim) for x in ("Material", "Process", "Facility"))).alias("q")
    asked = F.broadcast(questions.select("question", hv))
    combos = written(kept.groupBy("material", "process", "facility").agg(F.count("*").alias("n")))
    scored = _encoded_combos(combos, dim).crossJoin(asked).select("question", "material", "process", "facility", vectors.similarity_words(F.col("hv"), F.col("q"), dim).alias("similarity"))
    ahead = F.rank().over(Window.partitionBy("question").orderBy(F.desc("similarity")))
    best = written(scored.withColumn("ahead", ahead).where(F.col("ahead") <= k).drop("ahead"))
    best = F.broadcast(best) if best.count() <= BROADCAST_COMBINATIONS else best
    rank = F.row_number().over(Window.partitionBy("question").orderBy(F.desc("similarity"), "id"))
    found = kept.join(best, ["material", "process", "facility"]).withColumn("rank", rank).where(F.col("rank") <= k)
    return written(found).crossJoin(F.broadcast(combos.agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("hits"))))


def top_k(scored: DataFrame, k: int, score: str = "similarity", tie: str = "id", skip: int = 0) -> DataFrame:
    out = scored.orderBy(F.desc(score), tie)
    return (out.offset(skip) if skip else out).limit(k)


# --- full-dimension encoding ---------------------------------------------------------------------------------------


def _fillers(experiments: DataFrame) -> DataFrame:
    """id, parts, weights: what an experiment's vector is bundled from, as texts that say how to make each part, so that
    equal parts are made once. Relations' endpoints resolve to the first entity of that value."""
    sep, inner = F.lit("\u0001"), F.lit("\u0002")

    def placed(e: Column) -> Column:
        number = F.when(e["type"] == "Property", text.numeric_property(e["value"]))

        def filler(n: Column) -> Column:
            named = F.concat(F.lit("E"), inner, text.entity_key(e["type"], e["value"]))
            return F.when(n.isNull(), named).otherwise(text.bound(text.position_in_range(n), lambda at: F.when(at.isNotNull(), F.concat(F.lit("N"), inner, F.lower(n["name"]), inner, at.cast("string"))).otherwise(named)))

        weight = F.greatest(F.lit(1), *(F.when(e["type"] == t, w) for t, w in schema.BUNDLE_WEIGHTS.items()))
        part = lambda f: F.struct(F.lower(text.strip(e["value"])).alias("v"), f.alias("f"), F.concat(F.lit("B"), sep, e["type"], sep, f).alias("part"), weight.alias("w"))
        return text.bound(number, lambda n: text.bound(filler(n), part))  # each computed once, as lambdas share nothing

    own = experiments.select("id", "relations", F.transform(F.concat("input_entities", "process_entities", "output_entities"), placed).alias("own"))
    end = lambda value: text.bound(F.lower(text.strip(value)), lambda v: F.get(F.filter("own", lambda e: e["v"] == v)["f"], F.lit(0)))
    related = F.transform(F.coalesce("relations", F.array().cast(f"array<{schema.RELATION}>")), lambda r: F.concat(F.lit("R"), sep, r["type"], sep, end(r["source"]), sep, end(r["target"])))
    related = F.filter(related, lambda x: x.isNotNull())
    weights = F.concat(F.transform("own", lambda e: e["w"]), F.transform(related, lambda x: F.lit(1)))
    return own.select("id", F.concat(F.transform("own", lambda e: e["part"]), related).alias("parts"), weights.alias("weights"))


def encode_experiments(experiments: DataFrame, dim: int = vectors.FULL, semantic: bool = True, tasks: int | None = None, against: np.ndarray | None = None, make=vectors.generate) -> DataFrame:
    """id and the packed vector hv of each experiment: its role-filler bindings (Material and Process weigh 2) and its
    relations, permute(source) * type * target. With a query's vector `against`, id and similarity instead, and no vector
    leaves its task. Entities are columns of the row, so nothing is shuffled; `tasks` deals rows of few files out."""
    query = None if against is None else np.frombuffer(vectors.pack(against), np.uint8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Experiments share what breaks their ties, so that it doesn't set like ones apart.
        book, parts, even = vectors.Codebook(dim, semantic, make=make), {}, vectors.tie("experiments", dim, make)

        def filler(code: str) -> np.ndarray:
            kind, _, rest = code.partition("\u0002")
            if kind == "E":
                return book(rest)
            base, _, at = rest.rpartition("\u0002")
            return vectors.blend(book(f"NumericBase:{base}:min"), book(f"NumericBase:{base}:max"), float(at))

        def made(part: str) -> np.ndarray:
            kind, first, *rest = part.split("\u0001")
            if kind == "B":
                return vectors.bind(book(f"Role:{first}"), filler(rest[0]))
            return vectors.bind(vectors.permute(filler(rest[0])), book(f"RelationType:{first}")) if kind == "R" else filler(first)

        def kept(part: str) -> np.ndarray:
            if part not in parts:
                if len(parts) >= book.most:  # a bounded number is kept
                    parts.clear()
                parts[part] = made(part)
            return parts[part]

        related = np.empty(dim, np.int8)
        for batch in batches:
            out = []
            for id_, own, weights in zip(batch.column("id").to_pylist(), batch.column("parts").to_pylist(), batch.column("weights").to_pylist()):
                total = np.zeros(dim, np.int8 if sum(weights) < 128 else np.int32)
                for part, w in zip(own, weights):
                    if part[0] == "R":  # its two ends are kept, as there are many more pairs of them
                        source, _, target = part.rpartition("\u0001")
                        np.multiply(kept(source), kept(f"T\u0001{target}"), out=related)
                        np.add(total, related, out=total)
                    else:
                        for _ in range(w):
                            np.add(total, kept(part), out=total)
                if not own:
                    total = make(f"empty|{id_}", dim)
                hv = np.packbits((total > 0) | ((total == 0) & (even > 0)))
                out.append(hv.tobytes() if query is None else 1 - 2 * int(np.bitwise_count(hv ^ query).sum(dtype=np.int64)) / dim)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(out, pa.binary() if query is None else pa.float64())], ["id", "hv" if query is None else "similarity"])

    rows = _fillers(experiments.repartition(tasks, "id") if tasks else experiments)
    return rows.mapInArrow(run, "id string, hv binary" if query is None else "id string, similarity double")


def encode_words(experiments: DataFrame, dim: int = vectors.FULL, word=bundles.hashed_word, semantic: bundles.Semantic | None = None) -> DataFrame:
    """id, w, word: the same bundles word by word, without a Python worker. `bundles.similarities` compares them with a
    question's, `bundles.as_arrays` puts them together. With `semantic`, entities have vectors by what they mean; only those
    of new keys are made by Python workers."""
    return bundles.bundled_words(_fillers(experiments), dim, "experiments", word, semantic)


def query_words(query: DataFrame, dim: int = vectors.FULL, word=bundles.hashed_word, semantic: bundles.Semantic | None = None) -> list[int] | None:
    """The words of the unweighted bundle of a question's few entities (type, value); None if there are none."""
    held = query.agg(F.sort_array(F.collect_list(F.struct("type", "value"))).alias("input_entities"))
    none = lambda kind: F.array().cast(f"array<{kind}>")
    one = held.select(F.lit("query").alias("id"), "input_entities", none(schema.ENTITY).alias("process_entities"), none(schema.ENTITY).alias("output_entities"), none(schema.RELATION).alias("relations"))
    parts = _fillers(one).withColumn("weights", F.transform("weights", lambda w: F.lit(1)))
    row = bundles.as_arrays(bundles.bundled_words(parts.where(F.size("parts") > 0), dim, "query", word, semantic), dim).first()
    return row and row.hv


def encode_query(query: list[tuple[str, str]], dim: int = vectors.FULL, semantic: bool = True, positions: dict | None = None, make=vectors.generate):
    """The unweighted bundle of a few query entities, on the driver; positions: {value: (base, position)}."""
    book = vectors.Codebook(dim, semantic, make=make)
    parts = []
    for kind, value in query:
        if positions and value in positions:
            base, at = positions[value]
            filler = vectors.blend(book(f"NumericBase:{base}:min"), book(f"NumericBase:{base}:max"), at)
        else:
            filler = book(f"{kind}:{' '.join(value.lower().split())}")
        parts.append(vectors.bind(book(f"Role:{kind}"), filler))
    return vectors.bundle(parts, owner="query", make=make)


def query_hv(query: DataFrame, dim: int = vectors.FULL, semantic: bool = True, make=vectors.generate) -> np.ndarray | None:
    """The vector of a question's few entities (type, value); None if there are none."""
    rows = query.select("type", "value", F.lower(text.numeric_property("value")["name"]).alias("base"), F.when(F.col("type") == "Property", text.property_position("value")).alias("position")).collect()
    return encode_query([(r.type, r.value) for r in rows], dim, semantic, {r.value: (r.base, r.position) for r in rows if r.position is not None}, make) if rows else None


def search(encoded: DataFrame, experiments: DataFrame, query: DataFrame, limit: int = 5, f: schema.SearchFilter = schema.SearchFilter(), dim: int = vectors.FULL, semantic: bool = True) -> DataFrame:
    """The experiments most similar to the query entities (type, value); none without query entities."""
    hv = query_hv(query, dim, semantic)
    if hv is None:
        return experiments.limit(0).withColumn("similarity", F.lit(0.0))
    hits = metadata_filter(experiments, f).join(encoded, "id").withColumn("similarity", vectors.similarity_to(hv)("hv")).drop("hv")
    return top_k(hits, limit)


def nearest(rows: DataFrame, queries: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """query, vec_id, similarity: the k rows (vec_id, embedding) of the largest cosine for each query, itself left out.

    Queries come in blocks of bounded size, one pass over the rows for each. A task hands on its own k best of each
    query, so the shuffle carries k rows for each query and batch."""
    spark, parts, held = rows.sparkSession, [], []

    def passing(ids: np.ndarray, vectors_: np.ndarray) -> DataFrame:
        sent = spark.sparkContext.broadcast((ids, vectors_ / np.maximum(np.linalg.norm(vectors_, axis=1, keepdims=True), 1e-30)))

        def run(batches):
            wanted, units = sent.value
            for batch in batches:
                own = batch["vec_id"].to_numpy()
                x = np.stack(batch["embedding"].to_list()).astype(np.float64)
                s = units @ (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)).T
                s[wanted[:, None] == own] = -np.inf
                best = np.argsort(-s, axis=1, kind="stable")[:, :k]
                q = np.repeat(np.arange(len(wanted)), best.shape[1])
                out = pd.DataFrame({"query": wanted[q], "vec_id": own[best.ravel()], "similarity": s[q, best.ravel()]})
                yield out[np.isfinite(out["similarity"])]

        return rows.select("vec_id", "embedding").mapInPandas(run, "query long, vec_id long, similarity double")

    def flush() -> None:
        parts.append(passing(np.array([r[0] for r in held], np.int64), np.array([r[1] for r in held], np.float64)))
        held.clear()

    for r in queries.select("vec_id", "embedding").toLocalIterator():
        held.append(r)
        if len(held) == block:
            flush()
    if held:
        flush()
    if not parts:
        return spark.createDataFrame([], "query long, vec_id long, similarity double")
    best = Window.partitionBy("query").orderBy(F.desc("similarity"), "vec_id")
    every = reduce(DataFrame.unionByName, parts)
    return every.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


# --- gate ------------------------------------------------------------------------------------------------------------


def entity_overlap(query_keys: Column, keys: Column) -> Column:
    """Share of the query's distinct keys that the experiment has."""
    return F.when(F.size(query_keys) > 0, F.size(F.array_intersect(query_keys, keys)) / F.size(F.array_distinct(query_keys))).otherwise(0.0)


def scope_signals(query: DataFrame, generic: list[str] = schema.GENERIC_VALUES, *keys: str) -> DataFrame:
    """One row about the query entities (type, value), or one for each question if its columns are named."""
    domain, n = F.col("type").isin(schema.DOMAIN_TYPES), F.count("*")
    value = text.normalize_value("value")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return query.groupBy(*keys).agg(
        n.alias("n"), F.count_if(domain).alias("domain"), zero(F.count_if(domain) / F.nullif(n, F.lit(0))).alias("domain_ratio"), F.count_if(value.isin(generic)).alias("generic"),
        zero(F.count_if(value.isin(generic)) / F.nullif(n, F.lit(0))).alias("generic_ratio"), zero(F.avg(F.length(value))).alias("mean_length"),
    )


def confidence_signals(ranked: DataFrame, *keys: str) -> DataFrame:
    """One row about hits (rank from 1, id, similarity, overlap), or one for each question; the first five count. `hits`
    is the number of all hits if ranked has it, else of those given."""
    top = F.col("rank") <= 5
    at = lambda r: F.max(F.when(F.col("rank") == r, F.col("similarity")))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    hits = F.coalesce(F.max("hits"), F.lit(0)) if "hits" in ranked.columns else F.count("*")
    return ranked.groupBy(*keys).agg(
        zero(at(1)).alias("top1"), zero(F.avg(F.when(top, F.col("similarity")))).alias("top5_mean"), zero(at(1) - F.coalesce(at(2), at(1))).alias("margin"),
        zero(F.max(F.when(top, F.col("overlap")))).alias("overlap"), F.count_distinct(F.when(top, text.source_family("id"))).alias("families"), hits.alias("hits"),
    )


def gate(signals: DataFrame, t: schema.GateThresholds = schema.GateThresholds()) -> DataFrame:
    """Adds stage, reason and should_empty to rows of both kinds of signals; the first rule that holds decides."""
    c = F.col
    weak = (c("domain") == 0) | ((c("n") >= 3) & (c("mean_length") < 4))
    rules = [
        ("scope", "no_entities", c("n") == 0),
        ("scope", "weak_parse", weak),
        ("scope", "ood_scope", (1 - c("domain_ratio") >= 0.5) & (c("hits") > 0) & (c("top1") < 0.12)),
        ("scope", "ood_scope", (c("generic") >= 1) & (c("domain_ratio") <= 0.5) & (c("top1") < 0.15) & (c("n") <= 6)),
        ("scope", "ood_scope", (c("generic_ratio") >= 0.5) & (c("n") <= 4) & (c("overlap") <= 0)),
        ("scope", "ood_scope", (c("hits") > 0) & (c("overlap") <= 0) & (c("top1") < t.modest)),
        ("confidence", "no_hits", c("hits") == 0),
        ("confidence", "low_confidence", (c("top1") < t.top) | (c("top1") < t.low)),
        ("confidence", "low_confidence", (c("margin") < t.margin) & (c("overlap") < t.margin_overlap) & (c("top1") < t.margin_top)),
        ("confidence", "low_confidence", (c("families") <= 1) & (c("top1") < t.family_top) & (c("overlap") < t.family_overlap) & (c("hits") >= 3)),
        ("confidence", "needs_clarification", (c("n") <= 1) & (c("top1") >= t.low) & (c("top1") < t.clarify_high) & (c("overlap") < t.family_overlap)),
    ]
    verdict = F.struct(F.lit("").alias("stage"), F.lit("").alias("reason"))
    for stage, reason, holds in reversed(rules):
        verdict = F.when(holds, F.struct(F.lit(stage).alias("stage"), F.lit(reason).alias("reason"))).otherwise(verdict)
    return signals.withColumn("_v", verdict).withColumns({"stage": F.col("_v.stage"), "reason": F.col("_v.reason"), "should_empty": F.col("_v.reason") != ""}).drop("_v")


# --- rerank ------------------------------------------------------------------------------------------------------------


def source_quality(source_type: Column, confidence: Column, evidence: Column) -> Column:
    kind = F.lower(F.coalesce(source_type, F.lit("")))
    base = F.when(kind.isin("article", "patent", "gost", "report"), 0.6).when(kind != "", 0.3).otherwise(0.0)
    sure = F.coalesce(0.4 * F.greatest(F.lit(0.0), F.least(F.lit(1.0), confidence)), F.lit(0.0))
    return F.least(F.lit(1.0), base + sure + F.least(F.lit(0.2), 0.05 * F.greatest(F.size(evidence), F.lit(0))))


def graph_support(has_path: Column, has_evidence: Column, has_role: Column) -> Column:
    return F.when(has_path, F.least(F.lit(1.0), 0.5 + F.when(has_evidence, 0.3).otherwise(0.0) + F.when(has_role, 0.2).otherwise(0.0))).otherwise(0.0)


def hybrid(similarity: Column, entity: Column, metric: Column, graph: Column, source: Column, raw: Column, w: schema.RerankWeights = schema.RerankWeights()) -> Column:
    return w.similarity * similarity + w.entity * entity + w.metric * metric + w.graph * graph + w.source * source - w.raw * raw.cast("double")


def query_keys(query: DataFrame, *keys: str) -> DataFrame:
    """For each question its entities' keys and the names of its properties, as arrays; a question has a few entities."""
    key = text.normalize_value(F.concat("type", F.lit(":"), "value"))
    name = F.when(F.col("type") == "Property", text.normalize_value(F.substring_index("value", ":", 1)))
    return query.groupBy(*keys).agg(F.collect_set(key).alias("query_keys"), F.collect_set(name).alias("query_names"))


def own_keys() -> Column:
    every = F.concat("input_entities", "process_entities", "output_entities")
    return F.transform(every, lambda e: text.normalize_value(F.concat(e["type"], F.lit(":"), e["value"])))


def rerank(hits: DataFrame, query: list[tuple[str, str]] | DataFrame, graph: DataFrame | None = None, *keys: str) -> DataFrame:
    """hits (an experiment's columns, rank, similarity) by hybrid score. Raw similarity stays as it is; `graph` has
    (id, has_path, has_evidence, has_role). The query's entities (type, value) are a list, or a table of a few questions
    with the columns that name them (keys), which hits have too."""
    if not isinstance(query, DataFrame):
        query = hits.sparkSession.createDataFrame(query, "type string, value string")
    asked = F.broadcast(query_keys(query, *keys))
    out = hits.join(asked, list(keys)) if keys else hits.crossJoin(asked)
    every = F.concat("input_entities", "process_entities", "output_entities")
    own_names = F.transform(F.filter(every, lambda e: e["type"] == "Property"), lambda e: text.normalize_value(F.substring_index(e["value"], ":", 1)))
    metric = F.when(F.size("query_names") > 0, F.size(F.array_intersect("query_names", own_names)) / F.size("query_names")).otherwise(0.0)
    if graph is not None:
        out = out.join(graph, "id", "left")
    support = graph_support(F.coalesce("has_path", F.lit(False)), F.coalesce("has_evidence", F.lit(False)), F.coalesce("has_role", F.lit(False))) if graph is not None else F.lit(0.0)
    parts = {"entity_overlap": entity_overlap(F.col("query_keys"), own_keys()), "metric_overlap": metric, "graph_support": support, "source_quality": source_quality(F.col("source_type"), F.col("confidence"), F.col("evidence")), "raw_penalty": text.raw_noise("id").cast("double")}
    out = out.withColumns(parts).drop("query_keys", "query_names")
    return out.withColumn("hybrid", hybrid(F.col("similarity"), *(F.col(c) for c in parts))).orderBy(F.desc("hybrid"), "rank")


def graph_flags(graph_edges: DataFrame, ids: DataFrame) -> DataFrame:
    """id, has_path, has_evidence, has_role of experiments (id): what kinds of edges leave each."""
    own = graph_edges.join(ids.select("id").distinct(), graph_edges["source"] == ids["id"], "left_semi")
    return own.groupBy(F.col("source").alias("id")).agg(F.lit(True).alias("has_path"), F.bool_or(F.col("type") == "EVIDENCE_FROM").alias("has_evidence"), F.bool_or(F.col("type").startswith("HAS_")).alias("has_role"))


#: Hits that are reranked at least.
POOL = 20


def pool_and_tail(ranked: DataFrame, pool: int = POOL, skip: int = 0, limit: int = 5) -> DataFrame:
    """ranked (rank, similarity, hybrid): the pool by hybrid score, then the tail, which keeps its raw score."""
    size = max(pool, skip + limit)
    inside = F.col("rank") <= size
    return ranked.withColumn("segment", F.when(inside, 0).otherwise(1)).withColumn("shown", F.when(inside, F.col("hybrid")).otherwise(F.col("similarity"))).orderBy("segment", F.desc("shown"), "rank")
