"""The model's operators on the six seed experiments and on small tables."""

import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.engine import Engine
from hyperloom.functions import text, vectors
from hyperloom.operators import browse, chunks, counterfactual, entities, evaluate, gaps, graph, ingest, search
from hyperloom.policy import Session
from hyperloom.sources import readers
from hyperloom.sources.seed import seed
from hyperloom.sources.store import Store
from hyperloom.streaming import outbox


def value(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], ", ".join(f"{k} string" for k in row)).select(column.alias("x")).first().x


def test_vector_algebra():
    a, b, c = (vectors.generate(x) for x in "abc")
    assert vectors.similarity(a, a) == 1 and abs(vectors.similarity(a, b)) < 0.05
    assert np.array_equal(vectors.bind(vectors.bind(a, b), b), a)
    assert np.array_equal(vectors.permute(vectors.permute(a), -1), a)
    together = vectors.bundle([a, b, c])
    assert all(vectors.similarity(together, x) > 0.4 for x in (a, b, c))
    assert vectors.similarity(vectors.bundle([a, b, c], [3, 1, 1]), a) > vectors.similarity(together, a)
    assert np.array_equal(vectors.unpack(vectors.pack(a)), a)
    with pytest.raises(ValueError):
        vectors.bundle([])
    with pytest.raises(ValueError):
        vectors.bundle([a, b], [1])


def test_blends_order_by_distance():
    low, high = vectors.generate("low"), vectors.generate("high")
    at = [vectors.blend(low, high, p) for p in (0.1, 0.2, 0.9)]
    assert vectors.similarity(at[0], at[1]) > vectors.similarity(at[0], at[2])


def test_trigrams_know_likeness():
    e = [vectors.trigram_embedding(x) for x in ("nickel electrolyte", "nickel electrolytes", "heap leaching")]
    assert e[0] @ e[1] > 0.7 > 0.4 > e[0] @ e[2]
    assert not vectors.trigram_embedding("  ").any()


def test_words_and_numpy_agree_on_algebra(spark):
    row = spark.range(1).select(vectors.word_vector(F.lit("a")).alias("a"), vectors.word_vector(F.lit("b")).alias("b"))
    r = row.select(vectors.similarity_words(F.col("a"), F.col("a")).alias("same"), vectors.similarity_words(F.col("a"), F.col("b")).alias("other"), vectors.similarity_words(vectors.bind_words(vectors.bind_words(F.col("a"), F.col("b")), F.col("b")), F.col("a")).alias("back")).first()
    assert r.same == 1 and abs(r.other) < 0.3 and r.back == 1


@pytest.mark.parametrize(
    ("raw", "want"),
    [("pH < 2.0", ("pH", "<", 2.0, "")), ("pH: 2,5", ("pH", "", 2.5, "")), ("pH >= 3", ("pH", "≥", 3.0, "")), ("temp: 45°C", ("temp", "", 45.0, "°C")), ("current density: 300", None), ("nickel", None), ("", None)],
)
def test_numeric_property(spark, raw, want):
    got = value(spark, text.numeric_property("v"), v=raw)
    assert (tuple(got) if got else None) == want


def test_multiword_names(spark):
    assert value(spark, text.numeric_property("v", True), v="плотность тока: 300 А/м2").number == 300


def test_normalisation(spark):
    assert value(spark, text.normalize_value("v"), v="  Nickel \t  Ore ") == "nickel ore"
    assert value(spark, text.normalize_key("v"), v="NumericBase: pH :max") == "NumericBase:ph:max"
    assert value(spark, text.normalize_key("v"), v="Role:Material") == "Role:Material"
    assert value(spark, text.slug("v"), v="dir/My file (1).docx") == "MY-FILE-1"
    assert value(spark, text.normalize_code("v"), v="ти – 7 — 2020") == "ТИ-07-2020"
    assert value(spark, text.relation_type("v"), v=" Located in ") == "located_at"
    assert value(spark, text.relation_type("v"), v="whatever") is None
    assert value(spark, text.redact("v"), v="key sk-abcdefghijklmnopqrstuv Bearer x.y") == "key [REDACTED] [REDACTED]"
    assert value(spark, text.repair_json("v"), v='Sure:\n```json\n{“a”: [1,],}\n```') == '{"a": [1]}'
    assert value(spark, text.label_type("v"), v="Flotation plant") == "Process"


def test_numbers_with_units(spark):
    got = value(spark, text.numeric_mentions("v"), v="at 45 °C, 300 А/м² gives 95 %, > 5 мг/л and 95 % again")
    assert got == ["45 °C", "300 А/м²", "95 %", "5 мг/л", "> 5 мг/л"]


def test_low_signal(spark):
    assert value(spark, text.low_signal_reason("v"), v=None) == "too_short"
    assert value(spark, text.low_signal_reason("v"), v="1 2 3 " * 20) == "slide_number"
    assert value(spark, text.low_signal_reason("v"), v="nothing of note is said in these words of prose at all") == "low_domain_signal"
    assert value(spark, text.low_signal_reason("v"), v="copper electrowinning at the cathode is described in these words") is None
    assert value(spark, text.is_sensitive("v"), v="Содержание урана: U и Pu") is True
    assert value(spark, text.is_sensitive("v"), v="Usual plutonic rocks") is False


def test_seed_coverage_and_documents(spark):
    rows = {r.type: (r.occurrences, r.distinct_values) for r in entities.coverage(seed(spark)).collect()}
    assert rows["Material"] == (6, 3) and rows["Expert"] == (0, 0)
    assert {r.filename: r.experiments for r in entities.documents_rollup(seed(spark), "ord").collect()} == {"report 2023.docx": 3, "report 2017.docx": 3}


def test_counterfactuals(spark):
    rows = seed(spark)
    got = {(r.other, r.from_value, r.to_value) for r in counterfactual.for_target(rows, "EXP-NI-01").collect()}
    assert got == {("EXP-NI-02", "pH: 2.0", "pH: 1.0"), ("EXP-NI-03", "density: 300 A/m2", "density: 500 A/m2")}
    assert counterfactual.for_target(rows, "none").count() == 0
    assert counterfactual.all_pairs(rows).count() == 6
    assert {(r.parameter, r.pairs) for r in counterfactual.pair_counts(rows).collect() if r.pairs} == {("Property", 6)}
    effect = counterfactual.effects(counterfactual.for_target(rows, "EXP-NI-01").where("other = 'EXP-NI-02'"), rows).first()
    assert (effect.property, effect.from_output, effect.to_output) == ("current yield", "95.5 %", "91.2 %")


def test_gaps(spark):
    found = {(r.d0, r.d1): r.gap_type for r in gaps.analyze(seed(spark), ["Material", "Facility"]).collect()}
    assert found["nickel chloride electrolyte", "Long Harbour"] == "missing"
    assert found["low-grade Cu-Ni ore", "Kayerkan"] == "weak"
    assert found["nickel chloride electrolyte", "Kola"] == "foreign_only"
    home = gaps.analyze(seed(spark), ["Material", "Facility"], domestic=F.col("geography") == "RU")
    assert {r.gap_type for r in home.where("d1 = 'Kola' and experiments > 0").collect()} == {"domestic_only"}
    assert gaps.analyze(seed(spark), ["Expert"]).count() == 0


def test_search_ranks_inequality_first(spark):
    rows = seed(spark)
    encoded = search.encode_experiments(rows)
    query = spark.createDataFrame([("Material", "nickel chloride electrolyte"), ("Property", "pH < 2.0")], "type string, value string")
    got = search.search(encoded, rows, query, 3).collect()
    assert got[0].id == "EXP-NI-02" and got[0].similarity > got[1].similarity
    assert search.search(encoded, rows, query.limit(0)).count() == 0
    only = search.search(encoded, rows, query, 9, schema.SearchFilter(year_start=2020, geography="ru"))
    assert {r.id for r in only.collect()} == {"EXP-NI-01", "EXP-NI-02", "EXP-NI-03"}


def test_filters_pass_nulls(spark):
    rows = spark.createDataFrame([(1, None, None, None, False), (2, 2000, "RU", "patent", True), (3, 1990, "RU", "patent", False)], "id int, year int, geography string, source_type string, is_sensitive boolean")
    keep = lambda **f: sorted(r.id for r in search.metadata_filter(rows, schema.SearchFilter(**f)).collect())
    assert keep(year_start=1995) == [1, 2] and keep(geography="ru", source_type="PATENT") == [1, 2, 3] and keep(exclude_sensitive=True) == [1, 3]


@pytest.mark.parametrize(
    ("signals", "reason"),
    [
        ((0, 0, 0.0, 0, 0.0, 0.0, 0.5, 0.1, 1.0, 3, 5), "no_entities"),
        ((2, 0, 0.0, 0, 0.0, 9.0, 0.5, 0.1, 1.0, 3, 5), "weak_parse"),
        ((2, 2, 1.0, 0, 0.0, 9.0, 0.2, 0.1, 0.0, 3, 5), "ood_scope"),
        ((2, 2, 1.0, 0, 0.0, 9.0, 0.0, 0.0, 0.5, 0, 0), "no_hits"),
        ((2, 2, 1.0, 0, 0.0, 9.0, 0.07, 0.05, 0.5, 3, 5), "low_confidence"),
        ((1, 1, 1.0, 0, 0.0, 9.0, 0.12, 0.05, 0.1, 3, 5), "needs_clarification"),
        ((2, 2, 1.0, 0, 0.0, 9.0, 0.5, 0.2, 0.5, 3, 5), ""),
    ],
)
def test_gate(spark, signals, reason):
    names = "n int, domain int, domain_ratio double, generic int, generic_ratio double, mean_length double, top1 double, margin double, overlap double, families int, hits int"
    got = search.gate(spark.createDataFrame([signals], names)).first()
    assert got.reason == reason and got.should_empty == bool(reason)


def test_rerank_prefers_matching_over_raw(spark):
    rows = seed(spark).where("id in ('EXP-NI-01', 'EXP-HL-01')").withColumn("id", F.when(F.col("id") == "EXP-HL-01", "EXP-RAW-01").otherwise(F.col("id")))
    hits = rows.withColumns({"similarity": F.when(F.col("id") == "EXP-RAW-01", 0.95).otherwise(0.70), "rank": F.when(F.col("id") == "EXP-RAW-01", 1).otherwise(2)})
    got = search.rerank(hits, [("Material", "Nickel chloride electrolyte")]).collect()
    assert [r.id for r in got] == ["EXP-NI-01", "EXP-RAW-01"] and got[1].similarity == 0.95


def test_graph(spark):
    rows = seed(spark)
    kinds = {r.type: r.edges for r in graph.summary(graph.edges(rows)).collect()}
    assert kinds["EVIDENCE_FROM"] == 6 and kinds["USES_MATERIAL"] == 6 and kinds["HAS_OUTPUT"] == 6
    got = graph.expand(graph.edges(rows).drop("experiment_id").distinct(), rows.where("id = 'EXP-CU-01'").select("id"), 2).collect()
    assert max(r["rank"] for r in got) <= 2 and {r.kind for r in got} == {"publication", "entity", "second"}


def test_endpoints_resolve_first_or_last(spark):
    row = ("X", 0, "X", [("Material", "a"), ("Facility", "a"), ("Material", "b")], [], [], [("A", "uses_material", "b")], [], 1.0, None, None, None, False)
    one = spark.createDataFrame([row], schema.EXPERIMENT)
    assert graph.resolved_relations(one).first().source == "Facility:a" and graph.resolved_relations(one, last=False).first().source == "Material:a"


def test_metrics(spark):
    ranked = spark.createDataFrame([("q", 1, "a"), ("q", 2, "x"), ("q", 3, "y")], "question string, rank int, id string")
    relevant = spark.createDataFrame([("q", "a"), ("q", "b"), ("q", "c"), ("r", "z")], "question string, id string")
    got = {r.question: tuple(r)[1:] for r in evaluate.retrieval_metrics(ranked, relevant, 3).collect()}
    assert got["q"] == (pytest.approx(1 / 3), pytest.approx(1 / 3), 1.0) and got["r"] == (0, 0, 0)


def test_judge(spark):
    rows = spark.createDataFrame([("никелевый электролит", ["никеля"], 1.0, 0.5, 3, False), ("", ["a"], 1.0, 0.5, 3, False), ("none", None, None, None, 2, True)], "answer string, keywords array<string>, recall double, min_recall double, retrieved int, expect_empty boolean")
    assert [(r.passed, r.score) for r in evaluate.rule_judge(rows).collect()] == [(True, 1.0), (False, 0.0), (False, 0.0)]


def test_tables_repeat_their_header():
    parts = chunks.split_table([["h1", "h2"]], [["x" * 60, str(i)] for i in range(50)])
    assert len(parts) > 1 and all(p.startswith("| h1 | h2 |") and len(p) <= chunks.SOFT for p in parts)
    assert sum(p.count("x" * 60) for p in parts) == 50


def test_chunks_follow_headings(spark):
    rows = [(1, 0, "heading", 1, "One", None), (1, 1, "text", None, "word " * 20, None), (1, 2, "heading", 2, "Two", None), (1, 3, "table", None, "", [["a", "b"], ["1", "2"]]), (1, 4, "code", None, "import x", None), (1, 5, "heading", 1, "Three", None), (1, 6, "text", None, "short", None)]
    df = spark.createDataFrame(rows, "doc_id long, pos int, kind string, level int, body string, rows array<array<string>>")
    got = chunks.chunks(df).orderBy("index").collect()
    assert [(r.content_type, r.section_path) for r in got] == [("text", ["One"]), ("table", ["One", "Two"])]
    paths = {r.pos: r.section_path for r in chunks.section_paths(df).collect()}
    assert paths[3] == ["One", "Two"] and paths[6] == ["Three"]


def test_payloads(spark):
    rows = spark.createDataFrame([('{"entities":[{"type":"material","value":" ore "},{"type":"Ghost","value":"x"}]}',), ("no json",), ('{"entities":[{"type":"Ghost","value":"x"}]}',)], "payload string")
    got = ingest.parse_payload(rows).collect()
    assert [(len(r.entities), r.dropped, r.failure) for r in got] == [(1, 1, None), (0, 0, "parse_error"), (0, 1, "tolerant_drop_all")]


def test_outbox_dead_letters(spark):
    log = spark.createDataFrame([("a", 1, "enqueued"), ("a", 2, "published"), ("a", 3, "failed"), ("a", 4, "failed"), ("b", 1, "enqueued"), ("b", 2, "failed"), ("b", 3, "requeued"), ("c", 1, "acked")], "event_id string, seq int, kind string").withColumn("at", F.timestamp_seconds("seq"))
    got = {r.event_id: (r.status, r.attempts) for r in outbox.state(log, most=2).collect()}
    assert got == {"a": ("dead_letter", 2), "b": ("pending", 0), "c": ("acked", 0)}


def test_events_round_trip(spark):
    messages = outbox.encode(seed(spark)).select("payload").union(spark.createDataFrame([("poison",)], "payload string"))
    got = outbox.decode(messages)
    assert got.where("event is null").count() == 1 and got.where("event.experiment.id = 'EXP-CU-01'").count() == 1


def test_docx(spark, tmp_path):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = f'<w:document xmlns:w="{w}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>Title</w:t></w:r></w:p><w:p><w:r><w:t>Some text</w:t></w:r></w:p><w:tbl><w:tr><w:tc><w:p><w:r><w:t>c</w:t></w:r></w:p></w:tc></w:tr></w:tbl></w:body></w:document>'
    (tmp_path / "reviews").mkdir()
    data = BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", body)
    (tmp_path / "reviews/a.DOCX").write_bytes(data.getvalue())
    (tmp_path / "reviews/bad.docx").write_bytes(b"broken")
    (tmp_path / "other.txt").write_text("x")
    files = readers.in_order(readers.scan_directory(spark, str(tmp_path)), ["reviews"])
    got = {r.path.rsplit("/", 1)[1]: r for r in readers.parse_files(files).collect()}
    assert [(b.kind, b.level, b.body) for b in got["a.DOCX"].blocks] == [("heading", 2, "Title"), ("text", None, "Some text"), ("table", None, "")]
    assert [r.error is None for r in readers.parse_files(files.limit(0)).collect()] == []
    assert got["bad.docx"].blocks is None and "BadZipFile" in got["bad.docx"].error


def test_golden_fails_on_bad_lines(spark, tmp_path):
    (tmp_path / "ok.jsonl").write_text('{"id":"q1","query":"x"}\n\n')
    (tmp_path / "bad.jsonl").write_text('{"id":\n')
    assert readers.read_golden(spark, str(tmp_path / "ok.jsonl")).count() == 1
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        readers.read_golden(spark, str(tmp_path / "bad.jsonl")).collect()


def test_engine(spark, tmp_path):
    store = Store(spark, str(tmp_path / "store"))
    admin = Engine(spark, store, Session("ann", "Administrator"))
    admin.ingest(seed(spark).where("id <> 'EXP-HL-02'"))
    admin.ingest(seed(spark).where("id like 'EXP-HL%'"))
    assert admin.experiments().count() == 6 and admin.documents().count() == 2
    top = admin.search(spark.createDataFrame([("Material", "copper sulphate electrolyte"), ("Facility", "Long Harbour")], "type string, value string"), 2).collect()
    assert top[0].id == "EXP-CU-01"
    assert {(r.type, r.value) for r in admin.parse("pH 2.0 for heap leaching at Long Harbour").collect()} >= {("Process", "heap leaching"), ("Facility", "long harbour")}
    assert admin.audit_logs().count() >= 3
    guest = Engine(spark, store, Session("guy", "External Partner"))
    assert [r.id for r in guest.experiments().collect()] == ["EXP-CU-01"]
    assert guest.browse(geography="RU").count() == 0 and [r.id for r in admin.browse(words="kola", year=2023).collect()] == ["EXP-NI-01", "EXP-NI-02", "EXP-NI-03"]
    assert guest.options().count() == 2
    with pytest.raises(PermissionError):
        guest.gaps(["Material"])
    with pytest.raises(PermissionError):
        Engine(spark, store, Session("x", "")).statistics()


def test_listing(spark):
    rows = seed(spark)
    assert {r.id for r in browse.corpus_page(rows, True).collect()} == {"EXP-CU-01"}
    assert {r.id for r in browse.corpus_page(rows, words=" exp-ni ").collect()} == {"EXP-NI-01", "EXP-NI-02", "EXP-NI-03"}
    assert browse.corpus_page(rows, geography="RU", year=2017).count() == 2
    some = rows.select("id", F.when(F.col("id") == "EXP-NI-01", F.lit(None)).otherwise(F.col("year")).alias("year"), "geography")
    assert [r.value for r in browse.options(some).orderBy("kind", "pos").collect()] == ["Global", "RU", "2023", "2017"]
    assert browse.options(some.limit(0)).count() == 0


def test_hits_of_documents(spark):
    hits = spark.createDataFrame([("a", ["x"]), ("b", ["y", "z"]), ("c", []), ("d", None)], "id string, evidence array<string>")
    assert {r.id for r in browse.citing(hits, ["z"]).collect()} == {"b", "c", "d"}
    assert {r.id for r in browse.citing(hits.where("id in ('a', 'b')"), ["q"]).collect()} == {"a", "b"}
    assert browse.citing(hits.limit(0), ["q"]).count() == 0


def test_titles(spark):
    pages = spark.createDataFrame([(["", "short", "Review of all the works", "_____ long ruled line", "Leaching of nickel ore"], "f.docx"), ([], "plan.v2.docx"), (None, "x")], "p array<string>, f string")
    got = [r[0] for r in pages.select(browse.document_title(F.col("p"), F.col("f"), ["review"])).collect()]
    assert got == ["Leaching of nickel ore", "plan.v2", "x"]


def test_payload_shapes_and_reports(spark):
    answers = spark.createDataFrame([('x [{"type":"material","value":"a"},] y',), ('{"type":"Process","value":"b"}',), ("",), (None,)], "payload string")
    assert [r.entities and [tuple(e) for e in r.entities] for r in ingest.payload_entities(answers).collect()] == [[("Material", "a")], [("Process", "b")], None, None]
    outcomes = spark.createDataFrame([("a", "empty", 2, None), (None, "ok", None, 1), (None, "moderation", 1, 1)], "failure_class string, status string, dropped_entities int, dropped_relations int")
    assert {tuple(r) for r in ingest.validation_summary(outcomes).collect()} == {("a", 1, 1, 2, 0), (None, 2, 1, 1, 2)}
    run = evaluate.run_rollup(spark.createDataFrame([], "judge_pass boolean, e2e_ms double, vector_ms double, graph_ms double")).first()
    assert (run.questions, run.success_rate, run.mean_e2e_ms) == (0, 0.0, None)
