"""Stored graph, relay and consumer, document files, ingestion with a reader, answers, and the engine's methods."""

import json
import zipfile
from io import BytesIO

import numpy as np
import pytest
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.engine import Engine
from hyperloom.functions import text, vectors
from hyperloom.operators import answers, chunks, counterfactual, evaluate, gaps, graph, ingest, search
from hyperloom.policy import Session
from hyperloom.sources import readers
from hyperloom.sources.graph_store import GraphStore
from hyperloom.sources.seed import seed
from hyperloom.sources.store import Store
from hyperloom.streaming import relay

def at(day):
    return F.lit(f"2024-01-0{day} 00:00:00").cast("timestamp")


_NS = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"


def docx(*parts):
    """Bytes of a document of paragraphs (style, font, text) and tables (lists of rows)."""
    body = ""
    for p in parts:
        if isinstance(p, list):
            body += "<w:tbl>" + "".join("<w:tr>" + "".join(f"<w:tc><w:p><w:r><w:t>{c}</w:t></w:r></w:p></w:tc>" for c in row) + "</w:tr>" for row in p) + "</w:tbl>"
        else:
            style, font, said = p
            body += f'<w:p><w:pPr><w:pStyle w:val="{style}"/></w:pPr><w:r><w:rPr><w:rFonts w:ascii="{font}"/></w:rPr><w:t>{said}</w:t></w:r></w:p>'
    data = BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{_NS}"><w:body>{body}</w:body></w:document>')
    return data.getvalue()


PAPER = docx(
    ("Normal", "Arial", "УТВЕРЖДАЮ"), ("Normal", "Arial", ""), ("Normal", "Arial", "Директор института Иванов"), ("Normal", "Arial", "Nickel electrowinning from chloride electrolytes, 2021"),
    ("Normal", "Arial", "Список исполнителей:"), ("Normal", "Arial", "инженер Петров А.Б."), ("Normal", "Arial", "специалист Сидорова В.Г."),
    ("Heading1", "Arial", "Results"), ("Normal", "Courier New", "import os"), ("Normal", "Arial", "1.2 Cathode quality"),
    ("Normal", "Arial", "At 65 °C and pH 2.5 the copper cathode of the electrolyte gave a current yield of 95 % over ten days of electrowinning."), [["mode", "yield"], ["a", "95"], ["b", "91"]],
)


@pytest.fixture()
def files(spark):
    return spark.createDataFrame([("/data/ТИ-7-2020 report.docx", bytearray(PAPER)), ("/data/bad.docx", bytearray(b"x")), ("/data/x.pdf", bytearray(b"x"))], "path string, content binary")


def test_document_files(spark, files):
    parsed = readers.parse_files(files)
    errors = {r.path.rsplit("/", 1)[1]: r.error for r in parsed.collect()}
    assert errors["ТИ-7-2020 report.docx"] is None and "BadZipFile" in errors["bad.docx"] and errors["x.pdf"] == "no parser"
    doc = readers.metadata(parsed).collect()
    assert len(doc) == 1
    d = doc[0]
    assert (d.title, d.code, d.year, d.approver, d.authors) == ("Nickel electrowinning from chloride electrolytes, 2021", "ТИ-07-2020", 2020, "Директор института Иванов", ["Петров А.Б.", "Сидорова В.Г."])
    assert [(b.kind, b.level) for b in d.blocks][-5:] == [("heading", 1), ("code", None), ("heading", 2), ("text", None), ("table", None)]
    made = readers.document_chunks(files).orderBy("index").collect()
    assert [(r.id, r.section, r.content_type) for r in made] == [("EXP-ТИ-07-2020-cn_v1-00", "Введение", "text"), ("EXP-ТИ-07-2020-cn_v1-01", "1.2 Cathode quality", "text"), ("EXP-ТИ-07-2020-cn_v1-02", "1.2 Cathode quality", "table")]
    assert made[1].text.startswith("Results\n1.2 Cathode quality\n\nAt 65") and "import os" not in "".join(r.text for r in made)


def test_numbered_headings_and_code(spark):
    raw = spark.createDataFrame([([("paragraph", "Heading 3", False, "A", None), ("paragraph", "", False, "2.1.4 Deep heading", None), ("paragraph", None, True, "def f(x):", None), ("table", "", False, "", [["a"]])],)], f"raw array<{readers.RAW_BLOCK}>")
    got = raw.select(chunks.structured(F.col("raw")).alias("b")).first().b
    assert [(b.kind, b.level) for b in got] == [("heading", 3), ("heading", 3), ("code", None), ("table", None)]


def answer_of(entities, relations=()):
    return json.dumps({"entities": [{"type": t, "value": v} for t, v in entities], "relations": [{"source": s, "type": t, "target": o} for s, t, o in relations]})


def test_chunks_read_by_a_model(spark):
    body = "copper electrowinning at the cathode is described in these words, 95 % of it"
    good = answer_of([("material", "copper"), ("Process", "electrowinning"), ("Ghost", "x"), ("Property", "95 %")], [("electrowinning", "uses", "copper"), ("a", "nonsense", "b")])
    fenced = "{see below}\n```json\n" + answer_of([("Material", "heavy water"), ("Process", "neutron moderation")]) + "\n```\n{end}"
    said = {"ok": good, "fenced": fenced, "refused": "I  cannot\ndiscuss this topic", "broken": "no json", "nobody": answer_of([("Publication", "a book")]), "old": good}
    rows = [(k, "f.docx", body.replace("95 %", "") if k == "nobody" else body, 2020, ["Иванов", "Не указан"]) for k in said] + [("short", "f.docx", "1", 2020, [])]
    df = spark.createDataFrame(rows, "id string, filename string, text string, year int, experts array<string>")
    known = spark.createDataFrame([("old",)], "id string")
    seen = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def read(text_and_id):
        seen.add(text_and_id is not None and text_and_id["t"] is not None)
        return said[text_and_id["id"]] if text_and_id and text_and_id["t"] is not None else None

    got = {r.id: r for r in ingest.process_chunks(df, known, lambda c: read(F.struct(c.alias("t"), F.col("id")))).collect()}
    assert {k: (r.status, r.reason, r.failure_class) for k, r in got.items()} == {
        "ok": ("ok", None, None), "fenced": ("ok", None, None), "refused": ("moderation", None, None), "broken": ("validation_failed", None, "parse_error"), "nobody": ("empty", "weak_domain_evidence", "empty"),
        "old": ("skipped", None, None), "short": ("empty", "too_short", "empty"),
    }
    ok = got["ok"]
    assert [tuple(e) for e in ok.input_entities] == [("Material", "copper"), ("Property", "95 %"), ("Publication", "f.docx")] and [tuple(e) for e in ok.process_entities] == [("Process", "electrowinning"), ("Expert", "Иванов")]
    assert [tuple(r) for r in ok.relations] == [("electrowinning", "uses_material", "copper")] and (ok.dropped_entities, ok.dropped_relations) == (1, 1)
    assert seen.value <= 2 * 5  # neither what is known nor what says nothing is read
    unread = {r.id: r.status for r in ingest.process_chunks(df, known).collect()}  # numbers with units alone
    assert unread == {"ok": "ok", "fenced": "ok", "refused": "ok", "broken": "ok", "nobody": "empty", "old": "skipped", "short": "empty"}


def test_refusals(spark):
    said = {"I can't discuss this": True, "You CANNOT  discuss it": True, "Я не могу\tобсуждать это": True, "neutron moderation": False, "content filter": False, "I cannot assist": False, "": False, None: False}
    rows = spark.createDataFrame([(t,) for t in said], "t string").select("t", text.is_refusal("t").alias("r")).collect()
    assert {r.t: r.r for r in rows} == said


def test_strict_payloads(spark):
    rows = spark.createDataFrame([(answer_of([("Material", "a")]),), (answer_of([("Material", "a"), ("Ghost", "b")]),), ('{"entities": "a"}',), ("[1]",), ("{}",), (None,)], "payload string")
    strict = [(r.failure, len(r.entities)) for r in ingest.parse_payload(rows, strict=True).collect()]
    assert strict == [(None, 1), ("schema_error", 0), ("schema_error", 0), ("parse_error", 0), (None, 0), ("parse_error", 0)]
    tolerant = [(r.failure, r.dropped, r.reasons) for r in ingest.parse_payload(rows).collect()]
    assert tolerant == [(None, 0, []), (None, 1, ["unknown type Ghost"]), ("schema_error", 0, []), ("parse_error", 0, []), ("tolerant_drop_all", 0, []), ("parse_error", 0, [])]


def test_stored_graph(spark, tmp_path):
    store = GraphStore(Store(spark, str(tmp_path)))
    rows = seed(spark)
    store.insert(rows)
    nodes, edges = store.nodes().count(), store.edges().count()
    store.insert(rows)  # a merge may be repeated
    store.check_unique()
    assert (store.nodes().count(), store.edges().count()) == (nodes, edges)
    one = spark.createDataFrame([("Expert", "Nobody"), ("Ghost", "x"), ("Expert", " ")], "type string, value string")
    assert store.insert_ontology(one) == 1 and store.nodes().count() == nodes + 1
    assert store.clear() == (nodes + 1, edges) and store.nodes().count() == store.edges().count() == 0
    store.store.save("nodes", spark.createDataFrame([("a", "Material", "x"), ("a", "Material", "y")], "entity_id string, label string, name string"))
    with pytest.raises(ValueError, match="share an id"):
        store.check_unique()


def test_expansion_with_experts_and_contradictions(spark):
    edges = spark.createDataFrame(
        [("E1", "HAS_INPUT", "Material:a"), ("E1", "HAS_PROCESS", "Expert:ann"), ("E1", "EVIDENCE_FROM", "Publication:p"), ("Material:a", "VALIDATED_BY", "Expert:bob"), ("Material:a", "VALIDATED_BY", "Facility:f"), ("Material:z", "CONTRADICTS", "Material:a"), ("E1", "VALIDATED_BY", "Expert:cat"), ("E2", "HAS_INPUT", "Material:z")],
        "source string, type string, target string",
    )
    got = {(r.kind, r.node) for r in graph.expand(edges, spark.createDataFrame([("E1",)], "id string")).collect()}
    assert got == {("entity", "Material:a"), ("entity", "Expert:ann"), ("expert", "Expert:ann"), ("expert", "Expert:bob"), ("expert", "Expert:cat"), ("publication", "Publication:p"), ("second", "Expert:bob"), ("second", "Facility:f"), ("second", "Expert:cat"), ("contradiction", "Material:z")}
    text = answers.graph_lines(graph.expand(edges, spark.createDataFrame([("E1",)], "id string"))).first().graph
    assert text == "Связанные эксперты: ann, bob, cat\nСвязанные публикации: p\nПротиворечия: z\nГрафовые пути: 2"
    assert answers.graph_lines(graph.expand(edges, spark.createDataFrame([("E9",)], "id string"))).first().graph == ""


def test_relay_and_consumer(spark, tmp_path):
    store = Store(spark, str(tmp_path))
    rows = seed(spark)
    poison = spark.createDataFrame([("bad", "{", "pending", 3, None, None)], "event_id string, payload string, status string, attempts int, message_id string, error string").withColumns({"created_at": at(2), "updated_at": at(2)})
    store.save("outbox", relay.enqueued(relay.waiting(rows, at(2)), poison))
    graph_store, broken = GraphStore(store), [True]

    def apply(experiments):
        if broken[0]:
            raise OSError("down")
        graph_store.insert(experiments)

    state = lambda: {r[0]: (r[1], r[2]) for r in store.load("outbox").groupBy("status").agg(F.count("*"), F.sum("attempts")).collect()}
    assert relay.sync_once(store, apply, at(2)) == {"published": 6, "failed": 1, "acked": 0}
    assert state() == {"published": (6, 6), "pending": (1, 4)}  # the consumer's failures stay published
    broken[0] = False
    later = at(3)
    assert relay.sync_once(store, apply, later) == {"published": 6, "failed": 1, "acked": 6}  # stale ones go out again
    assert state() == {"acked": (6, 6), "dead_letter": (1, 5)} and graph_store.nodes().where("label = 'Experiment'").count() == 6
    assert relay.sync_once(store, apply, later, strict=True) == {"published": 0, "failed": 0, "acked": 0}
    assert relay.backfilled(rows, store.load("outbox"), at(2)).count() == 0
    assert relay.lookup(store.load("outbox"), event_id="bad").first().error == "bad_payload"
    store.save("outbox", poison.withColumn("attempts", F.lit(0)))
    with pytest.raises(RuntimeError, match="could not be relayed"):
        relay.sync_once(store, apply, at(2), strict=True)


def test_consumer_gives_up(spark):
    rows = relay.waiting(seed(spark).limit(1), at(2)).withColumns({"status": F.lit("published"), "attempts": F.lit(4), "message_id": F.lit("m")})

    def broken(_):
        raise OSError

    got = relay.marked(rows, relay.consumed(rows, broken), at(2)).first()
    assert (got.status, got.attempts, got.error) == ("dead_letter", 5, "OSError")


def test_bundles_and_embeddings(spark):
    dim = 256
    keys = spark.createDataFrame([("g", f"k{i}", i % 3 + 1) for i in range(9)] + [("one", "k1", 1)], "key string, name string, weight long")
    rows = keys.select("key", "weight", vectors.packed_vectors(dim)("name").alias("hv"))
    got = {r.key: vectors.unpack(r.hv, dim) for r in vectors.bundled(rows, dim, "weight").collect()}
    want = vectors.bundle([vectors.generate(f"k{i}", dim) for i in range(9)], [i % 3 + 1 for i in range(9)], "g")
    assert np.array_equal(got["g"], want) and np.array_equal(got["one"], vectors.generate("k1", dim))
    texts = spark.createDataFrame([("Nickel ore",), (" nickel  ORE ",), ("slag",), (" ",)], "text string")
    cache = spark.createDataFrame([("slag", [1.0])], "text string, embedding array<float>")
    found = {r.text: (r.cached, len(r.embedding)) for r in vectors.embedded(texts, cache).collect()}
    assert found == {"nickel ore": (False, 384), "slag": (True, 1)}


def test_words_and_numpy_shift_alike(spark):
    row = spark.range(1).select(vectors.word_vector(F.lit("a"), 128).alias("v")).select(vectors.similarity_words(vectors.permute_words(F.col("v")), F.col("v"), 128).alias("s")).first()
    own = vectors.digest_vector("a", 128)
    assert row.s == vectors.similarity(vectors.permute(own), own)


def test_encoding_by_plain_algebra(spark):
    """An experiment's vector against its bindings, made one by one."""
    dim = 512
    got = {r.id: vectors.unpack(r.hv, dim) for r in search.encode_experiments(seed(spark), dim, False).collect()}
    book = vectors.Codebook(dim, False)
    role = lambda kind, filler: vectors.bind(book(f"Role:{kind}"), filler)
    number = lambda base, p: vectors.blend(book(f"NumericBase:{base}:min"), book(f"NumericBase:{base}:max"), p)
    m, f, p = (book(x) for x in ("Material:nickel chloride electrolyte", "Facility:kola", "Process:electrowinning"))
    parts = [(role("Material", m), 2), (role("Facility", f), 1), (role("Property", number("ph", 2 / 14)), 1), (role("Property", number("density", 0.3)), 1), (role("Process", p), 2), (role("Property", book("Property:current yield: 95.5 %")), 1)]
    parts += [(vectors.permute(p) * book("RelationType:uses_material") * m, 1), (vectors.permute(p) * book("RelationType:located_at") * f, 1)]
    total = sum(v.astype(int) * w for v, w in parts)
    want = np.where(total == 0, vectors.tie("experiments", dim), np.sign(total))
    assert np.array_equal(got["EXP-NI-01"], want)
    q = vectors.generate("q", dim)
    scored = {r.id: r.similarity for r in search.encode_experiments(seed(spark), dim, False, against=q).collect()}
    assert scored["EXP-NI-01"] == vectors.similarity(want, q)


def test_judges_and_reports(spark, tmp_path):
    rows = spark.createDataFrame([('Sure: {"score": 1.7, "reasoning": "x"}',), ('```json\n{"score": 0.4}\n```',), ('{"reasoning": "none"}',), ("no",)], "verdict string")
    assert [(r.score, r.passed, r.reasoning) for r in evaluate.judge_verdicts(rows).collect()] == [(1.0, True, "x"), (0.4, False, ""), (0.0, False, "none"), (None, None, None)]
    questions = spark.createDataFrame([("a", True, None, None, None, None), ("b", None, None, "sk-abcdefghijklmnopqrstuv", None, None), ("c", None, None, None, False, "missing word"), ("d", None, None, None, True, None)], "id string, retrieval_skipped boolean, skip_reason string, error string, judge_pass boolean, judge_details string")
    assert [tuple(r) for r in evaluate.failures(questions).orderBy("id").collect()] == [("a", "retrieval_skipped", "no expected_experiment_ids"), ("b", "error", "[REDACTED]"), ("c", "judge_fail", "missing word")]
    store = Store(spark, str(tmp_path))
    path = store.run_report("r", spark.createDataFrame([(4, 0.5)], "questions int, success_rate double"), evaluate.failures(questions))
    lines = [r.value for r in spark.read.text(path).collect()]
    assert lines[:5] == ["# Run r", "", "## Metrics", "- **questions:** 4", "- **success_rate:** 0.5"] and lines[-1] == "- `c` judge_fail: missing word"


def test_answers(spark):
    rows = seed(spark)
    pairs = counterfactual.for_target(rows, "EXP-NI-01")
    told = answers.effect_texts(pairs, counterfactual.effects(pairs, rows))
    line = answers.counterfactual_lines(told).first().text.split("\n")[0]
    assert line == "- Если изменить 'Property' с 'pH: 2.0' на 'pH: 1.0', то наблюдается: свойство 'current yield' изменилось с '95.5 %' на '91.2 %'."
    assert "EXP-NI-03" in {r.other for r in answers.reasons(told).collect()}
    few = spark.createDataFrame([("weak", 2), ("missing", 0), ("none", 5)], "k string, n int").select(answers.gap_line(F.col("k"), F.col("n")).alias("t")).collect()
    assert [r.t for r in few] == ["- Данная область слабо освещена (найдено всего 2 экспериментов).", "- Данная комбинация параметров полностью не изучена (0 экспериментов в базе).", None]


def test_engine_methods(spark, tmp_path, files):
    store = Store(spark, str(tmp_path / "store"))
    admin = Engine(spark, store, Session("ann", "Administrator"))
    admin.ingest(seed(spark))
    known = spark.createDataFrame([("Material", "copper sulphate electrolyte"), ("Facility", "Long Harbour"), ("Property", "temp: 45 C")], "type string, value string")
    page, total = admin.search_page(known, 2)
    assert total == 6 and page.first().id == "EXP-CU-01" and page.count() == 2
    nothing = spark.createDataFrame([("Material", "пицца"), ("Facility", "завод")], "type string, value string")
    assert admin.search(nothing).count() == 0 and admin.search_page(nothing)[1] == 0
    assert admin.gate(nothing).first().reason == "ood_scope" and admin.gate(known).first().reason == ""
    assert admin.search(known.limit(0)).count() == 0 and admin.gate(known.limit(0)).first().reason == "no_entities"
    answer = admin.answer(known).first()
    assert answer.similar.startswith("Опыт EXP-CU-01") and "Связанные публикации: report 2017.docx" in answer.graph
    assert admin.reason("EXP-NI-01").count() == 2 and admin.total() == 6 and admin.experiments_page(2)[1] == 6
    gap = admin.enrich_gap([("Material", "nickel chloride electrolyte"), ("Facility", "Long Harbour")]).first()
    assert gap.gap_type == "missing" and "Близкие опыты" in gap.hypothesis and "EXP-" in gap.hypothesis
    near = gaps.neighbours(seed(spark), store.load("encoded"), spark.createDataFrame([("nickel chloride electrolyte", "Kola")], "d0 string, d1 string"), ["Material", "Facility"], vectors.FULL)
    assert {r.id for r in near.where("rank <= 3").collect()} == {"EXP-NI-01", "EXP-NI-02", "EXP-NI-03"}
    (tmp_path / "docs").mkdir()
    (tmp_path / "docs" / "ТИ-7-2020 report.docx").write_bytes(PAPER)
    assert admin.new_files(str(tmp_path / "docs")).first().new == 3
    counts = {r.status: r.chunks for r in admin.ingest_corpus(str(tmp_path / "docs")).collect()}
    assert counts["ok"] >= 1 and sum(counts.values()) == 3 and {r.status: r.chunks for r in admin.ingest_status().collect()} == counts
    again = {r.status: r.chunks for r in admin.ingest_corpus(str(tmp_path / "docs")).collect()}
    assert again["skipped"] == counts["ok"] and again["ok"] == 0
    with pytest.raises(PermissionError):
        Engine(spark, store, Session("guy", "Researcher")).reason("EXP-NI-01")


def test_golden_lines_say_where_they_fail(spark, tmp_path):
    (tmp_path / "bad.jsonl").write_text('{"id":"q1","query":"x"}\n\nnot json\n')
    with pytest.raises(Exception, match="malformed line in .*bad.jsonl"):
        readers.read_golden(spark, str(tmp_path / "bad.jsonl")).collect()


def test_layers(spark):
    parsed = spark.createDataFrame([("q", 0, "Material", "a")], "question string, pos int, type string, value string")
    hits = spark.createDataFrame([("q", 1, "A", 0.5, 0.2, "RU", 2020), ("q", 2, "B", 0.4, 0.9, "RU", 2021)], "question string, rank int, id string, similarity double, hybrid double, geography string, year int")
    pairs = spark.createDataFrame([("q", "A", "B", "Material")], "question string, id string, other string, parameter string")
    said = spark.createDataFrame([("q", "x" * 600, 1.5)], "question string, answer string, e2e_ms double")
    rows = evaluate.layers(parsed, hits, hits, pairs, said, 1).collect()
    assert {s: sum(r.stage == s for r in rows) for s in ("L0", "L1_pre_rerank", "L1", "L2", "L3", "L4")} == {"L0": 1, "L1_pre_rerank": 2, "L1": 2, "L2": 1, "L3": 1, "L4": 1}
    assert [json.loads(r.payload)["id"] for r in rows if r.stage == "L2"] == ["B"] and schema.ENTITY
