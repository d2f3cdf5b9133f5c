"""What is read: tables, JSON records, golden questions, documents in folders."""

from __future__ import annotations

import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom import schema
from hyperloom.functions import text
from hyperloom.operators import browse, chunks

GOLDEN = """id string, query string, question_category string, coverage_status string, eval_mode string, expected_experiment_ids array<string>,
expected_evidence_keywords array<string>, geography string, year_start int,
success_criteria struct<min_recall_at_5:double,required_keywords_in_answer:array<string>,expect_empty_retrieval:boolean>"""
RAW_BLOCK = "struct<kind:string,style:string,monospace:boolean,body:string,rows:array<array<string>>>"
#: Paragraphs of a file that its metadata are looked for in.
META_PARAGRAPHS = 70
# What tells a document's title, approver and authors, and what stands for none.
TITLE_BOILERPLATE = ["утверждаю", "директор", "институт", "департамент", "список", "обзор", "оип", "ти-", "ис-", "оглавление"]
APPROVALS = ["УТВЕРЖДАЮ", "Утверждаю"]
APPROVERS = ["Директор", "Начальник", "Заместитель", "к.г.-м.н.", "Цымбулов", "Козырев"]
AUTHOR_MARKS = ["исполнителей", "разработчик"]
AUTHOR_ROLES = ["специалист", "инженер", "научный сотрудник", "разработал", "выполнил"]
AUTHOR_NAME = r"([А-ЯA-Z][а-яa-z]+\s+[А-ЯA-Z]\.[А-ЯA-Z]\.)"
NOT_GIVEN = "Не указан"
MONOSPACE = ("courier", "consolas", "mono", "menlo")


def read_experiments(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines by the fixed schema; geography and confidence have their defaults."""
    return spark.read.schema(schema.EXPERIMENT).json(path).na.fill({"geography": "Global", "confidence": 1.0, "is_sensitive": False})


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """Golden questions; blank lines are skipped, and a bad line fails the read with its file and where it stands in it."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file")).where(text.strip("value") != "")
    good = F.coalesce(F.get_json_object("value", "$").startswith("{"), F.lit(False))
    fail = F.raise_error(F.concat(F.lit("malformed line in "), "file", F.lit(": "), F.left("value", F.lit(80))))
    read = lines.select(F.from_json(F.when(text.strip("value") == "", None).when(good, F.col("value")).otherwise(fail), GOLDEN, {"mode": "FAILFAST"}).alias("q"))
    return read.select("q.*")


def read_audit(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("timestamp string, username string, role string, action string, details string").json(path)


def scan_directory(spark: SparkSession, base: str, categories: list[str] | None = None, extensions: tuple[str, ...] = (".docx", ".pdf")) -> DataFrame:
    """path, length, content of the files below base in folders whose path holds one of the categories."""
    low = F.lower("path")
    kind = low.rlike("(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$")
    wanted = text.hits(F.col("path"), categories) > 0 if categories else F.lit(True)
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(base).where(kind & wanted).select("path", "length", "content")


def in_order(files: DataFrame, priorities: list[str], skip: int = 0, most: int | None = None) -> DataFrame:
    """Files by the first category that their path holds, then by path."""
    rank = F.lit(len(priorities))
    for i, word in reversed(list(enumerate(priorities))):
        rank = F.when(F.contains("path", F.lit(word)), i).otherwise(rank)
    out = files.withColumn("priority", rank).orderBy("priority", "path").offset(skip)
    return out if most is None else out.limit(most)


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_blocks(data: bytes) -> tuple[list[dict], list[str]]:
    """(paragraphs and tables of a word-processing file in their order, its first paragraphs, blank ones too)."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        body = ET.fromstring(z.read("word/document.xml")).find(f"{_W}body")
    said = lambda node: "".join(t.text or "" for t in node.iter(f"{_W}t"))
    out, paragraphs = [], []
    for node in body if body is not None else ():
        if node.tag == f"{_W}tbl":
            rows = [[said(cell) for cell in row.findall(f"{_W}tc")] for row in node.findall(f"{_W}tr")]
            out.append({"kind": "table", "style": "", "monospace": False, "body": "", "rows": rows})
        elif node.tag == f"{_W}p":
            paragraphs.append(said(node))
            if line := said(node).strip():
                style = node.find(f"{_W}pPr/{_W}pStyle")
                fonts = [f.get(f"{_W}ascii", "").lower() for f in node.iter(f"{_W}rFonts")]
                mono = any(m in f for f in fonts for m in MONOSPACE)
                out.append({"kind": "paragraph", "style": style.get(f"{_W}val", "") if style is not None else "", "monospace": mono, "body": line, "rows": None})
    return out, paragraphs[:META_PARAGRAPHS]


def parse_files(files: DataFrame, pdf=None) -> DataFrame:
    """path, blocks (as chunks.BLOCK), paragraphs, error of files (path, content). `pdf` maps bytes to the same two lists
    where a parser is at hand; a file that can't be read gives an error and no blocks instead of failing the job."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content in zip(rows["path"], rows["content"]):
                try:
                    parser = docx_blocks if path.lower().endswith(".docx") else pdf if path.lower().endswith(".pdf") else None
                    out.append((path, *(parser(content) if parser else (None, None)), None if parser else "no parser"))
                except Exception as e:  # noqa: BLE001 - the file is to blame, whatever it is
                    out.append((path, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["path", "raw", "paragraphs", "error"])

    raw = files.select("path", "content").mapInPandas(run, f"path string, raw array<{RAW_BLOCK}>, paragraphs array<string>, error string")
    return raw.select("path", chunks.structured(F.col("raw")).alias("blocks"), "paragraphs", "error")


def _after(paragraphs: Column, marks: list[str], most: int, says: Callable[[Column], Column], lower: bool = False) -> Column:
    """What `says` makes of the paragraphs after each one that holds a mark, nulls left out."""
    body = (lambda p: F.lower(p)) if lower else (lambda p: p)
    here = F.filter(F.sequence(F.lit(0), F.size(paragraphs) - 1), lambda i: text.hits(body(F.get(paragraphs, i)), marks) > 0)
    return F.filter(F.flatten(F.transform(here, lambda i: F.transform(F.slice(paragraphs, i + 2, F.lit(most)), says))), lambda x: x.isNotNull())


def metadata(parsed: DataFrame) -> DataFrame:
    """Adds filename, file_slug, title, code, year, authors and approver to parsed files that could be read. Year and code
    come from the file's name, else from its first paragraphs."""
    filename = F.regexp_extract("path", r"([^/]*)$", 1)
    p = F.slice("paragraphs", 1, 60)
    joined = F.array_join("paragraphs", "\n")
    approver = F.get(_after(p, APPROVALS, 4, lambda x: F.when(text.hits(x, APPROVERS) > 0, text.strip(x))), F.lit(0))
    name = lambda x: F.when(text.hits(F.lower(x), AUTHOR_ROLES) > 0, F.nullif(F.regexp_extract(x, AUTHOR_NAME, 1), F.lit("")))
    authors = F.array_distinct(_after(p, AUTHOR_MARKS, 9, name, lower=True))
    rows = parsed.where("error is null").withColumns({"filename": filename, "_joined": joined})
    return rows.withColumns({
        "file_slug": text.slug("filename"), "title": browse.document_title(F.col("paragraphs"), F.col("filename"), TITLE_BOILERPLATE), "code": F.coalesce(text.document_code("filename", "_joined"), F.lit("N/A")),
        "year": text.document_year("filename", "_joined"), "authors": F.when(F.size(authors) > 0, authors).otherwise(F.array(F.lit(NOT_GIVEN))), "approver": F.coalesce(approver, F.lit(NOT_GIVEN)),
    }).drop("_joined")


def document_chunks(files: DataFrame, pdf=None) -> DataFrame:
    """Chunks of files (path, content) with their document's metadata and an experiment's id each: what process_chunks
    reads. Files that can't be read have none."""
    docs = metadata(parse_files(files, pdf))
    made = chunks.chunks_of(docs.select(F.xxhash64("path").alias("doc_id"), "blocks"))
    own = docs.select(F.xxhash64("path").alias("doc_id"), "filename", "file_slug", "title", "code", "year", "authors")
    rows = made.join(own, "doc_id")
    id_ = text.experiment_id(F.nullif("code", F.lit("N/A")), F.col("file_slug"), F.col("chunk_version"), F.col("index"))
    return rows.select(id_.alias("id"), "filename", "title", "text", "year", F.col("authors").alias("experts"), "section", "index", "content_type", "chunk_version")


def read_ontology(spark: SparkSession, labels: dict[str, list[str]] | DataFrame) -> DataFrame:
    """type, value from a static vocabulary, by type or as rows (type, value) of any number; each once, blank values dropped."""
    rows = labels if isinstance(labels, DataFrame) else spark.createDataFrame([(t, v) for t, own in labels.items() for v in own], "type string, value string")
    return rows.select("type", "value").where(text.strip("value") != "").distinct()
