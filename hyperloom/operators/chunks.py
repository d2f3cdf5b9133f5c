"""Documents to chunks: headings build a path, text is packed up to a soft limit, tables repeat their header."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hyperloom.functions import text

SOFT, HARD, USEFUL, VERSION = 1800, 2400, 40, "cn_v1"


def blocks_of_text(docs: DataFrame) -> DataFrame:
    """doc_id, pos, kind, body: a line that holds bars is a table row, others are text."""
    rows = docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "body")).where(text.strip("body") != "")
    return rows.withColumn("kind", F.when(F.contains("body", F.lit("|")), "table").otherwise("text"))


def blocks_of_html(pages: DataFrame) -> DataFrame:
    """page_id, pos, kind, level, body from headings, paragraphs and list items, without scripts and styles."""
    clean = F.regexp_replace("html", r"(?is)<(script|style)\b.*?</\1>|<!--.*?-->", "")
    found = F.regexp_extract_all(clean, F.lit(r"(?is)<(?:h[1-6]|p|li)\b[^>]*>.*?(?=</?(?:h[1-6]|p|li|ul|article|div|body)\b)"), F.lit(0))
    rows = pages.select("page_id", F.posexplode(found).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"<(\w+)", 1))
    body = F.regexp_replace("raw", r"<[^>]*>", " ")
    for entity, char in {"&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&nbsp;": " ", "&amp;": "&"}.items():
        body = F.replace(body, F.lit(entity), F.lit(char))
    level = F.regexp_extract(tag, r"h(\d)", 1).try_cast("int")
    out = rows.select("page_id", "pos", F.when(level.isNotNull(), "heading").when(tag == "li", "item").otherwise("text").alias("kind"), level.alias("level"), text.strip(F.regexp_replace(body, r"(?U)\s+", " ")).alias("body"))
    return out.where("body <> ''")


def section_paths(blocks: DataFrame, key: str = "doc_id") -> DataFrame:
    """blocks (kind, level, body, pos) with section_path: the last heading of each level that no shallower one has
    ended since. Windows only, one for each of six levels."""
    w = Window.partitionBy(key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    last = lambda level: F.last(F.when(F.col("level") == level, F.struct("pos", "body")), True).over(w)
    out = blocks.withColumns({f"_h{i}": last(i) for i in range(1, 7)})
    ended = lambda i: F.greatest(F.lit(-1), *(F.coalesce(F.col(f"_h{j}.pos"), F.lit(-1)) for j in range(1, i))) if i > 1 else F.lit(-1)
    parts = [F.when(F.col(f"_h{i}.pos") > ended(i), F.col(f"_h{i}.body")) for i in range(1, 7)]
    return out.withColumn("section_path", F.filter(F.array(*parts), lambda x: x.isNotNull())).drop(*(f"_h{i}" for i in range(1, 7)))


def packed(lengths: Column, soft: int = SOFT) -> Column:
    """The part (from 0) of each of an array of lengths when parts are filled in order up to `soft`, one for each
    line break between. A single longer item is a part of its own."""
    start = F.struct(F.lit(-1).alias("part"), F.lit(0).alias("used"), F.array().cast("array<int>").alias("parts"))

    def step(acc: Column, n: Column) -> Column:
        new = (acc["part"] < 0) | (acc["used"] + n + 1 > soft)
        part = F.when(new, acc["part"] + 1).otherwise(acc["part"])
        return F.struct(part.alias("part"), F.when(new, n).otherwise(acc["used"] + n + 1).cast("int").alias("used"), F.concat(acc["parts"], F.array(part)).alias("parts"))

    return F.aggregate(lengths, start, step, lambda acc: acc["parts"])


def split_table(header: list[list[str]], body: list[list[str]], soft: int = SOFT, hard: int = HARD) -> list[str]:
    """A table as parts within `soft` characters, each under its header; a row that is longer comes alone."""
    line = lambda row: "| " + " | ".join(" ".join((c or "").split()) for c in row) + " |"
    head, rows = [line(r) for r in header], [line(r) for r in body]
    if not rows:
        return ["\n".join(head)] if head else []
    room = sum(len(x) + 1 for x in head)
    if len("\n".join(head + rows)) <= soft:
        return ["\n".join(head + rows)]
    parts: list[list[str]] = [[]]
    for row in rows:
        cost = len(row) + 1
        alone = room + cost > hard
        if parts[-1] and (alone or room + sum(len(x) + 1 for x in parts[-1]) + cost > soft):
            parts.append([])
        parts[-1].append(row)
        if alone:
            parts.append([])
    return ["\n".join(head + p) for p in parts if p]


BLOCK = "struct<pos:int,kind:string,level:int,body:string,rows:array<array<string>>>"


def structured(blocks: Column) -> Column:
    """Raw blocks of a document file (kind paragraph or table, style, monospace, body, rows) as BLOCKs: code, headings by
    style or number, text and tables."""

    def one(b: Column, i: Column) -> Column:
        level = text.heading_level(b["style"], b["body"])
        kind = F.when(b["kind"] == "table", "table").when(text.is_code_like(b["body"], b["monospace"]), "code").when(level.isNotNull(), "heading").otherwise("text")
        return F.struct(i.alias("pos"), kind.alias("kind"), F.when(kind == "heading", level).alias("level"), b["body"].alias("body"), b["rows"].alias("rows"))

    return F.transform(blocks, one)


def assembled(blocks: list[dict], soft: int, hard: int) -> list[tuple]:
    """The chunks of one document's blocks in order: (text, section path, kind, block, table part)."""
    out, path, levels, held, held_from = [], [], [], [], 0

    def put(body: str, kind: str, block: int, part: int | None = None) -> None:
        head = "\n".join(path)
        out.append((body if not path or body.startswith(head) else f"{head}\n\n{body}", list(path), kind, block, part))

    def flush() -> None:
        size, piece = 0, []
        for line in [*held, None]:
            if line is None or (piece and size + len(line) + 1 > soft):
                body = "\n".join(piece)
                if len(body) >= USEFUL:
                    put(body, "text", held_from)
                size, piece = 0, []
            if line is not None:
                piece.append(line)
                size += len(line) + 1
        held.clear()

    for b in blocks:
        if b["kind"] == "heading":
            flush()
            level = b["level"] or 1
            while levels and levels[-1] >= level:
                levels.pop()
                path.pop()
            levels.append(level)
            path.append(b["body"])
        elif b["kind"] == "table":
            flush()
            rows = [list(r) for r in b["rows"]]
            for i, part in enumerate(split_table(rows[:1], rows[1:], soft, hard) if len(rows) > 1 else split_table([], rows, soft, hard)):
                put(part, "table", b["pos"], i + 1)
        elif b["kind"] != "code":
            held_from = held_from if held else b["pos"]
            held.append(b["body"])
    flush()
    return out


def chunks_of(docs: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """Chunks of documents (doc_id, blocks array of BLOCK): code is skipped; a heading ends what is gathered; text is
    packed and kept from USEFUL characters on, after its section path; tables are split. A document is one row, so
    nothing is shuffled."""
    part = "struct<text:string,section_path:array<string>,content_type:string,source_block:int,table_part:int>"
    names = ("text", "section_path", "content_type", "source_block", "table_part")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("text", pa.string()), ("section_path", pa.list_(pa.string())), ("content_type", pa.string()), ("source_block", pa.int32()), ("table_part", pa.int32())]))
        for batch in batches:
            made = [[dict(zip(names, c)) for c in assembled(blocks or [], soft, hard)] for blocks in batch.column("blocks").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, kind)], ["doc_id", "parts"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("blocks").cast(f"array<{BLOCK}>")).mapInArrow(run, f"doc_id long, parts array<{part}>")
    rows = rows.select("doc_id", F.posexplode("parts").alias("index", "p"))
    return rows.select("doc_id", "index", "p.text", text.section_label("p.section_path").alias("section"), "p.section_path", "p.content_type", F.lit(VERSION).alias("chunk_version"), "p.source_block", "p.table_part")


def chunks(blocks: DataFrame, soft: int = SOFT, hard: int = HARD) -> DataFrame:
    """The same of blocks that are rows (doc_id, pos, kind, level, body, rows)."""
    own = F.array_sort(F.collect_list(F.struct(F.col("pos").cast("int").alias("pos"), "kind", F.col("level").cast("int").alias("level"), "body", "rows")))
    return chunks_of(blocks.groupBy("doc_id").agg(own.alias("blocks")), soft, hard)


def blocks_in_rows(docs: DataFrame) -> DataFrame:
    """doc_id, blocks of plain texts: lines that hold bars are tables of one row, others text; blank lines are none."""
    line = lambda body, i: F.struct(i.alias("pos"), F.when(F.contains(body, F.lit("|")), "table").otherwise("text").alias("kind"), F.lit(None).cast("int").alias("level"), body.alias("body"), F.when(F.contains(body, F.lit("|")), F.array(F.split(body, r"\s*\|\s*"))).alias("rows"))
    return docs.select("doc_id", F.filter(F.transform(F.split("text", "\n"), line), lambda b: text.strip(b["body"]) != "").alias("blocks"))
