"""Canonical exact fingerprints: operator 10, with DataFrame functions only.

A text's canonical form is its NFKC normalisation, case-folded, with every run of white space as one space and
none at the ends. Its fingerprint is a 128-bit xxhash of that form in hexadecimal. Hashes that come more than once
have their forms compared byte by byte; where different forms share one (never seen), each gets its SHA-256 appended,
so equal fingerprints always mean equal canonical forms. The likeness of two fingerprints is 1 if they are equal,
else 0.

Texts are shuffled once, to bring each beside the next one. Hashes are made before that and carried along.

Defined results: a null text is an empty text. A row without doc_id comes after all others; rows of one doc_id, or
without one, are ordered by their texts' hashes, then by text. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.llm.common import cut, table

#: Colliding hashes that are written into the plan at most; beyond it they are joined.
LITERAL_HASHES = 1000
#: Repeated hashes (32 bytes each) that are broadcast at most; beyond it they are joined by a shuffle.
BROADCAST_HASHES = 1_000_000
#: Rows of a block in which texts are ordered, and the most blocks.
BLOCK_ROWS, MOST_BLOCKS = 500, 1 << 16


def canonical(text: Column) -> Column:
    def nfkc(x: Column) -> Column:
        return F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), x, F.lit(True))

    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), nfkc(text), F.lit(True))
    return F.trim(F.regexp_replace(nfkc(folded), r"[\s\p{Z}\x85]+", " "))


def wide_hash(form: Column) -> Column:
    return F.lower(F.concat(F.lpad(F.hex(F.xxhash64(form)), 16, "0"), F.lpad(F.hex(F.xxhash64(F.lit("second"), form)), 16, "0")))


def collided(docs: DataFrame) -> DataFrame:
    """Hashes whose bucket holds different canonical forms. Hashes are counted first; only forms whose hash repeats are
    shuffled, equal ones merged before."""
    forms = docs.select(canonical(F.coalesce("text", F.lit(""))).alias("form")).withColumn("hash", wide_hash(F.col("form")))
    repeated = cut(forms.groupBy("hash").agg(F.count("*").alias("rows")).where("rows > 1").select("hash"))
    near = F.broadcast(repeated) if repeated.count() <= BROADCAST_HASHES else repeated
    same = forms.join(near, "hash", "left_semi").select("form", "hash").distinct()
    return same.groupBy("hash").agg(F.count("*").alias("forms")).where("forms > 1").select("hash")


def block_bounds(keyed: DataFrame) -> DataFrame:
    """One row that says how rows (at) go to blocks: bounds of ranges of about BLOCK_ROWS rows, and for each `at` that
    more rows share than that, into how many parts they go. As data of a row, so that no plan holds thousands of
    literals, and made once, as the bounds are approximate."""
    rows = keyed.count()
    ranges = max(1, min(rows // BLOCK_ROWS, MOST_BLOCKS))
    limit = max(2 * BLOCK_ROWS, rows // MOST_BLOCKS)
    hot = {r["at"]: -(-r["rows"] // limit) for r in keyed.groupBy("at").agg(F.count("*").alias("rows")).where(F.col("rows") > limit).collect()}
    cuts = keyed.agg(F.percentile_approx("at", [i / ranges for i in range(1, ranges)] or [1.0], max(10_000, 10 * ranges))).first()[0] or []
    bounds = sorted({*cuts, *hot} - {None}) or [0]
    step = max(1, round(len(bounds) ** 0.5))
    groups = [bounds[i : i + step] for i in range(0, len(bounds), step)]
    return keyed.sparkSession.createDataFrame([([g[-1] for g in groups], [g + [g[-1]] * (step - len(g)) for g in groups], hot)], "coarse array<long>, fine array<array<long>>, hot map<long,int>")


def in_blocks(keyed: DataFrame, bounds: DataFrame) -> DataFrame:
    """keyed (at, order) with block. Later blocks hold smaller ats, and of one `at` with several larger orders."""
    at, parts, step = F.col("at"), F.element_at("hot", F.col("at")), F.size(F.element_at("fine", 1))
    below = F.least(F.size(F.filter("coarse", lambda x: x < at)), F.size("coarse") - 1)
    range_ = below * step + F.size(F.filter(F.element_at("fine", below + 1), lambda x: x < at))
    place = F.when(parts.isNotNull(), 2 * range_ + 1).otherwise(2 * range_)
    part = F.coalesce(F.floor((F.col("order").cast("double") + 2.0**63) / 2.0**64 * parts).cast("int"), F.lit(0))
    return keyed.crossJoin(F.broadcast(bounds)).withColumn("block", F.struct((-place).alias("range"), part.alias("part"))).drop("coarse", "fine", "hot")


def with_next(docs: DataFrame) -> DataFrame:
    """Each row's doc_id, text, hash, next_text and next_hash: of the next row by descending doc_id, after the last the
    first. The last row of a block continues with the first of the block after it, which comes to it as a guest."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select("doc_id", text.alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("at"), F.xxhash64(text).alias("order"))
    bounds = block_bounds(keyed.select("at"))
    firsts = in_blocks(keyed.select("at", "order"), bounds).groupBy("block").agg(F.min(F.struct((-F.col("at").cast("decimal(20,0)")).alias("down"), "order", "at")).alias("first")).select("block", "first.at", "first.order").orderBy("block").collect()
    if not firsts:
        return keyed.select("doc_id", "text", F.lit("").alias("hash"), F.col("text").alias("next_text"), F.lit("").alias("next_hash"))
    before = [(r["at"], r["order"], firsts[i - 1]["block"]) for i, r in enumerate(firsts)]
    heads = docs.sparkSession.createDataFrame(before, "at long, order long, block struct<range:int,part:int>")
    guests = keyed.join(F.broadcast(heads), ["at", "order"]).groupBy("block").agg(F.min("text").alias("text"))
    hashed = lambda df: df.withColumn("hash", wide_hash(canonical(F.col("text"))))
    own = hashed(in_blocks(keyed, bounds)).select("doc_id", "text", "at", "order", "hash", "block", F.lit(0).alias("guest"))
    none = lambda kind: F.lit(None).cast(kind)
    kind = keyed.schema["doc_id"].dataType
    guests = hashed(guests).select(none(kind).alias("doc_id"), "text", none("long").alias("at"), none("long").alias("order"), "hash", "block", F.lit(1).alias("guest"))
    order = Window.partitionBy("block").orderBy("guest", F.col("at").desc(), "order", "text")
    every = own.unionByName(guests).withColumns({"next_text": F.lead("text").over(order), "next_hash": F.lead("hash").over(order)})
    return every.where("guest = 0").select("doc_id", "text", "hash", "next_text", "next_hash")


def with_clash(rows: DataFrame, columns: list[str], clashes: DataFrame) -> DataFrame:
    """Adds for each column of hashes whether it is among the clashes."""
    found = [r[0] for r in clashes.take(LITERAL_HASHES + 1)]
    for c in columns:
        if len(found) > LITERAL_HASHES:
            rows = rows.join(clashes.select(F.col("hash").alias(c), F.lit(True).alias(f"_{c}")), c, "left").withColumn(f"{c}_clash", F.coalesce(f"_{c}", F.lit(False))).drop(f"_{c}")
        else:
            rows = rows.withColumn(f"{c}_clash", F.col(c).isin(found) if found else F.lit(False))
    return rows


def told_apart(hash_: Column, form: Column, clash: Column) -> Column:
    return F.when(clash, F.concat(hash_, F.lit("-"), F.sha2(form.cast("binary"), 256))).otherwise(hash_)


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id and fingerprint of every row of docs."""
    form = canonical(F.coalesce("text", F.lit("")))
    rows = with_clash(docs.select("doc_id", form.alias("form")).withColumn("hash", wide_hash(F.col("form"))), ["hash"], collided(docs))
    return rows.select("doc_id", told_apart(F.col("hash"), F.col("form"), F.col("hash_clash")).alias("fingerprint"))


def op10_canonical_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    c = F.col
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.expr("substring(text, 1, int(length(text) - floor(length(text) / 2)))"), F.substring(c("next_text"), F.lit(1), half))
    rows = with_next(docs).withColumn("edited", edited).withColumn("edited_form", canonical(c("edited"))).withColumn("edited_hash", wide_hash(c("edited_form")))
    rows = with_clash(rows, ["hash", "edited_hash"], collided(docs))
    form = canonical(c("text"))  # asked for only where hashes are equal or clash
    alike = lambda other, other_form: F.when(c("hash") == other, form == other_form).otherwise(F.lit(False))
    near_edited, near_next = alike(c("edited_hash"), c("edited_form")), alike(c("next_hash"), canonical(c("next_text")))
    here = (c("hash") == c("edited_hash")) & ~near_edited  # a text and its edited form clash
    return rows.select(
        "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2(c("edited").cast("binary"), 256).alias("edited_sha256"),
        told_apart(c("hash"), form, c("hash_clash") | here).alias("fingerprint"), told_apart(c("edited_hash"), c("edited_form"), c("edited_hash_clash") | here).alias("edited_fingerprint"),
        near_edited.cast("double").alias("near_edited"), near_next.cast("double").alias("near_next"),
    )
