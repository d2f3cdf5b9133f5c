"""Merkle manifest of a dataset: operator 11, by concatenated levels.

A leaf is the SHA-256 of a row's columns. The leaves of a source, by ascending doc_id, are numbered and cut into aligned
blocks of BLOCK leaves. A block keeps each of its levels as one string of hexadecimal digests: a parent is the hash of a
fixed-width substring of three digests, and what flanks a digest in its run are its siblings. As BLOCK is a power of
three, a block comes to one node of the tree whatever lies beside it, and the blocks' nodes are leaves of the next
round, until a source has one node: its subroot. The subroots, ordered by source, are the leaves of one more tree, whose
node is the root. Siblings are handed down the same way, from the root to the blocks and there to the rows.

Rows are numbered by a range partitioning and counts of its parts, so no source, however large, is sorted or kept in one
task; after the leaves are made only digests are shuffled.

Defined results: a null column hashes as `-`, an empty text as `0:`. Rows of a source without doc_id come first; rows of
one doc_id are ordered by their leaves; rows alike in all are told apart by a number of their own, each with its own
proof. A null doc_id has no decimal form, so such a row isn't tampered with. A null source is a source of its own, before
all others. An empty table gives no rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm.common import table, written

#: Consecutive nodes that have one parent; the hexadecimal digits of a digest.
FAN, WIDTH = 3, 64
#: Levels of a block, and its leaves.
LEVELS = 5
BLOCK = FAN**LEVELS
#: Rows of a small table (of some hundred bytes) that are broadcast at most; beyond it, they are joined by a shuffle.
BROADCAST_ROWS = 20_000
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def leaf(doc_id: Column, source: Column, lang: Column, n_chars: Column, text: Column) -> Column:
    """Each value with its length in bytes before it, so that no two rows are written alike."""

    def part(value: Column) -> Column:
        value = value.cast("string")
        return F.when(value.isNull(), "-").otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))

    return digest(F.concat(*map(part, (doc_id, source, lang, n_chars, text))))


def leaves(docs: DataFrame) -> DataFrame:
    """doc_id, tree (a source's name after a dot, empty for none), leaf, and tampered: the leaf of the altered text where
    the row is tampered with, else null."""
    c = F.col
    tampers = F.coalesce(F.crc32(c("doc_id").cast("string").cast("binary")) % 2 == 0, F.lit(False))
    less = leaf(*(c(x) for x in COLUMNS[:-1]), F.replace(c("text"), F.lit("\n"), F.lit("")))
    own = leaf(*(c(x) for x in COLUMNS))
    # A text without a line end stays as it is, so its leaf needn't be made twice.
    altered = F.when(tampers & F.contains(c("text"), F.lit("\n")), less).when(tampers, own)
    tree = F.coalesce(F.concat(F.lit("."), c("source").cast("string")), F.lit(""))
    return docs.select("doc_id", tree.alias("tree"), own.alias("leaf"), altered.alias("tampered"))


def small(df: DataFrame) -> DataFrame:
    """A hint to broadcast what has few rows."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def placed(rows: DataFrame, *order: str) -> DataFrame:
    """rows (tree, ...) with at, from 0 in each tree by `order`, and n, the tree's number of rows."""
    rows = written(rows.withColumn("_own", F.monotonically_increasing_id()), "zstd")
    # Ordered parts of the whole table: a number has its part in the high bits, its place in the part in the low ones.
    keys = [F.col(c).asc_nulls_first() for c in ("tree", *order, "_own")]
    ranged = written(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).drop("_own").withColumn("_seq", F.monotonically_increasing_id()), "zstd")
    parts = ranged.groupBy("tree", F.shiftright("_seq", 33).alias("_part")).agg(F.count("*").alias("rows"), F.min("_seq").alias("first"))
    listed = parts.groupBy("tree").agg(F.sort_array(F.collect_list(F.struct("_part", "rows", "first"))).alias("parts"), F.sum("rows").alias("n"))
    earlier = F.expr("aggregate(slice(parts, 1, i), 0L, (sum, p) -> sum + p.rows)")
    starts = listed.select("tree", "n", "parts", F.posexplode("parts").alias("i", "own")).select("tree", "n", F.col("own._part").alias("_part"), (earlier - F.col("own.first")).alias("_shift"))
    return ranged.withColumn("_part", F.shiftright("_seq", 33)).join(small(written(starts)), ["tree", "_part"]).withColumn("at", F.col("_seq") + F.col("_shift")).drop("_part", "_seq", "_shift")


#: The level above a level: substrings of three digests, hashed one by one.
_ABOVE = f"array_join(transform(sequence(0, cast((length(s) - 1) div {FAN * WIDTH} as int)), i -> sha2(cast(substring(s, i * {FAN * WIDTH} + 1, {FAN * WIDTH}) as binary), 256)), '')"
#: As many levels above the leaves as bring a whole tree, or a full block, to one node.
_HEIGHT = "case " + " ".join(f"when n <= {FAN**h} then {h}" for h in range(LEVELS)) + f" else {LEVELS} end"
#: What flanks the node at h.at in each level below the topmost: the rest of its run, on its left and on its right.
_FLANKS = f"""transform(slice(levels, 1, size(levels) - 1), (s, l) -> transform(array(struct(
    cast(floor(pmod(h.at, {BLOCK}) / power({FAN}, l + 1)) as int) * {FAN * WIDTH} as run, cast(floor(pmod(h.at, {BLOCK}) / power({FAN}, l)) as int) * {WIDTH} as own)),
    p -> struct(substring(s, p.run + 1, p.own - p.run) as left, substring(s, p.own + {WIDTH + 1}, p.run + {FAN * WIDTH} - p.own - {WIDTH}) as right))[0])"""


def blocks(nodes: DataFrame, *carried: str) -> DataFrame:
    """Of nodes (tree, at, n, node): tree, block, n, held (an array of at, node and what is carried, by at), and levels,
    from the nodes to the one that the block comes to."""
    held = F.sort_array(F.collect_list(F.struct("at", "node", *carried))).alias("held")
    rows = nodes.groupBy("tree", F.floor(F.col("at") / BLOCK).cast("long").alias("block")).agg(F.first("n").alias("n"), held)
    up = f"aggregate(sequence(1, {LEVELS}), array(array_join(held.node, '')), (levels, h) -> if(h > {_HEIGHT}, levels, concat(levels, transform(array(element_at(levels, -1)), s -> {_ABOVE}))))"
    return rows.withColumn("levels", F.expr(up))


def climbed(nodes: DataFrame) -> DataFrame:
    """tree, at, path, top of nodes (tree, at, n, node): each node's siblings up to the one node that its tree comes to."""
    rows = written(blocks(nodes), "zstd")
    held = rows.withColumn("h", F.explode("held")).select("tree", "block", F.col("h.at").alias("at"), F.expr(_FLANKS).cast(PATH).alias("path"), F.element_at("levels", -1).alias("top"), "n")
    whole = held.where(F.col("n") <= BLOCK).select("tree", "at", "path", "top")
    if not rows.where(F.col("n") > BLOCK).limit(1).count():
        return whole
    above = climbed(higher(rows)).select("tree", F.col("at").alias("block"), F.col("path").alias("rest"), F.col("top").alias("_top"))
    rest = held.where(F.col("n") > BLOCK).drop("top").join(above, ["tree", "block"])
    return whole.unionByName(rest.select("tree", "at", F.concat("path", "rest").alias("path"), F.col("_top").alias("top")))


def higher(rows: DataFrame) -> DataFrame:
    """The nodes of the next round: what the blocks of trees with more than one block come to."""
    return rows.where(F.col("n") > BLOCK).select("tree", F.col("block").alias("at"), F.ceil(F.col("n") / BLOCK).alias("n"), F.element_at("levels", -1).alias("node"))


def manifest(docs: DataFrame) -> DataFrame:
    """doc_id, leaf, tampered, subroot, root and path (left and right siblings, level by level to the root) of each row."""
    rows = placed(leaves(docs), "doc_id", "leaf").withColumnRenamed("leaf", "node")
    rows = written(blocks(rows, "doc_id", "tampered"), "zstd")
    tops = written(climbed(higher(rows)).select("tree", F.col("at").alias("block"), F.col("path").alias("rest"), "top"), "zstd")
    single = rows.where(F.col("n") <= BLOCK).select("tree", F.element_at("levels", -1).alias("subroot"))
    subroots = written(single.unionByName(tops.groupBy("tree").agg(F.first("top").alias("subroot"))), "zstd")
    one = placed(subroots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), F.col("subroot").alias("node")), "name").select("tree", "name", "at", "n", "node")
    one = written(one)
    last = one.select("name", "at", F.col("node").alias("subroot")).join(climbed(one.drop("name")).select("at", F.col("path").alias("last"), F.col("top").alias("root")), "at")
    last = written(last.select(F.col("name").alias("tree"), "subroot", "last", "root"), "zstd")
    full = rows.join(small(tops.drop("top")), ["tree", "block"], "left").join(small(last), "tree")
    upper = F.concat(F.coalesce("rest", F.array().cast(PATH)), "last")
    own = full.select("subroot", "root", "levels", upper.alias("upper"), F.explode("held").alias("h"))
    return own.select("h.doc_id", F.col("h.node").alias("leaf"), "h.tampered", "subroot", "root", F.concat(F.expr(_FLANKS).cast(PATH), "upper").alias("path"))


def proof(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda p: F.concat(p["left"], p["right"])), ""))


def folded(node: Column, path: Column) -> Column:
    """The root that a leaf comes to with these siblings."""
    return F.aggregate(path, node, lambda acc, p: digest(F.concat(p["left"], acc, p["right"])))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = manifest(table(spark, sf_dir, "documents"))
    rows = rows.withColumns({"proof_sha256": proof(F.col("path")), "folded_root": folded(F.coalesce("tampered", "leaf"), F.col("path"))})
    return rows.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))


#: Levels that the SQL spells out: trees of up to 3^12 rows a source and as many sources.
_SQL_LEVELS = 12


def _sql() -> str:
    part = lambda x: f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END"
    hashed = lambda text: "sha256(" + " || ".join([*map(part, COLUMNS[:-1]), part(text)]) + ")"
    crc = """xor(list_reduce(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT)),
        lambda crc, c: list_reduce(range(8)::UBIGINT[], lambda x, i: xor(x >> 1, 3988292384::UBIGINT * (x & 1)), xor(crc, c)), 4294967295::UBIGINT), 4294967295::UBIGINT)"""
    ctes = [
        f"a AS (SELECT *, {hashed('text')} AS leaf, CASE WHEN {crc} % 2 = 0 THEN {hashed('''replace(text, chr(10), '')''')} END AS tampered FROM documents)",
        "b AS (SELECT doc_id, source, leaf, coalesce(tampered, leaf) AS fold, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos FROM a)",
    ]

    def tree(p: str, nodes: str, rows: str) -> None:
        """Levels of a tree from its nodes (tree, pos, node), and for rows (tree, pos, fold, proof) what they come to."""
        ctes.append(f"{p}0 AS (SELECT *, count(*) OVER (PARTITION BY tree) AS n FROM ({nodes}))")
        ctes.append(f"{p}p0 AS ({rows})")
        for i in range(_SQL_LEVELS):
            left, right = "coalesce(array_to_string(nodes[1 : p.pos % 3], ''), '')", "coalesce(array_to_string(nodes[p.pos % 3 + 2 : 3], ''), '')"
            ctes.append(f"{p}r{i} AS (SELECT tree, pos // 3 AS run, any_value(n) AS n, list(node ORDER BY pos) AS nodes FROM {p}{i} GROUP BY ALL)")
            ctes.append(f"{p}{i + 1} AS (SELECT tree, run AS pos, CASE WHEN n = 1 THEN nodes[1] ELSE sha256(array_to_string(nodes, '')) END AS node, count(*) OVER (PARTITION BY tree) AS n FROM {p}r{i})")
            step = f"CASE WHEN n = 1 THEN fold ELSE sha256({left} || fold || {right}) END AS fold, CASE WHEN n = 1 THEN proof ELSE proof || {left} || {right} END AS proof"
            ctes.append(f"{p}p{i + 1} AS (SELECT p.* REPLACE (p.pos // 3 AS pos, {step}) FROM {p}p{i} p JOIN {p}r{i} r ON p.tree IS NOT DISTINCT FROM r.tree AND p.pos // 3 = r.run)")

    tree("s", "SELECT source AS tree, pos, leaf AS node FROM b", "SELECT doc_id, source, leaf, source AS tree, pos, fold, '' AS proof FROM b")
    ctes.append(f"t AS (SELECT tree AS source, node AS subroot, row_number() OVER (ORDER BY tree NULLS FIRST) - 1 AS pos FROM s{_SQL_LEVELS})")
    tree("r", "SELECT 0 AS tree, pos, subroot AS node FROM t", f"SELECT doc_id, leaf, subroot, 0 AS tree, t.pos, fold, proof FROM sp{_SQL_LEVELS} p JOIN t ON p.source IS NOT DISTINCT FROM t.source")
    return f"WITH {', '.join(ctes)} SELECT doc_id, leaf, subroot, r.node AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = r.node AS verified FROM rp{_SQL_LEVELS} p, r{_SQL_LEVELS} r"


OP11_SQL = _sql()
