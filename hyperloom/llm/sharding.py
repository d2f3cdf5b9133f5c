"""Resharding by minimum-cost flow: operator 3.

From the bytes that each old shard holds and the bytes that each new one may hold, a flow of least cost says how
many bytes go from which shard to which; a byte that stays costs nothing. Documents of a shard are ordered by
falling size class, and the flow cuts that order: what stays comes first, then what goes to each other shard, so
the cuts fall among small documents and the shards' sizes come out nearly equal.

Only sums of blocks of documents reach the driver, at most SIZE_CLASSES * MOST_PARTS for each shard.

Defined results: a null text has no bytes and the checksum of an empty text; a null source is one more source;
repeated rows are placed and written one by one. Other columns pass through `rewrite` untouched.
"""

from __future__ import annotations

import heapq
import uuid
from collections import defaultdict

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hyperloom.llm.common import ROW, cut, numbered, shared_folder, table

#: Rows of a block that one task orders, and the most parts of a size class.
PART_ROWS, MOST_PARTS, SIZE_CLASSES = 2000, 1024, 64
#: Setting that names the folder of the shards written last.
WRITTEN_TO = "spark.hyperloom.shards"


def text_bytes(text: Column) -> Column:
    return (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")


def min_cost_flow(have: list[int], room: list[int], cost: dict[tuple[int, int], int] | None = None) -> dict[tuple[int, int], int]:
    """{(from, to): bytes} of least total cost. have and room have equal sums; a byte costs cost[from, to], by
    default 1, and 0 where it stays. Shortest augmenting paths with potentials, on shards only."""
    n = len(have)
    source, sink = 2 * n, 2 * n + 1
    price, left = defaultdict(int), defaultdict(int)
    around: dict[int, list[int]] = defaultdict(list)

    def link(a: int, b: int, most: int, c: int) -> None:
        around[a].append(b)
        around[b].append(a)
        left[a, b], price[a, b], price[b, a] = most, c, -c

    for i in range(n):
        link(source, i, have[i], 0)
        link(n + i, sink, room[i], 0)
        for j in range(n):
            link(i, n + j, sum(have), (cost or {}).get((i, j), int(i != j)))
    height = defaultdict(int)
    while True:
        far, came, queue = {source: 0}, {}, [(0, source)]
        while queue:
            d, a = heapq.heappop(queue)
            if d > far[a]:
                continue
            for b in around[a]:
                if left[a, b] > 0 and (e := d + price[a, b] + height[a] - height[b]) < far.get(b, 1 << 62):
                    far[b], came[b] = e, a
                    heapq.heappush(queue, (e, b))
        if sink not in far:
            break
        for a, d in far.items():
            height[a] += d
        path, b = [], sink
        while b != source:
            path.append((came[b], b))
            b = came[b]
        most = min(left[e] for e in path)
        for a, b in path:
            left[a, b] -= most
            left[b, a] += most
    return {(i, j): f for i in range(n) for j in range(n) if (f := left[n + j, i]) > 0}


def place(docs: DataFrame, shards: int, old_shard: Column, room: list[int] | None = None) -> tuple[DataFrame, dict[tuple[int, int], int]]:
    """(doc_id, size, text_crc32, old_shard, shard, slot) for every row, and the flow in bytes.

    `room` are the new capacities in bytes; by default the shards share all bytes evenly. Rows that are numbered keep
    their number.
    """
    spark = docs.sparkSession
    number = [ROW] if ROW in docs.columns else []
    light = cut(docs.select(*number, "doc_id", text_bytes(F.col("text")).alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"), old_shard.cast("int").alias("old_shard")))
    parts = max(1, min(light.count() // PART_ROWS, MOST_PARTS))
    falling = (F.lit(SIZE_CLASSES) - F.floor(F.log2("size"))).cast("int")
    dealt = F.xxhash64(*(number or ["doc_id", "text_crc32"]))  # by number where there is one, so that equal rows are dealt out too
    light = light.withColumns({"falling": falling, "part": F.pmod(dealt, F.lit(parts)).cast("int")})
    block = ["old_shard", "falling", "part"]
    sums = light.groupBy(*block).agg(F.sum("size").alias("bytes")).orderBy(*block).toPandas()
    have = [int(sums.bytes[sums.old_shard == i].sum()) for i in range(shards)]
    total = sum(have)
    room = room or [total // shards + (i < total % shards) for i in range(shards)]
    flow = min_cost_flow(have, room)
    sums["begin"] = sums.groupby("old_shard").bytes.cumsum() - sums.bytes
    begins = spark.createDataFrame([tuple(int(x) for x in r) for r in sums[[*block, "begin"]].itertuples(index=False)], "old_shard int, falling int, part int, begin long")
    cuts = F.lit(None).cast("int")
    middle = F.col("begin") + F.col("before") + F.floor(F.col("size") / 2)
    for i in range(shards):
        end, target = 0, F.lit(i)
        for j in [i, *(j for j in range(shards) if j != i)]:
            if flow.get((i, j)):
                target = F.when(middle >= F.lit(end), F.lit(j)).otherwise(target) if end else F.lit(j)
                end += flow[i, j]
        cuts = F.when(F.col("old_shard") == i, target).otherwise(cuts)
    order = Window.partitionBy(*block).orderBy(F.col("size").desc(), "doc_id", "text_crc32", *number)
    placed = (
        light.withColumn("before", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size"))
        .withColumn("row", F.row_number().over(order))
        .join(F.broadcast(begins), block)
        .withColumn("shard", cuts.cast("int"))
    )
    pieces = placed.groupBy("shard", *block).agg(F.count("*").alias("rows"), F.min("row").alias("first")).orderBy("shard", *block).toPandas()
    pieces["base"] = pieces.groupby("shard").rows.cumsum() - pieces.rows - pieces["first"]
    bases = spark.createDataFrame([tuple(int(x) for x in r) for r in pieces[["shard", *block, "base"]].itertuples(index=False)], "shard int, old_shard int, falling int, part int, base long")
    out = placed.join(F.broadcast(bases), ["shard", *block]).withColumn("slot", (F.col("base") + F.col("row")).cast("long"))
    return out.select(*number, "doc_id", "size", "text_crc32", "old_shard", "shard", "slot"), flow


def affected(flow: dict[tuple[int, int], int]) -> list[int]:
    """Shards that lose or gain documents; the files of the others stay as they are."""
    return sorted({x for (i, j) in flow if i != j for x in (i, j)})


def rewrite(docs: DataFrame, placed: DataFrame, flow: dict[tuple[int, int], int], folder: str, whole: bool = False) -> None:
    """Write the affected shards' documents, or all shards' (`whole`), to folder/new_shard=N, each row once.

    Numbered rows are joined by their number; others need doc_ids that are unique and not null.
    """
    key = ROW if ROW in docs.columns and ROW in placed.columns else "doc_id"
    if key != ROW and docs.groupBy(key).count().where("count > 1 or doc_id is null").limit(1).count():
        raise ValueError("doc_ids repeat or are null: number the rows before they are placed")
    shards = (placed if whole else placed.where(F.col("shard").isin(affected(flow)))).select(key, F.col("shard").alias("new_shard"))
    # Rows are dealt by their number, evenly; a deal by shard would put all of a large shard's texts in a few tasks.
    rows = docs.join(shards.hint("shuffle_hash"), key).drop(ROW)
    rows.write.option("compression", "zstd").option("partitionOverwriteMode", "dynamic").partitionBy("new_shard").mode("overwrite").parquet(folder)


def reshard(docs: DataFrame, shards: int, old_shard: Column, room: list[int] | None = None) -> DataFrame:
    """What `place` says of every row, after the documents were written to a new folder in the shared one, all shards
    of them, as no old file is there. The session's setting WRITTEN_TO names the folder."""
    rows = numbered(docs)
    placed, flow = place(rows, shards, old_shard, room)
    placed = cut(placed)
    folder = f"{shared_folder(docs.sparkSession)}/hyperloom-shards-{uuid.uuid4().hex}"
    rewrite(rows, placed, flow, folder, whole=True)
    docs.sparkSession.conf.set(WRITTEN_TO, folder)
    return placed.drop(ROW)


def by_source(shards: int) -> Column:
    """The layout to start from: each source's documents in one shard."""
    return F.pmod(F.xxhash64("source"), F.lit(shards))


def op3_flow_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = reshard(table(spark, sf_dir, "documents"), 8, by_source(8))
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "old_shard")
