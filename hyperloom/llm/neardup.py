"""Near-duplicate documents by min-max hashing: operator 4.

Each permutation of the hashed shingles gives two signature entries, its smallest and its largest value, so
a signature of 2k entries costs k hash evaluations a shingle. Entries are banded; documents that share a band
are candidates, and every link is confirmed on the two full shingle sets.

Defined results: a document without words (empty or null text) has an empty set, links with nothing and is its
own component. Rows of one doc_id count as one document. A row without doc_id takes part in nothing: its
component is null and it is not kept. Other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import kernels as k
from hyperloom.llm.common import cut, table
from hyperloom.llm.components import components

#: Signature entries in a band; documents with a tenth of their shingles in common rarely share so many.
ROWS = 6
#: Largest chance that a pair at the threshold shares no band.
MISS = 1e-5
#: Counts in the sketch that bounds two sets' difference from below.
SKETCH = 128
#: Members of a bucket that are compared in one block.
BLOCK = 256
#: Ids of candidate documents that are broadcast at most (8 bytes each); beyond it, they are joined by a shuffle.
BROADCAST_IDS = 1_000_000
#: Pairs with one document that one task confirms; its set is handed to as many tasks as it has more.
HUB = 2000


def bands_for(threshold: float, rows: int = ROWS, miss: float = MISS) -> int:
    """An even number of entries, so that all of a permutation's two are used."""
    bands = math.ceil(math.log(miss) / math.log1p(-(threshold**rows)))
    return bands + (bands * rows) % 2


def _sets(texts: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    grams, at = k.ngrams_of(*k.words_of(texts), shingle)
    for i in range(len(at) - 1):
        yield np.unique(grams[at[i] : at[i + 1]])


def signatures(docs: DataFrame, shingle: int, bands: int, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, d1 and d2 (a 128-bit digest of the whole set), bands (array), sketch (counts)."""
    perms = bands * rows // 2
    odd, shift, weights = k.random_words(perms, 21) | k.U64(1), k.random_words(perms, 22), k.random_words(rows, 23) | k.U64(1)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in k.slices(batches):
            grams, at = k.ngrams_of(*k.words_of(batch.column("text")), shingle)
            full = np.flatnonzero(np.diff(at))
            entries = np.empty((bands * rows, len(full)), k.U64)
            for j in range(perms if len(full) else 0):
                value = (grams ^ shift[j]) * odd[j]
                entries[2 * j] = np.minimum.reduceat(value, at[full])
                entries[2 * j + 1] = np.maximum.reduceat(value, at[full])
            keys = np.stack([k.mix((entries[b * rows : (b + 1) * rows] * weights[:, None]).sum(0, dtype=k.U64) + k.U64(b)) for b in range(bands)], 1)
            n, digest, sketch = np.zeros(batch.num_rows, np.int64), np.zeros((2, batch.num_rows), k.U64), [b""] * batch.num_rows
            for i in full:
                own = np.unique(grams[at[i] : at[i + 1]])
                n[i], digest[0, i], digest[1, i] = len(own), own.sum(dtype=k.U64), k.mix(own).sum(dtype=k.U64)
                sketch[i] = np.minimum(np.bincount((own % k.U64(SKETCH)).astype(np.int64), minlength=SKETCH), 255).astype(np.uint8).tobytes()
            sizes = np.zeros(batch.num_rows + 1, np.int32)
            sizes[1:][full] = bands
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes, dtype=np.int32)), pa.array(keys.reshape(-1).view(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").cast(pa.int64()), pa.array(n), pa.array(digest[0].view(np.int64)), pa.array(digest[1].view(np.int64)), lists, pa.array(sketch, pa.binary())], ["doc_id", "n_shingles", "d1", "d2", "bands", "sketch"])

    return docs.select("doc_id", "text").mapInArrow(sign, "doc_id long, n_shingles long, d1 long, d2 long, bands array<long>, sketch binary")


def confirmed(docs: DataFrame, pairs: DataFrame, shingle: int, percent: int) -> DataFrame:
    """The pairs (a, b) of doc_ids with 100 * intersection >= percent * union, on their full shingle sets."""
    pairs = cut(pairs)
    ids = cut(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct())
    ids = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids

    def full(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in k.slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([s.tobytes() for s in _sets(batch.column("text"), shingle)], pa.binary())], ["doc_id", "own"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column("own_a"), batch.column("own_b")):
                x, y = np.frombuffer(x.as_buffer(), k.U64), np.frombuffer(y.as_buffer(), k.U64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                yes.append(100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select(["a", "b"]).filter(pa.array(yes, pa.bool_()))

    # A document of many pairs is a hub: its pairs are dealt to several tasks, and its set to each of them.
    hubs = cut(pairs.groupBy("a").agg(F.ceil(F.count("*") / HUB).cast("int").alias("salts")).where("salts > 1"))
    hubs = F.broadcast(hubs) if hubs.count() <= BROADCAST_IDS else hubs
    dealt = pairs.join(hubs, "a", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("salts")).cast("int"), F.lit(0)))
    sets = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(ids, "doc_id", "left_semi").mapInArrow(full, "doc_id long, own binary")
    own_b = sets.select(F.col("doc_id").alias("b"), F.col("own").alias("own_b"))
    own_a = sets.select(F.col("doc_id").alias("a"), F.col("own").alias("own_a")).join(hubs, "a", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return dealt.drop("salts").join(own_b, "b").join(own_a, ["a", "salt"]).select("a", "b", "own_a", "own_b").mapInArrow(compare, "a long, b long").distinct()


def _block_pairs(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by (key, i, j); a block's pairs of different components whose sketches allow a link."""
    most = (100 - percent) / (100 + percent)

    def pairs(rows: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(rows)
        ids, n, comp, part = (t.column(c).to_numpy() for c in ("rep", "n_shingles", "comp", "part"))
        sketch = np.frombuffer(b"".join(t.column("sketch").to_pylist()), np.uint8).reshape(len(ids), SKETCH).astype(np.int16)
        split = t.column("i")[0].as_py() != t.column("j")[0].as_py()
        a, b = [], []
        for x in range(len(ids) - 1):
            apart = np.abs(sketch[x + 1 :] - sketch[x]).sum(1)
            yes = (comp[x + 1 :] != comp[x]) & (apart <= most * (n[x + 1 :] + n[x]) + 1e-6)
            if split:
                yes &= part[x + 1 :] != part[x]
            y = ids[x + 1 :][yes]
            a.append(np.minimum(y, ids[x]))
            b.append(np.maximum(y, ids[x]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(a or [np.zeros(0, np.int64)])), pa.array(np.concatenate(b or [np.zeros(0, np.int64)]))], ["a", "b"])

    held, last = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        marks = np.stack([batch.column(c).to_numpy() for c in ("key", "i", "j")], 1)
        edges = [0, *(np.flatnonzero((marks[1:] != marks[:-1]).any(1)) + 1), len(marks)]
        for begin, end in zip(edges[:-1], edges[1:]):
            if held and (marks[begin] != last).any():
                yield pairs(held)
                held = []
            held.append(batch.slice(begin, end - begin))
            last = marks[begin]
    if held:
        yield pairs(held)


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs (doc_id, text).

    1. Equal sets become one class, known by its smallest doc_id, so groups of copies are one row from here on.
    2. Classes that share a band: each is first compared with one class, the most popular that it shares a band with,
       that is, whose bands have most members. Of a text and its many edited copies, that is the one most like all.
    3. Buckets that still hold several components give their pairs of different components, in blocks of BLOCK
       by BLOCK members; the members of a bucket's largest component meet all others, but not each other. Pairs that
       the sketches rule out (a lower bound of the sets' difference, so no link is lost) are left out before any is
       confirmed.
    """
    signed = cut(signatures(docs, shingle, bands_for(percent / 100)))
    classes = cut(
        signed.where("n_shingles > 0 and doc_id is not null")
        .groupBy("d1", "d2")
        .agg(F.min("doc_id").alias("rep"), F.first("n_shingles").alias("n_shingles"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch"))
    )
    banded = classes.select("rep", F.explode("bands").alias("key"))
    shared = banded.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    members = cut(banded.join(shared, "key"))
    popular = members.groupBy("rep").agg(F.sum("members").alias("popularity"))
    ranked = members.join(popular, "rep").select("key", "rep", F.struct("popularity", (-F.col("rep")).alias("rep")).alias("place"))
    hubs = ranked.groupBy("key").agg(F.max("place").alias("hub"))
    stars = ranked.join(hubs, "key").where("rep <> -hub.rep").groupBy(F.col("rep").alias("b")).agg(F.max("hub").alias("hub")).select((-F.col("hub.rep")).alias("a"), "b")
    links = cut(confirmed(docs, stars, shingle, percent))
    found = components(links)
    labelled = members.join(found.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
    per = cut(labelled.groupBy("key", "comp").agg(F.count("*").alias("n")))
    mixed = per.groupBy("key").agg(F.max_by("comp", F.struct("n", "comp")).alias("largest"), F.max("n").alias("inside"), F.sum("n").alias("members"), F.count("*").alias("comps")).where("comps > 1")
    parts = lambda n: F.greatest(F.ceil(n / BLOCK), F.lit(1)).cast("int")
    mixed = mixed.select("key", "largest", parts(F.col("inside")).alias("large_parts"), parts(F.col("members") - F.col("inside")).alias("rest_parts"))
    # Parts of the largest component have even numbers, the others odd ones; only the others meet every part.
    large = F.col("comp") == F.col("largest")
    own = F.when(large, 2 * F.pmod(F.xxhash64("rep"), F.col("large_parts"))).otherwise(2 * F.pmod(F.xxhash64("rep"), F.col("rest_parts")) + 1).cast("int")
    rest = F.transform(F.sequence(F.lit(0), F.col("rest_parts") - 1), lambda i: 2 * i + 1)
    met = F.when(large, rest).otherwise(F.concat(rest, F.transform(F.sequence(F.lit(0), F.col("large_parts") - 1), lambda i: 2 * i)))
    placed = (
        labelled.join(mixed, "key")
        .join(classes.select("rep", "n_shingles", "sketch"), "rep")
        .select("key", "rep", "comp", "n_shingles", "sketch", own.alias("part"), F.explode(met).alias("other"))
        .select("key", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "rep", "comp", "n_shingles", "sketch")
    )
    blocks = placed.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    crossing = blocks.mapInArrow(lambda b: _block_pairs(b, percent), "a long, b long").distinct()
    more = confirmed(docs, crossing, shingle, percent)
    final = components(links.unionByName(more))
    labels = cut(classes.select("d1", "d2", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", F.coalesce("component", "rep").alias("component")))
    own = signed.select("doc_id", "n_shingles", "d1", "d2")
    joined = own.join(labels, ["d1", "d2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return joined.select("doc_id", "n_shingles", component.alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def op4_minmax_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), shingle=3, percent=85)
