"""Language-model scores from a log-frequency Bloom filter: operator 6.

Counts c of words, word pairs and word triples are quantised to levels 1 + floor(log2 c). A filter holds an entry
for every level of an n-gram up to its own; probing level after level until one is missing gives the level back,
never too low, and too high with the filter's rate of false positives. Each order discounts what the levels say about
an n-gram and hands the mass that this frees to the order below:

    p1(t)     = (c(t) + 1) / (N + V + 1)
    p2(t | v) = max(c(v t) - D2, 0) / c(v) + G2[level of c(v)] * p1(t)
    p3(t | u v) = max(c(u v t) - D3, 0) / c(u v) + G3[level of c(u v)] * p2(t | v)

The discounts D come from all training n-grams: n1 / (n1 + 2 n2), where n1 and n2 occur once and twice. The weights G
are D times the mean of 1 / c(n-gram) over all training tokens whose context has that level, which is what the discounts
free. A context that was never seen leaves all to the order below.

The filter is built in segments by ranges of the n-grams' hashes, each from its own share of the counts. Filters
up to `most_bytes` are broadcast at once. Larger ones are broadcast in parts: the rows are numbered and written, and
each pass over them notes the levels that its part knows in a byte for each token and order. Either way the levels of
all rows are written once, without the texts; the weights and the scores are read from them. The base score needs
exact counts: those of the most frequent words (at most HEAD_WORDS) are broadcast, all others are joined by a shuffle.

Defined results: a null or empty text is one token, the end. Without training documents all counts are 0. Rows
are scored one by one, so repeated ids are no matter; a null id counts as an empty one in the division into
training and held-out rows. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import kernels as k
from hyperloom.llm.common import cut, discard, numbered, remainder, table, written_to

ORDERS = 3
BITS_PER_ENTRY, PROBES = 8, 4
#: Tokens whose n-grams are counted together before they are handed on.
FLUSH = 1_500_000
#: Bits of an n-gram's hash that are kept below its segment's.
GRAM_BITS = 40
SEGMENT_BYTES = 4_000_000
HEAD_WORDS = 1 << 20
MOST_BYTES = 512_000_000
BEGIN, END = k.mix(np.array([1, 2], k.U64))
NOTED = [f"levels{i}" for i in range(ORDERS)]


def grams_of(texts: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """(for each order a hash for each token of the n-gram that ends there, offsets). An end follows each text's
    words; before the first word stand beginnings."""
    words, at = k.words_of(texts)
    n = len(at) - 1
    offsets = at + np.arange(n + 1)
    tokens = np.full(len(words) + n, END, k.U64)
    tokens[np.arange(len(words)) + np.repeat(np.arange(n), np.diff(at))] = words
    out = [tokens]
    for order in range(1, ORDERS):
        before = np.empty_like(tokens)
        before[1:] = out[-1][:-1]
        before[offsets[:-1]] = BEGIN
        out.append(k.mix(before * k.COEFFICIENTS[2 * order] + tokens * k.COEFFICIENTS[2 * order + 1]))
    return out, offsets


def _small(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in pieces so small that their n-grams take little beside the filters."""
    return k.slices(batches, "text", 4)


def _release() -> None:
    """Hand memory that was freed back to the system: workers are kept, and would hold it beside the next task's."""
    pa.default_memory_pool().release_unused()
    pa.system_memory_pool().release_unused()  # what numpy and Python took, too


def _lean(function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The function of a task's batches, with its memory released at the task's end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        _release()

    return run


def level(counts: np.ndarray) -> np.ndarray:
    return 1 + np.floor(np.log2(counts)).astype(np.int64)


#: The count that a level stands for: 0, 1, then the middle of 2^(level-1) .. 2^level - 1.
LEVEL_COUNT = np.array([0.0] + [(3 * 2.0 ** (i - 1) - 1) / 2 for i in range(1, 64)])


def _pack(x: np.ndarray, size: int) -> bytes:
    """The lower bytes, all lowest ones first: of sorted numbers the highest repeat, and a shuffle's compression finds that."""
    return x.view(np.uint8).reshape(-1, 8)[:, :size].T.tobytes()


def _unpack(x: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(x) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(x, np.uint8).reshape(size, -1).T
    return out.reshape(-1).view(k.U64)


def _ids(hashes: np.ndarray, bits: int) -> np.ndarray:
    """What of a hash stands below its segment's bits and is known to the filter."""
    return (hashes >> k.U64(64 - bits - GRAM_BITS)) & k.U64((1 << GRAM_BITS) - 1)


def _probes(ids: np.ndarray, lvl: int) -> Iterator[np.ndarray]:
    """PROBES 32-bit numbers for an id and a level."""
    low, half = k.U64(0xFFFFFFFF), k.U64(32)
    a = k.mix(ids + k.U64(int(k.COEFFICIENTS[3]) * lvl % 2**64))
    yield a & low
    yield a >> half
    b = k.mix(a + k.COEFFICIENTS[2])
    yield b & low
    yield b >> half


def marks_of(ids: np.ndarray, levels: np.ndarray) -> tuple[int, bytes]:
    """(size in bits, bits) of the filter that holds each id at all levels up to its own; sizes are under 2**32."""
    size = max(64, int(levels.sum()) * BITS_PER_ENTRY // 64 * 64)
    marks = np.zeros(size, bool)
    for lvl in range(1, int(levels.max(initial=0)) + 1):
        for x in _probes(ids[levels >= lvl], lvl):
            marks[(x * k.U64(size) >> k.U64(32)).astype(np.int64)] = True
    return size, np.packbits(marks, bitorder="little").tobytes()


class Filter:
    """The segments of one order that are at hand, a range of them; rows are (segment, size in bits, bits)."""

    def __init__(self, rows: list, bits: int):
        rows = sorted(rows)
        self.bits, self.first = bits, rows[0][0] if rows else 0
        n = rows[-1][0] - self.first + 1 if rows else 0
        self.sizes, self.begins = np.zeros(n + 1, k.U64), np.zeros(n + 1, np.int64)
        at = 0
        for segment, size, data in rows:
            self.sizes[segment - self.first], self.begins[segment - self.first] = size, at
            at += len(data)
        self.data = np.frombuffer(b"".join(data for _, _, data in rows), np.uint8)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        """Of each n-gram, as bytes; 0 if it is unknown or its segment isn't at hand. Equal hashes are probed once."""
        own, back = np.unique(hashes, return_inverse=True)
        ids = _ids(own, self.bits)
        segment = (own >> k.U64(64 - self.bits)).astype(np.int64) - self.first
        segment[(segment < 0) | (segment >= len(self.sizes))] = len(self.sizes) - 1  # the last one is empty
        out, left, lvl = np.zeros(len(own), np.uint8), np.flatnonzero(self.sizes[segment]), 1
        ids, sizes, begins = ids[left], self.sizes[segment[left]], self.begins[segment[left]] * 8
        while len(left):
            yes = None
            for x in _probes(ids, lvl):
                p = (x * sizes >> k.U64(32)).astype(np.int64) + begins
                bit = (self.data[p >> 3] >> (p & 7).astype(np.uint8)) & 1
                yes = bit if yes is None else yes & bit
            keep = np.flatnonzero(yes)
            left, ids, sizes, begins = left[keep], ids[keep], sizes[keep], begins[keep]
            out[left] = lvl
            lvl += 1
        return out[back]


# --- counting --------------------------------------------------------------------------------------------------------


def _counted(docs: DataFrame, bits: int) -> DataFrame:
    """A row for each task, order and segment with the n-grams seen: (segment, kind, hashes, counts)."""
    size = lambda kind: GRAM_BITS // 8 if kind else 8

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, tokens = np.empty((ORDERS, FLUSH), k.U64), 0

        def flush() -> Iterator[pa.RecordBatch]:
            for kind in range(ORDERS if tokens else 0):
                every = held[kind, :tokens]
                every.sort()
                starts = np.arange(1 << bits, dtype=k.U64) << k.U64(64 - bits)
                begins = np.append(np.searchsorted(every, starts), tokens)
                some = np.flatnonzero(np.diff(begins))
                for part in np.array_split(some, min(len(some), 8)):  # what is made beside the buffer stays small
                    own = every[begins[part[0]] : begins[part[-1] + 1]]
                    first = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
                    own, counts = own[first], np.diff(np.append(first, len(own))).astype(np.uint32)
                    ends = np.append(np.searchsorted(own, starts[part]), len(own))
                    rows = [(int(s), kind, _pack(_ids(own[a:b], bits) if kind else own[a:b], size(kind)), counts[a:b].tobytes()) for s, a, b in zip(part, ends[:-1], ends[1:])]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["segment", "kind", "hashes", "counts"])

        for batch in _small(batches):
            grams, at = grams_of(batch.column("text"))[0], 0
            while at < len(grams[0]):
                n = min(FLUSH - tokens, len(grams[0]) - at)
                for kind in range(ORDERS):
                    held[kind, tokens : tokens + n] = grams[kind][at : at + n]
                tokens, at = tokens + n, at + n
                if tokens == FLUSH:
                    yield from flush()
                    tokens = 0
        yield from flush()

    return docs.select("text").mapInArrow(_lean(count), "segment int, kind int, hashes binary, counts binary")


def build(docs: DataFrame) -> DataFrame:
    """The model, a row for each segment and order (kind 0: words): the filter's bits, its n-grams' number, how many of
    them occur once and twice, and the words' exact counts."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / SEGMENT_BYTES))), 6, 64 - GRAM_BITS))

    def merge(rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for kind, own in rows.groupby("kind"):
            hashes = np.concatenate([_unpack(x, GRAM_BITS // 8 if kind else 8) for x in own["hashes"]])
            counts = np.concatenate([np.frombuffer(x, np.uint32) for x in own["counts"]])
            order = np.argsort(hashes, kind="stable")
            hashes = hashes[order]
            first = np.flatnonzero(np.concatenate([[True], hashes[1:] != hashes[:-1]]))
            hashes, counts = hashes[first], np.add.reduceat(counts[order].astype(np.int64), first)
            marks = marks_of(hashes if kind else _ids(hashes, bits), level(counts))
            exact = (b"", b"") if kind else (hashes.tobytes(), counts.tobytes())
            out.append((int(own["segment"].iloc[0]), int(kind), *marks, *exact, int(counts.sum()), len(hashes), int((counts == 1).sum()), int((counts == 2).sum())))
        _release()
        return pd.DataFrame(out, columns=["segment", "kind", "size", "bits", "hashes", "counts", "tokens", "grams", "once", "twice"])

    merged = _counted(docs, bits).groupBy("segment").applyInPandas(merge, "segment int, kind int, size long, bits binary, hashes binary, counts binary, tokens long, grams long, once long, twice long")
    return cut(merged.withColumn("segment_bits", F.lit(bits)))


# --- probabilities ---------------------------------------------------------------------------------------------------


class Weights(NamedTuple):
    """What turns levels into probabilities. discount and left are by order; left[order] is by the context's level."""

    tokens: int
    words: int
    texts: int
    discount: list[float]
    left: list[np.ndarray]


def context_levels(levels: list[np.ndarray], at: np.ndarray, order: int, texts: int) -> tuple[np.ndarray, np.ndarray]:
    """(level, count) of each token's context at an order from 1: the n-gram of the order below that ends one token
    before. Beginnings occur once in each training text."""
    own = np.empty_like(levels[order - 1])
    own[1:] = levels[order - 1][:-1]
    own[at[:-1]] = level(np.array([texts]))[0] if texts else 0
    count = LEVEL_COUNT[own]
    count[at[:-1]] = texts
    return own, count


def probabilities(levels: list[np.ndarray], at: np.ndarray, w: Weights) -> np.ndarray:
    """Of each token, from the levels of the n-grams that end with it."""
    p = (LEVEL_COUNT[levels[0]] + 1) / (w.tokens + w.words + 1)
    for order in range(1, ORDERS):
        context, count = context_levels(levels, at, order, w.texts)
        p = np.maximum(LEVEL_COUNT[levels[order]] - w.discount[order], 0) / np.maximum(count, 1) + w.left[order][context] * p
        p = np.minimum(p, 1.0)
    return p


def _fit(noted: DataFrame, at_most: Weights) -> Weights:
    """The weights, from the levels of all training rows: how often each level of an n-gram follows each of a context."""
    texts = at_most.texts

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((ORDERS, 64 * 64), np.int64)
        for batch in _pieces(batches):
            levels, at = _noted(batch)
            for order in range(1, ORDERS):
                context, _ = context_levels(levels, at, order, texts)
                n[order] += np.bincount(context.astype(np.int64) * 64 + levels[order], minlength=64 * 64)
        order, pair = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(order), pa.array(pair // 64), pa.array(pair % 64), pa.array(n[order, pair])], ["order", "context", "level", "n"])

    total, n = np.zeros((ORDERS, 64)), np.zeros((ORDERS, 64), np.int64)
    counted = noted.select(*NOTED).mapInArrow(_lean(pairs), "order long, context long, level long, n long").groupBy("order", "context", "level").agg(F.sum("n").alias("n"))
    for r in sorted(counted.collect()):
        n[r["order"], r["context"]] += r["n"]
        total[r["order"], r["context"]] += r["n"] / max(LEVEL_COUNT[r["level"]], 1)
    left = [d * np.where(n[order], total[order] / np.maximum(n[order], 1), 1.0) for order, d in enumerate(at_most.discount)]
    for own in left:
        own[0] = 1.0
    return at_most._replace(left=left)


# --- scoring ---------------------------------------------------------------------------------------------------------


def _head_from(words: DataFrame) -> int:
    """The smallest count such that at most HEAD_WORDS words have it or more (on a scale of quarter octaves)."""
    steps = words.groupBy(F.floor(F.log2("n") * 4).cast("int").alias("step")).agg(F.count("*").alias("words")).collect()
    taken, least = 0, 1 << 62
    for step, n in sorted(((r[0], r[1]) for r in steps), reverse=True):
        taken += n
        if taken > HEAD_WORDS:
            break
        least = int(np.ceil(2 ** (step / 4) - 1e-9))
    return least


def word_counts(model: DataFrame) -> DataFrame:
    """(word, n): the exact counts of all training words, by the words' hashes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for h, n in zip(batch.column("hashes"), batch.column("counts")):
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(h.as_buffer(), np.int64)), pa.array(np.frombuffer(n.as_buffer(), np.int64))], ["word", "n"])

    return model.where("kind = 0").select("hashes", "counts").mapInArrow(rows, "word long, n long")


def with_levels(rows: DataFrame, parts: Iterator[tuple[int, Filter]]) -> tuple[DataFrame, str | None]:
    """Adds the columns NOTED: each token's level at each order in a byte, from the parts (order, filter) one after
    another. Each pass writes the rows anew and then removes what it read. And their folder, for `discard`."""
    path = None
    for column in NOTED:
        rows = rows.withColumn(column, F.lit(None).cast("binary"))
    for kind, part in parts:
        known = rows.sparkSession.sparkContext.broadcast(part)

        def fill(batches: Iterator[pa.RecordBatch], known=known, kind=kind) -> Iterator[pa.RecordBatch]:
            for batch in _small(batches):
                grams, at = grams_of(batch.column("text"))
                found = known.value.levels(grams[kind])
                before = b"".join(x.as_buffer() for x in batch.column(NOTED[kind]) if x.is_valid)
                if before:
                    found = np.maximum(found, np.frombuffer(before, np.uint8))
                yield batch.set_column(batch.schema.get_field_index(NOTED[kind]), NOTED[kind], _bytes_of(found, at))

        old = path
        rows, path = written_to(rows.mapInArrow(_lean(fill), rows.schema), "zstd")
        discard(rows.sparkSession, old)
        known.destroy()
    return rows, path


def _bytes_of(found: np.ndarray, at: np.ndarray) -> pa.Array:
    """A row's share of the levels as a binary."""
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(found)])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Noted rows in pieces of about as many tokens as slices of texts have."""
    return k.slices(batches, NOTED[0], 8)


def _noted(batch: pa.RecordBatch) -> tuple[list[np.ndarray], np.ndarray]:
    """(levels, offsets) of rows that have been through all parts."""
    own = [k.buffers(batch.column(c)) for c in NOTED]
    return [levels for _, levels in own], own[0][0]


def score(docs: DataFrame, train: Column, most_bytes: int = MOST_BYTES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs."""
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast
    model = build(docs.where(train))
    words = word_counts(model)
    sums = {r["kind"]: r for r in model.groupBy("kind").agg(*(F.sum(c).alias(c) for c in ("tokens", "grams", "once", "twice")), F.sum(F.length("bits")).alias("bytes"), F.max("segment_bits").alias("segment_bits")).collect()}
    bits = sums[0].segment_bits if sums else 6
    total, distinct = (sums[0].tokens, sums[0].grams) if sums else (0, 0)
    texts = docs.where(train).count()
    discount = [sums[i].once / max(1, sums[i].once + 2 * sums[i].twice) if i in sums else 0.0 for i in range(ORDERS)]
    weights = Weights(total, distinct, texts, discount, [])

    def load(kind: int, first: int = 0, end: int = 1 << bits) -> Filter:
        t = model.where((F.col("kind") == kind) & (F.col("segment") >= first) & (F.col("segment") < end)).select("segment", "size", "bits").toArrow()
        return Filter([(a, b, c.as_buffer()) for a, b, c in zip(t["segment"].to_pylist(), t["size"].to_pylist(), t["bits"])], bits)

    rows = docs.select(F.col("doc_id").cast("long"), "text", F.coalesce(train, F.lit(False)).alias("train"))
    whole, passed, filters = sum(r.bytes for r in sums.values()) <= most_bytes, None, []
    if whole:
        filters = [broadcast(load(kind)) for kind in range(ORDERS)]  # the driver holds one at a time

        def levels_in(batch: pa.RecordBatch, grams: list[np.ndarray]) -> list[np.ndarray]:
            return [f.value.levels(h) for f, h in zip(filters, grams)]
    else:
        # Segments are ranges of hashes, so they are about equally large and equal ranges of them make the parts.
        def parts() -> Iterator[tuple[int, Filter]]:
            for kind in range(ORDERS):
                step = max(1, (1 << bits) // -(-sums[kind].bytes // most_bytes))
                for first in range(0, 1 << bits, step):
                    yield kind, load(kind, first, min(first + step, 1 << bits))

        rows, passed = with_levels(numbered(rows), parts())

        def levels_in(batch: pa.RecordBatch, grams: list[np.ndarray]) -> list[np.ndarray]:
            return _noted(batch)[0]

    least = _head_from(words)
    head = words.where(F.col("n") >= least).toArrow()
    order = np.argsort(head["word"].to_numpy().view(k.U64)) if head.num_rows else np.zeros(0, np.int64)
    known = broadcast((head["word"].to_numpy().view(k.U64)[order], head["n"].to_numpy()[order].astype(np.float64)))
    names = ["row", "doc_id", "train", "n_tokens", "n_known", "logs", *NOTED, "word", "times"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 33  # the rows are made and written once, so this number stays theirs
        head_words, head_counts = known.value
        for batch in _small(batches):
            grams, at = grams_of(batch.column("text"))
            n, tokens = batch.num_rows, grams[0]
            levels = [_bytes_of(found, at) for found in levels_in(batch, grams)]
            rows = row + np.arange(n)
            row += n
            place = np.searchsorted(head_words, tokens)
            hit = np.zeros(len(tokens), bool)
            inside = place < len(head_words)
            hit[inside] = head_words[place[inside]] == tokens[inside]
            counts = np.zeros(len(tokens))
            counts[hit] = head_counts[place[hit]]
            logs, found = np.add.reduceat(np.log10(counts + 1), at[:-1]), np.add.reduceat(hit.astype(np.int64), at[:-1])
            rest = np.stack([np.repeat(rows, np.diff(at))[~hit], tokens[~hit].view(np.int64)], 1)
            rest = rest[np.lexsort((rest[:, 1], rest[:, 0]))]
            first = np.flatnonzero(np.concatenate([[True], (rest[1:] != rest[:-1]).any(1)])) if len(rest) else np.zeros(0, np.int64)
            m = len(first)
            none = lambda count, kind: pa.nulls(count, kind)
            yield pa.RecordBatch.from_arrays([pa.array(rows), batch.column("doc_id"), batch.column("train"), pa.array(np.diff(at)), pa.array(found), pa.array(logs), *levels, none(n, pa.int64()), none(n, pa.int64())], names)
            if m:
                tail = [pa.array(rest[first, 1]), pa.array(np.diff(np.append(first, len(rest))).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(rest[first, 0]), none(m, pa.int64()), none(m, pa.bool_()), none(m, pa.int64()), none(m, pa.int64()), none(m, pa.float64()), *[none(m, pa.binary())] * ORDERS, *tail], names)

    made, _ = written_to(rows.mapInArrow(_lean(run), "row long, doc_id long, train boolean, n_tokens long, n_known long, logs double, levels0 binary, levels1 binary, levels2 binary, word long, times long"), "zstd")
    discard(spark, passed)
    for sent in (known, *filters):  # nothing reads them any more; executors would hold them until the driver forgets them
        sent.destroy()
    weights = _fit(made.where("train"), weights)

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _pieces(batches):
            levels, at = _noted(batch)
            scores = np.add.reduceat(np.log10(probabilities(levels, at, weights)), at[:-1])
            yield batch.drop_columns(NOTED).append_column("score", pa.array(scores))

    rare = words.where(F.col("n") < least)
    tail = made.where("word is not null").select("row", "word", "times").join(rare, "word")
    tail = tail.groupBy("row").agg(F.sum(F.log10(F.col("n") + 1) * F.col("times")).alias("tail_logs"), F.sum("times").alias("tail_known"))
    out = made.where("word is null").drop("word", "times").mapInArrow(_lean(scored), "row long, doc_id long, train boolean, n_tokens long, n_known long, logs double, score double").join(tail, "row", "left")
    base = F.col("logs") + F.coalesce("tail_logs", F.lit(0.0)) - F.col("n_tokens") * F.log10(F.lit(float(total + distinct + 1)))
    return out.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", (F.col("n_known") + F.coalesce("tail_known", F.lit(0))).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), base.alias("base_score"), "score")


def op6_log_bloom_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, remainder(F.col("doc_id"), 7) != 2)
