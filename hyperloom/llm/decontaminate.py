"""Benchmark decontamination: operator 5.

Test items are cut into seeds: at each of their words the pairs with one of the next three words that are rare, that
is, expected less than RARE times in the corpus if its words came independently; where no pair is rare, the shortest
rare run of up to LONGEST words, or the one of LONGEST. Pairs that leave words out survive dense edits. Rarity goes by
the words' counts, not by the seed's own, so a passage that has leaked a thousand times still has seeds. An item that
would get none, be it of one or two words, is one seed itself, so it counts wherever it stands word for word.

Training passages that share a seed with an item are aligned with it word by word (Smith-Waterman), which scores
edited, cut and paraphrased copies too. A document has an item
* from half of a perfect score on (THRESHOLD), or
* as half of a long item is much, from the score of PASSAGE words in a row on, or
* as edits cost score, from EDITED of a perfect score on, if the words that both have are not to be expected together:
  by their counts, less than CHANCE such passages in the whole corpus.
Case, of any script, and punctuation at the ends of words make no difference.

The items are taken in blocks of at most BLOCK_BYTES of text, which bounds what is broadcast; there is one pass
over the documents for each block, and one before it for the words' counts.

Defined results: null and empty texts, and items without words, match nothing; repeated rows are treated one by one;
documents and items without an id keep their null. Other columns pass through `decontaminated`.
"""

from __future__ import annotations

import string
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import kernels as k
from hyperloom.llm.common import table

PAIRS = ((0, 1), (0, 2), (0, 3))
LONGEST = 8
RARE = 1.0
BLOCK_BYTES = 4_000_000
MATCH, MISMATCH, GAP = 1.0, -0.5, -0.5
#: Alignment score, as a share of a perfect one, from which a document has an item.
THRESHOLD = 0.5
#: Alignment score in words from which a document has an item, however long that is; chance gives 5 or 6.
PASSAGE = 13.0
#: Share from which it has an item whose words it can't have by chance, and the number of chance passages allowed.
EDITED, CHANCE = 0.25, 1e-3
#: Cells of an alignment table for one word of the items that are worked on together.
CELLS = 1 << 15
IS_PUNCTUATION = np.array([chr(b) in string.punctuation for b in range(256)])


class Seeds(NamedTuple):
    """Sorted hashes of the seeds of one shape; seed i stands at begins[i]:begins[i + 1] of item and position. maybe
    tells by the last bits of a hash whether it can be a seed's."""

    hashes: np.ndarray
    begins: np.ndarray
    item: np.ndarray
    position: np.ndarray
    maybe: np.ndarray


class Items(NamedTuple):
    """A block of items: the hashes of all words, offsets, what each word tells (log of 1 / its share of the corpus),
    seeds by shape, and the number of words of the corpus."""

    words: np.ndarray
    at: np.ndarray
    tells: np.ndarray
    seeds: dict[tuple[int, ...], Seeds]
    total: int


class Hit(NamedTuple):
    row: int
    item: int
    score: float
    begin: int
    end: int


def plain_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of the words in lower case, of any script, without the ASCII punctuation at their ends, and offsets.
    A word of punctuation alone stays, so words keep their places."""
    at, data = k.buffers(pc.utf8_lower(texts))
    n = len(data)
    if n == 0:
        return np.zeros(0, k.U64), np.zeros(len(at), np.int64)
    begins, ends = k.word_bounds(at, data)
    body, place = ~IS_PUNCTUATION[data], np.arange(n)
    first = np.minimum.accumulate(np.where(body, place, n)[::-1])[::-1][begins]
    last = np.maximum.accumulate(np.where(body, place, -1))[ends - 1] + 1
    some = first < ends
    return k.word_hashes(data, np.where(some, first, begins), np.where(some, last, ends)), np.searchsorted(begins, at)


def align_many(items: list[np.ndarray], passages: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best local alignment of each item with its passage: (scores, begins, ends in the passages). One row of all
    tables at a time; items come to an end one after another, the longest last."""
    n, sizes = len(items), np.array([len(x) for x in items])
    order = np.argsort(-sizes, kind="stable")
    m = max(len(x) for x in passages)
    a, b, real = np.zeros((n, sizes.max()), k.U64), np.zeros((n, m), k.U64), np.zeros((n, m), bool)
    for i, j in enumerate(order):
        a[i, : sizes[j]] = items[j]
        b[i, : len(passages[j])], real[i, : len(passages[j])] = passages[j], True
    column = np.arange(m + 1)
    ramp = (column * -GAP).astype(np.float32)
    above, start_above = np.zeros((n, m + 1), np.float32), np.tile(column, (n, 1))
    best, begin, end = np.zeros(n, np.float32), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for i in range(a.shape[1]):
        c = int((sizes[order] > i).sum())
        step = above[:c, :-1] + np.where((b[:c] == a[:c, i : i + 1]) & real[:c], np.float32(MATCH), np.float32(MISMATCH))
        down = above[:c, 1:] + np.float32(GAP)
        here, start = np.zeros((c, m + 1), np.float32), np.tile(column, (c, 1))
        here[:, 1:] = np.maximum(0, np.maximum(step, down))
        start[:, 1:] = np.where(here[:, 1:] <= 0, column[1:], np.where(step >= down, start_above[:c, :-1], start_above[:c, 1:]))
        lifted = np.maximum.accumulate(here + ramp, axis=1)
        source = np.maximum.accumulate(np.where(here + ramp >= lifted, column, 0), axis=1)
        here, start = lifted - ramp, np.take_along_axis(start, source, 1)
        top = here.argmax(1)
        value = here[np.arange(c), top]
        better = np.flatnonzero(value > best[:c])
        best[better], begin[better], end[better] = value[better], start[better, top[better]], top[better]
        above[:c], start_above[:c] = here, start
    back = np.argsort(order)
    return best[back].astype(np.float64), begin[back], end[back]


def align(item: np.ndarray, passage: np.ndarray) -> tuple[float, int, int]:
    """Best local alignment of two word sequences: (score / len(item), begin, end in the passage)."""
    score, begin, end = align_many([item], [passage])
    return float(score[0]) / max(1, len(item)), int(begin[0]), int(end[0])


def _vocabulary_counts(docs: DataFrame, vocabulary: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each word (sorted hashes) comes in all documents, and the number of all words."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, total = known.value, np.zeros(len(known.value) + 1, np.int64)
        maybe = np.zeros(1 << max(10, int(16 * len(own)).bit_length()), bool)
        last_bits = k.U64(len(maybe) - 1)
        maybe[(own & last_bits).astype(np.int64)] = True
        for batch in k.slices(batches):
            words, _ = plain_words(batch.column("text"))
            total[-1] += len(words)
            words = words[maybe[(words & last_bits).astype(np.int64)]]
            place = np.searchsorted(own, words)
            place[place == len(own)] = 0
            hit = own[place] == words if len(own) else np.zeros(len(words), bool)
            total[:-1] += np.bincount(place[hit], minlength=len(own))
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(total[seen])], ["word", "n"])

    out = np.zeros(len(vocabulary) + 1, np.int64)
    for word, n in docs.select("text").mapInArrow(count, "word long, n long").groupBy("word").agg(F.sum("n")).collect():
        out[word] = n
    return out[:-1], int(out[-1])


def _shape_hashes(words: np.ndarray, places: np.ndarray | slice, shape: tuple[int, ...]) -> np.ndarray:
    """Of the words at places + each of the shape's steps; a slice stands for all places from 0."""
    if isinstance(places, slice):
        return k.mix(sum(words[step : places.stop + step] * k.COEFFICIENTS[j] for j, step in enumerate(shape)))
    return k.mix(sum(words[places + step] * k.COEFFICIENTS[j] for j, step in enumerate(shape)))


def _seeds(words: np.ndarray, at: np.ndarray, tells: np.ndarray, total: int) -> dict[tuple[int, ...], Seeds]:
    expected = lambda told: np.log(max(total, 1)) - told < np.log(RARE)
    sums = np.concatenate([[0], np.cumsum(tells)])
    last, item, place = np.repeat(at[1:], np.diff(at)), np.repeat(np.arange(len(at) - 1), np.diff(at)), np.arange(len(words))
    open_, seeded = np.ones(len(words), bool), np.zeros(len(at) - 1, bool)
    chosen: dict[tuple[int, ...], list[np.ndarray]] = {}
    for shape in PAIRS:
        here = np.flatnonzero(place + shape[-1] < last)
        chosen[shape] = [here[expected(tells[here] + tells[here + shape[-1]])]]
        open_[chosen[shape][0]] = False
    for n in range(3, LONGEST + 1):
        here = np.flatnonzero(open_ & (place + n <= last))
        here = here[expected(sums[here + n] - sums[here])] if n < LONGEST else here
        chosen[tuple(range(n))] = [here]
        open_[here] = False
    for places in chosen.values():
        seeded[item[places[0]]] = True
    for n in range(1, LONGEST + 1):
        bare = at[:-1][~seeded & (np.diff(at) == n)]
        chosen.setdefault(tuple(range(n)), []).append(bare)
    out = {}
    for shape, places in chosen.items():
        here = np.concatenate(places)
        if not len(here):
            continue
        hashes = _shape_hashes(words, here, shape)
        order = np.argsort(hashes, kind="stable")
        distinct, begins = np.unique(hashes[order], return_index=True)
        maybe = np.zeros(1 << max(10, int(16 * len(distinct)).bit_length()), bool)
        maybe[(distinct & k.U64(len(maybe) - 1)).astype(np.int64)] = True
        out[shape] = Seeds(distinct, np.append(begins, len(here)), item[here][order], (here - at[:-1][item[here]])[order], maybe)
    return out


def _candidates(words: np.ndarray, at: np.ndarray, seeds: dict[tuple[int, ...], Seeds]) -> np.ndarray:
    """Distinct (row, item, where the item would begin in the row), sorted."""
    found = []
    for shape, s in seeds.items():
        stop = len(words) - shape[-1]
        if stop <= 0:
            continue
        hashes = _shape_hashes(words, slice(0, stop), shape)
        hit = np.flatnonzero(s.maybe[(hashes & k.U64(len(s.maybe) - 1)).astype(np.int64)])
        seed = np.searchsorted(s.hashes, hashes[hit])
        seed[seed == len(s.hashes)] = 0
        row = np.searchsorted(at, hit, side="right") - 1
        same = (s.hashes[seed] == hashes[hit]) & (hit + shape[-1] < at[row + 1])
        hit, seed, row = hit[same], seed[same], row[same]
        if len(hit):
            times = s.begins[seed + 1] - s.begins[seed]
            which = np.repeat(s.begins[seed], times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            found.append(np.stack([np.repeat(row, times), s.item[which], np.repeat(hit - at[row], times) - s.position[which]], 1))
    return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 3), np.int64)


def _hits(texts: pa.Array, items: Items, threshold: float) -> Iterator[Hit]:
    words, at = plain_words(texts)
    every = _candidates(words, at, items.seeds)
    if not len(every):
        return
    length = np.diff(items.at)[every[:, 1]]
    new = np.ones(len(every), bool)
    new[1:] = (every[1:, :2] != every[:-1, :2]).any(1) | (every[1:, 2] - every[:-1, 2] > length[1:])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(every)) - 1
    row, item, size = every[first, 0], every[first, 1], length[first]
    pad = np.maximum(4, size // 4)
    low = np.maximum(0, every[first, 2] - pad)
    high = np.minimum(np.diff(at)[row], every[last, 2] + size + pad)
    best: dict[tuple[int, int], Hit] = {}
    order, begin = np.argsort(high - low, kind="stable"), 0
    while begin < len(order):
        # Windows grow along the order: as many as fit with the largest of them, one at least.
        widest = (high - low)[order[begin:]] * np.arange(1, len(order) - begin + 1)
        end = begin + max(1, int(np.searchsorted(widest, CELLS, side="right")))
        some = order[begin:end]
        scores, starts, ends = align_many([items.words[items.at[i] : items.at[i + 1]] for i in item[some]], [words[at[r] + a : at[r] + b] for r, a, b in zip(row[some], low[some], high[some])])
        for c, score, a, b in zip(some, scores, starts, ends):
            r, i, n = int(row[c]), int(item[c]), int(size[c])
            share, a, b = float(score) / n, int(low[c] + a), int(low[c] + b)
            if share < threshold and score < PASSAGE:
                own = slice(items.at[i], items.at[i + 1])
                distinct, where = np.unique(items.words[own], return_index=True)
                told = items.tells[own][where][np.isin(distinct, words[at[r] + a : at[r] + b])].sum()
                if share < EDITED or np.log(max(items.total, 1) * n) - told > np.log(CHANCE):
                    continue
            if (r, i) not in best or share > best[r, i].score:
                best[r, i] = Hit(r, i, share, a, b)
        begin = end
    yield from best.values()


def _matchers(docs: DataFrame, benchmark: DataFrame, threshold: float) -> Iterator[tuple[list, Callable[[pa.Array], Iterator[Hit]]]]:
    """For each block of items: their ids, and a function from texts to hits that can be sent to the workers."""
    ids, texts, size = [], [], 0

    def made() -> tuple[list, Callable[[pa.Array], Iterator[Hit]]]:
        words, at = plain_words(pa.array(texts, pa.large_string()))
        vocabulary = np.unique(words)
        counts, total = _vocabulary_counts(docs, vocabulary)
        tells = -np.log(np.maximum(counts, 1)[np.searchsorted(vocabulary, words)] / max(total, 1))
        sent = docs.sparkSession.sparkContext.broadcast(Items(words, at, tells, _seeds(words, at, tells, total), total))
        return ids, lambda column: _hits(column, sent.value, threshold)

    for item, text in benchmark.select(F.col("item_id").cast("long"), F.coalesce("text", F.lit(""))).orderBy("item_id", "text").toLocalIterator():
        if ids and size + len(text) > BLOCK_BYTES:
            yield made()
            ids, texts, size = [], [], 0
        ids.append(item)
        texts.append(text)
        size += len(text)
    if ids:
        yield made()


def leaks(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, item_id, score, begin_word, end_word: every document's best alignment with each item that it has."""
    out = None
    for ids, hits in _matchers(docs, benchmark, threshold):

        def find(batches: Iterator[pa.RecordBatch], ids: list = ids, hits: Callable = hits) -> Iterator[pa.RecordBatch]:
            for batch in k.slices(batches):
                if rows := list(hits(batch.column("text"))):
                    own = [(batch.column("doc_id")[h.row].as_py(), ids[h.item], h.score, h.begin, h.end) for h in rows]
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*own), (pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int64()))], ["doc_id", "item_id", "score", "begin_word", "end_word"])

        part = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, item_id long, score double, begin_word long, end_word long")
        out = part if out is None else out.unionByName(part)
    return out if out is not None else docs.sparkSession.createDataFrame([], "doc_id long, item_id long, score double, begin_word long, end_word long")


def decontaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs, all columns, that have none of the items. No shuffle: each task drops its own rows."""
    for _, hits in _matchers(docs, benchmark, threshold):

        def clean(batches: Iterator[pa.RecordBatch], hits: Callable = hits) -> Iterator[pa.RecordBatch]:
            for batch in k.slices(batches):
                keep = np.ones(batch.num_rows, bool)
                keep[[h.row for h in hits(batch.column("text"))]] = False
                yield batch.filter(pa.array(keep))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
