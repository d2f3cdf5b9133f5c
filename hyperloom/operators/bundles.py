"""Experiments as bundles of bits, in generated code: no Python worker, no array that grows with a row's parts.

A vector is `dim` bits in words of 64. The distinct parts of experiments (bindings of a role and a filler, relations) make
a codebook of vectors, computed once each. An experiment's parts lie side by side as columns, one for each place; for
every word, carry-save adders sum them bit by bit: three planes of one weight become one of it and one of twice it, until
each power of two has a single plane. Comparing these counters with half of the weights gives the sign of all positions
at once. Words of an experiment are rows for that, which exist inside the generated loop alone.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.functions import vectors
from hyperloom.sources.scratch import written

WORD = 64
#: Bytes of a codebook that are broadcast at most; beyond it, parts are joined by shuffles.
BROADCAST_BYTES = 256 << 20
#: Places of parts that rows may have; rows with more go by `many`, which sums words over rows.
MOST_PLACES = 24


def words_of(dim: int) -> int:
    return -(-dim // WORD)


# --- words of vectors as functions of a key --------------------------------------------------------------------------


def hashed_word(key: Column, w: Column) -> Column:
    """64 positions by one hash."""
    return F.xxhash64(key, w.cast("int"))


def digest_word(key: Column, w: Column) -> Column:
    """The positions of `vectors.word_vector`, by a digest each: slow, but SQL can follow."""
    bit = lambda b: (F.ascii(F.md5(F.concat(key, F.lit("|"), (w * WORD + b).cast("string")).cast("binary"))) % 2).cast("long")
    return F.aggregate(F.sequence(F.lit(0), F.lit(WORD - 1)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(b), b)))


def _and(a: Column, b: Column) -> Column:
    return a.bitwiseAND(b)


def _or(a: Column, b: Column) -> Column:
    return a.bitwiseOR(b)


def _xor(a: Column, b: Column) -> Column:
    return a.bitwiseXOR(b)


def _shift(kind: str, x: Column, n: Column | int) -> Column:
    return F.call_function(kind, x, F.lit(n) if isinstance(n, int) else n)


def bound_word(a: Column, b: Column) -> Column:
    return F.bitwise_not(_xor(a, b))


def permuted_word(make, w: Column, dim: int) -> Column:
    """What stood at i stands at i + 1, the last position at 0; make(w) is the vector's word."""
    last = (dim - 1) // WORD
    carry = F.when(w == 0, _and(_shift("shiftrightunsigned", make(F.lit(last)), (dim - 1) % WORD), F.lit(1).cast("long"))).otherwise(_shift("shiftrightunsigned", make(F.greatest(w - 1, F.lit(0))), WORD - 1))
    return _or(_shift("shiftleft", make(w), 1), carry)


def blended_word(low: Column, high: Column, n: Column, w: Column) -> Column:
    """The first n positions from high, the rest from low."""
    mask = _shift("shiftleft", F.lit(1).cast("long"), F.greatest(F.lit(0), F.least(F.lit(WORD - 1), n - w * WORD)).cast("int")) - 1
    return F.when(n >= (w + 1) * WORD, high).when(n <= w * WORD, low).otherwise(_or(_and(high, mask), _and(low, F.bitwise_not(mask))))


def part_word(part: Column, w: Column, dim: int, word, held: tuple[Column, Column] | None = None) -> Column:
    """Word w of a part as `search._fillers` writes it: B, role and filler, or R, type and the fillers of both ends. held: words
    of the first and the second filler, null where they are functions of their keys."""
    field = lambda i: F.get(F.split(part, "\u0001"), F.lit(i))

    def filler(i: int, w: Column) -> Column:
        made = own(field(i), w)
        return F.coalesce(F.get(held[i - 2], w), made) if held else made

    def own(code: Column, w: Column) -> Column:
        at = lambda i: F.get(F.split(code, "\u0002"), F.lit(i))
        base = lambda end: word(F.concat(F.lit("NumericBase:"), at(1), F.lit(f":{end}")), w)
        n = F.floor(F.greatest(F.lit(0.0), F.least(F.lit(1.0), at(2).cast("double"))) * dim).cast("int")
        return F.when(at(0) == "E", word(at(1), w)).otherwise(blended_word(base("min"), base("max"), n, w))

    binding = bound_word(word(F.concat(F.lit("Role:"), field(1)), w), filler(2, w))
    source = permuted_word(lambda v: filler(2, v), w, dim)
    relation = bound_word(bound_word(source, word(F.concat(F.lit("RelationType:"), field(1)), w)), filler(3, w))
    return F.when(field(0) == "B", binding).otherwise(relation)


# --- adders ------------------------------------------------------------------------------------------------------------


def added(rows: DataFrame, planes: dict[int, list[str]], keep: list[str]) -> tuple[DataFrame, dict[int, str]]:
    """rows with one column for each power of two of the sum of bit columns: planes[p] weigh 2 ** p each."""
    planes, made = {p: list(c) for p, c in planes.items() if c}, 0
    while any(len(c) > 1 for c in planes.values()):
        new, left = {}, {p: [] for p in planes}
        outs: dict[str, Column] = {}
        for p, own in sorted(planes.items()):
            while len(own) > 1:
                a, b, *rest = (F.col(x) for x in own[:3])
                own = own[3:]
                names, made = (f"_s{made}", f"_c{made}"), made + 1
                both = _xor(a, b)
                outs[names[0]] = reduce(_xor, rest, both)
                outs[names[1]] = _or(_and(a, b), _and(rest[0], both)) if rest else _and(a, b)
                new.setdefault(p, []).append(names[0])
                new.setdefault(p + 1, []).append(names[1])
            left[p] += own
        kept = [c for cs in left.values() for c in cs]
        rows = rows.select(*keep, *kept, *(c.alias(n) for n, c in outs.items()))
        planes = {p: left.get(p, []) + new.get(p, []) for p in {*left, *new} if left.get(p) or new.get(p)}
    return rows, {p: c[0] for p, c in planes.items()}


def sign_word(counters: dict[int, str], total: Column, tie: Column) -> Column:
    """The bits of positions that more than half of the weights set, with the tie's where it is exactly half."""
    half = F.floor(total / 2).cast("long")
    above, equal = F.lit(0).cast("long"), F.lit(-1).cast("long")
    for p in sorted(counters, reverse=True):
        bits = F.col(counters[p])
        asked = F.negative(_and(_shift("shiftright", half, p), F.lit(1).cast("long")))  # all ones where half has this bit
        above, equal = _or(above, _and(equal, _and(bits, F.bitwise_not(asked)))), _and(equal, F.bitwise_not(_xor(bits, asked)))
    return F.when(total % 2 == 0, _or(above, _and(equal, tie))).otherwise(above)


# --- encoding ----------------------------------------------------------------------------------------------------------


def tie_words(spark: SparkSession, owner: str, dim: int, word) -> list[int]:
    """What breaks the ties of an owner's bundles: one vector, the same for all of them, so that it sets none apart."""
    if word is digest_word:
        bits = vectors.tie(owner, dim, vectors.digest_vector) > 0
        return [int.from_bytes(sum(1 << b for b, x in enumerate(bits[w * WORD : (w + 1) * WORD]) if x).to_bytes(8, "little"), "little", signed=True) for w in range(words_of(dim))]
    key = F.lit(f"tie|{owner}")
    return spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(words_of(dim) - 1)), lambda w: word(key, w)).alias("v")).first().v


def longs(values: list[int]) -> Column:
    return F.array(*(F.lit(v).cast("long") for v in values))


def codebook(parts: DataFrame, dim: int, word, semantic: Semantic | None = None) -> DataFrame:
    """part, hv (array of words) of the distinct parts of rows (parts)."""
    every, seq = parts.select(F.explode("parts").alias("part")).distinct(), F.sequence(F.lit(0), F.lit(words_of(dim) - 1))
    if semantic is None:
        return every.select("part", F.transform(seq, lambda w: part_word(F.col("part"), w, dim, word)).alias("hv"))
    key = lambda i: F.nullif(F.regexp_extract(F.get(F.split("part", "\u0001"), F.lit(i)), "^E\u0002([\\s\\S]*)$", 1), F.lit(""))
    keyed = written(every.select("part", key(2).alias("k2"), key(3).alias("k3")))
    known = semantic.vectors(keyed.select(F.explode(F.array("k2", "k3")).alias("key")).where("key is not null").distinct())
    for k in ("k2", "k3"):
        keyed = keyed.join(known.select(F.col("key").alias(k), F.col("hv").alias(f"h{k}")), k, "left")
    return keyed.select("part", F.transform(seq, lambda w: part_word(F.col("part"), w, dim, word, (F.col("hk2"), F.col("hk3")))).alias("hv"))


def trigrams(values: list[str]) -> np.ndarray:
    return np.stack([vectors.trigram_embedding(v) for v in values])


class Semantic:
    """Vectors of entity keys by what their values mean: embeddings of whole batches of values, projected at once by one matrix
    product, positions by its sign. With a store, the codebook is a table in it: keys that it has are read, and only new ones
    are made and merged in, so a key keeps its vector.

    embed: values to an array of one row each; matrix: makes the projection (positions by embedding's size), in a task."""

    def __init__(self, dim: int, store=None, embed: Callable[[list[str]], np.ndarray] = trigrams, matrix: Callable[[], np.ndarray] | None = None, name: str = "codebook"):
        self.dim, self.store, self.embed, self.name = dim, store, embed, name
        self.matrix = matrix or (lambda: vectors.projection(dim=dim))

    def made(self, keys: DataFrame) -> DataFrame:
        """key, hv of distinct keys."""
        dim, embed, matrix = self.dim, self.embed, self.matrix

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            project = None
            for batch in batches:
                if not len(batch):
                    continue
                project = matrix() if project is None else project
                dense = embed([k.partition(":")[2] for k in batch["key"]])
                bits = np.zeros((len(batch), words_of(dim) * WORD), np.uint8)
                bits[:, :dim] = dense @ project.T >= 0
                words = np.packbits(bits, 1, bitorder="little").view("<i8")
                yield pd.DataFrame({"key": batch["key"], "hv": list(words)})

        return keys.select("key").mapInPandas(run, "key string, hv array<long>")

    def vectors(self, keys: DataFrame) -> DataFrame:
        if self.store is None:
            return written(self.made(keys))
        known = self.store.load(self.name)
        new = keys if known is None else keys.join(known.select("key"), "key", "left_anti")
        self.store.upsert(self.name, self.made(new), "key")
        return self.store.load(self.name).join(keys, "key", "left_semi")


def bundled_words(parts: DataFrame, dim: int, owner: str = "experiments", word=hashed_word, semantic: Semantic | None = None) -> DataFrame:
    """id, w, word of rows (id, parts, weights): each row's weighted bundle, word by word. Weights are whole and small."""
    spark, w, parts = parts.sparkSession, F.col("w"), written(parts)
    sizes = parts.agg(F.max(F.size("parts")), F.max(F.aggregate("weights", F.lit(0), lambda acc, x: acc + x))).first()
    places, most = sizes[0] or 0, sizes[1] or 0
    book = written(codebook(parts, dim, word, semantic))
    rows = parts.select("id", "parts", "weights", F.coalesce(F.aggregate("weights", F.lit(0), lambda acc, x: acc + x), F.lit(0)).alias("total"))
    tie = F.get(longs(tie_words(spark, owner, dim, word)), w)
    own = word(F.concat(F.lit("empty|"), "id"), w)
    every = F.explode(F.sequence(F.lit(0), F.lit(words_of(dim) - 1))).alias("w")
    if places > MOST_PLACES:
        return many(rows, book, dim, tie, own)
    small = book.count() * (8 * words_of(dim) + 100) <= BROADCAST_BYTES if places else True
    for k in range(places):
        vector = book.select(F.col("part").alias(f"part{k}"), F.col("hv").alias(f"hv{k}"))
        rows = rows.withColumn(f"part{k}", F.get("parts", F.lit(k))).join(F.broadcast(vector) if small else vector, f"part{k}", "left").drop(f"part{k}")
    bits = range(max(1, most).bit_length())
    weighs = lambda k, p: _and(F.coalesce(F.get("weights", F.lit(k)), F.lit(0)).cast("long"), F.lit(1 << p).cast("long")) != 0
    # Which places may have which bit of a weight: most have one weight in all rows, and need one plane.
    used = rows.agg(*(F.max(weighs(k, p).cast("int")).alias(f"u{k}_{p}") for k in range(places) for p in bits)).first() if places else None
    rows = rows.select("id", "total", "weights", *(f"hv{k}" for k in range(places)), every)
    planes: dict[int, list[str]] = {}
    outs = []
    for k in range(places):
        for p in (p for p in bits if used[f"u{k}_{p}"]):
            planes.setdefault(p, []).append(f"_x{k}_{p}")
            outs.append(F.coalesce(F.when(weighs(k, p), F.get(f"hv{k}", w)), F.lit(0).cast("long")).alias(f"_x{k}_{p}"))
    rows, counters = added(rows.select("id", "total", "w", *outs), planes, ["id", "total", "w"])
    return rows.select("id", "w", F.when(F.col("total") == 0, own).otherwise(sign_word(counters, F.col("total"), tie)).alias("word"))


def many(rows: DataFrame, book: DataFrame, dim: int, tie: Column, own: Column) -> DataFrame:
    """The same for rows of any number of parts: parts are rows, and the weights that set each of a word's 64 positions are
    summed, in their own task first."""
    part = rows.select("id", "total", F.explode(F.arrays_zip("parts", "weights")).alias("p")).select("id", "total", F.col("p.parts").alias("part"), F.col("p.weights").cast("long").alias("weight"))
    lanes = part.join(book, "part").select("id", "total", "weight", F.posexplode("hv").alias("w", "x"))
    at = lambda x, b: _and(_shift("shiftrightunsigned", x, b), F.lit(1).cast("long"))
    sums = lanes.groupBy("id", "w").agg(F.first("total").alias("total"), *(F.sum(at(F.col("x"), b) * F.col("weight")).alias(f"n{b}") for b in range(WORD)))
    bit = lambda b: F.when(2 * F.col(f"n{b}") == F.col("total"), at(tie, b)).otherwise((2 * F.col(f"n{b}") > F.col("total")).cast("long"))
    words = sums.select("id", "w", reduce(_or, (_shift("shiftleft", bit(b), b) for b in range(WORD))).alias("word"))
    none = rows.where(F.size("parts") == 0).withColumn("w", F.explode(F.sequence(F.lit(0), F.lit(words_of(dim) - 1))))
    return words.unionByName(none.select("id", "w", own.alias("word")))


def _masks(dim: int) -> Column:
    """All ones, but for the positions of the last word that lie beyond dim."""
    rest = dim % WORD
    return F.when(F.col("w") == words_of(dim) - 1, F.lit((1 << rest) - 1 if rest else -1).cast("long")).otherwise(F.lit(-1).cast("long"))


def as_arrays(words: DataFrame, dim: int) -> DataFrame:
    """id, hv (array of words) of bundles; ids are unique."""
    if words_of(dim) == 1:  # a bundle is a row
        return words.select("id", F.array(_and(F.col("word"), _masks(dim))).alias("hv"))
    kept = words.select("id", F.struct("w", _and(F.col("word"), _masks(dim)).alias("word")).alias("p"))
    return kept.groupBy("id").agg(F.transform(F.sort_array(F.collect_list("p")), lambda p: p["word"]).alias("hv"))


def similarities(words: DataFrame, query: list[int], dim: int) -> DataFrame:
    """id, similarity (-1 to 1) of bundles to one vector; ids are unique."""
    apart = F.bit_count(_and(_xor(F.col("word"), F.get(longs(query), F.col("w"))), _masks(dim)))
    if words_of(dim) == 1:  # a bundle is a row, so nothing is shuffled
        return words.select("id", (1.0 - 2.0 * apart.cast("long") / dim).alias("similarity"))
    return words.groupBy("id").agg(F.sum(apart.cast("long")).alias("apart")).select("id", (1.0 - 2.0 * F.col("apart") / dim).alias("similarity"))
