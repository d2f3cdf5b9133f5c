"""Bipolar hypervectors.

Two forms share one algebra. *Words*: array<long> of 64 positions each, +1 is a set bit, made and compared by
built-in functions only. *Packed*: BINARY made by numpy in Arrow batches, for weighted bundles of any number of
vectors, permutation, blends and projections at full dimension. Every vector is a function of its key alone, so no
codebook has to be stored, joined or kept in order: a lookup never changes anything.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FULL = 10_000
_TIES: dict[tuple[str, int], np.ndarray] = {}

# --- words: in the JVM -------------------------------------------------------------------------------------------


def word_vector(key: Column, dim: int = 256) -> Column:
    """Position i is +1 where the MD5 of `key|i` begins with a digit of odd code."""
    bit = lambda i: (F.ascii(F.md5(F.concat(key, F.lit("|"), i.cast("string")).cast("binary"))) % 2).cast("long")
    word = lambda w: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda acc, b: acc.bitwiseOR(F.call_function("shiftleft", bit(w * 64 + b), b)))
    return F.transform(F.sequence(F.lit(0), F.lit(dim // 64 - 1)), word)


def bind_words(a: Column, b: Column) -> Column:
    """Element-wise product: the same bits give +1."""
    return F.zip_with(a, b, lambda x, y: F.bitwise_not(x.bitwiseXOR(y)))


def majority_words(a: Column, b: Column, c: Column) -> Column:
    """Sign of the sum of three vectors whose weights are each below the sum of the others."""
    return F.zip_with(F.zip_with(a, b, lambda x, y: F.struct(x.alias("x"), y.alias("y"))), c, lambda p, z: p["x"].bitwiseAND(p["y"]).bitwiseOR(p["x"].bitwiseXOR(p["y"]).bitwiseAND(z)))


def similarity_words(a: Column, b: Column, dim: int = 256) -> Column:
    """Dot product over dim, -1 to 1."""
    apart = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda acc, n: acc + n)
    return 1.0 - 2.0 * apart / dim


def permute_words(v: Column) -> Column:
    """Cyclic shift by one position: what stood at i stands at i + 1."""
    before = lambda i: F.element_at(v, F.when(i == 0, F.lit(-1)).otherwise(i))
    return F.transform(v, lambda x, i: F.call_function("shiftleft", x, F.lit(1)).bitwiseOR(F.call_function("shiftrightunsigned", before(i), F.lit(63))))


# --- packed: numpy -----------------------------------------------------------------------------------------------


def _rng(key: str) -> np.random.Generator:
    return np.random.default_rng(int.from_bytes(hashlib.md5(key.encode()).digest()[:8], "little"))


def generate(key: str, dim: int = FULL) -> np.ndarray:
    return _rng(key).integers(0, 2, dim, dtype=np.int8) * 2 - 1


def digest_vector(key: str, dim: int = FULL) -> np.ndarray:
    """`word_vector` in numpy: the same positions."""
    return np.array([1 if ord(hashlib.md5(f"{key}|{i}".encode()).hexdigest()[0]) % 2 else -1 for i in range(dim)], np.int8)


def bind(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return a * b


def permute(v: np.ndarray, n: int = 1) -> np.ndarray:
    return np.roll(v, n)


def tie(owner: str, dim: int = FULL, make: Callable[[str, int], np.ndarray] = generate) -> np.ndarray:
    """What breaks an owner's ties: one fixed vector, rolled by a checksum of the owner's name."""
    if (make.__name__, dim) not in _TIES:
        _TIES[make.__name__, dim] = make("tie", dim)
    return np.roll(_TIES[make.__name__, dim], zlib.crc32(owner.encode()) % dim)


def bundle(vectors: list[np.ndarray], weights: list[float] | None = None, owner: str = "", make: Callable[[str, int], np.ndarray] = generate) -> np.ndarray:
    """Sign of the weighted sum; ties go by the owner's name."""
    if not vectors:
        raise ValueError("nothing to bundle")
    if weights is not None and len(weights) != len(vectors):
        raise ValueError("as many weights as vectors are needed")
    if len(vectors) == 1:
        return vectors[0].copy()
    total = np.tensordot(np.asarray(weights if weights is not None else np.ones(len(vectors))), np.stack(vectors).astype(np.int32), 1)
    return np.where(total == 0, tie(owner, len(total), make), np.sign(total)).astype(np.int8)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    return float(np.dot(a.astype(np.int32), b.astype(np.int32))) / len(a)


def blend(low: np.ndarray, high: np.ndarray, position: float) -> np.ndarray:
    """The first part from `high`, the rest from `low`: positions near each other give similar vectors."""
    n = int(np.clip(position, 0, 1) * len(low))
    return np.concatenate([high[:n], low[n:]])


def pack(v: np.ndarray) -> bytes:
    return np.packbits(v > 0).tobytes()


def unpack(data: bytes, dim: int = FULL) -> np.ndarray:
    return np.unpackbits(np.frombuffer(data, np.uint8), count=dim).astype(np.int8) * 2 - 1


def trigram_embedding(text: str, dim: int = 384) -> np.ndarray:
    """Sum of a Gaussian vector for each character trigram of `_text_`, of length 1; zeros for a blank text."""
    clean = " ".join(text.lower().split())
    if not clean:
        return np.zeros(dim, np.float32)
    padded = f"_{clean}_"
    total = np.zeros(dim)
    for i in range(len(padded) - 2):
        seed = int(hashlib.md5(padded[i : i + 3].encode()).hexdigest(), 16) & 0xFFFFFFFF
        total += np.random.default_rng(seed).standard_normal(dim)
    norm = np.linalg.norm(total)
    return (total / norm if norm else total).astype(np.float32)


def projection(dense: int = 384, dim: int = FULL) -> np.ndarray:
    return np.random.default_rng(12345 + dense).standard_normal((dim, dense)).astype(np.float32)


def project(dense: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    return np.where(matrix @ dense >= 0, 1, -1).astype(np.int8)


class Codebook:
    """Vectors by key, made once in a task and kept up to a bounded number."""

    def __init__(self, dim: int = FULL, semantic: bool = True, most: int = 4096, make: Callable[[str, int], np.ndarray] = generate):
        self.dim, self.semantic, self.most, self.make, self.kept, self.matrix = dim, semantic, most, make, {}, None

    def __call__(self, key: str) -> np.ndarray:
        if key not in self.kept:
            if len(self.kept) >= self.most:
                self.kept.clear()
            kind, _, value = key.partition(":")
            if self.semantic and value and kind not in ("Role", "RelationType", "NumericBase"):
                self.matrix = projection(dim=self.dim) if self.matrix is None else self.matrix
                self.kept[key] = project(trigram_embedding(value), self.matrix)
            else:
                self.kept[key] = self.make(key, self.dim)
        return self.kept[key]


def similarity_to(query: np.ndarray):
    """A pandas UDF: BINARY vectors to their similarity with one query vector."""
    own, dim = np.frombuffer(pack(query), np.uint8), len(query)

    @F.pandas_udf("double")
    def run(packed: pd.Series) -> pd.Series:
        rows = np.frombuffer(b"".join(packed), np.uint8).reshape(len(packed), -1)
        return pd.Series(1 - 2 * np.bitwise_count(rows ^ own).sum(1, dtype=np.int64) / dim)

    return run


#: Keys whose sums a task holds before it hands them on.
HELD_KEYS = 256


def bundled(rows: DataFrame, dim: int = FULL, weight: str | None = None) -> DataFrame:
    """key, hv, vectors: for each key the bundle of its packed vectors (key, hv, and a whole weight), ties by the key's name.

    Tasks add up what they have of a key before the shuffle, so a key of any size is a few sums for the last step."""
    zero = np.zeros(dim, np.int64)

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[str, list] = {}

        def flush() -> pd.DataFrame:
            out = pd.DataFrame([(k, s.tobytes(), n) for k, (s, n) in held.items()], columns=["key", "sum", "n"])
            held.clear()
            return out

        for batch in batches:
            times = batch["weight"].to_numpy() if weight else np.ones(len(batch), np.int64)
            for key, hv, w in zip(batch["key"], batch["hv"], times):
                own = held.setdefault(key, [zero.copy(), 0])
                own[0] += int(w) * unpack(hv, dim)
                own[1] += 1
                if len(held) >= HELD_KEYS:
                    yield flush()
        yield flush()

    def whole(group: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(s, np.int64) for s in group["sum"]], axis=0)
        key = group["key"].iloc[0]
        return pd.DataFrame({"key": [key], "hv": [pack(np.where(total == 0, tie(key, dim), total))], "vectors": [int(group["n"].sum())]})

    columns = ["key", "hv"] + ([F.col(weight).alias("weight")] if weight else [])
    sums = rows.select(*columns).mapInPandas(partial, "key string, sum binary, n long")
    return sums.groupBy("key").applyInPandas(whole, "key string, hv binary, vectors long")


def packed_vectors(dim: int = FULL, make: Callable[[str, int], np.ndarray] = generate):
    """A pandas UDF: keys to packed vectors."""

    @F.pandas_udf("binary")
    def run(keys: pd.Series) -> pd.Series:
        known = {k: pack(make(k, dim)) for k in keys.unique()}
        return keys.map(known)

    return run


def migrated(codebook: DataFrame) -> DataFrame:
    """key, hv of a codebook (ord, key, hv) under normalised keys; of several that become one, the first counts."""
    from hyperloom.functions import text

    return codebook.groupBy(text.normalize_key("key").alias("key")).agg(F.min_by("hv", "ord").alias("hv"))


def trigram_udf(dim: int = 384):
    """A pandas UDF: texts to their trigram embeddings, equal texts once."""

    @F.pandas_udf("array<float>")
    def run(texts: pd.Series) -> pd.Series:
        known = {t: trigram_embedding(t or "", dim) for t in texts.unique()}
        return texts.map(known)

    return run


def embedded(texts: DataFrame, cache: DataFrame, embed=None) -> DataFrame:
    """text, embedding, cached for the distinct normalised texts: from the cache (text, embedding) where it has them, else
    made by `embed`, a function from a column to a column (trigrams by default)."""
    from hyperloom.functions import text as t

    wanted = texts.select(t.normalize_value("text").alias("text")).where("text <> ''").distinct()
    known = cache.select(t.normalize_value("text").alias("text"), "embedding").dropDuplicates(["text"])
    own = wanted.join(known.withColumn("cached", F.lit(True)), "text", "left")
    old = own.where("cached").select("text", "embedding", "cached")
    new = own.where("cached is null").select("text", (embed or trigram_udf())(F.col("text")).alias("embedding"), F.lit(False).alias("cached"))
    return old.unionByName(new)


def cosine(a: Column, b: Column) -> Column:
    """Of two arrays; 0 where one has no length, an error where their sizes differ."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda acc, v: acc + v)
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(F.size(a) != F.size(b), F.raise_error(F.lit("vectors of different dimension"))).otherwise(F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms))
