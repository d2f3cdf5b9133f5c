"""Vectorised text kernels that run inside tasks, on the buffers of Arrow string columns.

Words are ``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased. A word, and a run of n words, is known by a
64-bit hash; two of V different words share a hash with a chance of about V*V / 2**65.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Bytes of text handled at a time, so that memory doesn't follow the size of Arrow batches.
SLICE_BYTES = 1 << 20
U64 = np.uint64


def random_words(n: int, seed: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(0, 2**64, n, dtype=U64)


_rank = np.arange(256, dtype=np.uint8)
LOWER = np.where((_rank >= 65) & (_rank <= 90), _rank + 32, _rank).astype(np.uint8)
IS_SPACE = (_rank == 32) | ((_rank >= 9) & (_rank <= 13))
BYTE_CODE = random_words(256, 11)
BASE = 0x9E3779B97F4A7C15  # odd, so that it can be inverted modulo 2**64
BASE_INVERSE = pow(BASE, -1, 2**64)
COEFFICIENTS = random_words(64, 12) | U64(1)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> U64(32))) * U64(0xD6E8FEB86659FD93)
    return x ^ (x >> U64(32))


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=U64)
    out[:1] = 1
    return np.cumprod(out, dtype=U64)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of a string column, or a binary one without nulls; a null is an empty text."""
    texts = pa.array(texts.fill_null("")) if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    _, offsets, data = texts.buffers()
    n = len(texts)
    at = np.frombuffer(offsets, kind)[texts.offset : texts.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return at - at[0], whole[at[0] : at[-1]]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", parts: int = 1) -> Iterator[pa.RecordBatch]:
    """The batches' rows in pieces of about SLICE_BYTES / parts of text; a longer text comes alone."""
    for batch in batches:
        texts = batch.column(column)
        at, _ = buffers(texts)
        begin = 0
        while begin < batch.num_rows:
            end = max(begin + 1, int(np.searchsorted(at, at[begin] + SLICE_BYTES // parts, side="right")) - 1)
            yield batch.slice(begin, end - begin)
            begin = end


def run_bounds(at: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of all runs of bytes that are inside; a run ends with its text at the latest."""
    n = len(inside)
    first = np.zeros(n + 1, bool)
    first[at] = True
    begins = inside.copy()
    begins[1:] &= ~inside[:-1] | first[1:n]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:] | first[1:n]
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def word_bounds(at: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(begins, ends) of all words, in bytes."""
    return run_bounds(at, ~IS_SPACE[data])


def word_hashes(data: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Of the words data[begins[i]:ends[i]], none of them empty."""
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(BYTE_CODE[LOWER[data]] * powers(BASE, len(data)), out=total[1:])
    return mix((total[ends] - total[begins]) * powers(BASE_INVERSE, len(data))[begins])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all words in order, offsets: document i has words offsets[i]:offsets[i + 1])."""
    at, data = buffers(texts)
    if len(data) == 0:
        return np.zeros(0, U64), np.zeros(len(at), np.int64)
    begins, ends = word_bounds(at, data)
    return word_hashes(data, begins, ends), np.searchsorted(begins, at)


def ngrams_of(words: np.ndarray, at: np.ndarray, n: int, whole_if_short: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of each document's runs of n words, offsets). With fewer words, the whole sequence is one run if asked for."""
    count = np.diff(at)
    runs = np.maximum(count - n + 1, 0)
    short = np.flatnonzero((runs == 0) & (count > 0)) if whole_if_short else np.zeros(0, np.int64)
    made = runs.copy()
    made[short] = 1
    offsets = np.concatenate([[0], np.cumsum(made)])
    out = np.zeros(offsets[-1], U64)
    long = runs > 0
    if long.any():
        total = max(len(words) - n + 1, 0)
        every = words[:total] * COEFFICIENTS[0]
        for j in range(1, n):
            every = every + words[j : total + j] * COEFFICIENTS[j]
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, at[:-1][long], 1)
        np.add.at(step, at[:-1][long] + runs[long], -1)
        taken = np.cumsum(step)[:total] > 0
        place = np.ones(len(out), bool)
        place[offsets[:-1][short]] = False
        out[place] = every[taken]
    for i in short:
        own = words[at[i] : at[i + 1]]
        out[offsets[i]] = (own * COEFFICIENTS[: len(own)]).sum(dtype=U64) + U64(len(own))
    return mix(out), offsets
