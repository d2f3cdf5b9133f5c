"""Secret scans by token efficiency: operator 9.

Three patterns give base spans: assignments to credential names, access keys, and long hexadecimal runs. The
method adds random strings: a run of key characters that a vocabulary made from ordinary text of many languages
encodes badly, so that it has few characters per token. Known digests, UUIDs, numbers and names made of short words are
left out first. A long word is asked for its ratio like any other run, with a bound of its own, as invented and
compound words come near it.

Defined results: a null or empty text has no span; texts of any length are scanned whole; repeated rows are
scanned one by one; offsets are code points with the end exclusive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import kernels as k
from hyperloom.llm.common import table
from hyperloom.llm.lengths import PIECES, read_vocabulary

KINDS = ("assign", "access", "hex", "random")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
NAMES = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: The vocabulary; of the public ones it parts random strings and words best.
VOCABULARY = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: Characters per token below which a run is random; words and names have more.
RATIO = 2.0
#: In runs of words and numbers, the length from which a word is asked for its ratio, and the ratio below which it is
#: random up to LONGEST_WORD letters. In the given tables no invented word of that length has less (1 % have under 2),
#: and no longer one under RATIO.
ASKED_WORD, LONGEST_WORD, WORD_RATIO = 16, 19, 1.77
#: Lengths of common digests in hexadecimal.
DIGESTS = (32, 40, 56, 64, 96, 128)
KEY_BYTE = np.array([chr(b) in "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-" for b in range(256)])
SHORTEST_RUN = 16


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end), sorted."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if len(m[0]) >= LEAST["hex"]]
    return sorted(found)


def least_ratio(run: str) -> float:
    """Characters per token that a run has at least if it is no secret: none for digests, UUIDs, numbers and names made
    of words, whatever their ratio."""
    if len(run) in DIGESTS and re.fullmatch(r"[0-9a-fA-F]+", run) or re.fullmatch(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", run):
        return 0.0
    parts = [p for p in re.split(r"[+/_=-]+", run) if p]
    if not all(re.fullmatch(r"[A-Za-z]?[a-z]*|[A-Z]+|[0-9]+|[a-z]+[0-9]{1,4}", p) for p in parts):
        return RATIO
    longest = max((len(x) for x in re.findall("[A-Za-z]+", run)), default=0)
    return 0.0 if longest < ASKED_WORD else WORD_RATIO if longest <= LONGEST_WORD else RATIO


def random_spans(text: str, taken: list[tuple[int, int, int]], tokens, known: frozenset[str] = frozenset()) -> list[tuple[int, int, int]]:
    """Runs of low token efficiency that no base span touches. tokens(run) is its number of tokens."""
    out = []
    for m in RUN.finditer(text):
        run = m[0]
        least = least_ratio(run)
        if run in known or not least or any(a < m.end() and m.start() < b for a, _, b in taken):
            continue
        if len(run) < least * tokens(run):
            out.append((m.start(), 3, m.end()))
    return out


def has_runs(texts: pa.Array) -> np.ndarray:
    """Whether each text has a run of SHORTEST_RUN key characters or a credential name; others have no span."""
    at, data = k.buffers(texts)
    begins, ends = k.run_bounds(at, KEY_BYTE[data])
    flags = np.zeros(len(texts), bool)
    flags[np.searchsorted(at, begins[ends - begins >= SHORTEST_RUN], side="right") - 1] = True
    low = k.LOWER[data].tobytes()
    for name in NAMES:
        i = low.find(name)
        while i >= 0:
            own = int(np.searchsorted(at, i, side="right")) - 1
            flags[own] = True
            i = low.find(name, max(i + 1, int(at[own + 1]) - len(name)))
    return flags


def scan(docs: DataFrame, vocabulary: str = VOCABULARY, known: frozenset[str] = frozenset()) -> DataFrame:
    """doc_id and spans: array of (kind, start, end) by start, then kind. `known`: strings that are no secrets."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        own = tiktoken.Encoding("own", pat_str=PIECES, mergeable_ranks=ranks.value, special_tokens={})
        for batch in k.slices(batches):
            texts, out = batch.column("text"), [[]] * batch.num_rows
            for i in np.flatnonzero(has_runs(texts)):
                text = texts[int(i)].as_py()
                base = base_spans(text)
                every = sorted(base + random_spans(text, base, lambda run: len(own.encode_ordinary(run)), known))
                out[i] = [{"kind": KINDS[c], "start": a, "end": b} for a, c, b in every]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(out, pa.list_(span))], ["doc_id", "spans"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(find, "doc_id long, spans array<struct<kind string, start long, end long>>")


def op9_token_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(table(spark, sf_dir, "documents"))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "random")
    return found.select("doc_id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
