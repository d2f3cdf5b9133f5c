"""Language identification by a byte convolutional network: operator 8.

The network reads windows of WINDOW bytes: an embedding of each byte, filters of several widths, the largest
response of each filter in the window, and a softmax over the languages. It is trained in numpy on a bounded
sample of labelled texts; a text's prediction averages the windows that cover it whole, by their bytes. The sample takes at most about FIT_DOCS
documents of each language, however many languages there are.

Defined results: a null text, or one without a letter, is `und` with score 0. Rows with a null lang, or without a
letter, teach nothing. If there is nothing to learn from, every text is `und`. Repeated rows and ids get equal
results. Other columns pass through `in_a_language`.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hyperloom.llm import kernels as k
from hyperloom.llm.common import remainder, share, table

UNDETERMINED = "und"
WINDOW, EMBEDDING, WIDTHS, FILTERS = 256, 8, (2, 3, 4), 16
#: Bounds of the fitting sample: documents of a language, windows of a document.
FIT_DOCS, FIT_WINDOWS = 800, 3
EPOCHS, BATCH, RATE = 8, 128, 4e-3
#: Windows that go through the network at a time.
TOGETHER = 64


class Network(NamedTuple):
    embedding: np.ndarray  # 256 x EMBEDDING
    filters: np.ndarray  # (widest * EMBEDDING) x filters, zero beyond a filter's width
    offset: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def _patches(network: Network, windows: np.ndarray) -> np.ndarray:
    x = network.embedding[windows]
    n = windows.shape[1] - max(WIDTHS) + 1
    return np.concatenate([x[:, j : j + n] for j in range(max(WIDTHS))], 2)


def probabilities(network: Network, windows: np.ndarray) -> np.ndarray:
    out = np.empty((len(windows), len(network.bias)), np.float32)
    for i in range(0, len(windows), TOGETHER):
        patches = _patches(network, windows[i : i + TOGETHER])
        b, n, d = patches.shape
        pooled = np.maximum((patches.reshape(b * n, d) @ network.filters).reshape(b, n, -1).max(1) + network.offset, 0)
        z = pooled @ network.output + network.bias
        z = np.exp(z - z.max(1, keepdims=True))
        out[i : i + TOGETHER] = z / z.sum(1, keepdims=True)
    return out


#: Which entries a filter has, by its width.
SHAPE = np.concatenate([np.repeat(np.arange(max(WIDTHS)) < w, EMBEDDING)[:, None].repeat(FILTERS, 1) for w in WIDTHS], 1).astype(np.float32)


def loss_and_gradients(net: Network, windows: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> tuple[float, list[np.ndarray]]:
    """The mean of the labels' weighted cross-entropies and its derivatives; only each filter's largest response passes
    one back."""
    wide = max(WIDTHS)
    patches = _patches(net, windows)
    b, n, d = patches.shape
    z = (patches.reshape(b * n, d) @ net.filters).reshape(b, n, -1)
    top = z.argmax(1)
    raw = np.take_along_axis(z, top[:, None], 1)[:, 0] + net.offset
    pooled = np.maximum(raw, 0)
    y = pooled @ net.output + net.bias
    y = np.exp(y - y.max(1, keepdims=True))
    y /= y.sum(1, keepdims=True)
    rows = np.arange(b)
    loss = float(-(weight[labels] * np.log(np.maximum(y[rows, labels], 1e-30))).mean())
    y[rows, labels] -= 1
    y *= (weight[labels] / b)[:, None].astype(y.dtype)
    back = (y @ net.output.T) * (raw > 0)
    peak = patches[rows[:, None], top]  # b x filters x d
    to_patch = back[:, :, None] * net.filters.T[None]
    g_embedding = np.zeros_like(net.embedding)
    for j in range(wide):
        np.add.at(g_embedding, windows[rows[:, None], top + j], to_patch[:, :, j * EMBEDDING : (j + 1) * EMBEDDING])
    return loss, [g_embedding, np.einsum("bf,bfd->df", back, peak) * SHAPE, back.sum(0), pooled.T @ y, y.sum(0)]


def fit(windows: np.ndarray, labels: np.ndarray, classes: int, seed: int = 7) -> Network:
    """Adam on the cross-entropy."""
    rng = np.random.default_rng(seed)
    start = lambda *size, scale: (rng.standard_normal(size) * scale).astype(np.float32)
    p = [start(256, EMBEDDING, scale=0.5), start(*SHAPE.shape, scale=0.3) * SHAPE, np.zeros(SHAPE.shape[1], np.float32), start(SHAPE.shape[1], classes, scale=0.2), np.zeros(classes, np.float32)]
    first, second, t = [np.zeros_like(x) for x in p], [np.zeros_like(x) for x in p], 0
    weight = len(labels) / (classes * np.maximum(np.bincount(labels, minlength=classes), 1))
    for _ in range(EPOCHS):
        for rows in np.array_split(rng.permutation(len(labels)), max(1, len(labels) // BATCH)):
            _, grads = loss_and_gradients(Network(*p), windows[rows], labels[rows], weight)
            t += 1
            for i, g in enumerate(grads):
                first[i] = 0.9 * first[i] + 0.1 * g
                second[i] = 0.999 * second[i] + 0.001 * g * g
                p[i] = (p[i] - RATE * (first[i] / (1 - 0.9**t)) / (np.sqrt(second[i] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
    return Network(*p)


def _window(data: bytes) -> np.ndarray:
    return np.frombuffer(data[:WINDOW].ljust(WINDOW, b"\0"), np.uint8)


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def learn(docs: DataFrame, train: Column) -> tuple[Network | None, list[str]]:
    """The network and its languages, from rows of docs where `train` holds."""
    taught = docs.where(train & F.col("lang").isNotNull() & has_letter(F.col("text")))
    counts = {r[0]: r[1] for r in taught.groupBy("lang").count().collect()}  # a row for each language
    if not counts:
        return None, []
    # Rows are drawn by their id and text, so that rows without an id, or of one id, are drawn one by one.
    drawn = share(F.concat_ws("|", F.col("doc_id").cast("string"), F.md5(F.col("text").cast("binary"))), "fit")
    part = F.element_at(F.create_map(*(F.lit(x) for name, n in sorted(counts.items()) for x in (name, min(1.0, FIT_DOCS / n)))), F.col("lang"))
    place = lambda j: share(F.md5(F.col("text").cast("binary")), f"window {j}")
    pieces = F.array(*(F.substring(F.col("text"), (F.floor(place(j) * F.greatest(F.length("text") - WINDOW + 1, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)) for j in range(FIT_WINDOWS)))
    sample = taught.where(drawn < part).select("lang", F.explode(F.array_distinct(pieces)).alias("piece")).distinct().toArrow()
    rows = sorted(zip(sample["lang"].to_pylist(), sample["piece"].to_pylist()))
    if not rows:
        return None, []
    names = sorted({r[0] for r in rows})
    labels = np.searchsorted(np.array(names), [r[0] for r in rows])
    return fit(np.stack([_window(r[1].encode()) for r in rows]), labels, len(names)), names


def _lettered(texts: pa.Array) -> np.ndarray:
    """Whether each text has a letter of any script."""
    import regex

    at, data = k.buffers(texts)
    seen = np.concatenate([[0], np.cumsum((k.LOWER[data] >= 97) & (k.LOWER[data] <= 122))])
    out = seen[at[1:]] > seen[at[:-1]]
    for i in np.flatnonzero(~out & (np.diff(at) > 0)):
        out[i] = bool(regex.search(r"\p{L}", texts[int(i)].as_py()))
    return out


def _predict(texts: pa.Array, network: Network | None) -> tuple[np.ndarray, np.ndarray]:
    """(class or -1, score) of each text."""
    at, data = k.buffers(texts)
    size = np.diff(at)
    count = np.maximum(1, -(-size // WINDOW))
    windows = np.zeros((count.sum(), WINDOW), np.uint8)
    first = np.concatenate([[0], np.cumsum(count)])
    windows.reshape(-1)[np.repeat(first[:-1] * WINDOW - at[:-1], size) + np.arange(len(data))] = data
    if network is None or not len(texts):
        return np.full(len(texts), -1), np.zeros(len(texts))
    weight = np.full(len(windows), WINDOW, np.float64)
    weight[first[1:] - 1] = size - (count - 1) * WINDOW
    p = np.add.reduceat(probabilities(network, windows) * weight[:, None], first[:-1]) / np.maximum(size, 1)[:, None]
    known = _lettered(texts)
    return np.where(known, p.argmax(1), -1), np.where(known, np.clip(p.max(1), 0, 1), 0.0)


def languages(docs: DataFrame, network: Network | None, names: list[str]) -> DataFrame:
    """doc_id, lang_pred, score of every row of docs."""

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in k.slices(batches):
            kinds, score = _predict(batch.column("text"), network)
            lang = [names[c] if c >= 0 else UNDETERMINED for c in kinds]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(predict, "doc_id long, lang_pred string, score double")


def in_a_language(docs: DataFrame, network: Network | None, least: float) -> DataFrame:
    """The rows of docs, all columns, that have a language with this score at least. Nothing is shuffled."""

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in k.slices(batches):
            kinds, score = _predict(batch.column("text"), network)
            yield batch.filter(pa.array((kinds >= 0) & (score >= least)))

    return docs.mapInArrow(keep, docs.schema)


def op8_byte_cnn_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = remainder(F.col("doc_id"), 4) == 2
    return languages(docs, *learn(docs, ~held_out)).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
