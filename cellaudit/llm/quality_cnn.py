"""A convolutional network over bytes that tells good documents from poor ones.

Bytes are embedded, learned filters slide over all of them, and each filter's largest
response is taken in chunks of 512 positions that overlap by half.  Mean and maximum of
a document's chunks go into one logistic unit.  The largest response of a chunk is that
of its two halves, so each byte is looked at once; and since embedding and filter are
both linear, a filter's response is a sum of four look-ups by pairs of bytes.

Fitted in numpy on a bounded sample of the labelled rows (``PER_LABEL`` of each label,
``TRAINED_CHUNKS`` chunks spread evenly over each text); scores read whole texts.  The
sample is balanced, the scores are shifted back to the labels' true shares.

Defined results: null and empty texts are one chunk of padding; texts of any length are
read in pieces of bounded memory; repeated rows get equal scores; without rows of both
labels every score is the share of label 1, 0.5 if there are no labels at all; a score of
exactly 0.5 counts as good; an empty table gives no rows; further columns are handed on by
``kept_documents``, whatever their names, and not looked at by ``scored``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import labelled_texts
from .tables import fold, fresh, utf8

WIDTH, EMBEDDING, FILTERS = 8, 6, 16
HALF = 256
PER_LABEL, TRAINED_CHUNKS, STEPS, BATCH = 1200, 6, 700, 32
RATE = 0.01
THRESHOLD = 0.5

_tables: dict[bytes, np.ndarray] = {}


@dataclass
class Network:
    """``constant`` is the score of every document if nothing could be learned."""

    constant: float | None = None
    embedding: np.ndarray = field(default_factory=lambda: np.empty(0))
    filters: np.ndarray = field(default_factory=lambda: np.empty(0))
    bias: np.ndarray = field(default_factory=lambda: np.empty(0))
    weights: np.ndarray = field(default_factory=lambda: np.empty(0))
    offset: float = 0.0

    def by_byte(self) -> np.ndarray:
        """Response parts by place in the window, byte and filter."""
        return np.einsum("be,kef->kbf", self.embedding, self.filters)

    def by_pair(self) -> np.ndarray:
        """The same for two neighbouring bytes; made once in a process."""
        name = self.filters.tobytes()
        if name not in _tables:
            single = self.by_byte().astype(np.float32)
            _tables.clear()
            _tables[name] = (single[0::2, :, None] + single[1::2, None, :]).reshape(WIDTH // 2, 1 << 16, FILTERS)
        return _tables[name]

    def scores(self, data: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """One probability for each text; ``starts`` says where it begins in ``data``."""
        n = len(starts) - 1
        if self.constant is not None or not n:
            return np.full(n, self.constant or 0.0)
        lengths = np.maximum(np.diff(starts), 1)
        firsts = np.concatenate([[0], np.cumsum(lengths + WIDTH)])
        padded = np.zeros(firsts[-1] + WIDTH, np.uint16)
        shift = np.repeat(firsts[:-1] - starts[:-1], np.diff(starts))
        padded[np.arange(len(data)) + shift] = data
        pairs = (padded[:-1] << 8) | padded[1:]
        halves = -(-lengths // HALF)
        row = np.repeat(np.arange(n), halves)
        place = np.arange(len(row)) - np.repeat(np.cumsum(halves) - halves, halves)
        begin = firsts[row] + place * HALF
        end = np.minimum(begin + HALF, firsts[row] + lengths[row])
        best = self._best(pairs, begin, end)
        last = place == halves[row] - 1
        chunk = np.maximum(best, np.where(last[:, None], best, np.roll(best, -1, axis=0)))
        use = ~last | (halves[row] == 1)
        value = np.maximum(chunk[use] + self.bias, 0)
        at = np.concatenate([[0], np.cumsum(np.maximum(halves - 1, 1))])[:-1]
        mean = np.add.reduceat(value, at, axis=0) / np.maximum(halves - 1, 1)[:, None]
        both = np.concatenate([mean, np.maximum.reduceat(value, at, axis=0)], axis=1)
        return 1 / (1 + np.exp(-np.clip(both @ self.weights + self.offset, -30, 30)))

    def _best(self, pairs: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Each filter's largest response in every half chunk, some halves at a time."""
        tables = self.by_pair()
        best = np.empty((len(begin), FILTERS), np.float32)
        for i in range(0, len(begin), 64):
            b, e = begin[i : i + 64], end[i : i + 64]
            low, high = b[0], e[-1] + 1
            response = tables[0].take(pairs[low:high], axis=0)
            for k in range(1, WIDTH // 2):
                response += tables[k].take(pairs[low + 2 * k : high + 2 * k], axis=0)
            best[i : i + 64] = np.maximum.reduceat(response, np.stack([b, e], axis=1).ravel() - low, axis=0)[::2]
        return best


def chunks(text: str, most: int) -> np.ndarray:
    """Up to ``most`` chunks, spread evenly over the text, with the bytes that windows reach into."""
    data = np.frombuffer(text.encode("utf-8", "replace") or b"\0", np.uint8)
    n = max(1, -(-len(data) // HALF) - 1)
    places = np.unique(np.linspace(0, n - 1, min(most, n)).round().astype(int)) * HALF
    out = np.zeros((len(places), 2 * HALF + WIDTH), np.uint8)
    for i, at in enumerate(places):
        part = data[at : at + out.shape[1]]
        out[i, : len(part)] = part
    return out


class _Adam:
    def __init__(self, parts: list[np.ndarray]) -> None:
        self.parts, self.step = parts, 0
        self.first, self.second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]

    def update(self, gradients: list[np.ndarray], rate: float) -> None:
        self.step += 1
        for p, g, a, b in zip(self.parts, gradients, self.first, self.second, strict=True):
            a += 0.1 * (g - a)
            b += 0.001 * (g * g - b)
            p -= rate * (a / (1 - 0.9**self.step)) / (np.sqrt(b / (1 - 0.999**self.step)) + 1e-8)


def fit(texts: list[np.ndarray], labels: np.ndarray, share: float, steps: int = STEPS, seed: int = 7) -> Network:
    """``texts``: the chunks of each; ``share``: that of label 1 among all labelled rows."""
    if len(set(labels.tolist())) < 2:
        return Network(constant=float(np.mean(labels)) if len(labels) else 0.5)
    rng = np.random.default_rng(seed)
    net = Network(
        embedding=rng.normal(0, 0.5, (256, EMBEDDING)), filters=rng.normal(0, 0.3, (WIDTH, EMBEDDING, FILTERS)),
        bias=np.zeros(FILTERS), weights=rng.normal(0, 0.1, 2 * FILTERS),
    )
    offset = np.zeros(1)
    adam = _Adam([net.embedding, net.filters, net.bias, net.weights, offset])
    weight = np.where(labels == 1, 0.5 / np.mean(labels), 0.5 / (1 - np.mean(labels)))
    order = np.concatenate([rng.permutation(len(texts)) for _ in range(-(-steps * BATCH // len(texts)))])
    for step in range(steps):
        some = order[step * BATCH : (step + 1) * BATCH]
        adam.update(_gradients(net, offset, [texts[j] for j in some], labels[some], weight[some]), RATE * (1 - step / steps))
    net.offset = float(offset[0]) + float(np.log(share / (1 - share)))
    return net


def _gradients(net: Network, offset: np.ndarray, texts: list[np.ndarray], labels: np.ndarray, weight: np.ndarray) -> list[np.ndarray]:
    x = np.concatenate(texts)
    counts = np.array([len(t) for t in texts])
    row, at = np.repeat(np.arange(len(texts)), counts), np.cumsum(counts) - counts
    tables = net.by_byte().astype(np.float32)
    response = tables[0].take(x[:, : 2 * HALF], axis=0)
    for k in range(1, WIDTH):
        response += tables[k].take(x[:, k : k + 2 * HALF], axis=0)
    where = response.argmax(axis=1)
    value = np.maximum(np.take_along_axis(response, where[:, None, :], axis=1)[:, 0] + net.bias, 0)
    mean, top = np.add.reduceat(value, at, axis=0) / counts[:, None], np.maximum.reduceat(value, at, axis=0)
    both = np.concatenate([mean, top], axis=1)
    p = 1 / (1 + np.exp(-np.clip(both @ net.weights + offset[0], -30, 30)))
    error = weight * (p - labels) / len(texts)
    back = error[:, None] * net.weights
    grown = back[row, :FILTERS] / counts[row, None] + back[row, FILTERS:] * (value == top[row])
    grown *= value > 0
    to_embedding, to_filters = np.zeros_like(net.embedding), np.zeros_like(net.filters)
    for k in range(WIDTH):
        byte = np.take_along_axis(x, where + k, axis=1).astype(np.int64)
        part = np.bincount((byte * FILTERS + np.arange(FILTERS)).ravel(), grown.ravel(), 256 * FILTERS).reshape(256, FILTERS)
        to_filters[k] = net.embedding.T @ part + 1e-4 * net.filters[k]
        to_embedding += part @ net.filters[k].T
    return [to_embedding, to_filters, grown.sum(axis=0), both.T @ error + 1e-4 * net.weights, np.array([error.sum()])]


def learnable(key: Column) -> Column:
    """Rows from which may be learned; the others are held out."""
    return ~fold(key, 3, 1)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Network:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({"label": frame["label"], "place": frame["place"], "chunks": [chunks(t, TRAINED_CHUNKS).tobytes() for t in frame["text"]]})

    rows = labelled_texts(docs, labels, "quality", learnable, per_label).withColumn("place", F.xxhash64("doc_id"))
    found = rows.mapInPandas(cut, "label int, place long, chunks binary").toPandas().sort_values(["place", "label", "chunks"], kind="stable")
    marked = labels.where(learnable(F.col("doc_id")) & F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull())
    share = marked.agg(F.avg("quality")).first()[0]
    texts = [np.frombuffer(c, np.uint8).reshape(-1, 2 * HALF + WIDTH) for c in found["chunks"]]
    return fit(texts, found["label"].to_numpy(np.int64), float(share if share is not None else 0.5))


def score(text: Column, network: Network) -> Column:
    """The probability that a text is good, a column to use in any expression."""

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        out = [np.empty(0)]
        for part in _bounded(texts):
            out.append(network.scores(*utf8(part)))
        return pa.array(np.concatenate(out), pa.float64())

    return apply(F.coalesce(text.cast("string"), F.lit("")))


def _bounded(texts: pa.Array, most: int = 1 << 21) -> Iterator[pa.Array]:
    """Parts of so many bytes, or one longer text."""
    _, starts = utf8(texts)
    at = 0
    while at < len(texts):
        end = max(at + 1, int(np.searchsorted(starts, starts[at] + most, side="right")) - 1)
        yield texts.slice(at, end - at)
        at = end


def scored(docs: DataFrame, network: Network) -> DataFrame:
    df = docs.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), score(F.col("text"), network).alias("score"))
    return df.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def kept_documents(docs: DataFrame, labels: DataFrame, examples: DataFrame | None = None) -> DataFrame:
    """The documents that score at least ``THRESHOLD``, with the columns they came with.

    ``examples``: documents to learn from, if not these; filters before this one may
    have left no poor ones.
    """
    name = fresh(docs, "quality_score")
    df = docs.withColumn(name, score(F.col("text"), train(docs if examples is None else examples, labels)))
    return df.where(F.col(name) >= THRESHOLD).select(*docs.columns)
