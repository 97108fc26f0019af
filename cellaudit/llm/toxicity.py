"""Toxic documents by two Kneser-Ney language models, one per class.

Each class has a bigram model of words; counts are numbers of texts, and what is taken
off counts of one, two and more follows from how many there are.  It backs off to the
class's continuation counts (before how many different words a word stands) and these
back off to the continuation counts of both classes together, so a rare expression gets
its probability from what the classes share.  A text is compared by the difference of
its log-likelihoods under both models, divided by its length: over the whole text and
over its windows of ``WINDOW`` words, which overlap by half, of which the most toxic
counts.  A logistic curve over the two and a rising function over that, both fitted on
sampled rows that were not counted, make a probability of them.

All labelled rows that may be learned from are counted, by Spark, apart from a bounded
sample on which the curve is fitted (at most a quarter of ``PER_LABEL`` whole texts of each
label).  A first count finds the words that occur ``COMMON`` times or more, which get
numbers of their own; rarer ones share the remaining 31-bit numbers by hash, so that they
still count as different neighbours.  A second one counts the bigrams of numbers, of which
all found in ``COMMON`` texts or more go into the model.  Neither has an upper bound: the
model, which the driver gathers and every task holds, grows with the different words and
bigrams found so often.  Scores read whole texts.

Defined results: null texts and texts without words have difference 0; texts of any
length are read; repeated rows get equal scores, and so do texts of equal differences;
without rows of both labels every score is the share of label 1, 0 without labels; an
empty table gives no rows; further columns, whatever their names, are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import chain
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import chosen
from .tables import fold, stored

PER_LABEL = 3000
#: Words that follow so many different words have counts of their own in each class; rarer
#: ones have the shared counts alone, or copied texts would be known by heart.
COMMON = 10
WINDOW = 3
THRESHOLD = 0.7
#: Different words that a task gathers before it hands their counts on.
_GATHERED = 1 << 18
_CODES = 1 << 31

_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
_FILTER = 22
_SPREAD = np.uint64(0x9E3779B97F4A7C15)
_known: dict[int, dict[bytes, int]] = {}


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(_WORDS).split() if text else []


@dataclass
class Model:
    """Arrays by word number: 0 is any unknown word, the last one a text's start."""

    constant: float | None = None
    vocabulary: list[bytes] = field(default_factory=list)
    backoff: np.ndarray = field(default_factory=lambda: np.empty(0))  # class, word: probability without a history
    left: np.ndarray = field(default_factory=lambda: np.empty(0))  # class, word: mass that a history leaves
    pairs: np.ndarray = field(default_factory=lambda: np.empty(0))  # sorted keys of known bigrams
    seen: np.ndarray = field(default_factory=lambda: np.empty(0))  # class, bigram: probability beyond that
    curve: np.ndarray = field(default_factory=lambda: np.zeros(3))
    knots: np.ndarray = field(default_factory=lambda: np.empty((2, 0)))  # places on the curve and their probabilities

    def numbers(self) -> dict[bytes, int]:
        """Word numbers; made once in a process."""
        name = hash((len(self.vocabulary), self.vocabulary[0], self.vocabulary[-1], self.backoff.tobytes())) if self.vocabulary else 0
        if name not in _known:
            _known.clear()
            _known[name] = {w: i + 1 for i, w in enumerate(self.vocabulary)}
        return _known[name]

    def differences(self, texts: list[str | None]) -> np.ndarray:
        """For each text the difference by length over the whole and over its worst window."""
        get, size = self.numbers().get, self.backoff.shape[1]
        lists = [words(t) for t in texts]
        counts = np.array([len(x) for x in lists], np.int64)
        out = np.zeros((len(texts), 2))
        if not counts.sum():
            return out
        w = np.fromiter((get(x, 0) for x in chain.from_iterable(lists)), np.int64, counts.sum())
        ends = np.cumsum(counts)
        full = counts > 0
        starts = (ends - counts)[full]
        h = np.concatenate([[size - 1], w[:-1]])
        h[starts] = size - 1
        p = self.left[:, h] * self.backoff[:, w]
        key = h.astype(np.uint64) * np.uint64(size) + w.astype(np.uint64)
        may = np.flatnonzero(self._filter()[(key * _SPREAD) >> np.uint64(64 - _FILTER)])
        at = np.minimum(np.searchsorted(self.pairs, key[may]), max(len(self.pairs) - 1, 0))
        hit = self.pairs[at] == key[may] if len(self.pairs) else np.zeros(0, bool)
        p[:, may[hit]] += self.seen[:, at[hit]]
        value = np.where(w == h, 0.0, np.log(p[1]) - np.log(p[0]))  # repeating a word adds nothing
        total = np.concatenate([[0.0], np.cumsum(value)])
        out[full, 0] = (total[ends] - total[ends - counts])[full] / counts[full]
        steps = np.maximum(-(-(counts[full] - WINDOW) // (WINDOW // 2)), 0) + 1
        first = np.repeat(starts, steps) + (np.arange(steps.sum()) - np.repeat(np.cumsum(steps) - steps, steps)) * (WINDOW // 2)
        last = np.minimum(first + WINDOW, np.repeat(ends[full], steps))
        first = np.maximum(np.minimum(first, last - WINDOW), np.repeat(starts, steps))
        window = (total[last] - total[first]) / (last - first)
        out[full, 1] = np.maximum.reduceat(window, np.cumsum(steps) - steps)
        return out

    def _filter(self) -> np.ndarray:
        if not hasattr(self, "_bits"):
            self._bits = np.zeros(1 << _FILTER, bool)
            self._bits[(self.pairs * _SPREAD) >> np.uint64(64 - _FILTER)] = True
        return self._bits

    def scores(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        z = self.curve[0] + self.differences(texts) @ self.curve[1:]
        smooth = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        return 0.98 * np.interp(z, *self.knots) + 0.02 * smooth


def coded(found: list[bytes], number: dict[bytes, int]) -> np.ndarray:
    """Numbers of words: their own, or by hash beyond these and that of a text's start."""
    own, rest = len(number) + 2, _CODES - len(number) - 2
    get = number.get
    return np.array([get(x) or own + crc32(x) % rest for x in found], np.int64)


def _vocabulary(rows: DataFrame) -> list[bytes]:
    """All words with ``COMMON`` occurrences or more, the most frequent first."""

    def occurrences(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: Counter[bytes] = Counter()
        for text in chain.from_iterable(frame["text"] for frame in frames):
            found.update(words(text))
            if len(found) >= _GATHERED:
                yield pd.DataFrame({"w": list(found), "n": list(found.values())})
                found.clear()
        if found:
            yield pd.DataFrame({"w": list(found), "n": list(found.values())})

    found = rows.select("text").mapInPandas(occurrences, "w binary, n long").groupBy("w").agg(F.sum("n").alias("n"))
    return found.where(F.col("n") >= COMMON).orderBy(F.desc("n"), "w").select("w").toArrow()["w"].to_pylist()


def _bigrams(rows: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """(h, w, c0, c1): in how many texts of either label a word follows another, by their numbers."""
    start = len(vocabulary) + 1

    def pairs(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        number = {w: i + 1 for i, w in enumerate(vocabulary)}
        kept: tuple[list, list] = ([], [])
        gathered = 0

        def counted() -> Iterator[pd.DataFrame]:
            for label, keys in enumerate(kept):
                if keys:
                    both, n = np.unique(np.concatenate(keys), return_counts=True)
                    yield pd.DataFrame({"key": both, "c0": n * (label == 0), "c1": n * (label == 1)})
                    keys.clear()

        for frame in frames:
            for label, text in zip(frame["label"], frame["text"], strict=True):
                w = coded(words(text), number)
                if len(w):
                    kept[label].append(np.unique(np.concatenate([[start], w[:-1]]) * _CODES + w))
                    gathered += len(kept[label][-1])
                if gathered >= 4 * _GATHERED:
                    yield from counted()
                    gathered = 0
        yield from counted()

    found = rows.select("label", "text").mapInPandas(pairs, "key long, c0 long, c1 long")
    found = found.groupBy("key").agg(F.sum("c0").alias("c0"), F.sum("c1").alias("c1"))
    return found.select(F.expr(f"key div {_CODES}").alias("h"), (F.col("key") % _CODES).alias("w"), "c0", "c1")


def _steps(counts: str) -> list:
    """How many entries have a count of 1, 2, 3 or 4, and the sum of all counts."""
    return [*(F.count(F.when(F.col(counts) == k, 1)).alias(f"{counts}_{k}") for k in range(1, 5)), F.sum(counts).alias(f"{counts}_s"), F.count(F.when(F.col(counts) > 2, 1)).alias(f"{counts}_m")]


def discounts(ones: int, twos: int, threes: int, fours: int) -> np.ndarray:
    """What to take off counts of 0, 1, 2 and more, from how many entries have small counts."""
    y = ones / max(ones + 2 * twos, 1)
    found = [k - (k + 1) * y * above / max(own, 1) for k, own, above in ((1, ones, twos), (2, twos, threes), (3, threes, fours))]
    return np.array([0.0, *(np.clip(d, 0.3 * k, k - 0.05) for k, d in enumerate(found, 1))])


def _less(counts: np.ndarray, off: np.ndarray) -> np.ndarray:
    return np.maximum(counts - off[np.minimum(counts, 3).astype(int)], 0)


def _count(rows: DataFrame) -> Model:
    """Both models, without the curve, from the counted rows."""
    listed = _vocabulary(rows)
    start = len(listed) + 1
    types = stored(_bigrams(rows, listed), "bigrams")
    some = lambda c: F.count(F.when(F.col(c) > 0, 1))
    after = types.groupBy("w").agg(F.count("*").alias("n"), some("c0").alias("n0"), some("c1").alias("n1"))
    of_words = after.agg(F.count("*").alias("words"), F.sum("n").alias("total"), *_steps("n0"), *_steps("n1")).first()
    of_types = types.agg(*_steps("c0"), *_steps("c1")).first()
    # One row for each numbered word at most, and all bigrams that are common.
    after = after.where((F.col("n") >= COMMON) & (F.col("w") < start)).toArrow().to_pandas().sort_values("w")
    before = types.where(F.col("h") <= start).groupBy("h").agg(F.sum("c0").alias("s0"), F.sum("c1").alias("s1")).toArrow().to_pandas()
    often = types.where((F.col("c0") + F.col("c1") >= COMMON) & (F.col("h") <= start) & (F.col("w") < start))
    often = often.toArrow().to_pandas()

    vocabulary = [listed[w - 1] for w in after["w"]]
    size = len(vocabulary) + 2
    number = np.zeros(start + 1, np.int64)  # words without counts of their own are unknown ones
    number[after["w"].to_numpy(np.int64)] = np.arange(1, size - 1)
    number[start] = size - 1
    h, w = number[often["h"].to_numpy(np.int64)], number[often["w"].to_numpy(np.int64)]
    known = (h > 0) & (w > 0)
    h, w = h[known], w[known]
    spot = number[before["h"].to_numpy(np.int64)]

    shared = np.full(size, 0.5 / ((of_words["total"] or 0) + 0.5 * (of_words["words"] + 1)))
    shared[1:-1] *= 2 * after["n"].to_numpy() + 1
    backoff, left, seen = np.empty((2, size)), np.ones((2, size)), np.empty((2, len(h)))
    for c in (0, 1):
        own, n = np.zeros(size), f"n{c}"
        off = discounts(*(of_words[f"{n}_{k}"] for k in range(1, 5)))
        own[1:-1] = _less(after[n].to_numpy(), off)
        total = max(of_words[f"{n}_s"] or 0, 1)
        backoff[c] = (own + (total - own.sum()) * shared) / total
        c_ = f"c{c}"
        off = discounts(*(of_types[f"{c_}_{k}"] for k in range(1, 5)))
        total = np.ones(size)
        total[spot[spot > 0]] = np.maximum(before[f"s{c}"].to_numpy()[spot > 0], 1)
        seen[c] = _less(often[c_].to_numpy()[known], off) / total[h]
        np.subtract.at(left[c], h, seen[c])
    keys = h.astype(np.uint64) * np.uint64(size) + w.astype(np.uint64)
    order = np.argsort(keys)
    return Model(vocabulary=vocabulary, backoff=backoff, left=left, pairs=keys[order], seen=seen[:, order])


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60) -> np.ndarray:
    """Intercept and slopes by Newton's method, slightly pulled towards 0."""
    scale = np.maximum(x.std(axis=0), 1e-9)
    z = np.column_stack([np.ones(len(x)), x / scale])
    beta, pull = np.zeros(z.shape[1]), np.diag([1e-6] + [1e-2] * x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(z @ beta, -30, 30)))
        slope = z.T @ (weight * (p - y)) + pull @ beta
        curve = (z * (weight * p * (1 - p))[:, None]).T @ z + pull
        step = np.linalg.solve(curve, slope)
        beta -= np.clip(step, -2, 2)
    return beta / np.concatenate([[1.0], scale])


def rising(z: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Knots of the rising function that fits best: neighbours that fall are pooled."""
    blocks: list[list[float]] = []
    for at, value, w in sorted(zip(z.tolist(), y.tolist(), weight.tolist(), strict=True)):
        blocks.append([value * w, w, at, at])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            total, w, low, high = blocks.pop()
            blocks[-1] = [blocks[-1][0] + total, blocks[-1][1] + w, blocks[-1][2], high]
    ends = [(at, total / w) for total, w, low, high in blocks for at in (low, high)]
    return np.array(ends).T


def learnable(key: Column) -> Column:
    """Rows from which may be learned; the others are held out."""
    return ~fold(key, 3, 1)


def train(docs: DataFrame, labels: DataFrame, per_label: int = PER_LABEL) -> Model:
    marked = labels.select("doc_id", F.col("toxic").cast("int").alias("label"))
    marked = marked.where(learnable(F.col("doc_id")) & F.col("label").isin(0, 1) & F.col("doc_id").isNotNull())
    counts = {r[0]: r[1] for r in marked.groupBy("label").count().collect()}
    if len(counts) < 2:
        return Model(constant=float(sum(k for k in counts)))
    quarter = F.pmod(F.shiftright(F.xxhash64("doc_id"), 9), F.lit(4)) == 0
    marked = marked.withColumn("apart", chosen(marked, "doc_id", "label", per_label) & quarter)
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    # at every size a hash join that builds the narrow side: labels are never sent whole, texts never sorted
    rows = stored(texts.join(marked.hint("shuffle_hash"), "doc_id"), "learned")
    model = _count(rows.where("NOT apart"))

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = model.differences(frame["text"].tolist())
            yield pd.DataFrame({"doc_id": frame["doc_id"], "label": frame["label"], "whole": found[:, 0], "worst": found[:, 1]})

    apart = rows.where("apart").select("doc_id", "label", "text")
    found = apart.mapInPandas(measure, "doc_id long, label int, whole double, worst double").toPandas().sort_values(["doc_id", "label"])
    y = found["label"].to_numpy(float)
    if len(set(y)) < 2:
        return Model(constant=counts[1] / sum(counts.values()))
    weight = np.where(y == 1, counts[1] / max(y.sum(), 1), counts[0] / max((1 - y).sum(), 1)) * len(y) / sum(counts.values())
    x = found[["whole", "worst"]].to_numpy()
    model.curve = logistic(x, y, weight)
    model.knots = rising(model.curve[0] + x @ model.curve[1:], y, weight)
    return model


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""

    @F.arrow_udf("double")
    def apply(texts: pa.Array) -> pa.Array:
        found = [model.scores(texts.slice(i, 500).to_pylist()) for i in range(0, len(texts), 500)]
        return pa.array(np.concatenate(found) if found else np.empty(0), pa.float64())

    df = docs.select("doc_id", fold(F.col("doc_id"), 3, 1).alias("held_out"), apply(F.col("text").cast("string")).alias("score"))
    return df.select("*", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
