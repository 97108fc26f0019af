"""Language of texts by averaged embeddings of hashed subwords.

Text is lower-cased and everything but letters becomes a boundary.  The byte n-grams of
a word with its boundaries are hashed into buckets; the mean of their embeddings goes
through a linear softmax.  Embeddings and softmax are learned by stochastic gradient
descent in numpy on a bounded sample (``PER_LANGUAGE`` rows of each language, short
excerpts spread over each text).  Since both layers are linear, whole texts are scored by
one look-up of all languages' weights for each n-gram.

A part of the sample that is not trained on calibrates a temperature, so that scores are
probabilities, and the score below which a prediction is rejected: the least one above
which at most ``ERROR`` of the predictions are wrong.

Defined results: null texts and texts without a letter are ``und`` with score 0 and are
rejected; languages are what the learnable rows name, null ones are not learned; with a
single language every text with a letter is that one, with none ``und``; texts of any
length are read in pieces of bounded memory; of languages that tie, the first by name is
predicted; repeated rows get equal results; an empty table gives none; further columns,
whatever their names, are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .learning import sampled
from .tables import fold

SIZES = (2, 3, 4)
BUCKETS, DIMENSIONS = 1 << 16, 16
PER_LANGUAGE, EXCERPTS, EXCERPT = 600, 4, 160
EPOCHS, BATCH, RATE = 6, 32, 0.5
ERROR = 0.01
UNKNOWN = "und"

_LETTER = regex.compile(r"\p{L}")
#: ASCII but letters is a boundary; bytes of other characters stay.
_PLAIN = bytes(b if b >= 128 or chr(b).isalpha() else 32 for b in range(256))
_SPREAD = np.uint32(0x9E3779B1)


def buckets(text: str) -> np.ndarray:
    """The buckets of all n-grams of a text's words, boundaries included."""
    data = np.frombuffer(b" " + text.lower().encode("utf-8", "replace").translate(_PLAIN) + b" ", np.uint8)
    space = data == 32
    data = data[~(space & np.concatenate([[False], space[:-1]]))].astype(np.uint32)
    space = data == 32
    found = []
    for size in SIZES:
        n = max(len(data) - size + 1, 0)
        value, inner = np.zeros(n, np.uint32), np.zeros(n, bool)
        for k in range(size):
            value = (value << np.uint32(8)) | data[k : k + n]
            if 0 < k < size - 1:
                inner |= space[k : k + n]
        value = (value ^ np.uint32(size * 0x01000193)) * _SPREAD
        found.append(((value ^ (value >> np.uint32(15))) * _SPREAD)[~inner] >> np.uint32(16))
    return np.concatenate(found)


@dataclass
class Model:
    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0
    accept: float = 0.0

    def logits(self, text: str, piece: int = 1 << 20) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for i in range(0, len(text), piece):
            at = buckets(text[i : i + piece])
            total += np.bincount(at, minlength=BUCKETS) @ self.weights if len(at) > BUCKETS else self.weights.take(at, axis=0).sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / max(n, 1) + self.bias

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        if not self.languages or not text or not _LETTER.search(text):
            return UNKNOWN, 0.0, True
        p = _softmax(self.logits(text)[None] / self.temperature)[0]
        best = int(p.argmax())
        return self.languages[best], float(p[best]), bool(p[best] < self.accept)


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit(texts: list[str], languages: list[str], apart: np.ndarray, seed: int = 11) -> Model:
    """``apart`` marks the excerpts that calibrate instead of training."""
    names = sorted(set(languages))
    if len(names) < 2:
        return Model(names, np.zeros((BUCKETS, len(names)), np.float32), np.zeros(len(names)))
    y = np.array([names.index(x) for x in languages])
    rows = [buckets(t) for t in texts]
    rng = np.random.default_rng(seed)
    vectors = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS))
    softmax, bias = np.zeros((DIMENSIONS, len(names))), np.zeros(len(names))
    train = np.flatnonzero(~apart)
    weight = (len(train) / len(names) / np.maximum(np.bincount(y[train], minlength=len(names)), 1))[y]
    softmax += rng.normal(0, 0.1, softmax.shape)
    for epoch in range(EPOCHS):
        order, rate = rng.permutation(train), RATE * (1 - epoch / EPOCHS)
        for i in range(0, len(order), BATCH):
            some = order[i : i + BATCH]
            sizes = np.array([len(rows[j]) for j in some])
            at, row = np.concatenate([rows[j] for j in some]), np.repeat(np.arange(len(some)), sizes)
            share = 1 / np.maximum(sizes, 1)
            mean = np.zeros((len(some), DIMENSIONS))
            np.add.at(mean, row, vectors[at])
            mean *= share[:, None]
            wrong = _softmax(mean @ softmax + bias)
            wrong[np.arange(len(some)), y[some]] -= 1
            wrong *= weight[some, None] / len(some)
            back = wrong @ softmax.T * share[:, None]
            softmax -= rate * 4 * mean.T @ wrong
            bias -= rate * wrong.sum(axis=0)
            np.add.at(vectors, at, -rate * 40 * back[row])
    model = Model(names, (vectors @ softmax).astype(np.float32), bias)
    held = np.flatnonzero(apart)
    if len(held):
        _calibrate(model, np.stack([model.logits(texts[j]) for j in held]), y[held])
    return model


def _calibrate(model: Model, logits: np.ndarray, y: np.ndarray) -> None:
    loss = lambda t: -np.log(np.maximum(_softmax(logits / t)[np.arange(len(y)), y], 1e-12)).mean()
    model.temperature = float(min(np.geomspace(0.05, 5, 60), key=loss))
    p = _softmax(logits / model.temperature)
    order = np.argsort(-p.max(axis=1), kind="stable")
    wrong = np.cumsum(p.argmax(axis=1)[order] != y[order]) / np.arange(1, len(y) + 1)
    good = np.flatnonzero(wrong <= ERROR)
    model.accept = float(p.max(axis=1)[order[good[-1]]]) if len(good) else 1.0


def learnable(key: Column) -> Column:
    """Rows from which may be learned; the others are held out."""
    return ~fold(key, 4, 2)


def train(docs: DataFrame, per_language: int = PER_LANGUAGE) -> Model:
    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for place, lang, text in frame[["place", "lang", "text"]].itertuples(index=False):
                most = max(len(text) - EXCERPT, 0)
                for k, at in enumerate(sorted({most * i // max(EXCERPTS - 1, 1) for i in range(EXCERPTS)})):
                    out.append((place, k, lang, text[at : at + EXCERPT]))
            yield pd.DataFrame(out, columns=["place", "part", "lang", "text"])

    rows = docs.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & learnable(F.col("doc_id")))
    few = sampled(rows, "doc_id", "lang", per_language).withColumn("place", F.xxhash64("doc_id"))
    schema = "place long, part int, lang string, text string"
    found = few.mapInPandas(cut, schema).toPandas().sort_values(["place", "part", "lang", "text"], kind="stable")
    apart = (found["place"].to_numpy(np.int64) >> 7) % 5 == 0
    return fit(found["text"].tolist(), found["lang"].tolist(), apart)


def identified(docs: DataFrame, model: Model) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected."""

    @F.arrow_udf("struct<lang_pred: string, score: double, rejected: boolean>")
    def apply(texts: pa.Array) -> pa.Array:
        found = [model.predict(t.as_py()) for t in texts]
        kinds = (("lang_pred", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_()))
        columns = [pa.array([x[i] for x in found], k) for i, (_, k) in enumerate(kinds)]
        return pa.StructArray.from_arrays(columns, names=[n for n, _ in kinds])

    df = docs.select("doc_id", fold(F.col("doc_id"), 4, 2).alias("held_out"), apply(F.col("text").cast("string")).alias("found"))
    return df.select("doc_id", "held_out", "found.lang_pred", "found.score", "found.rejected")
