"""Hard negatives by segment summaries: bounds from means and deviations before exact scores.

Every vector is stored with the mean and the deviation of its segments, on two levels (4
segments, each split in 4).  For two vectors and one segment, the product is that of the
means plus or minus at most that of the deviations, so sums over segments bound a score
from both sides.  A task takes one block of anchors and one tile of rows.  It bounds all
scores by the coarse segments, refines those that may matter by the fine ones, and scores
exactly what is left:

* positives (rows of the anchor's label): a row may matter if its upper bound reaches the
  fifth largest lower bound, or the fifth best score so far;
* negatives (rows of other labels): if its bounds meet the span of scores that some
  positive allows, and its upper bound reaches the third best score in that span so far.

Exact scores are whole numbers.  Tasks hand on at most five (three) rows for each anchor
(and positive); the best of all tiles are taken by a window over these few.  Blocks and
tiles have bounded sizes whatever labels say, so a label that many rows share is split
like any other.  Anchors (rows whose id is divisible by 50) meet all rows, in blocks.

Defined results: rows without vec_id, label or vector, with an empty vector or with null
or non-finite components take no part.  Vectors of different length are never compared.
Every row counts for itself: another row with the same vec_id is another row, an anchor
that comes twice gives its rows twice.  Ties go to the smaller vec_id.  A positive without
a fitting negative gives no row, so do positive scores below zero.  An empty table gives
no rows.  Scores that a long can't hold raise an error.  Further columns are not looked
at, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored

EVERY, SHIFTED, LABELS = 50, 7, 10
POSITIVES, NEGATIVES = 5, 3
#: Percent of the positive's score that a negative's may have.
LEAST, MOST = 50, 95
SCALE = 256
#: Segments by level.
LEVELS = (4, 16)
#: Anchors in a block at most, rows in a tile at least (unless there are fewer) and at most.
BLOCK, SMALL_TILE, TILE, TILES = 4096, 2048, 65536, 24
#: Anchors and rows that are bounded at once.
ANCHORS, ROWS = 64, 4096
#: Room for rounding, relative to the largest product of two vectors' lengths.
ROOM = 1e-9

_STORED = "row long, vec_id long, label long, size int, x binary, means binary, deviations binary"


# ---- storing summaries ---------------------------------------------------------------------
def edges(size: int, segments: int) -> np.ndarray:
    """Where segments start; each coarse segment is some fine ones together."""
    return np.unique(np.arange(segments) * size // segments)


def summaries(x: np.ndarray, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of segments, both times the root of the segment's length."""
    starts = edges(x.shape[1], segments)
    lengths = np.diff([*starts, x.shape[1]])
    means = np.add.reduceat(x, starts, axis=1) / lengths
    off = x - np.repeat(means, lengths, axis=1)
    return means * np.sqrt(lengths), np.sqrt(np.add.reduceat(off * off, starts, axis=1))


def prepared(vectors: DataFrame) -> DataFrame:
    """The rows that take part, with whole numbers and summaries of all levels."""
    vec_id, label = F.col("vec_id").cast("long"), F.col("label").cast("long")
    given = vectors.select(
        vec_id.alias("vec_id"),
        F.when(vec_id % SHIFTED == 0, (label + 1) % LABELS).otherwise(label).alias("label"),
        F.col("embedding").cast("array<double>").alias("e"),
    )
    finite = F.forall("e", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    usable = F.col("vec_id").isNotNull() & F.col("label").isNotNull() & (F.size("e") > 0) & finite
    whole = given.where(usable).select("vec_id", "label", F.transform("e", lambda c: F.floor(c * SCALE)).alias("x"))

    def summarize(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(3).offsets.to_numpy()
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False)
            sizes = np.diff(ends)
            out = [[b""] * batch.num_rows for _ in range(3)]
            for size in np.unique(sizes):
                places = np.flatnonzero(sizes == size)
                x = flat[(ends[places] - ends[0])[:, None] + np.arange(size)]
                levels = [summaries(x.astype(float), k) for k in LEVELS]
                parts = (x.astype("<i8"), *(np.concatenate([level[i] for level in levels], axis=1) for i in (0, 1)))
                for column, rows in zip(out, parts, strict=True):
                    for place, row in zip(places.tolist(), rows, strict=True):
                        column[place] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(k) for k in range(3)), pa.array(sizes, pa.int32()), *(pa.array(c, pa.binary()) for c in out)],
                ["row", "vec_id", "label", "size", "x", "means", "deviations"],
            )

    numbered = whole.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "x")
    return stored(numbered.mapInArrow(summarize, _STORED), "summaries")


# ---- blocks and tiles ------------------------------------------------------------------------
def _dealt(anchors: DataFrame, rows: DataFrame, spans: str) -> DataFrame:
    """Anchors and rows for each pair of a block and a tile; ``side`` tells them apart."""
    n, n_anchors = rows.count(), anchors.count()
    tiles = max(1, -(-n // TILE), min(TILES, -(-n // SMALL_TILE)))
    blocks = max(1, -(-n_anchors // BLOCK))
    place = lambda parts: F.pmod(F.xxhash64("row"), F.lit(parts)).cast("int")
    each = lambda parts: F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    columns = ["row", "vec_id", "label", "size", "x", "means", "deviations"]
    one = anchors.select(*columns, spans, F.lit(True).alias("side"), place(blocks).alias("block"), each(tiles).alias("tile"))
    no_spans = F.lit(None).cast(anchors.schema[spans].dataType).alias(spans)
    other = rows.select(*columns, no_spans, F.lit(False).alias("side"), each(blocks).alias("block"), place(tiles).alias("tile"))
    return one.unionByName(other).repartition(min(tiles * blocks, 20000), "size", "block", "tile").groupBy("size", "block", "tile")


class Side:
    """Vectors as matrices: whole numbers, and means and deviations by level."""

    def __init__(self, frame: pd.DataFrame, order: list[str]) -> None:
        frame = frame.sort_values(order)
        size = int(frame["size"].iloc[0])
        matrix = lambda name, kind: np.frombuffer(b"".join(frame[name]), kind).reshape(len(frame), -1)
        self.row, self.vec_id, self.label = (frame[c].to_numpy(np.int64) for c in ("row", "vec_id", "label"))
        self.x = matrix("x", "<i8")
        cuts = np.cumsum([len(edges(size, k)) for k in LEVELS])[:-1]
        self.means, self.deviations = (np.split(matrix(c, "<f8"), cuts, axis=1) for c in ("means", "deviations"))
        self.frame = frame

    def __len__(self) -> int:
        return len(self.row)


class Scores:
    """Bounds and exact scores between some anchors and rows of a task."""

    def __init__(self, anchors: Side, rows: Side) -> None:
        self.anchors, self.rows = anchors, rows
        longest = [float(np.sqrt((s.x.astype(float) ** 2).sum(axis=1)).max(initial=0.0)) for s in (anchors, rows)]
        self.room = ROOM * longest[0] * longest[1] + 0.5
        largest = longest[0] * longest[1] * 1.001
        if largest >= 2.0**63:
            raise OverflowError("a score exceeds the range of a long")
        # sums of whole numbers are exact in doubles as long as they stay below 2^53
        self.doubles = float(np.abs(anchors.x).max(initial=0)) * float(np.abs(rows.x).max(initial=0)) * anchors.x.shape[1] < 2.0**52
        self.x = [s.x.astype(float) if self.doubles else s.x for s in (anchors, rows)]

    def bounds(self, a: np.ndarray | slice, r: np.ndarray | slice, level: int) -> tuple[np.ndarray, np.ndarray]:
        centre = self.anchors.means[level][a] @ self.rows.means[level][r].T
        radius = self.anchors.deviations[level][a] @ self.rows.deviations[level][r].T
        radius += self.room
        return centre - radius, centre + radius

    def exact(self, a: slice, r: np.ndarray) -> np.ndarray:
        found = self.x[0][a] @ self.x[1][r].T
        return np.rint(found).astype(np.int64) if self.doubles else found


def _largest(values: np.ndarray, k: int) -> np.ndarray:
    """The k-th largest of each line; lower than anything where there are fewer."""
    if values.shape[1] < k:
        return np.full(len(values), -np.inf)
    return np.partition(values, values.shape[1] - k, axis=1)[:, values.shape[1] - k]


_NONE = np.iinfo(np.int64).min


def _take(scores: np.ndarray, wanted: np.ndarray, k: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Up to k times: lines and columns of each line's best wanted score, the first of equal ones."""
    key = np.where(wanted, scores, _NONE)
    lines = np.arange(len(key))
    for _ in range(min(k, key.shape[1])):
        best = key.argmax(axis=1)
        value = key[lines, best]
        there = wanted[lines, best] & (value > _NONE)
        if not there.any():
            return
        yield lines[there], best[there], value[there]
        key[lines, best] = _NONE


# ---- positives -----------------------------------------------------------------------------
def _positives(frame: pd.DataFrame) -> pd.DataFrame:
    """The best rows of the anchors' own labels in one tile."""
    out = [np.empty((0, 4), np.int64)]
    if frame["side"].any() and not frame["side"].all():
        order = ["label", "vec_id", "row"]
        anchors, rows = Side(frame[frame["side"]], order), Side(frame[~frame["side"]], order)
        scores = Scores(anchors, rows)
        for label in np.unique(anchors.label):
            first, last = (np.searchsorted(anchors.label, label, side) for side in ("left", "right"))
            low, high = (np.searchsorted(rows.label, label, side) for side in ("left", "right"))
            for a in range(first, last, ANCHORS):
                out += _best_positives(scores, slice(a, min(a + ANCHORS, last)), low, high)
    found = np.concatenate(out)
    return pd.DataFrame({"anchor": found[:, 0], "positive": found[:, 1], "positive_id": found[:, 2], "score": found[:, 3]})


def _best_positives(scores: Scores, a: slice, low: int, high: int) -> list[np.ndarray]:
    anchors, rows = scores.anchors, scores.rows
    out, top = [], np.full((a.stop - a.start, POSITIVES), -np.inf)
    for start in range(low, high, ROWS):
        r = np.arange(start, min(start + ROWS, high))
        itself = anchors.row[a][:, None] == rows.row[r][None, :]
        lower, upper = scores.bounds(a, r, 0)
        lower[itself], upper[itself] = -np.inf, -np.inf
        least = np.maximum(_largest(lower, POSITIVES), top[:, -1])
        for level in range(1, len(LEVELS) + 1):
            keep = ~itself & (upper >= least[:, None])
            some = keep.any(axis=0)
            r, itself, keep = r[some], itself[:, some], keep[:, some]
            if level == len(LEVELS) or not len(r):
                break
            lower, upper = scores.bounds(a, r, level)
            lower[~keep], upper[~keep] = -np.inf, -np.inf
            least = np.maximum(least, _largest(lower, POSITIVES))
        if not len(r):
            continue
        for lines, columns, value in _take(scores.exact(a, r), keep, POSITIVES):
            out.append(np.column_stack([anchors.row[a][lines], rows.row[r[columns]], rows.vec_id[r[columns]], value]))
            worst = top[lines].min(axis=1)
            top[lines, top[lines].argmin(axis=1)] = np.maximum(worst, value)
        top = -np.sort(-top, axis=1)
    return out


# ---- negatives -----------------------------------------------------------------------------
def _negatives(frame: pd.DataFrame) -> pd.DataFrame:
    """For each anchor and positive the best fitting rows of other labels in one tile."""
    out = [np.empty((0, 5), np.int64)]
    if frame["side"].any() and not frame["side"].all():
        order = ["vec_id", "row"]
        anchors, rows = Side(frame[frame["side"]], order), Side(frame[~frame["side"]], order)
        scores = Scores(anchors, rows)
        low, high = (np.full((len(anchors), POSITIVES), end, np.int64) for end in (-(_NONE + 1), _NONE))
        for i, given in enumerate(anchors.frame["positives"]):
            for j, score in enumerate(given):
                low[i, j], high[i, j] = -(-LEAST * int(score) // 100), MOST * int(score) // 100
        for a in range(0, len(anchors), ANCHORS):
            out += _best_negatives(scores, slice(a, min(a + ANCHORS, len(anchors))), low, high)
    found = np.concatenate(out)
    return pd.DataFrame({"anchor": found[:, 0], "place": found[:, 1], "negative": found[:, 2], "negative_id": found[:, 3], "score": found[:, 4]})


def _best_negatives(scores: Scores, a: slice, low: np.ndarray, high: np.ndarray) -> list[np.ndarray]:
    anchors, rows = scores.anchors, scores.rows
    low, high = low[a], high[a]
    out, top = [], np.full((*low.shape, NEGATIVES), -np.inf)
    for start in range(0, len(rows), ROWS):
        r = np.arange(start, min(start + ROWS, len(rows)))
        for level in range(len(LEVELS) + 1):
            keep = anchors.label[a][:, None] != rows.label[r][None, :]
            if level:
                keep &= may
            if level < len(LEVELS):
                lower, upper = scores.bounds(a, r, level)
                may = np.zeros_like(keep)
                for j in range(low.shape[1]):  # the third best so far raises the lower end of a span
                    may |= (upper >= np.maximum(low[:, j], top[:, j, -1])[:, None]) & (lower <= high[:, j, None])
                may &= keep
                some = may.any(axis=0)
                r, may = r[some], may[:, some]
                if not len(r):
                    break
        if not len(r):
            continue
        exact = scores.exact(a, r)
        for j in range(low.shape[1]):
            fits = keep & (exact >= low[:, j, None]) & (exact <= high[:, j, None])
            for lines, columns, value in _take(exact, fits, NEGATIVES):
                out.append(np.column_stack([anchors.row[a][lines], np.full(len(lines), j), rows.row[r[columns]], rows.vec_id[r[columns]], value]))
                kept = top[lines, j]
                kept[np.arange(len(lines)), kept.argmin(axis=1)] = np.maximum(kept.min(axis=1), value)
                top[lines, j] = kept
        top = -np.sort(-top, axis=2)
    return out


# ---- the operator ----------------------------------------------------------------------------
def _first(found: DataFrame, by: list[str], name: str, row: str, k: int) -> DataFrame:
    """The k best of each group, numbered from 1."""
    best = Window.partitionBy(*by).orderBy(F.desc("score"), name, row)
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)


def mined(vectors: DataFrame) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)."""
    rows = prepared(vectors)
    anchors = rows.where(F.col("vec_id") % EVERY == 0).withColumn("positives", F.array().cast("array<long>"))
    found = _dealt(anchors, rows, "positives").applyInPandas(_positives, "anchor long, positive long, positive_id long, score long")
    positives = stored(_first(found, ["anchor"], "positive_id", "positive", POSITIVES), "positives")
    # at most five scores for each anchor, in order
    spans = positives.groupBy("anchor").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "score"))), lambda p: p["score"]).alias("positives"))
    asking = stored(anchors.drop("positives").join(spans, F.col("row") == F.col("anchor")).drop("anchor"), "anchors")
    found = _dealt(asking, rows, "positives").applyInPandas(_negatives, "anchor long, place int, negative long, negative_id long, score long")
    negatives = _first(found, ["anchor", "place"], "negative_id", "negative", NEGATIVES)
    pairs = positives.select("anchor", (F.col("rank") - 1).alias("place"), "positive_id", F.col("score").alias("positive_score"))
    out = negatives.join(pairs, ["anchor", "place"]).join(anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id")), "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", F.col("score").alias("negative_score"))


SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda c: floor(256 * c::DOUBLE)) AS x
  FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), scored AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, list_dot_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.x) = len(b.x) WHERE a.vec_id % 50 = 0
), positive AS (
  SELECT anchor_id, other AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other)::INTEGER AS rank,
  other AS negative_id, positive_score, score AS negative_score
FROM positive JOIN scored USING (anchor_id)
WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY rank <= 3
"""
