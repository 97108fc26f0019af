"""Near copies among vectors: every pair of cosine 0.9 or more, by tiles in PCA order.

Unit vectors are turned so that their leading dimensions vary most; the turn is fitted on
a bounded sample (``FITTED`` rows) and, being a rotation, changes no cosine.  Rows are
dealt into cells by splits of the leading dimensions, widest first, and cells into tiles
of bounded size.  Two tiles meet in one task if their boxes, over all leading dimensions
together, are close enough for any pair to reach the threshold.  There, products of the
leading dimensions come first; a pair is given up as soon as that sum and the product of
both suffix norms stay below the threshold, the rest gets further dimensions.

Turning and bounds only rule pairs out, or in where a cosine is clear of the threshold by
``ROOM``.  What lies closer is decided by the vectors as they were given: their product,
summed without rounding, over the root of their squares.

Tasks hand on, for each vector, its number of links and one edge to a linked vector that
it reaches in the task, never all pairs, so that large groups stay small.  Equal vectors
(up to a power of two) are one class beforehand, known by a digest.  All rows are
compared; work grows with the square of the number of different vectors that lie within
reach in the leading dimensions.

Defined results: vectors that are null, empty, zero or hold null or non-finite parts,
and vectors of different length, are linked with nothing; a repeated row is a further
vector of the same id, whatever its vector; an empty table gives no rows; further columns
are not looked at.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .tables import stored

SIMILARITY = 0.9
FITTED = 8192
#: Rows of a tile: at least (where there are as many) and at most; between, tables are cut into ``TILES``.
TILE, LARGEST, TILES = 4096, 65536, 8
#: Rows and others that are bounded at once.
ROWS, OTHERS = 512, 4096
LEADING = (8, 16, 32)
#: Dimensions over which cells are split and boxes kept.
BOXED = 16
#: Room for rounding: cosines within it of the threshold are decided by the given vectors.
ROOM = 1e-9
#: Share of pairs in a block below which what is left is looked at pair by pair.
FEW = 0.02


def classed(vectors: DataFrame) -> DataFrame:
    """(vec_id, size, digest, vector): vectors times a power of two, as bytes of doubles; null where there is none."""

    def scale(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for values in batch.column(1):
                x = np.array([np.nan if v is None else v for v in values.as_py()] if values.is_valid else [], float)
                top = np.abs(x).max() if len(x) and np.isfinite(x).all() else 0.0
                if top:
                    x = np.ldexp(x, -int(np.frexp(top)[1])) + 0.0  # exact, and far from overflow
                out.append((len(x), hashlib.blake2b(x.tobytes(), digest_size=16).digest(), x.tobytes()) if top else (None, None, None))
            kinds = (pa.int32(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds))], ["vec_id", "size", "digest", "vector"]
            )

    rows = vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(scale, "vec_id long, size int, digest binary, vector binary")


def rotation(sample: np.ndarray) -> np.ndarray:
    """Columns: directions of falling variance."""
    return np.linalg.eigh(sample.T @ sample)[1][:, ::-1].copy()


def _matrix(parts: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(parts), float).reshape(len(parts), -1)


def _units(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _reach(similarity: float) -> float:
    """How far unit vectors of this cosine can lie apart."""
    return float(np.sqrt(max(2 - 2 * similarity, 0.0))) + ROOM


def cosine(x: np.ndarray, y: np.ndarray) -> float:
    """In double precision: sums are rounded once."""
    x, y = x.tolist(), y.tolist()
    squares = math.fsum(a * a for a in x) * math.fsum(b * b for b in y)
    return math.fsum(a * b for a, b in zip(x, y, strict=True)) / math.sqrt(squares)


# ---- cells ------------------------------------------------------------------------------
def splits(sample: np.ndarray, parts: int) -> list[tuple[int, float]]:
    """Cuts of a tree of cells: the k-th node's dimension and place; its children are 2k+1 and 2k+2.

    Every node cuts the dimension, of the leading ones, in which its sample varies most.
    """
    depth = max(0, math.ceil(math.log2(max(parts, 1))))
    found, members = [], [np.arange(len(sample))]
    for _ in range(depth):
        following = []
        for rows in members:
            lead = sample[rows, :BOXED]
            axis = int(lead.var(axis=0).argmax()) if len(rows) else 0
            cut = float(np.median(lead[:, axis])) if len(rows) else 0.0
            found.append((axis, cut))
            above = lead[:, axis] > cut
            following += [rows[~above], rows[above]]
        members = following
    return found


def cells(x: np.ndarray, cuts: list[tuple[int, float]]) -> np.ndarray:
    """Each row's cell."""
    node = np.zeros(len(x), np.int64)
    if cuts:
        axes, places = np.array([a for a, _ in cuts]), np.array([c for _, c in cuts])
        for _ in range((len(cuts) + 1).bit_length() - 1):
            node = 2 * node + 1 + (x[np.arange(len(x)), axes[node]] > places[node])
    return node - len(cuts)


# ---- pairs within a task ------------------------------------------------------------------
class Tile:
    """Vectors in order of their first turned coordinate."""

    def __init__(self, frame: pd.DataFrame, turn: np.ndarray | None) -> None:
        given = _matrix(frame["vector"]) if len(frame) else np.empty((0, 1 if turn is None else len(turn)))
        x = _units(given)
        x = x if turn is None else x @ turn
        order = np.argsort(x[:, 0], kind="stable")
        self.given, self.x = given[order], x[order]
        self.node, self.n = frame["node"].to_numpy(np.int64)[order], frame["n"].to_numpy(np.int64)[order]
        self.suffix = [np.sqrt((self.x[:, m:] ** 2).sum(axis=1)) for m in LEADING]

    def __len__(self) -> int:
        return len(self.node)


def links(a: Tile, b: Tile, same: bool, similarity: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places (in a, in b) of all pairs that are similar enough, some rows at a time.

    ``same``: a is b, and only pairs of a place with a later one are wanted.
    """
    reach = _reach(similarity)
    for i in range(0, len(a), ROWS):
        rows = slice(i, min(i + ROWS, len(a)))
        low, high = np.searchsorted(b.x[:, 0], a.x[i, 0] - reach), np.searchsorted(b.x[:, 0], a.x[rows.stop - 1, 0] + reach, side="right")
        low = max(low, i) if same else low
        for j in range(low, high, OTHERS):
            x, y = _block(a, b, rows, slice(j, min(j + OTHERS, high)), same, similarity)
            if len(x):
                yield x, y


def _block(a: Tile, b: Tile, rows: slice, others: slice, same: bool, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    width, done = a.x.shape[1], 0
    total = np.zeros((rows.stop - rows.start, others.stop - others.start))
    left = np.arange(rows.start, rows.stop)[:, None] < np.arange(others.start, others.stop)[None, :] if same else np.ones(total.shape, bool)
    pairs = None
    for k, upto in enumerate([*(m for m in LEADING if m < width), width]):
        last = upto == width
        least = similarity - ROOM
        if pairs is None:
            total += a.x[rows, done:upto] @ b.x[others, done:upto].T
            rest = 0.0 if last else a.suffix[k][rows, None] * b.suffix[k][None, others]
            left &= total + rest >= least
            if last or np.count_nonzero(left) <= FEW * left.size:
                x, y = np.nonzero(left)
                pairs, total = (x + rows.start, y + others.start), total[x, y]
        else:
            x, y = pairs
            total = total + np.einsum("ij,ij->i", a.x[x, done:upto], b.x[y, done:upto])
            rest = 0.0 if last else a.suffix[k][x] * b.suffix[k][y]
            keep = total + rest >= least
            pairs, total = (x[keep], y[keep]), total[keep]
        done = upto
        if pairs is not None and not len(pairs[0]):
            break
    x, y = pairs
    near = np.flatnonzero(total < similarity + ROOM)
    keep = np.ones(len(x), bool)
    keep[near] = [cosine(a.given[x[p]], b.given[y[p]]) >= similarity for p in near]
    return x[keep], y[keep]


def _task(frame: pd.DataFrame, similarity: float, turns: dict[int, np.ndarray]) -> pd.DataFrame:
    """The links between two tiles, or within one."""
    same = frame["i"].iloc[0] == frame["j"].iloc[0]
    turn = turns.get(int(frame["size"].iloc[0]))
    a = Tile(frame if same else frame[frame["left"]], turn)
    b = a if same else Tile(frame[~frame["left"]], turn)
    links_a, links_b = np.zeros(len(a), np.int64), np.zeros(len(b), np.int64)
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    if len(a) and len(b):
        for x, y in links(a, b, same, similarity):
            np.add.at(links_a, x, b.n[y])
            np.add.at(links_b, y, a.n[x])
            u, v = forest(np.concatenate([u, a.node[x]]), np.concatenate([v, b.node[y]]))
    nodes, counts = (a.node, links_a + links_b) if same else (np.concatenate([a.node, b.node]), np.concatenate([links_a, links_b]))
    nodes, counts = nodes[counts > 0], counts[counts > 0]
    tied = pd.Series(v, index=u)
    return pd.DataFrame({"node": nodes, "links": counts, "other": tied.reindex(nodes).fillna(pd.Series(nodes, index=nodes)).astype("int64").to_numpy()})


# ---- the operator --------------------------------------------------------------------------
def linked(vectors: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """One row per vector: vec_id, n_links, component_id, kept."""
    rows = stored(classed(vectors), "vectors")
    classes = rows.where("digest IS NOT NULL").groupBy("digest", "size", "vector").agg(F.min("vec_id").alias("leader"), F.count("*").alias("n"))
    classes = stored(classes.withColumn("node", F.monotonically_increasing_id()), "classes")
    found = stored(_compared(classes.select("node", "size", "n", "vector"), similarity), "links")
    groups = components(found.where("node <> other").select("node", "other")).withColumnRenamed("node", "member")
    counts = found.groupBy("node").agg(F.sum("links").alias("links")).withColumnRenamed("node", "counted")
    known = classes.select("digest", "node", "leader", "n").join(counts, F.col("node") == F.col("counted"), "left")
    known = known.join(groups, F.col("node") == F.col("member"), "left").withColumn("group", F.coalesce("component", "node"))
    least = known.groupBy("group").agg(F.min("leader").alias("component_id"))
    n_links = F.coalesce("links", F.lit(0).cast("long")) + F.col("n") - 1
    decided = known.join(least, "group").select("digest", n_links.alias("n_links"), "component_id")
    out = rows.select("vec_id", "digest").join(decided, "digest", "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        component.alias("component_id"),
        F.coalesce(component == F.col("vec_id"), F.lit(True)).alias("kept"),
    )


def _gap(dimension: int) -> Column:
    """How far two boxes lie apart in one dimension; 0 where one of them doesn't have it."""
    low, high = (lambda t: F.col(f"{t}.low{dimension}")), (lambda t: F.col(f"{t}.high{dimension}"))
    return F.coalesce(F.greatest(low("a") - high("b"), low("b") - high("a"), F.lit(0.0)), F.lit(0.0))


def _compared(classes: DataFrame, similarity: float) -> DataFrame:
    """(node, links, other): links of each vector by task, and a vector that it is tied to there."""
    total = classes.count()
    share = F.lit(int((1 << 52) * min(1.0, FITTED / max(total, 1))))
    sample = classes.where(F.xxhash64("node").bitwiseAND(F.lit((1 << 52) - 1)) <= share).select("size", "node", "vector").toPandas().sort_values("node")
    most = min(max(TILE, -(-total // TILES)), LARGEST)
    units = {int(size): _units(_matrix(part["vector"])) for size, part in sample.groupby("size")}
    turns = {size: rotation(x) for size, x in units.items()}
    cuts = {size: splits(x @ turns[size], -(-total * len(x) // (max(len(sample), 1) * most))) for size, x in units.items()}

    def placed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for size, part in frame.groupby("size"):
                x = _units(_matrix(part["vector"])) @ turns.get(int(size), np.eye(int(size)))
                cell = cells(x, cuts.get(int(size), []))
                yield part.assign(cell=cell.astype("int32"), lead=list(x[:, :BOXED]))

    dealt = stored(classes.mapInPandas(placed, "node long, size int, n long, vector binary, cell int, lead array<double>"), "placed")
    sides = [
        f(F.get("lead", F.lit(k))).alias(f"{name}{k}") for k in range(BOXED) for f, name in ((F.min, "low"), (F.max, "high"))
    ]
    boxes = dealt.groupBy("size", "cell").agg(F.count("*").alias("rows"), *sides)
    parts = F.expr(f"int(ceil(rows / {most}))")
    tiles = boxes.withColumn("parts", parts).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tiles = stored(tiles.withColumn("tile", F.struct("cell", "part")), "tiles")
    # all tiles of one size meet: one side is spread over some salts, the other goes to each
    salts = min(64, max(1, tiles.count()))
    one = tiles.withColumn("salt", F.pmod(F.xxhash64("cell", "part"), F.lit(salts)).cast("int")).alias("a")
    two = tiles.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).alias("b")
    apart = sum((_gap(k) * _gap(k) for k in range(BOXED)), F.lit(0.0))
    near = (F.col("a.size") == F.col("b.size")) & (F.col("a.salt") == F.col("b.salt")) & (apart <= _reach(similarity) ** 2)
    meets = one.join(two, near).select(
        F.col("a.size").alias("size"), F.col("a.cell").alias("cell"), F.col("a.part").alias("part"),
        F.least("a.tile", "b.tile").alias("i"), F.greatest("a.tile", "b.tile").alias("j"), (F.col("a.tile") <= F.col("b.tile")).alias("left"),
    )
    meets = stored(meets, "meets")
    split = dealt.join(boxes.select("size", "cell", parts.alias("parts")), ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    sent = split.join(meets, ["size", "cell", "part"]).select("size", "i", "j", "left", "node", "n", "vector")
    tasks = max(1, min(meets.count(), 20000))
    return sent.repartition(tasks, "size", "i", "j").groupBy("size", "i", "j").applyInPandas(lambda frame: _task(frame, similarity, turns), "node long, links long, other long")


SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
  WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), near AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9
), reach(a, b) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, near.b FROM reach JOIN near ON reach.b = near.a
), least AS (
  SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a
)
SELECT e.vec_id, (SELECT count(*) FROM near WHERE near.a = e.vec_id) AS n_links, component_id, e.vec_id = component_id AS kept
FROM embeddings e JOIN least USING (vec_id)
"""
