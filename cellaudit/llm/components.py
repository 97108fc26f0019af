"""Connected components of a graph given by its edges, as joins and minima.

Large-star and small-star steps take turns: each node's larger neighbours, then its
smaller ones, are tied to the smallest node that it knows.  Every step aggregates with
partial minima before the shuffle and joins on a node, which adaptive execution splits
where one node has very many neighbours.  Before the first step each partition replaces
its own edges by a forest.  Each round is written to the shared folder.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import stored


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every node of the edges but the smallest of its component, and that smallest node."""
    nodes, places = np.unique(np.concatenate([a, b]), return_inverse=True)
    left, right = places[: len(a)], places[len(a) :]
    root = np.arange(len(nodes))
    while True:
        x, y = root[left], root[right]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    other = root != np.arange(len(nodes))
    return nodes[other], nodes[root[other]]


def _local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    u, v = np.empty(0, np.int64), np.empty(0, np.int64)
    for batch in batches:
        u = np.concatenate([u, batch.column(0).to_numpy(zero_copy_only=False)])
        v = np.concatenate([v, batch.column(1).to_numpy(zero_copy_only=False)])
        if len(u) > 1 << 20:
            u, v = forest(u, v)
            if len(u) > 1 << 19:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = u[:0], v[:0]
    u, v = forest(u, v)
    yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component): for each node of an edge the smallest node that it reaches.

    ``edges`` has two columns of longs; loops, repeated edges and either direction are
    allowed, nulls are left out.  The smallest node itself is a row too.
    """
    a, b = edges.columns
    df = edges.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).where(F.col("u") != F.col("v"))
    df, seen = stored(df.mapInArrow(_local, "u long, v long"), "edges"), None
    while True:
        state = df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == seen or not state[0]:
            break
        seen = tuple(state)
        df = stored(_small_star(_large_star(df)), "edges")
    labels = df.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return labels.unionByName(df.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _large_star(df: DataFrame) -> DataFrame:
    both = df.unionByName(df.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small_star(df: DataFrame) -> DataFrame:
    down = df.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    tied = down.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return tied.unionByName(least.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
