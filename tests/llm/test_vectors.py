"""Whitening against a full decomposition, hard negatives against all pairs."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellaudit.llm import hard_negatives, whitening
from cellaudit.llm.tables import table
from workload.check import compare

NAN, INF = float("nan"), float("inf")


def vectors(spark, rows, schema="vec_id long, embedding array<float>, label int"):
    return spark.createDataFrame(rows, schema)


# ---- whitening ----
@pytest.mark.parametrize("size, rank", [(1, 1), (2, 2), (3, 3), (5, 2), (30, 30), (64, 64), (150, 150), (150, 40)])
def test_pairs_of_a_matrix(size, rank):
    rng = np.random.default_rng(size + rank)
    x = rng.standard_normal((400, rank)) @ rng.standard_normal((rank, size))
    matrix = x.T @ x
    found = whitening.jacobi_davidson(lambda b: matrix @ b, size, 4)
    values, directions = np.linalg.eigh(matrix)
    k = min(4, size)
    assert np.allclose(found.values, values[::-1][:k], rtol=1e-12, atol=1e-12 * values[-1])
    assert np.allclose(found.vectors.T @ found.vectors, np.eye(k), atol=1e-13)
    assert (found.residuals <= 1e-13 * values[-1]).all()
    for i in range(min(k, rank)):
        assert abs(abs(found.vectors[:, i] @ directions[:, -1 - i]) - 1) < 1e-12


def test_pairs_of_odd_spectra():
    rng = np.random.default_rng(8)
    turn = np.linalg.qr(rng.standard_normal((60, 60)))[0]
    for spectrum in (np.ones(60), np.r_[5.0, 5.0, 5.0, np.ones(57)], np.r_[1e9, 1.0, np.full(58, 0.5)], np.zeros(60), 1 + 1e-3 * np.arange(60.0)[::-1]):
        matrix = (turn * spectrum) @ turn.T
        found = whitening.jacobi_davidson(lambda b, m=matrix: m @ b, 60, 4)
        assert np.allclose(found.values, spectrum[:4], rtol=1e-11, atol=1e-11 * max(spectrum[0], 1e-300))


def test_minres_solves():
    rng = np.random.default_rng(9)
    a = rng.standard_normal((20, 20))
    a = a + a.T
    right = np.column_stack([rng.standard_normal((20, 3)), np.zeros(20)])
    solved = whitening.minres(lambda b: a @ b, right, 60, 1e-12)
    assert np.allclose(a @ solved, right, atol=1e-8)


def plain(rows):
    """What the rows should be, by a full decomposition; whitened up to sign."""
    kept = [(i, e) for i, e, *_ in rows if e and all(c is not None and math.isfinite(c) for c in e)]
    size = max({len(e) for _, e in kept}, key=lambda s: (sum(len(e) == s for _, e in kept), s))
    kept = [(i, [math.floor(256 * float(np.float32(c))) for c in e]) for i, e in kept if len(e) == size]
    fit = sorted({tuple(x) for _, x in kept})
    n, sums = len(fit), [sum(c) for c in zip(*fit, strict=True)]
    x = np.array(fit, float)
    x -= np.array(sums) / n
    values, directions = np.linalg.eigh(x.T @ x / n)
    return kept, n, sums, values[::-1], directions[:, ::-1]


def checked(found, rows):
    kept, n, sums, values, directions = plain(rows)
    k = min(4, int((values > 1e-9 * max(values[0], 1e-300)).sum()))
    assert len(found) == k * len(kept)
    by_id = {}
    for r in found:
        assert r["n"] == n and r["identity_error"] < 1e-10
        assert r["explained"] == pytest.approx(values[r["component"] - 1] / values.sum(), rel=1e-10)
        by_id.setdefault((r["vec_id"], r["component"]), []).append(r)
    for c in range(k):
        given = {}
        for i, x in kept:
            white = (np.array(x) - np.array(sums) / n) @ directions[:, c] / math.sqrt(values[c])
            given.setdefault(i, []).append((sum((n * v - s) ** 2 for v, s in zip(x, sums, strict=True)), white))
        signs = set()
        for i, pairs in given.items():
            got = sorted((r["deviation"], r["whitened"]) for r in by_id[i, c + 1])
            assert [d for d, _ in got] == sorted(d for d, _ in pairs)
            if len(pairs) == 1 and abs(pairs[0][1]) > 1e-6:
                assert abs(got[0][1]) == pytest.approx(abs(pairs[0][1]), rel=1e-7)
                signs.add(np.sign(got[0][1]) == np.sign(pairs[0][1]))
        assert len(signs) <= 1


def test_whitened_table(spark, sf_dir):
    given = table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], r["embedding"]) for r in given.collect()]
    checked(whitening.whitened(given).collect(), rows)


def test_whitened_oddities(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.standard_normal(5).tolist(), 1) for i in range(40)]
    rows += [(3, rows[3][1], 1), (3, rows[4][1], None), (None, rows[5][1], 2), (50, None, 1), (51, [], 1), (52, [1.0, None, 0.0, 0.0, 0.0], 1)]
    rows += [(53, [NAN, 0.0, 0.0, 0.0, 0.0], 1), (54, [INF] * 5, 1), (55, [1.0, 2.0], 1), (56, [-0.0] * 5, 1)]
    given = vectors(spark, rows).withColumns({"x": F.lit("x"), "N": F.lit(1), "component": F.lit("c")}).repartition(7)
    found = whitening.whitened(given).collect()
    checked(found, rows)
    assert {r["component"] for r in found if r["vec_id"] is None} == {1, 2, 3, 4}


def test_whitened_without_directions(spark):
    schema = whitening.whitened(vectors(spark, [])).dtypes
    assert whitening.whitened(vectors(spark, [])).collect() == []
    assert [c for c, _ in schema] == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    one = whitening.whitened(vectors(spark, [(1, [1.0, 2.0], 0), (2, [1.0, 2.0], 0)]))
    assert one.collect() == [] and one.dtypes == schema
    line = [(i, [float(i), 2.0 * i, 0.0], 0) for i in range(6)]
    found = whitening.whitened(vectors(spark, line)).collect()
    assert {r["component"] for r in found} == {1} and len(found) == 6


def test_deviation_beyond_a_long_is_null():
    x = np.array([[2**40, 1], [3, 4]])
    exact = [sum((2 * int(v) - s) ** 2 for v, s in zip(row, [2**40 + 3, 5], strict=True)) for row in x]
    assert whitening._deviations(x, 2, [2**40 + 3, 5]) == [v if v < 2**63 else None for v in exact]
    assert whitening._deviations(x[1:], 2, [6, 8]) == [0]


# ---- hard negatives ----
def all_pairs(rows):
    """The operator's rows by scoring every anchor with every row."""
    kept = []
    for vec_id, e, label in rows:
        if vec_id is not None and label is not None and e and all(c is not None and math.isfinite(c) for c in e):
            kept.append((vec_id, (label + 1) % 10 if vec_id % 7 == 0 else label, [math.floor(256 * float(np.float32(c))) for c in e]))
    out = []
    for k, (anchor, label, x) in enumerate(kept):
        if anchor % 50:
            continue
        scored = [(-sum(a * b for a, b in zip(x, y, strict=True)), i, other) for j, (i, other, y) in enumerate(kept) if j != k and len(x) == len(y)]
        scored.sort()
        for negative, positive_id, _ in [s for s in scored if s[2] == label][:5]:
            p = -negative
            fitting = [(i, -s) for s, i, other in scored if other != label and 50 * p <= -100 * s <= 95 * p]
            out += [(anchor, positive_id, r, i, p, s) for r, (i, s) in enumerate(fitting[:3], 1)]
    return sorted(out)


def mined(df):
    return sorted(tuple(r) for r in hard_negatives.mined(df).collect())


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for size in (1, 3, 4, 7, 16, 64, 100):
        x, y = (np.floor(256 * (rng.standard_normal((30, size)) + shift)) for shift in (0.5, -0.3))
        exact = x @ y.T
        before = np.full_like(exact, np.inf)
        for segments in hard_negatives.LEVELS:
            (mx, dx), (my, dy) = hard_negatives.summaries(x, segments), hard_negatives.summaries(y, segments)
            centre, radius = mx @ my.T, dx @ dy.T
            assert (np.abs(exact - centre) <= radius + 1e-6).all()
            assert (radius <= before + 1e-6).all()
            before = radius


def test_mined_table(spark, sf_dir, connection):
    given = table(spark, sf_dir, "embeddings")
    rows = [(r["vec_id"], r["embedding"], r["label"]) for r in given.collect()]
    assert mined(given) == all_pairs(rows)
    assert compare(hard_negatives.mined(given), connection, hard_negatives.SQL) == ""


@pytest.mark.parametrize("sizes", [(4096, 2048, 24), (2, 16, 24)])
def test_mined_in_blocks_and_tiles(spark, monkeypatch, sizes):
    """Groups around centres, so that bounds rule rows out, in one or many blocks and tiles."""
    for name, value in zip(("BLOCK", "SMALL_TILE", "TILES"), sizes, strict=True):
        monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((8, 20)) + 1
    rows = [(int(i), (centres[i % 8] + 0.2 * rng.standard_normal(20)).tolist(), int(i % 3)) for i in range(300)]
    rows += [(50 * k, rows[k][1], 2) for k in range(7, 12)]
    assert mined(vectors(spark, rows).repartition(3)) == all_pairs(rows)


def test_few_rows_are_bounded_exactly():
    """What the bounds keep is less than everything where vectors have structure."""
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((50, 16)), 4, axis=1) * 100
    (m, d) = hard_negatives.summaries(np.floor(x), 16)
    assert np.allclose(m @ m.T, np.floor(x) @ np.floor(x).T) and np.allclose(d, 0)


def test_mined_oddities(spark):
    same = [1.0, 0.5, -0.5]
    rows = [(i, same, i % 2) for i in range(0, 120, 5)]  # ties everywhere
    rows += [(50, same, 0), (50, [0.6, 0.3, 0.1], 0), (100, [0.7, 0.4, -0.2], 1), (3, [0.8, 0.3, -0.4], 1), (4, [0.7, 0.5, -0.4], 2)]
    rows += [(200, [1.0, 2.0], 1), (201, [1.0, 2.0], 1), (202, [0.7, 1.3], 2), (250, None, 1), (300, [NAN, 1.0, 1.0], 1), (350, [], 1)]
    rows += [(400, same, None), (None, same, 1), (450, [None, 1.0, 1.0], 1), (500, [-1.0, -0.5, 0.5], 7), (501, [-0.9, -0.5, 0.5], 7), (550, [0.0] * 3, 8), (551, [0.0] * 3, 8)]
    given = vectors(spark, rows).withColumns({"row": F.lit("r"), "X": F.lit(1), "side": F.lit(1), "block": F.lit(1), "means": F.lit(1)}).repartition(6)
    assert mined(given) == all_pairs(rows)


def test_mined_from_nothing(spark):
    empty = hard_negatives.mined(vectors(spark, []))
    assert empty.collect() == []
    assert empty.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    assert mined(vectors(spark, [(1, [1.0], 1), (2, [1.0], 1)])) == []
    assert mined(vectors(spark, [(50, [1.0], 1)])) == []
