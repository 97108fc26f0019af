"""Vectors, components and hosts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellaudit.llm import components, embedding_dedup, url_rank
from cellaudit.llm.queries import ORACLES, QUERIES
from workload.check import compare

from . import brute


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, sf_dir, connection, name):
    assert compare(QUERIES[name](spark, sf_dir), connection, ORACLES[name]) == ""


def test_components(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(400), rng.randrange(400)) for _ in range(260)] + [(7, k) for k in range(1000, 1200)] + [(k, k + 1) for k in range(2000, 2060)]
    pairs += [(3, 3), *pairs[:5], (None, 4)]
    found = {r.node: r.component for r in components.components(spark.createDataFrame(pairs, "x long, y long").repartition(5)).collect()}
    solid = [p for p in pairs if p[0] is not None and p[0] != p[1]]
    assert found == brute.groups(solid, {n for p in solid for n in p})
    assert components.components(spark.createDataFrame([], "x long, y long")).count() == 0


def test_vectors_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "TILE", 40)
    monkeypatch.setattr(embedding_dedup, "FITTED", 60)
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 24))
    x = np.concatenate([centres[rng.integers(0, 12, 150)] + rng.normal(size=(150, 24)) * rng.uniform(0, 0.5, (150, 1)), rng.normal(size=(40, 24)), rng.normal(size=(20, 5))[:, :5].repeat(1, 0) @ np.eye(5, 24)])
    x = np.concatenate([x, np.repeat(x[:1], 70, axis=0), 3 * x[:10]])
    rows = [(int(i) + 1, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, []), (902, [0.0] * 24), (903, [float("nan")] + [1.0] * 23), (904, [None] + [1.0] * 23), (905, [1.0, 2.0]), (906, [2.0, 4.0]), (907, [1e-200] * 24), (908, [1e300] * 24)]
    found = {r.vec_id: r for r in embedding_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)).collect()}
    assert len(found) == len(rows)
    good = {i: np.array(v, float) / np.max(np.abs(v)) for i, v in rows if v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    good = {i: v / np.linalg.norm(v) for i, v in good.items()}
    assert embedding_dedup.TILE < len(good) / 4  # some tiles
    pairs = [(a, b) for a in good for b in good if a < b and len(good[a]) == len(good[b]) and good[a] @ good[b] >= 0.9]
    group = brute.groups(pairs, [i for i, _ in rows])
    for i, _ in rows:
        links = sum(i in p for p in pairs)
        assert (found[i].n_links, found[i].component_id, found[i].kept) == (links, group[i], group[i] == i)


def test_cosines_of_exactly_the_threshold(spark):
    """90 / (10 * 10): the turned vectors would miss half of these pairs."""
    rng = np.random.default_rng(6)
    rows = []
    for k in range(150):
        places, signs, scale = rng.permutation(12)[:4], rng.choice([-1.0, 1.0], 4), float(rng.integers(1, 1000))
        a, b = np.zeros(12), np.zeros(12)
        a[places[0]], b[places] = 10 * signs[0], signs * [9, 3, 3, 1]
        rows += [(2 * k, (a * scale).tolist()), (2 * k + 1, (b * scale).tolist())]
    found = {r.vec_id: r for r in embedding_dedup.linked(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()}
    exact = {i: [j for j, w in rows if j != i and 100 * np.dot(v, w) ** 2 >= 81 * np.dot(v, v) * np.dot(w, w) and np.dot(v, w) > 0] for i, v in rows}
    assert all(exact.values()) and {i: r.n_links for i, r in found.items()} == {i: len(x) for i, x in exact.items()}
    just_below = [(0, [10.0, 0.0, 0.0, 0.0]), (1, [9.0, 3.0, 3.0, 1.0 + 1e-13])]
    assert {r.n_links for r in embedding_dedup.linked(spark.createDataFrame(just_below, "vec_id long, embedding array<double>")).collect()} == {0}


def test_one_id_on_two_vectors(spark):
    rows = [(1, [1.0, 0.0, 0.0]), (1, [0.0, 1.0, 0.0]), (3, [0.01, 1.0, 0.0]), (4, [0.0, 0.0, 1.0]), (4, [0.0, 0.0, 1.0]), (None, [0.0, 0.1, 1.0]), (None, None)]
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], "vec_id long, embedding array<double>, digest int, VECTOR string")
    found = sorted((tuple(r) for r in embedding_dedup.linked(given).collect()), key=str)
    assert found == sorted([(1, 0, 1, True), (1, 1, 1, True), (3, 1, 1, False), (4, 2, 4, True), (4, 2, 4, True), (None, 2, 4, True), (None, 0, None, True)], key=str)


def test_cells_hold_every_row_once():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(1000, 20)) * np.linspace(3, 0.1, 20)
    for parts in (1, 2, 3, 8, 20):
        cuts = embedding_dedup.splits(x, parts)
        found = embedding_dedup.cells(x, cuts)
        count = 2 ** int(np.ceil(np.log2(parts)))
        assert len(cuts) == count - 1 and set(found) == set(range(count)) and np.bincount(found).max() <= 1000 / count + 2
    assert len(embedding_dedup.cells(x[:0], embedding_dedup.splits(x[:0], 4))) == 0


@pytest.mark.parametrize("few", [0.0, 0.02, 1.0])
def test_pairs_left_are_those_of_all_products(monkeypatch, few):
    """Whether blocks are looked at whole or pair by pair."""
    monkeypatch.setattr(embedding_dedup, "FEW", few)
    monkeypatch.setattr(embedding_dedup, "ROWS", 50)
    monkeypatch.setattr(embedding_dedup, "OTHERS", 70)
    import pandas as pd

    rng = np.random.default_rng(8)
    for size in (2, 8, 9, 40):
        x = np.repeat(rng.normal(size=(40, size)), 5, axis=0) + rng.normal(size=(200, size)) * 0.2
        frame = pd.DataFrame({"vector": [v.tobytes() for v in x], "node": np.arange(200), "n": 1})
        unit = x / np.linalg.norm(x, axis=1, keepdims=True)
        turn = embedding_dedup.rotation(unit)
        tile = embedding_dedup.Tile(frame, turn)
        found = {tuple(sorted((tile.node[i], tile.node[j]))) for u, v in embedding_dedup.links(tile, tile, True, 0.9) for i, j in zip(u, v, strict=True)}
        assert found == {(i, j) for i in range(200) for j in range(i + 1, 200) if unit[i] @ unit[j] >= 0.9}


def test_no_vectors(spark):
    assert embedding_dedup.linked(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    assert [r.n_links for r in embedding_dedup.linked(spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>")).collect()] == [0]


def test_urls(spark):
    page = lambda i, url, *links: (i, url, "".join(f'<a href="{x}">' for x in links) if links else None, "z")
    rows = [
        page(1, "https://WWW.Example.COM/en/x?q#f", "//good.org/a", "http://bad.info:80/x", "/own"),
        page(2, "http://example.com/en/"), page(3, "http://a.example.com/En/"), page(4, "http://shop.net/es/1", "http://bad.info"),
        page(5, "http://good.org"), page(6, "http://u@bad.info/es/"), page(7, None), page(8, "no scheme"), page(9, "ftp://x.com"), page(10, ""),
        page(11, "http://bad.info/", "http://shop.net/es/1", "http://shop.net/es/2"), page(11, "http://bad.info/"), page(None, "http://y.com/a"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    found = {(r.page_id): (r.host, r.path, r.rule, r.verdict) for r in url_rank.judged(pages.drop("host"), url_rank.rule_table(spark)).collect()}
    assert found[1] == ("www.example.com", "/en/x", "www.example.com/en/", "allow") and found[2] == ("example.com", "/en/", "example.com/en/", "block")
    assert found[3] == ("a.example.com", "/En/", "com/", "allow") and found[4] == ("shop.net", "/es/1", "net/es/", "block")
    assert found[5] == ("good.org", "", None, "allow") and found[11] == ("bad.info", "/", None, "block")
    assert found[7] == ("", "", None, "allow") == found[8] == found[10] and found[9] == ("x.com", "", None, "allow")
    assert found[None][2] == "com/" and url_rank.judged(pages, url_rank.rule_table(spark)).count() == 13
    assert url_rank.judged(pages.where("1 = 0"), url_rank.rule_table(spark)).count() == 0


def test_verdicts_do_not_shrink_with_the_input(spark):
    """A host is blocked by any distrust beyond its trust, also where ranks lie below 1e-10."""
    rules = url_rank.rule_table(spark, [("bad.org/", "block"), ("far.org/", "block")])
    link = '<a href="//bad.org/">'
    few = [(0, "http://bad.org/", ""), (1, "http://big.net/", link * 100_000), (2, "http://small.net/", link), (3, "http://none.net/", "")]
    few = spark.createDataFrame(few, "page_id long, url string, html string")
    crowd = spark.range(1000, 201_000).selectExpr("id AS page_id", "concat('http://far.org/', id) AS url", "'' AS html")
    for pages in (few, few.unionByName(crowd)):
        found = url_rank.judged(pages, rules).where("page_id < 1000").collect()
        assert {r.page_id: r.verdict for r in found} == {0: "block", 1: "block", 2: "block", 3: "allow"}
    tied = spark.createDataFrame([("a.org", "b.org", 1.0), ("b.org", "a.org", 1.0)], "src string, dst string, weight double")
    seeds = spark.createDataFrame([("a.org", 3.0, 3.0)], "host string, allowed double, blocked double")
    assert url_rank.ranks(tied, seeds).where(F.col("distrust") > F.col("trust") * (1 + url_rank.TIE)).count() == 0


def test_many_hosts_of_a_name(spark):
    rules = url_rank.rule_table(spark, [("b.org/", "block"), ("a.b.org/", "allow")])
    pages = spark.createDataFrame([(1, "http://b.org/x", ""), (2, "http://x.a.b.org/y", ""), (3, "http://ab.org/", "")], "page_id long, url string, html string")
    assert [(r.rule, r.verdict) for r in url_rank.judged(pages, rules).orderBy("page_id").collect()] == [("b.org/", "block"), ("a.b.org/", "allow"), (None, "allow")]


def test_hosts_far_from_every_rule(spark):
    """However many links away, and whatever the direction of the ones between."""
    rules = url_rank.rule_table(spark, [("h40.org/", "block"), ("good.org/", "allow")])
    chain = [(i, f"http://h{i}.org/", f'<a href="//h{i + 1}.org/">') for i in range(40)] + [(40, "http://h40.org/", ""), (41, "http://good.org/", '<a href="//kept.net/">'), (42, "http://kept.net/", "")]
    pages = spark.createDataFrame(chain, "page_id long, url string, html string")
    found = {r.page_id: r.verdict for r in url_rank.judged(pages, rules).collect()}
    assert {found[i] for i in range(41)} == {"block"} and found[41] == found[42] == "allow"


def test_nothing_leaks_over_public_suffixes(spark):
    rules = url_rank.rule_table(spark, [("evil.co.uk/", "block"), ("bad.example.org/", "block")])
    urls = ["evil.co.uk", "bbc.co.uk", "deep.shop.co.uk", "a.evil.co.uk", "bad.example.org", "next.example.org"]
    pages = spark.createDataFrame([(i, f"http://{h}/", "") for i, h in enumerate(urls)], "page_id long, url string, html string")
    found = {urls[r.page_id]: r.verdict for r in url_rank.judged(pages, rules).collect()}
    assert found == {h: "allow" if h in ("bbc.co.uk", "deep.shop.co.uk") else "block" for h in urls}
