"""The pipeline's stages, each against a plain version of its decision."""

import pytest

import corpus_pipeline
from cellaudit.llm import quality_cnn, quality_rules, secret_scan

from . import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it returned."""
    df, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        given = df
        df = corpus_pipeline.stored(stage(spark, given, SF), name)
        out[name] = (given, df)
    return out


def test_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "near_duplicates", "secret_scan", "packing"]


def test_columns(stages):
    for name, (given, out) in stages.items():
        if name != "packing":
            assert out.columns == given.columns


def ids(df):
    return {r.doc_id for r in df.select("doc_id").collect()}


def test_decisions(spark, stages):
    given, out = stages["quality_rules"]
    assert ids(out) == {r.doc_id for r in quality_rules.verdicts(given).collect() if r.kept}
    given, out = stages["quality_classifier"]
    net = quality_cnn.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    assert ids(out) == {r.doc_id for r in quality_cnn.scored(given, net).collect() if r.predicted}
    given, out = stages["near_duplicates"]
    groups = brute.near_copies([(r.doc_id, r.text) for r in given.collect()], 5)
    assert ids(out) == {k for k, (_, c) in groups.items() if k == c}
    given, out = stages["secret_scan"]
    want = {r.doc_id: secret_scan.masked(r.text) for r in given.collect()}
    assert {r.doc_id: r.text for r in out.collect()} == want
    assert all(len(t) == n for t, n in ((r.text, r.n_chars) for r in out.collect()) if "[SECRET]" in t)
    given, out = stages["packing"]
    assert out.groupBy("doc_id").sum("length").count() == given.count()


def test_run(spark, stages):
    columns = ["doc_id", "start", "length", "doc_tokens"]
    assert sorted(corpus_pipeline.run(spark, SF).select(columns).collect()) == sorted(stages["packing"][1].select(columns).collect())


def test_empty(spark):
    df = spark.read.parquet(f"{SF}/documents.parquet").where("1 = 0")
    for _, stage in corpus_pipeline.STAGES:
        df = stage(spark, df, SF)
    assert df.count() == 0


def test_clashing_columns(spark):
    """Further columns, whatever their names, go through all stages but the last."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = ["measures", "Kept", "score", "masked_text", "digest", "component_id", "n_shingles", "predicted", "held_out", "f_lang", "label", "ids"]
    df = docs.selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    plain, wide = docs, df
    for _, stage in corpus_pipeline.STAGES[:-1]:
        plain, wide = (corpus_pipeline.stored(stage(spark, x, SF), "stage") for x in (plain, wide))
        assert wide.columns == df.columns
    assert sorted(wide.select(docs.columns).collect(), key=str) == sorted(plain.collect(), key=str)
    assert all(r[n] == f"{n}{r.doc_id}" for r in wide.collect() for n in names)
