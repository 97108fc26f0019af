"""Classifiers: held-out accuracy, and what they make of odd input."""

import zlib
from collections import Counter

import numpy as np
import pytest

from cellaudit.llm import language_id, quality_cnn, toxicity
from cellaudit.llm.queries import QUERIES

LARGER = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n "), (4, "12 34 !!"), (5, "the of and " * 20000), (6, "ä"), (6, "ä"), (None, "the"), (7, "\x00▁日本")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{LARGER}/documents.parquet")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet(f"{LARGER}/labels.parquet")


@pytest.fixture(scope="module")
def odd(spark):
    return spark.createDataFrame([(*r, "x", 1) for r in ODD], "doc_id long, text string, lang string, score int")


def held(key, folds, number):
    return key is not None and zlib.crc32(str(key).encode()) % folds == number


def test_quality(spark, labels):
    want = {r.doc_id: r.quality for r in labels.collect()}
    rows = QUERIES["op1_quality_classifier"](spark, LARGER).collect()
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in tested]) > 0.93


def test_toxicity(spark, labels):
    want = {r.doc_id: r.toxic for r in labels.collect()}
    rows = QUERIES["op5_toxicity"](spark, LARGER).collect()
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id, 3, 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    tested = [r for r in rows if r.held_out and r.doc_id in want]
    assert np.mean([r.predicted == want[r.doc_id] for r in tested]) > 0.9
    assert np.mean([r.predicted for r in tested if want[r.doc_id]]) > 0.5


def test_language(spark, docs):
    want = {r.doc_id: r.lang for r in docs.select("doc_id", "lang").collect()}
    rows = QUERIES["op3_language_id"](spark, LARGER).collect()
    assert len(rows) == 1000 and all(r.held_out == held(r.doc_id, 4, 2) and 0 <= r.score <= 1 for r in rows)
    assert np.mean([r.lang_pred == want[r.doc_id] for r in rows if r.held_out]) > 0.98


def test_network_reads_whole_texts(docs, labels):
    """Scores of a batch are those of its texts one by one, and a far end counts."""
    net = quality_cnn.train(docs, labels, per_label=60)
    texts = [t or "" for _, t in ODD] + ["x" * 255, "x" * 256, "x" * 257, "x" * 513, "the and of " * 3000 + "&&& ### " * 300]
    data = [t.encode() for t in texts]
    starts = np.concatenate([[0], np.cumsum([len(d) for d in data])])
    together = net.scores(np.frombuffer(b"".join(data), np.uint8), starts)
    alone = [net.scores(np.frombuffer(d, np.uint8), np.array([0, len(d)]))[0] for d in data]
    assert np.allclose(together, alone, atol=1e-5)
    single = net.by_byte()
    d = np.frombuffer(data[-1] + bytes(8), np.uint8)
    response = sum(single[k][d[k : len(data[-1]) + k]] for k in range(quality_cnn.WIDTH))
    parts = [response[i : i + 2 * quality_cnn.HALF].max(axis=0) for i in range(0, max(len(response) - quality_cnn.HALF, 1), quality_cnn.HALF)]
    value = np.maximum(np.array(parts) + net.bias, 0)
    z = np.concatenate([value.mean(axis=0), value.max(axis=0)]) @ net.weights + net.offset
    assert alone[-1] == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-4)


def test_odd(spark, docs, labels, odd):
    empty = odd.where("1 = 0")
    net = quality_cnn.train(docs, labels, per_label=40)
    for rows in (quality_cnn.scored(odd, net).collect(), toxicity.scored(odd, toxicity.train(docs, labels, per_label=40)).collect()):
        assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    assert quality_cnn.scored(empty, net).count() == 0
    assert quality_cnn.kept_documents(odd, labels).columns == odd.columns
    model = language_id.train(docs, per_language=40)
    found = {r.doc_id: r for r in language_id.identified(odd, model).collect()}
    assert all(found[k].lang_pred == "und" and found[k].score == 0 for k in (1, 2, 3, 4)) and found[5].lang_pred == "en" and found[7].lang_pred != "und"


def test_empty_tables_and_clashing_names(spark, docs, labels):
    few = docs.limit(300)
    clash = few.withColumnsRenamed({"source": "score", "n_chars": "predicted"}).selectExpr("*", "1 AS held_out", "'x' AS lang_pred", "2 AS label", "3 AS apart", "4 AS whole")
    net, model, names = quality_cnn.train(docs, labels, per_label=40), toxicity.train(docs, labels, per_label=40), language_id.train(docs, per_language=40)
    for score in (lambda d: quality_cnn.scored(d, net), lambda d: toxicity.scored(d, model), lambda d: language_id.identified(d, names)):
        assert score(docs.where("1 = 0")).count() == 0
        assert sorted(score(clash).collect()) == sorted(score(few).collect())
    assert toxicity.train(clash, labels).constant is None and quality_cnn.kept_documents(clash, labels).columns == clash.columns


def test_nothing_to_learn(spark, docs, labels, odd):
    none = labels.where("1 = 0")
    assert {r.score for r in quality_cnn.scored(odd, quality_cnn.train(docs, none)).collect()} == {0.5}
    assert {r.score for r in toxicity.scored(odd, toxicity.train(docs, none)).collect()} == {0.0}
    one = labels.where("quality = 1 AND toxic = 0")
    assert {r.score for r in quality_cnn.scored(odd, quality_cnn.train(docs, one)).collect()} == {1.0}
    assert {r.lang_pred for r in language_id.identified(odd, language_id.train(docs.where("1 = 0"))).collect()} == {"und"}


def test_rising():
    z, y = np.array([3.0, 1, 2, 4, 5]), np.array([1.0, 0, 1, 0, 1])
    knots = toxicity.rising(z, y, np.ones(5))
    assert (np.diff(knots[1]) >= 0).all() and np.interp(1, *knots) == 0 and np.interp(3, *knots) == pytest.approx(2 / 3)


def test_all_labelled_texts_are_counted(spark, docs, labels):
    """Counts of words and bigrams equal those of plain loops over every row."""
    rows = docs.join(labels, "doc_id").select(labels.toxic.cast("int").alias("label"), "text").where("text IS NOT NULL")
    listed = toxicity._vocabulary(rows)
    plain = [(r.label, toxicity.words(r.text)) for r in rows.collect()]
    often = Counter(w for _, x in plain for w in x)
    assert listed == sorted((w for w, n in often.items() if n >= toxicity.COMMON), key=lambda w: (-often[w], w))
    number = {w: i + 1 for i, w in enumerate(listed)}
    want = Counter()
    for label, x in plain:
        at = toxicity.coded(x, number).tolist()
        assert all(a == number[w] if w in number else a > len(listed) + 1 for a, w in zip(at, x, strict=True))
        want.update((label, h, w) for h, w in set(zip([len(listed) + 1, *at], at, strict=False)))
    got = {}
    for r in toxicity._bigrams(rows, listed).collect():
        got.update({(c, r.h, r.w): n for c, n in enumerate((r.c0, r.c1)) if n})
    assert got == dict(want) and len(got) > 1000


def test_model_holds_all_common_words_and_bigrams(spark):
    """Neither words nor bigrams found often enough are cut, however many there are."""
    many = [f"w{i}" for i in range((1 << 17) + 500)]
    rows = spark.createDataFrame([(i % 2, " ".join(many)) for i in range(toxicity.COMMON)], "label int, text string")
    assert len(toxicity._vocabulary(rows)) == len(many)
    some = [f"w{i}" for i in range(520)]
    pairs = " ".join(f"{a} {b}" for a in some for b in some)
    texts = [(i % 2, pairs) for i in range(toxicity.COMMON + 1)] + [(1, "w7 bad")] * toxicity.COMMON
    texts += [(1, f"{w} bad") for w in some[10 : 10 + toxicity.COMMON]]
    model = toxicity._count(spark.createDataFrame(texts, "label int, text string").repartition(4))
    number, size = {w: i + 1 for i, w in enumerate(model.vocabulary)}, len(model.vocabulary) + 2
    held = set(model.pairs.tolist())
    assert {number[a.encode()] * size + number[b.encode()] for a in some for b in some} <= held
    assert number[b"w7"] * size + number[b"bad"] in held


def plain_kneser_ney(rows):
    """Both classes' probabilities by loops and dictionaries: (p(class, history, word), vocabulary)."""
    common = toxicity.COMMON
    texts = [(label, toxicity.words(t)) for label, t in rows]
    often = Counter(w for _, x in texts for w in x)
    listed = {w for w, n in often.items() if n >= common}
    counts = ({}, {})
    for label, x in texts:
        for pair in set(zip(["<s>", *x], x, strict=False)):
            counts[label][pair] = counts[label].get(pair, 0) + 1
    types = set(counts[0]) | set(counts[1])
    before = Counter(w for _, w in types)
    vocabulary = {w for w in listed if before[w] >= common}
    total, different = sum(before.values()), len(before)
    shared = lambda w: (2 * before[w] + 1 if w in vocabulary else 1) * 0.5 / (total + 0.5 * (different + 1))
    off = lambda values: toxicity.discounts(*(sum(v == k for v in values) for k in range(1, 5)))
    less = lambda n, d: max(n - d[min(n, 3)], 0)
    models = []
    for c in (0, 1):
        own = Counter(w for _, w in counts[c])
        d_own, d_pairs = off(own.values()), off(counts[c].values())
        kept = {w: less(own[w], d_own) for w in vocabulary}
        mass = max(sum(own.values()), 1)
        follows = Counter()
        for (h, _), n in counts[c].items():
            follows[h] += n
        known = {p for p in types if counts[0].get(p, 0) + counts[1].get(p, 0) >= common and p[1] in vocabulary and (p[0] == "<s>" or p[0] in vocabulary)}
        seen = {p: less(counts[c].get(p, 0), d_pairs) / max(follows[p[0]], 1) for p in known}
        left = Counter()
        for (h, _), x in seen.items():
            left[h] += x
        models.append((kept, mass, seen, left))

    def probability(c, h, w):
        kept, mass, seen, left = models[c]
        h = h if h == "<s>" or h in vocabulary else None
        below = (kept.get(w, 0) + (mass - sum(kept.values())) * shared(w)) / mass
        return seen.get((h, w), 0) + (1 - left[h]) * below

    return probability, vocabulary


def test_probabilities_and_windows_by_plain_loops(spark):
    rng = np.random.default_rng(12)
    common = [f"w{i}" for i in range(12)]
    rows = []
    for k in range(400):
        label = k % 2
        weights = np.arange(1, 13) ** (1.5 if label else 0.5)
        found = list(rng.choice(common, rng.integers(0, 9), p=weights / weights.sum()))
        rows.append((label, " ".join([*found, *(["bad thing"] if label and k % 3 == 0 else []), f"rare{k % 90}"])))
    model = toxicity._count(spark.createDataFrame(rows, "label int, text string").repartition(3))
    probability, vocabulary = plain_kneser_ney(rows)
    assert set(model.vocabulary) == vocabulary and b"bad" in vocabulary and b"thing" not in vocabulary  # it follows one word only
    texts = [t for _, t in rows[:40]] + ["", "w1", "w1 w1 w1 w2", "rare1 rare2 w3", "bad thing w5 w6 w7 w8 w9 unknown", "W3, w4!"]
    for text, (whole, worst) in zip(texts, model.differences(texts), strict=True):
        x = toxicity.words(text)
        h = ["<s>", *x]
        place = lambda w: w if w == "<s>" or w in vocabulary else None
        value = [0.0 if place(a) == place(b) else np.log(probability(1, a, b)) - np.log(probability(0, a, b)) for a, b in zip(h, x, strict=False)]
        assert whole == pytest.approx(sum(value) / len(x) if x else 0.0, abs=1e-9)
        spans = [value[i : i + toxicity.WINDOW] for i in range(max(len(x) - toxicity.WINDOW, 0) + 1)]
        assert worst == pytest.approx(max(np.mean(s) for s in spans) if x else 0.0, abs=1e-9)
