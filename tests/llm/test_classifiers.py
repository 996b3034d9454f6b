"""Held-out accuracy of the three classifiers, and the cases around them."""

import random

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import language_id, quality_rules, text_stats, toxicity
from reviewlens.llm.shingles import text_buffers
from tests.conftest import SF_ORACLE
from tests.llm.helpers import docs, with_clashes

LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def tables(spark):
    return (spark.read.parquet(f"{SF_ORACLE}/documents.parquet"), spark.read.parquet(f"{SF_ORACLE}/labels.parquet"))


def joined(scores, labels, label):
    return scores.join(labels.select("doc_id", label), "doc_id").filter("held_out").toPandas()


def test_quality_held_out(tables):
    d, labels = tables
    p = joined(quality_rules.quality_scores(with_clashes(d), labels), labels, "quality")
    assert (p.predicted == p.quality).mean() > 0.95
    assert ((p.score >= 0.5).astype(int) == p.predicted).all() and p.score.between(0, 1).all()


def test_toxicity_held_out(tables):
    d, labels = tables
    p = joined(toxicity.toxicity_scores(with_clashes(d), labels), labels, "toxic")
    clean, toxic = p[p.toxic == 0], p[p.toxic == 1]
    assert (clean.predicted == 0).mean() > 0.93
    assert (toxic.predicted == 1).mean() > 0.7      # some forty texts of label 1 are learned from


def test_language_held_out(tables):
    d, _ = tables
    p = language_id.language_scores(with_clashes(d)).join(d.select("doc_id", "lang"), "doc_id").filter("held_out").toPandas()
    assert (p.lang_pred == p.lang).mean() > 0.98


def test_labels_beside_the_text_do_not_matter(spark, tables):
    """lang, source and doc_id are no inputs of a score."""
    d, labels = tables
    from pyspark.sql import functions as F
    other = d.withColumn("source", F.lit("x")).withColumn("lang", F.when(F.col("doc_id") % 2 == 0, F.col("lang")))
    a = quality_rules.quality_scores(d, labels).collect()
    b = quality_rules.quality_scores(other, labels).collect()
    assert {(r["doc_id"], round(r["score"], 9)) for r in a} == {(r["doc_id"], round(r["score"], 9)) for r in b}


ROWS = [(1, None), (2, ""), (3, " \n "), (4, "12 34 !"), (5, "a"), (5, "a"), (None, "some text"), (6, "word " * 40_000), (7, "é日本")]


def test_unusual_rows(spark):
    d = docs(spark, ROWS)
    labels = spark.createDataFrame([(5, 1, 0), (6, 0, 1), (7, 1, None), (None, 0, 1), (2, None, 0)], LABELS)
    for got in (quality_rules.quality_scores(d, labels), toxicity.toxicity_scores(d, labels)):
        rows = got.collect()
        assert len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] in (0, 1) for r in rows)
    rows = language_id.language_scores(d).collect()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert und >= {1, 2, 3, 4} and len(rows) == len(ROWS) and all(0 <= r["score"] <= 1 for r in rows)


def test_no_labels_no_rows(spark):
    none = spark.createDataFrame([], LABELS)
    empty = docs(spark, [])
    d = docs(spark, [(1, "a b"), (2, "c")])
    for f in (quality_rules.quality_scores, toxicity.toxicity_scores):
        assert f(empty, none).count() == 0 and f(d, none).count() == 2
    assert language_id.language_scores(empty).count() == 0
    assert {r["lang_pred"] for r in language_id.language_scores(d.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}


def test_statistics():
    import pyarrow as pa
    s = dict(zip(text_stats.NAMES, text_stats.statistics(*text_buffers(pa.array(["Hello world. hello\nb $$$\nb $$$"])))[0]))
    assert s["n_chars"] == 30 and s["n_words"] == 7 and s["n_lines"] == 3
    assert s["repeated_lines"] == pytest.approx(1 / 3) and s["symbol_word_share"] == pytest.approx(2 / 7)
    assert s["distinct_word_share"] == pytest.approx(4 / 7) and s["top_word_share"] == pytest.approx(2 / 7)


def test_rules_compile_to_the_same_scores(spark):
    rng = np.random.default_rng(0)
    x = rng.random((600, len(text_stats.NAMES)))
    y = ((x[:, 3] > 0.5) & (x[:, 6] < 0.4)).astype(float)
    model = quality_rules.fit_rules(x, y)
    frame = spark.createDataFrame([tuple(map(float, r)) for r in x[:50]], text_stats.SCHEMA)
    got = [r["s"] for r in frame.select(model.column().alias("s")).collect()]
    logit = model.intercept + sum(w * quality_rules._applies(r, x[:50]) for r, w in zip(model.rules, model.weights))
    assert np.allclose(got, 1 / (1 + np.exp(-logit))) and ((np.array(got) >= 0.5) == (y[:50] == 1)).mean() > 0.95
    assert all(len(r) <= quality_rules.DEPTH for r in model.rules)


def test_misspelt_words_share_ngrams():
    rnd = random.Random(1)
    plain = [f"{a}{b}" for a in ("lo", "mi", "ta", "re", "su", "no") for b in ("ka", "ben", "dor", "shi", "pel", "van")]
    bad = ["stupidly", "worthless", "disgusting"]

    def text(toxic):
        w = [rnd.choice(plain) for _ in range(60)]
        for _ in range(4 * toxic):
            w[rnd.randrange(60)] = rnd.choice(bad)
        return " ".join(w)
    y = np.array([float(i % 3 == 0) for i in range(300)])
    model = toxicity.train([text(int(v)) for v in y], y)

    def score(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        return model.scores(raw, np.array([0, len(raw)]))[0]
    assert score(text(0)) < 0.3 < score(text(1))
    assert score(" ".join(["loka"] * 8 + ["wortthless", "stuppidly", "disgustting"] + ["tavan"] * 8)) > 0.3


def _plain_and_bad(rnd, n, bad=0):
    w = [f"{rnd.choice(('lo', 'mi', 'ta', 're', 'su', 'no'))}{rnd.choice(('ka', 'ben', 'dor', 'shi', 'pel', 'van'))}" for _ in range(n)]
    for _ in range(bad):
        w[rnd.randrange(n)] = rnd.choice(["stupidly", "worthless", "disgusting"])
    return " ".join(w)


@pytest.mark.parametrize("around", [200, 1_000, 5_000, 20_000])
def test_toxic_passage_in_clean_words(around):
    rnd = random.Random(around)
    y = np.array([float(i % 3 == 0) for i in range(300)])
    model = toxicity.train([_plain_and_bad(rnd, 60, 6 * int(v)) for v in y], y)
    texts, clean = [], []
    for _ in range(30):
        half = _plain_and_bad(rnd, around // 2)
        texts.append(f"{half} {_plain_and_bad(rnd, 40, 8)} {half}")
        clean.append(f"{half} {half}")
    found, alone = (model.scores(*text_buffers(pa.array(t))) >= 0.3 for t in (texts, clean))
    assert found.mean() >= 0.9 and alone.mean() <= 0.1


def test_long_labelled_texts_are_learned_from(spark):
    """All texts of label 1 are far longer than text_bytes: passages stand for them."""
    rnd = random.Random(3)
    rows = [(i, _plain_and_bad(rnd, 3_000, 900) if i % 3 == 0 else _plain_and_bad(rnd, 60)) for i in range(120)]
    labels = spark.createDataFrame([(i, 1, int(i % 3 == 0)) for i, _ in rows], LABELS)
    got = toxicity.toxicity_scores(docs(spark, rows), labels, text_bytes=32_000).collect()
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in got]) > 0.95


def test_windows_do_not_depend_on_pieces(monkeypatch):
    rnd = random.Random(4)
    model = toxicity.ToxicityModel(np.random.default_rng(1).normal(size=1 << toxicity.BUCKET_BITS).astype(np.float32))
    text = text_buffers(pa.array([_plain_and_bad(rnd, 3_000), "", "one"]))
    whole = model.scores(*text)
    raw, offsets = text
    sums, counts, low = [], [], []
    for a, b in zip(offsets[:-1], offsets[1:]):     # every window by itself
        w = bytes(raw[a:b]).decode().split()
        steps = [" ".join(w[i:i + toxicity.STEP]) for i in range(0, len(w), toxicity.STEP)] or [""]
        parts = [toxicity.step_ngrams(np.frombuffer(s.encode(), np.uint8), np.array([0, len(s)]))[0] for s in steps]
        low.append(max((model.weight[p].sum() + model.weight[q].sum()) / (len(p) + len(q) + toxicity.SMOOTH)
                       for p, q in zip(parts, [*parts[1:], parts[0][:0]])))
    assert np.allclose(whole, 1 / (1 + np.exp(-np.array(low))), atol=1e-5)


def test_passages(spark):
    from pyspark.sql import functions as F
    from reviewlens.llm.common import passages
    text = "".join(f"{i:05d}" for i in range(4_000))
    rows = spark.createDataFrame([(1, text), (2, "é" * 100), (3, None)], "doc_id long, text string")
    got = {r["doc_id"]: r["p"] for r in rows.select("doc_id", passages(F.col("text"), F.col("doc_id"), 1_000, 99).alias("p")).collect()}
    parts = got[1].split("\n")
    assert [len(p) for p in parts] == [99] * 10 and all(p in text for p in parts) and got[2] == "é" * 100 and got[3] is None
    assert all(i * 2_000 <= text.index(p) < (i + 1) * 2_000 for i, p in enumerate(parts))


def test_ridge_matches_the_kernel_form():
    texts = ["the cat sat on the mat", "a dog and a cat", "le chat est sur la table", "un chien et un chat"] * 3
    model = language_id.fit_language(texts, ["en", "en", "fr", "fr"] * 3, landmarks=12)
    sets = [language_id.presence(t) for t in texts]
    k = np.array([[len(np.intersect1d(a, b)) / np.sqrt(len(a) * len(b)) for b in sets] for a in sets])
    assert np.allclose(np.diag(k), 1) and model.predict(texts)[0] == ["en", "en", "fr", "fr"] * 3
    assert language_id.fit_language([], []).predict(["x"])[0] == ["und"]


def test_toxicity_training_does_not_hold_its_ngrams():
    """The n-grams of a sample stay out of the driver's memory: more text, about the same peak."""
    import tracemalloc

    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefghijklmnop"), 7)) for _ in range(4000)]

    def peak(n):
        texts = [" ".join(rng.choice(words, 1500)) for _ in range(n)]
        tracemalloc.start()
        toxicity.train(texts, np.arange(n) % 3 == 0)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        return most
    assert peak(240) - peak(40) < 20 << 20
