"""The stored feature model, sparse vectors, wide statistics, mini-batches."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import SparseVector
from pyspark.sql import functions as F

from reviewlens.operators.dbn import RBMLayer, rbm_epoch_batches, rbm_epoch_sums, rbm_fit
from reviewlens.operators.feature_model import FeatureModel
from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.hbos import HBOSModel
from reviewlens.operators.iforest import IsolationForestModel
from reviewlens.operators.scaling import Scaler, feature_stats_row, vector_stats
from reviewlens.operators.text import tfidf

REVIEWS = "row_id long, text string, summary string, stars double, t timestamp"


def reviews(spark, n=60):
    words = "good bad book story plot hero slow fast end été 你好 a1".split()
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(rng.choice(words, rng.integers(0, 9))) if i % 9 else None, str(rng.choice(words)),
             float(i % 5) if i % 7 else (None if i % 2 else float("nan")), f"2024-01-{1 + i % 20:02d} 06:00:00") for i in range(n)]
    return spark.createDataFrame(rows, REVIEWS.replace("timestamp", "string")).withColumn("t", F.to_timestamp("t"))


def vectors(df):
    return {r["row_id"]: r["features"] for r in df.collect()}


@pytest.mark.parametrize("mode", ["tfidf", "hash"])
def test_fit_store_load_and_apply_to_other_rows(spark, tmp_path, mode):
    df = reviews(spark)
    seen, new = df.where("row_id < 40"), df.where("row_id >= 40")
    m = FeatureModel.fit(seen, {"text": 8, "summary": 4}, ["stars"], mode, "t")
    m.save(spark, str(tmp_path / "m"))
    again = FeatureModel.load(spark, str(tmp_path / "m"))
    assert again == m and len(m.names) == 8 + 4 + 2
    got, want = vectors(again.transform(new)), vectors(m.transform(new))
    assert got == want and len(got) == 20
    assert all(isinstance(v, SparseVector) for v in got.values() if v.numNonzeros() < 7)
    stars = [r["stars"] for r in seen.collect() if r["stars"] is not None and r["stars"] == r["stars"]]
    assert abs(got[42][12] - np.mean(stars)) < 1e-12 and got[43][12] == 3.0      # 42 has no stars
    assert got[45].toArray()[:8].sum() == 0 or got[45][12] >= 0
    assert {round(v[13], 6) for v in got.values()} == {float(i % 20) for i in range(40, 60)}


def test_weights_are_those_of_tfidf(spark):
    df = reviews(spark)
    m = FeatureModel.fit(df, {"text": 8}, [])
    w, _ = tfidf(df, "row_id", "text", 8)
    want = {(r["id"], r["term_index"]): r["weight"] for r in w.collect()}
    got = {(i, int(j)): x for i, v in vectors(m.transform(df)).items() for j, x in zip(v.indices if isinstance(v, SparseVector) else range(8), v.values) if x}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_feature_model_edges(spark, tmp_path):
    df = reviews(spark)
    with pytest.raises(ValueError, match="stars"):
        FeatureModel.fit(df.withColumn("stars", F.lit(None).cast("double")), {"text": 3}, ["stars"])
    with pytest.raises(ValueError, match="mode"):
        FeatureModel.fit(df, {"text": 3}, [], "words")
    wordless = FeatureModel.fit(df.withColumn("text", F.lit("")), {"text": 3}, ["stars"])
    assert wordless.names == ["stars"] and wordless.transform(df).count() == 60
    wordless.save(spark, str(tmp_path / "m"))
    spark.read.json(str(tmp_path / "m" / "meta")).select(F.regexp_replace("meta", '"version": 1', '"version": 7').alias("meta")) \
        .write.json(str(tmp_path / "n" / "meta"))
    with pytest.raises(ValueError, match="version"):
        FeatureModel.load(spark, str(tmp_path / "n"))
    assert FeatureModel.fit(df, {"text": 3}, ["stars"]).transform(df.limit(0)).count() == 0


def test_plan_shuffles_nothing(spark):
    df = reviews(spark)
    plan = FeatureModel.fit(df, {"text": 8}, ["stars"]).transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan


def test_detectors_score_sparse_and_dense_vectors_alike(spark):
    df = reviews(spark)
    sparse = FeatureModel.fit(df, {"text": 6}, ["stars"]).transform(df).select("row_id", "features").persist()
    dense = sparse.withColumn("features", vector_to_array("features"))
    for make in (lambda d: HBOSModel.fit(d, vector="features"), lambda d: IsolationForestModel.fit(d, vector="features", n_estimators=10)):
        scores = [{r["row_id"]: r["anomaly_score"] for r in make(d).transform(d).collect()} for d in (sparse, dense)]
        assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][i] - scores[1][i]) < 1e-9 for i in scores[0])


def test_wide_statistics_are_one_aggregate(spark):
    rng = np.random.default_rng(1)
    X = rng.normal(3, 2, (50, 406))
    X[:, 7] = 4.25
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, v array<double>").repartition(3)
    got = vector_stats(df, "v", 406)
    want = feature_stats_row(df, FeatureSpec.of(df, vector="v").exprs(df)[:20])
    for a, b in zip(got, want):
        assert a["n"] == b["n"] and all(abs(a[k] - b[k]) < 1e-9 for k in ("mean", "var", "lo", "hi"))
    sc = Scaler.fit(df, FeatureSpec.of(df, vector="v"))
    assert 7 not in sc.kept and len(sc.kept) == 405
    assert np.allclose(sc.stds, np.delete(X.std(axis=0), 7))


@pytest.mark.parametrize("bad", [None, [1.0, None], [1.0, float("nan")], [1.0]])
def test_incomplete_vectors_are_an_error(spark, bad):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [3.0, 1.0]), (3, bad)], "row_id long, v array<double>")
    with pytest.raises(ValueError, match="imputed first"):
        Scaler.fit(df, FeatureSpec.of(df, vector="v"))


def units(spark, n=400, parts=4):
    rng = np.random.default_rng(2)
    kinds = rng.random((3, 12)) < 0.4
    X = np.where(rng.random((n, 12)) < 0.05, 1 - kinds[np.arange(n) % 3], kinds[np.arange(n) % 3]).astype(float)
    return spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "id long, x array<double>").repartition(parts), X


def test_mini_batches_learn(spark):
    df, _ = units(spark)
    layer, history = rbm_fit(df, 6, learning_rate=0.5, n_iter=8, batch_size=16, shards=2)
    scores = [t for _, t, _ in history]
    assert scores[-1] > scores[0] + 0.5 and layer.W.shape == (6, 12)
    full, slow = rbm_fit(df, 6, learning_rate=0.5, n_iter=8)
    assert scores[-1] > slow[-1][1]              # the same epochs over all rows at once learn less


def test_batches_do_not_depend_on_partitions(spark):
    start = RBMLayer(np.random.default_rng(0).normal(0, 0.1, (4, 12)), np.zeros(12), np.zeros(4))
    layers = [rbm_epoch_batches(units(spark, parts=p)[0], start, 0.1, 32, epoch=1, shards=3)[1] for p in (1, 7)]
    assert np.allclose(layers[0].W, layers[1].W, atol=1e-12) and not np.allclose(layers[0].W, start.W)


def test_one_batch_of_all_rows_is_a_full_step(spark):
    df, X = units(spark, 50)
    start = RBMLayer(np.random.default_rng(0).normal(0, 0.1, (4, 12)), np.zeros(12), np.zeros(4))
    n, layer = rbm_epoch_batches(df, start, 0.1, 1000, epoch=0, shards=1)
    m, gW, gb, gc = rbm_epoch_sums(df, start)
    assert n == m == 50
    assert np.allclose(layer.W, start.W + 0.1 * gW / n) and np.allclose(layer.b_visible, 0.1 * gb / n) and np.allclose(layer.b_hidden, 0.1 * gc / n)
    H0 = 1 / (1 + np.exp(-(X @ start.W.T)))
    V1 = 1 / (1 + np.exp(-(H0 @ start.W)))
    assert np.allclose(gb, (X - V1).sum(0))
    assert rbm_epoch_sums(df.limit(0), start)[0] == 0


def test_rbm_scores_and_sums_in_one_pass(spark, monkeypatch):
    """An epoch reads the rows once; its scores are those of the layer it ends with."""
    from reviewlens.operators import dbn
    rng = np.random.default_rng(8)
    rows = spark.createDataFrame([(i, rng.random(5).tolist(), i % 4 == 0) for i in range(400)], "id long, x array<double>, held boolean")
    train, held = rows.where("not held"), rows.where("held")
    passes, whole = [], dbn._epoch_pass
    monkeypatch.setattr(dbn, "_epoch_pass", lambda *a: passes.append(a) or whole(*a))
    _, history = rbm_fit(train, 3, n_iter=4, X_val=held, early_stopping=False)
    assert len(passes) == 5 and [e for e, _, _ in history] == [0, 1, 2, 3]
    last, _ = rbm_fit(train, 3, n_iter=4, early_stopping=False)
    for frame, score in ((train, history[-1][1]), (held, history[-1][2])):
        assert abs(dbn.pseudo_likelihood(frame, last) - score) < 1e-9
    assert dbn.pseudo_likelihood(held.limit(0), last) is None


def test_dbn_rows_with_missing_values_stay_null(spark):
    """A missing feature gives NULL elements, which means and scores leave out."""
    from reviewlens.operators import dbn
    rows = spark.createDataFrame([(1, [0.0, 1.0]), (2, [None, 0.5]), (3, [1.0, 0.0])], "id long, x array<double>")
    layer = RBMLayer(np.full((1, 2), 0.5), np.zeros(2), np.zeros(1))
    h = {r["id"]: r["h"] for r in dbn.DBNModel([layer], [0, 1], [0.0, 0.0], [1.0, 1.0]).transform(rows, "x", "h").collect()}
    assert h[2] == [None] and abs(h[1][0] - 1 / (1 + np.exp(-0.5))) < 1e-12 and h[1] == h[3]
    whole = rows.where("id <> 2")
    assert abs(dbn.pseudo_likelihood(rows, layer) - dbn.pseudo_likelihood(whole, layer)) < 1e-12
