"""Resumable tuning and curves, own scorers, stores of every model, layer commits, scratch scopes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import tuning as TU
from reviewlens.operators.dbn import dbn_fit
from reviewlens.operators.detect import AnomalyDetector
from reviewlens.operators.detector_store import load_detector, save_detector
from reviewlens.operators.study import Study
from reviewlens.session import materialize, scratch_path, scratch_scope
from reviewlens.sources.store import RunLedger

COLS = ["a", "b", "c"]


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    X = rng.normal(size=(150, 3))
    X[:15] += 6
    return spark.createDataFrame([(i, *map(float, x), i < 15) for i, x in enumerate(X)], "row_id long, a double, b double, c double, y boolean").persist()


def events(study, stage, status):
    return study.ledger.events().where((F.col("stage") == stage) & (F.col("status") == status))


GRIDS = {"hbos": {"n_bins": [5, 10]}, "isolation_forest": {"n_estimators": [5]}, "lof": {"k": [5]}}


def test_a_killed_run_goes_on_where_it_was(spark, data, tmp_path):
    calls = []

    def scorer(kill):
        def score(flags, label):
            calls.append(1)
            if kill and len(calls) > 5:      # 4 steps of hbos and one of the forest are done
                raise KeyboardInterrupt
            return flags.agg(F.avg((F.col(label) == F.col("is_anomaly")).cast("double")))
        return score
    study = Study(data, RunLedger(spark, str(tmp_path)), "run", "y", COLS, parallelism=1)
    with pytest.raises(KeyboardInterrupt):
        study.tune(GRIDS, k_folds=2, metric=scorer(True))
    done = events(study, "tune_step", "completed").count()
    assert done == 5 and study.pending(list(GRIDS)) == ["isolation_forest", "lof"]
    status = study.status(list(GRIDS)).first()
    assert status["tuned"] == ["hbos"] and abs(status["progress_pct"] - 100 / 3) < 1e-9
    calls.clear()
    again = Study(data, RunLedger(spark, str(tmp_path)), "run", "y", COLS, parallelism=2)
    results = again.tune(GRIDS, k_folds=2, metric=scorer(False))
    assert len(calls) == 2                   # one of the forest, one of LOF; nothing twice
    assert events(again, "tune_step", "completed").groupBy("model").count().agg(F.max("count")).first()[0] == 1
    assert results.count() == 4 + 2 + 1 and results.where("score is null").count() == 0
    assert again.pending(list(GRIDS)) == [] and again.status(list(GRIDS)).first()["progress_pct"] == 100.0
    calls.clear()
    assert again.tune(GRIDS, k_folds=2, metric=scorer(False)).count() == 7 and not calls
    assert {r["model"] for r in again.best().collect()} == set(GRIDS)
    whole = Study(data, RunLedger(spark, str(tmp_path / "other")), "run", "y", COLS).tune(GRIDS, k_folds=2, metric=scorer(False))
    keys = ["model", "grid_index", "fold", "score"]
    assert sorted(map(tuple, whole.select(*keys).collect())) == sorted(map(tuple, results.select(*keys).collect()))


def test_failed_steps_are_rows_and_are_tried_again(spark, data, tmp_path):
    study = Study(data, RunLedger(spark, str(tmp_path)), "r", "y", COLS)
    got = study.tune({"hbos": {"n_bins": [5, "many"]}}, k_folds=2)
    assert [(r["fold"], r["score"] is None) for r in got.where("params like '%many%'").orderBy("fold").collect()] == [(0, True), (1, True)]
    assert study.pending(["hbos"]) == ["hbos"] and events(study, "tune", "failed").count() == 1
    assert "many" not in study.best().first()["params"]
    before = events(study, "tune_step", "failed").count()
    study.tune({"hbos": {"n_bins": [5, "many"]}}, k_folds=2)
    assert events(study, "tune_step", "failed").count() == before + 2 and events(study, "tune_step", "completed").count() == 2


def test_curves_resume_and_keep_failed_models(spark, data, tmp_path):
    study = Study(data, RunLedger(spark, str(tmp_path)), "r", "y", COLS)
    params = {"hbos": {"n_bins": 5}, "dbscan": {"eps": 1.0}, "one_class_svm": {"nu": "none"}}
    curves = study.curves(params, train_sizes=(0.5, 1.0), k_folds=2)
    assert curves.count() == 3 * 2 * 2 * 2
    n = study.ledger.events().count()
    plain = TU.learning_curves(data, "hbos", {"n_bins": 5}, "y", COLS, train_sizes=(0.5, 1.0), k_folds=2)
    keys = ["train_size", "fold", "split", "score"]
    assert sorted(map(tuple, curves.where("model = 'hbos'").select(*keys).collect())) == sorted(map(tuple, plain.select(*keys).collect()))
    assert curves.where("model = 'one_class_svm' and score is null and error is not null").count() == 8
    summary = {r["model"]: r for r in TU.learning_curve_summary(curves).collect()}
    assert summary["one_class_svm"]["gap"] is None and summary["hbos"]["gap"] is not None
    del params["one_class_svm"]
    study.curves(params, train_sizes=(0.5, 1.0), k_folds=2)
    assert study.ledger.events().count() == n


def test_a_scorer_of_ones_own(data):
    def weighted_f1(flags, label):
        y, p = F.col(label), F.col("is_anomaly")
        c = flags.agg(*[F.count_if(e).cast("double").alias(n) for n, e in
                        (("tp", y & p), ("fp", ~y & p), ("fn", y & ~p), ("tn", ~y & ~p))])
        return c.select(((F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")) * (F.col("tp") + F.col("fn"))
                          + F.try_divide(2 * F.col("tn"), 2 * F.col("tn") + F.col("fp") + F.col("fn")) * (F.col("tn") + F.col("fp")))
                         / (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn"))).alias("score"))
    grid = {"n_bins": [3, 10], "contamination": [0.05, 0.1, 0.3]}
    found = [TU.grid_search(data, "hbos", grid, "y", COLS, k_folds=2, metric=m) for m in ("weighted_f1", weighted_f1)]
    scores = [{(r["grid_index"], r["fold"]): r["score"] for r in f.collect()} for f in found]
    assert scores[0].keys() == scores[1].keys() and all(abs(scores[0][k] - scores[1][k]) < 1e-12 for k in scores[0])
    assert TU.best_params(found[0]).first()["params"] == TU.best_params(found[1]).first()["params"]


@pytest.mark.parametrize("kind,params", [("isolation_forest", {"n_estimators": 12}), ("one_class_svm", {"n_components": 16, "max_iter": 5}),
                                         ("one_class_svm", {"n_components": 16, "max_iter": 5, "method": "rff"}),
                                         ("one_class_svm", {"kernel": "linear", "max_iter": 5}), ("hbos", {"max_features": 2}),
                                         ("isolation_forest", {"n_estimators": 4, "max_features": 1})])
def test_stored_models_score_other_rows_alike(spark, data, tmp_path, kind, params):
    det = AnomalyDetector(kind, **params).fit(data.where("row_id < 100"), COLS)
    save_detector(spark, det.model, str(tmp_path / "m"))
    new = data.where("row_id >= 100")
    got, want = ([(r["row_id"], r["anomaly_score"], r["is_anomaly"]) for r in m.transform(new).orderBy("row_id").collect()]
                 for m in (load_detector(spark, str(tmp_path / "m")), det.model))
    assert len(got) == 50
    assert all(g[0] == w[0] and abs(g[1] - w[1]) < 1e-12 and g[2] == w[2] for g, w in zip(got, want))


def test_max_features_ignores_the_rest(data):
    det = AnomalyDetector("hbos", max_features=2).fit(data, COLS)
    scores = [{r["row_id"]: r["anomaly_score"] for r in det.detect(d).collect()} for d in (data, data.withColumn("c", F.lit(1e9)))]
    assert scores[0] == scores[1] and det.model.scaler.kept_names == ["a", "b"]


def test_forest_as_an_expression(data):
    m = AnomalyDetector("isolation_forest", n_estimators=20).fit(data, COLS).model
    for r in data.select(m.score_expr(data).alias("p"), m.score_expr_jvm(data).alias("j")).collect():
        assert abs(r["p"] - r["j"]) < 1e-12


def test_a_stopped_fit_goes_on_at_the_next_layer(spark, data, tmp_path):
    df = data.select("row_id", F.array(*COLS).alias("features"))
    cfg = [{"learning_rate": 0.1, "n_iter": 3}, {"learning_rate": 0.1, "n_iter": 2, "batch_size": 16, "shards": 2}]
    kw = dict(hidden_layers=[3, 2], layer_configs=cfg, checkpoint=str(tmp_path))
    part = dbn_fit(df, stop_after=1, **kw)
    assert len(part.layers) == 1
    went_on = dbn_fit(df, **kw)
    whole = dbn_fit(df, **{**kw, "checkpoint": str(tmp_path / "other")})
    assert np.array_equal(went_on.layers[0].W, part.layers[0].W)
    for a, b in zip(went_on.layers, whole.layers):
        assert np.allclose(a.W, b.W, atol=1e-9) and np.allclose(a.b_hidden, b.b_hidden, atol=1e-9)
    assert [s[:2] for s in went_on.layer_scores] == [s[:2] for s in whole.layer_scores]
    other = dbn_fit(df, **{**kw, "layer_configs": [{"n_iter": 1}] * 2})      # other parameters: layers of their own
    assert not np.allclose(other.layers[0].W, part.layers[0].W)


def test_scratch_scope(spark):
    import os
    base = os.path.dirname(scratch_path(spark, "x"))
    materialize(spark.range(1))
    before = set(os.listdir(base))
    with scratch_scope(spark) as outer:
        a = materialize(spark.range(10))
        with scratch_scope(spark) as inner:
            b, c = materialize(spark.range(20)), materialize(spark.range(30))
            inner.keep(b.join(a, "id"))
        assert b.count() == 20 and len(set(os.listdir(base)) - before) == 2      # c is gone
        result = outer.keep(b.selectExpr("id + 1 as id"))
    assert result.count() == 20 and len(set(os.listdir(base)) - before) == 1
    with pytest.raises(ZeroDivisionError):
        with scratch_scope(spark) as scope:
            scope.keep(materialize(spark.range(5)))
            1 / 0
    assert len(set(os.listdir(base)) - before) == 1 and c is not None


def _labelled(spark):
    return spark.createDataFrame([(i, float(i % 17), float(i * i % 29), i % 5 == 0) for i in range(240)],
                                 "row_id long, a double, b double, label boolean")


def _count_scalers(monkeypatch):
    from reviewlens.operators.scaling import Scaler
    calls, fit = [], Scaler.fit
    monkeypatch.setattr(Scaler, "fit", staticmethod(lambda *a, **k: calls.append(a) or fit(*a, **k)))
    return calls


def test_grid_search_fits_a_scaler_per_fold(spark, monkeypatch):
    from reviewlens.operators import tuning
    df, grid = _labelled(spark), {"n_bins": [4, 8], "contamination": [0.2]}
    calls = _count_scalers(monkeypatch)
    shared = {(r["grid_index"], r["fold"]): r["score"] for r in tuning.grid_search(df, "hbos", grid, "label", cols=["a", "b"], k_folds=3).collect()}
    assert len(calls) == 3
    # with max_features every fit has its own, with the same scores
    own = tuning.grid_search(df, "hbos", {**grid, "max_features": [2]}, "label", cols=["a", "b"], k_folds=3).collect()
    assert len(calls) == 9 and shared == {(r["grid_index"], r["fold"]): r["score"] for r in own}


def test_study_fits_a_scaler_per_fold(spark, tmp_path, monkeypatch):
    from reviewlens.operators.study import Study
    from reviewlens.sources.store import RunLedger
    calls = _count_scalers(monkeypatch)
    found = Study(_labelled(spark), RunLedger(spark, str(tmp_path / "l")), "run", "label", cols=["a", "b"]).tune({"hbos": {"n_bins": [4, 8, 12]}}, k_folds=2)
    assert len(calls) == 2 and found.where("score is not null").count() == 6
