"""Rows outside the fit, rows with missing features, rows without a label."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators.detect import MODEL_TYPES, AnomalyDetector
from reviewlens.operators.evaluate import binary_metrics
from reviewlens.operators.hbos import HBOSModel


def frame(spark, X, first=0):
    return spark.createDataFrame([(first + i, *map(float, r)) for i, r in enumerate(X)], "row_id long, a double, b double")


def test_lof_judges_new_rows_by_their_features(spark):
    rng = np.random.default_rng(1)
    det = AnomalyDetector("lof", k=5).fit(frame(spark, rng.normal(size=(120, 2))), cols=["a", "b"])
    far = [[50.0, 50.0]]
    scores = [det.detect(frame(spark, far, first)).first() for first in (5, 1000)]
    assert scores[0]["anomaly_score"] == scores[1]["anomaly_score"] > 20 and scores[0]["is_anomaly"]
    assert det.training_scores().count() == 120


def test_training_rows_keep_their_own_scores(spark):
    X = np.random.default_rng(2).normal(size=(80, 2))
    df = frame(spark, X)
    det = AnomalyDetector("lof", k=5).fit(df, cols=["a", "b"])
    own = {r["row_id"]: r["anomaly_score"] for r in det.training_scores().collect()}
    assert {r["row_id"]: r["anomaly_score"] for r in det.detect_training(df).collect()} == own
    with pytest.raises(ValueError):
        AnomalyDetector("hbos").fit(df, cols=["a", "b"]).training_scores()


@pytest.mark.parametrize("model", MODEL_TYPES)
@pytest.mark.parametrize("missing", [None, float("nan")])
def test_missing_features_are_an_error_in_fit(spark, model, missing):
    df = frame(spark, np.random.default_rng(3).normal(size=(40, 2))).union(
        spark.createDataFrame([(99, missing, 1.0)], "row_id long, a double, b double"))
    with pytest.raises(ValueError, match="NULL, NaN"):
        AnomalyDetector(model).fit(df, cols=["a", "b"])


@pytest.mark.parametrize("model", ["hbos", "isolation_forest", "one_class_svm", "lof"])
def test_missing_features_are_an_error_in_scoring(spark, model):
    params = {"hbos": {}, "isolation_forest": {"n_estimators": 5}, "one_class_svm": {"max_iter": 2, "n_components": 8}, "lof": {"k": 3}}[model]
    det = AnomalyDetector(model, **params).fit(frame(spark, np.random.default_rng(3).normal(size=(40, 2))), cols=["a", "b"])
    for row in [(1, None, 1.0), (1, 1.0, None), (1, 1.0, float("nan"))]:
        with pytest.raises(Exception, match="impute it first"):
            det.detect(spark.createDataFrame([row], "row_id long, a double, b double")).select("anomaly_score").collect()


def test_infinite_values_of_new_rows_are_out_of_range(spark):
    m = HBOSModel.fit(frame(spark, np.random.default_rng(3).normal(size=(40, 2))), cols=["a", "b"])
    new = spark.createDataFrame([(1, float("inf"), 0.0), (2, float("-inf"), float("inf"))], "row_id long, a double, b double")
    assert m.transform(new).filter("is_anomaly").count() == 2


def test_weighted_f1_is_over_labelled_rows(spark):
    rows = [("a", True, True), ("a", False, False), ("a", True, True), ("a", False, False), ("a", None, True), ("a", None, False),
            ("b", None, True)]
    df = spark.createDataFrame(rows, "model string, label boolean, is_anomaly boolean")
    got = {r["model"]: r for r in binary_metrics(df, by=["model"]).collect()}
    assert got["a"]["weighted_f1"] == 1.0 and got["a"]["n"] == 6
    assert got["b"]["weighted_f1"] is None
    assert binary_metrics(df.limit(0)).first()["weighted_f1"] is None
    assert df.filter(F.col("label").isNull()).count() == 3
