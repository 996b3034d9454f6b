"""Evaluation micro fixtures (A16-A20, A22, A26) with hand-computed answers."""
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import evaluate as EV
from reviewlens.operators import report as RP
from reviewlens.operators import tuning as TU


def test_zero_division_and_single_class(spark):
    df = spark.createDataFrame([(True, False), (False, False), (True, False), (False, False)],
                               "label boolean, is_anomaly boolean")
    r0 = EV.binary_metrics(df, zero_division=0.0).first()
    r1 = EV.binary_metrics(df, zero_division=1.0).first()
    assert (r0["precision"], r0["recall"], r0["f1"]) == (0.0, 0.0, 0.0)
    assert r1["precision"] == 1.0 and r1["recall"] == 0.0
    one = spark.createDataFrame([(False, True), (False, False)], "label boolean, is_anomaly boolean")
    assert EV.binary_metrics(one).first()["roc_auc_binary"] is None
    cm = {(r["actual"], r["predicted"]): r["n"] for r in EV.confusion_matrix(df).collect()}
    assert cm == {(True, True): 0, (False, True): 0, (True, False): 2, (False, False): 2}


def test_roc_with_ties(spark):
    rows = [(0.9, True), (0.8, True), (0.8, False), (0.5, False), (0.5, True), (0.1, False)]
    df = spark.createDataFrame(rows, "anomaly_score double, label boolean")
    cur = EV.roc_curve(df, "label")
    pts = sorted((r["fpr"], r["tpr"]) for r in cur.collect())
    assert pts == [(0.0, 1 / 3), (1 / 3, 2 / 3), (2 / 3, 1.0), (1.0, 1.0)]
    auc = EV.roc_auc(cur).first()["auc"]
    # trapezoids: (0,0)-(0,1/3), (0,1/3)-(1/3,2/3), (1/3,2/3)-(2/3,1), (2/3,1)-(1,1)
    assert auc == pytest.approx(0 + (1 / 3) * (1 / 3 + 2 / 3) / 2 + (1 / 3) * (2 / 3 + 1) / 2 + (1 / 3) * 1)
    # groups, a NULL group among them, get a curve each
    both = df.selectExpr("'a' AS model", "*").union(df.selectExpr("cast(NULL AS string) AS model", "*"))
    split = EV.roc_curve(both, "label", by=["model"])
    assert sorted((r["fpr"], r["tpr"]) for r in split.where("model IS NULL").collect()) == pts
    assert [round(r["auc"], 9) for r in EV.roc_auc(split, ["model"]).collect()] == [round(auc, 9)] * 2


def test_box_stats_linear_quantiles(spark):
    df = spark.createDataFrame([(1, float(v)) for v in [1, 2, 3, 4, 100]], "score int, v double")
    b = RP.box_stats(df, "v", "score").first()
    assert (b["q1"], b["med"], b["q3"]) == (2.0, 3.0, 4.0)
    assert (b["whisker_lo"], b["whisker_hi"], b["n_outliers"]) == (1.0, 4.0, 1)


def test_learning_curve_failure_rows_and_summary(spark):
    df = spark.range(60).select(F.col("id").alias("row_id"), (F.col("id") % 7).cast("double").alias("x"),
                                (F.col("id") % 10 == 0).alias("label"))
    ok = TU.learning_curves(df, "hbos", {"n_bins": 5}, "label", cols=["x"], train_sizes=(0.5, 1.0), k_folds=2)
    bad = TU.learning_curves(df, "hbos", {"n_bins": -1}, "label", cols=["x"], train_sizes=(1.0,), k_folds=2)
    assert bad.where("score IS NULL AND error IS NOT NULL").count() == bad.count() == 4
    summ = {r["model"]: r for r in TU.learning_curve_summary(ok.unionByName(
        bad.withColumn("model", F.lit("broken")))).collect()}
    assert summ["hbos"]["final_train_size"] == 1.0 and summ["hbos"]["final_test_score"] is not None
    assert summ["broken"]["final_test_score"] is None


def test_score_kde_integrates_to_one(spark):
    import numpy as np
    rng = np.random.default_rng(3)
    df = spark.createDataFrame([("m", float(v)) for v in rng.normal(size=2000)], "model string, anomaly_score double")
    k = sorted((r["x"], r["density"]) for r in RP.score_kde(df, grid_points=400).collect())
    xs, ds = np.array([a for a, _ in k]), np.array([b for _, b in k])
    assert abs(np.trapezoid(ds, xs) - 1.0) < 0.01
    assert abs(xs[ds.argmax()]) < 0.3
