"""Feature cache, result, tuning and curve sinks, masks, feature subsets, fit-and-transform."""

import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators.dbn import dbn_fit_transform, random_feature_subset
from reviewlens.operators.evaluate import prefix_sums
from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.reduce import array_sums
from reviewlens.operators.scaling import Scaler
from reviewlens.operators.text import hashing_features
from reviewlens.sources import store as S


def test_feature_cache_builds_once(spark, tmp_path):
    df = spark.range(20).withColumn("v", F.col("id") * 2)
    built = []

    def build():
        built.append(1)
        return df.withColumn("w", F.col("v") + 1)
    first = S.feature_cache(spark, str(tmp_path), df, {"text": 3, "summary": 1}, build)
    again = S.feature_cache(spark, str(tmp_path), df.repartition(5), {"summary": 1, "text": 3}, build)
    assert len(built) == 1 and sorted(map(tuple, again.collect())) == sorted(map(tuple, first.collect()))
    S.feature_cache(spark, str(tmp_path), df, {"text": 4, "summary": 1}, build)
    S.feature_cache(spark, str(tmp_path), df.where("id > 0"), {"text": 3, "summary": 1}, build)
    assert len(built) == 3


def test_results_come_back_with_parameters_and_time(spark, tmp_path):
    flags = spark.createDataFrame([("lof", 1, 0.5, True), ("lof", 2, 0.1, False), ("hbos", 1, 3.0, True)],
                                  "model string, row_id long, anomaly_score double, is_anomaly boolean")
    metrics = spark.createDataFrame([("lof", 0.5, 0.25)], "model string, precision double, recall double")
    S.write_model_results(flags, str(tmp_path), metrics, {"k": 5})
    got = {(r["model"], r["row_id"]): r for r in S.read_model_results(spark, str(tmp_path)).collect()}
    assert len(got) == 3 and json.loads(got["lof", 1]["params"]) == {"k": 5} and got["lof", 2]["timestamp"][4] == "-"
    assert got["hbos", 1]["params"] is None and got["hbos", 1]["is_anomaly"]
    assert S.read_model_results(spark, str(tmp_path), "lof").count() == 2
    S.write_model_results(flags, str(tmp_path / "bare"))
    assert {r["params"] for r in S.read_model_results(spark, str(tmp_path / "bare")).collect()} == {None}


@pytest.mark.parametrize("write,detail,summary", [(S.write_tuning_results, "tuning_detail", "tuning_summary"),
                                                  (S.write_learning_curves, "learning_curves", "learning_curve_summary")])
def test_detail_as_json_and_summary_as_csv(spark, tmp_path, write, detail, summary):
    rows = spark.createDataFrame([("hbos", 0, 0.5), ("hbos", 1, None)], "model string, fold int, score double")
    write(rows, str(tmp_path), rows.groupBy("model").agg(F.avg("score").alias("best")))
    back = spark.read.json(os.path.join(tmp_path, detail))
    assert sorted((r["fold"], r["score"]) for r in back.select("fold", "score").collect()) == [(0, 0.5), (1, None)]
    line = spark.read.option("header", True).csv(os.path.join(tmp_path, summary)).first()
    assert (line["model"], line["best"]) == ("hbos", "0.5")
    write(rows.limit(0), str(tmp_path / "bare"))
    assert not os.path.exists(tmp_path / "bare" / summary)


def test_a_mask_keeps_its_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 5.0, 9.0]), (2, [2.0, 5.0, 7.0])], "row_id long, v array<double>")
    part = FeatureSpec.of(df, vector="v").slice([0, 2])
    assert part.names == ["v[0]", "v[2]"] and part.dim == 2
    assert [tuple(r) for r in df.orderBy("row_id").select(*part.exprs(df)).collect()] == [(1.0, 9.0), (2.0, 7.0)]
    sc = Scaler.fit(df, FeatureSpec.of(df, vector="v"))
    assert sc.kept == [0, 2]
    assert [r["features"] for r in sc.transform(df).orderBy("row_id").collect()] == [[-1.0, 1.0], [1.0, -1.0]]


def test_random_feature_subset():
    assert random_feature_subset(10, 1.0) == list(range(10)) and random_feature_subset(10, 0.01) == random_feature_subset(10, 0.1)
    some = random_feature_subset(50, 0.8, seed=3)
    assert len(some) == 40 == len(set(some)) and some == sorted(some) == random_feature_subset(50, 0.8, seed=3)
    assert some != random_feature_subset(50, 0.8, seed=4)


def test_fit_transform_is_fit_then_transform(spark):
    X = np.random.default_rng(0).random((60, 8))
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(X)], "row_id long, features array<double>")
    m, out = dbn_fit_transform(df, hidden_layers=[4, 2], layer_configs=[{"n_iter": 2}] * 2, feature_subset_ratio=0.5)
    assert len(m.feature_indices) == 4 and m.layers[0].W.shape == (4, 4)
    rows = {r["row_id"]: r["dbn_features"] for r in out.collect()}
    assert rows == {r["row_id"]: r["dbn_features"] for r in m.transform(df).collect()}
    H = ((X - X.min(0)) / (X.max(0) - X.min(0)))[:, m.feature_indices]
    for layer in m.layers:
        H = 1 / (1 + np.exp(-(H @ layer.W.T + layer.b_hidden)))
    assert np.allclose([rows[i] for i in range(60)], H)


def test_array_sums(spark):
    df = spark.range(100, numPartitions=40).select(F.lit(1).cast("long").alias("n"), F.array(F.col("id").cast("double"), F.lit(1.0)).alias("a"))
    n, (a,) = array_sums(df, ["a"])
    assert n == 100 and a.tolist() == [4950.0, 100.0]
    assert array_sums(df.limit(0), ["a"])[0] == 0


def test_hashed_features_have_norm_one(spark):
    df = spark.createDataFrame([(1, "one two two three"), (2, "four"), (3, ""), (4, None)], "id long, t string")
    rows = hashing_features(df, "id", "t", 16).collect()
    assert {r["id"] for r in rows} == {1, 2}
    assert all(abs(sum(r["weight"] ** 2 for r in rows if r["id"] == i) - 1) < 1e-12 for i in (1, 2))


def test_running_sums_per_group_over_many_batches(spark):
    rows = [(g, i, i % 5) for g in ("a", "b", None) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, k long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
    try:
        got = {(r["g"], r["k"]): r["v_cum"] for r in prefix_sums(df, ["g"], "k", ["v"], partitions=3).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want, total = {}, {}
    for g, i, v in rows:
        total[g] = total.get(g, 0) + v
        want[g, i] = total[g]
    assert got == want
