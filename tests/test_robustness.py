"""Ties, NULL, NaN, infinities and far-off points, each against hand-computed answers."""

import math

import pytest
from pyspark.sql import functions as F

from reviewlens.operators import report as RP
from reviewlens.operators.dbscan import dbscan
from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.neighbors import knn_join, radius_counts
from reviewlens.operators.prepare import stratified_cap
from reviewlens.operators.profile import _profile
from reviewlens.operators.ranking import exact_quantiles, rank_select
from reviewlens.operators.scaling import Scaler
from reviewlens.operators.text import text_features
from reviewlens.sources.store import table_fingerprint


def test_knn_takes_the_smallest_ids_among_equal_distances(spark):
    ring = [(i, [math.cos(i), math.sin(i)]) for i in range(200)]
    corpus = spark.createDataFrame([(i, [1.0, 0.0] if i % 2 else [-1.0, 0.0]) for i, _ in ring], "row_id long, features array<double>")
    query = spark.createDataFrame([(1000, [0.0, 0.0])], "row_id long, features array<double>")
    got = knn_join(query, corpus, 3, block_rows=64).orderBy("rank").collect()
    assert [r["neighbor_id"] for r in got] == [0, 1, 2]


def test_distances_far_from_the_origin(spark):
    x = spark.createDataFrame([(0, [1e8]), (1, [1e8 + 0.5]), (2, [1e8 + 1.0])], "row_id long, features array<double>")
    got = {r["id"]: r["n_within"] for r in radius_counts(x, x, 0.6).collect()}
    assert got == {0: 2, 1: 3, 2: 2}
    near = knn_join(x, x, 1).collect()
    assert {r["id"]: r["neighbor_id"] for r in near} == {0: 1, 1: 0, 2: 1}


def test_dbscan_follows_long_chains(spark):
    x = spark.range(150).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("x"))
    r = dbscan(x, cols=["x"], eps=1.0, min_samples=2, scale=False)
    assert [tuple(c) for c in r.labels.groupBy("cluster").count().collect()] == [(0, 150)]
    assert r.rounds < 30                      # far fewer than hops along the chain


def test_cap_keeps_the_null_stratum(spark):
    df = spark.range(9300).select(F.col("id").alias("row_id"), F.nullif(F.col("id") % 310, F.lit(0)).alias("s"))
    got = {r["s"]: r["count"] for r in stratified_cap(df, "s", 4650).groupBy("s").count().collect()}
    assert len(got) == 310 and set(got.values()) == {15} and None in got


def test_quantiles_over_infinities(spark):
    inf = float("inf")
    vals = [-inf] * 300 + [float(i) for i in range(1001)] + [inf] * 300
    df = spark.createDataFrame([(v,) for v in vals], "v double")
    q = exact_quantiles(df, "v", [0.0, 0.5, 0.9, 1.0], max_collect=50)[()]
    assert q == [-inf, 500.0, inf, inf]
    big = spark.createDataFrame([(-1.7e308,), (0.0,), (1.7e308,)] * 40, "v double")
    assert exact_quantiles(big, "v", [0.1, 0.5, 0.9], max_collect=5)[()] == [-1.7e308, 0.0, 1.7e308]


def test_ranks_of_integers_that_doubles_cannot_tell_apart(spark):
    base = 1 << 60
    df = spark.range(500).select((F.lit(base) + F.col("id")).alias("k"))
    got = rank_select(df, ["k"], [((), 0), ((), 123), ((), 499)], max_collect=4)
    assert [got[(), r][0] - base for r in (0, 123, 499)] == [0, 123, 499]


def test_correlation_skips_nan_pairwise(spark):
    nan = float("nan")
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 6.0), (4.0, nan), (nan, 1.0), (5.0, None)], "a double, b double")
    assert RP.correlation_matrix(df, ["a", "b"]).first()["r"] == pytest.approx(1.0)


def test_box_statistics_keep_the_null_group(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), (1, 5.0)], "g int, v double")
    got = {r["g"]: (r["med"], r["n"]) for r in RP.box_stats(df, "v", "g").collect()}
    assert got == {None: (2.0, 2), 1: (5.0, 1)}


def test_fingerprint_tells_nulls_names_and_types_apart(spark):
    rows = [[("x", None)], [(None, "x")]]
    a, b = (spark.createDataFrame(r, "p string, q string") for r in rows)
    prints = {table_fingerprint(a), table_fingerprint(b), table_fingerprint(a.toDF("p", "r"))}
    assert len(prints) == 3 and table_fingerprint(a) == table_fingerprint(a.repartition(3))


def test_scaler_refuses_nan_and_sees_constants(spark):
    df = spark.range(90).select(F.col("id").alias("row_id"), F.col("id").cast("double").alias("a"),
                                F.when(F.col("id") == 3, float("nan")).otherwise(1.0).alias("b"),
                                (F.col("id") * 0.0 + 7).alias("c"))
    with pytest.raises(ValueError, match="b"):
        Scaler.fit(df, FeatureSpec.of(df, ["a", "b"]))
    spec = FeatureSpec.of(df, ["a", "c"])
    assert Scaler.fit(df.repartition(7), spec).kept_names == ["a"]
    assert _profile(df.repartition(7), spec)[1][1]["var"] == 0.0


def test_text_mode_is_explicit(spark):
    df = spark.createDataFrame([(1, "a b"), (2, "b c")], "id long, t string")
    assert text_features(df, "id", "t", 3)[1] == "tfidf" and text_features(df, "id", "t", 3, "hash")[1] == "hash"
    with pytest.raises(ValueError):
        text_features(df, "id", "t", 3, "auto")
