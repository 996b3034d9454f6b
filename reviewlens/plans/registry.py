"""Registered queries: name -> (spark callable, DuckDB oracle SQL or None).

Every query reads the driver's tables (or data Spark derives from them), so
its work grows with the scale factor. ``__spark_entry__`` exposes this
registry to the driver.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.hbos import HBOSModel
from reviewlens.operators.prepare import NUMERIC_FEATURES
from reviewlens.operators.report import anomaly_by_rating
from reviewlens.plans import oracle_sql as O
from reviewlens.plans.review_features import review_features
from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.scaling import materialize_and_fit
from reviewlens.session import materialize

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn
    return deco


def _r(c, k=6):
    return F.round(F.col(c), k).alias(c)


# ----------------------------------------------------------------- D1 flagship
@register("d1_hbos_anomaly_by_rating", O.with_(O.FEATURES_CTE, O.hbos_scores_cte()) + """
SELECT score AS rating, is_anomaly, count(*) AS n_reviews FROM hf GROUP BY 1, 2""")
def d1_hbos_anomaly_by_rating(spark, sf):
    # feature table written once; scaler statistics observed by the same job
    f, sc = materialize_and_fit(review_features(spark, sf), FeatureSpec(tuple(NUMERIC_FEATURES), None,
                                                                       len(NUMERIC_FEATURES)))
    m = HBOSModel.fit(f, cols=NUMERIC_FEATURES, scaler=sc)
    return anomaly_by_rating(m.transform(f), "score")


# ----------------------------------------------------------------- helpers
import uuid  # noqa: E402

from reviewlens.functions.scalar import (days_since, display_name, epoch_to_timestamp, flag_label,  # noqa: E402
                                         helpfulness_parts, helpfulness_ratio, review_length,
                                         unix_time, whole_days_since)
from reviewlens.operators import evaluate as EV  # noqa: E402
from reviewlens.operators import prepare as PR  # noqa: E402
from reviewlens.operators import profile as PF  # noqa: E402
from reviewlens.operators import report as RP  # noqa: E402
from reviewlens.operators import tuning as TN  # noqa: E402
from reviewlens.operators.dbscan import dbscan  # noqa: E402
from reviewlens.operators.neighbors import knn_join  # noqa: E402
from reviewlens.operators.ranking import exact_quantiles  # noqa: E402
from reviewlens.operators.detector_store import load_detector, save_detector  # noqa: E402
from reviewlens.session import scratch_path  # noqa: E402
from reviewlens.sources.store import read_model_metrics, write_metrics  # noqa: E402
from reviewlens.sources.tables import scan_books, scan_reviews, with_ids  # noqa: E402
from reviewlens.operators.features import FeatureSpec  # noqa: E402
from reviewlens.plans import bindings  # noqa: E402
from reviewlens.plans.review_features import reviews_with_books  # noqa: E402

FEAT_SQL_LIST = ", ".join(NUMERIC_FEATURES)


def _hbos_flags(spark, sf):
    f, sc = materialize_and_fit(review_features(spark, sf), FeatureSpec(tuple(NUMERIC_FEATURES), None,
                                                                       len(NUMERIC_FEATURES)))
    m = HBOSModel.fit(f, cols=NUMERIC_FEATURES, scaler=sc)
    return f, m, m.transform(f)


# ----------------------------------------------------------------- P1-P7
@register("p_review_columns", O.with_(O.JOINED_CTE, "t0 AS (SELECT min(review_time) AS t0 FROM m)") + """
SELECT m.score AS rating,
       TRY_CAST(split_part(helpfulness, '/', 1) AS DOUBLE) AS helpfulness_numerator,
       TRY_CAST(split_part(helpfulness, '/', 2) AS DOUBLE) AS helpfulness_denominator,
       round(helpfulness_ratio, 6) AS helpfulness_ratio,
       CAST(length(review_text) AS BIGINT) AS review_length,
       round(CAST(epoch_us(review_time) - epoch_us(t0) AS DOUBLE) / 86400000000.0, 6) AS days_since_first,
       CAST(floor(CAST(epoch_us(review_time) - epoch_us(t0) AS DOUBLE) / 86400000000.0) AS BIGINT) AS whole_days_since_first,
       CAST(epoch_us(review_time) // 1000000 AS BIGINT) AS unix_review_time
FROM m CROSS JOIN t0""")
def p_review_columns(spark, sf):
    m = reviews_with_books(spark, sf)
    t0 = PR.first_time(m)
    t0c = F.timestamp_micros(F.lit(t0))
    a, b = helpfulness_parts("helpfulness")
    return m.select(F.col("score").alias("rating"), a.alias("helpfulness_numerator"),
                    b.alias("helpfulness_denominator"),
                    F.round(helpfulness_ratio("helpfulness"), 6).alias("helpfulness_ratio"),
                    review_length("review_text").alias("review_length"),
                    F.round(days_since("review_time", t0c), 6).alias("days_since_first"),
                    whole_days_since("review_time", t0c).alias("whole_days_since_first"),
                    unix_time("review_time").alias("unix_review_time"))


# ----------------------------------------------------------------- J1
@register("j1_review_book_join", O.with_(O.JOINED_CTE) + """
SELECT categories, count(*) AS n_reviews, sum(score) AS sum_score,
       round(avg(ratings_count), 6) AS avg_ratings_count, count(DISTINCT title) AS n_books
FROM m GROUP BY categories""")
def j1_review_book_join(spark, sf):
    m = reviews_with_books(spark, sf)
    return m.groupBy("categories").agg(F.count("*").alias("n_reviews"), F.sum("score").alias("sum_score"),
                                       F.round(F.avg("ratings_count"), 6).alias("avg_ratings_count"),
                                       F.count_distinct("title").alias("n_books"))


@register("j1_fanout_by_name", """
WITH rv AS (SELECT p.p_name AS book_name FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey)
SELECT rv.book_name, count(*) AS joined_rows
FROM rv JOIN part b ON rv.book_name IS NOT DISTINCT FROM b.p_name GROUP BY rv.book_name""")
def j1_fanout_by_name(spark, sf):
    r = bindings.reviews(spark, sf).join(bindings.books(spark, sf).select("title", "book_name"), "title")
    b = bindings.books(spark, sf)
    return PR.join_fanout_counts(r.select("book_name"), b.select("book_name"), "book_name") \
        .select("book_name", "joined_rows")


# ----------------------------------------------------------------- A1, F1
@register("a1_mean_impute", O.with_(O.JOINED_CTE, """
mi AS (SELECT NULLIF(score, 7.0) AS s, CASE WHEN ratings_count > 45 THEN NULL ELSE ratings_count END AS rc FROM m),
mv AS (SELECT avg(s) AS ms, avg(rc) AS mr FROM mi)""") + """
SELECT round(coalesce(s, ms), 6) AS score_imputed, count(*) AS n_reviews,
       round(sum(coalesce(rc, mr)), 4) AS sum_ratings_count
FROM mi CROSS JOIN mv GROUP BY 1""")
def a1_mean_impute(spark, sf):
    m = reviews_with_books(spark, sf).select(
        F.nullif(F.col("score"), F.lit(7.0)).alias("score"),
        F.when(F.col("ratings_count") > 45, F.lit(None)).otherwise(F.col("ratings_count")).alias("ratings_count"))
    imp, _ = PR.mean_impute(m, ["score", "ratings_count"])
    imp = PR.drop_missing(imp, ["score", "ratings_count"])
    return imp.groupBy(F.round("score", 6).alias("score_imputed")).agg(
        F.count("*").alias("n_reviews"), F.round(F.sum("ratings_count"), 4).alias("sum_ratings_count"))


# ----------------------------------------------------------------- J2, A3, A4
@register("j2_user_activity", O.with_(O.JOINED_CTE, """
mu AS (SELECT CASE WHEN review_text = '5-LOW' THEN NULL ELSE user_id END AS u FROM m),
uc AS (SELECT u, count(*) AS c FROM mu WHERE u IS NOT NULL GROUP BY u)""") + """
SELECT coalesce(uc.c, 0) AS user_review_count, count(*) AS n_reviews
FROM mu LEFT JOIN uc ON mu.u = uc.u GROUP BY 1""")
def j2_user_activity(spark, sf):
    # reviews of '5-LOW' orders have no user (exercises NULL users -> count 0)
    m = reviews_with_books(spark, sf).select(
        F.when(F.col("review_text") == "5-LOW", F.lit(None)).otherwise(F.col("user_id")).alias("user_id"))
    a = PR.user_activity(m, "user_id")
    return a.groupBy("user_review_count").agg(F.count("*").alias("n_reviews"))


@register("a3_user_counts", O.with_(O.JOINED_CTE) + """
SELECT user_id, count(*) AS user_review_count FROM m WHERE user_id IS NOT NULL GROUP BY user_id""")
def a3_user_counts(spark, sf):
    return PR.user_counts(reviews_with_books(spark, sf), "user_id")


@register("a4_first_review_time", O.with_(O.JOINED_CTE) + """
SELECT min(review_time) AS first_review_time, max(review_time) AS last_review_time, count(*) AS n_reviews FROM m""")
def a4_first_review_time(spark, sf):
    m = reviews_with_books(spark, sf)
    return m.agg(F.min("review_time").alias("first_review_time"), F.max("review_time").alias("last_review_time"),
                 F.count("*").alias("n_reviews"))


# ----------------------------------------------------------------- O1, O2, O8
_RANK_ORDER_SQL = "rk, " + ", ".join(bindings.TIE_COLS) + ", review_time"


@register("o1_stratified_cap", O.with_(O.JOINED_CTE, f"""
mk AS (SELECT m.*, {bindings.RANK_KEY_SQL} AS rk FROM m),
tot AS (SELECT count(*) // 4 AS cap, count(*) AS n FROM mk),
gc AS (SELECT score, count(*) AS ng FROM mk GROUP BY score),
rn AS (SELECT mk.*, row_number() OVER (PARTITION BY mk.score ORDER BY {_RANK_ORDER_SQL}) AS r FROM mk)""") + """
SELECT rn.score AS rating, count(*) AS n_kept, round(sum(price), 2) AS sum_price, min(rk) AS min_rk, max(rk) AS max_rk
FROM rn JOIN gc ON rn.score = gc.score CROSS JOIN tot
WHERE rn.r <= (tot.cap * gc.ng) // tot.n GROUP BY rn.score""")
def o1_stratified_cap(spark, sf):
    m, order = bindings.with_rank_cols(reviews_with_books(spark, sf))
    m = materialize(m.select("score", "price", *dict.fromkeys(c for c in order if c != "price")))
    cap = m.count() // 4
    s = PR.stratified_cap(m, "score", cap, order_cols=order)
    return s.groupBy(F.col("score").alias("rating")).agg(
        F.count("*").alias("n_kept"), F.round(F.sum("price"), 2).alias("sum_price"),
        F.min("rk").alias("min_rk"), F.max("rk").alias("max_rk"))


@register("o2_train_test_split", O.with_(O.JOINED_CTE, f"""
mk AS (SELECT m.*, {bindings.RANK_KEY_SQL} AS rk FROM m),
rn AS (SELECT mk.*, row_number() OVER (ORDER BY {_RANK_ORDER_SQL}) AS r, count(*) OVER () AS n FROM mk)""") + """
SELECT r <= CAST(ceil(n * 0.2) AS BIGINT) AS is_test, count(*) AS n_rows, round(sum(price), 2) AS sum_price
FROM rn GROUP BY 1""")
def o2_train_test_split(spark, sf):
    m, order = bindings.with_rank_cols(reviews_with_books(spark, sf))
    m = materialize(m.select("price", *dict.fromkeys(c for c in order if c != "price")))
    s = PR.train_test_split(m, 0.2, order_cols=order)
    return s.groupBy("is_test").agg(F.count("*").alias("n_rows"), F.round(F.sum("price"), 2).alias("sum_price"))


@register("o8_kfold", O.with_(O.JOINED_CTE) + f"""
SELECT CAST(({bindings.RANK_KEY_SQL}) % 3 AS INTEGER) AS fold, count(*) AS n_rows, round(sum(price), 2) AS sum_price FROM m GROUP BY 1""")
def o8_kfold(spark, sf):
    f = PR.kfold(reviews_with_books(spark, sf), 3, key=F.expr(bindings.RANK_KEY_SQL))
    return f.groupBy("fold").agg(F.count("*").alias("n_rows"), F.round(F.sum("price"), 2).alias("sum_price"))


@register("o1_null_and_many_strata", O.with_(O.JOINED_CTE, f"""
mk AS (SELECT m.*, nullif(m.title % 401, 0) AS stratum, {bindings.RANK_KEY_SQL} AS rk FROM m),
tot AS (SELECT count(*) // 3 AS cap, count(*) AS n FROM mk),
gc AS (SELECT stratum, count(*) AS ng FROM mk GROUP BY stratum),
rn AS (SELECT mk.*, row_number() OVER (PARTITION BY mk.stratum ORDER BY {_RANK_ORDER_SQL}) AS r FROM mk)""") + """
SELECT rn.stratum, count(*) AS n_kept, round(sum(price), 2) AS sum_price
FROM rn JOIN gc ON rn.stratum IS NOT DISTINCT FROM gc.stratum CROSS JOIN tot
WHERE rn.r <= (tot.cap * gc.ng) // tot.n GROUP BY rn.stratum""")
def o1_null_and_many_strata(spark, sf):
    m, order = bindings.with_rank_cols(reviews_with_books(spark, sf))
    m = m.withColumn("stratum", F.nullif(F.col("title") % 401, F.lit(0)))
    m = materialize(m.select("stratum", "price", *dict.fromkeys(c for c in order if c != "price")))
    s = PR.stratified_cap(m, "stratum", m.count() // 3, order_cols=order)
    return s.groupBy("stratum").agg(F.count("*").alias("n_kept"), F.round(F.sum("price"), 2).alias("sum_price"))


@register("o7_quantiles_with_infinities", """
WITH v AS (SELECT l_linestatus AS grp, CASE WHEN l_linenumber = 7 THEN 'inf'::DOUBLE WHEN l_linenumber = 6 THEN '-inf'::DOUBLE
                  WHEN l_linenumber = 5 THEN NULL ELSE l_extendedprice END AS v FROM lineitem)
SELECT grp, round(quantile_cont(v, 0.25), 4) AS q25, round(quantile_cont(v, 0.5), 4) AS q50,
       round(quantile_cont(v, 0.75), 4) AS q75, max(v) AS top FROM v GROUP BY grp""")
def o7_quantiles_with_infinities(spark, sf):
    n = F.col("l_linenumber")
    v = materialize(bindings.scan_table(spark, sf, "lineitem").select(
        F.col("l_linestatus").alias("grp"),
        F.when(n == 7, F.lit(float("inf"))).when(n == 6, F.lit(float("-inf"))).when(n == 5, F.lit(None))
        .otherwise(F.col("l_extendedprice")).alias("v")))
    q = exact_quantiles(v, "v", [0.25, 0.5, 0.75, 1.0], ["grp"], max_collect=500)
    out = spark.createDataFrame([(g[0], *x) for g, x in q.items()], "grp string, q25 double, q50 double, q75 double, top double")
    return out.select("grp", _r("q25", 4), _r("q50", 4), _r("q75", 4), "top")


@register("o5_best_params", """
WITH s AS (SELECT l_returnflag AS model, l_linenumber AS grid_index, 'bins=' || l_linenumber AS params, l_suppkey % 3 AS fold,
                  avg(l_discount) AS score FROM lineitem GROUP BY ALL),
m AS (SELECT model, grid_index, params, avg(score) AS a, stddev_pop(score) AS d FROM s GROUP BY ALL)
SELECT model, grid_index, params, round(a, 9) AS mean_test_score, round(d, 9) AS std_test_score FROM m
QUALIFY row_number() OVER (PARTITION BY model ORDER BY a DESC, grid_index) = 1""")
def o5_best_params(spark, sf):
    s = bindings.scan_table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), F.col("l_linenumber").alias("grid_index"),
        F.concat(F.lit("bins="), "l_linenumber").alias("params"), (F.col("l_suppkey") % 3).alias("fold")) \
        .agg(F.avg("l_discount").alias("score"))
    return TN.best_params(s).select("model", "grid_index", "params", _r("mean_test_score", 9), _r("std_test_score", 9))


_CURVES_SQL = """
WITH g AS (SELECT l_returnflag AS model, l_linenumber / 10.0 AS train_size, l_suppkey % 2 AS fold,
                  CASE WHEN l_quantity < 25 THEN 'train' ELSE 'test' END AS split, avg(l_tax) AS s FROM lineitem GROUP BY ALL),
c AS (SELECT model, train_size, fold, split, CASE WHEN model = 'A' THEN NULL ELSE s END AS score FROM g)"""


def _curves(spark, sf):
    """Learning-curve rows made of lineitem means; model 'A' failed throughout."""
    return bindings.scan_table(spark, sf, "lineitem").groupBy(
        F.col("l_returnflag").alias("model"), (F.col("l_linenumber") / 10.0).alias("train_size"),
        (F.col("l_suppkey") % 2).alias("fold"), F.when(F.col("l_quantity") < 25, "train").otherwise("test").alias("split")) \
        .agg(F.avg("l_tax").alias("score")).withColumn("score", F.when(F.col("model") != "A", F.col("score")))


@register("a22_fold_stats", _CURVES_SQL + """
SELECT model, CAST(train_size AS DOUBLE) AS train_size, split, round(avg(score), 9) AS mean_score, round(stddev_pop(score), 9) AS std_score
FROM c GROUP BY ALL""")
def a22_fold_stats(spark, sf):
    return TN.curve_stats(_curves(spark, sf)).select("model", F.col("train_size").cast("double").alias("train_size"), "split",
                                                     _r("mean_score", 9), _r("std_score", 9))


@register("a26_learning_curve_summary", _CURVES_SQL + """,
l AS (SELECT c.* FROM c JOIN (SELECT model, max(train_size) AS t FROM c GROUP BY 1) x ON c.model = x.model AND c.train_size = x.t)
SELECT model, CAST(max(train_size) AS DOUBLE) AS final_train_size,
       round(avg(score) FILTER (split = 'train'), 9) AS final_train_score,
       round(avg(score) FILTER (split = 'test'), 9) AS final_test_score,
       round(avg(score) FILTER (split = 'train') - avg(score) FILTER (split = 'test'), 9) AS gap FROM l GROUP BY model""")
def a26_learning_curve_summary(spark, sf):
    s = TN.learning_curve_summary(_curves(spark, sf))
    return s.select("model", F.col("final_train_size").cast("double").alias("final_train_size"),
                    _r("final_train_score", 9), _r("final_test_score", 9), _r("gap", 9))


@register("p2_epoch_to_timestamp", """
SELECT o_orderpriority, min(to_timestamp(epoch(o_orderdate)::BIGINT)::TIMESTAMP) AS first_time,
       max(to_timestamp(epoch(o_orderdate)::BIGINT)::TIMESTAMP) AS last_time, count(*) AS n FROM orders GROUP BY 1""")
def p2_epoch_to_timestamp(spark, sf):
    t = epoch_to_timestamp(unix_time("o_orderdate"))
    return bindings.scan_table(spark, sf, "orders").groupBy("o_orderpriority").agg(
        F.min(t).alias("first_time"), F.max(t).alias("last_time"), F.count("*").alias("n"))


@register("a14_correlation_with_nan", """
WITH v AS (SELECT l_quantity AS a, CASE WHEN l_linenumber = 1 THEN NULL ELSE l_extendedprice END AS b,
                  CASE WHEN l_linenumber = 2 THEN NULL ELSE l_discount END AS c FROM lineitem)
SELECT 'b' AS feature_a, 'a' AS feature_b, round(corr(b, a), 6) AS r FROM v
UNION ALL SELECT 'c', 'a', round(corr(c, a), 6) FROM v UNION ALL SELECT 'c', 'b', round(corr(c, b), 6) FROM v""")
def a14_correlation_with_nan(spark, sf):
    n, nan = F.col("l_linenumber"), F.lit(float("nan"))
    v = bindings.scan_table(spark, sf, "lineitem").select(
        F.col("l_quantity").alias("a"), F.when(n == 1, nan).otherwise(F.col("l_extendedprice")).alias("b"),
        F.when(n == 2, nan).otherwise(F.col("l_discount")).alias("c"))
    return RP.correlation_matrix(v, ["a", "b", "c"]).select("feature_a", "feature_b", _r("r"))


@register("j4_knn_ties", """
WITH d AS (SELECT a.p_partkey AS id, b.p_partkey AS neighbor_id, abs(a.p_size - b.p_size)::DOUBLE AS dist
           FROM part a JOIN part b ON a.p_partkey <> b.p_partkey)
SELECT id, neighbor_id, dist, CAST(row_number() OVER (PARTITION BY id ORDER BY dist, neighbor_id) AS INTEGER) AS rank FROM d
QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, neighbor_id) <= 3""")
def j4_knn_ties(spark, sf):
    p = bindings.scan_table(spark, sf, "part").select("p_partkey", F.array(F.col("p_size").cast("double")).alias("v"))
    return knn_join(p, p, 3, "p_partkey", "v", block_rows=512)


@register("d5_dbscan_long_chains", """
WITH x AS (SELECT p_partkey AS id, p_partkey + 10 * (p_partkey // 700) AS x FROM part),
g AS (SELECT id, CASE WHEN x - lag(x) OVER (ORDER BY x) <= 1 THEN 0 ELSE 1 END AS cut FROM x),
c AS (SELECT id, sum(cut) OVER (ORDER BY id) AS island FROM g)
SELECT min(id) AS cluster, count(*) AS n FROM c GROUP BY island HAVING count(*) > 1""")
def d5_dbscan_long_chains(spark, sf):
    key = F.col("p_partkey")
    x = bindings.scan_table(spark, sf, "part").select(key.alias("row_id"), (key + 10 * F.floor(key / 700)).cast("double").alias("x"))
    r = dbscan(x, cols=["x"], eps=1.0, min_samples=2, scale=False, block_rows=512)
    return r.labels.where("cluster is not null").groupBy("cluster").agg(F.count("*").alias("n"))


@register("s1_csv_chain", O.with_(O.FEATURES_CTE) + """
SELECT score, count(*) AS n_reviews, round(sum(review_length), 4) AS sum_length, round(avg(helpfulness_ratio), 6) AS mean_helpfulness,
       sum(user_review_count) AS sum_activity, round(max(days_since_first), 6) AS last_day FROM f GROUP BY score""")
def s1_csv_chain(spark, sf):
    """Given tables landed as CSV in the reference's shape, then scan -> load -> features."""
    base = scratch_path(spark, uuid.uuid4().hex)
    r = bindings.reviews(spark, sf).select(
        F.col("row_id").alias("Id"), F.col("title").alias("Title"), F.lit(None).cast("string").alias("Price"),
        F.col("user_id").alias("User_id"), F.lit(None).cast("string").alias("profileName"),
        F.col("helpfulness").alias("review/helpfulness"), F.col("score").alias("review/score"),
        unix_time("review_time").alias("review/time"), F.col("summary").alias("review/summary"),
        F.col("review_text").alias("review/text"))
    none = [F.lit(None).cast("string").alias(c) for c in
            ("description", "authors", "image", "previewLink", "publisher", "publishedDate", "infoLink")]
    b = bindings.books(spark, sf).select(F.col("title").alias("Title"), *none, "categories",
                                         F.col("ratings_count").alias("ratingsCount"))
    r.write.option("header", True).csv(f"{base}/reviews")
    b.write.option("header", True).csv(f"{base}/books")
    reviews = with_ids(scan_reviews(spark, f"{base}/reviews"), "review_id")
    books = with_ids(scan_books(spark, f"{base}/books"), "book_id")
    m, _ = PR.load_reviews(reviews, books)
    f, _ = PR.numeric_features(m)
    return f.groupBy("score").agg(
        F.count("*").alias("n_reviews"), F.round(F.sum("review_length"), 4).alias("sum_length"),
        F.round(F.avg("helpfulness_ratio"), 6).alias("mean_helpfulness"), F.sum("user_review_count").alias("sum_activity"),
        F.round(F.max("days_since_first"), 6).alias("last_day"))


# ----------------------------------------------------------------- A6, A7, A9
_A6_SQL = " UNION ALL ".join(
    f"SELECT '{c}' AS feature, {j} AS feature_index, round(avg({c}), 6) AS mean, round(var_pop({c}), 6) AS variance, "
    f"round(min({c}), 6) AS min, round(max({c}), 6) AS max, round(max({c}) - min({c}), 6) AS range FROM f"
    for j, c in enumerate(NUMERIC_FEATURES))


@register("a6_feature_stats", O.with_(O.FEATURES_CTE) + _A6_SQL)
def a6_feature_stats(spark, sf):
    f = review_features(spark, sf)
    st = PF.feature_stats(f, FeatureSpec.of(f, NUMERIC_FEATURES))
    return st.select("feature", "feature_index", *[_r(c) for c in ("mean", "variance", "min", "max", "range")])


_VARS = " UNION ALL ".join(f"SELECT var_pop({c}) AS v, max({c}) - min({c}) AS rg FROM f" for c in NUMERIC_FEATURES)


@register("a7_inspect_features", O.with_(O.FEATURES_CTE, f"vv AS ({_VARS})") + f"""
SELECT true AS valid, CAST(NULL AS VARCHAR) AS error, (SELECT count(*) FROM f) AS n_samples,
       {len(NUMERIC_FEATURES)} AS n_features, false AS has_nan, false AS has_inf,
       CAST(0 AS BIGINT) AS nan_count, CAST(0 AS BIGINT) AS inf_count,
       round(avg(v), 6) AS mean_variance, round(min(v), 6) AS min_variance, round(max(v), 6) AS max_variance,
       round(avg(rg), 6) AS mean_range, CAST(count_if(v = 0) AS INTEGER) AS zero_variance_count,
       CAST(count_if(v > 0 AND v < 1e-10) AS INTEGER) AS near_zero_variance_count,
       CAST(count_if(v > 0) AS INTEGER) AS non_zero_variance_count,
       round(count_if(v = 0) * 100.0 / {len(NUMERIC_FEATURES)}, 6) AS zero_variance_percent,
       CASE WHEN count_if(v = 0) = {len(NUMERIC_FEATURES)} THEN 'ALL_ZERO_VARIANCE'
            WHEN count_if(v = 0) > {len(NUMERIC_FEATURES)} * 0.5 THEN 'MAJORITY_ZERO_VARIANCE'
            WHEN count_if(v = 0) > 0 THEN 'SOME_ZERO_VARIANCE' END AS issue
FROM vv""")
def a7_inspect_features(spark, sf):
    f = review_features(spark, sf)
    r = PF.inspect_features(f, FeatureSpec.of(f, NUMERIC_FEATURES))
    return r.select("valid", "error", "n_samples", "n_features", "has_nan", "has_inf", "nan_count", "inf_count",
                    *[_r(c) for c in ("mean_variance", "min_variance", "max_variance", "mean_range")],
                    "zero_variance_count", "near_zero_variance_count", "non_zero_variance_count",
                    _r("zero_variance_percent"), "issue")


@register("a9_preprocess_report", O.with_(O.FEATURES_CTE, f"vv AS ({_VARS})") + f"""
SELECT (SELECT count(*) FROM f) AS n_samples, {len(NUMERIC_FEATURES)} AS n_features,
       CAST(count_if(v = 0) AS INTEGER) AS zero_variance_count,
       CAST(count_if(v > 0 AND v < 1e-10) AS INTEGER) AS near_zero_variance_count,
       CAST(count_if(v > 0) AS INTEGER) AS non_zero_variance_count, count_if(v > 0) = 0 AS needs_noise
FROM vv""")
def a9_preprocess_report(spark, sf):
    f = review_features(spark, sf)
    return PF.preprocess_report(f, FeatureSpec.of(f, NUMERIC_FEATURES)).drop("kept_mask")


# ----------------------------------------------------------------- A10, A12-A14
@register("a10_rating_distribution", O.with_(O.JOINED_CTE) + """
SELECT score AS rating, count(*) AS n_reviews FROM m GROUP BY 1""")
def a10_rating_distribution(spark, sf):
    return RP.rating_distribution(reviews_with_books(spark, sf))


def _box_sql(col: str, src: str = "f") -> str:
    return f"""
bq AS (SELECT score, quantile_cont({col}, 0.25) AS q1, quantile_cont({col}, 0.5) AS med,
              quantile_cont({col}, 0.75) AS q3 FROM {src} GROUP BY score),
cap AS (SELECT quantile_cont({col}, 0.95) AS axis_cap FROM {src})
SELECT {src}.score AS rating, round(bq.q1, 6) AS q1, round(bq.med, 6) AS med, round(bq.q3, 6) AS q3,
       count(*) AS n,
       round(min(CASE WHEN {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {col} END), 6) AS whisker_lo,
       round(max(CASE WHEN {col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1) THEN {col} END), 6) AS whisker_hi,
       CAST(count_if(NOT ({col} BETWEEN q1 - 1.5 * (q3 - q1) AND q3 + 1.5 * (q3 - q1))) AS BIGINT) AS n_outliers,
       round(any_value(cap.axis_cap), 6) AS axis_cap
FROM {src} JOIN bq ON {src}.score = bq.score CROSS JOIN cap
GROUP BY {src}.score, bq.q1, bq.med, bq.q3"""


def _box_spark(df, col):
    b = RP.box_stats(df, col, "score")
    return b.select(F.col("score").alias("rating"), _r("q1"), _r("med"), _r("q3"), "n", _r("whisker_lo"),
                    _r("whisker_hi"), "n_outliers", _r("axis_cap"))


@register("a12_length_by_rating", O.with_(O.FEATURES_CTE) + ",\n" + _box_sql("review_length"))
def a12_length_by_rating(spark, sf):
    return _box_spark(materialize(review_features(spark, sf)), "review_length")


@register("a13_helpfulness_by_rating", O.with_(O.FEATURES_CTE) + ",\n" + _box_sql("helpfulness_ratio"))
def a13_helpfulness_by_rating(spark, sf):
    return _box_spark(materialize(review_features(spark, sf)), "helpfulness_ratio")


_CORR_COLS = ["review_length", "score", "helpfulness_ratio", "user_review_count", "whole_days", "unix_time"]


def _corr_sql() -> str:
    parts = []
    for i in range(len(_CORR_COLS)):
        for j in range(i + 1, len(_CORR_COLS)):
            a, b = _CORR_COLS[j], _CORR_COLS[i]
            parts.append(f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, "
                         f"round(covar_pop({a}, {b}) / sqrt(var_pop({a}) * var_pop({b})), 6) AS r FROM cf")
    return " UNION ALL ".join(parts)


@register("a14_behaviour_correlation", O.with_(O.FEATURES_CTE, """
cf AS (SELECT review_length, score, helpfulness_ratio, user_review_count,
              CAST(floor(days_since_first) AS DOUBLE) AS whole_days,
              CAST(epoch_us(review_time) // 1000000 AS DOUBLE) AS unix_time FROM f)""") + _corr_sql())
def a14_behaviour_correlation(spark, sf):
    f = review_features(spark, sf)
    t0 = PR.first_time(f)
    cf = f.select("review_length", "score", "helpfulness_ratio", "user_review_count",
                  whole_days_since("review_time", F.timestamp_micros(F.lit(t0))).cast("double").alias("whole_days"),
                  unix_time("review_time").cast("double").alias("unix_time"))
    return RP.correlation_matrix(cf, _CORR_COLS).select("feature_a", "feature_b", _r("r"))


# ----------------------------------------------------------------- A5, A11 variants, A15-A21 on HBOS
_HB = O.with_(O.FEATURES_CTE, O.hbos_scores_cte())


@register("a5_dataset_summary", _HB + f"""
SELECT count(*) AS n_rows, {len(NUMERIC_FEATURES)} AS n_features,
       round(avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END) * 100, 6) AS anomaly_pct, 'completed' AS status FROM hf""")
def a5_dataset_summary(spark, sf):
    f, m, fl = _hbos_flags(spark, sf)
    return fl.agg(F.count("*").alias("n_rows"), F.lit(len(m.scaler.kept)).alias("n_features"),
                  F.round(F.avg(F.col("is_anomaly").cast("double")) * 100, 6).alias("anomaly_pct"),
                  F.lit("completed").alias("status"))


@register("p9_flag_labels", _HB + """
SELECT CASE WHEN is_anomaly THEN 'Anomaly' ELSE 'Normal' END AS label, count(*) AS n_reviews FROM hf GROUP BY 1""")
def p9_flag_labels(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    return fl.groupBy(flag_label("is_anomaly").alias("label")).agg(F.count("*").alias("n_reviews"))


@register("a15_model_anomaly_counts", _HB + """
SELECT 'hbos' AS model, 'Hbos' AS display_name, CAST(count_if(is_anomaly) AS BIGINT) AS anomalies, count(*) AS n,
       round(avg(CASE WHEN is_anomaly THEN 1.0 ELSE 0.0 END) * 100, 6) AS anomaly_pct FROM hf""")
def a15_model_anomaly_counts(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    c = RP.model_anomaly_counts(fl.withColumn("model", F.lit("hbos")))
    return c.select("model", display_name("model").alias("display_name"), "anomalies", "n", _r("anomaly_pct"))


@register("a16_confusion_matrix", _HB + """
SELECT is_returned AS actual, is_anomaly AS predicted, count(*) AS n FROM hf GROUP BY 1, 2""")
def a16_confusion_matrix(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    return EV.confusion_matrix(fl, "is_returned", "is_anomaly")


@register("a17_binary_metrics", _HB + """,
c AS (SELECT CAST(count_if(is_returned AND is_anomaly) AS BIGINT) AS tp,
             CAST(count_if(NOT is_returned AND is_anomaly) AS BIGINT) AS fp,
             CAST(count_if(is_returned AND NOT is_anomaly) AS BIGINT) AS fn,
             CAST(count_if(NOT is_returned AND NOT is_anomaly) AS BIGINT) AS tn,
             count(*) AS n, count(DISTINCT is_returned) AS label_classes FROM hf)
SELECT tp, fp, fn, tn, n, label_classes,
       round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round(((CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END) * (tp + fn)
             + (CASE WHEN 2 * tn + fn + fp = 0 THEN 0 ELSE 2 * tn / (2 * tn + fn + fp) END) * (tn + fp)) / n, 6) AS weighted_f1,
       round(CASE WHEN label_classes < 2 THEN NULL ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS roc_auc_binary,
       tp + fp AS anomalies_detected, round((tp + fp) * 100.0 / n, 6) AS anomaly_pct
FROM c""")
def a17_binary_metrics(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    b = EV.binary_metrics(fl, "is_returned", "is_anomaly")
    return b.select("tp", "fp", "fn", "tn", "n", "label_classes",
                    *[_r(c) for c in ("precision", "recall", "f1", "weighted_f1", "roc_auc_binary")],
                    "anomalies_detected", _r("anomaly_pct"))


@register("a20_roc_curve", _HB + """,
pts AS (SELECT hbos_score AS threshold, count_if(is_returned) AS pos, count_if(NOT is_returned) AS neg
        FROM hf GROUP BY 1),
cum AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM pts),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM pts)
SELECT round(threshold, 6) AS threshold, round(fp / N, 6) AS fpr, round(tp / P, 6) AS tpr FROM cum CROSS JOIN tot""")
def a20_roc_curve(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    c = EV.roc_curve(fl, "is_returned", "anomaly_score")
    return c.select(_r("threshold"), _r("fpr"), _r("tpr"))


@register("a20_roc_auc", _HB + """,
pts AS (SELECT hbos_score AS threshold, count_if(is_returned) AS pos, count_if(NOT is_returned) AS neg
        FROM hf GROUP BY 1),
cum AS (SELECT threshold, sum(pos) OVER (ORDER BY threshold DESC) AS tp, sum(neg) OVER (ORDER BY threshold DESC) AS fp FROM pts),
tot AS (SELECT sum(pos) AS P, sum(neg) AS N FROM pts),
cur AS (SELECT threshold, fp / N AS fpr, tp / P AS tpr FROM cum CROSS JOIN tot),
seg AS (SELECT fpr, tpr, coalesce(lag(fpr) OVER (ORDER BY threshold DESC), 0) AS pf,
               coalesce(lag(tpr) OVER (ORDER BY threshold DESC), 0) AS pt FROM cur)
SELECT round(sum((fpr - pf) * (tpr + pt) / 2), 6) AS auc FROM seg""")
def a20_roc_auc(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    return EV.roc_auc(EV.roc_curve(fl, "is_returned", "anomaly_score")).select(_r("auc"))


@register("a21_score_density", _HB + """,
rg AS (SELECT min(hbos_score) AS lo, max(hbos_score) AS hi, count(*) AS n FROM hf),
hb2 AS (SELECT CAST(CASE WHEN hi = lo THEN 0 ELSE least(floor((hbos_score - lo) / ((hi - lo) / 50)), 49) END AS INTEGER) AS bin,
               count(*) AS cnt, any_value(lo) AS lo, any_value(hi) AS hi, any_value(n) AS n
        FROM hf CROSS JOIN rg GROUP BY 1)
SELECT 'hbos' AS model, bin, cnt, round(cnt / (n * (CASE WHEN hi = lo THEN 1.0 ELSE (hi - lo) / 50 END)), 6) AS density FROM hb2""")
def a21_score_density(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    d = RP.score_density(fl.withColumn("model", F.lit("hbos")), 50)
    return d.select("model", "bin", "cnt", _r("density"))


# ----------------------------------------------------------------- J4, J5, D3, D5 on embeddings
from reviewlens.operators.dbscan import dbscan  # noqa: E402
from reviewlens.operators.detect import AnomalyDetector, detect_all  # noqa: E402
from reviewlens.operators.lof import LOFModel  # noqa: E402
from reviewlens.operators.neighbors import knn_join, knn_join_approx, knn_recall, radius_counts  # noqa: E402
from reviewlens.operators.scaling import Scaler  # noqa: E402
from reviewlens.sources.tables import scan_table  # noqa: E402

DBSCAN_EPS, DBSCAN_MIN = 9.5, 5
LOF_K, KNN_K = 20, 5


def _embeddings(spark, sf):
    return scan_table(spark, sf, "embeddings").select("vec_id", "embedding", "label")


def _scaled_embeddings(spark, sf):
    e = _embeddings(spark, sf)
    sc = Scaler.fit(e, FeatureSpec.of(e, vector="embedding"), id_col="vec_id")
    return e.select(F.col("vec_id").alias("id"), F.array(*sc.scaled_exprs(e)).alias("features"))


@register("j4_knn_join", O.with_(O.EMB_CTE, O.knn_cte(KNN_K)) + """
SELECT id AS vec_id, nid AS neighbor_id, r AS rank, round(dist, 6) AS dist FROM kn""")
def j4_knn_join(spark, sf):
    X = materialize(_scaled_embeddings(spark, sf))
    k = knn_join(X, X, KNN_K, "id", "features", exclude_self=True, block_rows=4096)
    return k.select(F.col("id").alias("vec_id"), "neighbor_id", F.col("rank").cast("bigint").alias("rank"),
                    _r("dist"))


@register("j5_radius_counts", O.with_(O.EMB_CTE) + f"""
SELECT id AS vec_id, count(*) AS n_within FROM pd WHERE dist <= {DBSCAN_EPS} GROUP BY id""")
def j5_radius_counts(spark, sf):
    X = materialize(_scaled_embeddings(spark, sf))
    r = radius_counts(X, X, DBSCAN_EPS, "id", "features", block_rows=4096)
    return r.select(F.col("id").alias("vec_id"), "n_within")


@register("d3_lof", O.with_(O.EMB_CTE, O.lof_cte(LOF_K, 0.1)) + """
SELECT id AS vec_id, round(lof, 6) AS lof, lof > t AS is_anomaly FROM lof CROSS JOIN lthr""")
def d3_lof(spark, sf):
    e = _embeddings(spark, sf)
    m = LOFModel.fit(e, vector="embedding", k=LOF_K, contamination=0.1, id_col="vec_id", block_rows=4096)
    return m.training_scores().select(F.col("id").alias("vec_id"), _r("lof"), "is_anomaly")


@register("s12_stored_lof", ORACLES["d3_lof"])
def s12_stored_lof(spark, sf):
    """LOF fitted, stored, loaded from the shared folder, then asked for its training scores."""
    m = LOFModel.fit(_embeddings(spark, sf), vector="embedding", k=LOF_K, contamination=0.1, id_col="vec_id", block_rows=4096)
    path = scratch_path(spark, uuid.uuid4().hex)
    save_detector(spark, m, path)
    return load_detector(spark, path).training_scores().select(F.col("id").alias("vec_id"), _r("lof"), "is_anomaly")


@register("s12_stored_hbos", ORACLES["d1_hbos_anomaly_by_rating"])
def s12_stored_hbos(spark, sf):
    f, m, _ = _hbos_flags(spark, sf)
    path = scratch_path(spark, uuid.uuid4().hex)
    save_detector(spark, m, path)
    return anomaly_by_rating(load_detector(spark, path).transform(f), "score")


@register("s8_metrics_round_trip", """
SELECT l_returnflag AS model, round(avg(l_discount), 9) AS precision, round(avg(l_tax), 9) AS recall, 0.0::DOUBLE AS f1,
       count(*) AS anomalies_detected, upper(l_returnflag) AS display_name FROM lineitem GROUP BY ALL""")
def s8_metrics_round_trip(spark, sf):
    """S6 -> S8: metrics (means of lineitem columns) written as JSON and read again; a missing F1 reads as 0."""
    m = bindings.scan_table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("model")).agg(
        F.avg("l_discount").alias("precision"), F.avg("l_tax").alias("recall"), F.count("*").alias("anomalies_detected"))
    path = scratch_path(spark, uuid.uuid4().hex)
    write_metrics(m, path)
    return read_model_metrics(spark, path).select("model", _r("precision", 9), _r("recall", 9), "f1", "anomalies_detected", "display_name")


@register("a8_constant_features", """
SELECT 'c' || i AS feature, CAST(i AS INTEGER) AS feature_index, min(l_quantity * 0 + i) AS value
FROM lineitem CROSS JOIN (SELECT unnest(range(5)) AS i) GROUP BY i""")
def a8_constant_features(spark, sf):
    cols = [f"c{i}" for i in range(11)]
    f = bindings.scan_table(spark, sf, "lineitem").select(
        *[(F.col("l_quantity") * 0 + i).alias(c) for i, c in enumerate(cols)], F.col("l_tax").alias("varying"))
    return PF.constant_feature_report(f, FeatureSpec.of(f, [*cols, "varying"]))


@register("d5_dbscan", O.dbscan_sql(DBSCAN_EPS, DBSCAN_MIN))
def d5_dbscan(spark, sf):
    e = _embeddings(spark, sf)
    res = dbscan(e, vector="embedding", eps=DBSCAN_EPS, min_samples=DBSCAN_MIN, id_col="vec_id", block_rows=4096)
    return res.labels.select(F.col("id").alias("vec_id"), "n_within", "is_core", "cluster", "is_anomaly")


@register("d3_lof_new_rows", f"""
WITH e AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings),
es AS (SELECT i, avg(v) AS m, var_pop(v) AS s2 FROM e WHERE vec_id % 2 = 0 GROUP BY i),
z AS (SELECT vec_id, i, (v - m) / sqrt(s2) AS z FROM e JOIN es USING (i) WHERE s2 > 0),
pd AS (SELECT a.vec_id AS id, b.vec_id AS nid, sqrt(sum((a.z - b.z) * (a.z - b.z))) AS dist
       FROM z a JOIN z b ON a.i = b.i AND b.vec_id % 2 = 0 GROUP BY 1, 2),
kn AS (SELECT id, nid, dist FROM pd WHERE id <> nid QUALIFY row_number() OVER (PARTITION BY id ORDER BY dist, nid) <= {LOF_K}),
kd AS (SELECT id, max(dist) AS kdist FROM kn WHERE id % 2 = 0 GROUP BY id),
lrd AS (SELECT kn.id, 1.0 / (avg(greatest(kdist, dist)) + 1e-10) AS lrd FROM kn JOIN kd ON kn.nid = kd.id GROUP BY kn.id),
lof AS (SELECT kn.id, avg(o.lrd) / any_value(p.lrd) AS lof FROM kn JOIN lrd o ON kn.nid = o.id JOIN lrd p ON kn.id = p.id GROUP BY kn.id),
t AS (SELECT quantile_cont(lof, 0.9) AS t FROM lof WHERE id % 2 = 0)
SELECT id // 2 AS vec_id, round(lof, 6) AS lof, lof > t AS is_anomaly FROM lof CROSS JOIN t WHERE id % 2 = 1""")
def d3_lof_new_rows(spark, sf):
    """LOF fitted on one half of the vectors scores the other half, whose ids clash with the first's."""
    e = _embeddings(spark, sf)
    seen, new = (e.where(F.col("vec_id") % 2 == half).withColumn("vec_id", F.floor(F.col("vec_id") / 2)) for half in (0, 1))
    det = AnomalyDetector("lof", k=LOF_K, contamination=0.1, block_rows=4096).fit(seen, vector="embedding", id_col="vec_id")
    return det.detect(new).select("vec_id", F.round("anomaly_score", 6).alias("lof"), "is_anomaly")


GRID_EPS, GRID_MIN = 50.0, 4
_GRID_SQL = f"""
WITH p AS (SELECT l_linenumber AS line, l_extendedprice AS x, CAST(epoch_us(l_shipdate) // 86400000000 AS DOUBLE) AS y,
                  row_number() OVER () AS id FROM lineitem),
pairs AS (SELECT a.id, b.id AS nid FROM p a JOIN p b ON b.x >= a.x - {GRID_EPS + 1} AND b.x <= a.x + {GRID_EPS + 1}
          AND b.y >= a.y - {GRID_EPS + 1} AND b.y <= a.y + {GRID_EPS + 1}
          WHERE sqrt((a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y)) <= {GRID_EPS}),
w AS (SELECT id, count(*) AS n FROM pairs GROUP BY id)"""


def _price_and_day(spark, sf):
    """lineitem as points (price, day); the id is a hash of the row, since the table has no key."""
    t = scan_table(spark, sf, "lineitem")
    day = F.floor(F.unix_micros(F.col("l_shipdate").cast("timestamp")) / F.lit(86_400_000_000)).cast("double")
    return t.select(F.xxhash64(*t.columns).alias("id"), F.col("l_linenumber").alias("line"),
                    F.array(F.col("l_extendedprice"), day).alias("features"))


@register("j5_radius_grid", _GRID_SQL + """
SELECT line, count(*) AS n_rows, CAST(sum(n) AS BIGINT) AS n_within, max(n) AS most FROM p JOIN w USING (id) GROUP BY line""")
def j5_radius_grid(spark, sf):
    p = materialize(_price_and_day(spark, sf))
    n = radius_counts(p, p, GRID_EPS, "id", "features", mode="grid")
    return p.join(n, "id").groupBy("line").agg(F.count("*").alias("n_rows"), F.sum("n_within").alias("n_within"), F.max("n_within").alias("most"))


@register("d5_dbscan_grid", _GRID_SQL + f""",
core AS (SELECT id FROM w WHERE n >= {GRID_MIN}),
near AS (SELECT DISTINCT pairs.id FROM pairs JOIN core ON core.id = pairs.nid)
SELECT line, count(core.id) AS n_core, count(near.id) - count(core.id) AS n_border, count(*) - count(near.id) AS n_noise
FROM p LEFT JOIN core USING (id) LEFT JOIN near USING (id) GROUP BY line""")
def d5_dbscan_grid(spark, sf):
    p = materialize(_price_and_day(spark, sf))
    r = dbscan(p, vector="features", eps=GRID_EPS, min_samples=GRID_MIN, id_col="id", scale=False).labels
    return p.select("id", "line").join(r, "id").groupBy("line").agg(
        F.count_if("is_core").alias("n_core"), F.count_if(~F.col("is_core") & F.col("cluster").isNotNull()).alias("n_border"),
        F.count_if("is_anomaly").alias("n_noise"))


@register("j4_knn_approx", f"""
SELECT count(*) AS n_queries, {KNN_K} * count(*) AS n_rows, true AS recall_reached FROM embeddings""")
def j4_knn_approx(spark, sf):
    """Neighbours by hash tables: every vector has all of them, and at least nine in ten are the true ones."""
    X = materialize(_scaled_embeddings(spark, sf))
    found = materialize(knn_join_approx(X, X, KNN_K, "id", "features", block_rows=4096))
    recall = knn_recall(found, X, X, KNN_K, "id", "features", block_rows=4096)
    return found.agg(F.count_distinct("id").alias("n_queries"), F.count("*").alias("n_rows")).crossJoin(
        recall.select((F.col("recall") >= 0.9).alias("recall_reached")))


# ----------------------------------------------------------------- D2, D4, D7 (no SQL form: rows-only)
from reviewlens.operators.iforest import IsolationForestModel  # noqa: E402
from reviewlens.operators.ocsvm import OneClassSVMModel  # noqa: E402


@register("d2_isolation_forest")
def d2_isolation_forest(spark, sf):
    f = materialize(review_features(spark, sf))
    m = IsolationForestModel.fit(f, cols=NUMERIC_FEATURES, n_estimators=100, contamination=0.1)
    return anomaly_by_rating(m.transform(f), "score")


@register("d4_one_class_svm")
def d4_one_class_svm(spark, sf):
    e = _embeddings(spark, sf)
    m = OneClassSVMModel.fit(e, vector="embedding", nu=0.1, n_components=128, max_iter=20, id_col="vec_id")
    return m.transform(e).select("vec_id", _r("anomaly_score"), "is_anomaly")


DETECT_ALL_SPECS = {
    "hbos": {},
    "isolation_forest": {},
    "lof": {"k": LOF_K, "block_rows": 4096},
    "one_class_svm": {"n_components": 128, "max_iter": 20},
    "dbscan": {"eps": DBSCAN_EPS, "min_samples": DBSCAN_MIN, "block_rows": 4096},
}


@register("d7_detect_all_counts")
def d7_detect_all_counts(spark, sf):
    e = materialize(_embeddings(spark, sf))
    res = detect_all(e, DETECT_ALL_SPECS, vector="embedding", id_col="vec_id")
    c = RP.model_anomaly_counts(res)
    return c.select("model", display_name("model").alias("display_name"), "anomalies", "n", _r("anomaly_pct"))


# ----------------------------------------------------------------- T1-T5, O6 on documents
from pyspark.ml.functions import vector_to_array  # noqa: E402

from reviewlens.operators import text as TX  # noqa: E402
from reviewlens.operators.feature_model import FeatureModel  # noqa: E402

_TOK_CTE = r"""
tok AS (SELECT doc_id, lang, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM documents)
"""


def _vocab_cte(k: int) -> str:
    return f"""
voc AS (SELECT term, term_count, term_index FROM (
          SELECT term, count(*) AS term_count, row_number() OVER (ORDER BY count(*) DESC, term) - 1 AS term_index
          FROM tok GROUP BY term) WHERE term_index < {k})
"""


def _documents(spark, sf):
    return scan_table(spark, sf, "documents").select("doc_id", "text", "lang", "n_chars")


@register("t1_tokenize", O.with_(_TOK_CTE) + """
SELECT lang, count(*) AS n_tokens, count(DISTINCT term) AS n_terms FROM tok GROUP BY lang""")
def t1_tokenize(spark, sf):
    d = _documents(spark, sf)
    p = d.select("lang", F.explode(TX.tokenize("text")).alias("term"))
    return p.groupBy("lang").agg(F.count("*").alias("n_tokens"), F.count_distinct("term").alias("n_terms"))


@register("o6_top_terms", O.with_(_TOK_CTE, _vocab_cte(300)) + """
SELECT term, term_count, CAST(term_index AS INTEGER) AS term_index FROM voc""")
def o6_top_terms(spark, sf):
    return TX.top_terms(_documents(spark, sf), "doc_id", "text", 300) \
        .select("term", "term_count", F.col("term_index").cast("int").alias("term_index"))


@register("t2_tfidf_features", O.with_(_TOK_CTE, _vocab_cte(300), """
tf AS (SELECT doc_id, term, count(*) AS tf FROM tok WHERE term IN (SELECT term FROM voc) GROUP BY 1, 2),
nd AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM documents),
dfq AS (SELECT term, CAST(count(*) AS DOUBLE) AS dfreq FROM tf GROUP BY term),
idf AS (SELECT voc.term, ln((1 + n) / (1 + coalesce(dfreq, 0))) + 1 AS idf
        FROM voc LEFT JOIN dfq ON voc.term = dfq.term CROSS JOIN nd),
w AS (SELECT tf.doc_id, tf.term, tf.tf * idf.idf AS raw FROM tf JOIN idf ON tf.term = idf.term),
nr AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY doc_id)""") + """
SELECT w.doc_id, w.term, round(raw / norm, 6) AS weight FROM w JOIN nr ON w.doc_id = nr.doc_id""")
def t2_tfidf_features(spark, sf):
    w, _ = TX.tfidf(_documents(spark, sf), "doc_id", "text", 300)
    return w.select(F.col("id").alias("doc_id"), "term", _r("weight"))


@register("t3_hashing_features")
def t3_hashing_features(spark, sf):
    h = TX.hashing_features(_documents(spark, sf), "doc_id", "text", 300)
    return h.groupBy(F.col("id").alias("doc_id")).agg(F.count("*").alias("n_buckets"),
                                                      F.round(F.sum(F.col("weight") ** 2), 6).alias("sq_norm"))


@register("t5_prepare_features")
def t5_prepare_features(spark, sf):
    d = _documents(spark, sf).withColumn("summary", F.split("text", "\n").getItem(0)) \
        .withColumn("n_chars_d", F.col("n_chars").cast("double"))
    f = TX.prepare_features(d, "doc_id", "text", "summary", ["n_chars_d"])
    return f.select("doc_id", F.size("features").alias("width"),
                    F.round(F.aggregate("features", F.lit(0.0), lambda a, x: a + x), 4).alias("feature_sum"))


@register("t5_stored_features", r"""
WITH d AS (SELECT doc_id, text, doc_id % 2 = 0 AS seen, CASE WHEN doc_id % 5 = 1 THEN NULL ELSE CAST(n_chars AS DOUBLE) END AS n FROM documents),
tok AS (SELECT doc_id, seen, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}_]{2,}')) AS term FROM d),
voc AS (SELECT term, ln((1 + (SELECT count(*) FROM d WHERE seen)) / (1.0 + count(DISTINCT doc_id))) + 1 AS idf FROM tok WHERE seen
        GROUP BY term ORDER BY count(*) DESC, term LIMIT 300),
w AS (SELECT doc_id, term, count(*) * any_value(idf) AS raw FROM tok JOIN voc USING (term) WHERE NOT seen GROUP BY 1, 2),
nr AS (SELECT doc_id, sqrt(sum(raw * raw)) AS norm FROM w GROUP BY 1)
SELECT doc_id, 'text:' || term AS feature, round(raw / norm, 6) AS value FROM w JOIN nr USING (doc_id)
UNION ALL
SELECT doc_id, 'n_chars_d', round(coalesce(n, (SELECT avg(n) FROM d WHERE seen)), 6) FROM d WHERE NOT seen""")
def t5_stored_features(spark, sf):
    """The feature model of one half of the documents, stored, loaded and applied to the other half."""
    d = _documents(spark, sf).withColumn("n_chars_d", F.when(F.col("doc_id") % 5 != 1, F.col("n_chars").cast("double")))
    seen, new = d.where("doc_id % 2 = 0"), d.where("doc_id % 2 = 1")
    path = scratch_path(spark, uuid.uuid4().hex)
    FeatureModel.fit(seen, {"text": 300}, ["n_chars_d"], id_col="doc_id").save(spark, path)
    m = FeatureModel.load(spark, path)
    names = F.array(*[F.lit(n) for n in m.names])
    long = m.transform(new).select("doc_id", F.posexplode(vector_to_array("features")).alias("i", "v")).where("v <> 0")
    return long.select("doc_id", F.get(names, F.col("i")).alias("feature"), F.round("v", 6).alias("value"))


@register("d1_hbos_sparse_features")
def d1_hbos_sparse_features(spark, sf):
    """HBOS over the sparse text vectors of all documents: rows and flagged rows."""
    d = _documents(spark, sf).withColumn("n_chars_d", F.col("n_chars").cast("double"))
    f = materialize(FeatureModel.fit(d, {"text": 40}, ["n_chars_d"], id_col="doc_id").transform(d).select("doc_id", "features"))
    m = HBOSModel.fit(f, vector="features", id_col="doc_id")
    return m.transform(f).select("doc_id", _r("anomaly_score"), "is_anomaly")


# ----------------------------------------------------------------- R1-R5, A24, A28
import json  # noqa: E402

import numpy as _np  # noqa: E402

from reviewlens.operators.dbn import DBNModel, RBMLayer, dbn_fit, min_max  # noqa: E402

# A 2 x 6 weight matrix and hidden biases for the checkable DBN case.
FIXED_W = [[0.5, -0.25, 0.75, -0.5, 0.25, -0.75],
           [-0.3, 0.6, -0.9, 0.2, -0.4, 0.8]]
FIXED_C = [0.1, -0.2]


def _fixed_dbn_sql() -> str:
    lines = []
    for k, (row, c) in enumerate(zip(FIXED_W, FIXED_C)):
        z = " + ".join(f"({w}) * (({f} - lo{j}) / (hi{j} - lo{j}))" for j, (w, f) in enumerate(zip(row, NUMERIC_FEATURES)))
        lines.append(f"1.0 / (1.0 + exp(-(({c}) + {z}))) AS h{k}")
    mm = ", ".join(f"min({f}) AS lo{j}, max({f}) AS hi{j}" for j, f in enumerate(NUMERIC_FEATURES))
    return O.with_(O.FEATURES_CTE, f"mx AS (SELECT {mm} FROM f)",
                   f"hh AS (SELECT f.score, {', '.join(lines)} FROM f CROSS JOIN mx)") + """
SELECT score AS rating, round(avg(h0), 6) AS mean_h0, round(avg(h1), 6) AS mean_h1 FROM hh GROUP BY score"""


@register("r5_dbn_transform_fixed", _fixed_dbn_sql())
def r5_dbn_transform_fixed(spark, sf):
    f = materialize(review_features(spark, sf)).withColumn("features", F.array(*NUMERIC_FEATURES))
    lo, hi = min_max(f, "features", len(NUMERIC_FEATURES))
    m = DBNModel([RBMLayer(_np.asarray(FIXED_W), _np.zeros(len(NUMERIC_FEATURES)), _np.asarray(FIXED_C))],
                 list(range(len(NUMERIC_FEATURES))), lo, hi)
    h = m.transform(f, "features", "h")
    return h.groupBy(F.col("score").alias("rating")).agg(F.round(F.avg(F.get("h", 0)), 6).alias("mean_h0"),
                                                         F.round(F.avg(F.get("h", 1)), 6).alias("mean_h1"))


def _review_dbn(spark, sf):
    f = materialize(review_features(spark, sf)).withColumn("features", F.array(*NUMERIC_FEATURES))
    return dbn_fit(f, "features", "row_id", hidden_layers=[3, 2],
                   layer_configs=[{"learning_rate": 0.05, "n_iter": 4}, {"learning_rate": 0.03, "n_iter": 3}],
                   patience=2, feature_subset_ratio=1.0)


@register("r4_dbn_layer_scores")
def r4_dbn_layer_scores(spark, sf):
    m = _review_dbn(spark, sf)
    s = m.scores_table(spark)
    return s.groupBy("layer").agg(F.count("*").alias("epochs"), F.round(F.max("train_score"), 4).alias("best_train"),
                                  F.round(F.max("val_score"), 4).alias("best_val")).where(F.col("best_val").isNotNull())


@register("a28_weight_stats")
def a28_weight_stats(spark, sf):
    m = _review_dbn(spark, sf)
    w = m.weights_table(spark)
    long = w.select("layer", F.posexplode("weights").alias("hidden", "row")) \
        .select("layer", "hidden", F.posexplode("row").alias("visible", "w"))
    return long.groupBy("layer").agg(F.count("*").alias("n_weights"), F.round(F.min("w"), 6).alias("w_min"),
                                     F.round(F.avg("w"), 6).alias("w_mean"), F.round(F.max("w"), 6).alias("w_max"),
                                     F.round(F.stddev_pop("w"), 6).alias("w_std"))


# ----------------------------------------------------------------- M1-M5, O5, A22, A25, A26
from reviewlens.operators import tuning as TU  # noqa: E402

HBOS_GRID = {"n_bins": [5, 10, 20], "alpha": [0.1], "contamination": [0.1]}


@register("m1_grid_search_hbos")
def m1_grid_search_hbos(spark, sf):
    f = materialize(review_features(spark, sf))
    res = TU.grid_search(f, "hbos", HBOS_GRID, "is_returned", cols=NUMERIC_FEATURES, k_folds=3)
    best = TU.best_params(res)
    met = TU.best_model_metrics(f, "hbos", json.loads(best.first()["params"]), "is_returned", cols=NUMERIC_FEATURES)
    return TU.tuning_summary(best, met).select("model", "best_params", _r("best_f1"), _r("precision"),
                                               _r("recall"), _r("f1"), _r("roc_auc_binary"))


@register("m5_learning_curves_hbos")
def m5_learning_curves_hbos(spark, sf):
    f = materialize(review_features(spark, sf))
    cur = TU.learning_curves(f, "hbos", {"n_bins": 10}, "is_returned", cols=NUMERIC_FEATURES,
                             train_sizes=(0.3, 0.65, 1.0), k_folds=2)
    return TU.learning_curve_summary(cur).select("model", "final_train_size", _r("final_train_score"),
                                                 _r("final_test_score"), _r("gap"))


@register("m1_study")
def m1_study(spark, sf):
    """One resumable run over two models, started twice: the second start finds every step done."""
    f = materialize(review_features(spark, sf))
    grids = {"hbos": {"n_bins": [5, 10]}, "isolation_forest": {"n_estimators": [10]}}
    ledger = RunLedger(spark, scratch_path(spark, uuid.uuid4().hex))
    for _ in range(2):
        study = Study(f, ledger, "run", "is_returned", cols=NUMERIC_FEATURES)
        study.tune(grids, k_folds=2)
    steps = ledger.events().where("stage = 'tune_step'").groupBy(F.split("model", "/")[0].alias("model")).agg(
        F.count("*").alias("n_events"), F.count_distinct("model").alias("n_steps"))
    return study.best().join(steps, "model").select("model", "params", _r("mean_test_score"), "n_events", "n_steps")


_LEDGER_SQL = """
WITH e AS (SELECT o_orderpriority || '/' || CAST(o_custkey % 10 AS VARCHAR) AS model, o_orderdate + to_microseconds(o_orderkey) AS ts,
                  CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'failed' ELSE 'started' END AS status FROM orders),
st AS (SELECT model, arg_max(status, ts) AS status FROM e GROUP BY model),
req AS (SELECT model FROM st UNION ALL SELECT 'never started')"""


def _order_events(spark, sf):
    """Orders read as ledger events: a model per priority and customer group, its status from the order's."""
    status = F.col("o_orderstatus")
    at = F.col("o_orderdate").cast("timestamp")
    return bindings.scan_table(spark, sf, "orders").select(
        F.lit("run").alias("run_id"), F.lit("tune").alias("stage"),
        F.concat("o_orderpriority", F.lit("/"), (F.col("o_custkey") % 10).cast("string")).alias("model"),
        F.when(status == "F", "completed").when(status == "O", "failed").otherwise("started").alias("status"),
        F.timestamp_micros(F.unix_micros(at) + F.col("o_orderkey")).alias("at"),
        F.lit("{}").alias("payload"), F.lit(None).cast("string").alias("result_path"))


@register("f4_pending_models", _LEDGER_SQL + """
SELECT model FROM req WHERE model NOT IN (SELECT model FROM st WHERE status = 'completed')""")
def f4_pending_models(spark, sf):
    e = _order_events(spark, sf)
    requested = e.select("model").distinct().union(spark.createDataFrame([("never started",)], "model string"))
    return pending_models(requested, ledger_state(e))


@register("m4_tuning_status", _LEDGER_SQL + """
SELECT string_agg(model, ',' ORDER BY model) FILTER (status = 'completed') AS tuned,
       string_agg(model, ',' ORDER BY model) FILTER (status IS DISTINCT FROM 'completed') AS untuned,
       round(count(*) FILTER (status = 'completed') * 100.0 / count(*), 6)::DOUBLE AS progress_pct FROM req LEFT JOIN st USING (model)""")
def m4_tuning_status(spark, sf):
    state = materialize(ledger_state(_order_events(spark, sf)))
    requested = [r["model"] for r in state.select("model").collect()] + ["never started"]
    s = tuning_status(state, requested)
    return s.select(F.array_join("tuned", ",").alias("tuned"), F.array_join("untuned", ",").alias("untuned"), _r("progress_pct"))


def _stored_alike(spark, model, df):
    """Rows, and rows that a model scores the same after it was stored and loaded."""
    path = scratch_path(spark, uuid.uuid4().hex)
    save_detector(spark, model, path)
    again = load_detector(spark, path)
    both = again.transform(model.transform(df, "s1", "f1"), "s2", "f2")
    return both.agg(F.count("*").alias("n_rows"), F.count_if((F.abs(F.col("s1") - F.col("s2")) < 1e-9) & (F.col("f1") == F.col("f2"))).alias("n_equal"))


@register("s12_stored_forest", "SELECT count(*) AS n_rows, count(*) AS n_equal FROM lineitem")
def s12_stored_forest(spark, sf):
    f = materialize(review_features(spark, sf))
    return _stored_alike(spark, IsolationForestModel.fit(f, cols=NUMERIC_FEATURES, n_estimators=20), f)


@register("s12_stored_svm", "SELECT count(*) AS n_rows, count(*) AS n_equal FROM embeddings")
def s12_stored_svm(spark, sf):
    e = _embeddings(spark, sf)
    return _stored_alike(spark, OneClassSVMModel.fit(e, vector="embedding", n_components=64, max_iter=5, id_col="vec_id"), e)


# ----------------------------------------------------------------- O4, A23, E1, S4
from reviewlens.operators.study import Study  # noqa: E402
from reviewlens.sources.store import RunLedger, ledger_state, pending_models, tuning_status  # noqa: E402
from reviewlens.sources.store import table_fingerprint  # noqa: E402


def _o4_sql() -> str:
    parts = [f"SELECT '{c}' AS feature, round(abs(covar_pop({c}, hbos_score) / sqrt(var_pop({c}) * var_pop(hbos_score))), 6) "
             f"AS importance FROM hf" for c in NUMERIC_FEATURES]
    return _HB + ",\nimp AS (" + " UNION ALL ".join(parts) + ")\nSELECT feature, importance FROM imp"


@register("o4_feature_importance_order", _o4_sql())
def o4_feature_importance_order(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    return RP.feature_importance_order(fl, NUMERIC_FEATURES).select("feature", _r("importance"))


@register("a23_metric_comparison", _HB + """,
c AS (SELECT CAST(count_if(is_returned AND is_anomaly) AS DOUBLE) AS tp,
             CAST(count_if(NOT is_returned AND is_anomaly) AS DOUBLE) AS fp,
             CAST(count_if(is_returned AND NOT is_anomaly) AS DOUBLE) AS fn, CAST(count(*) AS DOUBLE) AS n FROM hf)
SELECT 'hbos' AS model, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
       round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
       round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
       round((tp + fp) * 100.0 / n, 6) AS anomaly_pct, CAST(0.0 AS DOUBLE) AS roc_auc, 'Hbos' AS display_name FROM c""")
def a23_metric_comparison(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    b = EV.binary_metrics(fl.withColumn("model", F.lit("hbos")), "is_returned", "is_anomaly", by=["model"])
    metrics = ["precision", "recall", "f1", "anomaly_pct", "roc_auc"]
    long = b.select("model", F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("value"))
                                                 for m in metrics[:4]])).alias("m")).select("model", "m.*")
    wide = RP.metric_comparison(long, metrics_list=metrics)   # roc_auc missing -> 0.0
    return wide.select("model", *[_r(m) for m in metrics], "display_name")


@register("e1_project_2d")
def e1_project_2d(spark, sf):
    e = materialize(_embeddings(spark, sf))
    sc = Scaler.fit(e, FeatureSpec.of(e, vector="embedding"), id_col="vec_id")
    m = HBOSModel.fit(e, vector="embedding", id_col="vec_id", scaler=sc)
    scored = sc.transform(m.transform(e), "scaled", keep=["vec_id", "is_anomaly"])
    p = RP.project_2d(scored, "scaled", "vec_id", "is_anomaly")
    return p.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg("x"), 4).alias("mean_x"))


@register("s4_table_fingerprint")
def s4_table_fingerprint(spark, sf):
    fp = table_fingerprint(scan_table(spark, sf, "lineitem", rebalance=False))
    return spark.createDataFrame([("lineitem", fp)], "table_name string, fingerprint string")


@register("a21_score_kde")
def a21_score_kde(spark, sf):
    _, _, fl = _hbos_flags(spark, sf)
    k = RP.score_kde(fl.withColumn("model", F.lit("hbos")), grid_points=200)
    return k.select("model", "point", _r("x"), _r("density"))
