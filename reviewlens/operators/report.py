"""Aggregate tables behind the reference's charts and summaries.

A10 rating_distribution, A11 anomaly_by_rating, A12/A13 box statistics,
A14 behaviour_correlation, A15 model_anomaly_counts, A21 score_density,
A23 metric_comparison, A24 layer_scores, A25/A26 summaries, A28 weight_stats,
O4 feature_importance_order, E1 project_2d.
"""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.functions.scalar import display_name
from reviewlens.operators.ranking import exact_quantiles


def rating_distribution(df: DataFrame, score_col: str = "score") -> DataFrame:
    """A10: rows per score."""
    return df.groupBy(F.col(score_col).alias("rating")).agg(F.count("*").alias("n_reviews"))


def anomaly_by_rating(flags: DataFrame, score_col: str = "rating", flag_col: str = "is_anomaly") -> DataFrame:
    """Rows per (rating, flag)."""
    return flags.groupBy(F.col(score_col).alias("rating"), F.col(flag_col).alias("is_anomaly")).agg(
        F.count("*").alias("n_reviews"))


def box_stats(df: DataFrame, value_col: str, group_col: str, cap_quantile: float | None = 0.95) -> DataFrame:
    """Per group q1, median, q3, whiskers (min/max inside 1.5 IQR), outliers.

    Quantiles are exact (linear interpolation) and computed by histogram
    narrowing, so a large group is never buffered in one task. The whisker
    and outlier aggregate joins a one-row-per-group table (AQE broadcasts it
    when small).
    """
    q = exact_quantiles(df, value_col, [0.25, 0.5, 0.75], [group_col])
    spark = df.sparkSession
    rows = [(g[0], v[0], v[1], v[2]) for g, v in q.items()]
    qt = spark.createDataFrame(rows, f"_qg {df.schema[group_col].dataType.simpleString()}, q1 double, med double, q3 double")
    cap = None
    if cap_quantile is not None:
        cap = exact_quantiles(df, value_col, [cap_quantile]).get((), [None])[0]
    v = F.col(value_col).cast("double")
    j = df.select(F.col(group_col).alias("g"), v.alias("v")).where(F.col("v").isNotNull() & ~F.isnan("v")) \
        .join(qt, F.col("g").eqNullSafe(F.col("_qg"))).drop("_qg")
    lo_f = F.col("q1") - F.lit(1.5) * (F.col("q3") - F.col("q1"))
    hi_f = F.col("q3") + F.lit(1.5) * (F.col("q3") - F.col("q1"))
    inside = (F.col("v") >= lo_f) & (F.col("v") <= hi_f)
    out = j.groupBy("g", "q1", "med", "q3").agg(
        F.count("*").alias("n"),
        F.min(F.when(inside, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(inside, F.col("v"))).alias("whisker_hi"),
        F.count_if(~inside).alias("n_outliers"))
    out = out.withColumnRenamed("g", group_col)
    return out.withColumn("axis_cap", F.lit(cap).cast("double"))


def correlation_matrix(df: DataFrame, cols: list[str]) -> DataFrame:
    """Pearson r for every pair (strict lower triangle, a > b by position).

    Built from ``covar_pop`` and ``var_pop`` with ``try_divide`` so a constant
    column yields NULL instead of an ANSI error. One aggregate pass; rows with
    NULL or NaN in either column of a pair are skipped pairwise.
    """
    aggs = []
    pairs = []
    for i, j in itertools.combinations(range(len(cols)), 2):
        a, b = cols[j], cols[i]
        va, vb = (F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")) for c in (a, b))
        both = va.isNotNull() & vb.isNotNull()
        xa, xb = F.when(both, va), F.when(both, vb)
        k = len(pairs)
        aggs += [F.covar_pop(xa, xb).alias(f"c{k}"), F.var_pop(xa).alias(f"va{k}"), F.var_pop(xb).alias(f"vb{k}")]
        pairs.append((a, b))
    g = df.agg(*aggs)
    structs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                        F.try_divide(F.col(f"c{k}"), F.sqrt(F.col(f"va{k}") * F.col(f"vb{k}"))).alias("r"))
               for k, (a, b) in enumerate(pairs)]
    return g.select(F.explode(F.array(*structs)).alias("p")).select("p.*")


def model_anomaly_counts(results: DataFrame, model_col: str = "model", flag_col: str = "is_anomaly") -> DataFrame:
    """Anomalies per model and their percentage."""
    return results.groupBy(model_col).agg(
        F.count_if(F.col(flag_col)).alias("anomalies"),
        F.count("*").alias("n"),
        (F.avg(F.col(flag_col).cast("double")) * F.lit(100.0)).alias("anomaly_pct"))


def score_density(results: DataFrame, n_bins: int = 50, model_col: str = "model",
                  score_col: str = "anomaly_score") -> DataFrame:
    """Fixed-width histogram density of scores per model.

    density = count / (n * width); bins span each model's [min, max].
    """
    rng = results.groupBy(model_col).agg(F.min(score_col).alias("lo"), F.max(score_col).alias("hi"),
                                         F.count(score_col).alias("n"))
    j = results.select(model_col, score_col).join(rng, model_col)
    w = (F.col("hi") - F.col("lo")) / F.lit(n_bins)
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(score_col) - F.col("lo")) / w), F.lit(n_bins - 1))).cast("int")
    h = j.withColumn("bin", b).groupBy(model_col, "bin", "lo", "hi", "n").agg(F.count("*").alias("cnt"))
    width = F.when(F.col("hi") == F.col("lo"), F.lit(1.0)).otherwise((F.col("hi") - F.col("lo")) / F.lit(n_bins))
    return h.select(model_col, "bin",
                    (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
                    (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
                    "cnt", (F.col("cnt") / (F.col("n") * width)).alias("density"))


def metric_comparison(metrics: DataFrame, model_col: str = "model",
                      metrics_list=("precision", "recall", "f1", "anomaly_pct")) -> DataFrame:
    """Long metrics (model, metric, value) -> one row per model, missing -> 0."""
    p = metrics.groupBy(model_col).pivot("metric", list(metrics_list)).agg(F.first("value"))
    for m in metrics_list:
        p = p.withColumn(m, F.coalesce(F.col(m).cast("double"), F.lit(0.0)))
    return p.withColumn("display_name", display_name(model_col))


def feature_importance_order(df: DataFrame, feature_cols: list[str], score_col: str = "anomaly_score") -> DataFrame:
    """|corr(feature, score)| per feature, ascending (importance is ours)."""
    aggs = [F.abs(F.try_divide(F.covar_pop(F.col(c).cast("double"), F.col(score_col)),
                               F.sqrt(F.var_pop(F.col(c).cast("double")) * F.var_pop(score_col)))).alias(f"i{k}")
            for k, c in enumerate(feature_cols)]
    g = df.agg(*aggs)
    st = [F.struct(F.lit(c).alias("feature"), F.col(f"i{k}").alias("importance")) for k, c in enumerate(feature_cols)]
    return g.select(F.explode(F.array(*st)).alias("s")).select("s.*").orderBy("importance", "feature")


def project_2d(df: DataFrame, features_col: str, id_col: str, flag_col: str | None = None) -> DataFrame:
    """E1 (re-aimed t-SNE): 2-D PCA coordinates of standardised feature
    arrays plus the 'Anomaly'/'Normal' label. PCA needs only the d x d
    covariance (aggregated by Spark), so it scales with rows; t-SNE does not.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    from reviewlens.functions.scalar import flag_label
    v = df.select(id_col, *( [flag_col] if flag_col else []), array_to_vector(features_col).alias("_v"))
    model = PCA(k=2, inputCol="_v", outputCol="_p").fit(v)
    out = model.transform(v).withColumn("_a", vector_to_array("_p"))
    cols = [id_col, F.col("_a")[0].alias("x"), F.col("_a")[1].alias("y")]
    if flag_col:
        cols.append(flag_label(flag_col).alias("label"))
    return out.select(*cols)


def score_kde(results: DataFrame, grid_points: int = 200, hist_bins: int = 1024, model_col: str = "model",
              score_col: str = "anomaly_score") -> DataFrame:
    """A21 (KDE form): Gaussian kernel density of scores per model, binned.

    Spark computes per model n, std and a fine histogram (``hist_bins`` bins:
    one grouped aggregate, output bounded by models x bins). The density at
    ``grid_points`` evenly spaced points is then evaluated from the bin
    centres and counts (standard binned KDE), with Scott's bandwidth
    h = std * n^(-1/5). Nothing data-sized leaves the executors.
    """
    import math

    st = {r[model_col]: r for r in results.groupBy(model_col).agg(
        F.count(score_col).alias("n"), F.stddev_pop(score_col).alias("sd"),
        F.min(score_col).alias("lo"), F.max(score_col).alias("hi")).collect()}
    rng = results.sparkSession.createDataFrame(
        [(m, float(r["lo"]), float(r["hi"])) for m, r in st.items() if r["n"]],
        f"{model_col} string, lo double, hi double")
    w = (F.col("hi") - F.col("lo")) / F.lit(hist_bins)
    b = F.when(F.col("hi") == F.col("lo"), F.lit(0)).otherwise(
        F.least(F.floor((F.col(score_col) - F.col("lo")) / w), F.lit(hist_bins - 1))).cast("int")
    h = results.select(model_col, score_col).join(rng, model_col).groupBy(model_col, b.alias("bin")).count().collect()
    by_model: dict = {}
    for r in h:
        by_model.setdefault(r[model_col], []).append((r["bin"], r["count"]))
    rows = []
    for m, bins in by_model.items():
        s = st[m]
        n, sd, lo, hi = s["n"], s["sd"] or 0.0, s["lo"], s["hi"]
        bw = sd * n ** (-0.2) if sd > 0 else max(abs(lo), 1.0) * 1e-3
        width = (hi - lo) / hist_bins if hi > lo else 0.0
        centres = [(lo + (bi + 0.5) * width, c) for bi, c in bins]
        g_lo, g_hi = lo - 3 * bw, hi + 3 * bw
        for i in range(grid_points):
            x = g_lo + (g_hi - g_lo) * i / max(1, grid_points - 1)
            dens = sum(c * math.exp(-0.5 * ((x - xc) / bw) ** 2) for xc, c in centres) / (n * bw * math.sqrt(2 * math.pi))
            rows.append((m, i, x, dens))
    return results.sparkSession.createDataFrame(rows, f"{model_col} string, point int, x double, density double")
