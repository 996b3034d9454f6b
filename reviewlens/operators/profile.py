"""Feature profiling: A6 feature_stats, A7 inspect_features,
A8 constant_feature_report, A9 preprocess_report.

One aggregate pass computes, per feature, count, NaN and infinity counts,
mean, population variance, min and max (all partial aggregates, combined
map-side); the reports are derived from that single row.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.features import FeatureSpec

NEAR_ZERO = 1e-10

# Issue classes and recommendations of the inspection report.
ISSUES = {
    "ALL_ZERO_VARIANCE": "All features have zero variance. Check feature extraction process.",
    "MAJORITY_ZERO_VARIANCE": "Most features have zero variance. Consider different feature extraction.",
    "SOME_ZERO_VARIANCE": "Some features have zero variance. Will be handled automatically.",
}


def _profile(df: DataFrame, spec: FeatureSpec) -> tuple[int, list[dict]]:
    exprs = spec.exprs(df)
    aggs = [F.count(F.lit(1)).alias("n")]
    for j, e in enumerate(exprs):
        finite = F.when(~F.isnan(e) & (F.abs(e) != F.lit(float("inf"))), e)
        aggs += [F.count_if(F.isnan(e)).alias(f"nan{j}"),
                 F.count_if(F.abs(e) == F.lit(float("inf"))).alias(f"inf{j}"),
                 F.avg(finite).alias(f"m{j}"), F.var_pop(finite).alias(f"v{j}"),
                 F.min(finite).alias(f"lo{j}"), F.max(finite).alias(f"hi{j}"),
                 F.first(e, ignorenulls=True).alias(f"s{j}")]
    r = df.agg(*aggs).first()
    names = spec.names
    feats = [dict(feature=names[j], index=j, nan=r[f"nan{j}"], inf=r[f"inf{j}"], mean=r[f"m{j}"],
                  # merging partial sums can leave a rounding error in the variance of a constant
                  var=0.0 if r[f"lo{j}"] is not None and r[f"lo{j}"] == r[f"hi{j}"] else r[f"v{j}"], lo=r[f"lo{j}"], hi=r[f"hi{j}"], sample=r[f"s{j}"])
             for j in range(len(exprs))]
    return r["n"], feats


def feature_stats(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """(feature, index, mean, variance [ddof 0], min, max, range)."""
    _, feats = _profile(df, spec)
    rows = [(f["feature"], f["index"], f["mean"], f["var"], f["lo"], f["hi"],
             None if f["hi"] is None else f["hi"] - f["lo"]) for f in feats]
    return df.sparkSession.createDataFrame(
        rows, "feature string, feature_index int, mean double, variance double, min double, max double, range double")


def inspect_features(df: DataFrame, spec: FeatureSpec, debug: bool = True) -> DataFrame:
    """One-row inspection report (validity, NaN/inf, variance classes, issue)."""
    n, feats = _profile(df, spec)
    d = len(feats)
    schema = ("valid boolean, error string, n_samples bigint, n_features int, has_nan boolean, has_inf boolean, "
              "nan_count bigint, inf_count bigint, mean_variance double, min_variance double, max_variance double, "
              "mean_range double, zero_variance_count int, near_zero_variance_count int, "
              "non_zero_variance_count int, zero_variance_percent double, issue string, recommendation string, "
              "constant_feature_samples string")
    spark = df.sparkSession
    if n == 0 or d == 0:
        return spark.createDataFrame([(False, "Empty feature array", n, d) + (None,) * 15], schema)
    nan_c = sum(f["nan"] for f in feats)
    inf_c = sum(f["inf"] for f in feats)
    if nan_c or inf_c:
        return spark.createDataFrame([(False, "Features contain NaN or infinite values", n, d, nan_c > 0,
                                       inf_c > 0, nan_c, inf_c) + (None,) * 11], schema)
    var = [f["var"] for f in feats]
    rng = [f["hi"] - f["lo"] for f in feats]
    zero = sum(1 for v in var if v == 0)
    near = sum(1 for v in var if 0 < v < NEAR_ZERO)
    nonzero = sum(1 for v in var if v > 0)
    issue = None
    if zero == d:
        issue = "ALL_ZERO_VARIANCE"
    elif zero > d * 0.5:
        issue = "MAJORITY_ZERO_VARIANCE"
    elif zero > 0:
        issue = "SOME_ZERO_VARIANCE"
    samples = None
    if debug and zero:
        const = [f for f in feats if f["var"] == 0][:5]
        samples = ";".join(f"{f['feature']}={f['sample']!r}" for f in const)
    row = (True, None, n, d, False, False, 0, 0, sum(var) / d, min(var), max(var), sum(rng) / d,
           zero, near, nonzero, zero / d * 100.0, issue, ISSUES.get(issue), samples)
    return spark.createDataFrame([row], schema)


def constant_feature_report(df: DataFrame, spec: FeatureSpec, limit: int = 5) -> DataFrame:
    """First ``limit`` constant features with their value (reported when
    fewer than 10 % of more than 10 features vary)."""
    n, feats = _profile(df, spec)
    d = len(feats)
    varying = sum(1 for f in feats if (f["var"] or 0) > 0)
    rows = []
    if d > 10 and varying < d * 0.1:
        rows = [(f["feature"], f["index"], f["sample"]) for f in feats if (f["var"] or 0) == 0][:limit]
    return df.sparkSession.createDataFrame(rows, "feature string, feature_index int, value double")


def preprocess_report(df: DataFrame, spec: FeatureSpec) -> DataFrame:
    """Original shape, zero / near-zero / non-zero variance counts,
    whether noise is needed, and the kept-feature mask."""
    n, feats = _profile(df, spec)
    var = [f["var"] or 0.0 for f in feats]
    zero = sum(1 for v in var if v == 0)
    near = sum(1 for v in var if 0 < v < NEAR_ZERO)
    nonzero = sum(1 for v in var if v > 0)
    mask = [v > 0 for v in var]
    row = (n, len(feats), zero, near, nonzero, nonzero == 0, mask)
    return df.sparkSession.createDataFrame(
        [row], "n_samples bigint, n_features int, zero_variance_count int, near_zero_variance_count int, "
               "non_zero_variance_count int, needs_noise boolean, kept_mask array<boolean>")
