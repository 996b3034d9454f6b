"""Reference "Entry B" on the bound test tables: load -> join -> impute -> features.

The feature frame is written once (a table in the shared checkpoint folder),
with its imputation means and first review time observed by the same job;
:func:`reviews_with_books` stays lazy for queries that read it once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.functions.scalar import fill_text, helpfulness_ratio, nan_to_null, review_length
from reviewlens.operators.prepare import (NUMERIC_FEATURES, drop_missing, mean_impute, numeric_features,
                                          review_book_join)
from reviewlens.plans import bindings
from reviewlens.session import materialize_observed

IMPUTED = ["score", "helpfulness_ratio", "ratings_count"]


def _joined(spark: SparkSession, sf_dir: str, keep_text: bool = True) -> DataFrame:
    r = bindings.reviews(spark, sf_dir).withColumn("helpfulness_ratio", helpfulness_ratio("helpfulness"))
    m = review_book_join(r, bindings.books(spark, sf_dir))
    for c in ("review_text", "summary", "categories"):
        m = m.withColumn(c, fill_text(c))
    if not keep_text:
        # numeric features need only the length: long texts are not copied
        # into the intermediate table
        m = m.withColumn("review_length", review_length("review_text").cast("double")).drop("review_text", "summary")
    return m


def _impute_aggs() -> list:
    # imputation means (A1) and the first review time (A4)
    return [*[F.avg(nan_to_null(c)).alias(c) for c in IMPUTED],
            F.min(F.unix_micros(F.col("review_time").cast("timestamp"))).alias("_t0")]


def _materialize_joined(spark: SparkSession, sf_dir: str, keep_text: bool) -> tuple[DataFrame, dict]:
    """The joined frame written once; its imputation statistics observed by the same job."""
    return materialize_observed(_joined(spark, sf_dir, keep_text), _impute_aggs())


def _impute(m: DataFrame, st=None) -> tuple[DataFrame, int | None]:
    if st is None:
        st = m.agg(*_impute_aggs()).first()
    means = {c: st[c] for c in IMPUTED}
    m, _ = mean_impute(m, IMPUTED, means)
    empty = [c for c in IMPUTED if means[c] is None]
    return (drop_missing(m, empty) if empty else m), st["_t0"]


def reviews_with_books(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The joined, imputed frame, lazy: a query that needs a few columns scans
    only these (and the three imputed ones for their means). An operator that
    makes several passes writes the columns it needs first."""
    m, _ = _impute(_joined(spark, sf_dir))
    return m


def review_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the joined table with the six numeric feature columns."""
    m, t0 = _impute(*_materialize_joined(spark, sf_dir, False))
    f, _ = numeric_features(m, t0=t0)
    return f.select("row_id", "order_key", "title", "user_id", "review_time", "is_returned",
                    "line_number", "supp_key", "price", "quantity", "discount", "tax", *NUMERIC_FEATURES)
