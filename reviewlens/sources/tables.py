"""Scans of the review / book tables and of a landing directory.

CSV input is read with an explicit schema (no inference pass over the data)
and renamed once to snake_case, so downstream code never needs back-quoted
names such as ``review/score``. CSV with embedded newlines (``multiLine``)
cannot be split, so large landings should be converted to parquet once with
:func:`land_as_parquet` and queried from there.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.session import list_names, materialize

# Tokens that pandas' CSV reader treats as missing by default.
PANDAS_NA_TOKENS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan",
    "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a",
    "nan", "null",
]

REVIEWS_SCHEMA = T.StructType([
    T.StructField("Id", T.StringType()),
    T.StructField("Title", T.StringType()),
    T.StructField("Price", T.StringType()),
    T.StructField("User_id", T.StringType()),
    T.StructField("profileName", T.StringType()),
    T.StructField("review/helpfulness", T.StringType()),
    T.StructField("review/score", T.StringType()),
    T.StructField("review/time", T.StringType()),
    T.StructField("review/summary", T.StringType()),
    T.StructField("review/text", T.StringType()),
])

BOOKS_SCHEMA = T.StructType([
    T.StructField("Title", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("authors", T.StringType()),
    T.StructField("image", T.StringType()),
    T.StructField("previewLink", T.StringType()),
    T.StructField("publisher", T.StringType()),
    T.StructField("publishedDate", T.StringType()),
    T.StructField("infoLink", T.StringType()),
    T.StructField("categories", T.StringType()),
    T.StructField("ratingsCount", T.StringType()),
])

REVIEW_RENAMES = {
    "Title": "title", "User_id": "user_id", "review/helpfulness": "helpfulness",
    "review/score": "score", "review/time": "review_epoch",
    "review/summary": "summary", "review/text": "review_text",
}
BOOK_RENAMES = {"Title": "title", "categories": "categories", "ratingsCount": "ratings_count"}


def _na_to_null(c: str):
    return F.when(F.col(c).isin(PANDAS_NA_TOKENS), F.lit(None)).otherwise(F.col(c))


def _read_csv(spark: SparkSession, path: str, schema: T.StructType | None) -> DataFrame:
    r = (spark.read.option("header", True).option("multiLine", True)
         .option("escape", '"').option("mode", "PERMISSIVE"))
    if schema is not None:
        r = r.schema(schema).option("enforceSchema", False)
    return r.csv(path)


def normalize_review_columns(df: DataFrame) -> DataFrame:
    """Rename reference-style review columns to snake_case and type them."""
    out = df
    for c in df.columns:
        if df.schema[c].dataType == T.StringType():
            out = out.withColumn(c, _na_to_null(c))
    sel = []
    for src, dst in REVIEW_RENAMES.items():
        if src not in out.columns:
            continue
        col = F.col(f"`{src}`")
        if dst == "score":
            col = col.try_cast("double")
        elif dst == "review_epoch":
            col = col.try_cast("bigint")
        sel.append(col.alias(dst))
    return out.select(*sel)


def normalize_book_columns(df: DataFrame) -> DataFrame:
    out = df
    for c in df.columns:
        if df.schema[c].dataType == T.StringType():
            out = out.withColumn(c, _na_to_null(c))
    sel = []
    for src, dst in BOOK_RENAMES.items():
        if src not in out.columns:
            continue
        col = F.col(f"`{src}`")
        if dst == "ratings_count":
            col = col.try_cast("double")
        sel.append(col.alias(dst))
    return out.select(*sel)


def scan_reviews(spark: SparkSession, path: str, schema: T.StructType | None = REVIEWS_SCHEMA) -> DataFrame:
    """Reviews CSV (or parquet if ``path`` ends with .parquet)."""
    if path.endswith(".parquet"):
        return normalize_review_columns(spark.read.parquet(path))
    return normalize_review_columns(_read_csv(spark, path, schema))


def scan_books(spark: SparkSession, path: str, schema: T.StructType | None = BOOKS_SCHEMA) -> DataFrame:
    """Books CSV (or parquet)."""
    if path.endswith(".parquet"):
        return normalize_book_columns(spark.read.parquet(path))
    return normalize_book_columns(_read_csv(spark, path, schema))


def with_ids(df: DataFrame, name: str) -> DataFrame:
    """A scanned landing written once with a row number ``name`` of its own, so
    that the id of a row is the same in every later pass."""
    return materialize(df.withColumn(name, F.monotonically_increasing_id()))


def land_as_parquet(df: DataFrame, path: str, partitions: int | None = None) -> str:
    """Write a scanned landing once as parquet so later scans split and prune."""
    w = df if partitions is None else df.repartition(partitions)
    w.write.mode("overwrite").parquet(path)
    return path


def rebalance_if_undersplit(df: DataFrame) -> DataFrame:
    """Spread a scan with fewer splits than the cluster has cores.

    Parquet splits at row-group granularity, so a single-row-group file is
    read by one task and every narrow operator before the first shuffle runs
    on one core. The scan's own split count decides, wherever the file lies;
    a large source has more splits than cores and gets no shuffle.
    """
    par = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= par else df.repartition(par)


def scan_table(spark: SparkSession, sf_dir: str, name: str, rebalance: bool = True) -> DataFrame:
    path = os.path.join(sf_dir, f"{name}.parquet")
    df = spark.read.parquet(path)
    return rebalance_if_undersplit(df) if rebalance else df


def source_catalog(spark: SparkSession, landing_dir: str, required: list[str] | None = None,
                   register: bool = True) -> DataFrame:
    """Map file stems of a landing directory to paths, register temp views.

    Returns a DataFrame ``(stem, path, format)``. Raises when a required stem
    is missing (the reference fails the same way before loading).
    """
    rows = []
    for name in list_names(spark, landing_dir):
        stem, ext = os.path.splitext(name)
        ext = ext.lower().lstrip(".")
        if ext in ("csv", "parquet", "json"):
            rows.append((stem, os.path.join(landing_dir, name), ext))
    missing = [r for r in (required or []) if r not in {s for s, _, _ in rows}]
    if missing:
        raise FileNotFoundError(f"missing required sources: {missing}")
    if register:
        for stem, path, ext in rows:
            reader = spark.read
            if ext == "csv":
                df = _read_csv(spark, path, None)
            else:
                df = getattr(reader, ext)(path)
            df.createOrReplaceTempView(stem)
    schema = "stem string, path string, format string"
    return spark.createDataFrame(rows, schema)
