"""Binding of the review data model to the driver's TPC-H-style test tables.

reviews  = lineitem joined to orders (the reviewing user is ``o_custkey``)
books    = part (join key ``p_partkey``; ``p_name`` is a non-unique title)

Column roles (fixed choices, used by every plan and by the SQL oracles):

=====================  =============================================
review role            test expression
=====================  =============================================
score (stratum)        l_linenumber (1..7)
helpfulness "a/b"      l_linenumber || '/' || floor(l_quantity)
user_id                o_custkey
review_time            l_shipdate
review_text            o_orderpriority (short strings of varying length)
label (evaluation)     l_returnflag = 'R'  (``is_returned``)
title (join key)       l_partkey  ->  p_partkey
ratings_count          p_size
categories             p_type
=====================  =============================================
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.sources.tables import scan_table

LINEITEM_COLS = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
                 "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
                 "l_shipdate"]


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = scan_table(spark, sf_dir, "lineitem")
    od = scan_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    j = li.join(od, li.l_orderkey == od.o_orderkey, "inner")
    return j.select(
        # full lineitem rows are distinct: hash of the whole row is the row id
        F.xxhash64(*[F.col(c) for c in LINEITEM_COLS]).alias("row_id"),
        F.col("l_partkey").alias("title"),
        F.col("l_linenumber").cast("double").alias("score"),
        F.concat(F.col("l_linenumber").cast("string"), F.lit("/"),
                 F.floor("l_quantity").cast("bigint").cast("string")).alias("helpfulness"),
        F.col("o_custkey").alias("user_id"),
        F.col("l_shipdate").alias("review_time"),
        F.col("o_orderpriority").alias("review_text"),
        F.col("o_orderpriority").alias("summary"),
        F.col("o_orderkey").alias("order_key"),
        F.col("l_linenumber").alias("line_number"),
        F.col("l_suppkey").alias("supp_key"),
        F.col("l_quantity").alias("quantity"),
        F.col("l_extendedprice").alias("price"),
        F.col("l_discount").alias("discount"),
        F.col("l_tax").alias("tax"),
        (F.col("l_returnflag") == F.lit("R")).alias("is_returned"),
    )


def books(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scan_table(spark, sf_dir, "part")
    return p.select(
        F.col("p_partkey").alias("title"),
        F.col("p_name").alias("book_name"),
        F.col("p_type").alias("categories"),
        F.col("p_size").cast("double").alias("ratings_count"),
    )


# SQL (DuckDB dialect) for the same two views; used by the oracles.
REVIEWS_SQL = """
  SELECT l.l_partkey AS title,
         CAST(l.l_linenumber AS DOUBLE) AS score,
         CAST(l.l_linenumber AS VARCHAR) || '/' || CAST(CAST(floor(l.l_quantity) AS BIGINT) AS VARCHAR) AS helpfulness,
         o.o_custkey AS user_id,
         l.l_shipdate AS review_time,
         o.o_orderpriority AS review_text,
         o.o_orderkey AS order_key,
         l.l_linenumber AS line_number, l.l_suppkey AS supp_key, l.l_quantity AS quantity,
         l.l_extendedprice AS price, l.l_discount AS discount, l.l_tax AS tax,
         l.l_returnflag = 'R' AS is_returned
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
"""

BOOKS_SQL = """
  SELECT p_partkey AS title, p_name AS book_name, p_type AS categories,
         CAST(p_size AS DOUBLE) AS ratings_count
  FROM part
"""


# Portable rank key for exact samples / splits (same value in Spark and SQL),
# followed by tie-breakers that make the order total (these lineitem columns
# are unique together at every scale).
RANK_KEY_SQL = "(order_key * 7919 + title * 31 + line_number) % 1000003"
TIE_COLS = ["order_key", "line_number", "title", "supp_key", "price", "quantity", "discount", "tax"]


def with_rank_cols(df: DataFrame) -> tuple[DataFrame, list[str]]:
    out = (df.withColumn("rk", F.expr(RANK_KEY_SQL))
             .withColumn("ship_us", F.unix_micros(F.col("review_time").cast("timestamp"))))
    return out, ["rk", *TIE_COLS, "ship_us"]
