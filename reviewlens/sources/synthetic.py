"""S14 synthetic_reviews: seeded demo / property-test data built by Spark.

Every random draw is a hash of (row id, column, seed), so the data does not
depend on the number of partitions. Used by tests (planted outliers), never
by registered queries.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: the sentence the demo repeats 1-4 times as review text.
DEMO_SENTENCE = "This is a sample review text. "
BASE_TIME = "2024-01-01 00:00:00"


def _u(seed: int, tag: int):
    h = F.xxhash64(F.lit(seed), F.lit(tag), F.col("id"))
    return (F.pmod(h, F.lit(1 << 53)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))


def _n(seed: int, tag: int):
    return F.sqrt(F.lit(-2.0) * F.log(_u(seed, tag))) * F.cos(F.lit(2 * math.pi) * _u(seed, tag + 100003))


def synthetic_reviews(spark: SparkSession, n: int = 1000, n_features: int = 50, seed: int = 42,
                      anomaly_share: float = 0.1, planted_shift: float = 0.0,
                      partitions: int | None = None) -> DataFrame:
    """Scores 1-5, repeated text, helpfulness in [0,1), users user_1..user_99,
    a time within 365 days of a fixed base, ``n_features`` N(0,1) features and
    exactly ``round(anomaly_share*n)`` planted anomalies (lowest hash ranks).

    With ``planted_shift`` > 0 the planted rows are moved by that distance
    along a random direction (planted-outlier property tests).
    """
    df = spark.range(0, n, 1, partitions)
    k = int(round(anomaly_share * n))
    rank_key = F.xxhash64(F.lit(seed), F.lit(-1), F.col("id"))
    df = df.withColumn("_rk", rank_key)
    if k > 0:
        cut = df.orderBy("_rk").limit(k).agg(F.max("_rk").alias("m")).first()["m"]
        planted = F.col("_rk") <= F.lit(cut)
    else:
        planted = F.lit(False)
    feats = [_n(seed, j) for j in range(n_features)]
    if planted_shift:
        direction = [math.sin(j + 1.0) for j in range(n_features)]
        norm = math.sqrt(sum(d * d for d in direction)) or 1.0
        feats = [F.when(planted, f + F.lit(planted_shift * d / norm)).otherwise(f)
                 for f, d in zip(feats, direction)]
    return df.select(
        F.col("id").alias("row_id"),
        (F.floor(_u(seed, 1) * 5) + 1).cast("int").alias("score"),
        F.repeat(F.lit(DEMO_SENTENCE), (F.floor(_u(seed, 2) * 4) + 1).cast("int")).alias("review_text"),
        _u(seed, 3).alias("helpfulness_ratio"),
        F.concat(F.lit("user_"), (F.floor(_u(seed, 4) * 99) + 1).cast("int").cast("string")).alias("user_id"),
        (F.lit(BASE_TIME).cast("timestamp")
         - F.make_dt_interval(F.floor(_u(seed, 5) * 365).cast("int"))).alias("review_time"),
        F.array(*feats).alias("features"),
        planted.alias("is_planted"),
    )
