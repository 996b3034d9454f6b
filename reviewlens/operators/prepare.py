"""Preparation chain: join, impute, per-user counts, stratified cap, splits.

J1 review_book_join, J2 user_activity, A1/A2 mean_impute, A3 user_counts,
A4 first_time, F1 drop_missing, P11 numeric_features, O1 stratified_cap,
O2 train_test_split, O8 kfold.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.functions.scalar import (epoch_to_timestamp, days_since, fill_text, helpfulness_ratio,
                                         nan_to_null, review_length)
from reviewlens.operators.ranking import (MAX_REGION_GROUPS, SMALL_GROUP_ROWS, rank_select,
                                         rank_threshold_filter)

NUMERIC_FEATURES = ["score", "helpfulness_ratio", "ratings_count", "review_length",
                    "user_review_count", "days_since_first"]


def review_book_join(reviews: DataFrame, books: DataFrame, key: str = "title",
                     null_keys_match: bool = True, suffixes=("_x", "_y")) -> DataFrame:
    """Inner equi-join on ``key``; m:n fan-out; NULL keys match NULL keys.

    Clashing non-key columns get pandas-style suffixes. The strategy
    (broadcast / sort-merge) is left to AQE; a dominant key (e.g. a NULL title
    holding a large share) is split by AQE skew-join handling.
    """
    r, b = reviews.alias("r"), books.alias("b")
    cond = F.col(f"r.{key}").eqNullSafe(F.col(f"b.{key}")) if null_keys_match \
        else F.col(f"r.{key}") == F.col(f"b.{key}")
    clash = (set(reviews.columns) & set(books.columns)) - {key}
    sel = [F.col(f"r.{key}").alias(key)]
    for c in reviews.columns:
        if c != key:
            sel.append(F.col(f"r.{c}").alias(c + suffixes[0] if c in clash else c))
    for c in books.columns:
        if c != key:
            sel.append(F.col(f"b.{c}").alias(c + suffixes[1] if c in clash else c))
    return r.join(b, cond, "inner").select(*sel)


def join_fanout_counts(left: DataFrame, right: DataFrame, key: str,
                       null_keys_match: bool = True) -> DataFrame:
    """Rows an m:n equi-join produces per key, without materialising the join.

    Both sides are reduced to (key, count) first (map-side combine), so the
    shuffle carries one row per key and partition, and a hot key costs
    nothing extra: count(key) = count_left(key) * count_right(key).
    """
    lc = left.groupBy(key).agg(F.count("*").alias("_nl"))
    rc = right.groupBy(key).agg(F.count("*").alias("_nr")).withColumnRenamed(key, "_k")
    cond = lc[key].eqNullSafe(rc["_k"]) if null_keys_match else lc[key] == rc["_k"]
    return lc.join(rc, cond, "inner").select(
        F.col(key), F.col("_nl").alias("left_rows"), F.col("_nr").alias("right_rows"),
        (F.col("_nl") * F.col("_nr")).alias("joined_rows"))


def user_counts(df: DataFrame, user_col: str = "user_id") -> DataFrame:
    """A3: rows per non-NULL user (partial aggregation before the shuffle)."""
    return df.where(F.col(user_col).isNotNull()).groupBy(user_col).agg(
        F.count("*").cast("bigint").alias("user_review_count"))


def user_activity(df: DataFrame, user_col: str = "user_id", out: str = "user_review_count",
                  null_as_zero: bool = True) -> DataFrame:
    """Attach the number of rows of the same user to every row.

    Expressed as aggregate + join rather than a ``partitionBy(user)`` window:
    the aggregate combines map-side, and AQE can broadcast the counts or split
    a hot user's partition, whereas a window would sort a hot user in one task.
    """
    cnt = user_counts(df, user_col).withColumnRenamed("user_review_count", "_cnt")
    j = df.join(cnt, on=user_col, how="left")
    v = F.coalesce(F.col("_cnt"), F.lit(0)) if null_as_zero else F.col("_cnt")
    return j.withColumn(out, v.cast("bigint")).drop("_cnt")


def column_means(df: DataFrame, cols: list[str]) -> dict[str, float | None]:
    """NaN-ignoring means of ``cols`` (one aggregate, one row to the driver)."""
    if not cols:
        return {}
    r = df.agg(*[F.avg(nan_to_null(c)).alias(c) for c in cols]).first()
    return {c: r[c] for c in cols}


def mean_impute(df: DataFrame, cols: list[str], means: dict | None = None) -> tuple[DataFrame, dict]:
    """A1/A2: NaN/NULL -> column mean (computed on ``df`` unless given).

    An all-NULL column has no mean and stays NULL (F1 can drop those rows).
    Returns the imputed frame and the means so they can be stored and
    re-applied to new rows.
    """
    means = dict(means) if means is not None else column_means(df, cols)
    out = df
    for c in cols:
        m = means.get(c)
        v = nan_to_null(c)
        out = out.withColumn(c, F.coalesce(v, F.lit(m).cast("double")) if m is not None else v)
    return out, means


def drop_missing(df: DataFrame, cols: list[str]) -> DataFrame:
    """drop rows with NULL/NaN in any of ``cols``."""
    cond = F.lit(True)
    for c in cols:
        cond = cond & F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))
    return df.where(cond)


def first_time(df: DataFrame, time_col: str = "review_time") -> int | None:
    """A4: global minimum timestamp, as epoch microseconds (time-zone free)."""
    return df.agg(F.min(F.unix_micros(F.col(time_col).cast("timestamp"))).alias("t0")).first()["t0"]


def load_reviews(reviews: DataFrame, books: DataFrame, key: str = "title",
                 null_keys_match: bool = True, impute_score: bool = True) -> tuple[DataFrame, dict]:
    """Reference ``load_data`` minus the cap: P1, P2, J1, P3, A1, F1.

    ``review_epoch`` becomes ``review_time`` when there is none. With a
    ``review_id`` and a ``book_id`` (see ``sources.tables.with_ids``) the rows
    of the m:n join get ``row_id`` from the pair.
    """
    r = reviews.withColumn("helpfulness_ratio", helpfulness_ratio("helpfulness"))
    if "review_epoch" in r.columns and "review_time" not in r.columns:
        r = r.withColumn("review_time", epoch_to_timestamp("review_epoch"))
    m = review_book_join(r, books, key, null_keys_match)
    if "review_id" in m.columns and "book_id" in m.columns and "row_id" not in m.columns:
        m = m.withColumn("row_id", F.concat_ws(":", "review_id", "book_id"))
    for c in ("review_text", "summary", "categories"):
        if c in m.columns:
            m = m.withColumn(c, fill_text(c))
    num = ["score", "helpfulness_ratio", "ratings_count"] if impute_score else ["helpfulness_ratio", "ratings_count"]
    m, means = mean_impute(m, num)
    # after imputation only a column without any value (mean NULL) can be missing
    empty = [c for c in num if means.get(c) is None]
    if empty:
        m = drop_missing(m, empty)
    return m, means


def numeric_features(df: DataFrame, user_col: str = "user_id", time_col: str = "review_time",
                     text_col: str = "review_text", t0=None) -> tuple[DataFrame, dict]:
    """The six behavioural columns.

    score, helpfulness_ratio, ratings_count, review_length, user_review_count,
    days_since_first. ``t0`` (first review time in epoch microseconds, A4) is
    computed unless given,
    and returned so new rows are featurised with the same origin.
    """
    if t0 is None:
        t0 = first_time(df, time_col)
    out = user_activity(df, user_col)
    if text_col in out.columns:
        out = out.withColumn("review_length", review_length(text_col).cast("double"))
    elif "review_length" not in out.columns:
        raise ValueError(f"need {text_col} or a review_length column")
    out = (out.withColumn("user_review_count", F.col("user_review_count").cast("double"))
              .withColumn("days_since_first", days_since(F.col(time_col), F.timestamp_micros(F.lit(t0)))))
    return out, {"t0": t0}


# ---------------------------------------------------------------- sampling

def default_rank_cols(df: DataFrame, id_col: str = "row_id", seed: int = 42) -> tuple[DataFrame, list[str]]:
    """Two independent 64-bit hashes of the row id: a practically unique order."""
    out = (df.withColumn("_rk1", F.xxhash64(F.lit(seed), F.col(id_col)))
             .withColumn("_rk2", F.xxhash64(F.lit(seed + 1), F.col(id_col))))
    return out, ["_rk1", "_rk2"]


def stratified_cap(df: DataFrame, strata_col: str, max_records: int,
                   order_cols: list[str] | None = None, id_col: str = "row_id",
                   seed: int = 42, use_full_dataset: bool = False, max_collect: int = 20_000) -> DataFrame:
    """O1: keep exactly floor(max_records * n_g / n) rows of every stratum g.

    Rows are taken in ascending ``order_cols`` (default: two hashes of
    ``id_col`` with ``seed``), i.e. a seeded uniform sample without
    replacement. Instead of a per-stratum ``row_number`` (one task per
    stratum), the cut-off row of a large stratum is found by
    :func:`rank_select` and its cap becomes a plain filter.
    """
    drop = []
    if order_cols is None:
        df, order_cols = default_rank_cols(df, id_col, seed)
        drop = list(order_cols)
    counts = df.groupBy(strata_col).count().collect()
    n = sum(r["count"] for r in counts)
    if use_full_dataset or n <= max_records:
        return df.drop(*drop)
    quota = {r[strata_col]: (max_records * r["count"]) // n for r in counts}
    sizes = {r[strata_col]: r["count"] for r in counts}
    return _capped(df, strata_col, quota, sizes, order_cols, max_collect).drop(*drop)


def _capped(df: DataFrame, strata_col: str, quota: dict, sizes: dict, order_cols: list[str],
                         max_collect: int) -> DataFrame:
    """A per-stratum ``row_number`` for strata of at most SMALL_GROUP_ROWS rows
    (window partitions bounded), the cut-off by rank selection for the (few)
    larger strata; quotas travel as a joined table. NULL is a stratum."""
    spark = df.sparkSession
    st_type = df.schema[strata_col].dataType.simpleString()
    big = [g for g, nrows in sizes.items() if nrows > SMALL_GROUP_ROWS and quota[g] > 0]
    qdf = spark.createDataFrame([(g, int(q)) for g, q in quota.items()], f"_stratum {st_type}, _quota long")
    small = df.join(qdf, df[strata_col].eqNullSafe(F.col("_stratum"))).drop("_stratum")
    if big:
        bdf = spark.createDataFrame([(g,) for g in big], f"_stratum {st_type}")
        small = small.join(bdf, small[strata_col].eqNullSafe(F.col("_stratum")), "left_anti")
    w = Window.partitionBy(strata_col).orderBy(*[F.col(c) for c in order_cols])
    out = small.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= F.col("_quota")) \
        .drop("_rn", "_quota")
    if big:
        cut = rank_select(df, order_cols, [((g,), quota[g] - 1) for g in big], [strata_col], max_collect=max_collect)
        thr_rows = [(g, *cut[((g,), quota[g] - 1)]) for g in big]
        types = ", ".join(f"_t{j} {df.schema[c].dataType.simpleString()}" for j, c in enumerate(order_cols))
        tdf = spark.createDataFrame(thr_rows, f"_stratum {st_type}, {types}")
        bigrows = df.join(tdf, df[strata_col].eqNullSafe(F.col("_stratum"))).drop("_stratum")
        keep = F.struct(*[F.col(c) for c in order_cols]) <= F.struct(*[F.col(f"_t{j}").alias(c)
                                                                       for j, c in enumerate(order_cols)])
        out = out.unionByName(bigrows.where(keep).drop(*[f"_t{j}" for j in range(len(order_cols))]))
    return out


def train_test_split(df: DataFrame, test_size: float = 0.2, order_cols: list[str] | None = None,
                     id_col: str = "row_id", seed: int = 42, stratify: str | None = None,
                     max_collect: int = 20_000) -> DataFrame:
    """O2: adds ``is_test``; exactly ceil(n * test_size) test rows (per stratum if given)."""
    drop = []
    if order_cols is None:
        df, order_cols = default_rank_cols(df, id_col, seed)
        drop = list(order_cols)
    gcols = [stratify] if stratify else []
    counts = (df.groupBy(*gcols).count().collect() if gcols
              else [df.agg(F.count("*").alias("count")).first()])
    cond = F.lit(False)
    targets, need = [], {}
    for r in counts:
        g = tuple(r[c] for c in gcols)
        k = int(math.ceil(r["count"] * test_size))
        if k > 0:
            targets.append((g, k - 1))
            need[g] = k - 1
    cut = rank_select(df, order_cols, targets, gcols, max_collect=max_collect)
    for g, r in need.items():
        gc = F.lit(True)
        for c, v in zip(gcols, g):
            gc = gc & F.col(c).eqNullSafe(F.lit(v))
        cond = cond | (gc & rank_threshold_filter(order_cols, cut[(g, r)]))
    return df.withColumn("is_test", cond).drop(*drop)


def kfold(df: DataFrame, k: int = 3, id_col: str = "row_id", seed: int = 42, key: Column | None = None) -> DataFrame:
    """Fold id = pmod(key, k), by default with a hash of (seed, id) as the
    key — independent of partitioning."""
    key = F.xxhash64(F.lit(seed), F.col(id_col)) if key is None else key
    return df.withColumn("fold", F.pmod(key, F.lit(k)).cast("int"))


def hash_rank_fraction(id_col: str = "row_id", seed: int = 42) -> Column:
    """A uniform [0,1) value per row, for nested subsets (learning curves)."""
    h = F.xxhash64(F.lit(seed), F.col(id_col))
    return F.pmod(h, F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))
