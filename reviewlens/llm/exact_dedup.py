"""Exact duplicates by a distributed content sort (DataFrame functions only).

Method: the text without white space is written once with its length, first
code points and a hash. Spark's sampled splitters of the last two range-partition
the rows (texts with one common start still spread), an external sort inside each
partition makes equal texts neighbours, and the window over a run of equal
neighbours, told by comparing full texts, counts it and names the row that stays.

Skew: a text that may fill more than a quarter of an average partition is
found first by a count of text hashes (combined map-side) and gets a salt, drawn
by the number of the row, as second sort key, so its rows spread over several
runs. Only these runs are joined again through their SHA-256. At most
``4 * partitions`` texts can be that frequent, which bounds both tables.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, keyed_text, materialize, prepare, shuffle_partitions

#: white space that does not count, one code point each: [\x20\x09-\x0D]
SPACES = (" ", "\t", "\n", "\x0b", "\x0c", "\r")


#: code points of a text that range splitters are made of
HEAD = 32


def normalised(text: Column) -> Column:
    """The text without white space; ``replace`` works on bytes, without a regex."""
    for s in SPACES:
        text = F.replace(text, F.lit(s), F.lit(""))
    return text


def dedup_groups(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 partitions: int | None = None) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Null texts are empty texts; texts of any length are sorted and compared whole.
    In a group of equal texts the row with the
    most code points in its original text stays, then the smallest id (null
    ids last). Rows that repeat both id and length are told apart only by
    their place: exactly one row of a group has ``kept``. An empty table gives
    an empty result; other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    parts = partitions or shuffle_partitions(spark)
    # splitters are sampled from the first code points and a hash, two small columns of the
    # written table, so a sample row is small however long its text
    norm = normalised(F.col("text"))
    rows = materialize(
        keyed_text(df, id_col, text_col)
        .select("doc_id", F.length("text").alias("n"), norm.alias("norm"), F.monotonically_increasing_id().alias("row"))
        .withColumn("head", F.substring("norm", 1, HEAD)).withColumn("tail", F.xxhash64("norm")))

    hot = hot_texts(rows, parts)
    salted = (rows.join(F.broadcast(hot), "tail", "left")                 # at most 4 * parts rows
              .withColumn("salt", F.coalesce(F.pmod(F.xxhash64("row"), F.col("salts")), F.lit(-1)).cast("int")))
    run = Window.partitionBy("head", "tail", "salt", "norm")
    place = run.orderBy(F.desc("n"), F.asc_nulls_last("doc_id"), "row")
    whole = place.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    runs = materialize(
        salted.repartitionByRange(parts, "head", "tail", "salt")
        .select("doc_id", "n", "row", "salt", F.row_number().over(place).alias("rn"), F.first("doc_id").over(place).alias("keep_id"),
                F.count("*").over(whole).alias("size"), F.sha2("norm", 256).alias("text_sha256")))
    free(rows)

    best = F.struct((-F.col("n")).alias("neg_n"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("id"),
                    F.col("row").alias("row"))
    merged = (runs.filter("salt >= 0 and rn = 1").groupBy("text_sha256")
              .agg(F.sum("size").alias("all_size"), F.min(best).alias("b")))
    hot_row = F.col("salt") >= 0
    joined = runs.join(F.broadcast(merged.withColumnRenamed("text_sha256", "sha")),       # at most 4 * parts rows
                       hot_row & (F.col("text_sha256") == F.col("sha")), "left")
    return joined.select(
        "doc_id", F.when(hot_row, F.col("b.id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.when(hot_row, F.col("all_size")).otherwise(F.col("size")).alias("group_size"),
        F.when(hot_row, F.col("row") == F.col("b.row")).otherwise(F.col("rn") == 1).alias("kept"), "text_sha256")


def hot_texts(rows: DataFrame, parts: int) -> DataFrame:
    """(tail, salts) of the texts that may fill more than a quarter of a partition: at most ``4 * parts``."""
    counts = materialize(rows.groupBy("tail").agg(F.count("*").alias("c")))
    limit = max(64, (counts.agg(F.sum("c")).first()[0] or 0) // (4 * parts))
    return counts.filter(F.col("c") > limit).select("tail", F.ceil(F.col("c") / limit).alias("salts"))


def drop_exact_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one row of every group of equal texts, all columns kept.

    The dropped ids come from :func:`dedup_groups`. If an id is repeated in
    ``df``, rows are told apart by a hash of the text, and equal rows of one
    id are reduced to one.
    """
    groups = materialize(dedup_groups(df, id_col, text_col))
    cols = df.columns
    ids = groups.select("doc_id").agg(F.count("*").alias("n"), F.countDistinct("doc_id").alias("d"),
                                      F.count("doc_id").alias("k")).first()
    if ids["n"] == ids["d"] == ids["k"]:
        from .common import without
        return without(df, groups.filter("not kept").select("doc_id"), id_col)
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    kept = groups.filter("kept").select(F.col("doc_id").alias("_k_id"), F.col("text_sha256").alias("_k_sha"))
    longest = F.max_by(F.struct(*[F.col(f"`{c}`") for c in cols]), F.struct(F.length(text), F.xxhash64(text)))
    # equal rows are combined map-side before any shuffle, however many they are
    return (df.groupBy(F.col(f"`{id_col}`").alias("_id"), F.sha2(normalised(text), 256).alias("_sha")).agg(longest.alias("_row"))
            .join(kept, F.col("_id").eqNullSafe(F.col("_k_id")) & (F.col("_sha") == F.col("_k_sha")), "left_semi")
            .select("_row.*"))
