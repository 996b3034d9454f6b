"""Helpers shared by the text operators."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.session import ensure_checkpoint_dir, remember, scratch_path, ship_package

#: a list of ids of at most this many rows (16 MB) may be broadcast
BROADCAST_IDS = 2_000_000


def prepare(spark: SparkSession) -> None:
    """Shared folder and package for Python workers; safe to call repeatedly."""
    ensure_checkpoint_dir(spark)
    ship_package(spark)


def materialize(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read again: later passes scan
    columns of a file, and a lost executor costs only its own tasks. The table
    is known to ``drop_scratch_tables`` and ``scratch_scope``."""
    path = scratch_path(df.sparkSession, uuid.uuid4().hex)
    df.write.parquet(path)
    remember(df.sparkSession, path)
    out = df.sparkSession.read.parquet(path)
    out.scratch = path
    return out


def free(*frames: DataFrame) -> None:
    """Delete materialized tables that no frame in use reads any more."""
    for df in frames:
        spark = df.sparkSession
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(df.scratch)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def keyed_text(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns an operator needs, under fixed names.

    Further columns of ``df``, whatever their names, never reach the operator.
    """
    return df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"),
                     F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))


def small(df: DataFrame, limit: int = BROADCAST_IDS) -> DataFrame:
    """Broadcast hint for a frame of ids or pairs, only if it is proven small."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def passages(text: Column, seed: Column, most: int, length: int) -> Column:
    """A text of at most ``most`` code points whole; of a longer one, passages of
    ``length`` that together have at most as many: one from a place drawn by
    ``seed`` in each of equal stretches of the whole text."""
    parts = max(1, most // (length + 1))
    stretch = F.greatest(F.floor(F.length(text) / parts), F.lit(1))
    at = lambda i: (i * stretch + F.pmod(F.xxhash64(seed, i), F.greatest(stretch - length, F.lit(1))) + 1).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), F.lit(parts - 1)), lambda i: F.substring(text, at(i), F.lit(length)))
    return F.when(F.length(text) > most, F.array_join(drawn, "\n")).otherwise(text)


def text_hash(text: Column) -> Column:
    """Tells the texts of one id apart; a null text counts as an empty one."""
    return F.xxhash64(F.coalesce(text.cast("string"), F.lit("")))


def without(docs: DataFrame, dropped: DataFrame, id_col: str = "doc_id", text_col: str | None = None) -> DataFrame:
    """Rows of ``docs`` whose id is not in ``dropped`` (one long column). With
    ``text_col``, ``dropped`` has the hash of the text as a second column and
    both must be equal; null ids are then rows like any other."""
    names = ["_dropped_id", "_dropped_hash"][:1 if text_col is None else 2]
    ids = dropped.select(*[F.col(c).alias(n) for c, n in zip(dropped.columns, names)])
    same = docs[id_col].eqNullSafe(F.col("_dropped_id"))
    if text_col is not None:
        same = same & (text_hash(docs[text_col]) == F.col("_dropped_hash"))
    return docs.join(small(ids), same, "left_anti")


def large_string(batch: pa.RecordBatch, name: str) -> list:
    """A text column as Python strings, nulls as empty ones."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


__all__ = ["BROADCAST_IDS", "free", "keyed_text", "large_string", "materialize", "passages", "prepare", "read_table",
           "shuffle_partitions", "small", "text_hash", "without"]
