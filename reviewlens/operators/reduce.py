"""Arrays of rows in a task, and sums of model-sized arrays over all tasks, reduced by Spark."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: partial sums that meet in one task of the first reduction
FAN_IN = 16


def array_rows(column: pa.Array) -> np.ndarray:
    """An array column of one width as a matrix of doubles, without a Python object per row."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64, copy=False)


def array_sums(parts: DataFrame, names: list[str]) -> tuple[int, list[np.ndarray]]:
    """The sum of the column ``n`` and of the array columns ``names`` over all rows,
    in two reductions: the driver gets one row, however many tasks there were."""
    tree = parts.select("n", *[array_to_vector(c).alias(c) for c in names], F.floor(F.spark_partition_id() / FAN_IN).alias("_bucket"))
    some = tree.groupBy("_bucket").agg(F.sum("n").alias("n"), *[Summarizer.sum(F.col(c)).alias(c) for c in names])
    # a group of all rows: without rows there is no group and no summary of nothing
    r = some.groupBy(F.lit("all")).agg(F.sum("n").alias("n"), *[Summarizer.sum(F.col(c)).alias(c) for c in names]).first()
    return (r["n"], [r[c].toArray() for c in names]) if r else (0, [np.zeros(0) for _ in names])
