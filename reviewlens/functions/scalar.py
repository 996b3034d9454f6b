"""Scalar column expressions (all JVM-side, codegen friendly).

Every function takes and returns ``Column`` objects so it can be used in
``select``/``withColumn`` and composes with Catalyst optimisations.
Spark 4 runs with ANSI mode on: the helpers use ``try_*`` forms where the
input may be malformed, so bad rows become NULL instead of failing the job.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _ts(c) -> Column:
    """Timestamp with local time zone; NTZ inputs are read in the session
    time zone (pinned to UTC), matching engines that treat naive times as UTC."""
    return _c(c).cast("timestamp")


def nan_to_null(c) -> Column:
    """NaN -> NULL (pandas treats both as missing; Spark keeps them apart)."""
    return F.nanvl(_c(c).cast("double"), F.lit(None).cast("double"))


def helpfulness_parts(c) -> tuple[Column, Column]:
    """``"a/b"`` -> (a, b) as doubles; malformed parts become NULL."""
    parts = F.split(_c(c), "/")
    a = F.get(parts, 0).try_cast("double")
    b = F.get(parts, 1).try_cast("double")
    return a, b


def helpfulness_ratio(c) -> Column:
    """``"a/b"`` -> a / b. A zero denominator yields NULL (imputed later, Q1)."""
    a, b = helpfulness_parts(c)
    return F.try_divide(a, b)   # NULL when b is 0 or NULL


def epoch_to_timestamp(c) -> Column:
    """Epoch seconds -> timestamp."""
    return F.timestamp_seconds(_c(c))


def fill_text(c) -> Column:
    """NULL text -> empty string."""
    return F.coalesce(_c(c).cast("string"), F.lit(""))


def review_length(c) -> Column:
    """Characters (code points) in a text."""
    return F.length(fill_text(c)).cast("bigint")


def days_since(t, t0) -> Column:
    """Fractional days between ``t0`` and ``t`` (P5)."""
    return (F.unix_micros(_ts(t)) - F.unix_micros(_ts(t0))).cast("double") / F.lit(86400e6)


def whole_days_since(t, t0) -> Column:
    """Whole days between ``t0`` and ``t`` (P6), truncated toward zero."""
    return F.timestamp_diff("DAY", _ts(t0), _ts(t)).cast("bigint")


def unix_time(t) -> Column:
    """Timestamp -> epoch seconds."""
    return F.unix_seconds(_ts(t))


def display_name(c) -> Column:
    """``isolation_forest`` -> ``Isolation Forest``."""
    return F.initcap(F.regexp_replace(_c(c), "_", " "))


def flag_label(c) -> Column:
    """Boolean flag -> 'Anomaly' / 'Normal' (P9)."""
    return F.when(_c(c), F.lit("Anomaly")).otherwise(F.lit("Normal"))


def row_hash(*cols, seed: int = 42) -> Column:
    """Stable 64-bit row hash; independent of partitioning."""
    return F.xxhash64(F.lit(seed), *[_c(c) for c in cols])


def hash_uniform(*cols, seed: int = 42) -> Column:
    """Deterministic uniform [0, 1) from a hash of ``cols`` and ``seed``."""
    h = F.xxhash64(F.lit(seed), *[_c(c) for c in cols])
    return (F.pmod(h, F.lit(1 << 53)).cast("double")) / F.lit(float(1 << 53))
