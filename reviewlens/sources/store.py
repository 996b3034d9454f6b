"""Stores and sinks: fingerprints, feature cache, results, metrics, ledger, models.

S3 feature_cache, S4 table_fingerprint, S5 write_model_results,
S6 write_metrics, S7 read_model_results, S8 read_model_metrics,
S9/S10 write_tuning_results / write_learning_curves, S11 RunLedger (with F4
pending_models, O3 latest_checkpoint, M4 tuning_status), S12 detector store,
S13 DBN store.

Everything is parquet / JSON written by Spark under a base folder that should
live on shared storage; writes use overwrite of a whole directory, which is
atomic per job commit, so a lost executor never leaves half a file behind.
Large outputs (per-row flags) are long tables partitioned by model, never an
n-long array inside a JSON document.
"""

from __future__ import annotations

import datetime as _dt
import json
import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from reviewlens.functions.scalar import display_name
from reviewlens.session import path_exists


# ------------------------------------------------------------------ S4
def table_fingerprint(df: DataFrame, cols: list[str] | None = None) -> str:
    """Order-free content fingerprint: count, xor and decimal sum of row hashes.

    A row hash covers names, types, and for every column whether it is NULL
    and its value, so a NULL never looks like a missing column.
    """
    cols = cols or df.columns
    parts = [F.lit(f"{c}:{df.schema[c].dataType.simpleString()}") for c in cols]
    h = F.xxhash64(*parts, *[x for c in cols for x in (F.col(c).isNull(), F.col(c))])
    r = df.agg(F.count("*").alias("n"), F.bit_xor(h).alias("x"),
               F.sum(h.cast("decimal(38,0)")).alias("s")).first()
    return f"{r['n']:x}-{(r['x'] or 0) & 0xFFFFFFFFFFFFFFFF:016x}-{int(r['s'] or 0) & ((1 << 96) - 1):024x}"


# ------------------------------------------------------------------ S3
def feature_cache(spark: SparkSession, base: str, key_df: DataFrame, params: dict, build) -> DataFrame:
    """Return cached features for (fingerprint of ``key_df``, params) or build and store them."""
    key = table_fingerprint(key_df) + "-" + "-".join(f"{k}={params[k]}" for k in sorted(params))
    path = os.path.join(base, "features", key.replace("/", "_"))
    if path_exists(spark, os.path.join(path, "_SUCCESS")):
        return spark.read.parquet(path)
    build().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# ------------------------------------------------------------------ S5-S8
def write_model_results(results: DataFrame, base: str, metrics: DataFrame | None = None,
                        params: dict | None = None) -> None:
    """Flags as a long table partitioned by model; metrics/params as JSON."""
    results.write.mode("overwrite").partitionBy("model").parquet(os.path.join(base, "flags"))
    if metrics is not None:
        m = metrics
        if params is not None:
            m = m.withColumn("params", F.lit(json.dumps(params, sort_keys=True)))
        m = m.withColumn("timestamp", F.date_format(F.current_timestamp(), "yyyy-MM-dd HH:mm:ss"))
        m.write.mode("overwrite").json(os.path.join(base, "metrics"))


def write_metrics(metrics: DataFrame, path: str) -> None:
    """All metrics as JSON lines (one object per model)."""
    metrics.coalesce(1).write.mode("overwrite").json(path)


METRICS_SCHEMA = T.StructType([
    T.StructField("model", T.StringType()), T.StructField("precision", T.DoubleType()),
    T.StructField("recall", T.DoubleType()), T.StructField("f1", T.DoubleType()),
    T.StructField("anomalies_detected", T.LongType()), T.StructField("anomaly_pct", T.DoubleType()),
    T.StructField("completion_time", T.DoubleType()), T.StructField("params", T.StringType()),
    T.StructField("timestamp", T.StringType()), T.StructField("_corrupt_record", T.StringType()),
])


def read_model_results(spark: SparkSession, base: str, model: str | None = None) -> DataFrame:
    """Flags of one or all models (partition pruning on ``model``) with the
    ``params`` and ``timestamp`` of their metrics; NULL where a model has none."""
    df = spark.read.parquet(os.path.join(base, "flags"))
    df = df.where(F.col("model") == model) if model else df
    if not path_exists(spark, os.path.join(base, "metrics")):
        none = F.lit(None).cast("string")
        return df.withColumn("params", none).withColumn("timestamp", none)
    m = read_model_metrics(spark, os.path.join(base, "metrics")).groupBy("model").agg(
        F.max_by("params", "timestamp").alias("params"), F.max("timestamp").alias("timestamp"))
    return df.join(m, "model", "left")      # one row a model


def read_model_metrics(spark: SparkSession, path_glob: str) -> DataFrame:
    """Metrics JSON files matching a glob; malformed records skipped;
    missing metrics default to 0.0; pretty model names."""
    df = (spark.read.schema(METRICS_SCHEMA).option("mode", "PERMISSIVE")
          .option("columnNameOfCorruptRecord", "_corrupt_record").json(path_glob))
    df = df.where(F.col("_corrupt_record").isNull() & F.col("model").isNotNull()).drop("_corrupt_record")
    for c in ("precision", "recall", "f1", "anomaly_pct"):
        df = df.withColumn(c, F.coalesce(F.col(c), F.lit(0.0)))
    return df.withColumn("display_name", display_name("model"))


def write_tuning_results(results: DataFrame, base: str, summary: DataFrame | None = None) -> None:
    """Nested detail as JSON, summary as CSV with header."""
    results.write.mode("overwrite").json(os.path.join(base, "tuning_detail"))
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").option("header", True).csv(os.path.join(base, "tuning_summary"))


def write_learning_curves(curves: DataFrame, base: str, summary: DataFrame | None = None) -> None:
    """Long curve table as JSON, summary as CSV."""
    curves.write.mode("overwrite").json(os.path.join(base, "learning_curves"))
    if summary is not None:
        summary.coalesce(1).write.mode("overwrite").option("header", True).csv(
            os.path.join(base, "learning_curve_summary"))


# ------------------------------------------------------------------ S11
LEDGER_SCHEMA = "run_id string, stage string, model string, status string, at timestamp, payload string, result_path string"


class RunLedger:
    """Append-only run ledger (checkpoint / resume).

    Each event is one parquet row in a folder of its own, so that steps may be
    committed side by side; the state of (run, stage, model) is the
    status of its latest event. Results of finished steps are parquet tables
    next to the ledger, so a resumed run re-reads them instead of recomputing.
    """

    def __init__(self, spark: SparkSession, base: str):
        self.spark, self.base = spark, base
        self.path = os.path.join(base, "ledger")

    def append(self, run_id: str, stage: str, model: str, status: str, payload: dict | None = None,
               result_path: str | None = None, at: _dt.datetime | None = None) -> None:
        at = at or _dt.datetime.now(_dt.timezone.utc).replace(tzinfo=None)
        row = [(run_id, stage, model, status, at, json.dumps(payload or {}, sort_keys=True, default=str), result_path)]
        # a folder of its own: two jobs that write to one folder delete each other's temporary files
        self.spark.createDataFrame(row, LEDGER_SCHEMA).coalesce(1).write.parquet(os.path.join(self.path, uuid.uuid4().hex))

    def events(self) -> DataFrame:
        if not path_exists(self.spark, self.path):
            return self.spark.createDataFrame([], LEDGER_SCHEMA)
        return self.spark.read.schema(LEDGER_SCHEMA).option("recursiveFileLookup", True).parquet(self.path)

    def state(self) -> DataFrame:
        """Latest status per (run, stage, model)."""
        return ledger_state(self.events())

    def is_done(self, run_id: str, stage: str, model: str) -> bool:
        r = self.state().where((F.col("run_id") == run_id) & (F.col("stage") == stage) &
                               (F.col("model") == model)).first()
        return bool(r and r["status"] == "completed")

    def result(self, run_id: str, stage: str, model: str) -> DataFrame | None:
        r = self.state().where((F.col("run_id") == run_id) & (F.col("stage") == stage) &
                               (F.col("model") == model)).first()
        if r and r["result_path"] and path_exists(self.spark, r["result_path"]):
            return self.spark.read.parquet(r["result_path"])
        return None

    def complete(self, run_id: str, stage: str, model: str, result: DataFrame,
                 payload: dict | None = None) -> DataFrame:
        self.append(run_id, stage, model, "started", payload)
        path = os.path.join(self.base, "results", run_id, stage, model)
        result.write.mode("overwrite").parquet(path)
        self.append(run_id, stage, model, "completed", payload, path)
        return self.spark.read.parquet(path)

    def pending(self, run_id: str, stage: str, requested: list[str]) -> list[str]:
        req = self.spark.createDataFrame([(m,) for m in requested], "model string")
        return [r["model"] for r in pending_models(req, self.state().where(
            (F.col("run_id") == run_id) & (F.col("stage") == stage))).collect()]


def ledger_state(events: DataFrame) -> DataFrame:
    return events.groupBy("run_id", "stage", "model").agg(
        F.max_by("status", "at").alias("status"), F.max("at").alias("at"),
        F.max_by("result_path", "at").alias("result_path"), F.count("*").alias("n_events"))


def pending_models(requested: DataFrame, state: DataFrame) -> DataFrame:
    """requested models without a completed result (left anti join)."""
    done = state.where(F.col("status") == "completed").select("model")
    return requested.join(done, "model", "left_anti")


def latest_checkpoint(events: DataFrame, stage: str | None = None) -> DataFrame:
    """O3: the latest event (optionally of one stage)."""
    e = events if stage is None else events.where(F.col("stage") == stage)
    return e.agg(F.max_by(F.struct(*e.columns), "at").alias("e")).select("e.*")


def tuning_status(state: DataFrame, requested: list[str], stage: str = "tune") -> DataFrame:
    """M4: tuned / untuned models, progress percentage."""
    spark = state.sparkSession
    req = spark.createDataFrame([(m,) for m in requested], "model string")
    st = state.where(F.col("stage") == stage).select("model", "status")
    j = req.join(st, "model", "left")
    return j.agg(
        F.sort_array(F.collect_list(F.when(F.col("status") == "completed", F.col("model")))).alias("tuned"),
        F.sort_array(F.collect_list(F.when(F.coalesce(F.col("status"), F.lit("")) != "completed",
                                           F.col("model")))).alias("untuned"),
        (F.count_if(F.col("status") == "completed") * 100.0 / F.count("*")).alias("progress_pct"))


# ------------------------------------------------------------------ S12, S13
def save_model_tables(spark: SparkSession, path: str, meta: dict, tables: dict[str, DataFrame]) -> None:
    """Named parquet tables plus one metadata JSON row. The metadata are
    written last, so a model with metadata is whole."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(os.path.join(path, name))
    spark.createDataFrame([(json.dumps(meta, sort_keys=True, default=str),)], "meta string") \
        .coalesce(1).write.mode("overwrite").json(os.path.join(path, "meta"))


def load_model_tables(spark: SparkSession, path: str, names: list[str]) -> tuple[dict, dict[str, DataFrame]]:
    meta = json.loads(spark.read.json(os.path.join(path, "meta")).first()["meta"])
    return meta, {n: spark.read.parquet(os.path.join(path, n)) for n in names
                  if path_exists(spark, os.path.join(path, n))}
