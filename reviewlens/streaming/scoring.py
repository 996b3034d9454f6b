"""Score a stream with a stored model (optional extension; the reference has
no streaming).

HBOS scoring is a pure row-wise expression and isolation-forest / one-class
SVM scoring are scalar pandas UDFs, so the fitted model's ``transform``
applies unchanged to a streaming DataFrame: no state, no watermark needed.
``start_scoring`` writes flags with the parquet file sink under the shared
checkpoint folder, with the stream's own checkpoint location: the sink's
commit log names the files of each micro-batch once, so a replayed batch is
not read twice.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession

from reviewlens.session import ensure_checkpoint_dir


def file_stream(spark: SparkSession, path: str, schema, max_files_per_trigger: int = 1) -> DataFrame:
    """Parquet files landing in ``path`` as a stream."""
    return (spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger)
            .parquet(path))


def score_stream(model, stream: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Apply a fitted (stateless) model to a streaming frame."""
    out = model.transform(stream)
    return out.select(*(keep or stream.columns), "anomaly_score", "is_anomaly")


def start_scoring(scored: DataFrame, name: str, out_path: str | None = None, trigger_once: bool = True):
    spark = scored.sparkSession
    base = ensure_checkpoint_dir(spark)
    out_path = out_path or os.path.join(base, "stream-out", name)
    ckpt = os.path.join(base, "stream-ckpt", name)

    w = (scored.writeStream.format("parquet").option("path", out_path).outputMode("append")
         .option("checkpointLocation", ckpt).queryName(name))
    w = w.trigger(availableNow=True) if trigger_once else w
    return w.start(), out_path
