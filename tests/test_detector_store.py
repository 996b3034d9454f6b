import os

from pyspark.sql import functions as F

from reviewlens.operators.detect import AnomalyDetector
from reviewlens.operators.detector_store import load_detector, save_detector
from reviewlens.session import scratch_path


def _frame(spark, lo, hi):
    x = F.xxhash64(F.lit(3), F.col("id"))
    return spark.range(lo, hi).select(F.col("id").alias("row_id"), (F.pmod(x, F.lit(1000)) / 100.0).alias("a"),
                                      (F.pmod(x, F.lit(777)) / 50.0).alias("b"))


def test_loaded_detectors_score_new_rows_alike(spark):
    train, new = _frame(spark, 0, 200), _frame(spark, 200, 260)
    for kind in ("hbos", "lof"):
        det = AnomalyDetector(kind).fit(train, cols=["a", "b"])
        path = os.path.join(scratch_path(spark, f"det-{kind}"))
        save_detector(spark, det.model, path)
        want = det.model.transform(new).select("row_id", "anomaly_score", "is_anomaly")
        got = load_detector(spark, path).transform(new).select("row_id", "anomaly_score", "is_anomaly")
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_detect_scores_rows_outside_the_training_table(spark):
    det = AnomalyDetector("lof").fit(_frame(spark, 0, 150), cols=["a", "b"])
    flags = det.detect(_frame(spark, 100, 200)).collect()
    assert len(flags) == 100 and all(r["is_anomaly"] is not None for r in flags)
    db = AnomalyDetector("dbscan", eps=0.3).fit(_frame(spark, 0, 60), cols=["a", "b"])
    try:
        db.detect(_frame(spark, 50, 70))
        raise AssertionError("rows outside the fit must be refused")
    except ValueError:
        pass
