"""Parameter search and learning curves.

Each (model, grid point, fold) is an independent fit + score: a few Spark
jobs over the same table of rows and folds. The driver only loops over
the (small) grid and submits at most ``parallelism`` of them at a time from a
thread pool; results are a long table, and best parameters / summaries are
window and aggregate queries over it. Folds are hash folds of the row id
(O8), so every fold holds both classes, independent of row order.
"""

from __future__ import annotations

import itertools
import json
import time
from collections import defaultdict
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from threading import Lock

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.operators.detect import SCALED_MODELS, AnomalyDetector
from reviewlens.operators.evaluate import binary_metrics
from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.prepare import hash_rank_fraction, kfold
from reviewlens.operators.scaling import Scaler
from reviewlens.session import materialize

# The default grids (one point per model, as in the reference).
DEFAULT_GRIDS = {
    "isolation_forest": {"n_estimators": [100], "max_samples": ["auto"], "contamination": [0.1]},
    "lof": {"k": [20], "contamination": [0.1]},
    "one_class_svm": {"kernel": ["rbf"], "nu": [0.1], "gamma": ["scale"]},
    "hbos": {"n_bins": [10], "alpha": [0.1], "contamination": [0.1]},
    "dbscan": {"eps": [0.5], "min_samples": [5]},
}
WHOLE_DATA_MODELS = ("lof", "dbscan")


#: name of a column of ``binary_metrics``, or a function (flagged rows, label column) ->
#: a frame whose first value is the score, such as ``df.agg(...)``
Metric = str | Callable[[DataFrame, str], DataFrame]


def _number(value) -> float | None:
    return None if value is None else float(value)


def param_grid(grid: dict[str, list]) -> list[dict]:
    keys = sorted(grid)
    return [dict(zip(keys, vals)) for vals in itertools.product(*[grid[k] for k in keys])]


def _score(flags: DataFrame, label_col: str, metric: Metric, zero_division: float) -> dict:
    if callable(metric):       # V4: an aggregate of the caller's over the flagged rows
        value = metric(flags, label_col).first()
        return {"metric": None if value is None else value[0]}
    r = binary_metrics(flags, label_col, "is_anomaly", zero_division=zero_division).first()
    return {k: r[k] for k in ("precision", "recall", "f1", "weighted_f1", "roc_auc_binary")} | {"metric": r[metric]}


def fold_rows(df: DataFrame, k_folds: int, label_col: str, cols, vector, id_col: str, seed: int, metric: Metric) -> DataFrame:
    """The rows with their folds, written once: every fit and score of a search
    scans the columns that it needs. A metric of the caller's may read any column."""
    data = kfold(df, k_folds, id_col, seed)
    read = dict.fromkeys([id_col, label_col, *([vector] if vector is not None else cols or []), "fold"])
    return materialize(data if callable(metric) else data.select(*[F.col(c) for c in read]))


class FoldScalers:
    """The scaler of the training rows of a fold, fitted once for all grid points."""

    def __init__(self, model_type: str, points: list[dict], cols, vector, id_col: str):
        own = any({"max_features", "seed"} & p.keys() for p in points)
        self.shared = model_type in SCALED_MODELS and not own
        self.cols, self.vector, self.id_col = cols, vector, id_col
        self.locks, self.found = defaultdict(Lock), {}

    def get(self, fold: int, train: DataFrame) -> Scaler | None:
        if not self.shared:
            return None
        with self.locks[fold]:
            if fold not in self.found:
                self.found[fold] = Scaler.fit(train, FeatureSpec.of(train, self.cols, self.vector), id_col=self.id_col)
        return self.found[fold]


def _fit_score(train: DataFrame, test: DataFrame, model_type: str, params: dict, label_col: str,
               cols, vector, id_col: str, metric: Metric, zero_division: float, scaler: Scaler | None = None) -> dict:
    det = AnomalyDetector(model_type, **params).fit(train, cols, vector, id_col, scaler)
    flags = det.detect_training(test) if (test is train or model_type in WHOLE_DATA_MODELS) else det.score_new(test)
    return _score(flags, label_col, metric, zero_division)


def grid_search(df: DataFrame, model_type: str, grid: dict | None, label_col: str, cols=None, vector=None,
                id_col: str = "row_id", k_folds: int = 3, score_mode: str = "holdout", metric: Metric = "f1",
                zero_division: float = 1.0, parallelism: int = 4, seed: int = 42) -> DataFrame:
    """M1/M2: long table (model, grid_index, params, fold, score, seconds)."""
    points = param_grid(grid or DEFAULT_GRIDS[model_type])
    data = fold_rows(df, k_folds, label_col, cols, vector, id_col, seed, metric)
    scalers = FoldScalers(model_type, points, cols, vector, id_col)
    tasks = []
    for gi, p in enumerate(points):
        if model_type in WHOLE_DATA_MODELS:
            tasks.append((gi, p, -1))
        else:
            tasks += [(gi, p, f) for f in range(k_folds)]

    def run(t):
        gi, p, fold = t
        t0 = time.time()
        if fold < 0:
            s = _fit_score(data, data, model_type, p, label_col, cols, vector, id_col, metric, zero_division)
        else:
            held = data.where(F.col("fold") == fold)
            if score_mode == "refit":   # reference scorer: fit and predict on the scored fold
                train = held
            else:
                train = data.where(F.col("fold") != fold)
            s = _fit_score(train, held, model_type, p, label_col, cols, vector, id_col, metric, zero_division, scalers.get(fold, train))
        return (model_type, gi, json.dumps(p, sort_keys=True), fold, _number(s["metric"]), time.time() - t0)

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rows = list(ex.map(run, tasks))
    return df.sparkSession.createDataFrame(
        rows, "model string, grid_index int, params string, fold int, score double, seconds double")


def best_params(results: DataFrame) -> DataFrame:
    """Per model the grid point with the highest mean score (first wins ties)."""
    m = results.groupBy("model", "grid_index", "params").agg(F.avg("score").alias("mean_test_score"),
                                                             F.stddev_pop("score").alias("std_test_score"))
    w = Window.partitionBy("model").orderBy(F.col("mean_test_score").desc(), F.col("grid_index"))
    return m.withColumn("rank", F.row_number().over(w)).where("rank = 1").drop("rank")


def best_model_metrics(df: DataFrame, model_type: str, params: dict, label_col: str, cols=None, vector=None,
                       id_col: str = "row_id", zero_division: float = 1.0) -> DataFrame:
    """M3: refit the best parameters on all rows and evaluate."""
    t0 = time.time()
    det = AnomalyDetector(model_type, **params).fit(df, cols, vector, id_col)
    m = binary_metrics(det.detect_training(df), label_col, "is_anomaly", zero_division=zero_division)
    return m.select(F.lit(model_type).alias("model"), F.lit(json.dumps(params, sort_keys=True)).alias("params"),
                    "precision", "recall", "f1", "roc_auc_binary", F.lit(time.time() - t0).alias("completion_time"))


def curve_split(data: DataFrame, size: float, fold: int) -> tuple[DataFrame, DataFrame]:
    """Training rows of a size and the held-out rows of a fold."""
    return data.where((F.col("fold") != fold) & (F.col("_u") < F.lit(size))), data.where(F.col("fold") == fold)


def curve_points(train: DataFrame, test: DataFrame, model_type: str, params: dict, label_col: str, cols, vector, id_col: str,
                 metric: Metric) -> list[dict]:
    """The train and the test score of one fit."""
    det = AnomalyDetector(model_type, **params).fit(train, cols, vector, id_col)
    tr = _score(det.detect_training(train), label_col, metric, 1.0)["metric"]
    out = [{"split": "train", "score": _number(tr), "error": None}]
    if model_type == "dbscan":       # no way to label rows that were not fitted
        return out + [{"split": "test", "score": None, "error": "dbscan labels only the rows it was fitted on"}]
    te = _score(det.score_new(test), label_col, metric, 1.0)["metric"]
    return out + [{"split": "test", "score": _number(te), "error": None}]


def learning_curves(df: DataFrame, model_type: str, params: dict, label_col: str, cols=None, vector=None,
                    id_col: str = "row_id", train_sizes=(0.3, 0.5333, 0.7667, 1.0), k_folds: int = 2,
                    metric: Metric = "weighted_f1", parallelism: int = 4, seed: int = 42) -> DataFrame:
    """M5: long table (model, train_size, fold, split, score); a failed fit is a
    row with NULL score and the error text (Q8). Subsets are nested: a row in
    the 30 % subset is in every larger one."""
    data = kfold(df, k_folds, id_col, seed).withColumn("_u", hash_rank_fraction(id_col, seed + 7))
    tasks = [(s, f) for s in train_sizes for f in range(k_folds)]

    def run(t):
        size, fold = t
        try:
            points = curve_points(*curve_split(data, size, fold), model_type, params, label_col, cols, vector, id_col, metric)
        except Exception as e:   # recorded, not hidden: the row carries the error
            points = [{"split": s, "score": None, "error": f"{type(e).__name__}: {e}"} for s in ("train", "test")]
        return [(model_type, float(size), fold, p["split"], p["score"], p["error"]) for p in points]

    with ThreadPoolExecutor(max_workers=max(1, parallelism)) as ex:
        rows = [r for rs in ex.map(run, tasks) for r in rs]
    return df.sparkSession.createDataFrame(
        rows, "model string, train_size double, fold int, split string, score double, error string")


def curve_stats(curves: DataFrame) -> DataFrame:
    """Mean and population std over folds per (model, size, split)."""
    return curves.groupBy("model", "train_size", "split").agg(
        F.avg("score").alias("mean_score"), F.stddev_pop("score").alias("std_score"))


def learning_curve_summary(curves: DataFrame) -> DataFrame:
    """Last-size train/test means, their gap and stds; failed models keep NULLs."""
    st = curve_stats(curves)
    p = st.groupBy("model", "train_size").pivot("split", ["train", "test"]).agg(
        F.first("mean_score").alias("mean"), F.first("std_score").alias("std"))
    last = p.groupBy("model").agg(F.max_by(F.struct(*[c for c in p.columns if c != "model"]), "train_size").alias("l"))
    return last.select("model", F.col("l.train_size").alias("final_train_size"),
                       F.col("l.train_mean").alias("final_train_score"), F.col("l.test_mean").alias("final_test_score"),
                       (F.col("l.train_mean") - F.col("l.test_mean")).alias("gap"),
                       F.col("l.train_std").alias("train_std"), F.col("l.test_std").alias("test_std"))


def tuning_summary(best: DataFrame, metrics: DataFrame) -> DataFrame:
    """Per model best CV score, refit metrics, parameters, time."""
    return best.select("model", F.col("mean_test_score").alias("best_f1"), F.col("params").alias("best_params")) \
        .join(metrics.drop("params"), "model", "left")
