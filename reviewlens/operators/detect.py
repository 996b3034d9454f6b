"""D6 detect / D7 detect_all: one facade over the five detectors.

``AnomalyDetector(model_type, **params).fit(df, cols=..|vector=..)`` (with
``max_features=n`` on the first n features only) then
``.detect(df)`` adds ``anomaly_score`` (higher = more anomalous) and
``is_anomaly``. ``detect_all`` runs several detectors on one materialised
feature frame and returns the long table ``(model, id, anomaly_score,
is_anomaly)``, recording progress in a run ledger when one is given.
Errors are raised, never turned into "all normal" (except the documented
empty-input case, F5).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.dbscan import dbscan
from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.hbos import HBOSModel
from reviewlens.operators.iforest import IsolationForestModel
from reviewlens.operators.lof import LOFModel
from reviewlens.operators.ocsvm import OneClassSVMModel
from reviewlens.operators.scaling import Scaler

MODEL_TYPES = ("isolation_forest", "lof", "one_class_svm", "dbscan", "hbos")
#: models whose scaler depends on nothing but the training rows
SCALED_MODELS = ("isolation_forest", "hbos")

# Default parameters per model type (reference defaults).
DEFAULTS = {
    "isolation_forest": {"n_estimators": 100, "max_samples": "auto", "contamination": 0.1},
    "lof": {"k": 20, "contamination": 0.1},
    "one_class_svm": {"kernel": "rbf", "gamma": "scale", "nu": 0.1},
    "dbscan": {"eps": 0.5, "min_samples": 5},
    "hbos": {"n_bins": 10, "alpha": 0.1, "contamination": 0.1},
}


class AnomalyDetector:
    def __init__(self, model_type: str = "isolation_forest", **params):
        if model_type not in MODEL_TYPES:
            raise ValueError(f"no detector is called {model_type!r}; there are {', '.join(MODEL_TYPES)}")
        self.model_type = model_type
        self.params = {**DEFAULTS[model_type], **params}
        self.max_features = self.params.pop("max_features", None)
        self.model = None
        self._dbscan = None
        self.id_col = "row_id"
        self.spec = None

    def fit(self, df: DataFrame, cols: list[str] | None = None, vector: str | None = None,
            id_col: str = "row_id", scaler: Scaler | None = None) -> "AnomalyDetector":
        """``scaler``: that of ``df``, where it is known already; for ``SCALED_MODELS`` without ``max_features``."""
        self.id_col = id_col
        self.spec = FeatureSpec.of(df, cols, vector)
        if self.max_features is not None and self.max_features < self.spec.dim:
            # The first features only, in fit and in scoring alike
            self.spec = self.spec.slice(list(range(self.max_features)))
        if scaler.n == 0 if scaler else df.isEmpty():          # F5: nothing to learn; detect() reports all rows normal
            self.model = None
            return self
        p = dict(self.params)
        t = self.model_type
        if t == "hbos":
            self.model = HBOSModel.fit(df, self.spec, id_col=id_col, scaler=scaler, **p)
        elif t == "isolation_forest":
            self.model = IsolationForestModel.fit(df, self.spec, id_col=id_col, scaler=scaler, **p)
        elif t == "lof":
            self.model = LOFModel.fit(df, self.spec, id_col=id_col, **p)
        elif t == "one_class_svm":
            self.model = OneClassSVMModel.fit(df, self.spec, id_col=id_col, **p)
        elif t == "dbscan":
            # DBSCAN labels the rows it was fitted on (as the reference does)
            self._dbscan = dbscan(df, self.spec, id_col=id_col, **p)
            self.model = self._dbscan
        return self

    def detect(self, df: DataFrame) -> DataFrame:
        """``df`` with ``anomaly_score`` and ``is_anomaly``. Rows are judged by their
        features alone; an id that also stood in the training rows means nothing
        (DBSCAN excepted, which has labels for its training rows only)."""
        if self.model is None:
            return df.withColumn("anomaly_score", F.lit(0.0)).withColumn("is_anomaly", F.lit(False))
        if self.model_type == "dbscan":
            lab = self._dbscan.labels.select(F.col("id").alias(self.id_col), "is_anomaly",
                                             F.col("is_anomaly").cast("double").alias("anomaly_score"))
            if not df.join(lab, self.id_col, "left_anti").isEmpty():
                raise ValueError("dbscan labels only the rows it was fitted on")
            return df.join(lab, self.id_col)
        return self.model.transform(df)

    def training_scores(self) -> DataFrame:
        """(id, anomaly_score, is_anomaly) of the rows of ``fit``. For LOF these
        leave every row out of its own neighbours, which :meth:`detect` cannot."""
        if self.model_type != "lof" or self.model is None:
            raise ValueError("only a fitted lof detector has scores of its own for its training rows")
        return self.model.training_scores().select(F.col("id").alias(self.id_col), F.col("lof").alias("anomaly_score"), "is_anomaly")

    def detect_training(self, df: DataFrame) -> DataFrame:
        """:meth:`detect` for the rows of ``fit``: LOF compares none of them with itself."""
        if self.model_type != "lof" or self.model is None:
            return self.detect(df)
        return df.join(self.training_scores(), self.id_col)

    def score_new(self, df: DataFrame) -> DataFrame:
        """Score rows not seen in fit."""
        if self.model_type == "dbscan":
            raise ValueError("dbscan labels only the rows it was fitted on")
        return self.detect(df)


def detect_all(df: DataFrame, model_specs: dict[str, dict], cols: list[str] | None = None,
               vector: str | None = None, id_col: str = "row_id", ledger=None, run_id: str = "run") -> DataFrame:
    """Run several detectors; long result table; resumable through ``ledger``."""
    parts = []
    for name, params in model_specs.items():
        if ledger is not None and ledger.is_done(run_id, "detect", name):
            prev = ledger.result(run_id, "detect", name)
            if prev is not None:
                parts.append(prev)
                continue
        p = dict(params)
        mtype = p.pop("model_type", name)
        det = AnomalyDetector(mtype, **p).fit(df, cols, vector, id_col)
        res = det.detect_training(df).select(F.lit(name).alias("model"), F.col(id_col),
                                                   F.col("anomaly_score").cast("double").alias("anomaly_score"),
                                                   F.col("is_anomaly"))
        if ledger is not None:
            res = ledger.complete(run_id, "detect", name, res)
        parts.append(res)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
