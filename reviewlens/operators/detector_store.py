"""Fitted detectors on shared storage, with their preprocessing state.

A stored detector is one metadata row (the scaler and the model's own numbers)
and the tables of its kind: the nodes of a forest, the landmarks or projection
and the weights of a one-class SVM, the training rows and scores of LOF. A
loaded one scores new rows as the fitted one does. DBSCAN has no model: its
labels are a table of their own.
"""

from __future__ import annotations

from dataclasses import asdict

from pyspark.sql import SparkSession

from reviewlens.operators.features import FeatureSpec, SlicedSpec
from reviewlens.operators.hbos import HBOSModel
from reviewlens.operators.iforest import NODE_SCHEMA, IsolationForestModel
from reviewlens.operators.lof import LOFModel
from reviewlens.operators.ocsvm import OneClassSVMModel
from reviewlens.operators.scaling import Scaler
from reviewlens.session import ship_package
from reviewlens.sources.store import load_model_tables, save_model_tables

_SCALER = ("kept", "means", "stds", "los", "his", "jitter_eps", "jitter_seed", "id_col", "n")
_HBOS = ("n_bins", "alpha", "tol", "contamination", "lo", "width", "terms", "threshold")
_FOREST = ("n_estimators", "max_samples", "contamination", "seed", "threshold")
_SVM = ("nu", "kernel", "gamma", "n_components", "method", "rho", "seed")
_LOF = ("k", "contamination", "threshold", "id_col", "block_rows")


def _state(obj, names) -> dict:
    return {n: getattr(obj, n) for n in names}


Detector = HBOSModel | LOFModel | IsolationForestModel | OneClassSVMModel


def _spec_state(spec) -> dict:
    """A feature spec, or the part of one that a mask or ``max_features`` kept."""
    if isinstance(spec, SlicedSpec):
        return asdict(spec.base) | {"indices": list(spec.indices)}
    return asdict(spec)


def _spec(state: dict) -> FeatureSpec | SlicedSpec:
    base = FeatureSpec(tuple(state["cols"]), state["vector"], state["dim"])
    return SlicedSpec(base, tuple(state["indices"])) if "indices" in state else base


def save_detector(spark: SparkSession, model: Detector, path: str) -> None:
    meta = {"kind": model.kind, "spec": _spec_state(model.scaler.spec), "scaler": _state(model.scaler, _SCALER)}
    tables = {}
    if model.kind == "hbos":
        meta["model"] = _state(model, _HBOS)
    elif model.kind == "lof":
        meta["model"] = _state(model, _LOF) | {"scale": model._scale}
        tables = {"train": model.train, "scores": model._train_scores}
    elif model.kind == "isolation_forest":
        meta["model"] = _state(model, _FOREST)
        tables = {"nodes": spark.createDataFrame([tuple(n) for n in model.nodes], NODE_SCHEMA)}
    elif model.kind == "one_class_svm":
        meta["model"] = _state(model, _SVM)
        rows = max(len(model.w), len(model.W), len(model.landmarks))
        def at(values, i):
            return values[i] if i < len(values) else None
        tables = {"components": spark.createDataFrame(
            [(i, at(model.w, i), at(model.b, i), at(model.W, i), at(model.landmarks, i)) for i in range(rows)],
            "component int, weight double, offset double, projection array<double>, landmark array<double>")}
    else:
        raise ValueError(f"no store for a {model.kind} detector")
    save_model_tables(spark, path, meta, tables)


def load_detector(spark: SparkSession, path: str) -> Detector:
    ship_package(spark)
    meta, tables = load_model_tables(spark, path, ["train", "scores", "nodes", "components"])
    scaler = Scaler(_spec(meta["spec"]), **meta["scaler"])
    state = meta["model"]
    if meta["kind"] == "hbos":
        return HBOSModel(scaler, **state)
    if meta["kind"] == "isolation_forest":
        return IsolationForestModel(scaler, nodes=[tuple(r) for r in tables["nodes"].collect()], **state)
    if meta["kind"] == "one_class_svm":
        rows = sorted(tables["components"].collect(), key=lambda r: r["component"])
        parts = {k: [r[c] for r in rows if r[c] is not None] for k, c in
                 (("w", "weight"), ("b", "offset"), ("W", "projection"), ("landmarks", "landmark"))}
        return OneClassSVMModel(scaler, **state, **parts)
    scale = state.pop("scale")
    model = LOFModel(scaler, state["k"], state["contamination"], tables["train"], state["threshold"], state["id_col"], state["block_rows"])
    model._scale, model._train_scores = scale, tables["scores"]
    return model
