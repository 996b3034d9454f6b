"""Representation learning: Bernoulli RBM layers stacked into a DBN.

R1 rbm_fit      contrastive divergence (CD-1, mean-field), one Spark job per
                epoch from numpy over Arrow batches, which also scores the layer
                of the epoch before: one step over all rows, or
                mini-batches in replicas that are averaged. Partial sums are
                reduced by Spark; the driver gets one array of each kind.
                Weights are h x v doubles (82 000 at 406 x 203): model-sized.
R2 early stop   keep the weights with the best validation pseudo-likelihood,
                stop after ``patience`` epochs without improvement; epochs
                continue from the current weights.
R3 pseudo_ll    per-row log pseudo-likelihood with the flipped unit chosen by
                pmod(xxhash64(seed, id), d): deterministic, partition-free.
R4 dbn_fit      greedy layers; the next layer's input is R5 of this layer,
                checkpointed (lineage cut) before training continues.
R5 transform    sigmoid(x W^T + c) through every layer in a pandas UDF.
Inputs are min-max scaled to [0, 1] first (Bernoulli visible units), and an
optional seeded feature subset (P14) is applied before the first layer.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.reduce import array_rows, array_sums
from reviewlens.session import materialize, ship_package


def _sig(x):
    return 1.0 / (1.0 + np.exp(-x))


def _softplus(x):
    return np.logaddexp(0.0, x)


def _lists(H: np.ndarray) -> pa.Array:
    """The rows of a matrix as an array column, NaN as NULL."""
    return pa.ListArray.from_arrays(np.arange(len(H) + 1, dtype=np.int32) * H.shape[1], pa.array(H.ravel(), from_pandas=True))


def _stack(s: pd.Series) -> np.ndarray:
    return np.concatenate(s.to_numpy()).reshape(len(s), -1).astype(np.float64, copy=False)


@dataclass
class RBMLayer:
    W: np.ndarray          # hidden x visible
    b_visible: np.ndarray
    b_hidden: np.ndarray


def _pseudo_likelihoods(V: np.ndarray, flip: np.ndarray, layer: RBMLayer) -> np.ndarray:
    """Log pseudo-likelihood of every row, by its unit ``flip``."""
    W, bv, bh = layer.W, layer.b_visible, layer.b_hidden
    fe = -(V @ bv) - _softplus(V @ W.T + bh).sum(axis=1)
    V2 = V.copy()
    r = np.arange(len(V2))
    V2[r, flip] = 1.0 - V2[r, flip]
    fe2 = -(V2 @ bv) - _softplus(V2 @ W.T + bh).sum(axis=1)
    return W.shape[1] * -_softplus(-(fe2 - fe))


def _marked(X: DataFrame, d: int, col: str, id_col: str, seed: int, held: bool = False) -> DataFrame:
    """Rows with their flipped unit, and whether they are held out."""
    return X.select(F.col(col).alias("x"), F.pmod(F.xxhash64(F.lit(seed), F.col(id_col)), F.lit(d)).alias("flip"), F.lit(held).alias("held"))


def _epoch_pass(rows: DataFrame, layer: RBMLayer, sums: bool, scores: bool) -> tuple:
    """One pass over ``rows(x, flip, held)``: the number of training rows, with ``sums``
    the CD-1 sums of these, and with ``scores`` the mean log pseudo-likelihood of the
    training and of the held-out rows under the same layer (None without rows; rows
    for which it is NaN are left out)."""
    W, bv, bh = layer.W, layer.b_visible, layer.b_hidden
    h, v = W.shape

    def part(it):
        n, gW, gb, gc, pl = 0, np.zeros((h, v)), np.zeros(v), np.zeros(h), np.zeros(4)
        for batch in it:
            if batch.num_rows == 0:
                continue
            V, held = array_rows(batch.column("x")), batch.column("held").to_numpy(zero_copy_only=False)
            if scores:
                values = _pseudo_likelihoods(V, batch.column("flip").to_numpy(zero_copy_only=False), layer)
                a, b = values[~held & ~np.isnan(values)], values[held & ~np.isnan(values)]
                pl += [a.sum(), len(a), b.sum(), len(b)]
            n += int((~held).sum())
            if sums:
                V0 = V[~held]
                H0 = _sig(V0 @ W.T + bh)
                V1 = _sig(H0 @ W + bv)
                H1 = _sig(V1 @ W.T + bh)
                gW += H0.T @ V0 - H1.T @ V1
                gb += (V0 - V1).sum(axis=0)
                gc += (H0 - H1).sum(axis=0)
        yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "gW": [gW.ravel()], "gb": [gb], "gc": [gc], "pl": [pl]})

    n, found = array_sums(rows.mapInArrow(part, f"{_SUMS}, pl array<double>"), ["gW", "gb", "gc", "pl"])
    if n is None or not len(found[0]):
        return 0, np.zeros((h, v)), np.zeros(v), np.zeros(h), None, None
    gW, gb, gc, pl = found
    mean = [float(pl[i] / pl[i + 1]) if scores and pl[i + 1] else None for i in (0, 2)]
    return n, gW.reshape(h, v), gb, gc, *mean


def rbm_epoch_sums(X: DataFrame, layer: RBMLayer, col: str = "x") -> tuple[int, np.ndarray, np.ndarray, np.ndarray]:
    rows = X.select(F.col(col).alias("x"), F.lit(0).alias("flip"), F.lit(False).alias("held"))
    return _epoch_pass(rows, layer, True, False)[:4]


_SUMS = "n long, gW array<double>, gb array<double>, gc array<double>"
def rbm_epoch_batches(X: DataFrame, layer: RBMLayer, learning_rate: float, batch_size: int, epoch: int, shards: int = 8,
                      col: str = "x", id_col: str = "id", seed: int = 42) -> tuple[int, RBMLayer]:
    """One epoch of mini-batches: the mean of the layers of ``shards`` replicas.

    A row belongs to the shard that a hash of its id names and takes its place in
    the batches of an epoch by a hash of id and epoch, so the schedule does not
    depend on how the table is partitioned. A shard is one streamed partition:
    a task holds one batch and one layer. The replicas start the epoch from the
    same weights and are averaged by their rows, in two reductions.
    """
    W0, bv0, bh0 = layer.W, layer.b_visible, layer.b_hidden
    h, v = W0.shape

    def part(it):
        W, bv, bh = W0.copy(), bv0.copy(), bh0.copy()
        held, n = np.zeros((0, v)), 0

        def step(V0):
            nonlocal W, bv, bh
            H0 = _sig(V0 @ W.T + bh)
            V1 = _sig(H0 @ W + bv)
            H1 = _sig(V1 @ W.T + bh)
            rate = learning_rate / len(V0)
            W = W + rate * (H0.T @ V0 - H1.T @ V1)
            bv = bv + rate * (V0 - V1).sum(axis=0)
            bh = bh + rate * (H0 - H1).sum(axis=0)
        for pdf in it:
            if len(pdf) == 0:
                continue
            held = np.vstack([held, _stack(pdf[col])])
            n += len(pdf)
            while len(held) >= batch_size:
                step(held[:batch_size])
                held = held[batch_size:]
        if len(held):
            step(held)
        if n:
            yield pd.DataFrame({"n": [n], "gW": [(n * W).ravel().tolist()], "gb": [(n * bv).tolist()], "gc": [(n * bh).tolist()]})

    shard = F.pmod(F.xxhash64(F.lit(seed + 5), F.col(id_col)), F.lit(shards))
    place = F.xxhash64(F.lit(seed), F.lit(epoch), F.col(id_col))
    # shards are told apart by a range, so that each is one partition
    dealt = (X.select(col, shard.alias("_s"), place.alias("_p"), F.col(id_col).alias("_i")).repartitionById(shards, F.col("_s").cast("int"))
             .sortWithinPartitions("_s", "_p", "_i"))
    parts = dealt.select(col).mapInPandas(part, _SUMS)
    n, sums = array_sums(parts, ["gW", "gb", "gc"])
    if n == 0:
        return 0, layer
    return n, RBMLayer(sums[0].reshape(h, v) / n, sums[1] / n, sums[2] / n)


def pseudo_likelihood(X: DataFrame, layer: RBMLayer, col: str = "x", id_col: str = "id", seed: int = 42) -> float:
    """Mean log pseudo-likelihood of the rows of X."""
    return _epoch_pass(_marked(X, layer.W.shape[1], col, id_col, seed), layer, False, True)[4]


def rbm_fit(X: DataFrame, n_hidden: int, learning_rate: float = 0.05, n_iter: int = 10,
            X_val: DataFrame | None = None, patience: int = 3, early_stopping: bool = True,
            seed: int = 42, col: str = "x", id_col: str = "id", verbose: bool = False,
            batch_size: int | None = None, shards: int = 8) -> tuple[RBMLayer, list]:
    """R1 + R2. Returns the (best) layer and per-epoch scores [(epoch, train, val)].
    Without ``batch_size`` an epoch is one step over all rows; with it, mini-batches
    of that many rows in each of ``shards`` replicas (:func:`rbm_epoch_batches`)."""
    d = len(X.select(col).first()[0])
    rng = np.random.default_rng(seed)
    layer = RBMLayer(rng.normal(0, 0.01, size=(n_hidden, d)), np.zeros(d), np.zeros(n_hidden))
    best, best_val, bad = None, -math.inf, 0
    history = []
    rows = _marked(X, d, col, id_col, seed)
    if X_val is not None:
        rows = rows.union(_marked(X_val, d, col, id_col, seed, held=True))
    # the pass that scores an epoch's layer also takes the sums that the next epoch starts from
    n, gW, gb, gc = rbm_epoch_sums(X, layer, col) if n_iter and not batch_size else (0, None, None, None)
    for epoch in range(n_iter):
        if batch_size:
            n, layer = rbm_epoch_batches(X, layer, learning_rate, batch_size, epoch, shards, col, id_col, seed)
        if n == 0:
            break
        if not batch_size:
            layer = RBMLayer(layer.W + learning_rate * gW / n, layer.b_visible + learning_rate * gb / n,
                             layer.b_hidden + learning_rate * gc / n)
        _, gW, gb, gc, tr, va = _epoch_pass(rows, layer, not batch_size and epoch + 1 < n_iter, True)
        history.append((epoch, tr, va))
        if early_stopping and va is not None:
            if va > best_val:
                best_val, best, bad = va, layer, 0
            else:
                bad += 1
                if bad >= patience:
                    break
    return (best or layer), history


@dataclass
class DBNModel:
    layers: list = field(default_factory=list)             # RBMLayer
    feature_indices: list = field(default_factory=list)
    mins: list = field(default_factory=list)
    maxs: list = field(default_factory=list)
    layer_scores: list = field(default_factory=list)        # (layer, epoch, train, val)

    # ---------------------------------------------------------------- R5
    def transform_col(self, xcol):
        layers = [(l.W, l.b_hidden) for l in self.layers]
        idx = np.asarray(self.feature_indices, dtype=np.int64)
        lo = np.asarray(self.mins)
        span = np.asarray(self.maxs) - lo
        span[span == 0] = 1.0
        @F.arrow_udf("array<double>")
        def dbn_forward(x: pa.Array) -> pa.Array:
            if len(x) == 0:
                return pa.array([], pa.list_(pa.float64()))
            H = np.clip((array_rows(x) - lo) / span, 0.0, 1.0)[:, idx]
            for W, c in layers:
                H = _sig(H @ W.T + c)
            return _lists(H)

        return dbn_forward(xcol)

    def transform(self, df: DataFrame, col: str = "features", out: str = "dbn_features") -> DataFrame:
        return df.withColumn(out, self.transform_col(F.col(col)))

    # ---------------------------------------------------------------- tables
    def weights_table(self, spark) -> DataFrame:
        rows = [(i, l.W.tolist(), l.b_visible.tolist(), l.b_hidden.tolist()) for i, l in enumerate(self.layers)]
        return spark.createDataFrame(rows, "layer int, weights array<array<double>>, b_visible array<double>, "
                                           "b_hidden array<double>")

    def scores_table(self, spark) -> DataFrame:
        return spark.createDataFrame(self.layer_scores, "layer int, epoch int, train_score double, val_score double")


def _layer_udf(W: np.ndarray, c: np.ndarray):
    @F.arrow_udf("array<double>")
    def up(x: pa.Array) -> pa.Array:
        if len(x) == 0:
            return pa.array([], pa.list_(pa.float64()))
        return _lists(_sig(array_rows(x) @ W.T + c))
    return up


def min_max(df: DataFrame, col: str, d: int) -> tuple[list, list]:
    aggs = []
    for j in range(d):
        aggs += [F.min(F.get(F.col(col), j)).alias(f"lo{j}"), F.max(F.get(F.col(col), j)).alias(f"hi{j}")]
    r = df.agg(*aggs).first()
    return [float(r[f"lo{j}"]) for j in range(d)], [float(r[f"hi{j}"]) for j in range(d)]


def random_feature_subset(d: int, ratio: float, seed: int = 42) -> list[int]:
    """max(1, floor(d * ratio)) distinct feature indices, sorted."""
    if ratio >= 1.0:
        return list(range(d))
    k = max(1, int(d * ratio))
    return sorted(np.random.default_rng(seed).choice(d, size=k, replace=False).tolist())


class _LayerStore:
    """One committed folder per finished layer, keyed by table and parameters."""

    def __init__(self, df: DataFrame, base: str, col: str, id_col: str, params: dict):
        import hashlib
        import json
        import os

        from reviewlens.sources.store import table_fingerprint
        self.spark = df.sparkSession
        key = hashlib.sha1(json.dumps(params, sort_keys=True).encode()).hexdigest()[:16]
        self.path = os.path.join(base, "dbn_layers", f"{table_fingerprint(df.select(id_col, col))}-{key}")

    def write(self, layer: int, weights: RBMLayer, scores: list) -> None:
        save_dbn(self.spark, DBNModel([weights], layer_scores=scores), f"{self.path}/layer={layer}")

    def read(self, layer: int) -> tuple[RBMLayer, list] | None:
        """None where the layer is not there whole: its metadata are written last."""
        from reviewlens.session import path_exists
        path = f"{self.path}/layer={layer}"
        if not path_exists(self.spark, f"{path}/meta/_SUCCESS"):
            return None
        m = load_dbn(self.spark, path)
        return m.layers[0], m.layer_scores


def dbn_fit(df: DataFrame, col: str = "features", id_col: str = "row_id", hidden_layers: list[int] | None = None,
            layer_configs: list[dict] | None = None, val_fraction: float = 0.2, feature_subset_ratio: float = 1.0,
            patience: int = 3, early_stopping: bool = True, seed: int = 42, checkpoint: str | None = None,
            stop_after: int | None = None) -> DBNModel:
    """Greedy layer-wise training with a hashed validation split.

    With ``checkpoint`` every finished layer is committed under that folder as
    it is done, and a fit of the same table and parameters goes on after the
    last of them. ``stop_after`` ends the fit after so many layers.
    """
    ship_package(df.sparkSession)
    d = len(df.select(col).first()[0])
    hidden_layers = hidden_layers or [256, 128]
    layer_configs = layer_configs or [{"learning_rate": 0.05, "n_iter": 10}] * len(hidden_layers)
    if len(layer_configs) != len(hidden_layers):
        raise ValueError("layer_configs must have one entry per hidden layer")
    mins, maxs = min_max(df, col, d)
    model = DBNModel([], random_feature_subset(d, feature_subset_ratio, seed), mins, maxs, [])
    lo, span = np.asarray(mins), np.asarray(maxs) - np.asarray(mins)
    span[span == 0] = 1.0
    idx = model.feature_indices
    scale_expr = F.array(*[F.least(F.greatest((F.get(F.col(col), j) - F.lit(lo[j])) / F.lit(span[j]), F.lit(0.0)),
                                   F.lit(1.0)) for j in idx])
    cur = materialize(df.select(F.col(id_col).alias("id"), scale_expr.alias("x"),
                                (F.pmod(F.xxhash64(F.lit(seed + 99), F.col(id_col)), F.lit(1000)) <
                                 F.lit(int(val_fraction * 1000))).alias("is_val")))
    store = _LayerStore(df, checkpoint, col, id_col, dict(hidden=hidden_layers, configs=layer_configs, val=val_fraction, ratio=feature_subset_ratio,
                                                          patience=patience, early=early_stopping, seed=seed)) if checkpoint else None
    for li, (h, cfg) in enumerate(zip(hidden_layers, layer_configs)):
        if stop_after is not None and li >= stop_after:
            break
        known = store.read(li) if store else None
        if known:
            layer, scores = known
            model.layers.append(layer)
            model.layer_scores += scores
            cur = materialize(cur.select("id", _layer_udf(layer.W, layer.b_hidden)(F.col("x")).alias("x"), "is_val"))
            continue
        tr, va = cur.where(~F.col("is_val")), cur.where(F.col("is_val"))
        layer, hist = rbm_fit(tr, h, cfg.get("learning_rate", 0.05), cfg.get("n_iter", 10), va, patience,
                              early_stopping, seed + li, batch_size=cfg.get("batch_size"), shards=cfg.get("shards", 8))
        model.layers.append(layer)
        scores = [(li, e, t, v) for e, t, v in hist]
        model.layer_scores += scores
        if store:
            store.write(li, layer, scores)
        if li + 1 < len(hidden_layers):         # nothing reads the rows of the last layer
            cur = materialize(cur.select("id", _layer_udf(layer.W, layer.b_hidden)(F.col("x")).alias("x"), "is_val"))
    return model


def dbn_fit_transform(df: DataFrame, col: str = "features", id_col: str = "row_id", out: str = "dbn_features",
                      **kw) -> tuple[DBNModel, DataFrame]:
    """Fit then transform."""
    m = dbn_fit(df, col, id_col, **kw)
    return m, m.transform(df, col, out)


def save_dbn(spark, model: DBNModel, path: str) -> None:
    """Weights table (one row per layer) + metadata."""
    from reviewlens.sources.store import save_model_tables
    meta = {"feature_indices": model.feature_indices, "mins": model.mins, "maxs": model.maxs}
    save_model_tables(spark, path, meta, {"weights": model.weights_table(spark),
                                          "scores": model.scores_table(spark)})


def load_dbn(spark, path: str) -> DBNModel:
    from reviewlens.sources.store import load_model_tables
    ship_package(spark)
    meta, t = load_model_tables(spark, path, ["weights", "scores"])
    layers = [RBMLayer(np.asarray(r["weights"]), np.asarray(r["b_visible"]), np.asarray(r["b_hidden"]))
              for r in sorted(t["weights"].collect(), key=lambda r: r["layer"])]
    scores = sorted(tuple(r) for r in t["scores"].select("layer", "epoch", "train_score", "val_score").collect()) if "scores" in t else []
    return DBNModel(layers, meta["feature_indices"], meta["mins"], meta["maxs"], scores)


def dbn_train_or_load(spark, base: str, df: DataFrame, col: str = "features", id_col: str = "row_id",
                      **kw) -> DBNModel:
    """Reuse a stored model keyed by the content fingerprint and parameters."""
    import json
    import os

    from reviewlens.sources.store import table_fingerprint
    import hashlib
    params = hashlib.sha1(json.dumps(kw, sort_keys=True, default=str).encode()).hexdigest()[:16]
    key = table_fingerprint(df.select(id_col, col)) + "-" + params
    path = os.path.join(base, "dbn", key)
    from reviewlens.session import path_exists
    if path_exists(spark, os.path.join(path, "meta")):
        return load_dbn(spark, path)
    m = dbn_fit(df, col, id_col, **kw)
    save_dbn(spark, m, path)
    return m
