"""D2 isolation forest.

Fit
  * per tree t a seeded sample of ``max_samples`` rows: the rows with the
    smallest hash(seed, t, id). A cheap Bernoulli pre-filter
    (hash-uniform < 3 * psi / n) keeps ~3 psi candidates per tree, so only
    about 3 * psi * n_trees rows are shuffled, never n * n_trees;
  * ``groupBy(tree).applyInPandas`` grows each tree (random feature, uniform
    split between the node's min and max, depth limit ceil(log2 psi)) from its
    seeded generator and returns its node table;
  * the forest (n_trees x <= 2 psi nodes) is model-sized and collected.
Score
  2 ** (-mean path length / c(psi)) computed by a scalar pandas UDF over the
  feature array (Arrow batches, vectorised traversal), or by a column expression
  over constant node arrays. No shuffle.
Flag
  score above the (1 - contamination) quantile of the training scores.
"""

from __future__ import annotations

import json
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.ranking import exact_quantiles
from reviewlens.operators.reduce import array_rows
from reviewlens.operators.scaling import Scaler
from reviewlens.session import materialize

EULER_GAMMA = 0.5772156649015329

NODE_SCHEMA = ("tree int, node int, feature int, split double, left_child int, right_child int, "
               "size long, depth int")


def average_path_length(n):
    """c(n): expected path length of an unsuccessful BST search."""
    n = np.asarray(n, dtype=np.float64)
    out = np.zeros_like(n)
    out[n == 2] = 1.0
    big = n > 2
    out[big] = 2.0 * (np.log(n[big] - 1.0) + EULER_GAMMA) - 2.0 * (n[big] - 1.0) / n[big]
    return out


def grow_tree(X: np.ndarray, tree: int, seed: int, max_depth: int) -> list[tuple]:
    rng = np.random.default_rng([seed, tree])
    nodes = []

    def build(idx, depth):
        nid = len(nodes)
        nodes.append(None)
        sub = X[idx]
        if depth >= max_depth or len(idx) <= 1:
            nodes[nid] = (tree, nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        lo, hi = sub.min(axis=0), sub.max(axis=0)
        cand = np.nonzero(hi > lo)[0]
        if len(cand) == 0:
            nodes[nid] = (tree, nid, -1, 0.0, -1, -1, len(idx), depth)
            return nid
        f = int(cand[rng.integers(len(cand))])
        s = float(rng.uniform(lo[f], hi[f]))
        go_left = sub[:, f] < s
        left = build(idx[go_left], depth + 1)
        right = build(idx[~go_left], depth + 1)
        nodes[nid] = (tree, nid, f, s, left, right, len(idx), depth)
        return nid

    build(np.arange(X.shape[0]), 0)
    return nodes


def path_lengths(X: np.ndarray, forest: dict) -> np.ndarray:
    """Mean adjusted path length of every row of X over the forest."""
    total = np.zeros(X.shape[0])
    flat, start = X.ravel(), np.arange(X.shape[0]) * X.shape[1]
    for feature, split, child, length, levels in forest["trees"]:
        node = np.zeros(X.shape[0], dtype=np.int64)
        for _ in range(levels):
            right = ~(flat[start + feature[node]] < split[node])
            node = child[2 * node + right]
        total += length[node]
    return total / max(1, len(forest["trees"]))


@dataclass
class IsolationForestModel:
    scaler: Scaler
    n_estimators: int = 100
    max_samples: int = 256
    contamination: float = 0.1
    seed: int = 42
    nodes: list = field(default_factory=list)
    threshold: float | None = None
    kind: str = "isolation_forest"

    @staticmethod
    def fit(df: DataFrame, spec: FeatureSpec | None = None, *, cols=None, vector=None, n_estimators: int = 100,
            max_samples="auto", contamination: float = 0.1, seed: int = 42, id_col: str = "row_id",
            scaler: Scaler | None = None, oversample: float = 3.0) -> "IsolationForestModel":
        spec = spec or FeatureSpec.of(df, cols, vector)
        sc = scaler or Scaler.fit(df, spec, id_col=id_col)
        n = sc.n
        psi = min(256, n) if max_samples == "auto" else (
            int(max_samples * n) if isinstance(max_samples, float) else min(int(max_samples), n))
        m = IsolationForestModel(sc, n_estimators, psi, contamination, seed)
        if n == 0 or not sc.kept:
            return m
        max_depth = int(math.ceil(math.log2(max(psi, 2))))
        X = df.select(F.col(id_col).alias("id"), F.array(*sc.scaled_exprs(df)).alias("x"))
        T = n_estimators

        def u(t):
            return F.pmod(F.xxhash64(F.lit(seed), t, F.col("id")), F.lit(1 << 53)).cast("double") / F.lit(float(1 << 53))

        while True:
            p = min(1.0, oversample * psi / n)
            # one-hash gate: a row joins any tree with probability q = 1-(1-p)^T;
            # gated rows (probability g >= q) then accept each tree with p / g,
            # so per-tree inclusion stays p while most rows cost a single hash
            g = min(1.0, 2.0 * (1.0 - (1.0 - p) ** T))
            trees = F.filter(F.sequence(F.lit(0), F.lit(T - 1)), lambda t: u(t) < F.lit(p / g))
            cand = X.where(u(F.lit(-1)) < F.lit(g)).select("id", "x", F.explode(trees).alias("tree")) \
                .withColumn("h", F.xxhash64(F.lit(seed), F.col("tree"), F.col("id")))

            def grow(pdf: pd.DataFrame) -> pd.DataFrame:
                pdf = pdf.sort_values(["h", "id"], kind="mergesort").head(psi)
                Xs = np.stack([np.asarray(v, dtype=np.float64) for v in pdf["x"].to_numpy()])
                t = int(pdf["tree"].iloc[0])
                return pd.DataFrame(grow_tree(Xs, t, seed, max_depth),
                                    columns=["tree", "node", "feature", "split", "left_child", "right_child",
                                             "size", "depth"])

            nodes = cand.groupBy("tree").applyInPandas(grow, NODE_SCHEMA).collect()
            roots = {r[0]: r[6] for r in nodes if r[1] == 0}
            # every tree must have its full sample; else draw again with more candidates
            if p >= 1.0 or (len(roots) == T and min(roots.values()) >= psi):
                break
            oversample *= 2

        m.nodes = [tuple(r) for r in nodes]
        scores = materialize(df.select(m.score_expr(df).alias("s")))   # scored once, reused by the quantile
        m.threshold = exact_quantiles(scores, "s", [1.0 - contamination]).get((), [None])[0]
        return m

    def forest(self) -> dict:
        """Per tree: feature and split of every node, its two children, its adjusted
        path length, and the levels to walk. A leaf is its own child, so a row that
        has arrived stays."""
        by_tree: dict[int, list] = {}
        for r in self.nodes:
            by_tree.setdefault(r[0], []).append(r)
        trees = []
        for t in sorted(by_tree):
            rs = sorted(by_tree[t], key=lambda r: r[1])
            feature, depth = np.array([r[2] for r in rs]), np.array([r[7] for r in rs], dtype=np.float64)
            own = np.arange(len(rs))
            child = np.stack([np.where(feature < 0, own, [r[4] for r in rs]), np.where(feature < 0, own, [r[5] for r in rs])], axis=1)
            trees.append((np.maximum(feature, 0), np.array([r[3] for r in rs]), child.ravel(),
                          depth + average_path_length(np.array([r[6] for r in rs], dtype=np.float64)), int(depth.max())))
        return {"trees": trees}

    def score_expr(self, df: DataFrame | None = None):
        forest = self.forest()
        c_psi = float(average_path_length(np.array([self.max_samples]))[0]) or 1.0

        @F.arrow_udf("double")
        def iso_score(x: pa.Array) -> pa.Array:
            if len(x) == 0:
                return pa.array([], pa.float64())
            return pa.array(np.power(2.0, -path_lengths(array_rows(x), forest) / c_psi), from_pandas=True)

        return iso_score(F.array(*self.scaler.scaled_exprs(df)))

    def score_expr_jvm(self, df: DataFrame | None = None):
        """The same score without Python workers: the forest is a few constant arrays
        and every tree is walked from its root by array lookups. Spark interprets
        such lookups step by step, so this takes some five times as long as
        :meth:`score_expr`; it is for places where no Python worker can run."""
        order = sorted(self.nodes, key=lambda r: (r[0], r[1]))
        at = {(r[0], r[1]): i for i, r in enumerate(order)}
        def constant(values, kind):
            return F.from_json(F.lit(json.dumps([v if kind == "int" else float(v) for v in values])), f"array<{kind}>")
        feature = constant([r[2] for r in order], "int")
        split = constant([r[3] for r in order], "double")
        left = constant([at.get((r[0], r[4]), -1) for r in order], "int")
        right = constant([at.get((r[0], r[5]), -1) for r in order], "int")
        length = constant(np.array([r[7] for r in order]) + average_path_length(np.array([r[6] for r in order])), "double")
        trees = sorted({r[0] for r in order})
        roots = constant([at[t, 0] for t in trees], "int")
        levels = F.sequence(F.lit(1), F.lit(max(1, max(r[7] for r in order))))
        c_psi = float(average_path_length(np.array([self.max_samples]))[0]) or 1.0

        def leaf(x, root):
            def step(node, _):
                return F.when(F.get(feature, node) < 0, node).when(
                    F.get(x, F.get(feature, node)) < F.get(split, node), F.get(left, node)).otherwise(F.get(right, node))
            return F.aggregate(levels, root, step)

        def score(x):
            total = F.aggregate(roots, F.lit(0.0), lambda s, root: s + F.get(length, leaf(x, root)))
            return F.pow(F.lit(2.0), -(total / F.lit(float(len(trees)))) / F.lit(c_psi))
        # one list with the features: they are computed once a row, not once a step
        return F.element_at(F.transform(F.array(F.array(*self.scaler.scaled_exprs(df))), score), 1)

    def transform(self, df: DataFrame, score_col: str = "anomaly_score", flag_col: str = "is_anomaly") -> DataFrame:
        if not self.nodes:
            return df.withColumn(score_col, F.lit(0.0)).withColumn(flag_col, F.lit(False))
        out = df.withColumn(score_col, self.score_expr(df))
        return out.withColumn(flag_col, F.col(score_col) > F.lit(self.threshold))
