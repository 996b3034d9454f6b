"""Quality classifier: a sparse ensemble of rules over text statistics.

Trees are grown on the residuals of a boosted model; every path from a root to
a node is a rule, a conjunction of bounds on statistics. A lasso logistic
regression weighs the rules and leaves few of them, and those are compiled
into one Spark column expression over the statistics columns.

The model is fitted on the driver on a bounded sample of labelled rows
(``sample_rows``, chosen by a hash of the id); scoring runs over all rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import keyed_text, prepare, text_hash
from .text_stats import NAMES, SCHEMA, stats_pass

SAMPLE_ROWS = 20_000
TREES, DEPTH, LEAF = 40, 3, 20
#: l1 weight, in units of the mean loss
LASSO = 0.002

Bound = tuple[int, bool, float]                          # statistic, True for <=, threshold


@dataclass
class RuleModel:
    names: tuple[str, ...] = NAMES
    rules: list[tuple[Bound, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    intercept: float = 0.0

    def column(self) -> Column:
        """The probability of label 1 as one Spark expression."""
        total = F.lit(float(self.intercept))
        for rule, weight in zip(self.rules, self.weights):
            test = None
            for j, below, at in rule:
                c = F.col(self.names[j])
                one = c <= F.lit(float(at)) if below else c > F.lit(float(at))
                test = one if test is None else test & one
            total = total + F.when(test, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _grow(x: np.ndarray, bins: list[np.ndarray], codes: np.ndarray, grad: np.ndarray, rows: np.ndarray,
          features: np.ndarray, depth: int, path: tuple, rules: dict) -> np.ndarray:
    """Least-squares tree on the residuals; adds every path, returns fitted values of the rows."""
    value = np.full(len(rows), grad[rows].mean())
    if depth == 0 or len(rows) < 2 * LEAF:
        return value
    best = (1e-9, None, None)
    for j in features:
        c = codes[rows, j]
        n = np.bincount(c, minlength=len(bins[j]) + 1).cumsum()[:-1]
        s = np.bincount(c, weights=grad[rows], minlength=len(bins[j]) + 1).cumsum()[:-1]
        ok = (n >= LEAF) & (len(rows) - n >= LEAF)
        if not ok.any():
            continue
        total = grad[rows].sum()
        gain = np.where(ok, s ** 2 / np.maximum(n, 1) + (total - s) ** 2 / np.maximum(len(rows) - n, 1), 0) - total ** 2 / len(rows)
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = (float(gain[k]), int(j), k)
    if best[1] is None:
        return value
    _, j, k = best
    left = codes[rows, j] <= k
    for side, below in ((left, True), (~left, False)):
        step = path + ((j, below, float(bins[j][k])),)
        rules.setdefault(_simplify(step), None)
        value[side] = _grow(x, bins, codes, grad, rows[side], features, depth - 1, step, rules)
    return value


def _simplify(path: tuple) -> tuple[Bound, ...]:
    """The tightest bound per statistic and side."""
    tight: dict = {}
    for j, below, at in path:
        old = tight.get((j, below))
        tight[(j, below)] = at if old is None else (min(old, at) if below else max(old, at))
    return tuple(sorted((j, below, at) for (j, below), at in tight.items()))


def _applies(rule: tuple[Bound, ...], x: np.ndarray) -> np.ndarray:
    hit = np.ones(len(x), dtype=bool)
    for j, below, at in rule:
        hit &= x[:, j] <= at if below else x[:, j] > at
    return hit


def fit_rules(x: np.ndarray, y: np.ndarray, seed: int = 1) -> RuleModel:
    """Rules of boosted trees, weighted by lasso logistic regression (FISTA)."""
    if not len(y):
        return RuleModel()
    prior = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    base = float(np.log(prior / (1 - prior)))
    if y.min() == y.max():
        return RuleModel(intercept=base)
    rng = np.random.default_rng(seed)
    bins = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 65)[1:-1])) for j in range(x.shape[1])]
    codes = np.column_stack([np.searchsorted(b, x[:, j], side="left") for j, b in enumerate(bins)])
    rules: dict = {}
    score = np.full(len(y), base)
    for _ in range(TREES):
        grad = y - 1 / (1 + np.exp(-score))
        rows = np.flatnonzero(rng.random(len(y)) < 0.7)
        features = rng.permutation(x.shape[1])[:max(3, x.shape[1] * 2 // 3)]
        if len(rows) >= 2 * LEAF:
            fitted: dict = {}
            _grow(x, bins, codes, grad, rows, features, DEPTH, (), fitted)
            rules.update(fitted)
            leaves = [r for r in fitted if len(r)]
            hits = np.column_stack([_applies(r, x) for r in leaves]) if leaves else np.zeros((len(y), 0))
            for c in range(hits.shape[1]):               # a damped step along every rule of the tree
                h = hits[:, c]
                if h.any():
                    score[h] += 0.1 * grad[h].mean() / max((0.25 - abs(prior - 0.5) ** 2), 0.05)
    names = [r for r in rules if LEAF <= _applies(r, x).sum() <= len(y) - 1]
    if not names:
        return RuleModel(intercept=base)
    hits = {_applies(r, x).tobytes(): r for r in reversed(names)}   # rules with the same rows count once
    names = sorted(hits.values())
    a = np.column_stack([_applies(r, x) for r in names]).astype(float)
    scale = np.maximum(a.std(axis=0), 1e-6)
    centre = a.mean(axis=0)
    z = (a - centre) / scale
    w, b = np.zeros(z.shape[1]), base
    v, vb, t = w.copy(), b, 1.0
    step = 4.0 / max(np.linalg.eigvalsh(z.T @ z / len(y)).max() + 1, 1.0)
    for _ in range(600):
        p = 1 / (1 + np.exp(-np.clip(z @ v + vb, -30, 30)))
        new = v - step * (z.T @ (p - y) / len(y))
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_b = vb - step * float((p - y).mean())
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, vb = new + (t - 1) / t2 * (new - w), new_b + (t - 1) / t2 * (new_b - b)
        w, b, t = new, new_b, t2
    on = np.flatnonzero(np.abs(w) > 1e-6)
    weights = w[on] / scale[on]
    return RuleModel(rules=[names[i] for i in on], weights=weights.tolist(), intercept=float(b - (weights * centre[on]).sum()))


def held_out(id_col: Column, modulus: int, remainder: int) -> Column:
    """crc32 of the id as text, modulo; a null id counts as the empty text."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def labelled_ids(labels: DataFrame, label: str, test: Column) -> DataFrame:
    """(doc_id, y) of the labelled documents outside the held-out part. Null
    labels and ids are left out; an id with several labels counts by their mean."""
    return (labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("double").alias("y"))
            .filter("doc_id is not null and y is not null").filter(~test)
            .groupBy("doc_id").agg(F.avg("y").alias("y")))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, test: Column, rows: int) -> DataFrame:
    """At most ``rows`` labelled documents: doc_id, text, y. The ids are the first by
    hash, so the sample does not depend on the order or partitions of the tables."""
    ids = labelled_ids(labels, label, test).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    return docs.join(F.broadcast(ids), "doc_id")         # at most ``rows`` ids


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 3, remainder: int = 1,
                sample_rows: int = SAMPLE_ROWS) -> RuleModel:
    sample = labelled_sample(docs, labels, label, held_out(F.col("doc_id"), modulus, remainder), sample_rows)
    stats = sample.select("doc_id", "y", "text").mapInArrow(stats_pass(("doc_id", "y")), f"doc_id long, y double, {SCHEMA}")
    # one row per sampled id: of the texts of a repeated one, that with the smallest statistics
    rows = stats.groupBy("doc_id").agg(F.min(F.struct("y", *NAMES)).alias("s")).select("s.*").collect()
    table = np.array(sorted(tuple(r) for r in rows), dtype=float).reshape(len(rows), len(NAMES) + 1)
    return fit_rules(table[:, 1:], (table[:, 0] >= 0.5).astype(float))


def quality_scores(df: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                   threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, hashed: bool = False) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, and with
    ``hashed`` text_hash, which tells the texts of one id apart.

    A null or empty text has zero statistics and is scored like any other.
    Without usable labels every score is 0.5; with labels of one class only it
    is close to that class. Repeated rows are scored one by one. An empty
    table gives an empty result; other columns are ignored.
    """
    prepare(df.sparkSession)
    docs = keyed_text(df, id_col, text_col)
    model = fit_quality(docs, labels, sample_rows=sample_rows)
    keys = ["text_hash"] if hashed else []
    if hashed:
        docs = docs.withColumn("text_hash", text_hash(F.col("text")))
    stats = docs.mapInArrow(stats_pass(("doc_id", *keys)), ", ".join(["doc_id long", *[f"{k} long" for k in keys], SCHEMA]))
    return (stats.withColumn("score", model.column())
            .select("doc_id", held_out(F.col("doc_id"), 3, 1).alias("held_out"), "score",
                    (F.col("score") >= threshold).cast("int").alias("predicted"), *keys))
