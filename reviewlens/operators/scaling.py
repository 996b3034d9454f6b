"""D0 prepare_matrix: drop zero-variance features (jitter when none vary), standardise.

Statistics come from one aggregate pass (``avg``, ``var_pop``, ``min``,
``max`` per feature, combined map-side). The fitted state is a handful of
numbers per feature and is stored with the detector model, so scoring new
rows replays exactly the same projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.features import FeatureSpec
from reviewlens.session import ship_package


def gaussian_noise(id_col: str, feature: int, seed: int) -> Column:
    """Deterministic N(0,1) per (row id, feature, seed) by Box-Muller over hashes."""
    def u(s):
        h = F.xxhash64(F.lit(s), F.lit(feature), F.col(id_col))
        return (F.pmod(h, F.lit(1 << 53)).cast("double") + F.lit(0.5)) / F.lit(float(1 << 53))
    return F.sqrt(F.lit(-2.0) * F.log(u(seed))) * F.cos(F.lit(2 * math.pi) * u(seed + 7919))


def feature_stat_aggs(exprs: list[Column]) -> list[Column]:
    aggs = []
    for j, e in enumerate(exprs):
        aggs += [F.avg(e).alias(f"m{j}"), F.var_pop(e).alias(f"v{j}"),
                 F.min(e).alias(f"lo{j}"), F.max(e).alias(f"hi{j}"), F.count(e).alias(f"c{j}")]
    aggs.append(F.count(F.lit(1)).alias("n"))
    return aggs


def stats_from_row(r, d: int) -> list[dict]:
    """Statistics per feature; a constant has variance 0 whatever rounding the
    merge of partial sums has left."""
    n = r["n"]
    return [dict(mean=r[f"m{j}"], var=0.0 if r[f"lo{j}"] is not None and r[f"lo{j}"] == r[f"hi{j}"] else r[f"v{j}"],
                 lo=r[f"lo{j}"], hi=r[f"hi{j}"], n=n, nulls=n - r[f"c{j}"]) for j in range(d)]


def vector_stats(df: DataFrame, vector: str, dim: int) -> list[dict]:
    """Statistics of all elements of an array or vector column from one aggregate
    expression, however wide it is; sparse vectors stay sparse."""
    from pyspark.ml.functions import array_to_vector
    from pyspark.ml.stat import Summarizer
    c = F.col(vector)
    if df.schema[vector].dataType.simpleString().startswith("array"):
        c = c.cast("array<double>")
        whole = c.isNotNull() & (F.size(c) == dim) & ~F.exists(c, lambda x: x.isNull())
        c = array_to_vector(F.when(whole, c).otherwise(F.array_repeat(F.lit(float("nan")), dim)))
    else:
        whole = c.isNotNull()
    r = df.groupBy(F.lit("all")).agg(Summarizer.metrics("mean", "variance", "min", "max").summary(c).alias("s"),
                                 F.count(F.lit(1)).alias("n"), F.count_if(~whole).alias("missing")).first()
    n = r["n"] if r else 0
    if n == 0:
        return [dict(mean=None, var=None, lo=None, hi=None, n=0, nulls=0)] * dim
    mean, var, lo, hi = (r["s"][k].toArray() for k in ("mean", "variance", "min", "max"))
    # the sample variance of the summary, as the population's
    return [dict(mean=float(mean[j]), var=0.0 if lo[j] == hi[j] else float(var[j]) * (n - 1) / n, lo=float(lo[j]), hi=float(hi[j]),
                 n=n, nulls=r["missing"]) for j in range(dim)]


def feature_stats_row(df: DataFrame, exprs: list[Column]) -> list[dict]:
    return stats_from_row(df.agg(*feature_stat_aggs(exprs)).first(), len(exprs))


@dataclass
class Scaler:
    spec: FeatureSpec
    kept: list[int] = field(default_factory=list)
    means: list[float] = field(default_factory=list)
    stds: list[float] = field(default_factory=list)
    los: list[float] = field(default_factory=list)
    his: list[float] = field(default_factory=list)
    jitter_eps: float | None = None
    jitter_seed: int = 42
    id_col: str | None = None
    n: int = 0

    # ------------------------------------------------------------- fit
    @staticmethod
    def fit(df: DataFrame, spec: FeatureSpec, id_col: str | None = "row_id",
            seed: int = 42, stats: list[dict] | None = None) -> "Scaler":
        """Fit on ``df``; ``stats`` may carry precomputed per-feature
        statistics (e.g. observed while the frame was written)."""
        ship_package(df.sparkSession)        # every detector is fitted through here
        exprs = spec.exprs(df)
        if stats is None:
            whole = isinstance(spec, FeatureSpec) and spec.vector is not None and spec.dim > 0
            stats = vector_stats(df, spec.vector, spec.dim) if whole else feature_stats_row(df, exprs)
        n = stats[0]["n"] if stats else 0
        bad = [spec.names[j] for j, s in enumerate(stats)
               if s.get("nulls") or s["var"] is not None and not math.isfinite(s["var"])]
        if bad:
            raise ValueError(f"features with NULL, NaN or infinite values must be imputed first: {', '.join(bad)}")
        kept = [j for j, s in enumerate(stats) if (s["var"] or 0.0) > 0.0]
        sc = Scaler(spec, id_col=id_col if (id_col and id_col in df.columns) else None,
                    jitter_seed=seed, n=n)
        if kept or not stats or n == 0:
            sc.kept = kept
            sc.means = [stats[j]["mean"] for j in kept]
            sc.stds = [math.sqrt(stats[j]["var"]) for j in kept]
            sc.los = [stats[j]["lo"] for j in kept]
            sc.his = [stats[j]["hi"] for j in kept]
            return sc
        # Nothing varies -> add tiny noise (1e-6, then 1e-4) and keep every feature
        for eps in (1e-6, 1e-4):
            sc.jitter_eps = eps
            sc.kept = list(range(len(exprs)))
            js = feature_stats_row(df, sc.raw_exprs(df))
            if any((s["var"] or 0) > 0 for s in js):
                break
        sc.means = [s["mean"] for s in js]
        sc.stds = [math.sqrt(s["var"]) if (s["var"] or 0) > 0 else 1.0 for s in js]
        sc.los = [s["lo"] for s in js]
        sc.his = [s["hi"] for s in js]
        return sc

    # ------------------------------------------------------------- apply
    def raw_exprs(self, df: DataFrame | None = None) -> list[Column]:
        """Kept features before standardisation (with jitter when fitted so). A row
        with a NULL or NaN in one of them is an error, as it is in ``fit``."""
        exprs = self.spec.exprs(df)
        out = []
        for j in self.kept:
            e = self._checked(exprs) if j == self.kept[0] else exprs[j]
            if self.jitter_eps is not None:
                noise = gaussian_noise(self.id_col, j, self.jitter_seed) if self.id_col \
                    else F.randn(self.jitter_seed + j)
                e = e + F.lit(self.jitter_eps) * noise
            out.append(e)
        return out

    def _checked(self, exprs: list[Column]) -> Column:
        """The first kept feature, behind one check of all of them: a sum is NULL with
        any NULL term, and the greatest of some numbers is NaN with any NaN."""
        kept = [exprs[j] for j in self.kept]
        total = kept[0]
        for e in kept[1:]:
            total = total + e
        bad = total.isNull() | F.isnan(F.greatest(*kept) if len(kept) > 1 else kept[0])
        message = f"a row has NULL or NaN in one of its features ({', '.join(self.kept_names[:5])}, ...); impute it first"
        return F.when(bad, F.raise_error(F.lit(message)).cast("double")).otherwise(kept[0])

    def scaled_exprs(self, df: DataFrame | None = None) -> list[Column]:
        return [(e - F.lit(m)) / F.lit(s) for e, m, s in zip(self.raw_exprs(df), self.means, self.stds)]

    @property
    def kept_names(self) -> list[str]:
        names = self.spec.names
        return [names[j] for j in self.kept]

    def transform(self, df: DataFrame, out: str = "features", keep: list[str] | None = None) -> DataFrame:
        """Append an ``array<double>`` column of standardised kept features."""
        keep_cols = [F.col(c) for c in (keep if keep is not None else df.columns)]
        return df.select(*keep_cols, F.array(*self.scaled_exprs(df)).alias(out))

    def to_rows(self) -> list[tuple]:
        names = self.spec.names
        return [(names[j], j, m, s) for j, m, s in zip(self.kept, self.means, self.stds)]


def materialize_and_fit(df: DataFrame, spec: FeatureSpec, id_col: str | None = "row_id",
                        seed: int = 42) -> tuple[DataFrame, "Scaler"]:
    """Write ``df`` as a table and fit the scaler statistics in the same job."""
    from reviewlens.session import materialize_observed
    exprs = spec.exprs(df)
    table, m = materialize_observed(df, feature_stat_aggs(exprs))
    return table, Scaler.fit(table, spec, id_col, seed, stats=stats_from_row(m, len(exprs)))
