"""D1 HBOS: histogram-based outlier score.

Fit: per kept feature an equal-width histogram with ``n_bins`` bins over the
training range; density = count / (n * bin width) measured in standardised
units. Score of a row = sum over features of -log2(density(bin) + alpha);
values outside the training range use the edge bin when within ``tol`` bin
widths of it, else the feature's largest (worst) term. A row is flagged when
its score exceeds the (1 - contamination) quantile of the training scores.

Binning is done on the raw kept features: standardisation is affine, so the
bins are the same, and only the density needs the std factor. This keeps the
bin choice independent of floating-point noise in mean/std.

Plan shape: fit = 2 aggregate jobs (range, bin counts via one ``explode`` of
bins numbered over all features, combined map-side, d * n_bins output rows) + the exact
quantile passes. Scoring is a pure row-wise expression (literal lookup
arrays): no shuffle, no join, no Python — works unchanged on a stream.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.ranking import exact_quantiles
from reviewlens.operators.scaling import Scaler
from reviewlens.session import materialize_observed


def _bin_expr(x: Column, lo: float, w: float, n_bins: int) -> Column:
    return F.least(F.floor((x - F.lit(lo)) / F.lit(w)), F.lit(n_bins - 1)).cast("int")


@dataclass
class HBOSModel:
    scaler: Scaler
    n_bins: int = 10
    alpha: float = 0.1
    tol: float = 0.5
    contamination: float = 0.1
    lo: list[float] = field(default_factory=list)
    width: list[float] = field(default_factory=list)
    terms: list[list[float]] = field(default_factory=list)   # -log2(density + alpha)
    threshold: float | None = None
    kind: str = "hbos"

    @staticmethod
    def fit(df: DataFrame, spec: FeatureSpec | None = None, *, cols: list[str] | None = None,
            vector: str | None = None, n_bins: int = 10, alpha: float = 0.1, tol: float = 0.5,
            contamination: float = 0.1, id_col: str | None = "row_id", scaler: Scaler | None = None,
            seed: int = 42) -> "HBOSModel":
        spec = spec or FeatureSpec.of(df, cols, vector)
        sc = scaler or Scaler.fit(df, spec, id_col=id_col, seed=seed)
        m = HBOSModel(sc, n_bins, alpha, tol, contamination)
        if sc.n == 0 or not sc.kept:
            return m
        raw = sc.raw_exprs(df)
        los, widths = [], []
        for lo, hi in zip(sc.los, sc.his):
            if hi == lo:             # numpy's histogram widens an empty range by 0.5
                lo, hi = lo - 0.5, hi + 0.5
            los.append(lo)
            widths.append((hi - lo) / n_bins)
        bins = F.explode(F.array(*[F.lit(j * n_bins) + _bin_expr(x, los[j], widths[j], n_bins) for j, x in enumerate(raw)]))
        table = [[0] * n_bins for _ in raw]
        for r in df.select(bins.alias("b")).groupBy("b").count().collect():
            table[r["b"] // n_bins][r["b"] % n_bins] = r["count"]
        n = sc.n
        terms = []
        for j, row in enumerate(table):
            w_std = widths[j] / sc.stds[j]
            terms.append([-math.log2(c / (n * w_std) + alpha) for c in row])
        m.lo, m.width, m.terms = los, widths, terms
        # one narrow table of training scores, reused by every quantile pass;
        # its count / min / max are observed while it is written
        scores, st = materialize_observed(df.select(m.score_expr(df).alias("score")), [
            F.count("score").alias("n"), F.min("score").alias("lo"), F.max("score").alias("hi")])
        m.threshold = exact_quantiles(scores, "score", [1.0 - contamination],
                                      known=(st["n"], st["lo"], st["hi"]))[()][0]
        return m

    # --------------------------------------------------------------- scoring
    def term_expr(self, x: Column, j: int) -> Column:
        lo, w, nb = self.lo[j], self.width[j], self.n_bins
        hi = lo + w * nb
        t = self.terms[j]
        worst = F.lit(max(t))
        lookup = F.element_at(F.array(*[F.lit(v) for v in t]), _bin_expr(x, lo, w, nb) + 1)
        return (F.when(x < F.lit(lo), F.when(F.lit(lo) - x <= F.lit(w * self.tol), F.lit(t[0])).otherwise(worst))
                 .when(x > F.lit(hi), F.when(x - F.lit(hi) <= F.lit(w * self.tol), F.lit(t[-1])).otherwise(worst))
                 .otherwise(lookup))

    def score_expr(self, df: DataFrame | None = None) -> Column:
        if not self.terms:
            return F.lit(0.0)
        raw = self.scaler.raw_exprs(df)
        total = None
        for j, x in enumerate(raw):
            e = self.term_expr(x, j)
            total = e if total is None else total + e
        return total

    def transform(self, df: DataFrame, score_col: str = "anomaly_score", flag_col: str = "is_anomaly") -> DataFrame:
        if not self.terms:   # F5: unfitted / empty -> every row normal
            return df.withColumn(score_col, F.lit(0.0)).withColumn(flag_col, F.lit(False))
        s = self.score_expr(df)
        out = df.withColumn(score_col, s)
        return out.withColumn(flag_col, F.col(score_col) > F.lit(self.threshold))

    def to_rows(self) -> list[tuple]:
        names = self.scaler.kept_names
        return [(names[j], j, b, self.lo[j], self.width[j], self.terms[j][b])
                for j in range(len(self.terms)) for b in range(self.n_bins)]
