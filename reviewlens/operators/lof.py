"""D3 local outlier factor (exact), built on the blocked k-NN join.

k-distance(o)      = distance from o to its k-th neighbour
reach(p, o)        = max(k-distance(o), d(p, o))
lrd(p)             = 1 / (mean over p's neighbours of reach(p, o) + 1e-10)
LOF(p)             = mean over p's neighbours of lrd(o) / lrd(p)

Every step is a join on row ids plus a grouped aggregate over n * k rows.
Training rows are scored with themselves excluded (``self_excluded``); new
rows are scored against the stored training table (``novelty``), where the
reference's novelty predict on its own training rows corresponds to
``mode='novelty'`` on the training frame. A row is flagged when its LOF is
above the (1 - contamination) quantile of the training LOFs.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reviewlens.session import materialize

from reviewlens.operators.features import FeatureSpec
from reviewlens.operators.neighbors import knn_join
from reviewlens.operators.ranking import exact_quantiles
from reviewlens.operators.scaling import Scaler

EPS = 1e-10


def _lrd(knn: DataFrame, kd: DataFrame) -> DataFrame:
    j = knn.join(kd.select(F.col("id").alias("neighbor_id"), F.col("kdist").alias("nk")), "neighbor_id")
    return j.groupBy("id").agg(
        (F.lit(1.0) / (F.avg(F.greatest(F.col("nk"), F.col("dist"))) + F.lit(EPS))).alias("lrd"))


def lof_scores(knn: DataFrame, train_kd: DataFrame, train_lrd: DataFrame, query_lrd: DataFrame) -> DataFrame:
    j = knn.join(train_lrd.select(F.col("id").alias("neighbor_id"), F.col("lrd").alias("nlrd")), "neighbor_id")
    m = j.groupBy("id").agg(F.avg("nlrd").alias("mean_nlrd"))
    return m.join(query_lrd, "id").select("id", (F.col("mean_nlrd") / F.col("lrd")).alias("lof"))


@dataclass
class LOFModel:
    scaler: Scaler
    k: int
    contamination: float
    train: DataFrame            # (id, features, kdist, lrd) — data-sized, stays distributed
    threshold: float | None
    id_col: str = "row_id"
    block_rows: int = 2048
    kind: str = "lof"

    @staticmethod
    def fit(df: DataFrame, spec: FeatureSpec | None = None, *, cols=None, vector=None, k: int = 20,
            contamination: float = 0.1, id_col: str = "row_id", block_rows: int = 2048,
            scaler: Scaler | None = None, scale: bool = True) -> "LOFModel":
        spec = spec or FeatureSpec.of(df, cols, vector)
        sc = scaler or Scaler.fit(df, spec, id_col=id_col)
        exprs = sc.scaled_exprs(df) if scale else sc.raw_exprs(df)
        X = materialize(df.select(F.col(id_col).alias("id"), F.array(*exprs).alias("features")))
        n = X.count()
        knn = materialize(knn_join(X, X, k, "id", "features", exclude_self=True, block_rows=block_rows, n_rows=n))
        kd = knn.groupBy("id").agg(F.max("dist").alias("kdist"))
        lrd = _lrd(knn, kd)
        train = materialize(X.join(kd, "id").join(lrd, "id"))
        lof = lof_scores(knn, train.select("id", "kdist"), train.select("id", "lrd"), train.select("id", "lrd"))
        lof = materialize(lof)
        thr = exact_quantiles(lof, "lof", [1.0 - contamination]).get((), [None])[0]
        m = LOFModel(sc, k, contamination, train, thr, id_col, block_rows)
        m._train_scores = lof
        m._scale = scale
        return m

    def training_scores(self) -> DataFrame:
        """(id, lof, is_anomaly) for the training rows, self excluded."""
        return self._train_scores.withColumn("is_anomaly", F.col("lof") > F.lit(self.threshold))

    def transform(self, df: DataFrame, mode: str = "novelty", score_col: str = "anomaly_score",
                  flag_col: str = "is_anomaly") -> DataFrame:
        """Score rows of ``df`` against the training table (novelty mode)."""
        exprs = self.scaler.scaled_exprs(df) if self._scale else self.scaler.raw_exprs(df)
        Q = df.select(F.col(self.id_col).alias("id"), F.array(*exprs).alias("features"))
        knn = knn_join(Q, self.train.select("id", "features"), self.k, "id", "features",
                       exclude_self=(mode == "self_excluded"), block_rows=self.block_rows)
        qk = knn.join(self.train.select(F.col("id").alias("neighbor_id"), F.col("kdist").alias("nk")), "neighbor_id")
        qlrd = qk.groupBy("id").agg(
            (F.lit(1.0) / (F.avg(F.greatest(F.col("nk"), F.col("dist"))) + F.lit(EPS))).alias("lrd"))
        lof = lof_scores(knn, self.train.select("id", "kdist"), self.train.select("id", "lrd"), qlrd)
        out = df.join(lof.withColumnRenamed("id", self.id_col), self.id_col, "left")
        return out.withColumnRenamed("lof", score_col).withColumn(flag_col, F.col(score_col) > F.lit(self.threshold))
