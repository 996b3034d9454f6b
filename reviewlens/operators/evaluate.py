"""Evaluation against a label column: A16-A20, A22, A27.

Inputs are long result tables ``(model, ..., label, is_anomaly, anomaly_score)``;
every metric is one grouped aggregate (combined map-side), so a metrics table
has one row per model regardless of data size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import materialize


def _b(c) -> Column:
    return (F.col(c) if isinstance(c, str) else c).cast("boolean")


def confusion_matrix(df: DataFrame, label_col: str = "label", pred_col: str = "is_anomaly",
                     by: list[str] | None = None) -> DataFrame:
    """Counts per (actual, predicted) on a complete 2x2 spine."""
    by = list(by or [])
    counts = df.groupBy(*by).agg(
        F.count_if(_b(label_col) & _b(pred_col)).alias("tp"),
        F.count_if(~_b(label_col) & _b(pred_col)).alias("fp"),
        F.count_if(_b(label_col) & ~_b(pred_col)).alias("fn"),
        F.count_if(~_b(label_col) & ~_b(pred_col)).alias("tn"))
    cells = F.array(
        F.struct(F.lit(True).alias("actual"), F.lit(True).alias("predicted"), F.col("tp").alias("n")),
        F.struct(F.lit(False).alias("actual"), F.lit(True).alias("predicted"), F.col("fp").alias("n")),
        F.struct(F.lit(True).alias("actual"), F.lit(False).alias("predicted"), F.col("fn").alias("n")),
        F.struct(F.lit(False).alias("actual"), F.lit(False).alias("predicted"), F.col("tn").alias("n")))
    return counts.select(*by, F.explode(cells).alias("c")).select(*by, "c.*")


def _safe(num: Column, den: Column, zero_division: float) -> Column:
    return F.when(den == 0, F.lit(float(zero_division))).otherwise(num.cast("double") / den.cast("double"))


def binary_metrics(df: DataFrame, label_col: str = "label", pred_col: str = "is_anomaly",
                   by: list[str] | None = None, zero_division: float = 0.0) -> DataFrame:
    """A17 precision/recall/F1 of the anomaly class, A18 weighted F1,
    A19 AUC of the hard prediction ((TPR + TNR) / 2, NULL with one class),
    A15 anomaly count and percentage, A27 number of label classes. Rows without
    a label or a prediction are in ``n`` and in no cell; weighted F1 is over the
    rows in the cells, and NULL without any."""
    by = list(by or [])
    y, p = _b(label_col), _b(pred_col)
    c = df.groupBy(*by).agg(
        F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"),
        F.count_if(y & ~p).alias("fn"), F.count_if(~y & ~p).alias("tn"),
        F.count("*").alias("n"), F.count_distinct(y).alias("label_classes"))
    tp, fp, fn, tn = (F.col(x) for x in ("tp", "fp", "fn", "tn"))
    prec = _safe(tp, tp + fp, zero_division)
    rec = _safe(tp, tp + fn, zero_division)
    f1 = _safe(2 * tp, 2 * tp + fp + fn, zero_division)
    # negative class (for the support-weighted F1)
    f1_neg = _safe(2 * tn, 2 * tn + fn + fp, zero_division)
    pos, neg = tp + fn, tn + fp
    wf1 = F.try_divide(f1 * pos + f1_neg * neg, (pos + neg).cast("double"))
    tpr = F.try_divide(tp.cast("double"), pos.cast("double"))
    tnr = F.try_divide(tn.cast("double"), neg.cast("double"))
    auc = F.when(F.col("label_classes") < 2, F.lit(None).cast("double")).otherwise((tpr + tnr) / 2)
    return c.select(*by, "tp", "fp", "fn", "tn", "n", "label_classes",
                    prec.alias("precision"), rec.alias("recall"), f1.alias("f1"),
                    wf1.alias("weighted_f1"), auc.alias("roc_auc_binary"),
                    (tp + fp).alias("anomalies_detected"),
                    (F.try_divide((tp + fp).cast("double"), F.col("n").cast("double")) * 100.0).alias("anomaly_pct"))


def roc_curve(df: DataFrame, label_col: str = "label", score_col: str = "anomaly_score",
              by: list[str] | None = None) -> DataFrame:
    """(fpr, tpr) at every distinct score (descending), with the increments
    ``d_fpr`` and ``d_tpr`` of the point.

    Rows are first reduced to one row per (group, distinct score) with
    positive/negative counts (map-side combine). The running sums over that
    table are range-partitioned (:func:`prefix_sums`), whatever its size.
    """
    by = list(by or [])
    y = _b(label_col)
    pts = materialize(df.groupBy(*by, F.col(score_col).alias("threshold")).agg(
        F.count_if(y).alias("pos"), F.count_if(~y).alias("neg")))
    tot = pts.groupBy(*by).agg(F.sum("pos").alias("P"), F.sum("neg").alias("N"))
    cum = prefix_sums(pts, by, "threshold", ["pos", "neg"], descending=True) \
        .withColumnRenamed("pos_cum", "tp").withColumnRenamed("neg_cum", "fp")
    if by:
        named = tot.toDF(*[f"_tot_{c}" for c in by], "P", "N")
        cur = cum.join(named, [F.col(c).eqNullSafe(F.col(f"_tot_{c}")) for c in by])
    else:   # one row: use literals rather than a join
        t = tot.first()
        cur = cum.withColumn("P", F.lit((t["P"] if t else 0) or 0)).withColumn("N", F.lit((t["N"] if t else 0) or 0))
    share = lambda c, total: F.try_divide(F.col(c).cast("double"), F.col(total).cast("double"))
    return cur.select(*by, "threshold", share("fp", "N").alias("fpr"), share("tp", "P").alias("tpr"),
                      share("neg", "N").alias("d_fpr"), share("pos", "P").alias("d_tpr"))


def roc_auc(curve: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Trapezoid AUC of a curve from :func:`roc_curve` (starts at (0, 0)).

    Every point knows its increments, so the area is a plain sum and needs no
    neighbouring row.
    """
    area = F.col("d_fpr") * (2 * F.col("tpr") - F.col("d_tpr")) / 2
    return curve.groupBy(*(by or [])).agg(F.sum(area).alias("auc"))


def prefix_sums(df: DataFrame, by: list[str], order_col: str, sum_cols: list[str],
                descending: bool = False, partitions: int | None = None) -> DataFrame:
    """Running sums over a large sorted table without a single-task window.

    Range-partition by (by, order), sort within partitions, let each task
    compute local running sums (Arrow batches) and per-partition totals, then
    add the totals of all earlier partitions (a table of #partitions rows).
    The partitioned frame is checkpointed so both passes see the same
    partition layout.
    """
    import pandas as pd

    spark = df.sparkSession
    order = F.col(order_col).desc() if descending else F.col(order_col).asc()
    n_part = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    part = df.repartitionByRange(n_part, *[F.col(c) for c in by], order) \
        .sortWithinPartitions(*[F.col(c) for c in by], order) \
        .withColumn("_pid", F.spark_partition_id())
    part = part.checkpoint(eager=True)
    # one row per (partition, group): the sum over all earlier partitions of the group
    earlier = Window.partitionBy(*by).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    totals = part.groupBy("_pid", *by).agg(*[F.sum(c).alias(c) for c in sum_cols])
    off = totals.select(F.col("_pid").alias("_off_pid"), *[F.col(c).alias(f"_off_{c}") for c in by],
                        *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}_off") for c in sum_cols])

    from pyspark.sql.types import LongType, StructField, StructType
    # a new StructType: ``part.schema`` is cached on the frame and must not be mutated
    schema = StructType(list(part.schema.fields) + [StructField(f"{c}_local", LongType()) for c in sum_cols])

    def local(it):
        carry: dict = {}
        for pdf in it:
            for c in sum_cols:
                vals = pdf[c].fillna(0).astype("int64")
                if by:
                    # rows of a group stand together: one number and one lookup per group of the batch
                    groups = pdf.groupby(by, sort=False, dropna=False)
                    code = groups.ngroup().to_numpy()
                    keys = [tuple(None if pd.isna(x) else x for x in k) for k in pdf[by].drop_duplicates().itertuples(index=False)]
                    out = vals.groupby(code, sort=False).cumsum() + pd.Series([carry.get((c, k), 0) for k in keys])[code].to_numpy()
                    for k, v in zip(keys, out.groupby(code, sort=False).last()):
                        carry[(c, k)] = int(v)
                else:
                    out = vals.cumsum() + carry.get((c, ()), 0)
                    if len(out):
                        carry[(c, ())] = int(out.iloc[-1])
                pdf[f"{c}_local"] = out.astype("int64")
            yield pdf

    loc = part.mapInPandas(local, schema)
    same = F.col("_pid") == F.col("_off_pid")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"_off_{c}"))
    res = loc.join(off, same)
    for c in sum_cols:
        res = res.withColumn(f"{c}_cum", F.col(f"{c}_local") + F.col(f"{c}_off"))
    return res.drop("_pid", "_off_pid", *[f"_off_{c}" for c in by], *[f"{c}_local" for c in sum_cols], *[f"{c}_off" for c in sum_cols])
