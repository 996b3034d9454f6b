"""T5 as a fitted model, P12 as sparse vectors.

A :class:`FeatureModel` holds what the features of a row depend on beside the
row: the vocabulary and idf of each text column, the mean of each numeric
column, the first review time. It is fitted on one table, stored as a versioned
artefact of a few small tables, and applied to any other table.

Applying it is a narrow projection: tokens are counted against the fitted
vocabulary, weighted, normalised and assembled row by row by Spark's own
feature transformers, as sparse vectors. Nothing is shuffled, and a document
costs what its terms cost, not the width of the vocabulary.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct, HashingTF, Normalizer, VectorAssembler
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reviewlens.operators.text import tfidf, tokenize
from reviewlens.sources.store import load_model_tables, save_model_tables

#: layout of the stored artefact
VERSION = 1
MODES = ("tfidf", "hash")


def _known(name: str) -> Column:
    """A numeric column with NaN as NULL."""
    c = F.col(name).cast("double")
    return F.when(~F.isnan(c), c)


@dataclass
class FeatureModel:
    texts: dict[str, int]                                    # text column -> most terms (or buckets)
    numeric: list[str]
    mode: str = "tfidf"
    time_col: str | None = None
    terms: dict[str, list[tuple[str, float]]] = field(default_factory=dict)    # text column -> (term, idf) by index
    means: dict[str, float] = field(default_factory=dict)
    first_time: int | None = None                            # microseconds since the epoch

    # ---------------------------------------------------------------- fit
    @staticmethod
    def fit(df: DataFrame, texts: dict[str, int], numeric: list[str], mode: str = "tfidf", time_col: str | None = None,
            id_col: str = "row_id") -> "FeatureModel":
        """``texts`` gives the number of terms (hash mode: buckets) of each text column.

        A null text has no terms. A numeric column without any value has no mean
        and is an error. With ``time_col`` the days since the first time of the
        fitted rows are a last feature.
        """
        if mode not in MODES:
            raise ValueError(f"mode must be one of {', '.join(MODES)}, not {mode!r}")
        m = FeatureModel(dict(texts), list(numeric), mode, time_col)
        aggs = [F.avg(_known(c)).alias(c) for c in numeric] + [F.count(F.lit(1)).alias("_n")]
        if time_col:
            aggs.append(F.min(F.unix_micros(F.col(time_col).cast("timestamp"))).alias("_first"))
        r = df.agg(*aggs).first()
        empty = [c for c in numeric if r[c] is None]
        if empty:
            raise ValueError(f"numeric columns without any value have no mean: {', '.join(empty)}")
        m.means = {c: r[c] for c in numeric}
        m.first_time = r["_first"] if time_col else None
        for c, k in texts.items():
            if mode == "tfidf":
                _, idf = tfidf(df, id_col, c, k, n_docs=r["_n"])
                m.terms[c] = [(t["term"], t["idf"]) for t in sorted(idf.collect(), key=lambda t: t["term_index"])]
        return m

    # ---------------------------------------------------------------- apply
    @property
    def names(self) -> list[str]:
        """Name of every element of the feature vector."""
        out = []
        for c, k in self.texts.items():
            out += [f"{c}:{t}" for t, _ in self.terms[c]] if self.mode == "tfidf" else [f"{c}#{i}" for i in range(k)]
        return out + self.numeric + (["days_since_first"] if self.time_col else [])

    def transform(self, df: DataFrame, out: str = "features") -> DataFrame:
        """``df`` with the sparse vector ``out``; a missing number is the fitted mean."""
        parts, work = [], df
        for i, (c, k) in enumerate(self.texts.items()):
            tokens, counts, weights, block = (f"_{step}{i}" for step in ("tokens", "counts", "weights", "block"))
            if self.mode == "tfidf" and not self.terms[c]:
                continue
            work = work.withColumn(tokens, tokenize(c))
            if self.mode == "tfidf":
                vocabulary, idf = zip(*self.terms[c])
                counter = CountVectorizerModel.from_vocabulary(list(vocabulary), inputCol=tokens, outputCol=counts)
                weigh = ElementwiseProduct(scalingVec=Vectors.dense(idf), inputCol=counts, outputCol=weights)
                work = weigh.transform(counter.transform(work))
            else:
                work = HashingTF(numFeatures=k, inputCol=tokens, outputCol=weights).transform(work)
            work = Normalizer(p=2.0, inputCol=weights, outputCol=block).transform(work)
            parts.append(block)
        for i, c in enumerate(self.numeric):
            work = work.withColumn(f"_number{i}", F.coalesce(_known(c), F.lit(self.means[c])))
            parts.append(f"_number{i}")
        if self.time_col:
            micros = F.unix_micros(F.col(self.time_col).cast("timestamp")) - F.lit(self.first_time)
            work = work.withColumn("_days", F.coalesce(micros / F.lit(86_400_000_000.0), F.lit(0.0)))
            parts.append("_days")
        return VectorAssembler(inputCols=parts, outputCol=out).transform(work).select(*df.columns, out)

    # ---------------------------------------------------------------- store
    def save(self, spark: SparkSession, path: str) -> None:
        meta = {"version": VERSION, "texts": list(self.texts.items()), "numeric": self.numeric, "mode": self.mode,
                "time_col": self.time_col, "first_time": self.first_time}
        words = [(c, t, i, w) for c, ts in self.terms.items() for i, (t, w) in enumerate(ts)]
        save_model_tables(spark, path, meta, {
            "vocabulary": spark.createDataFrame(words, "field string, term string, term_index int, idf double"),
            "means": spark.createDataFrame(list(self.means.items()), "field string, mean double")})

    @staticmethod
    def load(spark: SparkSession, path: str) -> "FeatureModel":
        meta, tables = load_model_tables(spark, path, ["vocabulary", "means"])
        if meta.pop("version") != VERSION:
            raise ValueError(f"{path} holds no feature model of version {VERSION}")
        m = FeatureModel(dict(meta["texts"]), meta["numeric"], meta["mode"], meta["time_col"], first_time=meta["first_time"])
        m.means = {r["field"]: r["mean"] for r in tables["means"].collect()}
        if m.mode == "tfidf":
            m.terms = {c: [] for c in m.texts}
        for r in sorted(tables["vocabulary"].collect(), key=lambda r: r["term_index"]):
            m.terms[r["field"]].append((r["term"], r["idf"]))
        return m


__all__ = ["FeatureModel", "MODES", "VERSION"]
