"""Text features: T1 tokenize, O6 top_terms, T2 TF-IDF, T3 hashing, T4 switch,
T5 prepare_features (text || summary || numeric).

Tokens are maximal runs of at least two Unicode word characters (letters,
digits, underscore) of the lower-cased text — the usual ``\\b\\w\\w+\\b``
pattern written without word-boundary assertions so every regex engine
agrees. Whole texts are tokenised; nothing is truncated.

Plan shape: ``explode`` of tokens feeds grouped counts with map-side combine.
The vocabulary is a top-k (k <= a few hundred, the only broadcast, bounded by
k); postings are filtered by a broadcast semi-join on it *before* the
(doc, term) shuffle. Document norms are a grouped sum joined back by doc id.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reviewlens.session import materialize

TOKEN_PATTERN = r"[\p{L}\p{N}_]{2,}"


def tokenize(text) -> Column:
    """Array of lower-cased tokens."""
    c = F.col(text) if isinstance(text, str) else text
    return F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(TOKEN_PATTERN), 0)


def postings(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term) rows, one per token occurrence."""
    return df.select(F.col(id_col).alias("id"), F.explode(tokenize(text_col)).alias("term"))


def top_terms(df: DataFrame, id_col: str, text_col: str, k: int) -> DataFrame:
    """The k most frequent terms over the corpus (ties: term ascending)."""
    p = postings(df, id_col, text_col)
    return p.groupBy("term").agg(F.count("*").alias("term_count")) \
        .orderBy(F.col("term_count").desc(), F.col("term").asc()).limit(k) \
        .withColumn("term_index", F.row_number().over(   # k rows after the limit
            Window.orderBy(F.col("term_count").desc(), F.col("term").asc())) - 1)


def term_counts(df: DataFrame, id_col: str, text_col: str, terms: DataFrame) -> DataFrame:
    """(id, term, tf) of the terms in a small vocabulary: one tokenisation pass,
    restricted before the (doc, term) shuffle and combined map-side."""
    p = postings(df, id_col, text_col).join(F.broadcast(terms.select("term")), "term", "left_semi")
    return p.groupBy("id", "term").agg(F.count("*").alias("tf"))


def tfidf(df: DataFrame, id_col: str, text_col: str, k: int = 300, vocab: DataFrame | None = None,
          idf: DataFrame | None = None, n_docs: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Long TF-IDF weights ``(id, term, term_index, weight)``, rows L2-normalised.

    tf = raw count, idf = ln((1 + n) / (1 + df)) + 1 (smooth idf). Returns the
    weights and the fitted vocabulary ``(term, term_index, idf)`` so new rows
    can be transformed with the same vocabulary.

    Fit counts the terms of the corpus, combined map-side, so only the distinct
    terms are shuffled; the top-k rows reach the driver. The (doc, term) counts
    of a second pass, restricted to the k-row vocabulary (broadcast, bounded by
    k) before their shuffle, are written once: document frequencies and weights
    both read them.
    """
    spark = df.sparkSession
    if idf is None:
        n = n_docs if n_docs is not None else df.count()
        v = (vocab if vocab is not None else top_terms(df, id_col, text_col, k)).select("term", "term_index").collect()
        tf = materialize(term_counts(df, id_col, text_col, spark.createDataFrame(v, "term string, term_index int")))
        got = {r["term"]: r["df"] for r in tf.groupBy("term").agg(F.count("*").alias("df")).collect()}
        rows = [(r["term"], r["term_index"], math.log((1.0 + n) / (1.0 + got.get(r["term"], 0))) + 1.0) for r in v]
        idf = spark.createDataFrame(rows, "term string, term_index int, idf double")
    else:
        tf = term_counts(df, id_col, text_col, idf)
    w = tf.join(F.broadcast(idf), "term").withColumn("raw", F.col("tf") * F.col("idf"))
    # per document at most k vocabulary entries: a bounded list, no self-join
    per_doc = w.groupBy("id").agg(
        F.collect_list(F.struct("term", "term_index", "raw")).alias("items"),
        F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    out = per_doc.select("id", "norm", F.explode("items").alias("it")).select(
        "id", "it.term", "it.term_index", (F.col("it.raw") / F.col("norm")).alias("weight"))
    return out, idf


def hashing_features(df: DataFrame, id_col: str, text_col: str, n_features: int = 300,
                     seed: int = 42) -> DataFrame:
    """Signed hashed term counts ``(id, bucket, weight)``, rows L2-normalised."""
    p = postings(df, id_col, text_col)
    b = F.pmod(F.xxhash64(F.lit(seed), F.col("term")), F.lit(n_features)).cast("int")
    sign = F.when(F.pmod(F.xxhash64(F.lit(seed + 1), F.col("term")), F.lit(2)) == 0, F.lit(1.0)).otherwise(F.lit(-1.0))
    v = p.groupBy("id", b.alias("bucket")).agg(F.sum(sign).alias("raw")).where(F.col("raw") != 0)
    # at most n_features buckets per document: a bounded list, and one pass over the tokens
    per_doc = v.groupBy("id").agg(F.collect_list(F.struct("bucket", "raw")).alias("items"), F.sqrt(F.sum(F.col("raw") * F.col("raw"))).alias("norm"))
    return per_doc.select("id", "norm", F.explode("items").alias("it")).select("id", "it.bucket", (F.col("it.raw") / F.col("norm")).alias("weight"))


def text_features(df: DataFrame, id_col: str, text_col: str, k: int,
                  mode: str = "tfidf") -> tuple[DataFrame, str]:
    """T4: (id, index, weight) from TF-IDF (``mode="tfidf"``) or hashing (``"hash"``)."""
    if mode not in ("tfidf", "hash"):
        raise ValueError(f"mode must be 'tfidf' or 'hash', not {mode!r}")
    if mode == "hash":
        h = hashing_features(df, id_col, text_col, k)
        return h.select("id", F.col("bucket").alias("index"), "weight"), mode
    t, _ = tfidf(df, id_col, text_col, k)
    return t.select("id", F.col("term_index").alias("index"), "weight"), mode


def densify(long_df: DataFrame, width: int, id_col: str = "id", out: str = "vec") -> DataFrame:
    """(id, index, weight) -> (id, array<double> of ``width``). Per id at most
    ``width`` entries are gathered, so the group size is bounded."""
    g = long_df.groupBy(id_col).agg(F.map_from_entries(F.collect_list(F.struct("index", "weight"))).alias("m"))
    return g.select(id_col, F.transform(F.sequence(F.lit(0), F.lit(width - 1)),
                                        lambda i: F.coalesce(F.element_at(F.col("m"), i), F.lit(0.0))).alias(out))


def prepare_features(df: DataFrame, id_col: str, text_col: str, summary_col: str, numeric_cols: list[str],
                     max_text_features: int = 300, max_summary_features: int = 100,
                     mode: str = "tfidf") -> DataFrame:
    """T5: [text features || summary features || numeric columns] as one array,
    NULL/NaN numerics imputed with their column mean (A2)."""
    from reviewlens.operators.prepare import mean_impute

    t, _ = text_features(df, id_col, text_col, max_text_features, mode)
    s, _ = text_features(df, id_col, summary_col, max_summary_features, mode)
    tv = densify(t, max_text_features, out="tv")
    sv = densify(s, max_summary_features, out="sv")
    num, _ = mean_impute(df.select(F.col(id_col).alias("id"), *numeric_cols), numeric_cols)
    zeros_t = F.array_repeat(F.lit(0.0), max_text_features)
    zeros_s = F.array_repeat(F.lit(0.0), max_summary_features)
    j = num.join(tv, "id", "left").join(sv, "id", "left")
    return j.select(F.col("id").alias(id_col), F.concat(
        F.coalesce("tv", zeros_t), F.coalesce("sv", zeros_s),
        F.array(*[F.col(c).cast("double") for c in numeric_cols])).alias("features"))
