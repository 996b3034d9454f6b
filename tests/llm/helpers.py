"""Small frames with the shapes that every operator must take."""

import re

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs(spark, rows):
    """Rows (doc_id, text) as a documents table, over a few partitions."""
    full = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in rows]
    return spark.createDataFrame(full, DOCS).repartition(3)


def with_clashes(df):
    """The same rows with extra columns under names that operators use inside."""
    from pyspark.sql import functions as F
    extra = ["h", "n", "norm", "salt", "rn", "node", "token", "bucket", "score", "label", "w", "keep_id", "tie", "piece", "length"]
    return df.select("*", *[F.lit(1).alias(c) for c in extra])


def words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", low)


def shingles(text, k=5):
    w = words(text)
    if not w:
        return set()
    return {tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)}
