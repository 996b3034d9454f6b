"""The text pipeline: quality, toxicity, exact copies, near copies, packing.

``STAGES`` lists (name, function). A function takes (spark, docs, sf_dir) and
returns a DataFrame; ``run`` writes every result as Parquet into the shared
folder and gives it, read again, to the next stage. Labels come from the
``labels`` table beside the documents. Every stage but the last returns the
columns of ``documents`` for the rows that it keeps.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from reviewlens.llm import exact_dedup, jaccard_join, packing, quality_rules, toxicity
from reviewlens.llm.common import materialize, prepare, read_table, without

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rejected(scores: DataFrame, predicted: int) -> DataFrame:
    return materialize(scores.filter(scores["predicted"] == predicted).select("doc_id", "text_hash").distinct())


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble predicts as label 1 stay. Each row is
    judged by its own text, also under a null or repeated doc_id."""
    scores = quality_rules.quality_scores(docs, read_table(spark, sf_dir, "labels"), hashed=True)
    return without(docs, _rejected(scores, 0), text_col="text").select(*COLUMNS)


def non_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents predicted as toxic go. Each row is judged by its own text, also
    under a null or repeated doc_id."""
    scores = toxicity.toxicity_scores(docs, read_table(spark, sf_dir, "labels"), hashed=True)
    return without(docs, _rejected(scores, 1), text_col="text").select(*COLUMNS)


def distinct_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every group of equal texts stays."""
    return exact_dedup.drop_exact_duplicates(docs).select(*COLUMNS)


def distinct_shingles(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest doc_id of every component of near copies stays."""
    return jaccard_join.keep_one_per_component(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token ids in sequences of 2048."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [("quality", quality), ("toxicity", non_toxic), ("exact_dedup", distinct_texts),
          ("jaccard_join", distinct_shingles), ("packing", packed)]

#: models, tokenising and packing have no SQL form; tests hold the stages against brute force
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir))
    return docs
