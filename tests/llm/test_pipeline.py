"""Every stage on the rows of the one before, against brute force or its scores."""

import duckdb
import numpy as np
import pytest

import corpus_pipeline as C
from reviewlens.llm import quality_rules, toxicity
from reviewlens.llm.common import materialize
from tests.conftest import SF_SMALL
from tests.llm import test_exact_dedup, test_jaccard_join
from tests.llm.helpers import docs


@pytest.fixture(scope="module")
def stages(spark):
    frames = [spark.read.parquet(f"{SF_SMALL}/documents.parquet")]
    for _, f in C.STAGES:
        frames.append(materialize(f(spark, frames[-1], SF_SMALL)))
    return frames


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_filters_follow_their_scores(spark, stages):
    labels = spark.read.parquet(f"{SF_SMALL}/labels.parquet")
    good = quality_rules.quality_scores(stages[0], labels).filter("predicted = 1")
    assert ids(stages[1]) == ids(good)
    clean = toxicity.toxicity_scores(stages[1], labels).filter("predicted = 0")
    assert ids(stages[2]) == ids(clean)


def test_duplicates_go(stages):
    rows = [(r["doc_id"], r["text"]) for r in stages[2].collect()]
    assert ids(stages[3]) == sorted({k for _, k, _, _ in test_exact_dedup.brute(rows)})
    rows = [(r["doc_id"], r["text"]) for r in stages[3].collect()]
    assert ids(stages[4]) == sorted({c for _, _, c in test_jaccard_join.brute(rows)})


def test_columns_and_whole_rows(stages):
    source = {r["doc_id"]: tuple(r) for r in stages[0].collect()}
    for df in stages[1:5]:
        assert tuple(df.columns) == C.COLUMNS
        assert all(source[r["doc_id"]] == tuple(r) for r in df.collect())


def test_packing_holds_every_document(stages):
    con = duckdb.connect()
    packed = stages[5].toPandas()    # noqa: F841
    assert sorted(set(packed.doc_id)) == ids(stages[4])
    bad = con.sql("""SELECT count(*) FROM (SELECT sequence_id, "offset", coalesce(sum(length) OVER (PARTITION BY sequence_id ORDER BY "offset"
                     ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS want FROM packed) WHERE "offset" <> want""").fetchall()
    assert bad == [(0,)]
    assert con.sql("SELECT max(s) FROM (SELECT sum(length) AS s FROM packed GROUP BY sequence_id)").fetchall()[0][0] <= 2048


def test_stages_take_unusual_documents(spark):
    df = docs(spark, [(1, None), (2, ""), (3, "a b c d e f"), (3, "a b c d e f"), (None, "x"), (4, "A b c d e f")])
    for name, f in C.STAGES[:4]:
        df = materialize(f(spark, df, SF_SMALL))
        assert tuple(df.columns) == C.COLUMNS, name
    assert C.STAGES[4][1](spark, df, SF_SMALL).count() >= 0
    empty = docs(spark, [])
    for _, f in C.STAGES:
        assert f(spark, empty, SF_SMALL).count() == 0


def test_filters_judge_rows_of_one_id_apart(spark, monkeypatch):
    """A null or repeated id takes only its rejected texts with it."""
    bad = "badword of many words that stand here in a row"
    buckets, _, _ = toxicity.step_ngrams(np.frombuffer(b"badword", np.uint8), np.array([0, 7]))
    weight = np.zeros(1 << toxicity.BUCKET_BITS, np.float32)
    weight[buckets] = 1000
    monkeypatch.setattr(toxicity, "fit_toxicity", lambda *a, **k: toxicity.ToxicityModel(weight, -5.0))
    long = quality_rules.RuleModel(rules=[((quality_rules.NAMES.index("n_words"), False, 5.0),)], weights=[-10.0], intercept=5.0)
    monkeypatch.setattr(quality_rules, "fit_quality", lambda *a, **k: long)
    rows = [(None, "good a"), (None, bad), (None, None), (1, "good a"), (1, bad), (1, "good c"), (2, bad), (3, "good a")]
    want = sorted((i or 0, t or "") for i, t in rows if t != bad)
    for stage in (C.quality, C.non_toxic):
        left = stage(spark, docs(spark, rows), SF_SMALL).collect()
        assert sorted((r["doc_id"] or 0, r["text"] or "") for r in left) == want
