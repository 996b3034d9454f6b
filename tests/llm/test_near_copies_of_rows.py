"""The near-copy stage judges every text by itself, whatever its id; its tables can be freed."""

import os

from reviewlens.llm import exact_dedup, jaccard_join
from reviewlens.session import drop_scratch_tables, scratch_path, scratch_scope
from tests.llm.helpers import docs, with_clashes

A = " ".join(f"word{i}" for i in range(60))
NEAR_A = A.replace("word59", "changed")
OTHER = " ".join(f"other{i}" for i in range(60))
NEAR_OTHER = OTHER + " end"


def kept(df):
    return sorted(((r["doc_id"], r["text"]) for r in jaccard_join.keep_one_per_component(df).collect()), key=str)


def test_unrelated_texts_of_a_repeated_id_stay(spark):
    assert kept(docs(spark, [(1, A), (2, NEAR_A), (2, OTHER)])) == [(1, A), (2, OTHER)]
    assert kept(docs(spark, [(2, A), (1, OTHER), (1, NEAR_A)])) == [(1, OTHER), (1, NEAR_A)]


def test_rows_without_an_id_are_linked_like_others(spark):
    assert kept(docs(spark, [(None, A), (None, OTHER), (None, NEAR_A), (7, NEAR_OTHER)])) in (
        [(7, NEAR_OTHER), (None, A)], [(7, NEAR_OTHER), (None, NEAR_A)])


def test_texts_without_words_and_equal_rows_stay(spark):
    rows = [(1, ""), (2, None), (2, " "), (3, A), (3, A), (4, NEAR_A)]
    assert [r for r in kept(with_clashes(docs(spark, rows))) if r[1] and r[1].strip()] == [(3, A), (3, A)]
    assert len(kept(docs(spark, rows))) == 5
    assert kept(docs(spark, [])) == []


def test_scratch_tables_are_freed(spark):
    base = os.path.dirname(scratch_path(spark, "x"))
    drop_scratch_tables(spark)
    df = docs(spark, [(1, A), (2, NEAR_A), (3, OTHER), (4, OTHER)])
    before = set(os.listdir(base)) if os.path.exists(base) else set()
    with scratch_scope(spark) as scope:
        rows = scope.keep(jaccard_join.keep_one_per_component(exact_dedup.drop_exact_duplicates(df)))
    assert rows.count() == 2
    drop_scratch_tables(spark)
    assert set(os.listdir(base)) == before
