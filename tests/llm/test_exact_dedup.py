import hashlib
import re

import pytest

from reviewlens.llm.exact_dedup import dedup_groups, drop_exact_duplicates, hot_texts
from tests.llm.helpers import docs, with_clashes


def brute(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0))
    out = []
    for i, t in rows:
        norm = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        keep = min(groups[norm])
        out.append((i, None if keep[1] else keep[2], len(groups[norm]), hashlib.sha256(norm.encode()).hexdigest()))
    return sorted(out, key=repr)


ROWS = ([(1, "a b c"), (2, "abc"), (3, " a\tb\nc\x0b"), (4, None), (5, ""), (6, " \r\n"), (7, "a bc"), (8, "é 日本"), (9, "é日本")]
        + [(100 + i, "hot  text" if i % 3 else "hottext") for i in range(400)] + [(1000 + i, f"own text {i}") for i in range(50)])


@pytest.mark.parametrize("clash", [False, True])
def test_groups_match_brute_force(spark, clash):
    df = docs(spark, ROWS)
    got = dedup_groups(with_clashes(df) if clash else df, partitions=5).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(ROWS)
    assert all(r["kept"] == (r["doc_id"] == r["keep_id"]) for r in got)


def test_repeated_rows_and_null_ids_keep_exactly_one(spark):
    rows = [(1, "x y")] * 3 + [(None, "x  y")] + [(None, "z")] * 2
    got = dedup_groups(docs(spark, rows)).collect()
    kept = [r for r in got if r["kept"]]
    assert len(got) == 6 and sorted(r["text_sha256"] for r in kept) == sorted({r["text_sha256"] for r in got})
    assert {r["group_size"] for r in got} == {4, 2}
    left = drop_exact_duplicates(docs(spark, rows)).collect()
    assert sorted((r["text"] for r in left)) == ["x  y", "z"]


def test_empty_table(spark):
    assert dedup_groups(docs(spark, [])).count() == 0
    assert drop_exact_duplicates(docs(spark, [])).count() == 0


def test_drop_keeps_whole_rows(spark):
    left = drop_exact_duplicates(docs(spark, ROWS))
    assert left.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({k for _, k, _, _ in brute(ROWS)})


def test_many_equal_rows_without_id_spread_over_all_salts(spark, monkeypatch):
    from pyspark.sql import functions as F
    from reviewlens.llm import exact_dedup as X
    n = 100_000
    df = spark.range(n).select(F.lit(None).cast("long").alias("doc_id"), F.lit("one text").alias("text")).union(
        spark.range(500).select("id", F.concat(F.lit("own "), "id")))
    seen = []
    keep = X.materialize

    def watch(frame):
        out = keep(frame)
        seen.append(out)
        return out
    monkeypatch.setattr(X, "materialize", watch)
    got = dedup_groups(df, partitions=8)
    assert got.count() == n + 500 and got.filter("kept").count() == 501
    assert {(r["group_size"], r["keep_id"]) for r in got.filter("doc_id is null").distinct().collect()} == {(n, None)}
    sizes = [r["count"] for r in seen[-1].filter("salt >= 0").groupBy("salt").count().collect()]
    salts = -(-n // ((n + 500) // 32))
    assert len(sizes) == salts and max(sizes) < 2 * n / salts


def test_long_texts_and_common_starts(spark):
    long = "same start " * 30_000
    rows = [(i, long + str(i % 3)) for i in range(9)] + [(20, long + " 1 "), (21, long + "2x")]
    got = dedup_groups(docs(spark, rows), partitions=3).collect()
    assert sorted(((r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=repr) == brute(rows)


def test_hot_texts_are_bounded(spark):
    rows = spark.range(4_000).selectExpr("id % 20 as tail")
    assert hot_texts(rows, 2).count() == 0 and hot_texts(rows, 16).count() == 20
