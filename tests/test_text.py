"""Text features on inline fixtures."""
import math

from reviewlens.operators import text as TX


def test_tokenize_unicode_and_short(spark):
    df = spark.createDataFrame([(1, "Café déjà-vu a I 42 x_y 🙂 ÉTÉ")], "doc_id long, text string")
    toks = df.select(TX.tokenize("text").alias("t")).first()["t"]
    assert toks == ["café", "déjà", "vu", "42", "x_y", "été"]


def test_tfidf_zero_row_and_values(spark):
    df = spark.createDataFrame([(1, "apple apple pear"), (2, "pear plum"), (3, "zz")], "doc_id long, text string")
    w, idf = TX.tfidf(df, "doc_id", "text", k=3)
    vocab = {r["term"] for r in idf.collect()}
    assert vocab == {"apple", "pear", "plum"}      # 'zz' is tied last and sorts after
    got = {(r["id"], r["term"]): r["weight"] for r in w.collect()}
    assert not any(k[0] == 3 for k in got)            # no vocabulary term -> zero row
    idf_apple = math.log(4 / 2) + 1
    idf_pear = math.log(4 / 3) + 1
    a, p = 2 * idf_apple, idf_pear
    n = math.sqrt(a * a + p * p)
    assert abs(got[(1, "apple")] - a / n) < 1e-12 and abs(got[(1, "pear")] - p / n) < 1e-12


def test_hashing_rows_unit_norm(spark):
    df = spark.createDataFrame([(1, "a bb cc dd bb"), (2, "ee ff")], "doc_id long, text string")
    h = TX.hashing_features(df, "doc_id", "text", 16)
    for r in h.groupBy("id").agg({"weight": "collect_list"}).collect():
        assert abs(sum(x * x for x in r[1]) - 1.0) < 1e-12


def test_tfidf_counts_a_corpus_once_for_idf_and_weights(spark):
    """The weights read the counts that the document frequencies came from; repeated ids are one document."""
    import math

    from reviewlens.operators.text import tfidf
    df = spark.createDataFrame([(1, "aa bb aa"), (1, "bb cc"), (2, "aa dd"), (3, None), (None, "cc cc cc")], "doc_id long, text string")
    w, idf = tfidf(df, "doc_id", "text", 3)
    assert "regexp_extract_all" not in w._jdf.queryExecution().toString()
    got = {r["term"]: r["idf"] for r in idf.collect()}
    n = lambda d: math.log(6 / (1 + d)) + 1     # noqa: E731
    assert got == {"aa": n(2), "bb": n(1), "cc": n(2)}
    a, b, c = 2 * n(2), 2 * n(1), n(2)
    norm = math.sqrt(a * a + b * b + c * c)
    found = {(r["id"], r["term"]): r["weight"] for r in w.collect()}
    assert found.keys() == {(1, "aa"), (1, "bb"), (1, "cc"), (2, "aa"), (None, "cc")}
    assert abs(found[1, "bb"] - b / norm) < 1e-12 and found[None, "cc"] == 1.0
