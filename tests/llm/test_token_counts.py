import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewlens.llm import token_counts as T
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, with_clashes
from tests.llm.test_bpe import texts

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def brute(library, rows):
    out = []
    for i, t in rows:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        out.append((i, len((t or "").encode()), n, n > 2048))
    return sorted(out, key=str)


def run(df, **kw):
    return sorted(map(tuple, T.token_counts(df, PATH, **kw).collect()), key=str)


def test_pieces_add_up_to_the_library(library):
    for t in texts():
        found, special = T.pre_tokens(t, PATH)
        assert special + sum(n * T.count_pieces(w, PATH) for w, n in found.items()) == len(
            library.encode(t, add_special_tokens=False).ids), repr(t)


@pytest.mark.parametrize("head", [0, 5, T.HEAD_WORDS])
def test_head_size_changes_nothing(spark, library, head):
    rows = [(k, t) for k, t in enumerate(texts()[:80])] + [(1000, "the cat sat " * 50), (1001, "the dog")]
    assert run(docs(spark, rows), head_words=head, sample_rows=10) == brute(library, rows)


def test_documents_match_the_library(spark, library):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert run(df) == brute(library, rows)
    assert run(df.repartition(7), sample_rows=20, head_words=50) == brute(library, rows)


def test_limit_is_exclusive(spark):
    rows = [(1, "a " * 2048), (2, "a " * 2049)]
    assert [(r[2], r[3]) for r in run(docs(spark, rows))] == [(2048, False), (2049, True)]


def test_unusual_rows(spark, library):
    rows = [(None, None), (None, "x y"), (None, "x y"), (1, ""), (1, "a b"), (1, "c d e"), (2, "q" * 50_000), (3, "long words " * 30_000),
            (4, " \n\t "), (5, "<|endoftext|><|endoftext|> a")]
    assert run(with_clashes(docs(spark, rows))) == brute(library, rows)
    assert run(docs(spark, [])) == []
