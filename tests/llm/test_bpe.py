import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from reviewlens.llm import bpe
from tests.llm.helpers import docs, with_clashes

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


def texts():
    rnd = random.Random(1)
    spans = [(32, 127), (0xA0, 0x250), (0x300, 0x600), (0x1E00, 0x2200), (0x4E00, 0x4F00), (0x1F300, 0x1F600)]
    fixed = ["", " ", "<|endoftext|>a<|startoftext|> B", "<|endoftext|", "ΌΣΟΣ İ ẞ ǅ", "DON'T I'LL x's", "a" * 300, "1234", "_a__b", "\x00\x1f\x85",
             "á é", "  　 x"]
    return fixed + ["".join(chr(rnd.randrange(*rnd.choice(spans))) for _ in range(rnd.randrange(50))) for _ in range(400)]


def test_encode_and_decode_match_the_library(library):
    own = bpe.WordBPE(PATH)
    for t in texts():
        ids = library.encode(t, add_special_tokens=False).ids
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == library.decode(ids, skip_special_tokens=False)
        n, a, b = own.digest(t)
        assert n == len(ids) and a == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert b == hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_cache_limit_changes_nothing(monkeypatch):
    whole = [bpe.WordBPE(PATH).encode(t) for t in texts()[:60]]
    monkeypatch.setattr(bpe, "CACHE_WORDS", 3)
    small = bpe.WordBPE(PATH)
    assert [small.encode(t) for t in texts()[:60]] == whole and len(small.cache) <= 3


def test_frames(spark, library):
    rows = [(1, "Hello  World"), (1, "Hello  World"), (None, "x"), (2, None), (3, ""), (4, "long " * 20_000)]
    df = with_clashes(docs(spark, rows))
    got = {(r["doc_id"], r["n_tokens"], r["ids_sha256"]) for r in bpe.encoding_digests(df, PATH).collect()}
    ids = {(i, tuple(library.encode(t or "", add_special_tokens=False).ids)) for i, t in rows}
    assert got == {(i, len(x), hashlib.sha256(" ".join(map(str, x)).encode()).hexdigest()) for i, x in ids}
    encoded = bpe.encode_documents(df, PATH)
    assert {(r["doc_id"], tuple(r["ids"])) for r in encoded.collect()} == ids
    decoded = {(r["doc_id"], r["text"]) for r in bpe.decode_documents(encoded, PATH).collect()}
    assert decoded == {(i, library.decode(list(x), skip_special_tokens=False)) for i, x in ids}
    assert bpe.encoding_digests(docs(spark, []), PATH).count() == 0
