import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewlens.llm import packing as P
from tests.llm.helpers import docs, with_clashes

PATH = public_tokenizers.path("byte_bpe_50k.json")


def check_plan(histogram, plan, capacity):
    sequences, placed = defaultdict(list), defaultdict(list)
    for n, rank, count, first, offset in plan.rows:
        placed[n] += range(rank, rank + count)
        for i in range(count):
            sequences[first + i].append((offset, n))
    assert {n: sorted(r) for n, r in placed.items()} == {n: list(range(c)) for n, c in histogram.items() if c}
    for parts in sequences.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity
    assert len(sequences) == plan.sequences


@settings(max_examples=40, deadline=None)
@given(st.dictionaries(st.integers(1, 64), st.integers(0, 60), max_size=30))
def test_every_plan_is_a_packing(histogram):
    plan = P.make_plan(histogram, capacity=64, groups=6)
    check_plan(histogram, plan, 64)
    total = sum(n * c for n, c in histogram.items())
    assert -(-total // 64) <= plan.sequences


def test_plan_is_near_the_lower_bound():
    rng = np.random.default_rng(0)
    n, c = np.unique(np.minimum(rng.gamma(1.2, 600, 20_000).astype(int) + 1, 2048), return_counts=True)
    histogram = dict(zip(n.tolist(), c.tolist()))
    plan = P.make_plan(histogram)
    check_plan(histogram, plan, 2048)
    assert plan.sequences <= 1.005 * -(-int((n * c).sum()) // 2048)


def test_configurations_beat_best_fit():
    rng = np.random.default_rng(1)
    n, c = np.unique(rng.integers(600, 1100, 20_000), return_counts=True)
    histogram = dict(zip(n.tolist(), c.tolist()))
    plain = P.Plan(2048)
    P.best_fit(plain, histogram)
    assert P.make_plan(histogram).sequences < plain.sequences


def test_cut():
    assert P.cut(1, 4) == [(0, 1)] and P.cut(4, 4) == [(0, 4)] and P.cut(8, 4) == [(0, 4), (4, 4)]
    assert P.cut(9, 4) == [(0, 1), (1, 4), (5, 4)]


TEXTS = ["", None, "hello world", "<|endoftext|> x <|endoftext|", "  a\n\n b\t", "ÀÉ²½ 一二 ١٢ don't DON'T x's", "\u0000é😀", "word " * 3000, "a" * 5000]


@pytest.mark.parametrize("clash", [False, True])
def test_pieces_match_the_library(spark, clash):
    rows = list(enumerate(TEXTS)) + [(2, "hello world"), (None, "no id")]
    df = docs(spark, rows)
    got = P.pack_documents(with_clashes(df) if clash else df, PATH).collect()
    lib = Tokenizer.from_file(PATH)
    want = []
    for i, t in rows:
        ids = np.array(lib.encode(t or "", add_special_tokens=False).ids + [0], dtype="<u4")
        want += [(i, p, s, n, zlib.crc32(ids[s:s + n].tobytes())) for p, (s, n) in enumerate(P.cut(len(ids), 2048))]
    assert sorted((tuple(r)[:5] for r in got), key=repr) == sorted(want, key=repr)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in by.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048


def test_empty_table(spark):
    assert P.pack_documents(docs(spark, []), PATH).count() == 0
