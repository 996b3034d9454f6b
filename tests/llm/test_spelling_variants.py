import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from reviewlens.llm import spelling_variants as S
from tests.conftest import SF_SMALL
from tests.llm.helpers import docs, with_clashes


def is_near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1:] == a for i in range(len(b)))


def counted(rows):
    n = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            n[run if h % 31 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
    return {w: k for w, k in n.items() if len(w) >= 7 and k >= 2}


def brute(rows):
    n = counted(rows)
    near = {w: [] for w in n}
    words = sorted(n)
    # words that share what is left after one deletion, or are one of these
    shapes = {}
    for w in words:
        for s in {w} | {w[:i] + w[i + 1:] for i in range(len(w))}:
            shapes.setdefault(s, []).append(w)
    for group in shapes.values():
        for a in group:
            near[a] += [b for b in group if b not in near[a] and is_near(a, b)]
    form = {}
    for w in words:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = []
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def run(df, **kw):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in S.spelling_variants(df, **kw).collect())


def corpus(seed, size=400, letters="abé"):
    """Words of few letters, hence many near ones, with frequencies over three powers of ten."""
    rnd = random.Random(seed)
    words = ["".join(rnd.choice(letters) for _ in range(rnd.randrange(6, 12))) for _ in range(size)]
    rows = []
    for k, w in enumerate(words):
        rows += [(k, (w + " ") * rnd.choice([1, 2, 3, 30, 400]))]
    return rows


@pytest.mark.parametrize("seed", range(2))
def test_dense_vocabulary_against_brute_force(spark, seed):
    rows = corpus(seed)
    assert run(docs(spark, rows)) == brute(rows)


@pytest.mark.parametrize("block_words", [3, 50])
def test_cut_blocks_change_nothing(spark, block_words):
    rows = corpus(5, 250, "ab")
    assert run(docs(spark, rows), block_words=block_words) == brute(rows)


def test_documents_against_brute_force(spark):
    df = spark.read.parquet(f"{SF_SMALL}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]
    assert run(df) == brute(rows)


def test_near_words_of_one_block():
    words = ["aaaaaaa", "aaaaaab", "aaaaaaaa", "abaaaaa", "baaaaaa", "aaaaaba"]
    for third in range(3):
        i, j = S.near_pairs(words, np.zeros(6, int), np.zeros(6, int), 7, np.full(6, third))
        for a, b in zip(i, j):
            assert is_near(words[a], words[b])
    every = set()
    for third in range(3):
        i, j = S.near_pairs(words, np.zeros(6, int), np.zeros(6, int), 7, np.full(6, third))
        pairs = [tuple(sorted((words[a], words[b]))) for a, b in zip(i, j)]
        assert not every & set(pairs) and len(pairs) == len(set(pairs))     # each pair in one block
        every |= set(pairs)
    assert every == {tuple(sorted((a, b))) for a in words for b in words if a < b and is_near(a, b) and 7 in (len(a), len(b))}


def test_chains_and_ties(spark):
    rows = [(None, "spelling " * 2000), (None, "spellinga " * 150), (None, "spellingab " * 12), (None, "spellingabc"),
            (None, "variants " * 100), (None, "variantz " * 100), (None, "variantx " * 5), (None, "Variantx")]
    got = {r[0]: r for r in run(docs(spark, rows))}
    assert got == {r[0]: r for r in brute(rows)}
    assert got["spellingab"][1:3] == ("spellinga", "spelling")
    assert got["variantx"][1] == "variants"                                   # a tie: the smaller word
    assert got["variants"][1] is None


def test_unusual_rows(spark):
    rows = [(None, None), (1, ""), (1, "short words"), (2, "repeated repeated"), (2, "repeated repeated"), (3, "ÀÉÎõüßÿ ÀÉÎõüßÿ àÉÎõüßÿ àÉÎõüßÿ"),
            (4, "x" * 20_000 + " " + "x" * 20_000), (5, "x" * 20_001 + " " + "x" * 20_001), (6, "many words " * 20_000), (7, "×÷×÷×÷×÷ ×÷×÷×÷×÷")]
    assert run(with_clashes(docs(spark, rows))) == brute(rows)
    assert run(docs(spark, [])) == [] and run(docs(spark, [(1, None)])) == []


def test_a_form_of_very_many(spark):
    rows = [(None, "abcdefgh " * 500)] + [(k, f"abcdefg{chr(0xC0 + k)} " * 2) for k in range(64)]
    assert run(docs(spark, rows), block_words=10) == brute(rows)
