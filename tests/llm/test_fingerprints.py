import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from reviewlens.llm import fingerprints as P
from tests.llm.helpers import docs, with_clashes, words


def weights(text, k=5):
    w = words(text)
    return Counter(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else Counter([tuple(w)] if w else [])


def test_likeness_estimates_the_generalised_jaccard_similarity():
    rnd = random.Random(3)
    errors = []
    for _ in range(120):
        a = [f"w{rnd.randrange(30)}" for _ in range(rnd.randrange(5, 200))]
        b = a[:rnd.randrange(len(a) + 1)] * rnd.choice([1, 1, 2]) + [f"v{rnd.randrange(30)}" for _ in range(rnd.randrange(60))]
        ta, tb = " ".join(a), " ".join(b)
        x, y = weights(ta), weights(tb)
        want = sum((x & y).values()) / sum((x | y).values()) if x or y else 1.0
        sa, sb = P.signatures([ta, tb])
        errors.append(P.likeness(sa, sb) - want)
    assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 0.05


def test_blocks_of_a_long_text_change_nothing(monkeypatch):
    text = " ".join(f"w{i % 700}" for i in range(3000))
    whole = P.signatures([text])[0]
    monkeypatch.setattr(P, "BLOCK", 37)
    assert (P.signatures([text])[0] == whole).all()


def brute(rows):
    order = sorted(rows, key=lambda r: r[0], reverse=True)
    out = {}
    for k, (i, t) in enumerate(order):
        t, nxt = t or "", order[(k + 1) % len(order)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        s, se, sn = P.signatures([t, e, nxt])
        out[i] = (len(t), hashlib.sha256(e.encode()).hexdigest(), P.as_text(s), P.as_text(se), P.likeness(s, se), P.likeness(s, sn))
    return out


@pytest.mark.parametrize("n", [1, 2, 150])
def test_edited_texts_over_range_borders(spark, n):
    rnd = random.Random(n)
    rows = [(i * 7 - 20, rnd.choice([None, "", "x", "É 日本 😀 a b c d", " ".join(rnd.choices("abcdefgh", k=rnd.randrange(60)))])) for i in range(n)]
    got = P.edited_fingerprints(with_clashes(docs(spark, rows))).collect()
    assert {r["doc_id"]: tuple(r)[1:] for r in got} == brute(rows) and len(got) == n


def test_repeated_and_null_ids_lose_no_row(spark):
    rows = [(1, "a b c d e f")] * 3 + [(None, "x y z")] * 2 + [(5, "k"), (5, "l l l")]
    got = P.edited_fingerprints(docs(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0, 0, 1, 1, 1, 5, 5]
    assert P.edited_fingerprints(docs(spark, [])).count() == 0


def test_equal_texts_have_equal_fingerprints(spark):
    got = P.fingerprint_documents(docs(spark, [(1, "a b c d e f g"), (2, "a b c d e f g"), (3, None), (4, "")])).collect()
    f = {r["doc_id"]: r["fingerprint"] for r in got}
    assert f[1] == f[2] and set(f[3]) == set(f[4]) == {"0"} and f[1] != f[3]
