import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.llm import components
from reviewlens.llm import jaccard_join as J
from tests.llm.helpers import docs, shingles, with_clashes


def brute(rows):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets if i is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for a in range(len(sets)):
        for b in range(a):
            (i, s), (j, t) = sets[a], sets[b]
            if i is None or j is None or not s or not t:
                continue
            if 100 * len(s & t) >= 75 * len(s | t) and find(i) != find(j):
                lo, hi = sorted((find(i), find(j)))
                parent[hi] = lo
    return sorted(((i, len(s), None if i is None else find(i)) for i, s in sets), key=repr)


def corpus(seed):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    rows, n = [], 0
    passage = rnd.choices(vocab, k=14)
    for g in range(14):
        base = rnd.choices(vocab, k=rnd.choice([6, 7, 9, 12, 30, 60, 90]))
        for c in range(rnd.choice([1, 2, 5, 30])):
            w = list(base)
            for _ in range(rnd.choice([0, 0, 1, 1, 2, 3])):
                k = rnd.randrange(len(w))
                w[k:k + 1] = rnd.choice([[], [rnd.choice(vocab)], [w[k], rnd.choice(vocab)]])
            if rnd.random() < 0.3:
                w += passage
            rows.append((n, " ".join(w).upper() if c % 2 else "\t".join(w)))
            n += 1
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n "), (n + 3, "one two"), (n + 4, "ONE  two"), (n + 5, "one"), (n + 6, "É a b c d e"),
                   (n + 7, "é a b c d e")]


@pytest.mark.parametrize("seed", [1, 2])
def test_components_match_brute_force(spark, seed):
    rows = corpus(seed)
    got = J.jaccard_components(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_star_rounds_change_nothing(spark, monkeypatch):
    """With every list long and every element rare, star rounds run and the result is the same."""
    monkeypatch.setattr(J, "LONG_LIST", 2)
    monkeypatch.setattr(J, "FREQUENT", 1 << 40)
    rnd = random.Random(5)
    base = [f"b{i}" for i in range(50)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rnd.randrange(4)):
            w[rnd.randrange(50)] = f"x{rnd.randrange(999)}"
        rows.append((i, " ".join(w)))
    rows += [(100 + i, " ".join(f"{i}_{j}" for j in range(30))) for i in range(20)]
    got = J.jaccard_components(with_clashes(docs(spark, rows))).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)


def test_repeated_and_null_ids(spark):
    a, b = "a b c d e f g h", "p q r s t u v w"
    rows = [(1, a), (1, b), (2, b), (3, a), (None, a), (4, "z z z z z z")]
    got = sorted((r["doc_id"] or 0, r["component_id"]) for r in J.jaccard_components(docs(spark, rows)).collect())
    assert got == [(0, None), (1, 1), (1, 1), (2, 1), (3, 1), (4, 4)]


@pytest.mark.parametrize("size", [8, 60])
def test_null_id_copy_before_a_valid_copy(spark, size):
    """Light and heavy sets: the first copy of a task has no id, the second is linked with a near copy."""
    a = [f"w{i}" for i in range(size)]
    near = " ".join(a + ["more"])
    rows = [(None, " ".join(a)), (7, " ".join(a)), (3, near), (9, "p q r s t u v w")]
    got = J.jaccard_components(docs(spark, rows).coalesce(1).sortWithinPartitions(F.col("doc_id").asc_nulls_first())).collect()
    assert sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in got) == [(0, 0), (3, 3), (7, 3), (9, 9)]


def test_empty_table_and_stage(spark):
    assert J.jaccard_components(docs(spark, [])).count() == 0
    rows = corpus(3)
    left = J.keep_one_per_component(docs(spark, rows))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, _, c in brute(rows)})


def test_need_and_boundary():
    for a in range(1, 40):
        for b in range(1, 40):
            k = J.need(a, b)
            assert 100 * k >= 75 * (a + b - k) and 100 * (k - 1) < 75 * (a + b - k + 1)
    assert J.choose_boundary({4: 100}, 1.0) < J.choose_boundary({4: 100, 8: 100}, 500.0)


def test_texts_that_share_single_shingles_make_no_pairs(spark, monkeypatch):
    made, cross = [], J._cross_pairs
    monkeypatch.setattr(J, "_cross_pairs", lambda *a: made.append(cross(*a).cache()) or made[-1])
    rnd = random.Random(9)
    phrases = [" ".join(f"p{i}_{j}" for j in range(5)) for i in range(40)]
    rows = [(i, " ".join(f"t{i}_{k} {p}" for k, p in enumerate(rnd.sample(phrases, 8)))) for i in range(60)]
    got = J.jaccard_components(docs(spark, rows)).collect()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["doc_id"])] == list(range(60))
    assert sum(df.count() for df in made) == 0


def test_linked_sets_share_keys_among_their_first_and_bitmaps_never_exceed_the_difference():
    rnd = np.random.default_rng(3)
    for _ in range(400):
        b = int(rnd.integers(4, 300))
        a = int(rnd.integers(J.min_partner(b), b + 1))
        k = J.need(a, b)
        if k > a or k == b:
            continue
        u = np.unique(rnd.integers(0, 1 << 63, a + b - k, dtype=np.uint64))
        rnd.shuffle(u)
        x, y = np.sort(u[:a]), np.sort(u[a - k:])
        keys = [list(zip(s[:-1].tolist(), s[1:].tolist())) for s in (x, y)]
        assert len(set(keys[0]) & set(keys[1])) >= J.shared_keys(a, b)
        assert set(keys[0][:J.prefix_keys(a)]) & set(keys[1][:J.prefix_keys(b)])
        long, short = J._parity(x, 16), J._parity(x, 8)
        assert (long[:8] ^ long[8:]).tolist() == short.tolist()
        assert sum(int(v).bit_count() for v in (short ^ J._parity(y, 8)).view(np.uint64)) <= a + b - 2 * k
    assert J.key_width() == 2 and J.key_width(50, 100) == 1


def test_a_group_around_one_text_makes_few_pairs(spark, monkeypatch):
    """Copies edited too far share most list keys and are no links: short bitmaps rule them out inside the join."""
    made, cross = [], J._cross_pairs
    monkeypatch.setattr(J, "_cross_pairs", lambda *a: made.append(cross(*a).cache()) or made[-1])
    rnd = random.Random(4)
    base = [f"b{i}" for i in range(400)]
    rows = []
    for i in range(24):
        w = list(base)
        for k in rnd.sample(range(400), 13):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    got = J.jaccard_components(docs(spark, rows)).collect()
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in got), key=repr) == brute(rows)
    assert sum(df.count() for df in made) <= 24


def test_a_pair_is_left_to_the_list_of_an_earlier_shared_key(spark):
    names = "token long, node long, n int, pos int, root long, top long, before array<long>, " + ", ".join(
        f"p{i} long" for i in range(J.COARSE_WORDS))
    lists = spark.createDataFrame([(t, x, 100, p, x, 0, before, *[0] * J.COARSE_WORDS) for t, x, p, before in
                                   [(10, 1, 5, [9]), (10, 2, 6, [9]), (10, 3, 6, [8]), (10, 4, 0, [])]], names)
    pairs = J._cross_pairs(lists, lists, "rx <> ry and (y < x or ry = top)", J.NUM, J.DEN)
    assert sorted(map(tuple, pairs.collect())) == [(1, 3), (1, 4), (2, 3), (2, 4), (3, 4)]


def test_components_drop_links_within_one_label(spark, monkeypatch):
    left, contracted = [], components._contracted
    monkeypatch.setattr(components, "_contracted", lambda *a: left.append((r := contracted(*a)).count()) or r)
    chain = [(i, i + 1) for i in range(100, 140)] + [(140, 30)]
    star = [(200, i) for i in range(201, 260)] + [(i, i + 1) for i in range(201, 259)]
    got = {r["node"]: r["root"] for r in components.connected_components(spark.createDataFrame(chain + star + [(5, 5)], "x long, y long")).collect()}
    assert got == {**{i: 30 for i in range(100, 141)}, 30: 30, **{i: 200 for i in range(200, 260)}}
    assert left[0] <= len(chain) and left[-1] == 0
