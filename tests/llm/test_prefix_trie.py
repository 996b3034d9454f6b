import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import prefix_trie as P
from tests.conftest import SF_SMALL
from tests.llm.helpers import with_clashes

SCHEMA = "conv_id long, turn long, role string, text string"


def frame(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute(rows):
    """The contract, conversation by conversation and node by node."""
    own = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            text = text or ""
            own[c].append((t is not None, t or 0, role or "", hashlib.sha256(text.encode()).hexdigest(), text))
    own = {c: [(t[2], t[4]) for t in sorted(ts)] for c, ts in own.items()}
    nodes, ends = defaultdict(list), defaultdict(list)
    for c in own:
        h = zlib.crc32(str(c).encode()) % 4
        seq = own.get(c - (abs(c) % 20) * (1 if c >= 0 else -1), [])[:h] + own[c][h:]
        for d in range(len(seq) + 1):
            nodes[tuple(seq[:d])].append(c)
        ends[tuple(seq)].append(c)
    children, leaves, saved = defaultdict(int), defaultdict(int), defaultdict(int)
    for n in nodes:
        if n:
            children[n[:-1]] += 1
    for n, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", n[-1][1])) if n else 0
        for d in range(len(n) + 1):
            leaves[n[:d]] += children[n] == 0
            saved[n[:d]] += (len(members) - 1) * words
    return sorted((min(m), len(n), min(nodes[n[:-1]]) if n else None, len(m), children[n], leaves[n], saved[n],
                   hashlib.sha256(",".join(map(str, sorted(ends[n]))).encode()).hexdigest()) for n, m in nodes.items())


def run(df):
    return sorted(map(tuple, P.prefix_trie(df).collect()))


def test_conversations_against_brute_force(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    assert run(df) == brute([tuple(r) for r in df.select("conv_id", "turn", "role", "text").collect()])


@pytest.mark.parametrize("seed", range(4))
def test_shared_openings_of_every_length(spark, seed):
    rnd = random.Random(seed)
    rows = []
    for c in rnd.sample(range(200), 60):
        for t in range(rnd.randrange(14)):
            rows.append((c, t, rnd.choice("ab"), rnd.choice(["x", "x y"]) if rnd.random() < 0.25 else "same words here"))
    assert run(frame(spark, rows)) == brute(rows)


@pytest.mark.parametrize("block", [1, 2, 7])
def test_block_length_changes_nothing(spark, block, monkeypatch):
    rows = [(c, t, "r", "a" if t < c % 11 else f"b{c % 3}") for c in range(30) for t in range(c % 13)]
    monkeypatch.setattr(P, "BLOCK", block)
    assert run(frame(spark, rows)) == brute(rows)


def test_unusual_rows(spark):
    rows = [(None, 0, "a", "b"), (1, None, None, None), (1, 0, "", ""), (1, 0, "", ""), (1, 0, "z", "t"), (1, 0, "a", "t"),
            (-21, 5, "a", "b c"), (-20, 1, "a", "b c"), (7, -1, "a", " \n "), (8, 1, "q", "w " * 50_000)]
    assert run(with_clashes(frame(spark, rows))) == brute(rows)
    assert run(frame(spark, [])) == []
    assert run(frame(spark, [(None, 1, "a", "b")])) == []


def test_conversations_without_turns_are_members_of_the_root(spark):
    # all turns of a conversation are replaced and the lender is absent
    bare = [c for c in range(1, 400) if c % 20 and zlib.crc32(str(c).encode()) % 4 == 3][:5]
    rows = [(c, 0, "a", "b") for c in bare]
    assert run(frame(spark, rows)) == brute(rows)
    assert run(frame(spark, rows)) == [(min(bare), 0, None, 5, 0, 1, 0, hashlib.sha256(",".join(map(str, bare)).encode()).hexdigest())]


def test_long_conversation_and_many_copies(spark, monkeypatch):
    monkeypatch.setattr(P, "IDS_PER_ROW", 7)
    rows = [(20, t, "r", f"t{t % 5}") for t in range(150)] + [(20 * c, t, "r", "same") for c in range(2, 120) for t in range(3)]
    assert run(frame(spark, rows)) == brute(rows)


def test_subtree_sums(spark):
    # a chain under the root and one branch
    df = spark.createDataFrame([(0, 0, None, 1), (0, 1, 0, 10), (0, 2, 0, 100), (0, 3, 0, 1000), (5, 2, 0, 7)],
                               "conv_id long, depth long, parent_conv_id long, v long")
    got = {(r["conv_id"], r["depth"]): r["v"] for r in P.subtree_sums(df, ["v"]).collect()}
    assert got == {(0, 0): 1118, (0, 1): 1117, (0, 2): 1100, (0, 3): 1000, (5, 2): 7}


def test_texts_are_not_shuffled(spark):
    df = spark.read.parquet(f"{SF_SMALL}/conversations.parquet")
    turns = P.ordered_turns(df)
    plan = turns._jdf.queryExecution().executedPlan().toString()
    assert "text" not in plan.split("Exchange")[0]
    assert turns.filter(F.length("content") != 32).isEmpty()
