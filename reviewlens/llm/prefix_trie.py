"""Conversation prefix trie: shared openings of conversations as a table of nodes.

Every distinct sequence of first turns is a node. The digest of a sequence is
the exclusive-or of one 128-bit hash per turn, taken over the turn's place and
the SHA-256 of its role and text, so digests of prefixes are running
aggregates and need no pass from turn to turn.

Conversations are first grouped by the digests of successive blocks of
``BLOCK`` turns. Where all members of a block group go on with one and the
same next block, the turns inside it form a chain with the same members, and
the nodes are read off it. Only where the next blocks differ (or are shorter)
are turn boundaries refined, from one copy of every distinct block.

Sums over subtrees are taken by doubling: a node's sum over descendants nearer
than ``2^k`` levels goes to its ancestor ``2^k`` levels up, so the rounds are
the logarithm of the depth, whatever the length of a conversation.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free, materialize, prepare, shuffle_partitions

#: turns per block
BLOCK = 4
#: conversations that may lend a turn: one in so many
SOURCE_STEP = 20
#: most turns that a conversation borrows, plus one
HEADS = 4
#: members written per row while their ids are joined
IDS_PER_ROW = 4096

_WORDS = r"[^\x20\x09-\x0D]+"
_NODE = ("conv_id", "depth")


def _text(name: str) -> Column:
    return F.coalesce(F.col(f"`{name}`").cast("string"), F.lit(""))


def ordered_turns(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                  text_col: str = "text") -> DataFrame:
    """(conv_id, pos, content, words): every turn at its place from 0.

    Rows without a conv_id belong to no conversation and are left out. Turns
    are ordered by ``turn``, null first; equal ones by role and then by the
    SHA-256 of the text, so that the order is the same on every run.
    """
    role, text = _text(role_col), _text(text_col)
    turns = df.select(F.col(f"`{conv_col}`").cast("long").alias("conv_id"), F.col(f"`{turn_col}`").cast("long").alias("turn"),
                      role.alias("role"), F.sha2(text, 256).alias("sha"),
                      F.regexp_count(text, F.lit(_WORDS)).cast("long").alias("words")).filter("conv_id is not null")
    place = Window.partitionBy("conv_id").orderBy(F.asc_nulls_first("turn"), "role", "sha")
    return turns.select("conv_id", (F.row_number().over(place) - 1).cast("long").alias("pos"),
                        F.unhex(F.sha2(F.concat_ws(" ", "sha", "role"), 256)).alias("content"), "words")


def rebuilt_turns(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, n) with their number of turns, and their turns,
    the first of which come from the conversation that lends them.

    Conversation c takes the first h turns of c - c % 20, h = crc32(c) % 4, and
    goes on with its own turns after its first h.
    """
    own = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    source = F.col("conv_id") - F.col("conv_id") % SOURCE_STEP
    convs = own.select("conv_id", "own", source.alias("source"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).alias("h"))
    lent = own.select(F.col("conv_id").alias("source"), F.col("own").alias("there"))
    convs = materialize(convs.join(lent, "source", "left")
                        .withColumn("taken", F.least("h", F.coalesce("there", F.lit(0)))))
    heads = (turns.filter((F.col("pos") < HEADS - 1) & (F.col("conv_id") % SOURCE_STEP == 0))
             .withColumnRenamed("conv_id", "source"))
    first = convs.select("conv_id", "source", "h").join(heads, "source").filter("pos < h").select("conv_id", "pos", "content", "words")
    rest = (turns.join(convs.select("conv_id", "h", "taken"), "conv_id").filter("pos >= h")
            .select("conv_id", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "content", "words"))
    n = F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))
    return convs.select("conv_id", n.alias("n")), first.unionByName(rest)


def _block_groups(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct blocks in their context, and the block that each conversation ends in.

    groups: (start, p1, p2, d1, d2, n_convs, conv_id, turns): the block from
    turn ``start`` on, digests of the sequence before and after it, its members,
    the smallest of them, and one copy of its turns. ends: (conv_id, d1, d2).
    """
    hashed = turns.select("conv_id", "pos", F.xxhash64("pos", "content").alias("h1"),
                          F.xxhash64("content", F.lit(1), "pos").alias("h2"), "words")
    block = F.floor(F.col("pos") / BLOCK).alias("block")
    blocks = hashed.groupBy("conv_id", block).agg(
        F.bit_xor("h1").alias("x1"), F.bit_xor("h2").alias("x2"),
        F.sort_array(F.collect_list(F.struct("pos", "h1", "h2", "words"))).alias("turns"))
    upto = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    blocks = materialize(blocks.select("conv_id", (F.col("block") * BLOCK).alias("start"), "x1", "x2", "turns",
                                       F.bit_xor("x1").over(upto).alias("d1"), F.bit_xor("x2").over(upto).alias("d2")))
    before = [F.col("d1").bitwiseXOR(F.col("x1")).alias("p1"), F.col("d2").bitwiseXOR(F.col("x2")).alias("p2")]
    groups = blocks.select("start", *before, "d1", "d2", "conv_id", "turns").groupBy("start", "p1", "p2", "d1", "d2").agg(
        F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.any_value("turns").alias("turns"))
    ends = blocks.groupBy("conv_id").agg(F.max_by(F.struct("d1", "d2"), "start").alias("e")).select("conv_id", "e.d1", "e.d2")
    return materialize(groups), ends


def _turn_nodes(groups: DataFrame) -> DataFrame:
    """(depth, p1, p2, d1, d2, n_convs, conv_id, words): one row per node but the root."""
    parents = groups.groupBy("start", "p1", "p2").agg(F.count("*").alias("nexts"))
    groups = groups.join(parents, ["start", "p1", "p2"])
    running = F.expr("""transform(turns, (t, i) -> named_struct('depth', t.pos + 1, 'words', t.words,
        'x1', aggregate(slice(turns, 1, i + 1), p1, (a, u) -> a ^ u.h1), 'x2', aggregate(slice(turns, 1, i + 1), p2, (a, u) -> a ^ u.h2),
        'h1', t.h1, 'h2', t.h2))""")
    turns = groups.select("nexts", "n_convs", "conv_id", F.explode(running).alias("t")).select(
        "nexts", F.col("t.depth").alias("depth"), F.col("t.x1").bitwiseXOR(F.col("t.h1")).alias("p1"),
        F.col("t.x2").bitwiseXOR(F.col("t.h2")).alias("p2"), F.col("t.x1").alias("d1"), F.col("t.x2").alias("d2"),
        "n_convs", "conv_id", F.col("t.words").alias("words"))
    # one next block: its turns are nodes as they stand; several: those that share a boundary are one node
    chains = turns.filter("nexts = 1").drop("nexts")
    split = (turns.filter("nexts > 1").groupBy("depth", "p1", "p2", "d1", "d2")
             .agg(F.sum("n_convs").alias("n_convs"), F.min("conv_id").alias("conv_id"), F.max("words").alias("words")))
    return chains.unionByName(split)


def subtree_sums(nodes: DataFrame, values: list[str]) -> DataFrame:
    """``nodes`` (conv_id, depth, parent_conv_id, values) with every value summed
    over the node's subtree, itself included; (conv_id, depth) and the values."""
    up = nodes.select(*_NODE, F.col("parent_conv_id").alias("up_id"), (F.col("depth") - 1).alias("up_depth"), *values)
    state, step = materialize(up), 1
    while not state.filter("up_id is not null").isEmpty():
        lower = state.filter("up_id is not null")
        gained = lower.groupBy(F.col("up_id").alias("conv_id"), F.col("up_depth").alias("depth")).agg(
            *[F.sum(v).alias(f"more_{v}") for v in values])
        over = state.select(F.col("conv_id").alias("up_id"), F.col("depth").alias("up_depth"), F.col("up_id").alias("next_id"))
        jumped = lower.join(over, ["up_id", "up_depth"]).select(*_NODE, "next_id", (F.col("up_depth") - step).alias("next_depth"))
        new = materialize(state.drop("up_id", "up_depth").join(gained, list(_NODE), "left").join(jumped, list(_NODE), "left").select(
            *_NODE, F.col("next_id").alias("up_id"), F.col("next_depth").alias("up_depth"),
            *[(F.col(v) + F.coalesce(f"more_{v}", F.lit(0))).alias(v) for v in values]))
        free(state)
        state, step = new, 2 * step
    return state.select(*_NODE, *values)


def _ends_digests(ends: DataFrame) -> DataFrame:
    """(d1, d2, ends_sha256) of the members that end at each node.

    Their ids are sorted over range partitions and written as rows of many ids;
    one task then feeds the rows of a node to the hash, one after the other, so
    a node with any number of members takes the memory of one row.
    """
    key = ["d1", "d2"]

    def texts(batches: Iterator[pa.RecordBatch]):
        node, first, ids = None, None, []

        def row():
            return pa.record_batch([pa.array([x], pa.int64()) for x in (*node, first)] + [pa.array([",".join(map(str, ids))], pa.string())],
                                   names=["d1", "d2", "first", "ids"])
        for batch in batches:
            for d1, d2, conv in zip(*[c.to_pylist() for c in batch.columns]):
                if (d1, d2) != node or len(ids) == IDS_PER_ROW:
                    if ids:
                        yield row()
                    node, first, ids = (d1, d2), conv, []
                ids.append(conv)
        if ids:
            yield row()

    def digests(batches: Iterator[pa.RecordBatch]):
        node, state = None, None

        def row():
            return pa.record_batch([pa.array([node[0]], pa.int64()), pa.array([node[1]], pa.int64()), pa.array([state.hexdigest()], pa.string())],
                                   names=["d1", "d2", "ends_sha256"])
        for batch in batches:
            for d1, d2, _, ids in zip(*[c.to_pylist() for c in batch.columns]):
                if (d1, d2) != node:
                    if node is not None:
                        yield row()
                    node, state = (d1, d2), hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
        if node is not None:
            yield row()
    parts = shuffle_partitions(ends.sparkSession)
    rows = (ends.select(*key, "conv_id").repartitionByRange(parts, *key, "conv_id").sortWithinPartitions(*key, "conv_id")
            .mapInArrow(texts, "d1 long, d2 long, first long, ids string"))
    return (rows.repartition(parts, *key).sortWithinPartitions(*key, "first")
            .mapInArrow(digests, "d1 long, d2 long, ends_sha256 string"))


def prefix_trie(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                text_col: str = "text") -> DataFrame:
    """One row per node: conv_id (its smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    A null role or text is empty; a null turn comes first; rows of one turn are
    ordered by role and the SHA-256 of the text, and repeated rows are turns of
    their own. Rows without a conv_id are left out. A conversation of any
    length and texts of any length count whole; texts are read once and never
    shuffled. A table without conversations gives no node, not even the root;
    other columns, whatever their names, are ignored.
    """
    prepare(df.sparkSession)
    turns = materialize(ordered_turns(df, conv_col, turn_col, role_col, text_col))
    convs, rebuilt = rebuilt_turns(turns)
    groups, ends = _block_groups(rebuilt)
    root = convs.agg(F.count("*").alias("n_convs"), F.min("conv_id").alias("conv_id")).filter("n_convs > 0").select(
        F.lit(0).cast("long").alias("depth"), F.lit(None).cast("long").alias("p1"), F.lit(None).cast("long").alias("p2"),
        F.lit(0).cast("long").alias("d1"), F.lit(0).cast("long").alias("d2"), "n_convs", "conv_id", F.lit(0).cast("long").alias("words"))
    found = materialize(_turn_nodes(groups).unionByName(root))
    # every conversation ends at a node; those without turns at the root
    ends = convs.join(ends, "conv_id", "left").select("conv_id", F.coalesce("d1", F.lit(0)).alias("d1"), F.coalesce("d2", F.lit(0)).alias("d2"))
    parent = found.select(F.col("d1").alias("p1"), F.col("d2").alias("p2"), F.col("conv_id").alias("parent_conv_id"))
    children = found.filter("p1 is not null").groupBy(F.col("p1").alias("d1"), F.col("p2").alias("d2")).agg(F.count("*").alias("n_children"))
    nodes = materialize(
        found.join(parent, ["p1", "p2"], "left").join(children, ["d1", "d2"], "left").join(_ends_digests(ends), ["d1", "d2"], "left")
        .select("conv_id", "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"),
                F.when(F.col("n_children").isNull(), 1).otherwise(0).cast("long").alias("n_leaves"),
                ((F.col("n_convs") - 1) * F.col("words")).alias("saved_tokens"),
                F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256")))
    sums = subtree_sums(nodes.select(*_NODE, "parent_conv_id", "n_leaves", "saved_tokens"), ["n_leaves", "saved_tokens"])
    return nodes.drop("n_leaves", "saved_tokens").join(sums, list(_NODE)).select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


__all__ = ["BLOCK", "ordered_turns", "prefix_trie", "rebuilt_turns", "subtree_sums"]
