"""Packing of tokenised documents into sequences by a linear grouping scheme.

Tokenising runs on the executors, a batch of documents at a time. What the
driver sees is one histogram of piece lengths, at most ``capacity`` rows
whatever the corpus, and it returns a plan of runs: "ranks r to r + c of
length l go to sequences s to s + c at offset o". Pieces get their rank among
equal lengths by a distributed count and look their run up, so no group of
documents ever meets in one task.

The plan follows the linear grouping scheme for bin packing:

1. lengths over ``capacity / share`` are large. Sorted by size they fall into
   groups of equal cardinality, and each group is rounded up to its largest.
   The plan is made for a few shares, and the shortest one is used.
2. The few rounded sizes make a configuration program, solved by column
   generation (a dynamic program over the capacity prices the columns).
3. Whole parts of the solution become runs of sequences; actual documents
   replace the rounded sizes, run by run.
4. What is left, large or small, goes in decreasing order into the fullest
   sequence that still holds it (best fit), opening new ones when none does.
"""

from __future__ import annotations

import bisect
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import keyed_text, large_string, materialize, prepare, shuffle_partitions
from .vocab import byte_values

CAPACITY = 2048
GROUPS = 48
#: lengths over capacity / share are large; the share that needs the fewest sequences is taken
LARGE_SHARES = (2, 3, 4, 6, 8)
#: pieces that one counting bucket ranks at most on average, and buckets per shuffle partition at least
PIECES_PER_BUCKET, BUCKETS_PER_PARTITION = 1_000_000, 4

_encoders: dict = {}


def byte_encoder(path: str):
    """A fast encoder with the vocabulary of a byte-level BPE ``tokenizer.json``.

    It gives the ids of the tokenizers library for this file (a test compares
    them); special strings in a text become their special id, as there.
    """
    if path not in _encoders:
        import tiktoken
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        value = byte_values()
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(value[c] for c in word): i for word, i in spec["model"]["vocab"].items()
                 if word not in special}
        pattern = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
        _encoders[path] = tiktoken.Encoding("byte_level", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
    return _encoders[path]


def cut(total: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of a document; only the first may be shorter."""
    if total <= capacity:
        return [(0, total)]
    first = total % capacity or capacity
    return [(0, first)] + [(s, capacity) for s in range(first, total, capacity)]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _piece_pass(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]):
        enc = byte_encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), large_string(batch, "text")):
                ids = np.array(enc.encode(text, allowed_special="all") + [end_id], dtype="<u4")
                for p, (s, n) in enumerate(cut(len(ids), capacity)):
                    rows.append((doc_id, p, s, n, zlib.crc32(ids[s:s + n].tobytes())))
            cols = list(zip(*rows)) if rows else [()] * 5
            yield pa.record_batch([pa.array(c, t) for c, t in zip(
                cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"])
    return run


@dataclass
class Run:
    """``count`` neighbouring sequences with the same lengths in the same order."""
    first: int
    count: int
    used: int


class Plan:
    """Rows (length, rank, count, sequence, offset), and the open sequences."""

    def __init__(self, capacity: int):
        self.capacity, self.rows, self.sequences = capacity, [], 0
        self.cursor: dict[int, int] = {}
        self.open: dict[int, list[Run]] = {}
        self.spaces: list[int] = []          # sorted keys of self.open

    def new_run(self, count: int) -> Run:
        run = Run(self.sequences, count, 0)
        self.sequences += count
        return run

    def place(self, run: Run, length: int) -> None:
        """One piece of this length into every sequence of the run."""
        rank = self.cursor.get(length, 0)
        self.rows.append((length, rank, run.count, run.first, run.used))
        self.cursor[length] = rank + run.count
        run.used += length

    def keep(self, run: Run) -> None:
        space = self.capacity - run.used
        if space and run.count:
            if space not in self.open:
                self.open[space] = []
                bisect.insort(self.spaces, space)
            self.open[space].append(run)

    def best_space(self, length: int) -> int | None:
        i = bisect.bisect_left(self.spaces, length)
        return self.spaces[i] if i < len(self.spaces) else None

    def take(self, space: int) -> Run:
        run = self.open[space].pop()
        if not self.open[space]:
            del self.open[space]
            self.spaces.remove(space)
        return run


def best_fit(plan: Plan, counts: dict[int, int]) -> None:
    """Pieces in decreasing length, each into the fullest sequence that holds
    it. A sequence with the least fitting space stays the best one until the
    length no longer fits, so whole runs are filled at once."""
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left > 0:
            space = plan.best_space(length)
            if space is None:
                space = plan.capacity
                run = plan.new_run(-(-left // (space // length)))
            else:
                run = plan.take(space)
            each = space // length
            full = min(run.count, left // each)
            if full < run.count:
                if full == 0:                # the last pieces fill one sequence partly
                    each, full = left, 1
                plan.keep(Run(run.first + full, run.count - full, run.used))
                run = Run(run.first, full, run.used)
            for _ in range(each):
                plan.place(run, length)
            left -= each * run.count
            plan.keep(run)


def _best_configuration(rooms: np.ndarray, value: np.ndarray) -> tuple[float, np.ndarray]:
    """The multiset of sizes of the greatest value that fits the capacity.

    ``rooms[i, r]`` is the room that size i leaves of r, or the last column
    (never reached). One layer of the program adds one piece to every room.
    """
    k, width = rooms.shape
    best = np.zeros(width + 1)
    best[-1] = -np.inf
    layers = []
    while True:
        gain = best[rooms] + value[:, None]
        top = gain.argmax(axis=0)
        new = gain[top, np.arange(width)]
        better = new > best[:width] + 1e-12
        if not better.any():
            break
        layers.append(np.where(better, top, -1))
        best[:width] = np.where(better, new, best[:width])
    column, room = np.zeros(k), width - 1
    for choice in reversed(layers):
        if choice[room] >= 0:
            column[choice[room]] += 1
            room = int(rooms[choice[room], room])
    return float(value @ column), column


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, float]]:
    """The configuration program by column generation: (column, times used)."""
    k = len(sizes)
    basis = np.diag((capacity // sizes).astype(float))
    rooms = np.arange(capacity + 1)[None, :] - sizes[:, None]
    rooms[rooms < 0] = capacity + 1
    for _ in range(60 * k):
        inverse = np.linalg.inv(basis)
        amount = inverse @ demand
        price = np.ones(k) @ inverse
        worth, column = _best_configuration(rooms, np.maximum(price, 0))
        if worth <= 1 + 1e-7:
            break
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    return [(basis[:, j], float(x)) for j, x in enumerate(np.linalg.solve(basis, demand))]


def make_plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS,
              shares: tuple[int, ...] = LARGE_SHARES) -> Plan:
    """The packing of a histogram of lengths; see the module's head."""
    return min((_grouped_plan(histogram, capacity, groups, s) for s in shares), key=lambda p: p.sequences)


def _grouped_plan(histogram: dict[int, int], capacity: int, groups: int, share: int) -> Plan:
    plan = Plan(capacity)
    left = {n: c for n, c in histogram.items() if c > 0}
    whole = left.pop(capacity, 0)
    if whole:
        plan.place(plan.new_run(whole), capacity)
    large = sorted((n for n in left if n > capacity // share), reverse=True)
    total = sum(left[n] for n in large)
    if total:
        # groups of equal cardinality over the sorted lengths: [[length, count], ...]
        bounds = [total * g // groups for g in range(1, groups + 1)]
        parts: list[list[list[int]]] = [[]]
        seen = 0
        for n in large:
            c = left[n]
            while c:
                if seen == bounds[len(parts) - 1] and len(parts) < groups:
                    parts.append([])
                    continue
                t = min(c, bounds[len(parts) - 1] - seen)
                parts[-1].append([n, t])
                seen, c = seen + t, c - t
        parts = [p for p in parts if p]
        merged: dict[int, list[list[int]]] = {}
        for p in parts:                      # groups that round to one size are one
            merged.setdefault(p[0][0], []).extend(p)
        sizes = np.array(sorted(merged, reverse=True))
        stock = [merged[s] for s in sizes]
        demand = np.array([float(sum(c for _, c in p)) for p in stock])
        for column, times in configurations(sizes, demand, capacity):
            times = int(times + 1e-9)
            slots = [g for g, a in enumerate(column) for _ in range(int(round(a)))]
            if times <= 0 or not slots:
                continue
            pending = [plan.new_run(times)]
            for g in slots:
                nxt = []
                for run in pending:          # a run splits where the actual length changes
                    while run.count and stock[g]:
                        n, c = stock[g][0]
                        t = min(c, run.count)
                        part = Run(run.first, t, run.used)
                        plan.place(part, n)
                        left[n] -= t
                        nxt.append(part)
                        run = Run(run.first + t, run.count - t, run.used)
                        stock[g][0][1] -= t
                        if not stock[g][0][1]:
                            stock[g].pop(0)
                    if run.count:
                        nxt.append(run)
                pending = nxt
            for run in pending:
                plan.keep(run)
    best_fit(plan, {n: c for n, c in left.items() if c > 0})
    return plan


def _assign_pass(plan):
    """Look up the run of every (length, rank)."""
    def run(batches: Iterator[pa.RecordBatch]):
        length, rank, first, offset = plan.value
        key = length * (1 << 42) + rank
        for batch in batches:
            n, r = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            at = np.searchsorted(key, n * (1 << 42) + r, side="right") - 1
            yield pa.record_batch([*batch.columns[:5], pa.array(first[at] + r - rank[at]), pa.array(offset[at])],
                                  names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])
    return run


def pack_documents(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
                   capacity: int = CAPACITY, groups: int = GROUPS, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single token ``end_id``. Rows that repeat a
    doc_id are packed as documents of their own, null ids too. An empty table
    gives an empty result; other columns of ``df`` are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    pieces = materialize(keyed_text(df, id_col, text_col).mapInArrow(_piece_pass(tokenizer, capacity, end_id), _PIECES))
    buckets = max(BUCKETS_PER_PARTITION * shuffle_partitions(spark), pieces.count() // PIECES_PER_BUCKET)
    bucket = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).alias("bucket")
    within = Window.partitionBy("bucket", "length").orderBy("doc_id", "piece", "ids_crc32")
    ranked = pieces.select("*", bucket).withColumn("r", F.row_number().over(within) - 1)
    counts = materialize(pieces.select("length", bucket).groupBy("length", "bucket").agg(F.count("*").alias("c")))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("length", "bucket", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("base"))
    histogram = {r["length"]: r["c"] for r in counts.groupBy("length").agg(F.sum("c").alias("c")).collect()}  # <= capacity rows

    plan = make_plan(histogram, capacity, groups)
    rows = sorted(plan.rows)
    table = tuple(np.array([r[i] for r in rows], dtype=np.int64) for i in (0, 1, 3, 4))
    shared = spark.sparkContext.broadcast(table)    # runs: a number bounded by capacity and groups
    return (ranked.join(base, ["bucket", "length"])
            .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("r") + F.col("base")).cast("long").alias("rank"))
            .mapInArrow(_assign_pass(shared), _PIECES + ", sequence_id long, offset long"))
