"""Spelling variants: words of a corpus one edit apart, and the form each points to.

Words are compared by blocked Gram matrices. A word is a vector of letter
counts; products of two blocks of such vectors give all squared distances
between their words at once. One replaced letter is a squared distance of two,
one inserted letter of one, so pairs at a distance of at most two, in blocks
of equal or adjacent length, are kept and their edit is verified on the words.

All pairs of a length would be quadratic in the vocabulary. One edit leaves two
of the three thirds of a word as they are, so a word stands in the block of
every two of its thirds, under its own length and as the longer word of the
length before. Blocks with more than ``BLOCK_WORDS`` words are cut into parts
and every two parts meet in a task of their own, so that no block is one
task's work. A pair is counted in one block only, found from its edit.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free, large_string, materialize, prepare, shuffle_partitions, small

#: runs of letters that are words
LETTERS = "A-Za-zÀ-ÿ"
#: fewest code points and fewest occurrences of a word
SHORTEST, RAREST = 7, 2
#: one run in so many loses a letter
EDIT_STEP = 31
#: a form is so many times as frequent as its variant
FORM_RATIO = 10
#: most words of one part of a block
BLOCK_WORDS = 4096
#: rows of a Gram matrix
TILE = 512
#: code points that a task holds in one array of words, beyond one block
CELLS = 1 << 22
#: words counted in memory before a task hands on its counts
FLUSH_WORDS = 200_000

_RUN = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")
_LOWER = {c: c + 32 for c in range(65, 91)}
_DIMS = 96


def edited_run(doc_id, run: str) -> str:
    """A lower-cased run, or what its checksum with the document leaves of it."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    if h % EDIT_STEP:
        return run
    at = h % len(run)
    return run[:at] + run[at + 1:]


def vocabulary(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = RAREST) -> DataFrame:
    """(word, n): the words of all texts with at least ``least`` occurrences."""
    def run(batches: Iterator[pa.RecordBatch]):
        found: Counter = Counter()

        def out():
            return pa.record_batch([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), large_string(batch, "text")):
                for word, n in Counter(_RUN.findall(text.translate(_LOWER))).items():
                    word = edited_run(doc_id, word)
                    if len(word) >= SHORTEST:
                        found[word] += n
                if len(found) >= FLUSH_WORDS:
                    yield out()
                    found.clear()
        yield out()
    texts = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    return (texts.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
            .filter(F.col("n") >= least))


def _keys(words: DataFrame) -> DataFrame:
    """(key, base, third, word, n): the six blocks of every word. ``base`` is the
    length of the shorter words of a block."""
    length = F.length("word")
    rows = []
    for longer in (0, 1):
        base = length - longer
        cuts = [F.lit(0), F.floor(base / 3).cast("int"), F.floor(base * 2 / 3).cast("int"), base]
        for third in range(3):
            head, rest = cuts[third], cuts[third + 1] + longer
            kept = F.concat(F.substring(F.col("word"), F.lit(1), head), F.lit(" "), F.substring(F.col("word"), rest + 1, length))
            rows.append(F.struct(F.xxhash64(base, F.lit(third), kept).alias("key"), base.alias("base"), F.lit(third).alias("third")))
    return words.select("word", "n", F.explode(F.array(*rows)).alias("k")).select("k.*", "word", "n").filter(f"base >= {SHORTEST}")


def _tiles(keys: DataFrame, block_words: int) -> DataFrame:
    """Adds ``tile`` and ``side``. Words of a small block all meet in tile 0; a
    large block has a tile for every two of its parts, and in a tile of two
    different parts only words of different sides are compared."""
    large = keys.groupBy("key").count().filter(F.col("count") > block_words).select(
        "key", F.ceil(F.col("count") / block_words).cast("int").alias("parts"))
    found = keys.join(small(materialize(large)), "key", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    found = found.withColumn("part", F.pmod(F.xxhash64("word"), F.col("parts")).cast("int"))
    meets = F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda j: F.struct(
        (F.least("part", j) * F.col("parts") + F.greatest("part", j)).alias("tile"),
        F.when(j == F.col("part"), 0).when(j > F.col("part"), 1).otherwise(2).alias("side")))
    return found.select("base", "key", "third", "word", "n", F.explode(meets).alias("t")).select(
        "base", "key", "t.tile", "t.side", "third", "word", "n")


def letter_counts(codes: np.ndarray) -> np.ndarray:
    """Rows of Latin-1 codes, padded with 0 -> rows of letter counts."""
    place = np.where(codes < 0xC0, codes - 96, codes - 0xC0 + 27).astype(np.int64)    # a-z, then the accented letters
    rows = np.arange(len(codes))[:, None] * _DIMS
    flat = (rows + place)[codes > 0]
    return np.bincount(flat, minlength=len(codes) * _DIMS).reshape(-1, _DIMS).astype(np.float32)


def edit_places(shorter: np.ndarray, longer: np.ndarray, base: int, same: np.ndarray) -> np.ndarray:
    """Place of the one edit between rows of codes, -1 where there is not just one.
    ``same`` tells pairs of equal length; else the second word has one more."""
    differ = shorter[:, :base] != longer[:, :base]
    first = np.where(differ.any(1), differ.argmax(1), base)
    replaced = differ.sum(1) == 1
    after = np.arange(base)[None, :] >= first[:, None]
    inserted = ~((shorter[:, :base] != longer[:, 1:base + 1]) & after).any(1)
    return np.where(np.where(same, replaced, inserted), first, -1)


def near_pairs(words: list[str], keys: np.ndarray, sides: np.ndarray, base: int, third: np.ndarray):
    """Index pairs of near words among rows sorted by ``keys`` (a number per
    block and tile), by Gram matrices of ``TILE`` rows against their block."""
    m = len(words)
    codes = np.zeros((m, base + 1), np.uint8)
    for r, w in enumerate(words):
        codes[r, :len(w)] = np.frombuffer(w.encode("latin-1"), np.uint8)
    counts = letter_counts(codes)
    norms = (counts * counts).sum(1)
    longer = codes[:, base] > 0
    cuts = np.array([0, base // 3, base * 2 // 3, base + 1])
    ends = np.searchsorted(keys, keys, side="right")
    out = []
    for low in range(0, m, TILE):
        high = min(low + TILE, m)
        for left in range(low, int(ends[high - 1]), TILE):
            right = min(left + TILE, int(ends[high - 1]))
            squared = norms[low:high, None] + norms[None, left:right] - 2 * counts[low:high] @ counts[left:right].T
            i, j = np.nonzero((squared <= 2.5) & (keys[low:high, None] == keys[None, left:right]))
            i, j = i + low, j + left
            keep = (i < j) & ~(longer[i] & longer[j]) & ((sides[i] == 0) | (sides[i] != sides[j]))
            i, j = i[keep], j[keep]
            swap = longer[i]
            i, j = np.where(swap, j, i), np.where(swap, i, j)
            at = edit_places(codes[i], codes[j], base, ~longer[j])
            ok = (at >= 0) & (cuts[third[i]] <= at) & (at < cuts[third[i] + 1])
            out.append((i[ok], j[ok]))
    return (np.concatenate([x[k] for x in out]) if out else np.zeros(0, int) for k in (0, 1))


def _best(words: list[str], n: np.ndarray, i: np.ndarray, j: np.ndarray):
    """For every word with near words: its row, their number and the most frequent of them."""
    a, b = np.concatenate([i, j]), np.concatenate([j, i])
    rank = np.empty(len(words), np.int64)
    rank[np.array(sorted(range(len(words)), key=words.__getitem__), dtype=np.int64)] = np.arange(len(words))
    order = np.lexsort((rank[b], -n[b], a))
    a, b = a[order], b[order]
    rows, first, near = np.unique(a, return_index=True, return_counts=True)
    return rows, near, b[first]


def _near_words(tiles: DataFrame) -> DataFrame:
    """(word, n_near, best): partial numbers of near words and the best of a tile."""
    def run(batches: Iterator[pa.RecordBatch]):
        rows: list[tuple] = []

        def out():
            words, n = [r[5] for r in rows], np.array([r[6] for r in rows], np.int64)
            _, keys = np.unique(np.array([(r[1], r[2]) for r in rows], np.int64), axis=0, return_inverse=True)
            i, j = near_pairs(words, keys.reshape(-1), np.array([r[3] for r in rows]), rows[0][0], np.array([r[4] for r in rows]))
            found, near, best = _best(words, n, i, j)
            return pa.record_batch([pa.array([words[x] for x in found], pa.string()), pa.array(near, pa.int64()),
                                    pa.array([words[x] for x in best], pa.string()), pa.array(n[best], pa.int64())],
                                   names=["word", "n_near", "best", "best_n"])
        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns]):
                # blocks of one length, whole, until they fill a tile
                full = len(rows) >= TILE or len(rows) * row[0] >= CELLS
                if rows and (row[0] != rows[-1][0] or (full and row[1:3] != rows[-1][1:3])):
                    yield out()
                    rows = []
                rows.append(row)
        if rows:
            yield out()
    parts = shuffle_partitions(tiles.sparkSession)
    return (tiles.repartition(parts, "key", "tile").sortWithinPartitions("base", "key", "tile")
            .mapInArrow(run, "word string, n_near long, best string, best_n long"))


def roots(forms: DataFrame) -> DataFrame:
    """``forms`` (word, form) -> (word, root): forms followed to the last one, by
    doubling. Every step multiplies the frequency, so chains are short."""
    state = materialize(forms.select("word", F.col("form").alias("root")))
    while True:
        step = state.join(state.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        new = materialize(step.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        free(state)
        if new.filter("moved").isEmpty():
            return new.select("word", "root")
        state = materialize(new.select("word", "root"))
        free(new)


def spelling_variants(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per word: word, form, root, n, n_near, form_n.

    A null text has no words; a null doc_id counts as an empty one where runs
    are edited. Repeated rows count as often as they occur. Texts and words of
    any length count whole. Among near words of equal frequency the smallest in
    code-point order is the form. A table without words gives an empty result;
    other columns, whatever their names, are ignored.
    """
    prepare(df.sparkSession)
    words = materialize(vocabulary(df, id_col, text_col))
    near = _near_words(_tiles(materialize(_keys(words)), block_words))
    every = words.select("word", "n", F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("string").alias("best"),
                         F.lit(None).cast("long").alias("best_n"))
    # the smallest of (-n, word) is the most frequent, then the first word; a null is no candidate
    found = (every.unionByName(near, allowMissingColumns=True).groupBy("word")
             .agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"),
                  F.min(F.when(F.col("best").isNotNull(), F.struct((-F.col("best_n")).alias("m"), "best"))).alias("b")))
    has_form = -F.col("b.m") >= FORM_RATIO * F.col("n")
    found = materialize(found.select("word", "n", "n_near", F.when(has_form, F.col("b.best")).alias("form"),
                                     F.when(has_form, -F.col("b.m")).alias("form_n")))
    ends = roots(found.filter("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


__all__ = ["BLOCK_WORDS", "edited_run", "letter_counts", "near_pairs", "roots", "spelling_variants", "vocabulary"]
