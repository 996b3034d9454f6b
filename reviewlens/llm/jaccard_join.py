"""Exact Jaccard links between documents: a size-aware heavy-light join.

A document is its set of distinct 5-word shingles (64-bit hashes). Two sets of
sizes a and b are linked when their overlap is at least
``need(a, b) = ceil(num * (a + b) / (num + den))``, which is
``den * |A and B| >= num * |A or B|``.

* Light sets (size <= boundary) enumerate their subsets of the fixed sizes
  ``need(a, b)`` of all light partners b. Two light sets are linked exactly
  when they share a subset of size ``need(a, b)``, so a key proves the link
  and one star per key (smallest set = centre) is complete.
* Heavy sets enter inverted lists with keys of two elements that are neighbours
  in one global order. An element of the one set only breaks two such pairs at
  most, one of the other set only breaks one, so linked sets share at least
  ``3 * need(a, b) - a - b - 1`` keys, and one of the first
  ``a - 1 - that + 1``. Unrelated texts of one language often share a single
  shingle, but hardly ever two that are neighbours in both, so lists do not
  fill up with the size of the corpus. (Thresholds too low for this bound take
  single elements, of which linked sets share ``need(a, b)``.) Any global order
  is valid; here the elements that a fixed-size sketch of the whole corpus shows
  as frequent come last, so widespread passages seldom reach a list.
* The boundary is the size at which enumerating costs more keys than scanning
  lists, from the size histogram and the sketch's mean list length.

Lists are joined without expanding groups of copies into all pairs. Equal
sets are one node. Star rounds link the members of every list to a few centres,
and lists within one component are dropped, until what is open is small; at
last all pairs of a list whose components still differ are joined by size,
position and short parity bitmaps, each pair in one of the first lists that it
shares and not in all of them. A pair is tried first on parity bitmaps, which
bound the symmetric difference from below, then on the full sets. A pair left out is already
connected or provably under the threshold, so components are exact.
"""

from __future__ import annotations

import functools
import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_IDS, free, keyed_text, materialize, prepare, small
from .components import connected_components
from .shingles import batch_shingles, mix64

SHINGLE = 5
NUM, DEN = 75, 100
#: counters of the frequency sketch: a fixed size, whatever the corpus
SKETCH_BITS = 24
#: sketch counters of this sum mark frequent elements; the largest HOT_COUNTERS of them are kept
FREQUENT, HOT_COUNTERS = 32, 1 << 20
#: star rounds go on while open lists have as many pairs as lists of this many sets; centres of a list and round
LONG_LIST, CENTRES = 8, 3
#: shortest and longest parity bitmap of a set, in words of 64 bits; below the longest, one has at least two bits per element
COARSE_WORDS, BITMAP_WORDS = 8, 128
#: open keys before its own that an entry of a list carries into the last join
BEFORE = 4
#: bytes of text hashed at once; memory of a task only
CHUNK = 1 << 18
#: sizes for which enumeration is considered at all (2^12 subsets at most)
LARGEST_LIGHT = 12


def need(a: int, b: int, num: int = NUM, den: int = DEN) -> int:
    """Smallest overlap that links sets of sizes a and b."""
    return -(-num * (a + b) // (num + den))


def min_partner(a, num: int = NUM, den: int = DEN):
    """ceil(num * a / den): smallest size of a linked set, and smallest overlap."""
    return -(-num * a // den)


@functools.lru_cache(maxsize=None)
def key_width(num: int = NUM, den: int = DEN) -> int:
    """Elements of a list key: 2 if all linked sets that differ share a pair of neighbours, else 1."""
    wide = 32 * (3 * num - (num + den)) >= num + den and all(
        shared_keys(a, b, num, den, 2) >= 1 for b in range(1, 65) for a in range(min_partner(b, num, den), b + 1)
        if need(a, b, num, den) < b)
    return 2 if wide else 1


def shared_keys(a, b, num: int = NUM, den: int = DEN, width: int = 2):
    """Smallest number of list keys that linked sets of sizes a and b share."""
    least = need(a, b, num, den)
    return least if width == 1 else 3 * least - a - b - 1


@functools.lru_cache(maxsize=1 << 16)
def prefix_keys(a: int, num: int = NUM, den: int = DEN) -> int:
    """Number of first list keys among which every partner of a set of size a shares one."""
    width = key_width(num, den)
    least = int(shared_keys(a, np.arange(min_partner(a, num, den), a * den // num + 1), num, den, width).min())
    return min(a - width + 1, a - width + 1 - least + 1)


def subset_sizes(a: int, boundary: int, num: int = NUM, den: int = DEN) -> list[int]:
    """Sizes of the subsets that a light set of size a enumerates."""
    lo, hi = min_partner(a, num, den), min(a * den // num, boundary)
    return sorted({need(a, b, num, den) for b in range(lo, hi + 1)})


def choose_boundary(sizes: dict[int, int], mean_list: float, num: int = NUM, den: int = DEN) -> int:
    """Light up to the size that minimises keys enumerated plus lists scanned."""
    def enumerate_cost(a, boundary):
        return sum(math.comb(a, c) for c in subset_sizes(a, boundary, num, den))

    def scan_cost(a):
        return prefix_keys(a, num, den) * mean_list

    def cost(boundary):
        return sum(n * (enumerate_cost(a, boundary) if a <= boundary else scan_cost(a))
                   for a, n in sizes.items())
    return min(range(1, LARGEST_LIGHT + 1), key=lambda b: (cost(b), b))


def _chance_limit(mean: float) -> int:
    """Smallest count that a Poisson counter of this mean reaches with a chance of at most 1 in 500."""
    c, p = 0, math.exp(-mean)
    tail = 1.0
    while tail > 0.002:
        tail -= p
        c += 1
        p *= mean / c
    return c


def _sketch_pass(k: int):
    """Per task: sketch counters that stand out, and a histogram of small sizes."""
    def run(batches: Iterator[pa.RecordBatch]):
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int32)
        sizes = np.zeros(LARGEST_LIGHT + 1, dtype=np.int64)
        tokens = 0
        shift = np.uint64(64 - SKETCH_BITS)
        for batch in batches:
            for _, h in batch_shingles(batch.column(0), k, CHUNK):
                u = np.unique(h)
                tokens += len(u)
                if len(u) <= LARGEST_LIGHT:
                    sizes[len(u)] += 1
                np.add.at(counts, (u >> shift).astype(np.int64), 1)
        hot = np.flatnonzero(counts >= _chance_limit(tokens / counts.size))
        kind = np.concatenate([np.zeros(len(hot)), np.ones(len(sizes)), [2]]).astype(np.int32)
        key = np.concatenate([hot, np.arange(len(sizes)), [0]]).astype(np.int64)
        val = np.concatenate([counts[hot], sizes, [tokens]]).astype(np.int64)
        yield pa.record_batch([pa.array(kind), pa.array(key), pa.array(val)], names=["kind", "key", "val"])
    return run


def _keys_pass(k: int, boundary: int, heavy, num: int, den: int):
    """Per document: size, node id, first list keys in order, parity bitmap and light subset keys."""
    shift = np.uint64(64 - SKETCH_BITS)
    width = key_width(num, den)

    def run(batches: Iterator[pa.RecordBatch]):
        buckets, weights = heavy.value
        seen: set = set()
        for batch in batches:
            sizes, nodes, prefix, bits, coarse, subsets = [], [], [], [], [], []
            named = batch.column(0).is_valid().to_pylist()
            for r, h in batch_shingles(batch.column(1), k, CHUNK):
                u = np.unique(h)
                a = len(u)
                sizes.append(a)
                if not a:
                    nodes.append(None)
                    prefix.append(None)
                    bits.append(None)
                    coarse.append(None)
                    subsets.append(None)
                    continue
                node = _node_id(u)
                nodes.append(node)
                # a row without an id takes no part in links; an equal set of this task has its keys already
                if not named[r] or node in seen:
                    prefix.append(None)
                    bits.append(None)
                    coarse.append(None)
                    subsets.append(None)
                    continue
                if len(seen) < 1 << 20:     # bounds memory only; repeats are dropped later too
                    seen.add(node)
                light = a <= boundary
                if light:
                    mixed = mix64(u)
                    keys = [mix64(np.array([sum(int(mixed[i]) for i in c) + s * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF],
                                           dtype=np.uint64)).astype(np.int64)[0]
                            for s in subset_sizes(a, boundary, num, den)
                            for c in itertools.combinations(range(a), s)]
                    sizes_of = [s for s in subset_sizes(a, boundary, num, den) for _ in range(math.comb(a, s))]
                    subsets.append([{"key": int(x), "c": s} for x, s in zip(keys, sizes_of)])
                else:
                    subsets.append(None)
                if light and a * den // num <= boundary:
                    prefix.append(None)     # every partner is light too
                    bits.append(None)
                    coarse.append(None)
                    continue
                b = (u >> shift).astype(np.int64)
                at = np.searchsorted(buckets, b)
                at[at == len(buckets)] = 0
                w = np.where(buckets[at] == b, weights[at], 0) if len(buckets) else np.zeros(a, np.int64)
                p = prefix_keys(a, num, den)
                v = u[np.lexsort((u, w))[:p + width - 1]]
                prefix.append((v if width == 1 else mix64(v[:-1]) + v[1:]).view(np.int64))
                bits.append(_parity(u, min(max(1 << max(0, (a - 1).bit_length() - 5), COARSE_WORDS), BITMAP_WORDS)))
                coarse.append(_parity(u, COARSE_WORDS))
            yield pa.record_batch([
                batch.column(0), pa.array(sizes, pa.int32()), pa.array(nodes, pa.int64()),
                pa.array(prefix, pa.list_(pa.int64())), pa.array(bits, pa.list_(pa.int64())),
                pa.array(coarse, pa.list_(pa.int64())),
                pa.array(subsets, pa.list_(pa.struct([("key", pa.int64()), ("c", pa.int32())])))],
                names=["doc_id", "n", "node", "prefix", "bits", "coarse", "subsets"])
    return run


_KEYS = ("doc_id long, n int, node long, prefix array<long>, bits array<long>, coarse array<long>, "
         "subsets array<struct<key: long, c: int>>")


def _node_id(u: np.ndarray) -> int:
    """One 64-bit name for a whole set of sorted element hashes."""
    return int((mix64(u ^ np.uint64(0x5851F42D4C957F2D)).sum() + np.uint64(len(u))).astype(np.int64))


def _parity(u: np.ndarray, words: int) -> np.ndarray:
    """Parity bitmap of a set: an element flips one bit, so two bitmaps of one
    length differ in at most as many bits as the sets in elements. The length is
    a power of two; the exclusive or of its halves is the bitmap of half the length."""
    at = (mix64(u ^ np.uint64(0x2545F4914F6CDD1D)) & np.uint64(64 * words - 1)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<i8")


def _set_pass(k: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            names, sets = batch.column(0).to_pylist(), []
            for r, h in batch_shingles(batch.column(1), k, CHUNK):
                u = np.unique(h)
                if len(u) and _node_id(u) == names[r]:  # else another text under a repeated doc_id
                    sets.append((names[r], u.view(np.int64)))
            # a few documents per batch: arrays of very long texts stay apart
            for i in range(0, len(sets), 64):
                part = sets[i:i + 64]
                yield pa.record_batch([pa.array([x[0] for x in part], pa.int64()),
                                       pa.array([x[1] for x in part], pa.list_(pa.int64()))],
                                      names=["node", "elements"])
    return run


def _verify(num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]):
        for batch in batches:
            x, y = batch.column(0), batch.column(1)
            ea, eb = batch.column(2), batch.column(3)
            keep = []
            for i in range(batch.num_rows):
                a, b = ea[i].values.to_numpy(), eb[i].values.to_numpy()
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(den * both >= num * (len(a) + len(b) - both))
            keep = pa.array(keep, pa.bool_())
            yield pa.record_batch([x.filter(keep), y.filter(keep)], names=["x", "y"])
    return run


def _parity_bound(num: int, den: int) -> Column:
    """Whether sets of sizes a and b may be linked by their parity bitmaps bx and by."""
    def folded(c: str, other: str) -> Column:
        n = F.floor(F.size(c) / 2).cast("int")
        halves = F.zip_with(F.slice(c, F.lit(1), n), F.slice(c, n + 1, n), lambda p, q: p.bitwiseXOR(q))
        return F.when(F.size(c) == 2 * F.size(other), halves).otherwise(F.col(c))
    x, y = folded("bx", "by"), folded("by", "bx")
    apart = F.aggregate(F.zip_with(x, y, lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda s, c: s + c)
    least = F.ceil(F.lit(num) * (F.col("a") + F.col("b")) / F.lit(num + den))
    return (F.size(x) != F.size(y)) | (apart <= F.col("a") + F.col("b") - 2 * least)


class _Verifier:
    """Checks candidate pairs of nodes on their parity bitmaps and on their full sets."""

    def __init__(self, docs: DataFrame, nodes: DataFrame, reps: DataFrame, k: int, num: int, den: int):
        self.docs, self.reps, self.k, self.num, self.den = docs, reps, k, num, den
        self.bits = materialize(nodes.filter("bits is not null").select("node", "n", "bits", "coarse").dropDuplicates(["node"]))

    def possible(self, pairs: DataFrame) -> DataFrame:
        """``pairs(x, y)`` that their sizes and bitmaps do not rule out."""
        return materialize(
            pairs.join(self.bits.select(F.col("node").alias("x"), F.col("n").alias("a"), F.col("bits").alias("bx")), "x")
            .join(self.bits.select(F.col("node").alias("y"), F.col("n").alias("b"), F.col("bits").alias("by")), "y")
            .filter(_parity_bound(self.num, self.den)).select("x", "y"))

    def links(self, pairs: DataFrame) -> DataFrame:
        """``pairs(x, y)`` that are linked."""
        pairs = self.possible(pairs)
        nodes = pairs.select(F.col("x").alias("node")).union(pairs.select(F.col("y").alias("node"))).distinct()
        ids = materialize(nodes.join(self.reps, "node").select("node", F.col("rep").alias("doc_id")))
        texts = self.docs.join(small(ids), "doc_id").select("node", "text")
        # (equal rows of a repeated doc_id give their pair twice, which changes no component)
        sets = materialize(texts.mapInArrow(_set_pass(self.k), "node long, elements array<long>"))
        a = sets.select(F.col("node").alias("x"), F.col("elements").alias("ea"))
        b = sets.select(F.col("node").alias("y"), F.col("elements").alias("eb"))
        found = materialize(pairs.join(a, "x").join(b, "y").select("x", "y", "ea", "eb")
                            .mapInArrow(_verify(self.num, self.den), "x long, y long"))
        free(pairs, ids, sets)
        return found


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE,
                       num: int = NUM, den: int = DEN) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id.

    ``component_id`` is the smallest doc_id reachable by links, itself
    included. A null or empty
    text, or one without words, has ``n_shingles`` 0 and is linked with
    nothing; fewer words than ``shingle`` make one shingle. A null doc_id
    takes no part in links and keeps a null component. Rows that repeat a
    doc_id are rows of one document: they share the smallest of their
    components. An empty table gives an empty result; other columns of ``df``
    are ignored.
    """
    spark = df.sparkSession
    prepare(spark)
    docs = keyed_text(df, id_col, text_col)

    rows = (docs.select("text").mapInArrow(_sketch_pass(shingle), "kind int, key long, val long")
            .groupBy("kind", "key").agg(F.sum("val").alias("val"))
            .filter((F.col("kind") > 0) | (F.col("val") >= FREQUENT))
            .orderBy(F.desc("kind"), F.desc("val"), "key").limit(HOT_COUNTERS).toArrow())
    kind, key, val = (rows.column(i).to_numpy() for i in range(3))
    tokens = int(val[kind == 2].sum())
    order = np.argsort(key[kind == 0])
    hot = key[kind == 0][order], val[kind == 0][order]
    mean_list = 1 + float((hot[1].astype(float) ** 2).sum()) / max(tokens, 1)
    boundary = choose_boundary({int(a): int(c) for a, c in zip(key[kind == 1], val[kind == 1]) if a}, mean_list, num, den)
    heavy = spark.sparkContext.broadcast(hot)

    keys = materialize(docs.mapInArrow(_keys_pass(shingle, boundary, heavy, num, den), _KEYS).withColumn("row", F.monotonically_increasing_id()))
    nodes = keys.filter("node is not null and doc_id is not null")
    reps = materialize(nodes.groupBy("node").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n")))
    verify = _Verifier(docs, nodes, reps, shingle, num, den)

    repeated = nodes.groupBy("doc_id").agg(F.min("node").alias("y"), F.max("node").alias("hi")).filter("y <> hi")
    same_id = nodes.join(repeated.select("doc_id", "y"), "doc_id").filter("node <> y").select(F.col("node").alias("x"), "y")
    light = _light_links(nodes, num, den)
    links = materialize(light.union(same_id))
    free(light)
    roots = _heavy_links(_inverted_lists(nodes), links, verify, num, den)

    named = roots.join(reps.select("node", "rep"), "node")
    smallest = named.groupBy("root").agg(F.min("rep").alias("component_id"))
    by_node = materialize(reps.join(roots, "node", "left").join(smallest, "root", "left")
                          .select("node", F.coalesce("component_id", "rep").alias("component_id")))
    free(reps, roots, verify.bits)
    return (keys.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "node")
           .join(by_node, "node", "left")
           .select("doc_id", "n_shingles",
                   F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")))


def _light_links(nodes: DataFrame, num: int, den: int) -> DataFrame:
    """Links among light sets: sets that share a subset key of size c are linked
    with the smallest set of the key if need(a, b) <= c. ``need`` grows with
    both sizes, so a set that is too large for the centre is too large for all."""
    keyed = nodes.filter("subsets is not null").select("node", "n", F.explode("subsets").alias("s"))
    keyed = keyed.select("node", "n", F.col("s.key").alias("key"), F.col("s.c").alias("c")).distinct()
    centre = keyed.groupBy("key", "c").agg(F.min(F.struct("n", "node")).alias("m"), F.count("*").alias("k")).filter("k > 1")
    linked = F.ceil(F.lit(num) * (F.col("n") + F.col("m.n")) / F.lit(num + den)) <= F.col("c")
    return materialize(keyed.join(centre, ["key", "c"]).filter(linked & (F.col("node") != F.col("m.node")))
                       .select(F.col("node").alias("x"), F.col("m.node").alias("y")).distinct())


def _inverted_lists(nodes: DataFrame) -> DataFrame:
    """(token, node, n, pos) of every list key that two rows or more have. Only
    the key, a row number and the position are shuffled."""
    entries = nodes.filter("prefix is not null").select("row", F.posexplode("prefix").alias("pos", "token"))
    shared = materialize(entries.withColumn("length", F.count("*").over(Window.partitionBy("token")))
                         .filter("length > 1").select("token", "row", "pos"))
    rows = materialize(shared.select("row").distinct().join(nodes.select("row", "node", "n"), "row"))
    lists = materialize(shared.join(small(rows, BROADCAST_IDS // 4), "row").select("token", "node", "n", "pos").distinct())
    free(shared, rows)
    return lists


def _heavy_links(lists: DataFrame, links: DataFrame, verify: _Verifier, num: int, den: int):
    """Adds the links found through inverted lists; returns the components."""
    salt, before = 0, None
    while True:
        roots = connected_components(links)
        mine = (lists.select("token", "node", "n", "pos").join(small(roots, BROADCAST_IDS // 4), "node", "left")
                .select("token", "node", "n", "pos", F.coalesce("root", "node").alias("root")))
        per_list = mine.groupBy("token", "root").agg(F.count("*").alias("c"))
        per_list = materialize(per_list.groupBy("token").agg(
            F.count("*").alias("roots"), F.max_by("root", "c").alias("top"), F.sum("c").alias("c"),
            ((F.sum("c") * F.sum("c") - F.sum(F.col("c") * F.col("c"))) / 2).alias("pairs")).filter("roots > 1"))
        cross, entries = per_list.agg(F.sum("pairs"), F.sum("c")).first()
        cross, entries = cross or 0, entries or 0
        mixed = materialize(mine.join(per_list.select("token", "top"), "token"))
        free(per_list, lists)
        # rounds go on while many pairs are open and a round closes half of them; the result is the same after any number
        if 2 * cross <= (LONG_LIST - 1) * entries or before is not None and 2 * cross > before:
            break
        found = verify.links(_star_pairs(mixed, salt, num, den))
        links, old = materialize(_as_links(roots).union(found)), links
        free(found, old, roots)
        lists, salt, before = mixed, salt + CENTRES, cross
    # every pair that is apart has a member outside the largest component of its list
    words = verify.bits.select("node", *[F.col("coarse")[i].alias(f"p{i}") for i in range(COARSE_WORDS)])
    keys = Window.partitionBy("node").orderBy("pos")
    before = F.array_compact(F.array(*[F.lag("token", i + 1).over(keys) for i in range(BEFORE)]))
    right = materialize(mixed.withColumn("before", before).join(words, "node"))
    pairs = _cross_pairs(right.filter("root <> top"), right, "rx <> ry and (y < x or ry = top)", num, den)
    found = verify.links(pairs)
    free(mixed, right)
    joined = connected_components(_as_links(roots).union(found))
    free(found, links, roots)
    return joined


def _as_links(roots: DataFrame) -> DataFrame:
    """Components as links: every node with its root."""
    return roots.filter("node <> root").select(F.col("node").alias("x"), F.col("root").alias("y"))


def _star_pairs(mixed: DataFrame, salt: int, num: int, den: int) -> DataFrame:
    """Likely pairs of a set and one of the centres of its lists, one for each other
    component. Leaving a pair out here loses nothing, since the last step joins
    whatever is still apart."""
    def centre(s):
        return F.min(F.struct(F.xxhash64("node", F.lit(s)).alias("o"), F.col("node").alias("y"),
                              F.col("n").alias("yn"), F.col("root").alias("yroot")))
    centres = (mixed.groupBy("token").agg(*[centre(salt + i).alias(f"c{i}") for i in range(CENTRES)])
               .select("token", F.explode(F.array_distinct(F.array(*[F.col(f"c{i}").dropFields("o") for i in range(CENTRES)]))).alias("m")))
    pairs = (mixed.join(centres.select("token", "m.*"), "token")
             .filter((F.col("root") != F.col("yroot"))
                     & (F.col("n") * den >= F.col("yn") * num) & (F.col("yn") * den >= F.col("n") * num))
             .groupBy(F.col("node").alias("x"), "yroot", "y").agg(F.count("*").alias("c")))
    return pairs.groupBy("x", "yroot").agg(F.max_by("y", F.struct("c", "y")).alias("y")).select("x", "y")


def _cross_pairs(left: DataFrame, right: DataFrame, apart: str, num: int, den: int) -> DataFrame:
    """(x, y): pairs of a list in different components that may be linked by size
    and position. The first key that sets of sizes a and b share has as many keys
    from it on, in both, as linked sets of these sizes share at least. Coarse
    parity bitmaps rule out most others here, before a pair is a row. A pair that
    shares one of the last few keys before this one is met in the list of that
    key, which passes wherever this one does, so it is left out here."""
    x = left.select("token", F.col("node").alias("x"), F.col("n").alias("a"), F.col("pos").alias("i"), F.col("root").alias("rx"),
                    F.col("before").alias("kx"),
                    *[F.col(f"p{i}").alias(f"px{i}") for i in range(COARSE_WORDS)])
    y = right.select("token", F.col("node").alias("y"), F.col("n").alias("b"), F.col("pos").alias("j"), F.col("root").alias("ry"),
                     "top", F.col("before").alias("ky"), *[F.col(f"p{i}").alias(f"py{i}") for i in range(COARSE_WORDS)])
    differ = sum(F.bit_count(F.col(f"px{i}").bitwiseXOR(F.col(f"py{i}"))) for i in range(COARSE_WORDS))
    width = key_width(num, den)
    least = F.ceil(F.lit(num) * (F.col("a") + F.col("b")) / F.lit(num + den))
    shared = least if width == 1 else 3 * least - F.col("a") - F.col("b") - 1
    pairs = x.join(y, (x["token"] == y["token"]) & F.expr(apart)
                   & (F.col("a") * den >= F.col("b") * num) & (F.col("b") * den >= F.col("a") * num)
                   & (F.col("i") + shared <= F.col("a") - (width - 1)) & (F.col("j") + shared <= F.col("b") - (width - 1))
                   & (differ <= F.col("a") + F.col("b") - 2 * least) & ~F.arrays_overlap("kx", "ky"))
    return pairs.select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y")).distinct()


def keep_one_per_component(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``df`` with one text of every component: that of the smallest doc_id.

    Every (doc_id, text) is judged by itself: an unrelated text under a repeated
    doc_id stays, and texts under a null doc_id are linked like any other (one
    with a doc_id is kept before them). Texts without words stay, and so do all
    rows with the id and text of the one kept. All columns are kept; an empty
    table gives an empty result.
    """
    from .common import text_hash, without
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    one = df.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text.alias("text"), text_hash(text).alias("hash"))
    one = one.withColumn("unit", F.xxhash64(F.lit(5), F.col("doc_id").isNull(), "doc_id", "text"))
    groups = jaccard_components(one, "unit", "text").filter("n_shingles > 0").select(F.col("doc_id").alias("unit"), "component_id").distinct()
    members = materialize(one.select("doc_id", "hash", "unit").distinct().join(groups, "unit"))
    kept = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("a"), "doc_id", "unit")).alias("k"),
                                               F.count("*").alias("texts")).filter("texts > 1").select("component_id", F.col("k.unit").alias("kept"))
    dropped = materialize(members.join(kept, "component_id").filter("unit <> kept").select("doc_id", "hash").distinct())
    return without(df, dropped, id_col, text_col)
