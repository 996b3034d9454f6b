"""Distance work in tiles: which query rows meet which corpus rows, and the kernel.

A tile is a task-sized meeting of at most ``block_rows`` query rows and as many
corpus rows. Three layouts deal rows out to tiles:

  panels  every query panel meets every corpus panel (any dimension). A task
          holds a panel of query rows, and the corpus streams past it a block
          at a time: one summary per query row and panel, however many blocks;
  grid    a row meets the rows of its own cell, where each corpus row also
          stands in the adjacent cells that it is within ``eps`` of; the grid
          lies over at most ``GRID_DIMS`` coordinates, those of the largest
          spread, and its cells are so wide that a tile has many rows, of
          which few stand in a second cell; rows that meet one another stand
          in their own cell once, as query and corpus row in one;
  hash    a row meets the rows of its own bucket in every hash table.

Cells and buckets may be of any size: one with more rows than a block is cut
into parts on both sides, and every two parts are a tile of their own. The
pairs of a tile never leave the task; the kernel hands its near pairs to a
summary (counts, nearest rows, spanning forests), whose rows go on.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reviewlens.session import materialize

#: coordinates that a grid is laid over at most
GRID_DIMS = 3
#: a cell is this much wider than eps, so that rounding never moves a near row two cells away
CELL_SLACK = 1e-3
#: cells farther out than this count as one; up to here the division errs by less than the slack
FARTHEST_CELL = float(1 << 40)
#: relative rounding error allowed for the expanded square, in units of the squared norms
ROUNDING = 1e-12
#: pairs whose distances are held at once
PAIRS = 1 << 20
#: tiles with more pairs than this use a matrix product
MATRIX_PAIRS = 4096
#: rows of small tiles worked on together
BATCH_ROWS = 4096
#: numbers (rows x dimension) that a panel or a grid tile holds at most, and its rows
PANEL_VALUES = 1 << 22
PANEL_ROWS = 1 << 16
#: rows that a grid cell should have: the fewest, and as many on large tables, where
#: wide cells keep the copies in adjacent cells few
CELL_ROWS = (1 << 13, 1 << 18)
#: rows of one side of a grid tile at most
GRID_ROWS = 1 << 19
#: rows of a shuffled partition of tiles, about
PART_ROWS = 1 << 20
#: a grid cell is at most this many times as wide as eps
WIDEST_CELL = 64
#: strips per eps on a side: the fewest and the most (:class:`Strips`)
STRIPS = (1, 32)

TILE = ["t0", "t1", "t2", "tq", "tc"]
#: the side of a tile that a row stands on, in the order in which they are sorted
QUERY, BOTH, CORPUS = 0, 1, 2
MIN_BLOCK_ROWS = 256


def n_blocks(n: int, block_rows: int, parallelism: int = 8) -> int:
    """Blocks of one side: enough for ~2 x parallelism block-pair tasks (but
    blocks of at least MIN_BLOCK_ROWS rows), and never more than
    ``block_rows`` rows per block (the task memory bound)."""
    by_size = int(math.ceil(n / float(max(1, block_rows))))
    by_par = min(int(math.ceil(math.sqrt(2 * max(1, parallelism)))), int(math.ceil(n / float(MIN_BLOCK_ROWS))))
    return max(1, by_size, by_par)


def _part(parts, seed: int) -> Column:
    return F.pmod(F.xxhash64(F.lit(seed), "id", "v"), F.lit(parts) if isinstance(parts, int) else parts).cast("long")


def _upto(parts) -> Column:
    return F.explode(F.sequence(F.lit(0).cast("long"), (F.lit(parts) if isinstance(parts, int) else parts).cast("long") - 1))


def block_tiles(query: DataFrame, corpus: DataFrame, block_rows: int, n_query: int, n_corpus: int) -> tuple[DataFrame, DataFrame]:
    """Both frames (id, v, ...) with the tile columns of every meeting. Each side
    has as many blocks as its own rows need."""
    cores = query.sparkSession.sparkContext.defaultParallelism
    nq, nc = n_blocks(n_query, block_rows, cores), n_blocks(n_corpus, block_rows, cores)
    zero = [F.lit(0).cast("long").alias(c) for c in TILE[:3]]
    q = query.select("*", *zero, _part(nq, 17).alias("tq"), _upto(nc).alias("tc"))
    c = corpus.select("*", *zero, _upto(nq).alias("tq"), _part(nc, 17).alias("tc"))
    return q, c


def panel_rows(block_rows: int, dim: int) -> int:
    """Rows of a panel: some blocks, within a bound on the numbers that a task holds."""
    return max(block_rows, min(PANEL_ROWS, PANEL_VALUES // max(1, dim)))


def panel_tiles(query: DataFrame, corpus: DataFrame, block_rows: int, dim: int, n_query: int, n_corpus: int) -> tuple[DataFrame, DataFrame, int]:
    """Both frames with the number of every panel meeting (``t0``), and how many there
    are: about four a core, as few of them as the bound on a panel allows beyond that."""
    tasks = 4 * query.sparkSession.sparkContext.defaultParallelism

    def panels(n, wanted):
        return max(1, min(int(math.ceil(wanted)), int(math.ceil(n / float(MIN_BLOCK_ROWS)))))
    by_size = int(math.ceil(n_query / float(panel_rows(block_rows, dim))))
    nq = max(by_size, panels(n_query, math.sqrt(tasks * max(1, n_query) / max(1, n_corpus))))
    nc = panels(n_corpus, tasks / nq)
    q = query.withColumn("_q", _part(nq, 17)).withColumn("_c", _upto(nc))
    c = corpus.withColumn("_c", _part(nc, 17)).withColumn("_q", _upto(nq))
    return *[side.withColumn("t0", (F.col("_q") * nc + F.col("_c")).cast("int")).drop("_q", "_c") for side in (q, c)], nq * nc


def widest_dims(df: DataFrame, dim: int, limit: int = GRID_DIMS) -> list[int]:
    """Indices of the coordinates of ``v`` with the largest range."""
    if dim <= limit:
        return list(range(dim))
    spread = (df.select(F.posexplode("v").alias("j", "x")).groupBy("j")
              .agg((F.max("x") - F.min("x")).alias("r")).orderBy(F.desc("r"), "j").limit(limit).collect())
    return sorted(r["j"] for r in spread)


def _cell(j: int, width: float, shift: float = 0.0) -> Column:
    x = (F.nanvl(F.get("v", F.lit(j)), F.lit(0.0)) + F.lit(shift)) / F.lit(width)
    return F.floor(F.greatest(F.lit(-FARTHEST_CELL), F.least(F.lit(FARTHEST_CELL), x))).cast("long")


def _cells(df: DataFrame, dims: list[int], width: float) -> DataFrame:
    zero = F.lit(0).cast("long")
    return df.select("*", *[(_cell(dims[k], width) if k < len(dims) else zero).alias(f"x{k}") for k in range(GRID_DIMS)])


def _reached(df: DataFrame, dims: list[int], width: float, reach: float) -> DataFrame:
    """Every row in each cell that it is within ``reach`` of, in ``t0``, ``t1``, ``t2``."""
    for k in range(GRID_DIMS):
        cell = F.explode(F.sequence(_cell(dims[k], width, -reach), _cell(dims[k], width, reach))) if k < len(dims) else F.lit(0).cast("long")
        df = df.select("*", cell.alias(f"t{k}"))
    return df


def _dealt(query: DataFrame, corpus: DataFrame, links: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a cell (x0, x1, x2) dealt to tiles. ``links`` (x0, x1, x2, t0, t1, t2,
    nq, nc): which query cell meets which corpus cell, with the rows of both."""
    target = TILE[:3]
    sizes = links.groupBy(*target).agg(F.sum("nq").alias("nq"), F.max("nc").alias("nc")).select(
        *target, F.ceil(F.col("nq") / block_rows).alias("pq"), F.ceil(F.col("nc") / block_rows).alias("pc"))
    sizes = materialize(sizes)
    own = ["x0", "x1", "x2"]
    meets = links.join(sizes, target).groupBy(*own).agg(F.collect_list(F.struct(*target, "pq", "pc")).alias("meets"))
    q = query.join(meets, own).drop(*own).withColumn("m", F.explode("meets")).drop("meets")
    q = q.select(*[c for c in q.columns if c != "m"], *[f"m.{t}" for t in target], _part(F.col("m.pq"), 17).alias("tq"),
                 _upto(F.col("m.pc")).alias("tc"))
    named = sizes.toDF(*own, "pq", "pc")
    c = corpus.join(named, own)
    c = c.select(*[x for x in c.columns if x not in (*own, "pq", "pc")], *[F.col(o).alias(t) for o, t in zip(own, target)],
                 _upto(F.col("pq")).alias("tq"), _part(F.col("pc"), 17).alias("tc"))
    return q, c


def cells_per_eps(corpus: DataFrame, eps: float, dim: int) -> tuple[int, int]:
    """How many times as wide as eps a cell may be, for about as many rows in it as
    ``CELL_ROWS`` says: from the number of rows with which a row shares a cell of width
    eps. And the number of rows."""
    dims = widest_dims(corpus, dim)
    n = _cells(corpus, dims, eps * (1 + CELL_SLACK) if eps > 0 else 1.0).groupBy("x0", "x1", "x2").agg(F.count("*").cast("double").alias("n"))
    found = n.agg((F.sum(F.col("n") * F.col("n")) / F.sum("n")).alias("shared"), F.sum("n").alias("n")).first()
    if not dims or not found["shared"]:
        return 1, int(found["n"] or 0)
    # some cells for every core, as long as these are not too small
    rows = max(CELL_ROWS[0], min(CELL_ROWS[1], found["n"] / (4 * corpus.sparkSession.sparkContext.defaultParallelism)))
    return max(1, min(WIDEST_CELL, int((rows / found["shared"]) ** (1.0 / len(dims))))), int(found["n"])


def grid_tiles(query: DataFrame, corpus: DataFrame, eps: float, dim: int, block_rows: int, wide: int = 1) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by the cells of a grid, ``wide`` times as wide as eps: a query row
    stands in its own cell, a corpus row in every cell that it is within eps of."""
    dims = widest_dims(corpus, dim)
    reach = eps * (1 + CELL_SLACK) if eps > 0 else 0.0
    width = reach * wide if eps > 0 else 1.0
    target = TILE[:3]
    q = _cells(query, dims, width).withColumnsRenamed({f"x{k}": f"t{k}" for k in range(GRID_DIMS)})
    c = _reached(corpus, dims, width, reach)
    # only cells of more rows than a block are cut, and only these are listed
    qn, cn = (side.groupBy(*target).agg(F.count("*").alias(n)) for side, n in ((q, "nq"), (c, "nc")))
    sizes = qn.join(cn, target).select(*target, F.ceil(F.col("nq") / block_rows).alias("pq"), F.ceil(F.col("nc") / block_rows).alias("pc"))
    large = materialize(sizes.where("pq > 1 or pc > 1"))
    one = F.lit(1).cast("long")
    if large.isEmpty():
        q, c = (side.withColumn("pq", one).withColumn("pc", one) for side in (q, c))
    else:
        q, c = (side.join(large, target, "left").withColumns({p: F.coalesce(p, one) for p in ("pq", "pc")}) for side in (q, c))
    q = q.withColumn("tq", _part(F.col("pq"), 17)).withColumn("tc", _upto(F.col("pc"))).drop("pq", "pc")
    c = c.withColumn("tq", _upto(F.col("pq"))).withColumn("tc", _part(F.col("pc"), 17)).drop("pq", "pc")
    return q, c


def own_grid_tiles(rows: DataFrame, eps: float, dim: int, block_rows: int, wide: int = 1) -> DataFrame:
    """Rows (id, v, is_corpus, ...) that meet one another, dealt as :func:`grid_tiles` does,
    with their ``side``: a row stands once in its own cell, on both sides where it is a
    corpus row, and a corpus row also in the adjacent cells that it is within eps of. Only
    in cells of more rows than a block, which are cut, the sides are apart. ``shared``:
    whether the row stands in several tiles."""
    dims = widest_dims(rows, dim)
    reach = eps * (1 + CELL_SLACK) if eps > 0 else 0.0
    width = reach * wide if eps > 0 else 1.0
    target, home = TILE[:3], [f"x{k}" for k in range(GRID_DIMS)]
    apart = [_cell(j, width, -reach) < _cell(j, width, reach) for j in dims]
    dealt = _reached(_cells(rows.withColumn("shared", functools.reduce(Column.__or__, apart, F.lit(False))), dims, width), dims, width, reach)
    at_home = (F.col("t0") == F.col("x0")) & (F.col("t1") == F.col("x1")) & (F.col("t2") == F.col("x2"))
    side = F.when(at_home & F.col("is_corpus"), BOTH).when(at_home, QUERY).when(F.col("is_corpus"), CORPUS)
    dealt = dealt.withColumn("side", side).where(F.col("side").isNotNull()).drop(*home, "is_corpus")
    sizes = dealt.groupBy(*target).agg(F.count_if(F.col("side") < CORPUS).alias("nq"), F.count_if(F.col("side") > QUERY).alias("nc"))
    large = materialize(sizes.where((F.col("nq") > 0) & (F.col("nc") > 0)).select(
        *target, F.ceil(F.col("nq") / block_rows).alias("pq"), F.ceil(F.col("nc") / block_rows).alias("pc")).where("pq > 1 or pc > 1"))
    zero = F.lit(0).cast("long")
    if large.isEmpty():
        return dealt.withColumn("tq", zero).withColumn("tc", zero)

    def parts(tq, tc, on):
        return F.struct(tq.cast("long").alias("tq"), tc.cast("long").alias("tc"), on.alias("on"))

    def upto(n):
        return F.sequence(zero, n.cast("long") - 1)
    side, pq, pc = F.col("side"), F.col("pq"), F.col("pc")
    none = F.filter(F.array(parts(zero, zero, side)), lambda x: F.lit(False))
    as_query = F.when(side < CORPUS, F.transform(upto(pc), lambda k: parts(_part(pq, 17), k, F.lit(QUERY)))).otherwise(none)
    as_corpus = F.when(side > QUERY, F.transform(upto(pq), lambda k: parts(k, _part(pc, 17), F.lit(CORPUS)))).otherwise(none)
    copies = F.when(pq.isNull(), F.array(parts(zero, zero, side))).otherwise(F.concat(as_query, as_corpus))
    dealt = dealt.join(large, target, "left").withColumn("shared", F.col("shared") | pq.isNotNull()).withColumn("m", F.explode(copies))
    return dealt.withColumns({"tq": F.col("m.tq"), "tc": F.col("m.tc"), "side": F.col("m.on")}).drop("m", "pq", "pc")


def hash_tiles(query: DataFrame, corpus: DataFrame, planes: np.ndarray, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Rows dealt by the buckets of random hyperplanes: ``planes`` is tables x bits x (dim + 1)."""
    def buckets(df):
        def bucket(table):
            bits = [F.when(F.aggregate(F.zip_with("v", F.array(*[F.lit(float(a)) for a in p[:-1]]), lambda x, a: x * a),
                                       F.lit(0.0), lambda s, x: s + x) > F.lit(float(p[-1])), 1 << b).otherwise(0)
                    for b, p in enumerate(table)]
            return F.lit(0) + sum(bits[1:], bits[0])
        rows = F.array(*[F.struct(F.lit(t).cast("long").alias("x0"), bucket(p).cast("long").alias("x1"), F.lit(0).cast("long").alias("x2"))
                         for t, p in enumerate(planes)])
        return df.select("*", F.explode(rows).alias("b")).select(*df.columns, "b.*")
    own = ["x0", "x1", "x2"]
    query, corpus = buckets(query), buckets(corpus)
    qc = query.groupBy(*own).agg(F.count("*").alias("nq"))
    cc = corpus.groupBy(*own).agg(F.count("*").alias("nc"))
    links = materialize(qc.join(cc, own).select(*own, *[F.col(o).alias(t) for o, t in zip(own, TILE)], "nq", "nc"))
    return _dealt(query, corpus, links, block_rows)


# ------------------------------------------------------------------ kernel
def centred(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Both blocks moved by their common mean, and a bound on the error of
    their expanded squared distances: far from the origin the expansion
    would lose the digits that tell near points apart."""
    mean = (a.sum(axis=0) + b.sum(axis=0)) / (len(a) + len(b))
    a, b = a - mean, b - mean
    return a, b, ROUNDING * (np.einsum("ij,ij->i", a, a).max() + np.einsum("ij,ij->i", b, b).max())


def pairwise_sq_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared euclidean distances by the expansion (fast; used for candidates)."""
    aa = np.einsum("ij,ij->i", a, a)[:, None]
    bb = np.einsum("ij,ij->i", b, b)[None, :]
    return np.maximum(aa + bb - 2.0 * (a @ b.T), 0.0)


def exact_dists(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row-wise distances between matching rows of a and b (direct differences)."""
    d = a - b
    return np.sqrt(np.einsum("ij,ij->i", d, d))


class Rows:
    """Whole tiles of a sorted stream: vectors, ids, the side and the tile of every row."""

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        self.n = table.num_rows
        self.col = {c: table.column(c) for c in table.column_names if c != "v"}
        flat = table.column("v").combine_chunks() if table.num_rows else None
        self.v = flat.flatten().to_numpy(zero_copy_only=False).reshape(self.n, -1) if self.n else np.zeros((0, 0))
        self.id = table.column("id").to_numpy()
        self.side = table.column("side").to_numpy()
        new = np.zeros(max(0, self.n - 1), bool)
        for c in TILE:
            key = table.column(c).to_numpy()
            new |= key[1:] != key[:-1]
        cut = np.flatnonzero(new) + 1
        self.starts = np.concatenate([[0], cut])
        self.ends = np.concatenate([cut, [self.n]])
        # within a tile query rows stand before rows of both sides, and these before corpus rows
        self.q_ends = self.starts + np.add.reduceat((self.side < CORPUS).astype(np.int64), self.starts)
        self.c_starts = self.ends - np.add.reduceat((self.side > QUERY).astype(np.int64), self.starts)

    def array_bool(self, name: str) -> np.ndarray:
        """A boolean column; a null is false."""
        return self.col[name].fill_null(False).to_numpy(zero_copy_only=False).astype(bool)


def near_pairs(rows: Rows, eps: float, without=()) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(query row, corpus row) pairs within ``eps`` of all tiles but ``without``, some at a time."""
    nq, nc = rows.q_ends - rows.starts, rows.ends - rows.c_starts
    nq[np.asarray(without, dtype=np.int64)] = 0
    small = np.flatnonzero((nq > 0) & (nc > 0) & (nq * nc <= MATRIX_PAIRS))
    at = 0
    while at < len(small):
        # flattened pairs of many small tiles
        total = np.cumsum((nq * nc)[small[at:]])
        upto = at + max(1, int(np.searchsorted(total, PAIRS, side="right")))
        t = small[at:upto]
        pairs = (nq * nc)[t]
        which = np.repeat(np.arange(len(t)), pairs)
        place = np.arange(len(which)) - np.repeat(np.cumsum(pairs) - pairs, pairs)
        q = rows.starts[t][which] + place // nc[t][which]
        c = rows.c_starts[t][which] + place % nc[t][which]
        keep = exact_dists(rows.v[q], rows.v[c]) <= eps
        yield q[keep], c[keep]
        at = upto
    for t in np.flatnonzero((nq > 0) & (nc > 0) & (nq * nc > MATRIX_PAIRS)):
        s, m, e = rows.starts[t], rows.c_starts[t], rows.ends[t]
        a, b = rows.v[s:rows.q_ends[t]], rows.v[m:e]
        ca, cb, error = centred(a, b)
        # pairs within the error of the expansion are decided by exact differences
        slack = 2 * error + 1e-12 * eps * eps
        step = max(1, PAIRS // len(b))
        for i in range(0, len(a), step):
            d2 = pairwise_sq_dists(ca[i:i + step], cb)
            q, c = np.nonzero(d2 <= eps * eps + slack)
            close = np.flatnonzero(np.abs(d2[q, c] - eps * eps) <= slack)
            keep = np.ones(len(q), bool)
            for k in range(0, len(close), PAIRS // max(1, a.shape[1])):
                p = close[k:k + PAIRS // max(1, a.shape[1])]
                keep[p] = exact_dists(a[i + q[p]], b[c[p]]) <= eps
            yield s + i + q[keep], m + c[keep]


def nearest_pairs(rows: Rows, k: int, exclude_self: bool) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query row, corpus row, distance): per tile and query the ``k`` nearest and
    all ties of the k-th distance."""
    for s, q_end, m, e in zip(rows.starts, rows.q_ends, rows.c_starts, rows.ends):
        if s == q_end or m == e:
            continue
        a, b = rows.v[s:q_end], rows.v[m:e]
        ca, cb, error = centred(a, b)
        step = max(1, PAIRS // (8 * len(b)))
        for i in range(0, len(a), step):
            d2 = pairwise_sq_dists(ca[i:i + step], cb)
            if exclude_self:
                d2[rows.id[s + i:s + i + len(d2), None] == rows.id[None, m:e]] = np.inf
            kk = min(k, d2.shape[1])
            kth = np.partition(d2, kk - 1, axis=1)[:, kk - 1]
            q, c = np.nonzero((d2 <= kth[:, None] + 2 * error) & np.isfinite(d2))
            yield s + i + q, m + c, exact_dists(a[i + q], b[c])


class Strips:
    """The corpus rows of one tile in at most three dimensions, for radius queries.

    Rows stand in strips by all coordinates but the last and are sorted by the
    last within a strip. For a query row and a strip there is an interval of
    rows that are near whatever their place in the strip, and a wider one
    outside which none is; only the rows between the two are compared. Equal
    rows are one row here. ``near`` is that of exact differences throughout.
    """

    def __init__(self, v: np.ndarray, eps: float, near_rows: float):
        self.eps, self.v = eps, v
        d = v.shape[1]
        fine = min(STRIPS[1], max(STRIPS[0], int(math.sqrt(0.04 * near_rows)))) if d == 2 else STRIPS[0] * 2
        self.width = eps / fine if eps > 0 else 1.0
        self.low = v.min(axis=0)
        self.lead = list(range(d - 1))
        strip = np.floor((v[:, :-1] - self.low[:-1]) / self.width).astype(np.int64)
        self.shape = strip.max(axis=0) + 1 if d > 1 else np.zeros(0, np.int64)
        slot = self._slot(strip)
        slots, at = np.unique(slot, return_inverse=True)
        order = np.lexsort((v[:, -1], at))
        self.order, at = order, at[order]
        self.sorted = v[order]
        start = np.searchsorted(at, np.arange(len(slots)))
        self.slots = slots
        self.lo = np.minimum.reduceat(self.sorted[:, :-1], start, axis=0)
        self.hi = np.maximum.reduceat(self.sorted[:, :-1], start, axis=0)
        self.span = float(v[:, -1].max() - self.low[-1]) + 6 * eps + 1.0
        self.key = at * self.span + (self.sorted[:, -1] - self.low[-1])
        self.slack = 1e-6 * eps + 16 * np.finfo(float).eps * (len(slots) + 1) * self.span
        grid = np.arange(-fine - 1, fine + 2)
        self.offsets = np.stack(np.meshgrid(*[grid] * (d - 1), indexing="ij"), axis=-1).reshape(-1, d - 1) if d > 1 else np.zeros((1, 0), np.int64)

    def _slot(self, strip: np.ndarray) -> np.ndarray:
        out = np.zeros(len(strip), np.int64)
        for k, n in enumerate(self.shape):
            out = out * n + strip[:, k]
        return out

    def near(self, q: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """(query row, first, end, pair query, pair corpus): whole intervals of sorted
        rows that are near, and single near rows, some at a time."""
        strip = np.floor((q[:, :-1] - self.low[:-1]) / self.width).astype(np.int64)
        x = q[:, -1] - self.low[-1]
        inside = (x >= -2 * self.eps) & (x <= self.span)
        for offset in self.offsets:
            to = strip + offset
            r = np.flatnonzero(inside & ((to >= 0) & (to < self.shape)).all(axis=1))
            if not len(r):
                continue
            slot = self._slot(to[r])
            s = np.minimum(np.searchsorted(self.slots, slot), len(self.slots) - 1)
            have = self.slots[s] == slot
            r, s = r[have], s[have]
            lo, hi, y = self.lo[s], self.hi[s], q[r, :-1]
            far = (np.maximum(np.abs(y - lo), np.abs(y - hi)) ** 2).sum(axis=1)
            close = (np.maximum(np.maximum(lo - y, y - hi), 0.0) ** 2).sum(axis=1)
            e2 = self.eps * self.eps
            meets = close <= e2 * (1 + 1e-9)
            r, s, far, close = r[meets], s[meets], far[meets], close[meets]
            if not len(r):
                continue
            outer = np.sqrt(np.maximum(e2 - close, 0.0)) + self.slack
            inner = np.sqrt(np.maximum(e2 - far, 0.0)) - self.slack
            middle = s * self.span + x[r]
            a, b = s * self.span - self.eps, s * self.span + self.span - 3 * self.eps      # a strip's own keys
            l0 = np.searchsorted(self.key, np.maximum(middle - outer, a), side="left")
            r0 = np.searchsorted(self.key, np.minimum(middle + outer, b), side="right")
            some = inner > 0
            l1, r1 = l0.copy(), l0.copy()
            l1[some] = np.searchsorted(self.key, np.maximum(middle - inner, a)[some], side="left")
            r1[some] = np.searchsorted(self.key, np.minimum(middle + inner, b)[some], side="right")
            r1 = np.maximum(l1, r1)
            found = r1 > l1
            whole = r[found], l1[found], r1[found]
            at, many = np.concatenate([l0, r1]), np.concatenate([l1 - l0, r0 - r1])
            rows = np.concatenate([r, r])
            some = many > 0
            at, many, rows = at[some], many[some], rows[some]
            total = np.cumsum(many)
            done = 0
            while done < len(many) or whole is not None:
                upto = done + max(1, int(np.searchsorted(total[done:] - (total[done - 1] if done else 0), PAIRS, side="right"))) if done < len(many) else done
                n = many[done:upto]
                c = np.repeat(at[done:upto], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                i = np.repeat(rows[done:upto], n)
                keep = exact_dists(q[i], self.sorted[c]) <= self.eps
                none = np.zeros(0, np.int64)
                yield *(whole or (none, none, none)), i[keep], c[keep]
                whole, done = None, upto


def large_tiles(rows: Rows, eps: float) -> np.ndarray:
    """The tiles for :class:`Strips`: few dimensions, and too many pairs to compare them all."""
    nq, nc = rows.q_ends - rows.starts, rows.ends - rows.c_starts
    return np.flatnonzero((nq * nc > MATRIX_PAIRS) & (0 < rows.v.shape[1] <= GRID_DIMS) & bool(np.isfinite(eps)))


def distinct_rows(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows and the distinct row of every row."""
    order = np.lexsort(v.T)
    new = np.concatenate([[True], (v[order][1:] != v[order][:-1]).any(axis=1)]) if len(v) else np.zeros(0, bool)
    at = np.empty(len(v), np.int64)
    at[order] = np.cumsum(new) - 1
    return v[order[new]], at


def block_squares(a: np.ndarray, b: np.ndarray, bound: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """Squared distances of two blocks against the ``bound`` of each query row, some query
    rows at a time: (first query row, values, low, high). Below ``low`` a value is surely
    within the bound, above ``high`` surely not; those between are for exact differences.
    Single precision with a bound on its error where that is fine enough, else double."""
    mean = (a.sum(axis=0) + b.sum(axis=0)) / (len(a) + len(b))
    a, b = a - mean, b - mean
    aa, bb = np.einsum("ij,ij->i", a, a), np.einsum("ij,ij->i", b, b)
    scale = 2.0 * (aa.max() + bb.max())
    error = 4.0 * (a.shape[1] + 4) * scale
    single = scale < 1e30 and error * 2.0 ** -24 <= 0.01 * np.median(bound)
    kind = np.float32 if single else np.float64
    slack = error * 2.0 ** (-24 if single else -53)
    # (-2 a, 1) (b, |b|^2) is the squared distance less |a|^2
    left = np.hstack([-2.0 * a, np.ones((len(a), 1))]).astype(kind)
    right = np.ascontiguousarray(np.hstack([b, bb[:, None]]).astype(kind).T)
    rest = bound - aa
    low, high = (rest - slack).astype(kind)[:, None], (rest + slack).astype(kind)[:, None]
    step = max(1, PAIRS // len(b))
    for i in range(0, len(a), step):
        yield i, left[i:i + step] @ right, low[i:i + step], high[i:i + step]


def within(a: np.ndarray, b: np.ndarray, eps: float) -> Iterator[tuple[int, np.ndarray]]:
    """(first query row, rows x corpus mask) of the pairs within ``eps``, some query rows at a time."""
    for s, d2, low, high in block_squares(a, b, np.full(len(a), eps * eps)):
        near = d2 < low
        open_pairs = np.flatnonzero((d2 <= high) ^ near)
        q, c = open_pairs // len(b), open_pairs % len(b)
        for k in range(0, len(q), max(1, PAIRS // a.shape[1])):
            i, j = q[k:k + max(1, PAIRS // a.shape[1])], c[k:k + max(1, PAIRS // a.shape[1])]
            near[i, j] = exact_dists(a[s + i], b[j]) <= eps
        yield s, near


def join_labels(root: np.ndarray, u: np.ndarray, v: np.ndarray) -> None:
    """Joins what the links (u, v) connect in ``root``, in place: every node has the smallest of its component."""
    u, v = root[u], root[v]
    while True:
        other = u != v
        if not other.any():
            return
        u, v = u[other], v[other]
        low = np.minimum(u, v)
        np.minimum.at(root, np.maximum(u, v), low)
        while True:                          # labels of labels, to the end of each chain
            jumped = root[root]
            if (jumped == root).all():
                break
            root[:] = jumped
        u, v = root[u], root[v]


def run_panels(query: DataFrame, corpus: DataFrame, panels: int, block_rows: int, work: Callable, schema: str, extra: list[str] | None = None) -> DataFrame:
    """Bring the rows of each panel meeting together. ``work(query)`` returns an object
    whose ``block(table)`` takes the corpus a block at a time and whose ``end()`` yields
    record batches. ``extra`` as in :func:`run_tiles`."""
    extra = extra or []

    def side(df, number):
        have = [F.col(c) if c in df.columns else F.lit(None).cast(dict((corpus if number == 0 else query).dtypes)[c]).alias(c) for c in extra]
        return df.select("t0", F.lit(number).alias("side"), "id", "v", *have)
    both = side(query, 0).unionByName(side(corpus, 1))
    dealt = both.repartitionById(panels, F.col("t0")).sortWithinPartitions("t0", "side")

    def run(batches):
        tile, held, n, state, number = None, [], 0, None, 0

        def flush():
            nonlocal held, n, state
            if held:
                table = pa.Table.from_batches(held).combine_chunks()
                if number == 0:
                    state = work(table)
                elif state is not None:
                    for i in range(0, table.num_rows, block_rows):
                        state.block(table.slice(i, block_rows))
            held, n = [], 0
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()], axis=1)
            cut = np.concatenate([[0], np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1, [len(keys)]])
            for s, e in zip(cut[:-1], cut[1:]):
                if (keys[s, 0], keys[s, 1]) != (tile, number):
                    flush()
                    if keys[s, 0] != tile:
                        if state is not None:
                            yield from state.end()
                        state = None
                    tile, number = keys[s, 0], keys[s, 1]
                held.append(batch.slice(s, e - s))
                n += e - s
                if number == 1 and n >= block_rows:
                    flush()
        flush()
        if state is not None:
            yield from state.end()
    return dealt.mapInArrow(run, schema)


def vectors(table: pa.Table) -> np.ndarray:
    flat = table.column("v").combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(table.num_rows, -1)


def run_tiles(query: DataFrame, corpus: DataFrame, summary: Callable[[Rows], Iterator[pa.RecordBatch]], schema: str,
              extra: list[str] | None = None) -> DataFrame:
    """Bring the rows of each tile together and apply ``summary`` to whole tiles.
    ``extra`` names further columns of the corpus (null on the query side) or of both."""
    extra = extra or []

    def side(df, number):
        have = [F.col(c) if c in df.columns else F.lit(None).cast(dict((corpus if number == 0 else query).dtypes)[c]).alias(c) for c in extra]
        return df.select(*TILE, F.lit(number).alias("side"), "id", "v", *have)
    return run_dealt(side(query, QUERY).unionByName(side(corpus, CORPUS)), summary, schema)


def run_dealt(rows: DataFrame, summary: Callable[[Rows], Iterator[pa.RecordBatch]], schema: str, n_rows: int = 0) -> DataFrame:
    """Apply ``summary`` to whole tiles of rows with their tile and ``side``; about ``n_rows``, if that is known."""
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), n_rows // PART_ROWS)
    dealt = rows.select(*TILE, "side", *[c for c in rows.columns if c not in (*TILE, "side")])
    dealt = dealt.repartition(parts, *TILE).sortWithinPartitions(*TILE, "side")

    def run(batches):
        held: list[pa.RecordBatch] = []
        n, last = 0, None
        for batch in batches:
            if batch.num_rows == 0:
                continue
            keys = [batch.column(k).to_numpy() for k in range(len(TILE))]
            new = np.zeros(batch.num_rows, bool)
            new[0] = last is not None and last != tuple(k[0] for k in keys)
            for k in keys:
                new[1:] |= k[1:] != k[:-1]
            last = tuple(k[-1] for k in keys)
            cut = np.flatnonzero(new)
            if len(cut) and n + cut[-1] >= BATCH_ROWS:        # all tiles but the last are whole
                at = int(cut[-1])
                yield from summary(Rows(pa.Table.from_batches([*held, batch.slice(0, at)])))
                held, n = [], 0
                batch = batch.slice(at)
            held.append(batch)
            n += batch.num_rows
        if held:
            yield from summary(Rows(pa.Table.from_batches(held)))
    return dealt.mapInArrow(run, schema)
