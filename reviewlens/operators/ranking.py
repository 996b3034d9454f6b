"""Exact rank selection and exact quantiles without a global sort (H2).

``row_number() over (partition by g order by k)`` and Spark's exact
``percentile`` both put a whole group into one task: a stratum holding a third
of all rows would be sorted (or buffered) by a single core. Here the value at
a given rank is found by *histogram narrowing* instead:

1. per target (group, rank): count/min/max of the ordering column in its region;
2. if the region is small (<= ``max_collect`` rows) collect just that region
   and pick the row exactly;
3. otherwise build an equal-width histogram of the region (a grouped
   aggregate with map-side combine, output <= ``buckets`` rows per target),
   keep the bucket containing the rank, and repeat.

Each pass scans the data once and shuffles only bucket counts. Bucket
membership is defined by the same monotone expression in every later pass,
so regions nest exactly. Ties on the first ordering column move the search to
the next ordering column, so a lexicographic order (key, tie-breakers) is
supported and the chosen row is unique when the order is total.
"""

from __future__ import annotations

import math
import os
import time
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass
class _Target:
    sid: int
    group: tuple
    rank: int                 # 0-based rank inside the current region
    path: tuple               # identifies the region: equal paths = identical regions
    cond: Column              # region predicate
    level: int = 0            # index of the ordering column being narrowed
    fixed: list = field(default_factory=list)   # values fixed for columns < level
    count: int | None = None
    lo: object = None
    hi: object = None
    result: tuple | None = None
    done: bool = False


# at most this many groups are narrowed together (CASE width per pass)
MAX_REGION_GROUPS = 256
# groups up to this size are handled by Spark's built-in exact aggregates /
# windows (their buffer per group is bounded by it); only larger groups are
# narrowed, and there are at most n / SMALL_GROUP_ROWS of those
SMALL_GROUP_ROWS = 2_000_000


def _collect(df: DataFrame, tag: str) -> list:
    if os.environ.get("REVIEWLENS_DEBUG"):
        t = time.time()
        r = df.collect()
        print(f"  [rank_select] {tag}: {len(r)} rows in {time.time() - t:.2f}s", flush=True)
        return r
    return df.collect()


def _group_cond(group_cols, g) -> Column:
    cond = F.lit(True)
    for c, v in zip(group_cols, g):
        cond = cond & F.col(c).eqNullSafe(F.lit(v))
    return cond


def _bucket_expr(col: str, lo, hi, buckets: int) -> Column:
    """Monotone bucket of a region [lo, hi], lo < hi, that always separates lo
    from hi, so every pass makes progress."""
    lo_d, hi_d = float(lo), float(hi)
    if not (math.isfinite(lo_d) and math.isfinite(hi_d)):
        # the infinities are end buckets of their own
        return F.when(F.col(col) == F.lit(-math.inf), F.lit(0)).when(F.col(col) == F.lit(math.inf), F.lit(2)).otherwise(F.lit(1))
    w = (hi_d - lo_d) / buckets
    if w <= 0 or not math.isfinite(w):
        # too close or too far apart for equal widths in doubles: halve the region exactly
        mid = lo + (hi - lo) // 2 if isinstance(lo, int) else lo / 2 + hi / 2
        mid = mid if lo <= mid < hi else lo
        return F.when(F.col(col) <= F.lit(mid), F.lit(0)).otherwise(F.lit(1))
    b = F.floor((F.col(col).cast("double") - F.lit(lo_d)) / F.lit(w))
    return F.least(F.greatest(b, F.lit(0)), F.lit(buckets - 1)).cast("int")


def _regions(states: list) -> dict:
    """path -> states; regions with different paths are disjoint."""
    reg: dict = {}
    for s in states:
        reg.setdefault(s.path, []).append(s)
    return reg


def _region_case(paths: list, reg: dict) -> Column:
    e = None
    for i, p in enumerate(paths):
        cond = reg[p][0].cond
        e = F.when(cond, F.lit(i)) if e is None else e.when(cond, F.lit(i))
    return e


def rank_select(df: DataFrame, order_cols: list[str], targets: list[tuple[tuple, int]],
                group_cols: list[str] | None = None, max_collect: int = 20_000,
                buckets: int = 4096, initial_stats: dict | None = None) -> dict[tuple[tuple, int], tuple | None]:
    """Return the ordering-column values of the row at each (group, rank).

    ``order_cols`` must be numeric (or castable to double monotonically, e.g.
    bigint); rows with NULL in any ordering column are ignored. Ranks are
    0-based; an out-of-range rank maps to ``None``. ``initial_stats`` may give
    ``{group: (count, min, max)}`` of the first ordering column to skip the
    first pass.
    """
    group_cols = list(group_cols or [])
    groups = list(dict.fromkeys(tuple(g) for g, _ in targets))
    if len(groups) > MAX_REGION_GROUPS:
        # bounded CASE width: process the groups in chunks (each chunk = its own passes)
        out: dict = {}
        for i in range(0, len(groups), MAX_REGION_GROUPS):
            chunk = set(groups[i:i + MAX_REGION_GROUPS])
            out.update(rank_select(df, order_cols, [t for t in targets if tuple(t[0]) in chunk], group_cols,
                                   max_collect, buckets,
                                   None if initial_stats is None else
                                   {g: v for g, v in initial_stats.items() if g in chunk}))
        return out
    base = df.select(*[F.col(c) for c in group_cols], *[F.col(c) for c in order_cols])
    for c in order_cols:
        base = base.where(F.col(c).isNotNull())
    states = []
    for i, (g, r) in enumerate(targets):
        st = _Target(i, tuple(g), int(r), (tuple(g),), _group_cond(group_cols, g))
        if initial_stats is not None:
            st.count, st.lo, st.hi = initial_stats.get(tuple(g), (0, None, None))
        states.append(st)
    for s in states:
        if s.rank < 0:
            s.done = True

    while True:           # each histogram pass shrinks a region ~``buckets``-fold
        pending = [s for s in states if not s.done]
        if not pending:
            break
        # 1) count / min / max of regions that lack them (one query per level)
        need = [s for s in pending if s.count is None]
        for level in sorted({s.level for s in need}):
            reg = _regions([s for s in need if s.level == level])
            paths = list(reg)
            col = order_cols[level]
            q = base.select(_region_case(paths, reg).alias("r"), F.col(col).alias("v")).where("r IS NOT NULL") \
                .groupBy("r").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            got = {r["r"]: r for r in _collect(q, "stats")}
            for i, p in enumerate(paths):
                r = got.get(i)
                for s in reg[p]:
                    s.count = 0 if r is None else r["n"]
                    s.lo, s.hi = (None, None) if r is None else (r["lo"], r["hi"])

        collect_now, hist_now = [], []
        for s in pending:
            if s.rank >= s.count:
                s.result, s.done = None, True
            elif s.count <= max_collect:
                collect_now.append(s)
            elif s.lo == s.hi:
                # all equal on this column: fix it, continue on the next column
                s.fixed.append(s.lo)
                s.cond = s.cond & (F.col(order_cols[s.level]) == F.lit(s.lo))
                s.path = s.path + (("eq", s.level),)
                s.level += 1
                if s.level == len(order_cols):
                    s.result, s.done = tuple(s.fixed), True
                else:
                    s.count = None
            else:
                hist_now.append(s)

        # 2) small regions: collect (ordering tuple, count) and pick exactly
        if collect_now:
            reg = _regions(collect_now)
            paths = list(reg)
            ocols = [f"o{j}" for j in range(len(order_cols))]
            q = base.select(_region_case(paths, reg).alias("r"),
                            *[F.col(c).alias(o) for c, o in zip(order_cols, ocols)]) \
                .where("r IS NOT NULL").groupBy("r", *ocols).count()
            by_r: dict[int, list] = {}
            for r in _collect(q, "region"):
                by_r.setdefault(r["r"], []).append((tuple(r[c] for c in ocols), r["count"]))
            for i, p in enumerate(paths):
                vals = sorted(by_r.get(i, []))
                for s in reg[p]:
                    acc, s.result = 0, None
                    for v, cnt in vals:
                        acc += cnt
                        if s.rank < acc:
                            s.result = v
                            break
                    s.done = True

        # 3) large regions: equal-width histogram, keep the bucket holding the rank
        for level in sorted({s.level for s in hist_now}):
            reg = _regions([s for s in hist_now if s.level == level])
            paths = list(reg)
            col = order_cols[level]
            bexpr = {p: _bucket_expr(col, reg[p][0].lo, reg[p][0].hi, buckets) for p in paths}
            rcase = _region_case(paths, reg)
            bcase = None
            for i, p in enumerate(paths):
                bcase = F.when(F.col("r") == i, bexpr[p]) if bcase is None else bcase.when(F.col("r") == i, bexpr[p])
            q = base.select(rcase.alias("r"), F.col(col)).where("r IS NOT NULL") \
                .select("r", bcase.alias("b"), F.col(col).alias("v")) \
                .groupBy("r", "b").agg(F.count("*").alias("n"), F.min("v").alias("lo"), F.max("v").alias("hi"))
            per: dict[int, list] = {}
            for r in _collect(q, "histogram"):
                per.setdefault(r["r"], []).append((r["b"], r["n"], r["lo"], r["hi"]))
            for i, p in enumerate(paths):
                hist = sorted(per.get(i, []))
                for s in reg[p]:
                    below, chosen = 0, None
                    for b, n, lo, hi in hist:
                        if s.rank < below + n:
                            chosen = (b, n, lo, hi)
                            break
                        below += n
                    b, n, lo, hi = chosen
                    s.cond = s.cond & (bexpr[p] == F.lit(b))
                    s.path = s.path + (("b", level, b),)
                    s.rank -= below
                    s.count, s.lo, s.hi = n, lo, hi

    return {(s.group, targets[s.sid][1]): s.result for s in states}


def exact_quantiles(df: DataFrame, value: str | Column, probs: list[float],
                    group_cols: list[str] | None = None, max_collect: int = 20_000,
                    buckets: int = 4096, known: tuple | None = None) -> dict[tuple, list[float | None]]:
    """Exact linearly interpolated quantiles (numpy 'linear' / DuckDB quantile_cont).

    Returns ``{group_tuple: [q(p) for p in probs]}``; NULL and NaN values are
    ignored; groups with no values are absent. With many groups, groups of at
    most SMALL_GROUP_ROWS rows use Spark's exact ``percentile`` (bounded
    buffers) and only the larger ones are narrowed (chunked).
    """
    group_cols = list(group_cols or [])
    vcol = value if isinstance(value, Column) else F.col(value)
    base = df.select(*[F.col(c) for c in group_cols], vcol.cast("double").alias("_qv"))
    base = base.where(F.col("_qv").isNotNull() & ~F.isnan("_qv"))
    aggs = [F.count("*").alias("count"), F.min("_qv").alias("lo"), F.max("_qv").alias("hi")]
    if known is not None and not group_cols:
        # (count, min, max) of the non-NULL, non-NaN values, already known
        counts = [{"count": known[0], "lo": known[1], "hi": known[2]}]
    else:
        counts = _collect(base.groupBy(*group_cols).agg(*aggs), "counts") if group_cols \
            else _collect(base.agg(*aggs), "counts")
    init = {tuple(r[c] for c in group_cols): (r["count"], r["lo"], r["hi"]) for r in counts}
    if not (group_cols and len(init) > MAX_REGION_GROUPS):
        return _narrow_quantiles(base, probs, group_cols, init, max_collect, buckets)
    big = {g: v for g, v in init.items() if v[0] > SMALL_GROUP_ROWS}
    out = {}
    small_df = base
    if big:
        bigdf = base.sparkSession.createDataFrame(list(big), base.select(*group_cols).schema)
        same = None            # NULL groups are groups like any other
        named = bigdf.toDF(*[f"_big_{c}" for c in group_cols])
        for c in group_cols:
            one = base[c].eqNullSafe(named[f"_big_{c}"])
            same = one if same is None else same & one
        small_df = base.join(named, same, "left_anti")
        out.update(_narrow_quantiles(base.join(named, same, "left_semi"), probs, group_cols, big,
                                     max_collect, buckets))
    res = small_df.groupBy(*group_cols).agg(F.percentile(F.col("_qv"), [float(p) for p in probs]).alias("q"))
    for r in res.collect():
        out[tuple(r[c] for c in group_cols)] = list(r["q"])
    return out


def _narrow_quantiles(base: DataFrame, probs, group_cols, init: dict, max_collect: int,
                      buckets: int) -> dict[tuple, list[float | None]]:
    targets, plan = [], {}
    for g, (n, _, _) in init.items():
        if n == 0:
            continue
        plan[g] = []
        for p in probs:
            pos = (n - 1) * float(p)
            lo_i = int(math.floor(pos))
            hi_i = min(lo_i + 1, n - 1)
            frac = pos - lo_i
            plan[g].append((lo_i, hi_i, frac))
            targets.extend([(g, lo_i), (g, hi_i)])
    targets = list(dict.fromkeys(targets))
    sel = rank_select(base, ["_qv"], targets, group_cols, max_collect, buckets, initial_stats=init)
    out = {}
    for g, items in plan.items():
        vals = []
        for lo_i, hi_i, frac in items:
            a = sel[(g, lo_i)][0]
            b = sel[(g, hi_i)][0]
            vals.append(a if (frac == 0 or a == b) else a + (b - a) * frac)
        out[g] = vals
    return out


def rank_threshold_filter(order_cols: list[str], threshold: tuple, inclusive: bool = True) -> Column:
    """Predicate ``(order_cols) <= threshold`` in lexicographic order."""
    expr = None
    for i in range(len(order_cols) - 1, -1, -1):
        c, t = F.col(order_cols[i]), F.lit(threshold[i])
        if expr is None:
            expr = (c <= t) if inclusive else (c < t)
        else:
            expr = (c < t) | ((c == t) & expr)
    return expr
