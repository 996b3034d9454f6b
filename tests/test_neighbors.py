"""Grid, blocked and hashed neighbour joins against numpy over all pairs."""

import re
import threading
import time
from concurrent.futures import ThreadPoolExecutor

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens.operators import neighbors as N
from reviewlens.operators import tiles
from reviewlens.operators.components import connected_components
from reviewlens.operators.dbscan import dbscan
from reviewlens import session
from reviewlens.session import materialize


def frame(spark, X, ids=None, **cols):
    ids = range(len(X)) if ids is None else ids
    rows = [(int(i), [float(x) for x in v], *[c[k] for c in cols.values()]) for k, (i, v) in enumerate(zip(ids, X))]
    types = {"flag": "boolean", "label": "long"}
    return spark.createDataFrame(rows, "row_id long, features array<double>" + "".join(f", {c} {types[c]}" for c in cols)).repartition(4)


def dists(A, B):
    return np.sqrt(((A[:, None, :] - B[None, :, :]) ** 2).sum(-1))


def points(kind, d, n=160):
    rng = np.random.default_rng(d)
    if kind == "spread":
        return rng.uniform(-4, 4, (n, d))
    if kind == "integers":                       # many pairs exactly eps apart
        return rng.integers(-3, 4, (n, d)).astype(float)
    if kind == "hot":                            # two thirds of all rows in one cell, many equal
        return np.vstack([np.full((n // 3, d), 0.5), rng.uniform(0, 0.9, (n // 3, d)), rng.uniform(-30, 30, (n // 3, d))])
    return rng.uniform(-2, 2, (n, d)) + 1e7      # far from the origin


@pytest.mark.parametrize("mode", N.MODES)
@pytest.mark.parametrize("kind,d", [("spread", 1), ("spread", 2), ("integers", 3), ("hot", 2), ("far", 2), ("spread", 5)])
def test_radius_against_all_pairs(spark, mode, kind, d):
    X = points(kind, d)
    flag, label = [k % 3 == 0 for k in range(len(X))], [(k * 7) % 31 for k in range(len(X))]
    df = frame(spark, X, flag=flag, label=label)
    got = {r["id"]: tuple(r)[1:] for r in N.radius_counts(df, df, 1.0, flag_col="flag", label_col="label", block_rows=20, mode=mode).collect()}
    near = dists(X, X) <= 1.0
    want = {i: (int(near[i].sum()), int((near[i] & flag).sum()), min((label[j] for j in np.flatnonzero(near[i] & flag)), default=None))
            for i in range(len(X))}
    assert got == want


@pytest.mark.parametrize("mode", N.MODES)
def test_sides_of_different_size(spark, mode):
    Q, C = points("spread", 2, 300), points("integers", 2, 7)
    got = {r["id"]: r["n_within"] for r in N.radius_counts(frame(spark, Q), frame(spark, C), 1.5, block_rows=16, mode=mode).collect()}
    assert got == {i: int(n) for i, n in enumerate((dists(Q, C) <= 1.5).sum(1))}       # rows with nothing near, too
    empty = frame(spark, C).limit(0)
    assert {r["n_within"] for r in N.radius_counts(frame(spark, Q), empty, 1.5, mode=mode).collect()} == {0}
    assert N.radius_counts(empty, frame(spark, Q), 1.5, mode=mode).count() == 0


@pytest.mark.parametrize("mode", N.MODES)
def test_radius_zero_and_bad_arguments(spark, mode):
    X = points("integers", 2)
    got = {r["id"]: r["n_within"] for r in N.radius_counts(frame(spark, X), frame(spark, X), 0.0, mode=mode).collect()}
    assert got == {i: int(n) for i, n in enumerate((dists(X, X) == 0).sum(1))}
    for bad in ({"eps": -1.0}, {"eps": float("nan")}, {"eps": 1.0, "mode": "tree"}):
        with pytest.raises(ValueError):
            N.radius_counts(frame(spark, X), frame(spark, X), **({"mode": mode} | bad))


def test_grid_meets_adjacent_cells_only(spark):
    """A long line of points: the tiles hold a few rows per row, not all pairs."""
    X = np.arange(2000.0)[:, None]
    df = frame(spark, X).select(F.col("row_id").alias("id"), F.col("features").alias("v"))
    from reviewlens.operators.tiles import block_tiles, grid_tiles
    q, c = grid_tiles(df, df, 1.0, 1, 256)
    pairs = q.groupBy("t0", "t1", "t2", "tq", "tc").count().join(
        c.groupBy("t0", "t1", "t2", "tq", "tc").agg(F.count("*").alias("n")), ["t0", "t1", "t2", "tq", "tc"])
    assert pairs.agg(F.sum(F.col("count") * F.col("n"))).first()[0] < 8 * len(X)
    q, _ = block_tiles(df, df, 256, 2000, 2000)
    assert q.groupBy("tq").count().agg(F.max("count")).first()[0] > 0


def test_no_tile_is_larger_than_its_parts(spark):
    """10 corpus rows and 4000 query rows: the query side is cut as well."""
    from reviewlens.operators.tiles import block_tiles, grid_tiles
    X = np.zeros((4000, 2))
    df = frame(spark, X).select(F.col("row_id").alias("id"), F.col("features").alias("v"))
    few = df.where("id < 10")
    for q, c in (block_tiles(df, few, 512, 4000, 10), grid_tiles(df, few, 1.0, 2, 512)):
        assert q.groupBy("t0", "t1", "t2", "tq", "tc").count().agg(F.max("count")).first()[0] < 800
        assert c.count() >= 10


def brute_dbscan(X, eps, least):
    near = dists(X, X) <= eps
    core = near.sum(1) >= least
    label = np.where(core, np.arange(len(X)), len(X))
    while True:
        new = np.where(core, np.where(near & core[None, :], label[None, :], len(X)).min(1), label)
        if (new == label).all():
            break
        label = new
    out = {}
    for i in range(len(X)):
        around = label[near[i] & core]
        c = int(label[i]) if core[i] else int(around.min()) if len(around) else None
        out[i] = (int(near[i].sum()), bool(core[i]), c, not core[i] and len(around) == 0)
    return out


@pytest.mark.parametrize("kind,d,eps,least", [("spread", 2, 0.7, 4), ("integers", 2, 1.0, 5), ("hot", 3, 0.6, 6), ("spread", 4, 1.6, 4)])
def test_dbscan_against_brute_force(spark, kind, d, eps, least):
    X = points(kind, d)
    for mode in N.MODES:
        r = dbscan(frame(spark, X), vector="features", eps=eps, min_samples=least, scale=False, block_rows=32, mode=mode)
        assert {t[0]: tuple(t)[1:] for t in r.labels.collect()} == brute_dbscan(X, eps, least)
        assert r.rounds == 2
    flags = dbscan(frame(spark, X), vector="features", eps=eps, min_samples=least, scale=False, with_clusters=False).labels
    assert {t["id"]: t["is_anomaly"] for t in flags.collect()} == {i: t[3] for i, t in brute_dbscan(X, eps, least).items()}


def test_dbscan_of_a_long_shuffled_chain(spark):
    rng = np.random.default_rng(0)
    order = rng.permutation(1500)
    X = (order + 100 * (order // 500)).astype(float)[:, None]
    r = dbscan(frame(spark, X), vector="features", eps=1.0, min_samples=2, scale=False, block_rows=64)
    got = {t["id"]: t["cluster"] for t in r.labels.collect()}
    first = {g: int(min(i for i in range(1500) if order[i] // 500 == g)) for g in range(3)}
    assert got == {i: first[order[i] // 500] for i in range(1500)} and r.rounds == 2


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 300) if i % 50] + [(7, 7), (900, 800)]
    got = {r["id"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for i in range(1, 301):
        want[i] = next(s for s in range(i, 0, -1) if s == 1 or (s - 1) % 50 == 0 and s - 1 > 0)
    assert got == {i: r for i, r in want.items()} | {900: 800, 800: 800}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def clustered(n=1200, d=16):
    rng = np.random.default_rng(4)
    centres = rng.normal(0, 10, (24, d))
    return centres[rng.integers(0, 24, n)] + rng.normal(0, 1, (n, d))


def test_approximate_neighbours(spark):
    X = clustered()
    df = frame(spark, X).persist()
    found = N.knn_join_approx(df, df, 5, tables=8, rows_per_bucket=100, block_rows=128).persist()
    rows = found.collect()
    D = dists(X, X)
    np.fill_diagonal(D, np.inf)
    assert len(rows) == 5 * len(X) and {(r["id"], r["rank"]) for r in rows} == {(i, k) for i in range(len(X)) for k in range(1, 6)}
    assert all(abs(r["dist"] - D[r["id"], r["neighbor_id"]]) < 1e-9 for r in rows)
    true = {(i, int(j)) for i in range(len(X)) for j in np.argsort(D[i])[:5]}
    recall = len(true & {(r["id"], r["neighbor_id"]) for r in rows}) / len(true)
    assert recall >= 0.9
    measured = N.knn_recall(found, df, df, 5, sample_rows=len(X)).first()
    assert measured["n_queries"] == len(X) and abs(measured["recall"] - recall) < 1e-9


def test_approximate_mode_compares_fewer_rows(spark):
    from reviewlens.operators.tiles import hash_tiles
    df = frame(spark, clustered())
    planes = N.hash_planes(df, "features", 8, 4)
    side = df.select(F.col("row_id").alias("id"), F.col("features").alias("v"))
    q, c = hash_tiles(side, side, planes, 4096)
    key = ["t0", "t1", "t2", "tq", "tc"]
    pairs = q.groupBy(*key).count().join(c.groupBy(*key).agg(F.count("*").alias("n")), key).agg(F.sum(F.col("count") * F.col("n"))).first()[0]
    assert pairs < 0.8 * 1200 * 1200


def test_rows_that_meet_too_few_are_joined_exactly(spark):
    X = np.vstack([np.zeros((40, 3)), [[50.0, 0, 0], [0, 50.0, 0], [0, 0, -50.0]]])
    df = frame(spark, X)
    rows = N.knn_join_approx(df, df, 4, tables=1, bits=6, block_rows=16).collect()
    assert sorted((r["id"], r["rank"]) for r in rows) == [(i, k) for i in range(43) for k in range(1, 5)]
    exact = {(r["id"], r["rank"]): r["dist"] for r in N.knn_join(df, df, 4, block_rows=16).collect()}
    assert all(abs(exact[r["id"], r["rank"]] - r["dist"]) < 1e-9 for r in rows if r["id"] >= 40)
    assert N.knn_join_approx(df.limit(0), df, 4).count() == 0 and N.knn_join_approx(df, df.limit(0), 4).count() == 0


def test_panels_send_few_rows_and_keep_one_summary(spark):
    """A panel takes many blocks: rows are copied per panel and not per block, and a row has
    k candidates per panel, where it had k per block."""
    from reviewlens.operators.tiles import panel_tiles
    X = np.random.default_rng(6).normal(size=(3000, 8))
    df = frame(spark, X)
    side = df.select(F.col("row_id").alias("id"), F.col("features").alias("v"))
    q, c, panels = panel_tiles(side, side, 64, 8, 3000, 3000)
    assert q.count() + c.count() <= 3000 * (2 * panels ** 0.5 + 2) < 3000 * 2 * (3000 // 64)
    assert N._panel_top_k(side, side, 3, 8, True, 64, 3000, 3000).count() <= 3 * q.count()
    got = {(r["id"], r["rank"]): r["neighbor_id"] for r in N.knn_join(df, df, 3, block_rows=64).collect()}
    D = dists(X, X)
    np.fill_diagonal(D, np.inf)
    assert got == {(i, k + 1): int(j) for i in range(3000) for k, j in enumerate(np.argsort(D[i], kind="stable")[:3])}


def test_equal_rows_are_compared_once(spark):
    """2000 rows at 20 places: neighbours by smallest id, from a few rows of each place."""
    X = (np.arange(2000) % 20).astype(float)[:, None]
    df = frame(spark, X)
    met = []
    plain, N.panel_tiles = N.panel_tiles, lambda q, c, *a: met.append((q.count(), c.count())) or plain(q, c, *a)
    try:
        got = {(r["id"], r["rank"]): (r["neighbor_id"], r["dist"]) for r in N.knn_join(df, df, 3, block_rows=64).collect()}
    finally:
        N.panel_tiles = plain
    assert met == [(20, 80)]
    assert got == {(i, k): (j, 0.0) for i in range(2000)
                   for k, j in enumerate([x for x in range(i % 20, 100, 20) if x != i][:3], 1)}


def test_strips_compare_few_pairs_of_a_dense_tile(spark):
    """Counts in a dense plane: most near rows are counted in whole intervals."""
    from reviewlens.operators.tiles import Strips, exact_dists
    rng = np.random.default_rng(8)
    X = np.round(rng.uniform(0, 4, (6000, 2)), 2)
    strips = Strips(X, 1.0, 1000)
    n, single = np.zeros(len(X), int), 0
    for r, first, end, i, _ in strips.near(X):
        n += np.bincount(r, end - first, len(X)).astype(int) + np.bincount(i, minlength=len(X))
        single += len(i)
    want = np.array([(exact_dists(np.repeat(x[None], len(X), 0), X) <= 1.0).sum() for x in X])
    assert (n == want).all() and single < 0.3 * want.sum()
    df = frame(spark, X)
    got = {r["id"]: r["n_within"] for r in N.radius_counts(df, df, 1.0, mode="grid").collect()}
    assert got == dict(enumerate(want.tolist()))


@pytest.mark.parametrize("kind,d,cut", [("hot", 2, 100), ("hot", 1, 16), ("integers", 2, 16), ("spread", 3, 16)])
def test_rows_of_one_frame_in_cut_cells(spark, monkeypatch, kind, d, cut):
    """Cells as wide as eps, and those of more than a few rows cut on both sides."""
    monkeypatch.setattr(tiles, "GRID_ROWS", cut)
    monkeypatch.setattr(tiles, "CELL_ROWS", (1, 1))
    X = points(kind, d, 420)
    X[-1] = 1e5                                  # a row with nothing near
    flag, label = [k % 3 == 0 for k in range(len(X))], [(k * 7) % 31 for k in range(len(X))]
    df = frame(spark, X, flag=flag, label=label)
    got = {r["id"]: tuple(r)[1:] for r in N.radius_counts(df, df, 0.7, flag_col="flag", label_col="label", block_rows=1, mode="grid").collect()}
    near = dists(X, X) <= 0.7
    assert got == {i: (int(near[i].sum()), int((near[i] & flag).sum()), min((label[j] for j in np.flatnonzero(near[i] & flag)), default=None))
                   for i in range(len(X))}
    r = dbscan(df, vector="features", eps=0.7, min_samples=4, scale=False, block_rows=1, mode="grid")
    assert {t[0]: tuple(t)[1:] for t in r.labels.collect()} == brute_dbscan(X, 0.7, 4)


def test_dense_rows_stand_in_few_tiles(spark, monkeypatch):
    """2500 rows in a square of eps: cells are wide all the same, and a row is dealt about once."""
    n, met = 1_000_000, []
    side = (n / 2500) ** 0.5
    df = spark.range(n).select(F.col("id").alias("row_id"), F.array(F.rand(1) * side, F.rand(2) * side).alias("features"))

    def deal(*args, **_):
        frames = [a for a in args if hasattr(a, "rdd")]
        met.append(sum(f.count() for f in frames))
        return spark.createDataFrame([], next(a for a in args if isinstance(a, str)))
    for name in ("run_tiles", "run_dealt"):
        monkeypatch.setattr(N, name, deal, raising=False)
    N.radius_counts(df, df, 1.0, mode="grid")
    assert n <= met[0] < 2.5 * n


def test_written_tables_drop_their_shuffles(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key)
    df = spark.range(100_000).selectExpr("xxhash64(id) AS k").groupBy("k").count()
    statuses = spark.sparkContext._jsc.sc().env().mapOutputTracker().shuffleStatuses()
    had = statuses.keySet().toString()
    table = materialize(df, drop_shuffles=True)
    until = time.time() + 20
    while (left := set(re.findall(r"\d+", statuses.keySet().toString())) - set(re.findall(r"\d+", had))) and time.time() < until:
        time.sleep(0.2)
    assert not left and spark.conf.get(key) == before and table.count() == 100_000


def test_dbscan_joins_shared_points_only_and_frees_its_tables(spark, monkeypatch):
    """One dense cluster over many tiles: components are joined by few links, and what is left are the tables that labels read."""
    monkeypatch.setattr(tiles, "CELL_ROWS", (400, 400))
    X, links = np.random.default_rng(5).uniform(0, 20, (6000, 2)), []
    plain = connected_components
    monkeypatch.setattr("reviewlens.operators.dbscan.connected_components", lambda edges: links.append(edges.count()) or plain(edges))
    df = materialize(frame(spark, X))
    had = set(session._SCRATCH[spark.sparkContext.applicationId])
    written = []
    monkeypatch.setattr("reviewlens.operators.dbscan.materialize", lambda t, **k: written.append(t.columns) or materialize(t, **k))
    labels = dbscan(df, vector="features", eps=1.0, min_samples=3, scale=False).labels
    assert ["id", "features"] not in written                # a stored table is not stored again
    assert len(set(session._SCRATCH[spark.sparkContext.applicationId]) - had) <= 3
    assert {r["cluster"] for r in labels.select("cluster").distinct().collect()} == {0} and labels.count() == len(X)
    assert 0 < links[0] < len(X) / 20


def test_steps_in_other_threads_keep_their_tables(spark):
    """A scope that ends frees the tables of its own thread only."""
    def step(k):
        with session.scratch_scope(spark):
            materialize(spark.range(k + 5))
            both.wait()                                  # the scope of one ends while the other has tables
            if k:
                ended.wait()
            kept = materialize(spark.range(k + 10), drop_shuffles=True) if k else None
            n = kept.count() if k else materialize(spark.range(3)).count()
        ended.set()
        return n
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, both, ended = spark.conf.get(key), threading.Barrier(2), threading.Event()

    def table(k):
        both.wait()
        t = materialize(spark.range(7))                  # of a thread without a scope
        ended.wait()
        return t.count()
    with ThreadPoolExecutor(2) as pool:
        assert [f.result(60) for f in (pool.submit(step, 0), pool.submit(table, 1))] == [3, 7]
        both, ended = threading.Barrier(2), threading.Event()
        assert [f.result(60) for f in (pool.submit(step, 0), pool.submit(step, 1))] == [3, 11]
    assert spark.conf.get(key) == before
