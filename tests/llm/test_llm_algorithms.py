"""Frequent items, seen keys, digests and density clusters against brute force."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from cellwise.llm import density as C
from cellwise.llm import digests as D
from cellwise.llm import heavy_hitters as H
from cellwise.llm import peel
from cellwise.llm import seen_keys as S
from cellwise.llm.histogram_check import wrong_histograms


def zipf_rows(n, seed, groups=1):
    rng = random.Random(seed)
    return [(rng.randrange(groups), int(rng.paretovariate(0.7)) % 5000, rng.choice([1, 1, 2, 9])) for _ in range(n)]


def test_summary_bounds_hold_at_any_merge_order():
    rng = np.random.default_rng(1)
    h = rng.zipf(1.3, 20_000).astype(np.int64) % 3000
    w = rng.integers(1, 5, len(h))
    exact = Counter()
    for k, n in zip(h.tolist(), w.tolist()):
        exact[k] += n
    parts = []
    for i in range(7):
        s = H.Summary(50)
        for j in range(3):
            rows = slice((i * 3 + j) * 900, (i * 3 + j + 1) * 900)
            s.add(np.zeros(len(h[rows]), np.int64), h[rows], w[rows])
        parts.append(s.frame(0))
    exact = Counter()
    for k, n in zip(h[: 7 * 2700].tolist(), w[: 7 * 2700].tolist()):
        exact[k] += n
    import pandas as pd

    merged = H._merge_frame(pd.concat([H._merge_frame(pd.concat(parts[:3]), 50, 1), H._merge_frame(pd.concat(parts[3:]), 50, 1)]), 50, 1)
    head = merged[merged.total >= 0].iloc[0]
    total = sum(exact.values())
    assert head.total == total and head.floor <= total / 50
    items = merged[merged.total < 0]
    assert len(items) <= 50
    tracked = set(items.h)
    for r in items.itertuples():
        assert r.low <= exact[r.h] <= r.up
    assert all(n <= head.floor for k, n in exact.items() if k not in tracked)


@pytest.mark.parametrize("max_groups", [1, None])
def test_frequent_items(spark, max_groups):
    groups = 1 if max_groups else 3
    rows = zipf_rows(6000, 2, groups)
    totals, whole = Counter(), Counter()
    for g, k, n in rows:
        totals[g, k] += n
        whole[g] += n
    dirty = [(None, 1, 5), (0, None, 5), (0, 1, None), (0, 1, 0), (0, 1, -3)]
    df = spark.createDataFrame(rows + dirty, "g bigint, k bigint, w int").withColumn("total", F.lit("clash")).repartition(9)
    got = H.frequent_items(df, {"g": F.col("g"), "k": F.col("k")}, F.col("w"), 0.02, 64, group=["g"] if groups > 1 else [], max_groups=max_groups)
    if groups == 1:
        whole = defaultdict(lambda: sum(totals.values()))
    found = {(r.g, r.k): r.total for r in got.collect()}
    assert found == {k: n for k, n in totals.items() if n >= 0.02 * whole[k[0]]}
    for r in got.collect():
        assert r.low <= r.total <= r.up and r.group_total == whole[r.g]
    assert H.frequent_items(df.limit(0), {"k": F.col("k")}, F.col("w"), 0.5, 8).count() == 0
    with pytest.raises(ValueError, match="share"):
        H.frequent_items(df, {"k": F.col("k")}, F.col("w"), 0.01, 64)


def test_many_candidates_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(H, "BROADCAST_ROWS", 0)
    df = spark.createDataFrame([(i % 5, i % 3, 1) for i in range(300)], "g int, k int, w int")
    got = H.frequent_items(df, {"g": F.col("g"), "k": F.col("k")}, F.col("w"), 0.2, 16, group=["g"], max_groups=None)
    assert {(r.g, r.k): r.total for r in got.collect()} == {(g, k): 20 for g in range(5) for k in range(3)}


@pytest.mark.parametrize("n", [0, 1, 2, 100, 20_000])
def test_peeling_filters(n):
    rng = np.random.default_rng(n)
    keys, others = rng.integers(-(2**63), 2**63 - 1, n), rng.integers(-(2**63), 2**63 - 1, 300_000)
    built = peel.build(np.concatenate((keys, keys[:5])))
    assert peel.probe(keys, *built).all()
    assert peel.probe(others, *built).mean() < 4 * peel.RATE + 1e-5


def test_seen_keys(spark, monkeypatch):
    monkeypatch.setattr(S, "SHARD_KEYS", 40)
    monkeypatch.setattr(peel, "BITS", 16)
    rng = random.Random(4)
    rows = [(i, rng.choice([1, 1, 1, rng.randrange(60)]), rng.choice([7, None]) if i % 50 == 0 else 7, rng.randrange(30), rng.randrange(3)) for i in range(800)]
    rows += [(5000, 1, 7, None, None), (5001, 999, 7, None, None)]
    df = spark.createDataFrame(rows, "id bigint, a int, b int, day int, o int").withColumn("_h", F.lit("clash"))
    key = {"a": F.col("a"), "b": F.col("b")}
    at = F.struct("day", "o")
    history = S.build_history(df, key, F.col("day"), at, F.col("id"))
    assert history.shards > 1
    new, checked = S.first_rows(history)
    first = {}
    for i, a, b, day, o in rows:
        if b is not None:
            k = (-1 if day is None else day, -1 if o is None else o, i)
            first[a] = min(first.get(a, k), k)
    assert {r.row_id for r in new.collect()} == {v[2] for v in first.values()}
    report = S.error_report(history).collect()
    assert all(r.n_wrong <= r.n_positive <= r.n_keys and r.n_filters <= 5 and r.error_bound < 1e-3 for r in report)
    asked = spark.createDataFrame([(1, 1, 7), (2, 12345, 7), (3, 1, None), (3, 1, None)], "i int, a int, b int")
    here = S.present(history, asked, key, {"i": F.col("i")})
    assert {(r.i, r.present) for r in here.collect()} == {(1, True), (2, False), (3, False)}
    empty = S.build_history(df.limit(0), key, F.col("day"), at, F.col("id"))
    assert S.first_rows(empty)[0].count() == 0
    assert {r.present for r in S.present(empty, asked, key, {"i": F.col("i")}).collect()} == {False}


def test_a_wrong_filter_answer_is_corrected(spark, monkeypatch):
    monkeypatch.setattr(peel, "probe", lambda h, *a: np.ones(len(h), bool))
    df = spark.createDataFrame([(i, i % 20, i // 25) for i in range(100)], "id bigint, k int, day int")
    history = S.build_history(df, {"k": F.col("k")}, F.col("day"), F.col("id"), F.col("id"))
    assert S.first_rows(history)[0].count() == 20


def test_digest_bounds_and_quantiles(spark):
    rng = random.Random(5)
    rows = [(g, rng.choice([0.0, rng.gauss(0, 1), rng.expovariate(1) * 10**g])) for g in (0, 1, 2) for _ in range(3000)]
    rows += [(None, 1.0), (None, 2.0), (3, None), (3, float("nan")), (3, float("inf")), (4, 7.0), (5, 3.0), (5, 3.0)]
    df = spark.createDataFrame(rows, "g int, v double").withColumn("mean", F.lit("clash")).repartition(7)
    groups = {"g": F.col("g")}
    d = D.digest(df, F.col("v"), groups).cache()
    by = defaultdict(list)
    for g, v in rows:
        if v is not None and math.isfinite(v):
            by[g].append(v)
    assert {r.g: r.n for r in d.groupBy("g").agg(F.sum("weight").alias("n")).collect()} == {g: len(v) for g, v in by.items()}
    assert d.groupBy("g").count().agg(F.max("count")).first()[0] <= D.DELTA + 1
    cuts = spark.createDataFrame([(g, c) for g in by for c in (0.0, 0.5, 3.0)], "g int, c double")
    for r in D.rank_bounds(d, ["g"], cuts, "c", []).collect():
        below, upto = sum(v < r.c for v in by[r.g]), sum(v <= r.c for v in by[r.g])
        assert r.below_min <= below <= r.below_max and r.upto_min <= upto <= r.upto_max
    for r in D.count_ranks(df, F.col("v"), groups, cuts, "c").collect():
        assert (r.n_below, r.n_at_or_below, r.n_all) == (sum(v < r.c for v in by[r.g]), sum(v <= r.c for v in by[r.g]), len(by[r.g]))
    for r in D.certified(df, F.col("v"), groups, (0.1, 0.5, 0.99)).collect():
        limit = 0.03 if r.n > 100 else 0.5
        assert r.rank_error <= limit
        assert r.n_below == sum(v < r.estimate for v in by[r.g])
    merged = {r.q: r.estimate for r in D.quantiles(D.merge(d, []), [], (0.5,)).collect()}
    every = sorted(v for vs in by.values() for v in vs)
    assert abs(sum(v <= merged[0.5] for v in every) / len(every) - 0.5) < 0.2  # a third of all are 0
    assert D.digest(df.limit(0), F.col("v"), groups).count() == 0


def test_wrong_histograms(spark):
    rng = random.Random(6)
    values = [(s, g, rng.gauss(g, 1)) for g in (0, 1) for s in range(400)]
    values += values[:50] + [(900, 0, None), (901, 1, float("nan"))]
    v = spark.createDataFrame(values, "s bigint, g int, v double")
    good = [{"x": float(x), "y": sum(1 for s, g, w in values[:400] if x - 0.125 < w <= x + 0.125)} for x in np.arange(-4, 4.1, 0.25)]
    rng.shuffle(good)
    scaled = [{"x": b["x"], "y": b["y"] * 7} for b in good]
    wrong = [{"x": b["x"] + 2, "y": b["y"]} for b in good]
    hs = [(1, 0, good), (2, 0, scaled), (3, 0, wrong), (3, 0, wrong), (4, 0, None), (5, 0, []), (6, 9, good), (7, 0, [{"x": 0.0, "y": 0}]), (8, 0, [{"x": None, "y": 1}])]
    h = spark.createDataFrame(hs, "h bigint, g int, bins array<struct<x double, y int>>")
    got = wrong_histograms(h, F.col("h"), F.col("bins"), v, F.col("s"), F.col("v"), {"g": "g"})
    assert {r._id for r in got.collect()} == {3}
    assert wrong_histograms(h.limit(0), F.col("h"), F.col("bins"), v, F.col("s"), F.col("v"), {"g": "g"}).count() == 0
    assert wrong_histograms(h, F.col("h"), F.col("bins"), v.limit(0), F.col("s"), F.col("v"), {"g": "g"}).count() == 0


def brute_components(points, radius):
    top = list(range(len(points)))

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for i, (r, _, x) in enumerate(points):
        for j in range(i):
            s, _, y = points[j]
            if r == s and len(x) == len(y) and math.dist(x, y) <= radius:
                top[find(i)] = find(j)
    groups = defaultdict(set)
    for i, (r, e, _) in enumerate(points):
        groups[find(i)].add((r, e))
    return groups.values()


@pytest.mark.parametrize(("finish", "tile"), [(20_000, 1500), (0, 30), (40, 30)])
def test_connected_clusters(spark, monkeypatch, finish, tile):
    monkeypatch.setattr(C, "TILE_POINTS", tile)
    rng = random.Random(7)
    points, n = [], 0
    for run, d in ((1, 2), (2, 3)):
        for _ in range(6):
            c = [rng.uniform(-1, 1) for _ in range(d)]
            for _ in range(rng.randint(2, 30)):
                n += 1
                points.append((run, n, [v + rng.gauss(0, 0.02) for v in c]))
        copy = points[-1][2]
        for _ in range(60):  # one vector with many copies
            n += 1
            points.append((run, n, list(copy)))
    df = spark.createDataFrame([(r, e, x, "clash") for r, e, x in points], "run int, e bigint, x array<double>, node string")
    got = C.connected(df, F.col("run"), F.col("e"), F.col("x"), 0.05, 4, finish_edges=finish)
    found = defaultdict(set)
    for r in got.collect():
        found[r.cluster_id].add(r.element)
    wanted = {min(e for _, e in g): {e for _, e in g} for g in brute_components(points, 0.05) if len(g) >= 4}
    assert dict(found) == wanted
    assert C.connected(df.limit(0), F.col("run"), F.col("e"), F.col("x"), 0.05, 4).count() == 0


def test_tiles_break_ties_alike():
    """Points of a lattice, whose distances tie: the forests of tiles with rows in any order join what all near pairs join."""
    rng = np.random.default_rng(12)
    radius, side = 0.02, 0.04
    cells = np.argwhere(rng.random((60, 60)) < 0.6)
    x, node = cells / 64, rng.permutation(len(cells))
    at = {tuple(c): i for c, i in zip(cells.tolist(), node.tolist(), strict=True)}
    pairs = [(i, at[n]) for (a, b), i in at.items() for n in ((a + 1, b), (a, b + 1)) if n in at]
    low, high = np.floor((x - radius) / side).astype(int), np.floor((x + radius) / side).astype(int)
    edges = []
    for tile in {(a, b) for (a, b) in np.floor(x / side).astype(int).tolist()}:
        inside = rng.permutation(np.flatnonzero(((low <= tile) & (tile <= high)).all(axis=1)))
        home = (np.floor(x[inside] / side).astype(int) == tile).all(axis=1)
        rows = {"run": 1, "node": node[inside], "x": list(x[inside]), "mult": 1, "core": 0.0, "tile": 0, "home": home}
        got = C._tile_forest(radius)(pd.DataFrame(rows))
        edges += list(zip(got["u"].tolist(), got["v"].tolist(), strict=True))

    def components(links):
        top = list(range(len(node)))

        def find(a):
            while top[a] != a:
                top[a] = top[top[a]]
                a = top[a]
            return a

        for u, v in links:
            top[find(u)] = find(v)
        return len({find(i) for i in range(len(node))})

    assert components(edges) == components(pairs)


def brute_forest(points, core, radius):
    edges = sorted((max(math.dist(a, b), core[i], core[j]), i, j) for i, a in enumerate(points) for j, b in enumerate(points[:i]))
    top, out = list(range(len(points))), []

    def find(a):
        while top[a] != a:
            a = top[a]
        return a

    for w, i, j in edges:
        if w <= radius and find(i) != find(j):
            top[find(i)] = find(j)
            out.append(w)
    return out


def test_mutual_reachability_forest(spark, monkeypatch):
    monkeypatch.setattr(C, "TILE_POINTS", 20)
    rng = random.Random(8)
    pts = [[rng.gauss(c, 0.05), rng.gauss(0, 0.05)] for c in (0, 0.3, 1) for _ in range(40)]
    radius, k = 0.15, 4
    core = [sorted(math.dist(a, b) for b in pts)[k - 1] for a in pts]
    df = spark.createDataFrame([(1, i, p) for i, p in enumerate(pts)], "run int, e bigint, x array<double>")
    forest = C.spanning_forest(df, F.col("run"), F.col("e"), F.col("x"), radius, k, finish_edges=10)
    got = sorted(r.w for r in forest.edges.collect())
    assert np.allclose(got, sorted(brute_forest(pts, core, radius)))
    clusters = C.stable_clusters(df, F.col("run"), F.col("e"), F.col("x"), radius, k, 10).collect()
    assert len(clusters) >= 3 and all(r.size >= 10 and r.stability >= 0 and len(r.exemplars) == 3 for r in clusters)
    far = next(r for r in clusters if r.cluster_id >= 80)
    assert all(abs(pts[e][0] - 1) < 0.12 and abs(pts[e][1]) < 0.12 for e in far.exemplars)


def test_condensed_tree_prefers_the_split():
    left = [(i, i + 1, 0.01) for i in range(0, 9)]
    right = [(i, i + 1, 0.01) for i in range(20, 29)]
    u, v, w = map(np.array, zip(*left, *right, (9, 20, 0.9), strict=True))
    size = {i: 1 for i in [*range(10), *range(20, 30)]}
    out = C.condense(u, v, w, size, 5, 1.0)
    assert sorted(o[0] for o in out) == [10, 10]


@pytest.mark.parametrize("capacity", [8, 400])
@pytest.mark.parametrize("flat", [True, False])
def test_top_items_are_exact(spark, capacity, flat):
    """Also of a flat stream, where keys that the summary dropped may be among the top."""
    rng = random.Random(21)
    rows = [(str(rng.randint(0, 99) if flat else int(rng.expovariate(0.2))), rng.randint(1, 3)) for _ in range(3000)] + [(None, 9), ("0", None), ("1", 0)]
    out = H.top_items(spark.createDataFrame(rows, "k string, w int").repartition(4), {"k": F.col("k")}, F.col("w"), 5, capacity).collect()
    totals = Counter()
    for k, w in rows:
        if k is not None and w:
            totals[k] += w
    assert [(r.k, r.total) for r in out] == sorted(totals.items(), key=lambda e: (-e[1], e[0]))[:5]
    assert {r.group_total for r in out} == {sum(totals.values())}
    assert H.top_items(spark.createDataFrame([], "k string, w int"), {"k": F.col("k")}, F.col("w"), 5, capacity).count() == 0
