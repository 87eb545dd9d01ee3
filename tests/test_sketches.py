import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cellwise.functions import vectors as V
from cellwise.functions.hashing import spread
from cellwise.operators import bloom as B
from cellwise.operators import count_min as C
from cellwise.operators import discovery as D
from cellwise.operators import grid as G
from cellwise.operators import topk as T
from cellwise.plans.reference_hash import bucket_of
from cellwise.session import drop_staged, stage


def frame(spark, keys):
    return spark.createDataFrame([(k,) for k in keys], "key string")


def test_bucket_rule_known_values(spark):
    wanted = {"test": [16, 9, 0, 4, 11], "test1": [17, 11, 11, 8, 0], "(0.5,0.25)": [4, 2, 2, 18, 7]}
    rows = spread(frame(spark, wanted), "key", 5, 20).collect()
    assert {(r.key, r.row): r.col for r in rows} == {(k, i): c for k, cs in wanted.items() for i, c in enumerate(cs)}


def test_bucket_rule_matches_plain_python(spark):
    rng = random.Random(3)
    keys = ["", "é", "x" * 5000] + ["".join(rng.choices("ab(),.01ü", k=rng.randint(1, 20))) for _ in range(200)]
    for r in spread(frame(spark, set(keys)), "key", 3, 1000).collect():
        assert r.col == bucket_of(r.key, r.row, 1000)


def test_point_counts(spark):
    sizing = C.Sizing.of(0.01, 0.1)
    assert (sizing.width, sizing.depth) == (20, 5)
    sketch = C.build(frame(spark, ["test"] * 3 + ["test1"]), F.col("key"), sizing)
    got = {r.key: r.estimate for r in C.lookup(sketch, frame(spark, ["test", "test1", "none of it"]), sizing).collect()}
    assert got["test"] == 3 and got["test1"] == 1


def test_never_underestimates_and_merges(spark):
    rng = random.Random(1)
    keys = [str(int(rng.gauss(0, 30))) for _ in range(3000)] + [None, None]
    sizing, exact = C.Sizing(3, 40), Counter(k for k in keys if k is not None)
    df = frame(spark, keys)
    whole = C.build(df, F.col("key"), sizing)
    parts = C.merge(C.build(frame(spark, keys[:1000]), F.col("key"), sizing), C.build(frame(spark, keys[1000:]), F.col("key"), sizing))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, parts.collect()))
    for r in C.lookup(whole, df.where("key IS NOT NULL").distinct(), sizing).collect():
        assert r.estimate >= exact[r.key]
    assert all(r.total == 3000 for r in whole.groupBy("row").agg(F.sum("cnt").alias("total")).collect())
    assert C.row_sum(whole).first().total == 3000


def test_error_bound_holds(spark):
    rng = random.Random(2)
    keys = [f"{int(rng.gauss(0, 1) * 50)},{int(rng.gauss(0, 1) * 50)}" for _ in range(50_000)]
    sizing = C.Sizing.of(0.01, 0.01)
    counts = C.key_counts(frame(spark, keys), F.col("key"))
    p = C.error_profile(counts, C.lookup(C.from_counts(counts, sizing), counts.select("key"), sizing), sizing.error_bound(len(keys))).first()
    assert p.n_under == 0 and p.n_beyond_bound <= 0.01 * p.n_keys


def test_empty_streams(spark):
    sizing = C.Sizing(2, 10)
    none = frame(spark, [])
    assert C.build(none, F.col("key"), sizing).count() == 0
    assert C.lookup(C.empty(spark), frame(spark, ["a"]), sizing).first().estimate == 0
    assert C.row_sum(C.empty(spark)).first().total == 0
    assert T.top_k(C.key_counts(none, F.col("key")), 3).count() == 0


def test_bounded_queue_traced_by_hand(spark):
    """Three slots, the second and the third are replaced. Keys do not collide, so an estimate is the count so far."""
    trace = [
        ("ash", ["ash 1"]),
        ("oak", ["ash 1", "oak 1"]),
        ("elm", ["ash 1", "oak 1", "elm 1"]),
        ("elm", ["elm 2", "oak 1", "ash 1"]),  # passes its parent, ash moves down
        ("fir", ["elm 2", "oak 1", "fir 1"]),  # full: the last of the smallest goes
        ("ash", ["elm 2", "oak 1", "ash 2"]),  # counted all along, not larger than the first
        ("ash", ["ash 3", "oak 1", "elm 2"]),
        ("yew", ["ash 3", "yew 1", "elm 2"]),
        ("oak", ["ash 3", "oak 2", "elm 2"]),
        ("yew", ["ash 3", "oak 2", "yew 2"]),
        ("yew", ["ash 3", "oak 2", "yew 3"]),  # equal to its parent: stays
        ("elm", ["ash 3", "elm 3", "yew 3"]),
        ("oak", ["ash 3", "elm 3", "oak 3"]),
        ("fir", ["ash 3", "elm 3", "fir 2"]),
        ("yew", ["yew 4", "elm 3", "fir 2"]),  # strictly larger than the first: takes its slot
    ]
    queue, counts = T.BoundedQueue(3), Counter()
    for key, wanted in trace:
        counts[key] += 1
        queue.update(key, counts[key])
        assert [f"{k} {c}" for c, k in queue.slots] == wanted
    df = spark.createDataFrame([(i, k) for i, (k, _) in enumerate(trace)], "seq int, key string")
    got = T.sequential_heavy_hitters(df, F.col("key"), F.col("seq"), 3, 5, 1000).orderBy("slot").collect()
    assert [f"{r.key} {r.cnt}" for r in got] == trace[-1][1]
    assert T.sequential_heavy_hitters(df, F.col("key"), F.col("seq"), 0, 5, 20).count() == 0


def test_top_k_ties(spark):
    df = spark.createDataFrame([("b", 2), ("a", 2), ("c", 5), ("d", 1)], "key string, cnt bigint")
    assert [(r["rank"], r.key) for r in T.top_k(df, 3).collect()] == [(1, "c"), (2, "a"), (3, "b")]


def test_bloom_has_no_false_negatives(spark):
    sizing = B.BloomSizing.of_rate(0.02, 500)
    keys = [f"k{i}" for i in range(500)]
    bits = B.build(frame(spark, [*keys, None, "k1"]), F.col("key"), sizing)
    assert B.contains_all(bits, frame(spark, keys), sizing).first().all_maybe
    others = B.contains(bits, frame(spark, [f"x{i}" for i in range(2000)]), sizing)
    assert others.where("maybe").count() < 2000 * 0.06
    assert B.same(bits, B.merge(B.build(frame(spark, keys[:200]), F.col("key"), sizing), B.build(frame(spark, keys[200:]), F.col("key"), sizing))).first().same
    assert B.contains_all(bits, frame(spark, []), sizing).first().all_maybe


def test_grid(spark):
    assert G.enumerate_box(spark, [0, 0], [10, 10], ["x", "y"]).count() == 121
    assert G.enumerate_box(spark, [0, 0], [-1, 3], ["x", "y"]).count() == 0
    with pytest.raises(ValueError, match="cells"):
        G.enumerate_box(spark, [0] * 9, [99] * 9, list("abcdefghi"))
    df = spark.createDataFrame([(-2.5,), (2.5,), (0.125,), (None,)], "x double")
    assert [r.g for r in df.select(G.grid_index(F.col("x"), 0).alias("g")).collect()] == [-2, 3, 0, None]
    big = spark.createDataFrame([(1e300,), (-1e300,), (0.75,)], "x double")
    assert [r.g for r in big.select(G.to_binary(F.col("x"), 1).alias("g")).collect()] == [2147483647, -2147483648, 1]
    cells = spark.createDataFrame([], "g0 bigint, g1 bigint")
    assert G.enumerate_observed(cells, ["g0", "g1"]).count() == 0
    with pytest.raises(Exception, match="cells"):
        G.enumerate_observed(spark.createDataFrame([(0, 0), (10, 10)], "g0 bigint, g1 bigint"), ["g0", "g1"], max_cells=5).collect()


def test_vectors(spark):
    df = spark.createDataFrame([([5.0, 1.0, 2.0, 3.0, -4.0],), ([3.0, 1.0, -2.0, 3.0, 0.0],), ([-3.0, 0.0, 0.0, 0.0, 0.0],)], "v array<double>")
    r = df.agg(V.minima(F.col("v"), 5).alias("a"), V.maxima(F.col("v"), 5).alias("b")).first()
    assert r.a == [-3, 0, -2, 0, -4] and r.b == [5, 1, 2, 3, 0]
    one = spark.range(1)
    vec = lambda *x: F.array(*[F.lit(float(v)) for v in x])
    q = one.select(
        V.all_below(vec(-1, 0, 2), vec(0, 0, 0)).alias("a"), V.all_below(vec(-1, 0, 2), vec(0, 0, 2)).alias("b"), V.dot(vec(1, 2), vec(3, 4)).alias("dot"),
        V.key(vec(0.5, 0.25)).alias("key"), V.parse_key(F.lit("(0.5,-1.0E-4)")).alias("parsed"), V.tail(vec(1, 2, 3)).alias("tail"), V.cut(vec(1, 2, 3, 4), 1, 3).alias("cut"),
        V.zeros(2).alias("zeros"), V.divide(vec(1, 2), 0.0).alias("none"), V.append(vec(1), vec(2)).alias("both"), V.tail(vec(1)).alias("nothing"),
    ).first()
    assert (q.a, q.b, q.dot, q.key, q.parsed) == (False, True, 11.0, "(0.5,0.25)", [0.5, -1e-4])
    assert (q.tail, q.cut, q.zeros, q.none, q.both, q.nothing) == ([2.0, 3.0], [2.0, 3.0], [0.0, 0.0], [None, None], [1.0, 2.0], [])


def test_discovery_exact_when_wide(spark):
    rng = random.Random(5)
    pts = [(rng.gauss(0, 0.3), rng.gauss(0, 0.3)) for _ in range(500)] + [(None, 0.1)]
    cells = D.to_cells(spark.createDataFrame(pts, "x double, y double"), [F.col("x"), F.col("y")], 1)
    sizing = C.Sizing(4, 50_000)
    sketch = D.sketch_cells(cells, 1, sizing)
    exact = {(r.g0, r.g1): r.cnt for r in D.cell_counts(cells).collect()}
    found = {(r.g0, r.g1): r.cnt for r in D.by_enumeration(sketch, cells, 1, sizing).collect()}
    assert {k: v for k, v in found.items() if v} == exact and sum(found.values()) == 500
    hh = D.by_heavy_hitters(sketch, cells, 1, sizing, 5).orderBy("rank").collect()
    assert [r.cnt for r in hh] == sorted(exact.values(), reverse=True)[:5]
    assert D.by_random_points(spark, sketch, 2, 50, 1, sizing, 1).count() == 50
    assert D.full_range(spark, 4).count() == 32


def test_estimates_by_sizing_are_those_of_single_sketches(spark):
    rng = random.Random(9)
    counts = C.key_counts(frame(spark, [str(int(rng.gauss(0, 30))) for _ in range(2000)]), F.col("key"))
    sizings = [C.Sizing(1, 30), C.Sizing(3, 30), C.Sizing(2, 71)]
    got = {(r.sizing, r.key): r.estimate for r in C.estimates_by_sizing(counts, sizings).collect()}
    for i, s in enumerate(sizings):
        for r in C.lookup(C.from_counts(counts, s), counts.select("key"), s).collect():
            assert got[i, r.key] == r.estimate


def test_bloom_words_round_trip(spark):
    sizing = B.BloomSizing.of_rate(0.02, 50)
    bits = B.build(frame(spark, [f"k{i}" for i in range(50)]), F.col("key"), sizing)
    assert B.same(bits, B.from_words(B.to_words(bits))).first().same and B.to_words(bits).count() <= sizing.bits // 64 + 1
    edge = spark.createDataFrame([(0,), (63,), (64,), (127,)], "bit bigint")
    assert sorted(r.bit for r in B.from_words(B.to_words(edge)).collect()) == [0, 63, 64, 127]
    assert B.from_words(B.to_words(edge.limit(0))).count() == 0


def test_staged_tables_are_dropped(spark):
    import os

    kept = stage(spark.range(5), "kept")
    path = kept._staged_at
    assert os.path.isdir(path.removeprefix("file:")) and kept.count() == 5
    drop_staged(kept, spark.range(1))
    assert not os.path.exists(path.removeprefix("file:"))
