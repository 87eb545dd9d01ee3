import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cellwise.functions import scalar as S
from cellwise.operators import bloom as B
from cellwise.operators import discovery as D
from cellwise.operators import evaluate as E
from cellwise.operators import forest as RF
from cellwise.operators import histogram as H
from cellwise.operators import kmeans as K
from cellwise.operators import regression as R
from cellwise.plans import pipelines as P


def test_linear_descent_is_plain_descent(spark):
    rng = np.random.default_rng(1)
    x, w = rng.uniform(-1, 1, 200), rng.integers(1, 5, 200)
    y = 0.6 + 0.1 * x + rng.normal(0, 0.01, 200)
    rows = [(float(a), float(b), int(c)) for a, b, c in zip(y, x, w)] + [(None, 1.0, 3)]
    df = spark.createDataFrame(rows, "y double, x double, w bigint")
    trace = R.linear(df, F.col("y"), [F.col("x")], F.col("w"), steps=60)
    theta = np.array([1.0, 1.0])
    X = np.stack([np.ones(200), x], 1)
    for _ in range(60):
        theta = theta - 0.5 * ((X @ theta - y)[:, None] * X * w[:, None]).sum(0) / w.sum()
    assert np.allclose(trace.model, theta) and np.allclose(trace.model, [0.6, 0.1], atol=0.02)
    empty = R.linear(df.where("w > 99"), F.col("y"), [F.col("x")], F.col("w"), steps=3)
    assert empty.model == [1.0, 1.0]


def test_logistic_descent(spark):
    rng = random.Random(2)
    rows = [(int(rng.random() < 1 / (1 + math.exp(-(1 + 3 * x)))), x) for x in (rng.uniform(-1, 1) for _ in range(400))]
    df = spark.createDataFrame(rows, "y int, x double").cache()
    trace = R.logistic(df, F.col("y"), [F.col("x")], F.lit(1), steps=5)
    theta = np.array([1.0, 1.0])
    y, X = np.array([r[0] for r in rows]), np.array([[1, r[1]] for r in rows])
    for _ in range(5):
        theta = theta + 0.5 * ((y - 1 / (1 + np.exp(-X @ theta)))[:, None] * X).mean(0)
    assert np.allclose(trace.model, theta)
    assert len(R.logistic(df.where("x > 5"), F.col("y"), [F.col("x")], F.lit(1), steps=3).steps) == 1


def test_sketched_pipelines_find_the_model(spark, tmp_path):
    from cellwise.functions import generate as gen

    df = gen.polynomial(spark, 20_000, [0.6, 0.1], [0, 1], 0.0, seed=4)
    config = P.RegressionConfig("y", ["x"], steps=200, precision=2, epsilon=0.0005, output=str(tmp_path / "out"))
    for mode in (P.ENUMERATION, P.HEAVY_HITTERS, P.EXACT):
        model = P.sketched_regression(df, config, mode).model
        assert abs(model[0] - 0.6) < 0.02 and abs(model[1] - 0.1) < 0.05
    assert len(spark.read.text(str(tmp_path / "out/heavyhitters")).collect()) > 0
    model = P.sketched_moments(df, P.RegressionConfig("y", ["x"], steps=200, precision=2, epsilon=0.0001)).model
    assert abs(model[0] - 0.6) < 0.02 and abs(model[1] - 0.1) < 0.05


def test_generators_are_seeded(spark):
    from cellwise.functions import generate as gen

    a, b = gen.logistic(spark, 100, [1, 2], [0, 1], 0.1), gen.logistic(spark, 100, [1, 2], [0, 1], 0.1)
    assert a.collect() == b.collect() and {r.y for r in a.collect()} <= {0, 1}
    points, centers = gen.clusters(spark, 300, 3, [0.01, 0.02, 0.01], seed=2)
    means = {r.center: (r.m0, r.m1) for r in points.groupBy("center").agg(F.avg("x0").alias("m0"), F.avg("x1").alias("m1")).collect()}
    for i, c in enumerate(centers, 1):
        assert np.allclose(means[i], c, atol=0.02)
    assert gen.random_places(spark, 20, (41, -9, 42, -8)).where("lat BETWEEN 41 AND 42 AND lon BETWEEN -9 AND -8").count() == 20
    moved = gen.perturb(spark.createDataFrame([(0.0, 0.0)], "a double, b double"), ["a", "b"], 0.5).first()
    assert {abs(v) for v in moved} == {0.5}


def test_kmeans(spark):
    pts = spark.createDataFrame([(0.0, 0.0, 1), (0.0, 1.0, 3), (10.0, 0.0, 1), (10.0, 2.0, 1)], "x double, y double, w bigint")
    xs = [F.col("x"), F.col("y")]
    start = {1: [0.0, 0.0], 2: [9.0, 0.0], 3: [500.0, 0.0]}
    gone = K.run(pts, xs, F.col("w"), start, 2)
    assert gone == {1: [0.0, 0.75], 2: [10.0, 1.0]}
    kept = K.run(pts, xs, F.col("w"), start, 2, keep_empty=True)
    assert math.isnan(kept[3][0]) and kept[1] == [0.0, 0.75]
    tie = K.assign(spark.createDataFrame([(5.0, 0.0)], "x double, y double"), xs, {2: [10.0, 0.0], 1: [0.0, 0.0]}).first()
    assert tie.center == 1
    costs = [K.cost(pts, xs, F.col("w"), K.run(pts, xs, F.col("w"), {1: [0.0, 0.0], 2: [9.0, 0.0]}, i)).first().cost for i in range(4)]
    assert costs == sorted(costs, reverse=True)
    with pytest.raises(ValueError, match="centers"):
        K.init_heaviest(pts, ["x", "y"], "w", 9)


def test_histogram_keeps_totals_and_means():
    rng = np.random.default_rng(4)
    v = np.round(rng.gamma(2, 3, 5000), 2)
    for most in (1, 2, 7, 64):
        h = H.StreamingHistogram(most)
        for part in np.array_split(v, 13):
            h.update(part)
        assert len(h.bins) == most and h.total == 5000 and abs((h.x * h.y).sum() / 5000 - v.mean()) < 1e-9
        assert (np.diff(h.x) > 0).all() and h.x[0] >= v.min() and h.x[-1] <= v.max()
    for p, q in zip(H.StreamingHistogram(64, [(c, n) for c, n in h.bins]).split_points(4), (0.25, 0.5, 0.75), strict=True):
        assert abs((v <= p).mean() - q) < 0.02 and abs(h.count_up_to(p) / 5000 - q) < 1e-6
    one = H.StreamingHistogram(3)
    for x in (1.0, 2.0, 10.0, 11.5):
        one.update(x)
    assert one.bins == [(1.5, 2.0), (10.0, 1.0), (11.5, 1.0)]


def test_models_predict_and_learn(spark):
    rng = random.Random(6)
    rows = [(x, 2 + 3 * x, int(rng.random() < 1 / (1 + math.exp(1 - 4 * x))), 1, i % 3) for i, x in enumerate(rng.uniform(-1, 1) for _ in range(2000))] + [(None, 1.0, 0, 1, 0)]
    df = spark.createDataFrame(rows, "x double, y double, b int, w int, worker int").withColumn("theta0", F.lit("clash"))
    x, known = [F.col("x")], df.dropna()
    linear = R.LinearModel([2.0, 3.0])
    assert df.where("x IS NOT NULL").select(F.max(F.abs(linear.predict(x) - F.col("y")))).first()[0] < 1e-9
    assert df.where("x IS NULL").select(linear.predict(x)).first()[0] is None
    assert max(map(abs, linear.gradient(known, F.col("y"), x, F.col("w")).first())) < 1e-9
    steps = R.descend(R.LinearModel, known, F.col("y"), x, F.col("w"), steps=5).steps
    assert all(abs(a - b) < 1e-9 for s, t in zip(steps, R.linear(known, F.col("y"), x, F.col("w"), steps=5).steps, strict=True) for a, b in zip(s, t, strict=True))
    fitted = R.logistic_newton(known, F.col("b"), x, F.col("w")).model
    assert abs(fitted[0] + 1) < 0.3 and abs(fitted[1] - 4) < 0.6
    assert max(map(abs, R.LogisticModel(fitted).gradient(known, F.col("b"), x, F.col("w")).first())) < 1e-6
    assert R.logistic_newton(known.limit(0), F.col("b"), x, F.col("w")).steps == [[0.0, 0.0]]
    models, mean = R.linear_by_worker(df, F.col("worker"), F.col("y"), x, F.col("w"), steps=300)
    assert set(models) == {0, 1, 2} and abs(mean[0] - 2) < 1e-3 and abs(mean[1] - 3) < 1e-3
    assert R.linear_by_worker(df.limit(0), F.col("worker"), F.col("y"), x, F.col("w")) == ({}, [1.0, 1.0])
    with pytest.raises(ValueError, match="workers"):
        R.linear_by_worker(df, F.col("worker"), F.col("y"), x, F.col("w"), most=2)


def test_hooks_are_arguments(spark):
    rng = random.Random(7)
    df = spark.createDataFrame([(x, 0.25 + 0.5 * x) for x in (rng.uniform(-1, 1) for _ in range(500))], "x double, y double")
    seen = []

    def own(sketch, cells, precision, sizing):
        seen.append(sizing.hash_function is crude)
        return D.estimate_cells(sketch, cells.distinct(), precision, sizing)

    def crude(key, row):
        return F.xxhash64(key, row)

    down = lambda c, p: F.floor(c * 10**p)
    config = P.RegressionConfig("y", ["x"], hash_function=crude, normalizer=down, learning=lambda cells, y, xs, w: R.linear(cells, y, xs, w, steps=400))
    got = P.sketched_regression(df, config, own).model
    assert seen == [True] and abs(got[0] - 0.25) < 0.02 and abs(got[1] - 0.5) < 0.02
    assert P.sketched_regression(df, config, P.EXACT).model != P.sketched_regression(df, P.RegressionConfig("y", ["x"], learning=config.learning), P.EXACT).model


def test_truth_join(spark):
    p = spark.createDataFrame([(2, "b"), (1, "a"), (3, None), (9, "z"), (2, "b")], "id int, guess string").withColumn("actual", F.lit("clash"))
    t = spark.createDataFrame([(1, "a"), (2, "c"), (2, "b"), (3, "c"), (4, None)], "id int, label string").withColumn("guess", F.lit("clash"))
    out = E.truth_join(p, t, "id", "guess", "label")
    assert sorted((r.id, r.predicted or "", r.actual) for r in out.collect()) == [(1, "a", "a"), (2, "b", "b"), (2, "b", "b"), (3, "", "c")]
    assert E.accuracy(out, F.col("predicted"), F.col("actual")).first().n == 4 and E.truth_join(p.limit(0), t, "id", "guess", "label").count() == 0


def test_sides_by_filters_are_those_of_the_values(spark):
    rng = random.Random(8)
    s = spark.createDataFrame([(i, i % 2, [rng.gauss(0, 1), rng.gauss(0, 1)]) for i in range(60)], "sample bigint, label int, features array<double>")
    c = spark.createDataFrame([(0, [-0.5, 0.5]), (1, [0.0])], "feature int, candidates array<double>")
    splits = RF.sample_splits(s, c)
    sizing = B.BloomSizing.of_rate(0.001, splits.count())
    left, right = RF.split_filters(splits, sizing)
    got = {(r["sample"], r.feature, r.candidate): (r.goes_left, r.goes_right) for r in RF.filtered_sides(splits, left, right, sizing).collect()}
    wrong = 0
    for r in splits.collect():
        a, b = got[r["sample"], r.feature, r.candidate]
        assert a if r.value <= r.candidate else b
        wrong += a and b
    assert len(got) == 180 and wrong <= 4


def test_histogram():
    h = H.StreamingHistogram(3)
    for v in (1, 2, 2, 10, 11):
        h.update(v)
    assert h.total == 5 and len(h.bins) == 3
    assert h.count_up_to(0.5) == 0 and h.count_up_to(99) == 5 and h.count_up_to(h.x[0]) == h.y[0]
    assert h.split_points(9) == [] and len(h.split_points(3)) == 2
    assert H.StreamingHistogram.from_text(h.text("7"))[1].bins == h.bins
    assert H.StreamingHistogram.from_text(H.StreamingHistogram(4).text("1"))[1].bins == []
    assert h.merge(h).total == 10


def test_histogram_frames(spark):
    rng = random.Random(3)
    rows = [(i % 2, rng.gauss(i % 2, 1)) for i in range(2000)] + [(0, None), (None, 1.0), (1, float("nan"))]
    df = spark.createDataFrame(rows, "f int, v double")
    hs = H.build(df, F.col("v"), {"f": F.col("f")}, 32)
    for r in hs.select("f", H.count_up_to(F.col("bins"), F.lit(0.5)).alias("n"), "bins").collect():
        truth = sum(v <= 0.5 for f, v in rows if f == r.f and v is not None)
        assert len(r.bins) == 32 and abs(r.n - truth) < 60
        assert abs(r.n - H.StreamingHistogram(99, [(b.x, b.y) for b in r.bins]).count_up_to(0.5)) < 1e-9
    assert H.build(df.limit(0), F.col("v"), {"f": F.col("f")}, 8).count() == 0


def test_forest_learns_and_votes(spark):
    rng = random.Random(4)
    rows = [(i, int(x > 0.2) + 2 * int(y > 0), [x, y, rng.random()]) for i in range(800) for x, y in [(rng.uniform(-1, 1), rng.uniform(-1, 1))]]
    rows += [(9000, None, [0.1, 0.1, 0.1]), (9001, 1, None)]
    s = spark.createDataFrame(rows, "sample bigint, label int, features array<double>")
    c = spark.createDataFrame([(f, [-0.5, 0.0, 0.2, 0.5]) for f in range(3)], "feature int, candidates array<double>")
    nodes = RF.grow(s, c, 3, 3, 4, per_node=3, least=20, max_depth=3, seed=1).cache()
    assert nodes.where("node = 0").select("bag_size").distinct().first().bag_size == 800
    votes = E.majority_vote(RF.predict(s.where("sample < 9000"), nodes), "sample", "label")
    joined = votes.withColumnRenamed("label", "guess").join(s, "sample")
    assert E.accuracy(joined, F.col("guess"), F.col("label")).first().accuracy > 0.95
    for corrected in (True, False):
        assert RF.grow(s.limit(0), c, 1, 3, 4, corrected=corrected).count() == 0


def test_evaluation(spark):
    df = spark.createDataFrame([(True, True), (True, False), (None, True), (False, None)], "p boolean, a boolean")
    r = E.precision_recall(E.confusion(df, F.col("p"), F.col("a"))).first()
    assert (r.true_positive, r.false_positive, r.false_negative, r.true_negative) == (1, 1, 1, 1) and r.precision == 0.5
    empty = E.precision_recall(E.confusion(df.limit(0), F.col("p"), F.col("a"))).first()
    assert empty.n == 0 and empty.precision is None
    votes = spark.createDataFrame([(1, 5), (1, 3), (2, 7), (2, 7), (2, None)], "s int, l int")
    assert {(x.s, x.l) for x in E.majority_vote(votes, "s", "l").collect()} == {(1, 3), (2, 7)}
    q = spark.range(1).select(S.gini(F.array(F.lit(0.5), F.lit(0.5))).alias("g"), S.entropy(F.array(F.lit(1.0), F.lit(0.0))).alias("e"), S.entropy(F.array(F.lit(0.5), F.lit(0.5))).alias("b")).first()
    assert (q.g, q.e, q.b) == (0.5, 0.0, 1.0)
