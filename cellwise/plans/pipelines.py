"""Whole pipelines: scan, grid, sketch, discover, learn, export; with their configurations."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import scalar as S
from cellwise.functions import vectors as V
from cellwise.functions.hashing import HashFunction
from cellwise.operators import bloom as B
from cellwise.operators import count_min as C
from cellwise.operators import discovery as D
from cellwise.operators import evaluate as E
from cellwise.operators import grid as G
from cellwise.operators import kmeans as K
from cellwise.operators import parzen as P
from cellwise.operators import regression as R
from cellwise.operators import topk as TK
from cellwise.operators.records import TRIP, parse_records
from cellwise.session import stage
from cellwise.sources import writers

ENUMERATION, HEAVY_HITTERS, EXACT = "enumeration", "heavy-hitters", "exact"
#: A user's sketching step: rows to (key, value).
SketchFunction = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class SketchSpec:
    """One sketch of a job. ``kind`` is count, weight or bloom; ``fields`` are joined to the key ``(a,b)``, rounded if ``precision`` is given."""

    name: str
    fields: Sequence[str]
    kind: str = "count"
    value: str | None = None
    precision: int | None = None
    delta: float = 0.1
    epsilon: float = 0.001
    expected: int = 100_000
    rate: float = 0.01
    function: SketchFunction | None = None


def field_key(fields: Sequence[str], precision: int | None = None, parentheses: bool = True) -> Column:
    """``(a,b,..)`` of the fields as they are or rounded half up; null if a field is null."""
    parts = [(G.round_half_up(F.col(f), precision) if precision is not None else F.col(f)).cast("string") for f in fields]
    joined = parts[0]
    for p in parts[1:]:
        joined = F.concat(joined, F.lit(","), p)
    return F.concat(F.lit("("), joined, F.lit(")")) if parentheses else joined


def build_sketch(df: DataFrame, spec: SketchSpec) -> DataFrame:
    """The sketch of ``df`` by one spec: counters (row, col, cnt), weighted counters (row, col, val) or set bits (bit)."""
    rows = spec.function(df) if spec.function else df.select(field_key(spec.fields, spec.precision).alias("key"), (F.coalesce(F.col(spec.value), F.lit(0)) if spec.value else F.lit(1)).alias("value"))
    if spec.kind == "bloom":
        return B.build(rows, F.col("key"), B.BloomSizing.of_rate(spec.rate, spec.expected))
    if spec.kind == "weight":
        return C.build_weighted(rows, F.col("key"), F.col("value"), C.Sizing.of(spec.delta, spec.epsilon, weighted=True))
    return C.build(rows, F.col("key"), C.Sizing.of(spec.delta, spec.epsilon), F.col("value"))


def build_sketches(df: DataFrame, specs: Sequence[SketchSpec], path: str | None = None) -> dict[str, DataFrame]:
    """All sketches of a job; with ``path`` each is also written, one Parquet folder a sketch."""
    out = {s.name: build_sketch(df, s) for s in specs}
    for name, sketch in out.items() if path else ():
        writers.parquet(sketch, f"{path}/{name}")
    return out


@dataclass(frozen=True)
class RegressionConfig:
    """delta comes before epsilon. ``y`` and ``x`` are column names; the grid has ``precision`` decimals."""

    y: str
    x: Sequence[str]
    delta: float = 0.1
    epsilon: float = 0.001
    precision: int = 2
    steps: int = 10
    rate: float = 0.5
    heavy_hitters: int = 200
    min_count: int = 0
    logistic: bool = False
    start: Sequence[float] | None = None
    output: str | None = None
    hash_function: HashFunction | None = None
    normalizer: D.Normalizer = G.grid_index
    learning: R.LearningFunction | None = None


def recovered_cells(cells: DataFrame, precision: int, sizing: C.Sizing, discovery: str | D.DiscoveryStrategy, k: int, min_count: int = 0) -> DataFrame:
    """Weighted cells (g.., cnt): recovered from a sketch by a named or an own strategy, or exact."""
    if discovery == EXACT:
        return D.cell_counts(cells)
    sketch = D.sketch_cells(cells, precision, sizing)
    if callable(discovery):
        return discovery(sketch, cells, precision, sizing)
    if discovery == HEAVY_HITTERS:
        return D.by_heavy_hitters(sketch, cells, precision, sizing, k).drop("rank", "key")
    return D.by_enumeration(sketch, cells, precision, sizing, min_count)


def sketched_regression(df: DataFrame, config: RegressionConfig, discovery: str | D.DiscoveryStrategy = ENUMERATION) -> R.Trace:
    """Grid, sketch, recovered cells, gradient descent (or the ``learning`` function). With ``output`` the heavy hitters, the enumerated grid and both joined are exported."""
    sizing, p = replace(C.Sizing.of(config.delta, config.epsilon), hash_function=config.hash_function), config.precision
    cells = D.to_cells(df, [F.col(config.y), *[F.col(c) for c in config.x]], p, config.normalizer)
    found = stage(recovered_cells(cells, p, sizing, discovery, config.heavy_hitters, config.min_count), "cells")
    if config.output:
        sketch = stage(D.sketch_cells(cells, p, sizing), "sketch")
        hitters = stage(D.by_heavy_hitters(sketch, cells, p, sizing, config.heavy_hitters), "hitters")
        grid = stage(D.by_enumeration(sketch, cells, p, sizing), "grid")
        writers.sketch_export(hitters, grid, D.heavy_hitter_grid(grid, hitters), config.output)
    s = float(10**p)
    xs = [F.col(f"g{i}") / s for i in range(1, len(config.x) + 1)]
    if config.learning:
        return config.learning(found, F.col("g0") / s, xs, F.col("cnt"))
    learn = R.logistic if config.logistic else R.linear
    return learn(found, F.col("g0") / s, xs, F.col("cnt"), config.start, config.rate, config.steps)


def sketched_moments(df: DataFrame, config: RegressionConfig, max_cells: int = G.MAX_CELLS) -> R.Trace:
    """Linear regression from one sketch a product (y x_j, x_j x_k): each moment is the sum of value times estimate over the product's grid."""
    sizing, p = C.Sizing.of(config.delta, config.epsilon), config.precision
    s = float(10**p)
    y, xs = F.col(config.y).cast("double"), [F.col(c).cast("double") for c in config.x]
    rows = df.dropna(subset=[config.y, *config.x])
    m: dict[str, float] = {"n": float(rows.count())}
    for name, product in R.product_columns(y, xs).items():
        cells = D.to_cells(rows, [product], p)
        found = D.by_enumeration(D.sketch_cells(cells, p, sizing), cells, p, sizing, max_cells=max_cells)
        m[name] = found.agg(F.sum(F.col("g0") / s * F.col("cnt"))).first()[0] or 0.0
    return R.descend_linear(m, config.start or [1.0] * (len(xs) + 1), config.rate, config.steps)


@dataclass(frozen=True)
class KMeansConfig:
    columns: Sequence[str]
    k: int
    iterations: int = 10
    delta: float = 0.1
    epsilon: float = 0.001
    precision: int = 2
    heavy_hitters: int = 200
    init: str = "heaviest"  # or random
    seed: int = 1


def sketched_kmeans(df: DataFrame, config: KMeansConfig, discovery: str | D.DiscoveryStrategy = ENUMERATION) -> K.Centers:
    """k-means on recovered cells, in grid units divided by 10^precision. Empty centers stay as NaN on sketched cells and disappear on exact ones."""
    sizing, p = C.Sizing.of(config.delta, config.epsilon), config.precision
    cells = D.to_cells(df, [F.col(c) for c in config.columns], p)
    found = stage(recovered_cells(cells, p, sizing, discovery, config.heavy_hitters, min_count=1), "cells")
    names, s = D.coordinates(len(config.columns)), 10**p
    if config.init == "random":
        centers = {i: [v * s for v in c] for i, c in K.init_random(config.k, len(names), config.seed).items()}
    else:
        centers = K.init_heaviest(found, names, "cnt", config.k)
    done = K.run(found, [F.col(n) for n in names], F.col("cnt"), centers, config.iterations, keep_empty=discovery != EXACT)
    return {i: [v / s for v in c] for i, c in done.items()}


@dataclass(frozen=True)
class Sweep:
    deltas: Sequence[float] = (0.5, 0.1, 0.01)
    epsilons: Sequence[float] = (0.01, 0.001, 0.0001)


def sketch_error_sweep(df: DataFrame, key: Column, sweep: Sweep = Sweep()) -> DataFrame:
    """One row a (delta, epsilon): size, error totals and the number of keys beyond the bound. Keys are counted once and hashed once for all sizes."""
    settings = [(d, e) for d in sweep.deltas for e in sweep.epsilons]
    sizings = [C.Sizing.of(d, e) for d, e in settings]
    counts = stage(C.key_counts(df, key), "counts")
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    pick = lambda values: F.array(*[F.lit(v) for v in values])[F.col("sizing")]
    bounded = C.estimates_by_sizing(counts, sizings).withColumn("bound", pick([s.error_bound(total) for s in sizings]))
    rows = bounded.groupBy("sizing").agg(*C.profile_columns(F.col("bound")))
    named = {"delta": [d for d, _ in settings], "epsilon": [e for _, e in settings], "depth": [s.depth for s in sizings], "width": [s.width for s in sizings]}
    return rows.select(*[pick(v).alias(n) for n, v in named.items()], *[c for c in rows.columns if c != "sizing"])


def regression_sweep(df: DataFrame, config: RegressionConfig, sweep: Sweep = Sweep(), discovery: str | D.DiscoveryStrategy = HEAVY_HITTERS) -> DataFrame:
    """One row a (delta, epsilon): the size of the sketch, the model learned from it, and its distance to the model of the exact cells."""
    spark = df.sparkSession
    exact = sketched_regression(df, config, EXACT).model
    rows = []
    for delta in sweep.deltas:
        for epsilon in sweep.epsilons:
            model = sketched_regression(df, replace(config, delta=delta, epsilon=epsilon), discovery).model
            sizing = C.Sizing.of(delta, epsilon)
            rows.append((delta, epsilon, sizing.depth, sizing.width, *model, math.dist(model, exact)))
    thetas = ", ".join(f"theta{d} double" for d in range(len(exact)))
    return spark.createDataFrame(rows, f"delta double, epsilon double, depth int, width int, {thetas}, off double")


def kmeans_sweep(df: DataFrame, config: KMeansConfig, sweep: Sweep = Sweep(), discovery: str | D.DiscoveryStrategy = HEAVY_HITTERS) -> DataFrame:
    """One row a (delta, epsilon): the size of the sketch, and the cost of all rows with the centers learned from it."""
    spark = df.sparkSession
    xs = [F.col(c).cast("double") for c in config.columns]
    known = df.dropna(subset=list(config.columns))
    rows = []
    for delta in sweep.deltas:
        for epsilon in sweep.epsilons:
            centers = sketched_kmeans(df, replace(config, delta=delta, epsilon=epsilon), discovery)
            sane = {i: c for i, c in centers.items() if not any(map(math.isnan, c))}
            sizing = C.Sizing.of(delta, epsilon)
            rows.append((delta, epsilon, sizing.depth, sizing.width, len(sane), K.cost(known, xs, F.lit(1.0), sane).first()[0] if sane else None))
    return spark.createDataFrame(rows, "delta double, epsilon double, depth int, width int, n_centers int, cost double")


def trip_etl(records: DataFrame, record: Column, fmt: Column, keep: dict[str, Column] | None = None) -> DataFrame:
    """Raw trajectories to trips: start date, hour and weekday (UTC), first point, measurements, meters, minutes and km/h. Trips without a point have null places."""
    parsed = parse_records(records, record, fmt, keep or {}, [TRIP]).where("reason IS NULL")
    ts = F.timestamp_seconds("trip_epoch")
    day, hour, weekday = S.trip_calendar(ts)
    n = F.size("polyline")
    first = F.get("polyline", F.lit(0))
    meters = S.path_length(F.col("polyline"))
    return parsed.select(
        *(keep or {}), "trip_id", "taxi_id", "call_type", "trip_epoch", day.alias("day"), hour.alias("hour"), weekday.alias("weekday"), F.get(first, F.lit(0)).alias("lon"),
        F.get(first, F.lit(1)).alias("lat"), n.alias("num_measurements"), meters.alias("meters"), S.duration_minutes(n).alias("minutes"),
        S.speed_kmh(meters, S.duration_minutes(n)).alias("kmh"),
    )


@dataclass(frozen=True)
class TripQuery:
    """Windowed counts: decimals of the grid, window in steps, radius in meters, hours in a slot, minutes up to which a trip is short, and the box of centers."""

    precision: int = 2
    window: int = 2
    radius: float = 2000.0
    hour_step: int = 1
    limit_minutes: float = 10
    delta: float = 0.1
    epsilon: float = 0.001
    box: Sequence[int] = field(default=(4110, -870, 4120, -855))

    @property
    def sizing(self) -> C.Sizing:
        return C.Sizing.of(self.delta, self.epsilon)


def trip_cells(trips: DataFrame, query: TripQuery) -> DataFrame:
    """(g0, g1, trip_type, hour) of trips with lat, lon, duration and hour_of_day."""
    known = trips.where("lat IS NOT NULL AND lon IS NOT NULL AND duration IS NOT NULL AND hour_of_day IS NOT NULL")
    place = [G.grid_index(F.col(c), query.precision).alias(n) for c, n in (("lat", "g0"), ("lon", "g1"))]
    return known.select(*place, S.trip_type(F.col("duration"), query.limit_minutes).alias("trip_type"), F.col("hour_of_day").alias("hour"))


def trip_windows(trips: DataFrame, query: TripQuery) -> DataFrame:
    """Real and sketched counts and wrong positives of every center of the box, hour slot and trip type."""
    spark, names, s = trips.sparkSession, ["g0", "g1", "trip_type", "hour"], F.lit(float(10**query.precision))
    key = V.key(F.array(F.col("g0") / s, F.col("g1") / s, F.col("trip_type").cast("double"), F.col("hour").cast("double")))
    real = trip_cells(trips, query).groupBy(*names).agg(F.count(F.lit(1)).alias("real"))
    sketch = C.from_counts(real.select(key.alias("key"), F.col("real").alias("cnt")), query.sizing)
    centers = G.enumerate_box(spark, query.box[:2], query.box[2:], ["c0", "c1"]).withColumn("center", F.concat_ws(":", F.col("c0").cast("string"), F.col("c1").cast("string")))
    asked = P.window_cells(centers, query.precision, query.window, query.radius).select("g0", "g1").distinct()
    keys = asked.withColumn("trip_type", F.explode(F.array(F.lit(P.LONG), F.lit(P.SHORT)))).withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(23)))).withColumn("key", key)
    estimated = C.lookup(sketch, keys, query.sizing, "key").drop("key")
    cells = estimated.join(real, names, "left").select(*names, F.coalesce("real", F.lit(0)).alias("real"), "estimate")
    return P.count_windows(centers, cells, query.precision, query.window, query.radius, query.hour_step)


@dataclass
class TripResult:
    """``windows``: the counts; ``slots``: long or short by truth and by sketch; ``summary``: one row with sizes, confusion, precision and recall."""

    windows: DataFrame
    slots: DataFrame
    summary: DataFrame


def taxi_pipeline(trips: DataFrame, query: TripQuery = TripQuery(), output: str | None = None) -> TripResult:
    """Trips to windowed counts, to long or short, to how often the sketch is right. With ``output`` the slots are written, one folder a center, and the summary."""
    windows = stage(trip_windows(trips, query), "windows")
    slots = P.long_or_short(windows)
    quality = E.precision_recall(E.confusion(slots, F.col("predicted_long"), F.col("is_long")))
    settings = [F.lit(query.delta).alias("delta"), F.lit(query.epsilon).alias("epsilon"), F.lit(query.sizing.depth).alias("depth"), F.lit(query.sizing.width).alias("width")]
    summary = quality.select(*settings, "*")
    if output:
        writers.per_center(slots, f"{output}/slots")
        writers.csv(summary, f"{output}/summary", "\t", True)
    return TripResult(windows, slots, summary)


def heavy_hitter_table(df: DataFrame, key: Column, k: int) -> DataFrame:
    return TK.top_k(C.key_counts(df, key), k)


def write_centers(spark: SparkSession, centers: K.Centers, path: str) -> None:
    writers.csv(K.frame(spark, centers), path, " ")
