"""Queries of the sketching, discovery, learning and evaluation operators, with their SQL twins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions import scalar as S
from cellwise.functions import vectors as V
from cellwise.operators import bloom as B
from cellwise.operators import count_min as C
from cellwise.operators import discovery as D
from cellwise.operators import evaluate as E
from cellwise.operators import forest as RF
from cellwise.operators import grid as G
from cellwise.operators import histogram as H
from cellwise.operators import kmeans as K
from cellwise.operators import parzen as P
from cellwise.operators import regression as R
from cellwise.operators import topk as TK
from cellwise.plans import pipelines as PL
from cellwise.queries.general import P5_CTE
from cellwise.session import scratch_path, stage, table
from cellwise.sources import readers as IO
from cellwise.sources import writers as W

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return register


# -- SQL building blocks -------------------------------------------------------------------------------------------------


def hash_sql(keys: str, sizing: C.Sizing, extra: str = "") -> str:
    """SQL of (key, extra.., row, col) for the rows of ``keys``, which has ``key``."""
    more = f", {extra}" if extra else ""
    terms = " + ".join(f"c[{k + 1}]::HUGEINT * {256**k}::HUGEINT" for k in range(8))
    return f"""
    SELECT key{more}, r AS "row", abs(trunc((CASE WHEN u >= 9223372036854775808::HUGEINT THEN u - 18446744073709551616::HUGEINT ELSE u END)::DOUBLE
      / 9223372036854775807::DOUBLE * {sizing.width}))::BIGINT AS col
    FROM (SELECT *, {terms} AS u FROM (SELECT *, [CASE WHEN len([x FOR x IN b[1:k - 1] IF x >= 128]) % 2 = 1 THEN 255 - b[k] ELSE b[k] END FOR k IN range(1, 9)] AS c
      FROM (SELECT *, [CAST('0x' || substr(h, 2 * k + 1, 2) AS INT) FOR k IN range(8)] AS b
        FROM (SELECT *, sha256(lpad(CAST(r AS VARCHAR), 5, '0') || key) AS h FROM (SELECT *, CAST(unnest(range({sizing.depth})) AS INT) AS r FROM ({keys}))))))
    """


TAX_SIZING = C.Sizing.of(0.1, 0.04)
TAX_CELLS_SQL = "SELECT CAST(floor(l_tax * 100 + 0.5) AS BIGINT) AS g0, CAST(floor(l_discount * 100 + 0.5) AS BIGINT) AS g1 FROM lineitem WHERE l_tax IS NOT NULL AND l_discount IS NOT NULL"
TAX_KEY_SQL = "'(' || CAST(g0 / 100::DOUBLE AS VARCHAR) || ',' || CAST(g1 / 100::DOUBLE AS VARCHAR) || ')'"
TAX_COUNTS_SQL = f"SELECT g0, g1, {TAX_KEY_SQL} AS key, count(*) AS cnt FROM ({TAX_CELLS_SQL}) GROUP BY g0, g1"
TAX_SKETCH_SQL = f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(TAX_COUNTS_SQL, TAX_SIZING, "cnt")}) GROUP BY 1, 2'
TAX_BOX_SQL = f"""SELECT g0, g1, {TAX_KEY_SQL} AS key FROM (SELECT unnest(range(a, b + 1)) AS g0, c, d FROM (SELECT min(g0) a, max(g0) b, min(g1) c, max(g1) d FROM ({TAX_CELLS_SQL}))),
  LATERAL (SELECT unnest(range(c, d + 1)) AS g1)"""


def estimates_sql(keys: str, sketch: str, sizing: C.Sizing, extra: str) -> str:
    return f'SELECT {extra}, CAST(min(coalesce(s.cnt, 0)) AS BIGINT) AS cnt FROM ({hash_sql(keys, sizing, extra)}) k LEFT JOIN ({sketch}) s USING ("row", col) GROUP BY key, {extra}'


TAX_ENUM_SQL = estimates_sql(TAX_BOX_SQL, TAX_SKETCH_SQL, TAX_SIZING, "g0, g1")
TAX_HH_SQL = f"SELECT * FROM ({estimates_sql(TAX_COUNTS_SQL, TAX_SKETCH_SQL, TAX_SIZING, 'g0, g1')}) ORDER BY cnt DESC, {TAX_KEY_SQL} LIMIT 20"


def tax_cells(spark: SparkSession, sf: str) -> DataFrame:
    return D.to_cells(table(spark, sf, "lineitem"), [F.col("l_tax"), F.col("l_discount")], 2)


def tax_sketch(spark: SparkSession, sf: str) -> DataFrame:
    return D.sketch_cells(tax_cells(spark, sf), 2, TAX_SIZING)


# -- scans and projections -----------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_quantity AS v0, l_discount AS v1, l_tax AS v2 FROM lineitem")
def scan_vectors(spark, sf):
    line = F.concat_ws(" ", *[F.col(c).cast("string") for c in ("l_quantity", "l_discount", "l_tax")])
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", IO.parse_vector(line).alias("v"))
    return rows.select("l_orderkey", "l_linenumber", *[F.get("v", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query("SELECT vec_id, floor(embedding[1]::DOUBLE * 100 + 0.5) / 100::DOUBLE AS a, floor(embedding[2]::DOUBLE * 1000 + 0.5) / 1000::DOUBLE AS b, CAST(trunc(embedding[3]::DOUBLE * 256) AS INT) AS c FROM embeddings")
def round_half_up(spark, sf):
    e = lambda i: F.col("embedding")[i].cast("double")
    return table(spark, sf, "embeddings").select("vec_id", G.round_half_up(e(0), 2).alias("a"), G.round_half_up(e(1), 3).alias("b"), G.to_binary(e(2), 8).alias("c"))


@query("SELECT rec_id, CASE WHEN duration > 10 THEN 1 WHEN duration <= 10 THEN 2 END AS trip_type FROM taxi_trips WHERE lat IS NOT NULL AND lon IS NOT NULL")
def trip_type_case(spark, sf):
    return table(spark, sf, "taxi_trips").where("lat IS NOT NULL AND lon IS NOT NULL").select("rec_id", S.trip_type(F.col("duration"), 10).alias("trip_type"))


@query("""SELECT l_orderkey, l_linenumber, round(l_quantity * l_tax + l_extendedprice * l_discount, 6) AS dot, [l_quantity + l_tax, l_extendedprice + l_discount] AS total,
  [l_quantity - l_tax, l_extendedprice - l_discount] AS diff, [l_quantity * 2.0::DOUBLE, l_extendedprice * 2.0::DOUBLE] AS twice, [1.0::DOUBLE, l_quantity, l_extendedprice] AS sample,
  '(' || CAST(l_tax AS VARCHAR) || ',' || CAST(l_discount AS VARCHAR) || ')' AS key, round(sqrt((l_tax - l_discount) * (l_tax - l_discount)), 9) AS distance FROM lineitem""")
def vector_ops(spark, sf):
    a, b = V.as_vector([F.col("l_quantity"), F.col("l_extendedprice")]), V.as_vector([F.col("l_tax"), F.col("l_discount")])
    return table(spark, sf, "lineitem").select(
        "l_orderkey", "l_linenumber", F.round(V.dot(a, b), 6).alias("dot"), V.add(a, b).alias("total"), V.subtract(a, b).alias("diff"), V.scale(a, 2.0).alias("twice"),
        V.with_intercept(a).alias("sample"), V.key(b).alias("key"), F.round(V.euclidean(V.take(b, 1), V.tail(b)), 9).alias("distance"),
    )


@query("SELECT l_returnflag, [min(l_quantity), min(l_discount), min(l_tax)] AS low, [max(l_quantity), max(l_discount), max(l_tax)] AS high FROM lineitem GROUP BY 1")
def componentwise_minmax(spark, sf):
    v = V.as_vector([F.col(c) for c in ("l_quantity", "l_discount", "l_tax")])
    return table(spark, sf, "lineitem").select("l_returnflag", v.alias("v")).groupBy("l_returnflag").agg(V.minima(F.col("v"), 3).alias("low"), V.maxima(F.col("v"), 3).alias("high"))


@query("SELECT l_orderkey, l_linenumber, l_quantity <= 25 AND l_tax <= l_discount AS below, l_quantity >= 25 AND l_tax >= l_discount AS above FROM lineitem")
def componentwise_less(spark, sf):
    a, b = V.as_vector([F.col("l_quantity"), F.col("l_tax")]), V.as_vector([F.lit(25.0), F.col("l_discount")])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.all_below(a, b).alias("below"), V.all_above(a, b).alias("above"))


HAVERSINE_SQL = """6371000.0::DOUBLE * 2 * atan2(sqrt(h), sqrt(greatest(1.0::DOUBLE - h, 0.0::DOUBLE)))"""
H_SQL = "sin(radians({b} - {a}) / 2) * sin(radians({b} - {a}) / 2) + cos(radians({a})) * cos(radians({b})) * sin(radians({d} - {c}) / 2) * sin(radians({d} - {c}) / 2)"


@query(f"SELECT rec_id, round({HAVERSINE_SQL}, 3) AS meters FROM (SELECT rec_id, {H_SQL.format(a='lat', b='41.15::DOUBLE', c='lon', d='(-8.61::DOUBLE)')} AS h FROM taxi_trips WHERE lat IS NOT NULL AND lon IS NOT NULL)")
def haversine(spark, sf):
    d = S.haversine(F.col("lat"), F.col("lon"), F.lit(41.15), F.lit(-8.61))
    return table(spark, sf, "taxi_trips").where("lat IS NOT NULL AND lon IS NOT NULL").select("rec_id", F.round(d, 3).alias("meters"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_extract(spark, sf):
    return table(spark, sf, "events").select("event_id", *[c.cast("bigint").alias("k") for c in IO.json_paths(F.col("props"), {"k": "k"})])


@query("SELECT rec_id, CAST(start_ts AS DATE) AS day, CAST(hour(start_ts) AS INT) AS hour, CAST(dayofweek(start_ts) AS INT) AS weekday, num_measurements * 15 / 60 AS minutes, CASE WHEN num_measurements <> 0 THEN round((distance / 1000) / ((num_measurements * 15 / 60) / 60), 6) END AS kmh FROM taxi_trips")
def trip_calendar(spark, sf):
    day, hour, weekday = S.trip_calendar(F.col("start_ts"))
    minutes = S.duration_minutes(F.col("num_measurements"))
    return table(spark, sf, "taxi_trips").select("rec_id", day.alias("day"), hour.alias("hour"), weekday.alias("weekday"), minutes.alias("minutes"), F.round(S.speed_kmh(F.col("distance"), minutes), 6).alias("kmh"))


@query("SELECT vec_id, label, CAST(f - 1 AS INT) AS feature, CAST(embedding[f] AS DOUBLE) AS value FROM (SELECT *, unnest(range(1, 65)) AS f FROM embeddings)")
def split_unpivot(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("sample"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))
    return RF.unpivot(rows).select(F.col("sample").alias("vec_id"), "label", "feature", "value")


@query("""SELECT l_orderkey, l_linenumber, y AS t_0, x1 * y AS t_1, x2 * y AS t_2, 1.0::DOUBLE AS s_0_0, x1 AS s_0_1, x2 AS s_0_2, x1 * x1 AS s_1_1, x1 * x2 AS s_1_2, x2 * x2 AS s_2_2
  FROM (SELECT *, l_extendedprice / 100000 AS y, l_quantity / 50 AS x1, l_discount AS x2 FROM lineitem)""")
def feature_products(spark, sf):
    products = R.product_columns(F.col("l_extendedprice") / 100000, [F.col("l_quantity") / 50, F.col("l_discount")])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *[F.expr("1.0D").alias(n) if n == "s_0_0" else c.alias(n) for n, c in products.items()])


# -- exact counts, top-k, statistics, unions, joins ----------------------------------------------------------------------------


@query("SELECT count(*) AS n_samples, CAST(max(len(embedding)) AS INT) AS n_features, CAST(count(DISTINCT label) AS INT) AS n_labels, list_sort(list(DISTINCT label)) AS labels FROM embeddings")
def dataset_statistics(spark, sf):
    return E.dataset_statistics(table(spark, sf, "embeddings"), F.col("embedding"), F.col("label"))


@query(f"SELECT g0, g1, cnt FROM ({TAX_COUNTS_SQL})")
def exact_key_counts(spark, sf):
    return D.cell_counts(tax_cells(spark, sf))


KEYS_SQL = "SELECT user_id || ' ' || event_type AS key, count(*) AS cnt FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1"


def event_key() -> Column:
    return F.concat(F.col("user_id").cast("string"), F.lit(" "), F.col("event_type"))


@query(f"SELECT count(*) AS n_keys, count(*) FILTER (cnt = 1) AS n_single, count(*) FILTER (cnt > 1) AS n_more, CAST(sum(cnt) AS BIGINT) AS total, max(cnt) AS most FROM ({KEYS_SQL})")
def key_count_profile(spark, sf):
    counts = C.key_counts(table(spark, sf, "events"), event_key())
    return counts.agg(F.count(F.lit(1)).alias("n_keys"), F.count_if(F.col("cnt") == 1).alias("n_single"), F.count_if(F.col("cnt") > 1).alias("n_more"), F.sum("cnt").alias("total"), F.max("cnt").alias("most"))


@query(f"SELECT CAST(row_number() OVER (ORDER BY cnt DESC, key) AS INT) AS rank, key, cnt FROM ({KEYS_SQL}) ORDER BY cnt DESC, key LIMIT 25")
def topk_keys(spark, sf):
    return TK.top_k(C.key_counts(table(spark, sf, "events"), event_key()), 25)


@query("SELECT 'customer' AS origin, c_nationkey AS nationkey, c_acctbal AS balance FROM customer UNION ALL SELECT 'supplier', s_nationkey, s_acctbal FROM supplier")
def union_tagged(spark, sf):
    c, s = table(spark, sf, "customer"), table(spark, sf, "supplier")
    return IO.tagged(customer=c.select(F.col("c_nationkey").alias("nationkey"), F.col("c_acctbal").alias("balance")), supplier=s.select(F.col("s_nationkey").alias("nationkey"), F.col("s_acctbal").alias("balance"))).select("origin", "nationkey", "balance")


CANDIDATES_SQL = "SELECT CAST(unnest(range(64)) AS INT) AS feature, [-0.1::DOUBLE, 0.0::DOUBLE, 0.1::DOUBLE] AS candidates"


def samples(spark, sf) -> DataFrame:
    """All 64 features of every embedding."""
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("sample"), "label", F.transform("embedding", lambda x: x.cast("double")).alias("features"))


def fixed_candidates(spark, n: int = 64) -> DataFrame:
    return spark.range(n).select(F.col("id").cast("int").alias("feature"), F.array(F.lit(-0.1), F.lit(0.0), F.lit(0.1)).alias("candidates"))


@query(f"""SELECT vec_id AS sample, label, feature, CAST(embedding[feature + 1] AS DOUBLE) AS value, unnest(candidates) AS candidate FROM embeddings, ({CANDIDATES_SQL})""")
def broadcast_candidates_join(spark, sf):
    return RF.sample_splits(samples(spark, sf), fixed_candidates(spark)).select("sample", "label", "feature", "value", "candidate")


# -- Count-Min sketches --------------------------------------------------------------------------------------------------------


@query("SELECT delta, epsilon, CAST(ceil(ln(1 / delta)) AS INT) AS depth, CAST(ceil(2 / epsilon) AS INT) AS width FROM (SELECT unnest([0.5::DOUBLE, 0.1::DOUBLE, 0.01::DOUBLE]) AS delta), (SELECT unnest([0.01::DOUBLE, 0.003::DOUBLE, 0.0001::DOUBLE]) AS epsilon)")
def cms_sizing(spark, sf):
    rows = [(d, e, *(lambda s: (s.depth, s.width))(C.Sizing.of(d, e))) for d in (0.5, 0.1, 0.01) for e in (0.01, 0.003, 0.0001)]
    return spark.createDataFrame(rows, "delta double, epsilon double, depth int, width int")


@query(TAX_SKETCH_SQL)
def cms_build(spark, sf):
    return tax_sketch(spark, sf)


@query(estimates_sql(TAX_COUNTS_SQL, TAX_SKETCH_SQL, TAX_SIZING, "g0, g1"))
def cms_point_lookup(spark, sf):
    return D.estimate_cells(tax_sketch(spark, sf), tax_cells(spark, sf).distinct(), 2, TAX_SIZING)


@query(TAX_SKETCH_SQL)
def cms_merge(spark, sf):
    rows = table(spark, sf, "lineitem")
    parts = [D.sketch_cells(D.to_cells(rows.where(c), [F.col("l_tax"), F.col("l_discount")], 2), 2, TAX_SIZING) for c in ("l_returnflag = 'R'", "l_returnflag <> 'R' OR l_returnflag IS NULL")]
    return C.merge(*parts)


@query(f'SELECT CAST(coalesce(sum(cnt), 0) AS BIGINT) AS total FROM ({TAX_SKETCH_SQL}) WHERE "row" = 0')
def cms_row_sum(spark, sf):
    return C.row_sum(tax_sketch(spark, sf))


SMALL = C.Sizing(2, 8)
SMALL_SKETCH_SQL = f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(TAX_COUNTS_SQL, SMALL, "cnt")}) GROUP BY 1, 2'


@query(f"""SELECT "row", array_to_string(list(lpad(CAST(coalesce(cnt, 0) AS VARCHAR), 6, ' ') ORDER BY col), ' ') AS line
  FROM (SELECT r."row", r.col, s.cnt FROM (SELECT * FROM (SELECT DISTINCT "row" FROM ({SMALL_SKETCH_SQL})), (SELECT unnest(range(8)) AS col)) r LEFT JOIN ({SMALL_SKETCH_SQL}) s USING ("row", col)) GROUP BY 1""")
def cms_dump(spark, sf):
    return C.dump(D.sketch_cells(tax_cells(spark, sf), 2, SMALL), SMALL, 6)


WSIZING = C.Sizing.of(0.1, 0.01, weighted=True)
NATION_SUMS_SQL = "SELECT CAST(c_nationkey AS VARCHAR) AS key, sum(c_acctbal) AS val FROM customer WHERE c_nationkey IS NOT NULL GROUP BY 1"
WSKETCH_SQL = f'SELECT "row", col, sum(val) AS cnt FROM ({hash_sql(NATION_SUMS_SQL, WSIZING, "val")}) GROUP BY 1, 2'


def weighted_sketch(spark, sf):
    return C.build_weighted(table(spark, sf, "customer"), F.col("c_nationkey").cast("string"), F.col("c_acctbal"), WSIZING)


@query(f'SELECT "row", col, round(cnt, 2) AS val FROM ({WSKETCH_SQL})')
def wcms_build(spark, sf):
    return weighted_sketch(spark, sf).select("row", "col", F.round("val", 2).alias("val"))


@query(f'SELECT key, round(min(coalesce(s.cnt, 0)), 2) AS estimate FROM ({hash_sql("SELECT CAST(n_nationkey AS VARCHAR) AS key FROM nation", WSIZING)}) k LEFT JOIN ({WSKETCH_SQL}) s USING ("row", col) GROUP BY 1')
def wcms_lookup(spark, sf):
    keys = table(spark, sf, "nation").select(F.col("n_nationkey").cast("string").alias("key"))
    return C.lookup(weighted_sketch(spark, sf), keys, WSIZING, value="val").select("key", F.round("estimate", 2).alias("estimate"))


EVENT_SIZING = C.Sizing.of(0.05, 0.005)
EVENT_SKETCH_SQL = f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(KEYS_SQL, EVENT_SIZING, "cnt")}) GROUP BY 1, 2'


@query(f"""SELECT count(*) AS n_keys, CAST(sum(real) AS BIGINT) AS total, CAST(sum(cnt) AS BIGINT) AS estimated_total, max(cnt - real) AS max_error, count(*) FILTER (cnt > real) AS n_over,
  count(*) FILTER (cnt < real) AS n_under, count(*) FILTER (cnt - real > 2.0::DOUBLE * (SELECT count(*) FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL) / {EVENT_SIZING.width}) AS n_beyond_bound
  FROM ({estimates_sql(KEYS_SQL.replace("AS cnt", "AS real"), EVENT_SKETCH_SQL, EVENT_SIZING, "real")})""")
def cms_error_vs_exact(spark, sf):
    counts = C.key_counts(table(spark, sf, "events"), event_key())
    total = counts.agg(F.coalesce(F.sum("cnt"), F.lit(0))).first()[0]
    estimated = C.lookup(C.from_counts(counts, EVENT_SIZING), counts.select("key"), EVENT_SIZING)
    return C.error_profile(counts, estimated, EVENT_SIZING.error_bound(total))


# -- Bloom filters ---------------------------------------------------------------------------------------------------------------

BLOOM_RATE = 0.02
BLOOM_KEYS_SQL = "SELECT DISTINCT CAST(user_id AS VARCHAR) || ' ' || event_type AS key FROM events WHERE user_id IS NOT NULL AND (event_type = 'purchase' OR event_type = 'error')"
_HASHES = B.BloomSizing.of_rate(BLOOM_RATE, 1).hashes


class _CountedRows:
    """Hash rows of a filter sized for the counted keys, for ``hash_sql``."""

    def __init__(self, keys: str, hashes: int) -> None:
        self.depth, self.expected = hashes, f"(SELECT greatest(count(*), 1) FROM ({keys}))"
        self.width = f"(SELECT CAST(ceil({hashes} / ln(2.0::DOUBLE) * {self.expected}) AS BIGINT))"


BLOOM_ROWS = _CountedRows(BLOOM_KEYS_SQL, _HASHES)
BLOOM_SQL = f"SELECT DISTINCT col % {BLOOM_ROWS.width} AS bit FROM ({hash_sql(BLOOM_KEYS_SQL, BLOOM_ROWS)})"


def bloom_members(spark, sf) -> DataFrame:
    """The keys in the filter: users that bought or met an error. The keys of all events are asked for, so the others are known not to be in it."""
    rows = table(spark, sf, "events").where("event_type IN ('purchase', 'error')")
    return rows.select(event_key().alias("key")).where("key IS NOT NULL").distinct()


def bloom(spark, sf) -> tuple[DataFrame, B.BloomSizing]:
    """The filter, sized for the counted number of its keys."""
    members = stage(bloom_members(spark, sf), "members")
    sizing = B.BloomSizing.of_rate(BLOOM_RATE, max(1, members.count()))
    return B.build(members, F.col("key"), sizing), sizing


@query(BLOOM_SQL)
def bloom_build(spark, sf):
    return bloom(spark, sf)[0]


@query(BLOOM_SQL)
def bloom_words(spark, sf):
    """The filter written as 64-bit words and made again from them."""
    return B.from_words(B.to_words(bloom(spark, sf)[0]))


@query(f"SELECT key, bool_and(b.bit IS NOT NULL) AS maybe FROM ({hash_sql(KEYS_SQL, BLOOM_ROWS)}) k LEFT JOIN ({BLOOM_SQL}) b ON k.col % {BLOOM_ROWS.width} = b.bit GROUP BY 1")
def bloom_contains(spark, sf):
    filter_, sizing = bloom(spark, sf)
    return B.contains(filter_, table(spark, sf, "events").select(event_key().alias("key")).where("key IS NOT NULL").distinct(), sizing)


@query(f"""SELECT {BLOOM_ROWS.width} AS bits, {_HASHES} AS hashes, round(pow(1 - exp(-{_HASHES} * {BLOOM_ROWS.expected}::DOUBLE / {BLOOM_ROWS.width}), {_HASHES}), 9) AS expected_rate,
  (SELECT count(*) FROM ({BLOOM_SQL})) AS n_bits, (SELECT bool_and(b.bit IS NOT NULL) FROM ({hash_sql(BLOOM_KEYS_SQL, BLOOM_ROWS)}) k LEFT JOIN ({BLOOM_SQL}) b ON k.col % {BLOOM_ROWS.width} = b.bit) AS all_maybe""")
def bloom_fpp(spark, sf):
    filter_, sizing = bloom(spark, sf)
    every = B.contains_all(filter_, bloom_members(spark, sf), sizing).scalar()
    return B.set_bits(filter_).select(
        F.lit(sizing.bits).cast("bigint").alias("bits"), F.lit(sizing.hashes).alias("hashes"), F.lit(round(sizing.false_positive_rate(), 9)).alias("expected_rate"), "n_bits", every.alias("all_maybe")
    )


@query()
def bloom_split_sides(spark, sf):
    """Each sample, feature and candidate with the sides that two filters, sized for the counted splits, give it. Without a SQL twin: 192 hashed keys a sample are too
    slow there; tested against the plain comparison."""
    splits = RF.sample_splits(samples(spark, sf), fixed_candidates(spark))
    sizing = B.BloomSizing.of_rate(0.01, max(1, splits.count()))
    left, right = RF.split_filters(splits, sizing)
    return RF.filtered_sides(splits, left, right, sizing)


# -- grids and discovery ------------------------------------------------------------------------------------------------------------


@query(f"SELECT g0, g1 FROM ({TAX_BOX_SQL})")
def grid_enumerate(spark, sf):
    return G.enumerate_observed(tax_cells(spark, sf), ["g0", "g1"])


@query("SELECT x, y FROM (SELECT unnest(range(0, 11)) AS x), (SELECT unnest(range(0, 11)) AS y)")
def grid_static(spark, sf):
    return G.enumerate_box(spark, [0, 0], [10, 10], ["x", "y"])


@query(TAX_ENUM_SQL)
def discover_enumeration(spark, sf):
    return D.by_enumeration(tax_sketch(spark, sf), tax_cells(spark, sf), 2, TAX_SIZING)


@query(f"SELECT CAST(row_number() OVER (ORDER BY cnt DESC, {TAX_KEY_SQL}) AS INT) AS rank, g0, g1, {TAX_KEY_SQL} AS key, cnt FROM ({TAX_HH_SQL})")
def discover_heavy_hitters(spark, sf):
    return D.by_heavy_hitters(tax_sketch(spark, sf), tax_cells(spark, sf), 2, TAX_SIZING, 20).select("rank", "g0", "g1", "key", "cnt")


@query(f"""SELECT g0, g1, e.cnt, coalesce(h.cnt, 0) AS hh_cnt, CASE WHEN h.cnt IS NULL THEN 0 ELSE e.cnt END AS hh_estimate FROM ({TAX_ENUM_SQL}) e LEFT JOIN ({TAX_HH_SQL}) h USING (g0, g1)""")
def hh_input_space(spark, sf):
    sketch, cells = tax_sketch(spark, sf), tax_cells(spark, sf)
    return D.heavy_hitter_grid(D.by_enumeration(sketch, cells, 2, TAX_SIZING), D.by_heavy_hitters(sketch, cells, 2, TAX_SIZING, 20))


@query(f"SELECT g1, list(cnt ORDER BY g0) AS line FROM ({TAX_ENUM_SQL}) GROUP BY 1")
def grid_matrix(spark, sf):
    return D.grid_matrix(D.by_enumeration(tax_sketch(spark, sf), tax_cells(spark, sf), 2, TAX_SIZING), "g0", "g1", "cnt")


_DRAW = "CAST(floor(((((id + 1) * (48271 + 2 * {d}) + 11 * 69621 + {d}) % 2147483647 * 16807 % 2147483647) * 39373 % 2147483647) * 201 / 2147483647) AS BIGINT) - 100 AS g{d}"
RANDOM_SQL = f"SELECT {_DRAW.format(d=0)}, {_DRAW.format(d=1)} FROM (SELECT unnest(range(500)) AS id)"
RANDOM_ENUM_SQL = estimates_sql(f"SELECT DISTINCT g0, g1, {TAX_KEY_SQL} AS key FROM ({RANDOM_SQL})", TAX_SKETCH_SQL, TAX_SIZING, "g0, g1")


@query(f"SELECT g0, g1, cnt FROM ({RANDOM_SQL}) JOIN ({RANDOM_ENUM_SQL}) USING (g0, g1)")
def discover_random(spark, sf):
    return D.by_random_points(spark, tax_sketch(spark, sf), 2, 500, 2, TAX_SIZING, 11)


# -- regression -------------------------------------------------------------------------------------------------------------------------

REG_SIZING = C.Sizing.of(0.1, 0.001)
REG_CELLS_SQL = "SELECT CAST(floor(l_extendedprice / 100000 * 100 + 0.5) AS BIGINT) AS g0, CAST(floor(l_quantity / 50 * 100 + 0.5) AS BIGINT) AS g1 FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL"
REG_COUNTS_SQL = f"SELECT g0, g1, {TAX_KEY_SQL} AS key, count(*) AS cnt FROM ({REG_CELLS_SQL}) GROUP BY g0, g1"
REG_SKETCH_SQL = f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(REG_COUNTS_SQL, REG_SIZING, "cnt")}) GROUP BY 1, 2'
REG_ENUM_SQL = estimates_sql(TAX_BOX_SQL.replace(TAX_CELLS_SQL, REG_CELLS_SQL), REG_SKETCH_SQL, REG_SIZING, "g0, g1")
REG_HH_SQL = f"SELECT * FROM ({estimates_sql(REG_COUNTS_SQL, REG_SKETCH_SQL, REG_SIZING, 'g0, g1')}) ORDER BY cnt DESC, {TAX_KEY_SQL} LIMIT 200"
MOMENTS_SQL = """SELECT CAST(sum(cnt) AS DOUBLE) AS n, CAST(sum(cnt) AS DOUBLE) AS s_0_0, sum(cnt * (g1 / 100::DOUBLE)) AS s_0_1, sum(cnt * (g1 / 100::DOUBLE) * (g1 / 100::DOUBLE)) AS s_1_1,
  sum(cnt * (g0 / 100::DOUBLE)) AS t_0, sum(cnt * (g1 / 100::DOUBLE) * (g0 / 100::DOUBLE)) AS t_1 FROM ({cells})"""
GD_SQL = """WITH RECURSIVE m AS (""" + MOMENTS_SQL + """), d(step, a, b) AS (SELECT 0, 1.0::DOUBLE, 1.0::DOUBLE UNION ALL
  SELECT step + 1, a - 0.5::DOUBLE * (s_0_0 * a + s_0_1 * b - t_0) / n, b - 0.5::DOUBLE * (s_0_1 * a + s_1_1 * b - t_1) / n FROM d, m WHERE step < 20)
  SELECT step, round(a, 9) AS theta0, round(b, 9) AS theta1 FROM d"""


def regression_cells(spark, sf):
    return D.to_cells(table(spark, sf, "lineitem"), [F.col("l_extendedprice") / 100000, F.col("l_quantity") / 50], 2)


def _fit_linear(spark, cells: DataFrame) -> DataFrame:
    trace = R.linear(cells, F.col("g0") / 100.0, [F.col("g1") / 100.0], F.col("cnt"), steps=20)
    return trace.frame(spark).select("step", *[F.round(f"theta{d}", 9).alias(f"theta{d}") for d in (0, 1)])


@query(f"SELECT round(n, 6) AS n, round(s_0_0, 6) AS s_0_0, round(s_0_1, 6) AS s_0_1, round(s_1_1, 6) AS s_1_1, round(t_0, 6) AS t_0, round(t_1, 6) AS t_1 FROM ({MOMENTS_SQL.format(cells=REG_COUNTS_SQL)})")
def linear_moments(spark, sf):
    m = R.moments(D.cell_counts(regression_cells(spark, sf)), F.col("g0") / 100.0, [F.col("g1") / 100.0], F.col("cnt"))
    return m.select(*[F.round(c, 6).alias(c) for c in m.columns])


@query(GD_SQL.format(cells=REG_COUNTS_SQL))
def linear_gd_exact(spark, sf):
    return _fit_linear(spark, D.cell_counts(regression_cells(spark, sf)))


@query(GD_SQL.format(cells=REG_ENUM_SQL))
def linear_gd_enum(spark, sf):
    cells = regression_cells(spark, sf)
    return _fit_linear(spark, D.by_enumeration(D.sketch_cells(cells, 2, REG_SIZING), cells, 2, REG_SIZING))


@query(GD_SQL.format(cells=REG_HH_SQL))
def linear_gd_hh(spark, sf):
    cells = regression_cells(spark, sf)
    return _fit_linear(spark, D.by_heavy_hitters(D.sketch_cells(cells, 2, REG_SIZING), cells, 2, REG_SIZING, 200))


LOGIT_CELLS_SQL = "SELECT CAST(floor((CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) * 100 + 0.5) AS BIGINT) AS g0, CAST(floor(l_quantity / 50 * 100 + 0.5) AS BIGINT) AS g1 FROM lineitem WHERE l_returnflag IS NOT NULL AND l_quantity IS NOT NULL"
LOGIT_COUNTS_SQL = f"SELECT g0, g1, {TAX_KEY_SQL} AS key, count(*) AS cnt FROM ({LOGIT_CELLS_SQL}) GROUP BY g0, g1"
LOGIT_SKETCH_SQL = f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(LOGIT_COUNTS_SQL, REG_SIZING, "cnt")}) GROUP BY 1, 2'
LOGIT_HH_SQL = f"SELECT * FROM ({estimates_sql(LOGIT_COUNTS_SQL, LOGIT_SKETCH_SQL, REG_SIZING, 'g0, g1')}) ORDER BY cnt DESC, {TAX_KEY_SQL} LIMIT 60"


def _logit_sql(cells: str, steps: int) -> str:
    out = f"WITH c AS MATERIALIZED (SELECT g0 / 100::DOUBLE AS y, g1 / 100::DOUBLE AS x, cnt FROM ({cells})), s0 AS (SELECT 1.0::DOUBLE AS a, 1.0::DOUBLE AS b)"
    for i in range(1, steps + 1):
        p = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + x * b))))"
        out += f", s{i} AS MATERIALIZED (SELECT any_value(a) + 0.5::DOUBLE * sum((y - {p}) * cnt) / sum(cnt) AS a, any_value(b) + 0.5::DOUBLE * sum((y - {p}) * cnt * x) / sum(cnt) AS b FROM c, s{i - 1})"
    return out + " " + " UNION ALL ".join(f"SELECT {i} AS step, round(a, 9) AS theta0, round(b, 9) AS theta1 FROM s{i}" for i in range(steps + 1))


@query(_logit_sql(LOGIT_HH_SQL, 6))
def logistic_gd_hh(spark, sf):
    y = F.when(F.col("l_returnflag") == "R", F.lit(1)).when(F.col("l_returnflag").isNotNull(), F.lit(0))
    cells = D.to_cells(table(spark, sf, "lineitem"), [y, F.col("l_quantity") / 50], 2)
    hh = D.by_heavy_hitters(D.sketch_cells(cells, 2, REG_SIZING), cells, 2, REG_SIZING, 60).select("g0", "g1", "cnt")
    trace = R.logistic(stage(hh, "cells"), F.col("g0") / 100.0, [F.col("g1") / 100.0], F.col("cnt"), steps=6)
    return trace.frame(spark).select("step", *[F.round(f"theta{d}", 9).alias(f"theta{d}") for d in (0, 1)])


def _logit_cells(spark, sf) -> DataFrame:
    y = F.when(F.col("l_returnflag") == "R", F.lit(1)).when(F.col("l_returnflag").isNotNull(), F.lit(0))
    return D.to_cells(table(spark, sf, "lineitem"), [y, F.col("l_quantity") / 50], 2)


def _logit_trace(spark, found: DataFrame, steps: int = 6) -> DataFrame:
    trace = R.logistic(stage(found.select("g0", "g1", "cnt"), "cells"), F.col("g0") / 100.0, [F.col("g1") / 100.0], F.col("cnt"), steps=steps)
    return trace.frame(spark).select("step", *[F.round(f"theta{d}", 9).alias(f"theta{d}") for d in (0, 1)])


@query(_logit_sql(LOGIT_COUNTS_SQL, 6))
def logistic_gd_exact(spark, sf):
    return _logit_trace(spark, D.cell_counts(_logit_cells(spark, sf)))


LOGIT_ENUM_SQL = estimates_sql(TAX_BOX_SQL.replace(TAX_CELLS_SQL, LOGIT_CELLS_SQL), LOGIT_SKETCH_SQL, REG_SIZING, "g0, g1")


@query(_logit_sql(LOGIT_ENUM_SQL, 6))
def logistic_gd_enum(spark, sf):
    cells = _logit_cells(spark, sf)
    return _logit_trace(spark, D.by_enumeration(D.sketch_cells(cells, 2, REG_SIZING), cells, 2, REG_SIZING))


def _newton_sql(cells: str, steps: int) -> str:
    out = f"WITH c AS MATERIALIZED (SELECT g0 / 100::DOUBLE AS y, g1 / 100::DOUBLE AS x, cnt FROM ({cells})), s0 AS (SELECT 0.0::DOUBLE AS a, 0.0::DOUBLE AS b)"
    p = "(1.0::DOUBLE / (1.0::DOUBLE + exp(-(a + x * b))))"
    for i in range(1, steps + 1):
        out += f""", m{i} AS MATERIALIZED (SELECT any_value(a) AS a, any_value(b) AS b, sum((y - {p}) * cnt) AS g, sum((y - {p}) * cnt * x) AS h, sum({p} * (1 - {p}) * cnt) AS u,
          sum({p} * (1 - {p}) * cnt * x) AS v, sum({p} * (1 - {p}) * cnt * x * x) AS w FROM c, s{i - 1}), s{i} AS MATERIALIZED (SELECT a + (w * g - v * h) / (u * w - v * v) AS a, b + (u * h - v * g) / (u * w - v * v) AS b FROM m{i})"""
    return out + " " + " UNION ALL ".join(f"SELECT {i} AS step, round(a, 7) AS theta0, round(b, 7) AS theta1 FROM s{i}" for i in range(steps + 1))


@query(_newton_sql(LOGIT_COUNTS_SQL, 4))
def logistic_newton(spark, sf):
    cells = stage(D.cell_counts(_logit_cells(spark, sf)), "cells")
    trace = R.logistic_newton(cells, F.col("g0") / 100.0, [F.col("g1") / 100.0], F.col("cnt"), 4)
    return trace.frame(spark).select("step", *[F.round(f"theta{d}", 7).alias(f"theta{d}") for d in (0, 1)])


@query(f"SELECT l_orderkey, l_linenumber, round(theta0 + theta1 * (l_quantity / 50), 6) AS predicted FROM lineitem, (SELECT * FROM ({GD_SQL.format(cells=REG_COUNTS_SQL)}) WHERE step = 20)")
def linear_predict(spark, sf):
    """Every row by the model learned from the exact cells."""
    trace = R.linear(D.cell_counts(regression_cells(spark, sf)), F.col("g0") / 100.0, [F.col("g1") / 100.0], F.col("cnt"), steps=20)
    model = R.LinearModel([round(t, 9) for t in trace.model])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(model.predict([F.col("l_quantity") / 50]), 6).alias("predicted"))


@query(f"SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-(theta0 + theta1 * (l_quantity / 50)))), 6) AS predicted FROM lineitem, (SELECT * FROM ({_logit_sql(LOGIT_COUNTS_SQL, 6)}) WHERE step = 6)")
def logistic_predict(spark, sf):
    """The probability of every row by the model learned from the exact cells."""
    cells = stage(D.cell_counts(_logit_cells(spark, sf)), "cells")
    trace = R.logistic(cells, F.col("g0") / 100.0, [F.col("g1") / 100.0], F.col("cnt"), steps=6)
    model = R.LogisticModel([round(t, 9) for t in trace.model])
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.round(model.predict([F.col("l_quantity") / 50]), 6).alias("predicted"))


WORKER_CELLS_SQL = "SELECT CAST(l_linenumber AS INT) AS worker, CAST(floor(l_extendedprice / 100000 * 100 + 0.5) AS BIGINT) AS g0, CAST(floor(l_quantity / 50 * 100 + 0.5) AS BIGINT) AS g1 FROM lineitem WHERE l_extendedprice IS NOT NULL AND l_quantity IS NOT NULL"


@query(f"""WITH RECURSIVE m AS (SELECT worker, count(*)::DOUBLE AS n, count(*)::DOUBLE AS s_0_0, sum(g1 / 100::DOUBLE) AS s_0_1, sum((g1 / 100::DOUBLE) * (g1 / 100::DOUBLE)) AS s_1_1, sum(g0 / 100::DOUBLE) AS t_0,
    sum((g1 / 100::DOUBLE) * (g0 / 100::DOUBLE)) AS t_1 FROM ({WORKER_CELLS_SQL}) GROUP BY 1), d(worker, step, a, b) AS (SELECT worker, 0, 1.0::DOUBLE, 1.0::DOUBLE FROM m UNION ALL
  SELECT d.worker, step + 1, a - 0.5::DOUBLE * (s_0_0 * a + s_0_1 * b - t_0) / n, b - 0.5::DOUBLE * (s_0_1 * a + s_1_1 * b - t_1) / n FROM d JOIN m ON d.worker = m.worker WHERE step < 10)
  SELECT worker, round(a, 7) AS theta0, round(b, 7) AS theta1 FROM d WHERE step = 10 UNION ALL SELECT NULL, round(avg(a), 7), round(avg(b), 7) FROM d WHERE step = 10""")
def linear_workers(spark, sf):
    """The models that the workers learn on their own rows, and (worker null) their mean."""
    rows = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("worker"), G.grid_index(F.col("l_extendedprice") / 100000, 2).alias("g0"), G.grid_index(F.col("l_quantity") / 50, 2).alias("g1"))
    models, mean = R.linear_by_worker(rows, F.col("worker"), F.col("g0") / 100.0, [F.col("g1") / 100.0], F.lit(1.0), steps=10)
    out = [(w, *[round(t, 7) for t in m]) for w, m in [*models.items(), (None, mean)]]
    return spark.createDataFrame(out, "worker int, theta0 double, theta1 double")


@query("SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 4) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2, regr_count(l_extendedprice, l_quantity)::BIGINT AS n FROM lineitem")
def regr_closed_form(spark, sf):
    f = R.closed_form(table(spark, sf, "lineitem"), F.col("l_extendedprice"), F.col("l_quantity"))
    return f.select(F.round("slope", 4).alias("slope"), F.round("intercept", 4).alias("intercept"), F.round("r2", 6).alias("r2"), "n")


# -- k-means -------------------------------------------------------------------------------------------------------------------------------

KM_SIZING = C.Sizing.of(0.1, 0.0005)
KM_CELLS_SQL = "SELECT CAST(floor(embedding[1]::DOUBLE * 100 + 0.5) AS BIGINT) AS g0, CAST(floor(embedding[2]::DOUBLE * 100 + 0.5) AS BIGINT) AS g1 FROM embeddings"
KM_COUNTS_SQL = f"SELECT g0, g1, {TAX_KEY_SQL} AS key, count(*) AS cnt FROM ({KM_CELLS_SQL}) GROUP BY g0, g1"
KM_SKETCH_SQL = f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(KM_COUNTS_SQL, KM_SIZING, "cnt")}) GROUP BY 1, 2'
KM_ENUM_SQL = estimates_sql(TAX_BOX_SQL.replace(TAX_CELLS_SQL, KM_CELLS_SQL), KM_SKETCH_SQL, KM_SIZING, "g0, g1")
KM_HH_SQL = f"SELECT * FROM ({estimates_sql(KM_COUNTS_SQL, KM_SKETCH_SQL, KM_SIZING, 'g0, g1')}) ORDER BY cnt DESC, {TAX_KEY_SQL} LIMIT 100"
START = {1: [-15.0, -10.0], 2: [10.0, 0.0], 3: [0.0, 12.0]}


def _kmeans_sql(cells: str, iterations: int) -> str:
    start = " UNION ALL ".join(f"SELECT {i} AS id, {c[0]}::DOUBLE AS x, {c[1]}::DOUBLE AS y" for i, c in START.items())
    out = f"WITH p AS MATERIALIZED (SELECT g0, g1, cnt FROM ({cells}) WHERE cnt > 0), c0 AS ({start})"
    for i in range(1, iterations + 1):
        d = "(g0 - x) * (g0 - x) + (g1 - y) * (g1 - y)"
        out += f", c{i} AS MATERIALIZED (SELECT id, sum(g0 * cnt)::DOUBLE / sum(cnt)::DOUBLE AS x, sum(g1 * cnt)::DOUBLE / sum(cnt)::DOUBLE AS y FROM (SELECT g0, g1, any_value(cnt) AS cnt, arg_min(id, ({d}, id)) AS id FROM p, c{i - 1} GROUP BY g0, g1) GROUP BY id)"
    return out + f" SELECT id, round(x, 9) AS x0, round(y, 9) AS x1 FROM c{iterations}"


def kmeans_cells(spark, sf):
    """The first two coordinates: a grid that is enumerated has few axes. All 64 are in kmeans_exact_wide."""
    e = lambda i: F.col("embedding")[i].cast("double")
    return D.to_cells(table(spark, sf, "embeddings"), [e(0), e(1)], 2)


def _kmeans(spark, cells: DataFrame) -> DataFrame:
    kept = stage(cells.select("g0", "g1", "cnt"), "cells")
    centers = K.run(kept, [F.col("g0"), F.col("g1")], F.col("cnt"), START, 3)
    return K.frame(spark, centers).select("id", F.round("x0", 9).alias("x0"), F.round("x1", 9).alias("x1"))


WIDE_START = {i: [v] * 64 for i, v in ((1, -0.1), (2, 0.1), (3, 0.0))}
_WIDE_CENTERS = " UNION ALL ".join(f"SELECT {i} AS id, [{c[0]}::DOUBLE FOR k IN range(64)] AS c" for i, c in WIDE_START.items())


@query(f"WITH c AS ({_WIDE_CENTERS}) SELECT vec_id, arg_min(id, (round(list_sum([(embedding[k]::DOUBLE - c.c[k]) ** 2 FOR k IN range(1, 65)]), 12), id)) AS center FROM embeddings, c GROUP BY 1")
def kmeans_assign(spark, sf):
    """All 64 coordinates."""
    e = [F.col("embedding")[i].cast("double") for i in range(64)]
    return K.assign(table(spark, sf, "embeddings"), e, WIDE_START).select("vec_id", "center")


def _wide_kmeans_sql(iterations: int) -> str:
    out = f"WITH p AS MATERIALIZED (SELECT vec_id, [x::DOUBLE FOR x IN embedding] AS e FROM embeddings), c0 AS ({_WIDE_CENTERS})"
    for i in range(1, iterations + 1):
        out += f""", a{i} AS MATERIALIZED (SELECT vec_id, any_value(e) AS e, arg_min(id, (round(list_sum([(e[k] - c.c[k]) ** 2 FOR k IN range(1, 65)]), 12), id)) AS id FROM p, c{i - 1} c GROUP BY vec_id),
          c{i} AS MATERIALIZED (SELECT id, list(v ORDER BY k) AS c FROM (SELECT id, k, avg(e[k]) AS v FROM (SELECT id, e, unnest(range(1, 65)) AS k FROM a{i}) GROUP BY id, k) GROUP BY id)"""
    return out + f" SELECT id, unnest(range(64))::INT AS d, round(unnest(c), 9) AS x FROM c{iterations}"


@query(_wide_kmeans_sql(2))
def kmeans_exact_wide(spark, sf):
    """Two iterations over all 64 coordinates of the rows themselves."""
    points = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)])
    centers = K.run(points, [F.col(f"x{i}") for i in range(64)], F.lit(1), WIDE_START, 2)
    return K.frame(spark, centers).select("id", F.posexplode(F.array(*[F.round(f"x{i}", 9) for i in range(64)])).alias("d", "x"))


@query(_kmeans_sql(KM_COUNTS_SQL, 3))
def kmeans_exact_iter3(spark, sf):
    return _kmeans(spark, D.cell_counts(kmeans_cells(spark, sf)))


@query(_kmeans_sql(KM_HH_SQL, 3))
def kmeans_sketch_hh_iter3(spark, sf):
    cells = kmeans_cells(spark, sf)
    return _kmeans(spark, D.by_heavy_hitters(D.sketch_cells(cells, 2, KM_SIZING), cells, 2, KM_SIZING, 100))


@query(_kmeans_sql(KM_ENUM_SQL, 3))
def kmeans_sketch_enum_iter3(spark, sf):
    cells = kmeans_cells(spark, sf)
    return _kmeans(spark, D.by_enumeration(D.sketch_cells(cells, 2, KM_SIZING), cells, 2, KM_SIZING, min_count=1))


# -- geo-temporal counts ----------------------------------------------------------------------------------------------------------------------

GEO_SIZING = C.Sizing.of(0.1, 0.001)
BOX = (4110, -870, 4120, -855)
WINDOW, RADIUS = 2, 2000.0
GEO_KEY_SQL = "'(' || CAST(g0 / 100::DOUBLE AS VARCHAR) || ',' || CAST(g1 / 100::DOUBLE AS VARCHAR) || ',' || CAST(g2::DOUBLE AS VARCHAR) || ',' || CAST(g3::DOUBLE AS VARCHAR) || ')'"
GEO_COUNTS_SQL = f"""SELECT g0, g1, g2, g3, {GEO_KEY_SQL} AS key, count(*) AS cnt FROM (SELECT CAST(floor(lat * 100 + 0.5) AS BIGINT) AS g0, CAST(floor(lon * 100 + 0.5) AS BIGINT) AS g1,
  CASE WHEN duration > 10 THEN 1 ELSE 2 END AS g2, hour_of_day AS g3 FROM taxi_trips WHERE lat IS NOT NULL AND lon IS NOT NULL AND duration IS NOT NULL AND hour_of_day IS NOT NULL) GROUP BY 1, 2, 3, 4"""
GEO_SKETCH_SQL = f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(GEO_COUNTS_SQL, GEO_SIZING, "cnt")}) GROUP BY 1, 2'
_FAR = HAVERSINE_SQL.replace("h)", "(" + H_SQL.format(a="(c0 / 100::DOUBLE)", b="(g0 / 100::DOUBLE)", c="(c1 / 100::DOUBLE)", d="(g1 / 100::DOUBLE)") + "))").replace("- h,", "- (" + H_SQL.format(a="(c0 / 100::DOUBLE)", b="(g0 / 100::DOUBLE)", c="(c1 / 100::DOUBLE)", d="(g1 / 100::DOUBLE)") + "),")
GEO_ASK_SQL = f"""SELECT CAST(c0 AS VARCHAR) || ':' || CAST(c1 AS VARCHAR) AS center, g0, g1 FROM (SELECT c0, c1, c0 + a AS g0, c1 + b AS g1 FROM (SELECT unnest(range({BOX[0]}, {BOX[2] + 1})) AS c0), (SELECT unnest(range({BOX[1]}, {BOX[3] + 1})) AS c1),
  (SELECT unnest(range(-{WINDOW}, {WINDOW + 1})) AS a), (SELECT unnest(range(-{WINDOW}, {WINDOW + 1})) AS b)) WHERE trunc({_FAR}) < {RADIUS}"""
PARZEN_SQL = f"""WITH ask AS MATERIALIZED ({GEO_ASK_SQL}), k AS MATERIALIZED (SELECT g0, g1, g2, g3, {GEO_KEY_SQL} AS key FROM (SELECT DISTINCT g0, g1 FROM ask), (SELECT unnest([1, 2]) AS g2), (SELECT CAST(unnest(range(24)) AS INT) AS g3)),
  e AS MATERIALIZED ({estimates_sql("SELECT * FROM k", GEO_SKETCH_SQL, GEO_SIZING, "g0, g1, g2, g3")}),
  c AS (SELECT g0, g1, g2, g3, coalesce(r.cnt, 0) AS real, e.cnt AS est FROM e LEFT JOIN ({GEO_COUNTS_SQL}) r USING (g0, g1, g2, g3)),
  w AS MATERIALIZED (SELECT center, g3 AS hour_slot, g2 AS trip_type, CAST(sum(real) AS BIGINT) AS real_count, CAST(sum(est) AS BIGINT) AS sketch_count,
    CAST(sum(CASE WHEN real = 0 THEN est ELSE 0 END) AS BIGINT) AS false_positive FROM ask JOIN c USING (g0, g1) GROUP BY 1, 2, 3)"""


TRIPS = PL.TripQuery(precision=2, window=WINDOW, radius=RADIUS, hour_step=1, limit_minutes=10, delta=0.1, epsilon=0.001, box=BOX)


def window_counts(spark, sf) -> DataFrame:
    return PL.trip_windows(table(spark, sf, "taxi_trips"), TRIPS)


@query(PARZEN_SQL + " SELECT * FROM w")
def parzen_counts(spark, sf):
    return window_counts(spark, sf)


PREDICT_SQL = PARZEN_SQL + """, v AS (SELECT center, hour_slot, coalesce(sum(real_count) FILTER (trip_type = 1), 0) AS rl, coalesce(sum(real_count) FILTER (trip_type = 2), 0) AS rs,
  coalesce(sum(sketch_count) FILTER (trip_type = 1), 0) AS sl, coalesce(sum(sketch_count) FILTER (trip_type = 2), 0) AS ss, sum(false_positive) AS fp FROM w GROUP BY 1, 2),
  f AS (SELECT *, rl > rs AS is_long, sl > ss AS predicted_long FROM v),
  t AS (SELECT count(*) AS n, count(*) FILTER (predicted_long AND is_long) AS true_positive, count(*) FILTER (predicted_long AND NOT is_long) AS false_positive,
  count(*) FILTER (NOT predicted_long AND is_long) AS false_negative, count(*) FILTER (NOT predicted_long AND NOT is_long) AS true_negative FROM f)"""


@query(PREDICT_SQL + " SELECT * FROM t")
def taxi_confusion(spark, sf):
    return E.confusion(P.long_or_short(window_counts(spark, sf)), F.col("predicted_long"), F.col("is_long"))


@query(PREDICT_SQL + """ SELECT *, true_positive / nullif(true_positive + false_positive, 0) AS precision, true_positive / nullif(true_positive + false_negative, 0) AS recall,
  (true_positive + true_negative) / nullif(n, 0) AS accuracy FROM t""")
def taxi_precision_recall(spark, sf):
    return E.precision_recall(E.confusion(P.long_or_short(window_counts(spark, sf)), F.col("predicted_long"), F.col("is_long")))


@query(PREDICT_SQL + f""" SELECT 0.1::DOUBLE AS delta, 0.001::DOUBLE AS epsilon, {GEO_SIZING.depth} AS depth, {GEO_SIZING.width} AS width, *, true_positive / nullif(true_positive + false_positive, 0) AS precision,
  true_positive / nullif(true_positive + false_negative, 0) AS recall, (true_positive + true_negative) / nullif(n, 0) AS accuracy FROM t""")
def taxi_pipeline(spark, sf):
    """The whole pipeline by one configuration, its results written and the summary read back."""
    path = scratch_path(spark, "taxi")
    done = PL.taxi_pipeline(table(spark, sf, "taxi_trips"), TRIPS, path)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in done.summary.schema)
    return IO.csv(spark, f"{path}/summary", schema, "\t")


@query(PARZEN_SQL + " SELECT trip_type, CAST(sum(sketch_count - real_count) AS BIGINT) AS total_error FROM w GROUP BY 1")
def taxi_error_totals(spark, sf):
    return E.error_totals(window_counts(spark, sf), ["trip_type"], F.col("sketch_count"), F.col("real_count"))


@query("SELECT bin, count(*) AS n FROM (SELECT CASE WHEN e < 0 THEN 0 WHEN e >= 20 THEN 21 ELSE CAST(floor(e) AS INT) + 1 END AS bin FROM (SELECT sketch_count - real_count AS e FROM trip_counts WHERE sketch_count IS NOT NULL AND real_count IS NOT NULL)) GROUP BY 1")
def error_histogram(spark, sf):
    return E.error_histogram(table(spark, sf, "trip_counts"), F.col("sketch_count") - F.col("real_count"), 0.0, 20.0, 20)


# -- votes, splits, histograms, forests -----------------------------------------------------------------------------------------------------------


@query("SELECT user_id, label, n_votes FROM (SELECT user_id, label, count(*) AS n_votes, row_number() OVER (PARTITION BY user_id ORDER BY count(*) DESC, label) AS r FROM (SELECT user_id, CAST(floor(value) AS BIGINT) % 5 AS label FROM events WHERE value IS NOT NULL) GROUP BY 1, 2) WHERE r = 1")
def majority_vote(spark, sf):
    votes = table(spark, sf, "events").where("value IS NOT NULL").select("user_id", (F.floor("value") % 5).alias("label"))
    return E.majority_vote(votes, "user_id", "label")


@query("SELECT count(*) AS n, round(avg(CASE WHEN o_orderstatus = CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'F' ELSE 'O' END THEN 1.0::DOUBLE ELSE 0 END), 9) AS accuracy FROM orders WHERE o_orderstatus IS NOT NULL")
def accuracy(spark, sf):
    guess = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "F").otherwise("O")
    return E.accuracy(table(spark, sf, "orders"), guess, F.col("o_orderstatus")).select("n", F.round("accuracy", 9).alias("accuracy"))


@query("""WITH j AS (SELECT o_orderkey, CASE WHEN o_orderdate < TIMESTAMP '1997-01-01' THEN 'F' ELSE 'O' END AS predicted, c_custkey FROM orders JOIN customer ON o_custkey = c_custkey)
  SELECT c_custkey, predicted, status AS actual FROM j JOIN (SELECT o_custkey, min(o_orderstatus) AS status FROM orders WHERE o_orderstatus IS NOT NULL GROUP BY 1) ON o_custkey = c_custkey""")
def prediction_truth_join(spark, sf):
    """Predictions of orders with the smallest status of the customer as truth, joined by id."""
    orders, customers = table(spark, sf, "orders"), table(spark, sf, "customer").select(F.col("c_custkey").alias("id"))
    guess = F.when(F.col("o_orderdate") < F.lit("1997-01-01").cast("timestamp_ntz"), "F").otherwise("O")
    predictions = orders.select(F.col("o_custkey").alias("id"), guess.alias("predicted")).join(customers, "id", "left_semi")
    return E.truth_join(predictions, orders.select(F.col("o_custkey").alias("id"), "o_orderstatus"), "id", "predicted", "o_orderstatus").select(F.col("id").alias("c_custkey"), "predicted", "actual")


GINI_SQL = f"""WITH s AS (SELECT label, feature, CAST(embedding[feature + 1] AS DOUBLE) AS value, unnest(candidates) AS candidate FROM embeddings, ({CANDIDATES_SQL}) WHERE label IS NOT NULL),
  c AS (SELECT feature, candidate, label, count(*) FILTER (value <= candidate)::DOUBLE AS l, count(*) FILTER (value > candidate)::DOUBLE AS r FROM s GROUP BY 1, 2, 3),
  t AS (SELECT feature, candidate, sum(l) AS lt, sum(r) AS rt FROM c GROUP BY 1, 2)
  SELECT feature, candidate, CAST(any_value(lt) AS BIGINT) AS "left", CAST(any_value(rt) AS BIGINT) AS "right", round(coalesce((1 - sum(((l + r) / (lt + rt)) ** 2)) - any_value(lt / (lt + rt)) * (1 - sum(CASE WHEN lt > 0 THEN (l / lt) ** 2 ELSE 0 END))
    - any_value(rt / (lt + rt)) * (1 - sum(CASE WHEN rt > 0 THEN (r / rt) ** 2 ELSE 0 END)), 0), 9) AS quality FROM c JOIN t USING (feature, candidate) GROUP BY 1, 2"""


def split_counts(spark, sf) -> DataFrame:
    s = RF.sample_splits(samples(spark, sf), fixed_candidates(spark)).where("label IS NOT NULL")
    low = F.col("value") <= F.col("candidate")
    return s.groupBy("feature", "candidate", "label").agg(F.sum(low.cast("bigint")).alias("n_left"), F.sum((~low).cast("bigint")).alias("n_right"))


@query(GINI_SQL)
def gini_by_split(spark, sf):
    return RF.node_quality(split_counts(spark, sf), 10).select("feature", "candidate", "left", "right", F.round("quality", 9).alias("quality"))


LEGACY_SQL = GINI_SQL[: GINI_SQL.index("SELECT feature, candidate, CAST(any_value(lt)")] + """
  SELECT feature, candidate, CAST(any_value(lt) AS BIGINT) AS "left", CAST(any_value(rt) AS BIGINT) AS "right",
    round(0.5::DOUBLE * (1 - sum((l / (lt + rt)) ** 2)) - 0.5::DOUBLE * (1 - sum((r / (lt + rt)) ** 2)), 9) AS quality FROM c JOIN t USING (feature, candidate) GROUP BY 1, 2"""


@query(LEGACY_SQL)
def split_quality_legacy(spark, sf):
    """The quality from shares of the node total."""
    return RF.node_quality(split_counts(spark, sf), 10, corrected=False).select("feature", "candidate", "left", "right", F.round("quality", 9).alias("quality"))


@query()
def approx_topk_native(spark, sf):
    rows = table(spark, sf, "events").select(event_key().alias("key")).where("key IS NOT NULL")
    return TK.approximate_top_k(rows, "key", 25)


@query()
def histogram_stream(spark, sf):
    v = table(spark, sf, "feature_values")
    return H.build(v, F.col("fvalue"), {"feature": F.col("feature")}, 64)


@query("""SELECT DISTINCT hist_id, CAST(list_sum([CASE WHEN b.x > 5 THEN b.y ELSE 0 END FOR b IN bins]) AS DOUBLE) AS above FROM histograms WHERE bins IS NOT NULL AND len(bins) > 0 AND list_bool_and([b.x IS NOT NULL AND b.y IS NOT NULL FOR b IN bins])""")
def histogram_above(spark, sf):
    h = table(spark, sf, "histograms").where("bins IS NOT NULL AND size(bins) > 0").where(F.forall("bins", lambda b: b["x"].isNotNull() & b["y"].isNotNull()))
    doubled = F.transform("bins", lambda b: F.struct(b["x"].alias("x"), b["y"].cast("double").alias("y")))
    return h.select("hist_id", H.count_above(doubled, F.lit(5.0)).alias("above")).distinct()


@query()
def histogram_split_points(spark, sf):
    return H.split_candidates(histogram_stream(spark, sf), ["feature"], 5)


def _forest(spark, sf):
    s = samples(spark, sf)
    values = RF.unpivot(s)
    candidates = H.split_candidates(H.build(values, F.col("value"), {"feature": F.col("feature")}, 32), ["feature"], 5)
    return s, RF.grow(s, candidates, 3, 64, 10, per_node=5, least=20, max_depth=4, seed=5)


@query()
def forest_grow(spark, sf):
    return _forest(spark, sf)[1]


@query()
def forest_predict(spark, sf):
    s, nodes = _forest(spark, sf)
    votes = RF.predict(s, stage(nodes, "nodes"))
    return E.majority_vote(votes, "sample", "label")


def _tree_sql(depth: int, least: int) -> str:
    """One tree over all features and fixed candidates, level by level: nodes (node, feature, split, label, bag_size)."""
    out = f"WITH f AS MATERIALIZED (SELECT feature, unnest(candidates) AS candidate FROM ({CANDIDATES_SQL})), n0 AS MATERIALIZED (SELECT vec_id, label, embedding, 0::BIGINT AS node, []::INT[] AS used FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL)"
    for d in range(depth + 1):
        out += f""", h{d} AS MATERIALIZED (SELECT node, arg_max(label, (n, -label)) AS major, CAST(sum(n) AS BIGINT) AS bag_size FROM (SELECT node, label, count(*) AS n FROM n{d} GROUP BY ALL) GROUP BY node)"""
        if d == depth:
            break
        out += f""", c{d} AS MATERIALIZED (SELECT node, feature, candidate, label, count(*) FILTER (embedding[feature + 1]::DOUBLE <= candidate)::DOUBLE AS l, count(*) FILTER (embedding[feature + 1]::DOUBLE > candidate)::DOUBLE AS r
            FROM n{d}, f WHERE NOT list_contains(used, feature) GROUP BY ALL),
          t{d} AS MATERIALIZED (SELECT node, feature, candidate, sum(l) AS lt, sum(r) AS rt FROM c{d} GROUP BY ALL),
          q{d} AS MATERIALIZED (SELECT node, feature, candidate, any_value(lt) AS lt, any_value(rt) AS rt, (1 - sum(((l + r) / (lt + rt)) ** 2)) - any_value(lt / (lt + rt)) * (1 - sum(CASE WHEN lt > 0 THEN (l / lt) ** 2 ELSE 0 END))
            - any_value(rt / (lt + rt)) * (1 - sum(CASE WHEN rt > 0 THEN (r / rt) ** 2 ELSE 0 END)) AS quality FROM c{d} JOIN t{d} USING (node, feature, candidate) GROUP BY ALL),
          b{d} AS MATERIALIZED (SELECT node, b.feature, b.candidate FROM (SELECT node, arg_max({{'feature': feature, 'candidate': candidate, 'lt': lt, 'rt': rt}}, (round(quality, 12), -feature, -candidate)) AS b FROM q{d} GROUP BY node) WHERE b.lt >= {least} AND b.rt >= {least}),
          n{d + 1} AS MATERIALIZED (SELECT vec_id, label, embedding, node * 2 + CASE WHEN embedding[feature + 1]::DOUBLE > candidate THEN 2 ELSE 1 END AS node, list_append(used, feature) AS used FROM n{d} JOIN b{d} USING (node))"""
    parts = [f"SELECT 0 AS tree, node, coalesce(feature, -1) AS feature, candidate AS split, CASE WHEN feature IS NULL THEN major ELSE -1 END AS label, bag_size FROM h{d} LEFT JOIN b{d} USING (node)" for d in range(depth)]
    parts.append(f"SELECT 0, node, -1, NULL, major, bag_size FROM h{depth}")
    return out + ", tree AS (" + " UNION ALL ".join(parts) + ")"


def one_tree(spark, sf) -> DataFrame:
    return RF.grow(samples(spark, sf), fixed_candidates(spark), 1, 64, 10, per_node=64, least=20, max_depth=2)


@query(_tree_sql(2, 20) + " SELECT * FROM tree")
def forest_tree(spark, sf):
    """One tree that looks at all features in every node, so that nothing is drawn."""
    return one_tree(spark, sf)


@query(_tree_sql(2, 20).replace("WITH f AS", "WITH RECURSIVE f AS", 1) + """, w(vec_id, embedding, node, label) AS (SELECT vec_id, embedding, 0::BIGINT, -1 FROM embeddings UNION ALL
  SELECT w.vec_id, w.embedding, CASE WHEN t.feature < 0 THEN -1 ELSE w.node * 2 + CASE WHEN w.embedding[t.feature + 1]::DOUBLE > t.split THEN 2 ELSE 1 END END, t.label FROM w JOIN tree t ON w.node = t.node)
  SELECT vec_id AS sample, label FROM w WHERE node = -1""")
def forest_tree_predict(spark, sf):
    return RF.predict(samples(spark, sf), stage(one_tree(spark, sf), "nodes")).select("sample", "label")


@query("""SELECT feature, count(*)::DOUBLE AS total, round(avg(fvalue), 6) AS mean FROM feature_values WHERE feature IS NOT NULL AND isfinite(fvalue) GROUP BY 1""")
def histogram_invariants(spark, sf):
    """What merging bins keeps: the total and the weighted mean of every feature's streaming histogram."""
    h = histogram_stream(spark, sf).select("feature", F.explode("bins").alias("b"))
    return h.groupBy("feature").agg(F.sum("b.y").alias("total"), F.round(F.sum(F.col("b.x") * F.col("b.y")) / F.sum("b.y"), 6).alias("mean"))


@query("""WITH w AS (SELECT DISTINCT ON (update_id) update_id, date_trunc('hour', update_ts) AS window_start, sketch_id FROM sketch_updates WHERE sketch_id IS NOT NULL AND update_ts IS NOT NULL AND update_id IS NOT NULL),
  c AS (SELECT window_start, CAST(sketch_id AS VARCHAR) AS key, count(*) AS cnt FROM w GROUP BY 1, 2)
  SELECT CAST(window_start AS TIMESTAMP) AS window_start, "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM (""" + hash_sql("SELECT * FROM c", TAX_SIZING, "window_start, cnt") + ") GROUP BY 1, 2, 3")
def sketch_windows(spark, sf):
    from cellwise.streaming.sketch_stream import windowed_counters

    rows = table(spark, sf, "sketch_updates").where("sketch_id IS NOT NULL AND update_ts IS NOT NULL AND update_id IS NOT NULL")
    once = rows.groupBy("update_id").agg(F.first("sketch_id").alias("sketch_id"), F.first("update_ts").alias("update_ts"))
    out = windowed_counters(once, F.col("sketch_id").cast("string"), "update_ts", TAX_SIZING)
    return out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz"))


# -- pipelines ------------------------------------------------------------------------------------------------------------------------------------

TRIP_ETL_PART = r"""
SELECT record_id, v[1] AS trip_id, TRY_CAST(v[5] AS BIGINT) AS taxi_id, v[2] AS call_type, TRY_CAST(v[6] AS BIGINT) AS trip_epoch,
  CAST(make_timestamp(TRY_CAST(v[6] AS BIGINT) * 1000000) AS DATE) AS day, CAST(hour(make_timestamp(TRY_CAST(v[6] AS BIGINT) * 1000000)) AS INT) AS hour,
  CAST(dayofweek(make_timestamp(TRY_CAST(v[6] AS BIGINT) * 1000000)) AS INT) AS weekday,
  CAST(v[9] AS DOUBLE[][])[1][1] AS lon, CAST(v[9] AS DOUBLE[][])[1][2] AS lat, CAST(len(CAST(v[9] AS DOUBLE[][])) AS INT) AS num_measurements, len(CAST(v[9] AS DOUBLE[][])) * 15 / 60 AS minutes
FROM q WHERE fmt = 'trip' AND reason = ''
"""


@query(P5_CTE + TRIP_ETL_PART)
def trip_etl(spark, sf):
    from cellwise.plans.pipelines import trip_etl as etl

    rows = etl(table(spark, sf, "raw_records"), F.col("record"), F.col("fmt"), {"record_id": F.col("record_id")})
    return rows.select("record_id", "trip_id", "taxi_id", "call_type", "trip_epoch", "day", "hour", "weekday", "lon", "lat", "num_measurements", "minutes")


_LEG = HAVERSINE_SQL.replace("h)", "(" + H_SQL.format(a="p[i][2]", b="p[i + 1][2]", c="p[i][1]", d="p[i + 1][1]") + "))").replace("- h,", "- (" + H_SQL.format(a="p[i][2]", b="p[i + 1][2]", c="p[i][1]", d="p[i + 1][1]") + "),")


@query(P5_CTE + f""", p AS (SELECT record_id, CAST(v[9] AS DOUBLE[][]) AS p FROM q WHERE fmt = 'trip' AND reason = ''),
  m AS (SELECT record_id, len(p) AS n, coalesce(list_sum([{_LEG} FOR i IN range(1, len(p))]), 0) AS meters FROM p)
  SELECT record_id, round(meters, 2) AS meters, CASE WHEN n > 0 THEN round((meters / 1000) / ((n * 15 / 60) / 60), 4) END AS kmh FROM m""")
def trip_distances(spark, sf):
    from cellwise.plans.pipelines import trip_etl as etl

    rows = etl(table(spark, sf, "raw_records"), F.col("record"), F.col("fmt"), {"record_id": F.col("record_id")})
    return rows.select("record_id", F.round("meters", 2).alias("meters"), F.round("kmh", 4).alias("kmh"))


SWEEP_SQL = " UNION ALL ".join(
    f"""SELECT {d}::DOUBLE AS delta, {e}::DOUBLE AS epsilon, {s.depth} AS depth, {s.width} AS width, count(*) AS n_keys, CAST(sum(real) AS BIGINT) AS total, CAST(sum(cnt) AS BIGINT) AS estimated_total,
  max(cnt - real) AS max_error, count(*) FILTER (cnt > real) AS n_over, count(*) FILTER (cnt < real) AS n_under, count(*) FILTER (cnt - real > 2.0::DOUBLE * (SELECT sum(real) FROM rk) / {s.width}) AS n_beyond_bound
  FROM ({estimates_sql("SELECT * FROM rk", f'SELECT "row", col, CAST(sum(real) AS BIGINT) AS cnt FROM ({hash_sql("SELECT * FROM rk", s, "real")}) GROUP BY 1, 2', s, "real")})"""
    for d in (0.5, 0.1)
    for e in (0.05, 0.005)
    for s in [C.Sizing.of(d, e)]
)


@query(f"WITH rk AS MATERIALIZED ({KEYS_SQL.replace('AS cnt', 'AS real')}) " + SWEEP_SQL)
def sketch_error_sweep(spark, sf):
    from cellwise.plans.pipelines import Sweep
    from cellwise.plans.pipelines import sketch_error_sweep as sweep

    return sweep(table(spark, sf, "events"), event_key(), Sweep((0.5, 0.1), (0.05, 0.005)))


@query()
def linear_gd_products(spark, sf):
    from cellwise.plans.pipelines import RegressionConfig, sketched_moments

    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 100000).alias("y"), (F.col("l_quantity") / 50).alias("x"))
    return sketched_moments(rows, RegressionConfig("y", ["x"], precision=3, epsilon=0.0001, steps=20, start=[0.9, 0.9])).frame(spark)


@query()
def kmeans_sketch_3d(spark, sf):
    from cellwise.plans.pipelines import HEAVY_HITTERS, KMeansConfig, sketched_kmeans

    e = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    return K.frame(spark, sketched_kmeans(e, KMeansConfig(["x0", "x1", "x2"], 3, 3, precision=1), HEAVY_HITTERS))


SMALL_SWEEP = ((0.5, 0.1), (0.01, 0.001))


@query(" UNION ALL ".join(
    f"""SELECT {d}::DOUBLE AS delta, {e}::DOUBLE AS epsilon, {z.depth} AS depth, {z.width} AS width, theta0, theta1 FROM ({GD_SQL.format(cells=estimates_sql(REG_COUNTS_SQL, f'SELECT "row", col, CAST(sum(cnt) AS BIGINT) AS cnt FROM ({hash_sql(REG_COUNTS_SQL, z, "cnt")}) GROUP BY 1, 2', z, "g0, g1"))}) WHERE step = 20"""
    for d in SMALL_SWEEP[0]
    for e in SMALL_SWEEP[1]
    for z in [C.Sizing.of(d, e)]
))
def regression_sweep(spark, sf):
    """The linear model by size of the sketch, every observed cell looked up (an own discovery strategy)."""
    rows = table(spark, sf, "lineitem").select((F.col("l_extendedprice") / 100000).alias("y"), (F.col("l_quantity") / 50).alias("x"))
    observed = lambda sketch, cells, precision, sizing: D.estimate_cells(sketch, cells.distinct(), precision, sizing)
    out = PL.regression_sweep(rows, PL.RegressionConfig("y", ["x"], steps=20), PL.Sweep(*SMALL_SWEEP), observed)
    return out.select("delta", "epsilon", "depth", "width", *[F.round(f"theta{d}", 9).alias(f"theta{d}") for d in (0, 1)])


@query()
def kmeans_sweep(spark, sf):
    """Centers found and cost by size of the sketch, over three coordinates."""
    e = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(3)])
    return PL.kmeans_sweep(e, PL.KMeansConfig(["x0", "x1", "x2"], 3, 3, precision=1), PL.Sweep((0.1,), (0.01, 0.001)))


# -- scans of files that the sinks wrote ---------------------------------------------------------------------------------------------------


LINES = ["l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_returnflag"]


def _written_lines(spark, sf, header: bool, delimiter: str = ",") -> str:
    path = scratch_path(spark, "lines")
    W.csv(table(spark, sf, "lineitem").select(*LINES), path, delimiter, header)
    return path


@query("SELECT l_orderkey, l_linenumber, l_quantity, l_discount, l_returnflag FROM lineitem")
def files_csv(spark, sf):
    """CSV by explicit schema, from a folder of parts."""
    return IO.csv(spark, _written_lines(spark, sf, True), "l_orderkey bigint, l_linenumber int, l_quantity double, l_discount double, l_returnflag string")


@query("SELECT l_returnflag, l_orderkey FROM lineitem")
def files_by_header(spark, sf):
    return IO.csv_by_header(spark, _written_lines(spark, sf, True), {"l_returnflag": "string", "l_orderkey": "bigint"})


@query("SELECT l_orderkey AS a, l_discount AS b FROM lineitem")
def files_typed_mask(spark, sf):
    return IO.typed_csv(spark, _written_lines(spark, sf, False, ";"), [(0, "a", "bigint"), (3, "b", "double")], 5, ";")


@query("SELECT l_quantity AS v0, l_discount AS v1, l_tax AS v2 FROM lineitem")
def files_vectors(spark, sf):
    path = scratch_path(spark, "vectors")
    W.csv(table(spark, sf, "lineitem").select("l_quantity", "l_discount", "l_tax"), path, " ")
    return IO.vectors(spark, path).select(*[F.get("vec", F.lit(i)).alias(f"v{i}") for i in range(3)])


@query("SELECT vec_id AS sample, label, [x::DOUBLE FOR x IN embedding] AS features FROM embeddings WHERE label IS NOT NULL")
def files_samples(spark, sf):
    path = scratch_path(spark, "samples")
    W.csv(table(spark, sf, "embeddings").where("label IS NOT NULL").select("vec_id", "label", *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)]), path, " ")
    return IO.samples(spark, path)


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events WHERE props IS NOT NULL")
def files_json_sorted(spark, sf):
    """JSON lines from text files, sorted by a path."""
    path = scratch_path(spark, "json")
    table(spark, sf, "events").where("props IS NOT NULL").select("props").write.text(path)
    lines = IO.sorted_by_path(IO.text_lines(spark, path), F.col("value"), "k", "bigint")
    return lines.select(*[c.cast("bigint").alias("k") for c in IO.json_paths(F.col("value"), {"k": "k"})])


@query(f"WITH rk AS MATERIALIZED ({KEYS_SQL.replace('AS cnt', 'AS real')}) " + SWEEP_SQL)
def files_sweep_read_back(spark, sf):
    path = scratch_path(spark, "sweep")
    W.csv(sketch_error_sweep(spark, sf), path)
    return IO.read_back(spark, path)
