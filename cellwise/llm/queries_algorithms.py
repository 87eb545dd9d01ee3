"""Queries on streams, filters, digests and clusters: p1, p2, p3, p6."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.keys import key_numbers, key_text
from cellwise.llm import density as C
from cellwise.llm import digests as D
from cellwise.llm import heavy_hitters as H
from cellwise.llm import seen_keys as S
from cellwise.llm.histogram_check import wrong_histograms
from cellwise.session import stage, table

UPDATE_SHARE, CELL_SHARE = 0.002, 0.01
UPDATE_COUNTERS, CELL_COUNTERS = 4096, 512


def _updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates with a key, once an ``update_id`` (its deliveries are alike but for the written form); updates without an id are kept as they are."""
    rows = table(spark, sf_dir, "sketch_updates").select("update_id", key_numbers(F.col("cell_key")).alias("k"), F.coalesce(F.col("cnt"), F.lit(1)).alias("cnt"))
    rows = rows.where("k IS NOT NULL").select("update_id", "k.*", "cnt")
    lone = F.when(F.col("update_id").isNull(), F.monotonically_increasing_id()).alias("_lone")
    return rows.groupBy("update_id", lone).agg(*[F.first(c).alias(c) for c in ("lat", "lon", "type", "hour", "cnt")])


def _frequent_updates(spark: SparkSession, sf_dir: str, share: float) -> DataFrame:
    key = {c: F.col(c) for c in ("lat", "lon", "type", "hour")}
    found = H.frequent_items(_updates(spark, sf_dir), key, F.col("cnt"), share, UPDATE_COUNTERS)
    return found.select(key_text(*[F.col(c) for c in key]).alias("item_key"), "total", "low", "up", "group_total")


def valid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Valid elements, once a run and cell_id: n_dims finite entries and a positive count."""
    rows = table(spark, sf_dir, "input_cells").select("cell_id", "run_id", "n_dims", "vec", "cnt")
    finite = F.forall("vec", lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))))
    rows = rows.where((F.col("cnt") > 0) & (F.size("vec") == F.col("n_dims")) & (F.col("n_dims") > 0) & finite)
    rows = rows.withColumn("vec", F.transform("vec", lambda x: x + F.lit(0.0)))
    return rows.groupBy("run_id", "cell_id").agg(F.first("vec").alias("vec"), F.first("cnt").alias("cnt"))


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    updates = _frequent_updates(spark, sf_dir, UPDATE_SHARE).select(F.lit("updates").alias("origin"), "item_key")
    key = {"run_id": F.col("run_id"), "vec": F.col("vec")}
    found = H.frequent_items(valid_cells(spark, sf_dir), key, F.col("cnt"), CELL_SHARE, CELL_COUNTERS, group=["run_id"], max_groups=None, least=F.col("cell_id"))
    return updates.unionByName(found.select(F.lit("cells").alias("origin"), F.col("least").cast("string").alias("item_key")))


def p1_top_updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 keys with the largest totals (a top-k report)."""
    key = {c: F.col(c) for c in ("lat", "lon", "type", "hour")}
    found = H.top_items(_updates(spark, sf_dir), key, F.col("cnt"), 20, UPDATE_COUNTERS)
    return found.select(key_text(*[F.col(c) for c in key]).alias("item_key"), "total", "group_total")


def p1_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent keys with the bounds of the summary: low <= total <= up."""
    return _frequent_updates(spark, sf_dir, UPDATE_SHARE)


def p1_bounds_hold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frequent keys with their exact totals, and whether these are within the bounds of the summary."""
    return p1_bounds(spark, sf_dir).select("item_key", "total", ((F.col("low") <= F.col("total")) & (F.col("total") <= F.col("up"))).alias("within"))


def _grid(c: str) -> Column:
    return F.floor(F.col(c) * F.lit(1000) + F.lit(0.5))


def _trips(spark: SparkSession, sf_dir: str) -> S.History:
    trips = table(spark, sf_dir, "taxi_trips").select("rec_id", "trip_day", "hour_of_day", "lat", "lon", "duration", "arrive_ts")
    kind = F.when(F.col("duration").isNotNull(), F.when(F.col("duration") > 10, F.lit(1)).otherwise(F.lit(2)))
    key = {"trip_day": F.col("trip_day"), "hour": F.col("hour_of_day"), "lat_k": _grid("lat"), "lon_k": _grid("lon"), "kind": kind}
    return S.build_history(trips, key, F.datediff(F.to_date("arrive_ts"), F.lit("1970-01-01")), F.col("arrive_ts"), F.col("rec_id"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    history = _trips(spark, sf_dir)
    new, _ = S.first_rows(history)
    keyed = table(spark, sf_dir, "taxi_trips").where("trip_day IS NOT NULL AND hour_of_day IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL AND duration IS NOT NULL")
    again = keyed.select(F.col("rec_id").alias("row_id")).join(new, "row_id", "left_anti").distinct()
    counts = table(spark, sf_dir, "trip_counts").where("sketch_count IS NOT NULL")
    key = {"trip_day": F.col("trip_day"), "hour": F.col("hour_of_day"), "lat_k": _grid("lat"), "lon_k": _grid("lon"), "kind": F.col("trip_type")}
    asked = S.present(history, counts, key, {"count_id": F.col("count_id"), "sketch_count": F.col("sketch_count")})
    wrong = asked.where(((F.col("sketch_count") > 0) & ~F.col("present")) | ((F.col("sketch_count") == 0) & F.col("present")))
    return again.select(F.lit("trip").alias("origin"), "row_id").unionByName(wrong.select(F.lit("count").alias("origin"), F.col("count_id").alias("row_id")).distinct())


def p2_error_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day of arrival: keys asked, positives, wrong positives and the compounded error bound."""
    return S.error_report(_trips(spark, sf_dir))


def p2_seen_by_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per day of arrival: keys asked, and those that an earlier day has, as the filters and the check of their positives say."""
    return S.error_report(_trips(spark, sf_dir)).select("batch", "n_keys", (F.col("n_positive") - F.col("n_wrong")).alias("n_seen"))


def p2_answer_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per sketch run, how often the recorded answers are wrong: keys said to be seen that no delivery has, keys said to be new that one has, real counts that deny
    or claim a delivery wrongly, and wrong positives that are recorded where there is none or not recorded where there is one."""
    key = {"trip_day": F.col("trip_day"), "hour": F.col("hour_of_day"), "lat_k": _grid("lat"), "lon_k": _grid("lon"), "kind": F.col("trip_type")}
    kept = {n: F.col(n) for n in ("sketch_run", "count_id", "sketch_count", "real_count", "false_positive")}
    return S.answer_report(S.present(_trips(spark, sf_dir), table(spark, sf_dir, "trip_counts"), key, kept), "sketch_run", "sketch_count", "real_count", "false_positive")


GROUPS = {"feature": "feature", "batch_day": "batch_day", "worker": "worker"}


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    values, stored = table(spark, sf_dir, "feature_values"), table(spark, sf_dir, "histograms")
    found = wrong_histograms(stored, F.col("hist_id"), F.col("bins"), values, F.col("sample_id"), F.col("fvalue"), GROUPS)
    return found.select(F.col("_id").alias("hist_id"))


def _values(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "feature_values").select(*GROUPS, "sample_id", "fvalue").where("fvalue IS NOT NULL AND abs(fvalue) < double('infinity')")
    return rows.groupBy(*GROUPS, "sample_id").agg(F.first("fvalue").alias("fvalue"))


def p3_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per feature, day and worker, with counted rank errors."""
    return D.certified(_values(spark, sf_dir), F.col("fvalue"), {n: F.col(n) for n in GROUPS}, (0.25, 0.5, 0.75, 0.9, 0.99))


def p3_percentiles_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles per feature for all days and workers together, from the merged digests of the single days and workers, with counted rank errors."""
    values = stage(_values(spark, sf_dir), "values")
    digests = D.digest(values, F.col("fvalue"), {n: F.col(n) for n in GROUPS})
    found = stage(D.quantiles(D.merge(digests, ["feature"]), ["feature"], (0.25, 0.5, 0.75, 0.9, 0.99)), "quantiles")
    return D.certify(values, F.col("fvalue"), {"feature": F.col("feature")}, found)


RANK_ERROR = 0.01


def p3_rank_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feature, day and worker and per percentile the number of values, and whether the counted rank error is at most RANK_ERROR (and one value, between two)."""
    return p3_percentiles(spark, sf_dir).select(*GROUPS, "q", "n", (F.col("rank_error") <= RANK_ERROR + 1 / F.col("n")).alias("certified"))


def p3_rank_errors_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same per feature, of the digests of single days and workers merged."""
    return p3_percentiles_merged(spark, sf_dir).select("feature", "q", "n", (F.col("rank_error") <= RANK_ERROR + 1 / F.col("n")).alias("certified"))


NEAR, LEAST_MEMBERS = 0.02, 4


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = stage(valid_cells(spark, sf_dir).select("run_id", "cell_id", "vec"), "cells")
    found = C.connected(cells, F.col("run_id"), F.col("cell_id"), F.col("vec"), NEAR, LEAST_MEMBERS)
    return found.select("cluster_id", F.col("element").alias("cell_id"))


def p6_found_by_rounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same clusters with Boruvka rounds to the end, as large inputs need them, and no finish in one task."""
    cells = stage(valid_cells(spark, sf_dir).select("run_id", "cell_id", "vec"), "cells")
    found = C.connected(cells, F.col("run_id"), F.col("cell_id"), F.col("vec"), NEAR, LEAST_MEMBERS, finish_edges=0)
    return found.select("cluster_id", F.col("element").alias("cell_id"))


def p6_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most stable clusters of each run with their sizes and most typical elements."""
    cells = stage(valid_cells(spark, sf_dir).select("run_id", "cell_id", "vec"), "cells")
    found = C.stable_clusters(cells, F.col("run_id"), F.col("cell_id"), F.col("vec"), 0.05, 4, 8)
    return found.select(F.col("run").cast("int").alias("run_id"), "cluster_id", "size", "stability", "exemplars")


KEY_SQL = """
  SELECT update_id, cnt, CASE WHEN len(p) = 4 AND list_bool_and([x IS NOT NULL AND abs(x) < 1e300 FOR x IN v]) THEN v END AS nums
  FROM (SELECT *, [TRY_CAST(x AS DOUBLE) FOR x IN p] AS v FROM (SELECT *, string_split(translate(cell_key, '()[] ', ''), ',') AS p FROM sketch_updates))
"""
KEY_TEXT_SQL = "printf('(%.4f,%.4f,%d,%d)', nums[1], nums[2], CAST(nums[3] AS BIGINT), CAST(nums[4] AS BIGINT))"
ONCE_SQL = f"SELECT update_id, min(nums) AS nums, max(coalesce(cnt, 1)) AS cnt FROM ({KEY_SQL}) WHERE nums IS NOT NULL GROUP BY update_id"
VALID_SQL = """
  SELECT run_id, cell_id, any_value(vec) AS vec, any_value(cnt) AS cnt FROM input_cells
  WHERE cnt > 0 AND vec IS NOT NULL AND len(vec) = n_dims AND list_bool_and([x IS NOT NULL AND isfinite(x) FOR x IN vec]) GROUP BY run_id, cell_id
"""
P1_FOUND_SQL = f"""
WITH k AS (SELECT nums, sum(cnt) AS n FROM ({ONCE_SQL}) GROUP BY nums),
c AS ({VALID_SQL}), v AS (SELECT run_id, vec, sum(cnt) AS n, min(cell_id) AS id FROM c GROUP BY 1, 2), t AS (SELECT run_id, sum(cnt) AS n FROM c GROUP BY 1)
SELECT 'updates' AS origin, {KEY_TEXT_SQL} AS item_key FROM k WHERE n >= 0.002::DOUBLE * (SELECT sum(n) FROM k)
UNION ALL SELECT 'cells', CAST(id AS VARCHAR) FROM v JOIN t USING (run_id) WHERE v.n >= 0.01::DOUBLE * t.n
"""
P1_TOP_SQL = f"""
SELECT {KEY_TEXT_SQL} AS item_key, CAST(sum(cnt) AS BIGINT) AS total, CAST((SELECT sum(cnt) FROM ({ONCE_SQL})) AS BIGINT) AS group_total
FROM ({ONCE_SQL}) GROUP BY nums ORDER BY total DESC, item_key LIMIT 20
"""
P2_FOUND_SQL = """
WITH d AS (SELECT rec_id, arrive_ts, trip_day, hour_of_day, floor(lat*1000+0.5) AS a, floor(lon*1000+0.5) AS b, CASE WHEN duration > 10 THEN 1 ELSE 2 END AS t
           FROM taxi_trips WHERE lat IS NOT NULL AND lon IS NOT NULL AND duration IS NOT NULL),
r AS (SELECT rec_id, row_number() OVER (PARTITION BY trip_day, hour_of_day, a, b, t ORDER BY arrive_ts, rec_id) AS n FROM d),
k AS (SELECT DISTINCT trip_day, hour_of_day, a, b, t FROM d),
c AS (SELECT DISTINCT count_id, sketch_count, trip_day, hour_of_day, floor(lat*1000+0.5) AS a, floor(lon*1000+0.5) AS b, trip_type AS t FROM trip_counts)
SELECT 'trip' AS origin, rec_id AS row_id FROM r WHERE n > 1
UNION ALL
SELECT DISTINCT 'count', count_id FROM c LEFT JOIN (SELECT *, true AS here FROM k) USING (trip_day, hour_of_day, a, b, t)
WHERE (sketch_count > 0 AND here IS NULL) OR (sketch_count = 0 AND here)
"""
_P2_KEYS = """WITH d AS (SELECT rec_id, coalesce(CAST(arrive_ts AS DATE) - DATE '1970-01-01', -1) AS day, trip_day, hour_of_day, floor(lat*1000+0.5) AS a, floor(lon*1000+0.5) AS b, CASE WHEN duration > 10 THEN 1 ELSE 2 END AS t
  FROM taxi_trips WHERE lat IS NOT NULL AND lon IS NOT NULL AND duration IS NOT NULL AND trip_day IS NOT NULL AND hour_of_day IS NOT NULL)"""
P2_BATCH_SQL = _P2_KEYS + """
SELECT CASE WHEN day < 0 THEN 0 ELSE day - (SELECT min(day) FROM d WHERE day >= 0) + 1 END AS batch, count(*) AS n_keys, count(*) FILTER (day > first) AS n_seen
FROM (SELECT DISTINCT day, trip_day, hour_of_day, a, b, t, min(day) OVER (PARTITION BY trip_day, hour_of_day, a, b, t) AS first FROM d) GROUP BY 1
"""
P2_ANSWER_SQL = _P2_KEYS + """,
c AS (SELECT DISTINCT sketch_run, count_id, sketch_count, real_count, false_positive, trip_day, hour_of_day, floor(lat*1000+0.5) AS a, floor(lon*1000+0.5) AS b, trip_type AS t FROM trip_counts),
p AS (SELECT DISTINCT sketch_run, count_id, sketch_count, real_count, false_positive, here IS NOT NULL AS here FROM c LEFT JOIN (SELECT DISTINCT trip_day, hour_of_day, a, b, t, true AS here FROM d) USING (trip_day, hour_of_day, a, b, t))
SELECT sketch_run, count(*) FILTER (sketch_count IS NOT NULL) AS n_answers, count(*) FILTER (sketch_count > 0 AND NOT here) AS n_said_seen, count(*) FILTER (sketch_count = 0 AND here) AS n_said_new,
  count(*) FILTER ((real_count > 0) <> here) AS n_real_wrong, count(*) FILTER ((false_positive > 0) <> (sketch_count > 0 AND NOT here)) AS n_positive_wrong,
  round(count(*) FILTER ((sketch_count > 0 AND NOT here) OR (sketch_count = 0 AND here)) / nullif(count(*) FILTER (sketch_count IS NOT NULL), 0), 9) AS wrong_rate FROM p GROUP BY 1
"""
P3_FOUND_SQL = """
WITH v AS (SELECT feature, batch_day, worker, sample_id, min(fvalue) AS v FROM feature_values WHERE isfinite(fvalue) GROUP BY 1, 2, 3, 4),
h AS (SELECT DISTINCT hist_id, feature, batch_day, worker, b.x AS x, sum(coalesce(b.y, 0)) OVER w AS upto, sum(coalesce(b.y, 0)) OVER (PARTITION BY hist_id) AS total
      FROM (SELECT hist_id, feature, batch_day, worker, unnest(bins) AS b FROM (SELECT DISTINCT ON (hist_id) * FROM histograms)) WHERE b.x IS NOT NULL
      WINDOW w AS (PARTITION BY hist_id ORDER BY b.x, b.y ROWS UNBOUNDED PRECEDING)),
c AS (SELECT hist_id, feature, batch_day, worker, q, min(x) AS c FROM h, (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE]) AS q) WHERE total > 0 AND upto >= q * total GROUP BY ALL),
r AS (SELECT hist_id, q, avg(CASE WHEN v < c THEN 1.0::DOUBLE ELSE 0 END) AS a, avg(CASE WHEN v <= c THEN 1.0::DOUBLE ELSE 0 END) AS b FROM c JOIN v USING (feature, batch_day, worker) GROUP BY ALL)
SELECT DISTINCT hist_id FROM r WHERE a > q + 0.10::DOUBLE OR b < q - 0.10::DOUBLE
"""
_P3_VALUES = "SELECT DISTINCT feature, batch_day, worker, sample_id FROM feature_values WHERE isfinite(fvalue)"
P3_RANK_SQL = f"SELECT feature, batch_day, worker, q, count(*) AS n, true AS certified FROM ({_P3_VALUES}), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q) GROUP BY ALL"
P3_MERGED_SQL = f"SELECT feature, q, count(*) AS n, true AS certified FROM ({_P3_VALUES}), (SELECT unnest([0.25::DOUBLE, 0.5::DOUBLE, 0.75::DOUBLE, 0.9::DOUBLE, 0.99::DOUBLE]) AS q) GROUP BY ALL"
P1_BOUNDS_SQL = f"""
WITH k AS (SELECT nums, CAST(sum(cnt) AS BIGINT) AS total FROM ({ONCE_SQL}) GROUP BY nums)
SELECT {KEY_TEXT_SQL} AS item_key, total, true AS within FROM k WHERE total >= 0.002::DOUBLE * (SELECT sum(total) FROM k)
"""
P6_FOUND_SQL = f"""
WITH RECURSIVE c AS MATERIALIZED ({VALID_SQL}),
e AS MATERIALIZED (SELECT a.run_id, a.cell_id AS u, b.cell_id AS v FROM c a JOIN c b ON a.run_id = b.run_id AND len(a.vec) = len(b.vec)
      AND abs(a.vec[1] - b.vec[1]) <= 0.02 AND list_distance(a.vec, b.vec) <= 0.02::DOUBLE),
r(run_id, node, low) AS (SELECT run_id, u, min(v) FROM e GROUP BY 1, 2
      UNION SELECT e.run_id, e.v, r.low FROM r JOIN e ON e.run_id = r.run_id AND e.u = r.node WHERE r.low < e.v),
l AS (SELECT run_id, node, min(low) AS cluster_id FROM r GROUP BY 1, 2)
SELECT cluster_id, node AS cell_id FROM (SELECT *, count(*) OVER (PARTITION BY run_id, cluster_id) AS n FROM l) WHERE n >= 4
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_top_updates, p1_bounds, p1_bounds_hold, p2_found, p2_error_report, p2_seen_by_batch, p2_answer_report, p3_found, p3_percentiles, p3_percentiles_merged, p3_rank_errors, p3_rank_errors_merged, p6_found, p6_found_by_rounds, p6_clusters)}
ORACLES = {"p1_found": P1_FOUND_SQL, "p1_top_updates": P1_TOP_SQL, "p1_bounds_hold": P1_BOUNDS_SQL, "p3_rank_errors": P3_RANK_SQL, "p3_rank_errors_merged": P3_MERGED_SQL, "p2_found": P2_FOUND_SQL, "p2_seen_by_batch": P2_BATCH_SQL, "p2_answer_report": P2_ANSWER_SQL, "p3_found": P3_FOUND_SQL, "p6_found": P6_FOUND_SQL, "p6_found_by_rounds": P6_FOUND_SQL}
