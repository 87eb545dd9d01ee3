"""Queries of the general training-data operators: hot keys (p4) and rejected records (p5)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cellwise.functions.keys import key_numbers, key_text
from cellwise.operators import records as R
from cellwise.operators.eager_join import dominant, eager_join_aggregate, form_states, key_totals
from cellwise.session import table

HOT_SHARE = 0.01

KEY_SQL = """
  SELECT *, CASE WHEN len(p) = 4 AND list_bool_and([x IS NOT NULL AND abs(x) < 1e300 FOR x IN v]) THEN v END AS nums
  FROM (SELECT *, [TRY_CAST(x AS DOUBLE) FOR x IN p] AS v FROM (SELECT *, string_split(translate(cell_key, '()[] ', ''), ',') AS p FROM sketch_updates))
"""
KEY_TEXT_SQL = "printf('(%.4f,%.4f,%d,%d)', nums[1], nums[2], CAST(nums[3] AS BIGINT), CAST(nums[4] AS BIGINT))"


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return key_totals(table(spark, sf_dir, "sketch_updates"), F.col("cell_key"), F.coalesce(F.col("cnt"), F.lit(1)), key_numbers)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dominant(_totals(spark, sf_dir), HOT_SHARE).select(key_text(F.col("lat"), F.col("lon"), F.col("type"), F.col("hour")).alias("cell_key"))


def p4_key_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows and total count of every key over all deliveries (a missing count is 1)."""
    return _totals(spark, sf_dir).select(key_text(F.col("lat"), F.col("lon"), F.col("type"), F.col("hour")).alias("cell_key"), "n_rows", "total")


def p4_join_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Updates joined to trips of the same type and hour: pairs and sums a type, of a join far too large to make."""
    updates = form_states(table(spark, sf_dir, "sketch_updates"), F.col("cell_key"), F.coalesce(F.col("cnt"), F.lit(1)), key_numbers)
    trips = table(spark, sf_dir, "taxi_trips")
    kind = F.when(F.col("duration").isNotNull(), F.when(F.col("duration") > 10, F.lit(1)).otherwise(F.lit(2)))
    return eager_join_aggregate(
        updates,
        trips,
        [(F.col("key.type").cast("int"), kind), (F.col("key.hour").cast("int"), F.col("hour_of_day"))],
        group_left={"trip_type": F.col("key.type").cast("int")},
        group_right={"weekday": F.col("weekday")},
        sum_left={"sum_cnt": F.col("total")},
        sum_right={"sum_measurements": F.col("num_measurements").cast("bigint")},
        sum_product={"sum_weighted": (F.col("total"), F.col("num_measurements").cast("bigint"))},
        count="n_pairs",
        weight_left=F.col("n_rows"),
    )


P4_FOUND_SQL = f"""
WITH k AS (SELECT nums, count(*) AS n FROM ({KEY_SQL}) WHERE nums IS NOT NULL GROUP BY nums)
SELECT {KEY_TEXT_SQL} AS cell_key FROM k WHERE n >= 0.01::DOUBLE * (SELECT sum(n) FROM k)
"""
P4_TOTALS_SQL = f"""
SELECT {KEY_TEXT_SQL} AS cell_key, count(*) AS n_rows, CAST(sum(coalesce(cnt, 1)) AS BIGINT) AS total
FROM ({KEY_SQL}) WHERE nums IS NOT NULL GROUP BY nums
"""
P4_ROLLUP_SQL = f"""
WITH u AS (SELECT CAST(nums[3] AS INT) AS kind, CAST(nums[4] AS INT) AS hour, count(*) AS n, sum(coalesce(cnt, 1)) AS s
           FROM ({KEY_SQL}) WHERE nums IS NOT NULL GROUP BY 1, 2),
     t AS (SELECT CASE WHEN duration > 10 THEN 1 ELSE 2 END AS kind, hour_of_day AS hour, weekday, num_measurements AS m
           FROM taxi_trips WHERE duration IS NOT NULL)
SELECT u.kind AS trip_type, t.weekday, CAST(sum(u.n) AS BIGINT) AS n_pairs, CAST(sum(u.s) AS BIGINT) AS sum_cnt,
       CAST(sum(u.n * t.m) AS BIGINT) AS sum_measurements, CAST(sum(u.s * t.m) AS BIGINT) AS sum_weighted
FROM u JOIN t USING (kind, hour) GROUP BY 1, 2
"""


def _parsed(spark: SparkSession, sf_dir: str, typed: bool) -> DataFrame:
    raw = table(spark, sf_dir, "raw_records")
    keep = {"record_id": F.col("record_id"), "source_file": F.col("source_file"), "line_no": F.col("line_no")} if typed else {"record_id": F.col("record_id")}
    return R.parse_records(raw, F.col("record"), F.col("fmt"), keep, typed=typed)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _parsed(spark, sf_dir, False).where(F.col("reason").isin(R.QUOTING, R.COLUMNS, R.VALUE)).select("record_id", "reason").distinct()


def p5_trips(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid trip records as typed fields."""
    good = _parsed(spark, sf_dir, True).where((F.col("fmt") == "trip") & F.col("reason").isNull())
    return good.select("record_id", "source_file", "line_no", *R.TRIP.fields)


def p5_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The valid regression and point records as typed fields."""
    good = _parsed(spark, sf_dir, True).where(F.col("fmt").isin("regr", "point") & F.col("reason").isNull())
    return good.select("record_id", "fmt", *R.REGRESSION.fields, *R.POINT.fields)


def p5_reject_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of each file by format and reason ('' for valid)."""
    return _parsed(spark, sf_dir, True).groupBy("fmt", "source_file", F.coalesce("reason", F.lit("")).alias("reason")).agg(F.count(F.lit(1)).alias("n_rows"))


_FIELD = r"""[ \t]*("(?:[^"]|"")*"|[^",]*)[ \t]*"""
_NUM = r"[+-]?[0-9]+(\.[0-9]+)?([eE][+-]?[0-9]+)?"
_POLY = rf"\[[ \t]*(\[[ \t]*{_NUM}[ \t]*,[ \t]*{_NUM}[ \t]*\][ \t]*(,[ \t]*\[[ \t]*{_NUM}[ \t]*,[ \t]*{_NUM}[ \t]*\][ \t]*)*)?\]"
P5_CTE = rf"""
WITH r AS (SELECT record_id, fmt, source_file, line_no, coalesce(regexp_replace(record, '^[ \t\r\n]+|[ \t\r\n]+$', '', 'g'), '') AS rec FROM raw_records),
f AS (SELECT *,
        CASE WHEN fmt = 'point' THEN string_split_regex(rec, '[ \t]+')
             ELSE list_transform(regexp_extract_all(rec || ',', '{_FIELD},', 1), lambda t:
               trim(replace(CASE WHEN trim(t, chr(9) || ' ') LIKE '"%"' AND length(trim(t, chr(9) || ' ')) >= 2 THEN trim(t, chr(9) || ' ')[2:-2] ELSE t END, '""', '"'), chr(9) || ' ')) END AS v,
        fmt <> 'point' AND NOT regexp_full_match(rec, '{_FIELD}(,{_FIELD})*') AS badq
      FROM r),
q AS (SELECT *,
        CASE WHEN rec = '' THEN 'columns'
             WHEN badq THEN 'quoting'
             WHEN len(v) <> CASE fmt WHEN 'trip' THEN 9 ELSE 3 END THEN 'columns'
             WHEN fmt = 'trip' AND NOT (regexp_full_match(v[1], '[0-9]+') AND regexp_full_match(v[2], '[ABC]')
               AND regexp_full_match(v[3], '([+-]?[0-9]+)?') AND regexp_full_match(v[4], '([+-]?[0-9]+)?')
               AND regexp_full_match(v[5], '[+-]?[0-9]+') AND regexp_full_match(v[6], '[+-]?[0-9]+') AND regexp_full_match(v[7], '[ABC]')
               AND regexp_full_match(lower(v[8]), 'true|false') AND regexp_full_match(v[9], '{_POLY}')) THEN 'value'
             WHEN fmt = 'trip' AND NOT coalesce(list_bool_and(list_transform(regexp_extract_all(v[9], '{_NUM}', 0),
               lambda x, i: coalesce(abs(TRY_CAST(x AS DOUBLE)) <= CASE WHEN i % 2 = 1 THEN 180 ELSE 90 END, false))), true) THEN 'value'
             WHEN fmt = 'regr' AND NOT regexp_full_match(v[1], '[+-]?[0-9]+') THEN 'value'
             WHEN fmt = 'regr' AND NOT list_bool_and([regexp_full_match(x, '{_NUM}') AND coalesce(isfinite(TRY_CAST(x AS DOUBLE)), false) FOR x IN v[2:3]]) THEN 'value'
             WHEN fmt = 'point' AND NOT list_bool_and([regexp_full_match(x, '{_NUM}') AND coalesce(isfinite(TRY_CAST(x AS DOUBLE)), false) FOR x IN v]) THEN 'value'
             ELSE '' END AS reason
      FROM f)
"""
P5_FOUND_SQL = P5_CTE + "SELECT DISTINCT record_id, reason FROM q WHERE reason <> ''"
P5_REPORT_SQL = P5_CTE + "SELECT fmt, source_file, reason, count(*) AS n_rows FROM q GROUP BY ALL"
P5_TRIPS_SQL = P5_CTE + r"""
SELECT record_id, source_file, line_no, v[1] AS trip_id, v[2] AS call_type, TRY_CAST(nullif(v[3], '') AS BIGINT) AS origin_call,
  TRY_CAST(nullif(v[4], '') AS BIGINT) AS origin_stand, TRY_CAST(v[5] AS BIGINT) AS taxi_id, TRY_CAST(v[6] AS BIGINT) AS trip_epoch, v[7] AS day_type,
  lower(v[8]) = 'true' AS missing_data, CAST(v[9] AS DOUBLE[][]) AS polyline
FROM q WHERE fmt = 'trip' AND reason = ''
"""
P5_NUMBERS_SQL = P5_CTE + """
SELECT record_id, fmt, CASE WHEN fmt = 'regr' THEN TRY_CAST(v[1] AS BIGINT) END AS idx, CASE WHEN fmt = 'regr' THEN CAST(v[2] AS DOUBLE) END AS y,
  CASE WHEN fmt = 'regr' THEN CAST(v[3] AS DOUBLE) END AS x, CASE WHEN fmt = 'point' THEN CAST(v[1] AS DOUBLE) END AS p0,
  CASE WHEN fmt = 'point' THEN CAST(v[2] AS DOUBLE) END AS p1, CASE WHEN fmt = 'point' THEN CAST(v[3] AS DOUBLE) END AS p2
FROM q WHERE fmt IN ('regr', 'point') AND reason = ''
"""

QUERIES = {f.__name__: f for f in (p4_found, p4_key_totals, p4_join_rollup, p5_found, p5_trips, p5_numbers, p5_reject_report)}
ORACLES = {
    "p4_found": P4_FOUND_SQL, "p4_key_totals": P4_TOTALS_SQL, "p4_join_rollup": P4_ROLLUP_SQL,
    "p5_found": P5_FOUND_SQL, "p5_trips": P5_TRIPS_SQL, "p5_numbers": P5_NUMBERS_SQL, "p5_reject_report": P5_REPORT_SQL,
}
