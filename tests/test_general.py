"""Hot keys, rejected records, sources, sinks and streams."""

import itertools
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cellwise.functions.keys import key_numbers, key_text
from cellwise.operators import records as R
from cellwise.operators.eager_join import dominant, eager_join_aggregate, key_totals
from cellwise.sources import readers, writers


def test_eager_join_equals_the_join(spark):
    rng = random.Random(1)
    left = [(rng.choice([1, 1, 1, 2, None]), rng.choice("ab"), rng.choice([1, 2, None])) for _ in range(300)]
    right = [(rng.choice([1, 1, 2, 3, None]), rng.choice("xy"), rng.randint(0, 5)) for _ in range(200)]
    a, b = spark.createDataFrame(left, "k int, g string, v bigint"), spark.createDataFrame(right, "k int, g string, v bigint")
    got = eager_join_aggregate(
        a, b, [(F.col("k"), F.col("k"))], group_left={"lg": F.col("g")}, group_right={"rg": F.col("g")}, sum_left={"sl": F.col("v")}, sum_right={"sr": F.col("v")},
        sum_product={"sp": (F.col("v"), F.col("v"))}, min_left={"lo": F.col("v")}, max_left={"hi": F.col("v")},
    )
    wanted = {}
    for (k, g, v), (k2, g2, v2) in itertools.product(left, right):
        if k is not None and k == k2:
            w = wanted.setdefault((g, g2), [0, 0, 0, 0, [], []])
            w[0] += 1
            w[1] += v or 0
            w[2] += v2
            w[3] += (v or 0) * v2
            w[4] += [v] if v else []
    assert {(r.lg, r.rg): (r.n_rows, r.sl, r.sr, r.sp, r.lo, r.hi) for r in got.collect()} == {k: (*w[:4], min(w[4]), max(w[4])) for k, w in wanted.items()}
    assert eager_join_aggregate(a.limit(0), b, [(F.col("k"), F.col("k"))], group_left={"g": F.col("g")}).count() == 0
    assert eager_join_aggregate(a.limit(0), b, [(F.col("k"), F.col("k"))]).count() == 0


def test_key_forms(spark):
    forms = ["(41.18,-8.6,1,3)", " ( 41.1800, -8.6000, 1, 3 ) ", "[41.180000,-8.600000,1,3]", "(4.118E+01,-8.6E+00,1,3)", "41.18,-8.6,1.0,3.0"]
    bad = ["", "x", "(1,2,3)", "(1,2,3,4,5)", "(NaN,1,1,1)", "(1e999,1,1,1)", None]
    df = spark.createDataFrame([(f, 2) for f in forms] + [(b, 1) for b in bad], "form string, n int")
    out = key_totals(df, F.col("form"), F.col("n"), key_numbers)
    r = out.select(key_text(*[F.col(c) for c in ("lat", "lon", "type", "hour")]).alias("k"), "n_rows", "total").collect()
    assert [tuple(x) for x in r] == [("(41.1800,-8.6000,1,3)", 5, 10)]
    assert dominant(out, 0.5).count() == 1 and key_totals(df.limit(0), F.col("form"), F.col("n"), key_numbers).count() == 0


LINE = '1,A,,,5,6,A,true,"[[1,2]]"'


@pytest.mark.parametrize(
    ("record", "reason"),
    [
        (LINE, ""), (f"  {LINE}\r\n", ""), ('"1" , "B" ,"", 7,5,6,A,FALSE,[]', ""), ("1,A,,,5,6,A,true,[ [ 1 , 2 ] , [3,4.5e0] ]", "columns"), ('1,A,,,5,6,A,true,"[ [ 1 , 2 ] , [3,4.5e0] ]"', ""),
        ("", "columns"), (None, "columns"), (" \r\n", "columns"), ("1,A", "columns"), (LINE + ",", "columns"), (LINE + " x", "quoting"), ('1,"A,,,5,6,A,true,[]', "quoting"), ('1,A"x",,,5,6,A,true,[]', "quoting"),
        ('1,"A" "B",,,5,6,A,true,[]', "quoting"), ('1,"A""",,,5,6,A,true,[]', "value"), ("x1,A,,,5,6,A,true,[]", "value"), ("1,D,,,5,6,A,true,[]", "value"), ("1,A,,,5,,A,true,[]", "value"),
        ('1,A,,,5,6,A,true,"[[181,2]]"', "value"), ('1,A,,,5,6,A,true,"[[1,-91]]"', "value"), ('1,A,,,5,6,A,true,"[[1,2,3]]"', "value"), ('1,A,,,5,6,A,true,"[[1,2]"', "value"), ("1,A,,,5,6,A,yes,[]", "value"),
        ('1,A,"",,5,6,A,true,"[[' + "1,2],[" * 50_000 + '1,2]]"', ""), ("9" * 100 + ",A,,," + "9" * 30 + ",6,A,true,[]", ""),
    ],
)
def test_trip_records(record, reason):
    reasons, columns = R.parse_batch(pa.array([LINE, record, LINE], pa.string()), R.TRIP)
    assert list(reasons) == ["", reason, ""]
    assert [v is None for v in columns["trip_id"].to_pylist()] == [False, bool(reason), False]


def test_numbers_and_points():
    lines = ["1,2,3", '1,"2",-3.5e-2', "1,.5,3", "1,5.,3", "1,1e999,3", "1.0,2,3", "1,2", "a", "1,nan,2"]
    assert list(R.parse_batch(pa.array(lines), R.REGRESSION)[0]) == ["", "", "value", "value", "value", "value", "columns", "columns", "value"]
    points = ["1 2 3", "  1   2e0 -3 ", '"1 2 3', "1 2", "1 2 x", "1,2,3"]
    assert list(R.parse_batch(pa.array(points), R.POINT)[0]) == ["", "", "value", "columns", "value", "columns"]
    assert list(R.parse_batch(pa.array([], pa.string()), R.POINT)[0]) == []


def by_hand(text):
    """Fields of a record, a character at a time, or None if its quoting is broken."""
    fields, i, n = [], 0, len(text)
    while True:
        while i < n and text[i] == " ":
            i += 1
        if i < n and text[i] == '"':
            i, value = i + 1, ""
            while True:
                if i >= n:
                    return None
                if text[i] == '"':
                    if text[i + 1 : i + 2] == '"':
                        value, i = value + '"', i + 2
                        continue
                    i += 1
                    break
                value, i = value + text[i], i + 1
            while i < n and text[i] == " ":
                i += 1
            if i < n and text[i] != ",":
                return None
            fields.append(value.strip(" "))
        else:
            j = i
            while j < n and text[j] != ",":
                if text[j] == '"':
                    return None
                j += 1
            fields.append(text[i:j].strip(" "))
            i = j
        if i >= n:
            return fields
        i += 1


@settings(max_examples=400, deadline=None)
@given(st.lists(st.text('1a", ', max_size=12), min_size=1, max_size=6))
def test_structural_index_equals_a_plain_parser(lines):
    reasons, _ = R.parse_batch(pa.array(lines, pa.string()), R.REGRESSION)
    for line, got in zip(lines, reasons, strict=True):
        fields = by_hand(line.strip(" "))
        if not line.strip(" "):
            wanted = "columns"
        elif fields is None:
            wanted = "quoting"
        elif len(fields) != 3:
            wanted = "columns"
        else:
            wanted = "" if all(f and set(f) <= {"1"} for f in fields) else "value"
        assert got == wanted, line


def test_records_in_frames(spark):
    rows = [(1, "regr", "1,2,3"), (2, "point", "1 2 3"), (3, None, "x"), (4, "other", "x"), (5, "regr", None), (5, "regr", None)]
    df = spark.createDataFrame(rows, "id int, fmt string, record string").withColumn("reason", F.lit("clash")).withColumn("y", F.lit(0))
    out = R.parse_records(df, F.col("record"), F.col("fmt"), {"id": F.col("id")})
    assert sorted((r.id, r.reason or "") for r in out.collect()) == [(1, ""), (2, ""), (3, "format"), (4, "format"), (5, "columns"), (5, "columns")]
    assert R.parse_records(df.limit(0), F.col("record"), F.col("fmt"), {"id": F.col("id")}).count() == 0


def test_sources_and_sinks(spark, tmp_path):
    path = str(tmp_path / "v")
    spark.createDataFrame([("1 2.5 3",), (" 4 5 6 ",), ("",)], "value string").write.text(path)
    assert sorted(r.vec for r in readers.vectors(spark, path).collect()) == [[1.0, 2.5, 3.0], [4.0, 5.0, 6.0]]
    whole = str(tmp_path / "w")
    spark.createDataFrame([("7 3 0.5 1.5",), ("8 4 2.5 3.5",)], "value string").write.text(whole)
    assert sorted(map(tuple, readers.samples(spark, whole).collect())) == [(7, 3, [0.5, 1.5]), (8, 4, [2.5, 3.5])]
    assert readers.samples(spark, whole, readers.SampleFormat(label=-1, first_feature=1)).first().label is None
    picked = readers.typed_csv(spark, path, [(2, "c", "double"), (0, "a", "double")], 3)
    assert picked.columns == ["c", "a"]
    named = str(tmp_path / "n")
    writers.csv(spark.createDataFrame([(1, 0.5), (2, 1.5)], "index int, x double"), named, header=True)
    assert sorted(r.x for r in readers.csv_by_header(spark, named, {"x": "double"}).collect()) == [0.5, 1.5]
    assert sorted(r["index"] for r in readers.csv(spark, named, "index int, x double").collect()) == [1, 2]
    writers.csv(spark.createDataFrame([(9,)], "a int"), named)
    assert [r.value for r in readers.text_lines(spark, named).collect()] == ["9"]
    assert [tuple(r) for r in readers.stdin(spark, ["a  b\n", "c"]).collect()] == [(0, "a"), (1, "b"), (2, "c")]
    bad = str(tmp_path / "bad")
    spark.createDataFrame([("1 x",)], "value string").write.text(bad)
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        readers.vectors(spark, bad).collect()
    assert readers.vectors(spark, bad, strict=False).first().vec == [1.0, None]
    js = str(tmp_path / "j")
    spark.createDataFrame([('{"a": {"b": 3}}',), ("{}",)], "value string").write.text(js)
    assert sorted(r.b or "" for r in readers.json_lines(spark, js, {"b": "a.b"}).collect()) == ["", "3"]
    assert spark.range(1).select(readers.column_of(F.lit("a b c"), 2).alias("c")).first().c == "b"
    matrix = str(tmp_path / "m")
    writers.matrix_export(spark.createDataFrame([(1, [1, 2]), (2, [3, 4])], "y int, line array<int>"), "y", matrix)
    assert [r.value for r in readers.text_lines(spark, matrix).collect()] == ["3 4", "1 2"]


def test_stream_equals_batch(spark, tmp_path):
    from cellwise.operators.count_min import Sizing
    from cellwise.streaming.sketch_stream import to_memory, windowed_counters

    rows = [(i % 40, f"k{i % 7}", f"2024-01-01 0{i % 3}:00:00") for i in range(120)] + [(500, None, "2024-01-01 00:00:00")]
    df = spark.createDataFrame(rows, "id int, key string, ts string").withColumn("ts", F.to_timestamp("ts"))
    df.write.parquet(str(tmp_path / "s"))
    sizing = Sizing(2, 16)
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "s"))
    got = to_memory(windowed_counters(stream, F.col("key"), "ts", sizing), "sketch_test")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, windowed_counters(df, F.col("key"), "ts", sizing).collect()))
    once = windowed_counters(df, F.col("key"), "ts", sizing, update_id="id").groupBy("row").agg(F.sum("cnt").alias("n")).collect()
    assert {r.n for r in once} == {40}


def test_sketch_jobs(spark):
    from cellwise.plans.pipelines import SketchSpec, build_sketches, field_key, heavy_hitter_table

    df = spark.createDataFrame([(0.124, "a", 2.0), (0.126, "a", 3.0), (None, "b", 1.0)], "x double, y string, w double")
    keys = [r.k for r in df.select(field_key(["x", "y"], None).alias("k")).collect()]
    assert keys == ["(0.124,a)", "(0.126,a)", None]
    out = build_sketches(df, [SketchSpec("c", ["x"], precision=1), SketchSpec("w", ["y"], "weight", "w"), SketchSpec("b", ["y"], "bloom")])
    assert out["c"].groupBy("row").agg(F.sum("cnt").alias("n")).first().n == 2
    assert out["w"].groupBy("row").agg(F.sum("val").alias("n")).first().n == 6.0 and out["b"].count() > 0
    assert [tuple(r) for r in heavy_hitter_table(df, F.col("y"), 1).collect()] == [(1, "a", 2)]


def test_join_of_hot_keys(spark):
    from cellwise.session import join_hot

    left = spark.createDataFrame([(i, "a" if i % 3 else str(i)) for i in range(300)] + [(999, None)], "id int, k string")
    right = spark.createDataFrame([("a", 1, 200), ("3", 2, 1), ("6", 3, 1), ("zz", 4, 0)], "_k string, v int, n int")
    for least in (0, 10, 1000):
        out = join_hot(left, right, F.col("k") == F.col("_k"), F.col("n") > least)
        assert out.columns == ["id", "k", "_k", "v", "n"] and out.count() == 202 and {r.v for r in out.collect()} == {1, 2, 3}
    assert join_hot(left.limit(0), right, F.col("k") == F.col("_k"), F.col("n") > 10).count() == 0


def test_exports(spark, tmp_path):
    from cellwise.plans.pipelines import TripQuery, taxi_pipeline, write_centers
    from cellwise.sources import readers, writers

    write_centers(spark, {1: [0.5, -1.0], 2: [2.0, 3.5]}, f"{tmp_path}/centers")
    assert sorted(r.value for r in readers.text_lines(spark, f"{tmp_path}/centers").collect()) == ["1 0.5 -1.0", "2 2.0 3.5"]
    matrix = spark.createDataFrame([(1, [1, 2]), (3, [5, 6]), (2, [3, 4])], "y int, line array<int>")
    writers.matrix_export(matrix, "y", f"{tmp_path}/matrix")
    assert [r.value for r in readers.text_lines(spark, f"{tmp_path}/matrix").collect()] == ["5 6", "3 4", "1 2"]
    trips = spark.createDataFrame([(41.15, -8.61, 12, 8), (41.15, -8.61, 4, 8), (41.16, -8.6, 30, 9), (None, -8.6, 1, 1)], "lat double, lon double, duration int, hour_of_day int")
    done = taxi_pipeline(trips, TripQuery(box=(4114, -862, 4116, -860), hour_step=12), f"{tmp_path}/taxi")
    assert done.summary.first().n == 9 * 2 and done.windows.agg(F.sum("real_count")).first()[0] > 0
    assert {r.center for r in spark.read.options(sep="\t", header="true").csv(f"{tmp_path}/taxi/slots").select("center").distinct().collect()} == {f"{a}:{b}" for a in range(4114, 4117) for b in range(-862, -859)}


def test_command_line_describes(capsys):
    from cellwise.__main__ import main

    assert main(["describe", "bloom_words"]) == 0 and "64-bit words" in capsys.readouterr().out
    assert main(["describe", "nothing"]) == 2 and main([]) == 2
