"""Scans: delimited vectors, CSV with header or with a typed column mask, text, folders of parts, standard input, collections."""

from __future__ import annotations

import sys
from collections.abc import Iterable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class SampleFormat:
    """Layout of sample lines: ``label`` -1 means no label; features begin at ``first_feature``."""

    delimiter: str = " "
    id: int = 0
    label: int = 1
    first_feature: int = 2


def text_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """One column ``value``. A folder gives the lines of all its files."""
    return spark.read.option("recursiveFileLookup", "true").text(path)


def parse_vector(line: Column, delimiter: str = " ", strict: bool = True) -> Column:
    """ARRAY<DOUBLE> of a delimited line; a malformed field raises an error, or gives a null entry if not ``strict``. A null line gives null."""
    import re

    parts = F.split(F.trim(line), re.escape(delimiter))
    return F.transform(parts, lambda x: F.trim(x).cast("double") if strict else F.trim(x).try_cast("double"))


def vectors(spark: SparkSession, path: str, delimiter: str = " ", strict: bool = True) -> DataFrame:
    """(vec) of every non-empty line."""
    return text_lines(spark, path).where(F.length(F.trim("value")) > 0).select(parse_vector(F.col("value"), delimiter, strict).alias("vec"))


def csv(spark: SparkSession, path: str, schema: str | T.StructType, delimiter: str = ",", header: bool = True) -> DataFrame:
    """CSV by explicit schema: no inference pass over the data. Malformed rows raise an error."""
    return spark.read.options(sep=delimiter, header=str(header).lower(), mode="FAILFAST").schema(schema).csv(path)


def csv_by_header(spark: SparkSession, path: str, columns: dict[str, str], delimiter: str = ",") -> DataFrame:
    """Named columns of a CSV with header, cast to the given types; the order in the file does not matter."""
    raw = spark.read.options(sep=delimiter, header="true").csv(path)
    return raw.select(*[F.col(f"`{c}`").cast(t).alias(c) for c, t in columns.items()])


def typed_csv(spark: SparkSession, path: str, mask: Sequence[tuple[int, str, str]], width: int, delimiter: str = " ") -> DataFrame:
    """Columns picked by position: ``mask`` holds (position, name, type) of a file of ``width`` columns; others are pruned in the scan."""
    kinds = {p: (n, t) for p, n, t in mask}
    schema = ", ".join(f"`{kinds[i][0]}` {kinds[i][1]}" if i in kinds else f"_skip{i} string" for i in range(width))
    return spark.read.options(sep=delimiter, header="false").schema(schema).csv(path).select(*[n for _, n, _ in mask])


def samples(spark: SparkSession, path: str, form: SampleFormat = SampleFormat()) -> DataFrame:
    """(sample BIGINT, label INT or null, features ARRAY<DOUBLE>) of sample lines."""
    parts = F.split(F.trim("value"), form.delimiter)
    label = F.lit(None).cast("int") if form.label < 0 else F.get(parts, F.lit(form.label)).cast("int")
    features = F.transform(F.slice(parts, F.lit(form.first_feature + 1), F.size(parts)), lambda x: x.cast("double"))
    return text_lines(spark, path).where(F.length(F.trim("value")) > 0).select(F.get(parts, F.lit(form.id)).cast("bigint").alias("sample"), label.alias("label"), features.alias("features"))


def tokens(lines: Iterable[str]) -> list[str]:
    """Tokens separated by any white space."""
    return [t for line in lines for t in line.split()]


def stdin(spark: SparkSession, stream: Iterable[str] | None = None) -> DataFrame:
    """(pos, value) of the tokens of standard input, which the driver holds."""
    found = tokens(sys.stdin if stream is None else stream)
    return collection(spark, list(enumerate(found)), "pos bigint, value string")


def collection(spark: SparkSession, rows: Sequence, schema: str) -> DataFrame:
    return spark.createDataFrame(list(rows), schema)


def json_paths(line: Column, paths: dict[str, str]) -> list[Column]:
    """Columns of dotted paths of a JSON line (null where missing)."""
    return [F.get_json_object(line, "$." + p).alias(n) for n, p in paths.items()]


def json_lines(spark: SparkSession, path: str, paths: dict[str, str]) -> DataFrame:
    return text_lines(spark, path).select(*json_paths(F.col("value"), paths))


def sorted_by_path(df: DataFrame, line: Column, path: str, kind: str = "string", ascending: bool = True) -> DataFrame:
    """``df`` in the order of a value in its JSON lines, as a range-partitioned sort; lines without the value come last."""
    value = F.get_json_object(line, "$." + path).try_cast(kind)
    return df.orderBy(value.asc_nulls_last() if ascending else value.desc_nulls_last())


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """Statistics written by ``writers.csv`` of a sweep, typed."""
    return csv(spark, path, "delta double, epsilon double, depth int, width int, n_keys bigint, total bigint, estimated_total bigint, max_error bigint, n_over bigint, n_under bigint, n_beyond_bound bigint", header=False)


def column_of(line: Column, position: int, delimiter: str = " ") -> Column:
    """Field ``position`` (from 1) of a delimited line."""
    return F.get(F.split(line, delimiter), F.lit(position - 1))


def tagged(**sources: DataFrame) -> DataFrame:
    """Union of sources with one layout, each row with the name of its ``origin``."""
    out = None
    for name, df in sources.items():
        part = df.withColumn("origin", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out
