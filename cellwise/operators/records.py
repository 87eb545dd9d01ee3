"""Delimited records to typed fields or to rejects with a reason, by structural indexing.

A batch of records is one byte buffer. Quote positions give a prefix parity, the parity tells delimiters from text, delimiters and record ends give
field spans; counts and types are then checked a column at a time. No record is looked at by itself.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import spread

QUOTING, COLUMNS, VALUE, FORMAT = "quoting", "columns", "value", "format"

_NUMBER = r"[+-]?[0-9]+(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?"
_PAIR = rf"\[[ \t]*{_NUMBER}[ \t]*,[ \t]*{_NUMBER}[ \t]*\]"
_PATTERNS = {
    "digits": r"^[0-9]+$",
    "integer": r"^[+-]?[0-9]+$",
    "integer_or_empty": r"^(?:[+-]?[0-9]+)?$",
    "number": rf"^{_NUMBER}$",
    "abc": r"^[ABC]$",
    "bool": r"^(?i:true|false)$",
    "polyline": rf"^\[[ \t]*(?:{_PAIR}[ \t]*(?:,[ \t]*{_PAIR}[ \t]*)*)?\]$",
}
_ARROW = {
    "digits": pa.string(), "abc": pa.string(), "integer": pa.int64(), "integer_or_empty": pa.int64(), "number": pa.float64(), "bool": pa.bool_(),
    "polyline": pa.list_(pa.list_(pa.float64())),
}
_SQL = {"digits": "string", "abc": "string", "integer": "bigint", "integer_or_empty": "bigint", "number": "double", "bool": "boolean", "polyline": "array<array<double>>"}

_BLANK = np.zeros(256, bool)
_BLANK[[9, 32]] = True
_EDGE = _BLANK.copy()
_EDGE[[10, 13]] = True


@dataclass(frozen=True)
class RecordFormat:
    """``delimiter`` a byte, or None for runs of blanks (then quotes have no meaning); ``fields`` maps output names to kinds of values."""

    name: str
    fields: dict[str, str]
    delimiter: str | None = ","


TRIP = RecordFormat("trip", {
    "trip_id": "digits", "call_type": "abc", "origin_call": "integer_or_empty", "origin_stand": "integer_or_empty", "taxi_id": "integer",
    "trip_epoch": "integer", "day_type": "abc", "missing_data": "bool", "polyline": "polyline",
})
REGRESSION = RecordFormat("regr", {"idx": "integer", "y": "number", "x": "number"})
POINT = RecordFormat("point", {"p0": "number", "p1": "number", "p2": "number"}, None)
FORMATS = (TRIP, REGRESSION, POINT)


def field_spans(buf: np.ndarray, begin: np.ndarray, end: np.ndarray, delimiter: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Spans of the fields of every record ``buf[begin:end]`` (already free of outer blanks).

    Returns (record of each field, its start, its end, records whose quoting is broken). Fields are free of blanks around them; quotes remain.
    """
    n, size = len(begin), len(buf)
    inside = np.zeros(size + 1, np.int32)
    np.add.at(inside, begin, 1)
    np.add.at(inside, end, -1)
    inside = np.cumsum(inside[:-1]) > 0
    blank = _BLANK[buf]
    broken = np.zeros(n, bool)
    if delimiter is None:
        full = inside & ~blank
        before = np.empty(size, bool)
        before[:1], before[1:] = False, full[:-1]
        before[begin[(begin < end)]] = False
        first = np.flatnonzero(full & ~before)
        after = np.empty(size, bool)
        after[-1:], after[:-1] = False, full[1:]
        after[end[begin < end] - 1] = False
        last = np.flatnonzero(full & ~after) + 1
        return np.searchsorted(begin, first, "right") - 1, first, last, broken

    quote = inside & (buf == 34)
    upto = np.zeros(size + 1, np.int64)
    np.cumsum(quote, out=upto[1:])
    broken |= ((upto[end] - upto[begin]) & 1).astype(bool)
    # parity before each byte; the record's own start is the origin, so a broken record does not spoil the next
    marks = np.flatnonzero(inside & ((buf == ord(delimiter)) | quote))
    owner = np.searchsorted(begin, marks, "right") - 1
    odd = ((upto[marks] - upto[begin[owner]]) & 1).astype(bool)
    is_quote = buf[marks] == 34
    cuts, cut_owner = marks[~is_quote & ~odd], owner[~is_quote & ~odd]

    counts = np.bincount(cut_owner, minlength=n) + 1
    record = np.repeat(np.arange(n), counts)
    head = np.concatenate(([0], np.cumsum(counts)[:-1]))
    start, stop = np.empty(len(record), np.int64), np.empty(len(record), np.int64)
    is_head = np.zeros(len(record), bool)
    is_head[head] = True
    is_last = np.zeros(len(record), bool)
    is_last[head + counts - 1] = True
    start[is_head], start[~is_head] = begin, cuts + 1
    stop[is_last], stop[~is_last] = end, cuts

    solid = np.flatnonzero(inside & ~blank)
    at = np.searchsorted(solid, start)
    padded = np.concatenate((solid, [size]))
    first = np.minimum(padded[at], stop)
    last = np.where(first < stop, padded[np.searchsorted(solid, stop) - 1] + 1, first)

    if is_quote.any():
        q, q_owner, q_odd = marks[is_quote], owner[is_quote], odd[is_quote]
        field = np.searchsorted(start, q, "right") - 1
        opens = ~q_odd
        prev_quote = np.zeros(len(q), bool)
        prev_quote[1:] = (q[1:] - q[:-1] == 1) & (q_owner[1:] == q_owner[:-1])
        next_quote = np.zeros(len(q), bool)
        next_quote[:-1] = prev_quote[1:]
        wrong = np.where(opens, (q != first[field]) & ~prev_quote, (q != last[field] - 1) & ~next_quote)
        broken[q_owner[wrong]] = True
    return record, first, last, broken


def _texts(data: bytes, start: np.ndarray, end: np.ndarray) -> pa.Array:
    return pa.array([data[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)], pa.binary()).cast(pa.string())


def _doubles(texts: pa.Array) -> np.ndarray:
    raw = [t.encode() if t is not None else b"nan" for t in texts.to_pylist()]
    return np.array(raw, dtype="S").astype(np.float64) if raw else np.zeros(0)


def _check(kind: str, texts: pa.Array) -> tuple[np.ndarray, object]:
    """Which texts are proper values of a kind, and what the kind needs to make its typed column."""
    good = np.array(pc.match_substring_regex(texts, _PATTERNS[kind]), dtype=bool)
    if kind == "number":
        value = np.full(len(texts), np.nan)
        value[good] = _doubles(texts.filter(pa.array(good)))
        return good & np.isfinite(value), value
    if kind == "polyline":
        rows = np.flatnonzero(good)
        bare = pc.replace_substring_regex(texts.take(pa.array(rows)), r"[\[\] \t]", "")
        parts = pc.split_pattern(bare, ",")
        counts = np.where(np.array(pc.equal(bare, "")), 0, np.array(pc.list_value_length(parts)))
        flat = pc.list_flatten(parts.filter(pa.array(counts > 0)))
        value = _doubles(flat)
        owner = np.repeat(np.arange(len(rows)), counts)
        limit = np.tile([180.0, 90.0], len(value) // 2)
        with np.errstate(invalid="ignore"):
            out = ~(np.abs(value) <= limit)
        good[rows[np.unique(owner[out])]] = False
        return good, (rows, counts, value)
    return good, None


def _typed(kind: str, texts: pa.Array, good: np.ndarray, extra: object) -> pa.Array:
    mask = pa.array(good)
    if kind == "number":
        return pa.array(extra, mask=~good)
    if kind == "polyline":
        rows, counts, value = extra
        inner = pa.ListArray.from_arrays(pa.array(np.arange(0, len(value) + 1, 2, dtype=np.int32)), pa.array(value))
        lengths = np.zeros(len(texts), np.int64)
        lengths[rows] = counts // 2
        offsets = np.concatenate(([0], np.cumsum(lengths))).astype(np.int32)
        return pc.if_else(mask, pa.ListArray.from_arrays(pa.array(offsets), inner), pa.scalar(None, _ARROW[kind]))
    kept = pc.if_else(mask, texts, pa.scalar(None, pa.string()))
    if kind == "bool":
        return pc.equal(pc.utf8_lower(kept), "true")
    if kind.startswith("integer"):
        whole = [None if t is None or t == "" else int(t) for t in kept.to_pylist()]
        return pa.array([v if v is not None and -(2**63) <= v < 2**63 else None for v in whole], pa.int64())
    return kept


def parse_batch(records: pa.Array, form: RecordFormat, typed: bool = True) -> tuple[np.ndarray, dict[str, pa.Array]]:
    """The reason of each record ('' if valid) and, if ``typed``, one column a field (null in rejects)."""
    records = pc.fill_null(records.cast(pa.large_string()), "")
    n = len(records)
    offsets = np.frombuffer(records.buffers()[1], np.int64, n + 1 + records.offset)[records.offset :]
    data = records.buffers()[2].to_pybytes() if n and records.buffers()[2] is not None else b""
    buf = np.frombuffer(data, np.uint8)
    reason = np.full(n, "", dtype=object)
    solid = np.flatnonzero(~_EDGE[buf])
    padded = np.concatenate((solid, [len(buf)]))
    begin = np.minimum(padded[np.searchsorted(solid, offsets[:-1])], offsets[1:])
    end = np.where(begin < offsets[1:], padded[np.searchsorted(solid, offsets[1:]) - 1] + 1, begin)
    live = np.flatnonzero(begin < end)
    reason[begin >= end] = COLUMNS

    if not len(live):
        return reason, {name: pa.nulls(n, _ARROW[kind]) for name, kind in form.fields.items()} if typed else {}
    record, start, stop, broken = field_spans(buf, begin[live], end[live], form.delimiter)
    reason[live[broken]] = QUOTING
    count = np.bincount(record, minlength=len(live))
    whole = ~broken & (count == len(form.fields))
    reason[live[~broken & ~whole]] = COLUMNS
    rows = live[whole]
    keep = whole[record]
    width = len(form.fields)
    start, stop = start[keep].reshape(-1, width), stop[keep].reshape(-1, width)
    if form.delimiter is not None and len(rows):
        quoted = (start < stop) & (buf[np.minimum(start, len(buf) - 1)] == 34)
        start, stop = start + quoted, stop - quoted
    good = np.ones(len(rows), bool)
    columns: dict[str, tuple] = {}
    for j, (name, kind) in enumerate(form.fields.items()):
        texts = _texts(data, start[:, j], stop[:, j])
        if form.delimiter is not None:
            texts = pc.utf8_trim(pc.replace_substring(texts, '""', '"'), " \t")
        ok, extra = _check(kind, texts)
        good &= ok
        columns[name] = (kind, texts, extra)
    reason[rows[~good]] = VALUE
    if not typed:
        return reason, {}
    place = np.full(n, -1)
    place[rows[good]] = np.flatnonzero(good)
    at = pa.array(place, mask=place < 0)
    return reason, {name: _typed(kind, texts, good, extra).take(at) for name, (kind, texts, extra) in columns.items()}


def parse_records(df: DataFrame, record: Column, fmt: Column, keep: dict[str, Column], formats: Iterable[RecordFormat] = FORMATS, typed: bool = True) -> DataFrame:
    """Every record once: ``keep`` columns, ``fmt``, ``reason`` (null if valid) and, if ``typed``, the fields of all formats.

    The first reason that applies is given: quoting, columns, value. A null or blank record breaks ``columns``; a record of an unknown or null
    format gets ``format``. Integers beyond 63 bits are valid but their typed value is null. Repeated rows stay repeated. Narrow: no shuffle,
    memory of one Arrow batch a task.
    """
    formats = tuple(formats)
    renamed = {f"_c{i}": c for i, c in enumerate(keep.values())}
    source = df.select(*[c.alias(n) for n, c in renamed.items()], fmt.alias("_fmt"), record.cast("string").alias("_rec"))
    fields = {n: k for f in formats for n, k in f.fields.items()} if typed else {}
    kept = source.drop("_rec").schema
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kept] + ["_reason string"] + [f"`{n}` {_SQL[k]}" for n, k in fields.items()])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            kinds, records = batch.column("_fmt"), batch.column("_rec")
            left = np.ones(batch.num_rows, bool)
            for form in formats:
                rows = np.flatnonzero(np.array(pc.fill_null(pc.equal(kinds, form.name), False)))
                if len(rows):
                    left[rows] = False
                    at = pa.array(rows)
                    reason, typed_columns = parse_batch(records.take(at), form, typed)
                    yield _out(batch, at, reason, typed_columns, fields)
            if left.any():
                at = pa.array(np.flatnonzero(left))
                yield _out(batch, at, np.full(len(at), FORMAT, dtype=object), {}, fields)

    parsed = spread(source).mapInArrow(parse, schema)
    named = [F.col(c).alias(n) for c, n in zip(renamed, keep, strict=True)]
    return parsed.select(*named, F.col("_fmt").alias("fmt"), F.col("_reason").alias("reason"), *fields)


def _out(batch: pa.RecordBatch, at: pa.Array, reason: np.ndarray, columns: dict[str, pa.Array], fields: dict[str, str]) -> pa.RecordBatch:
    arrays = [batch.column(i).take(at) for i, n in enumerate(batch.schema.names) if n != "_rec"]
    names = [n for n in batch.schema.names if n != "_rec"]
    arrays.append(pa.array([r or None for r in reason], pa.string()))
    for name, kind in fields.items():
        arrays.append(columns[name] if name in columns else pa.nulls(len(at), _ARROW[kind]))
    return pa.RecordBatch.from_arrays(arrays, names=[*names, "_reason", *fields])
