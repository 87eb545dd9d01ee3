"""Has this key been seen before? Sealed batches are held as fingerprint filters, the current batch is handled exactly.

Batches are numbered 0, 1, 2, ... in time. Filters are built for aligned blocks of 2^j batches, so the batches before batch t are covered by one
filter a set bit of t (at most log2 of the number of batches), as generations of a log-structured merge tree are. The keys are split in shards by
hash, so that no filter and no task holds more than about ``SHARD_KEYS`` keys of the whole history.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm import peel
from cellwise.session import stage

SHARD_KEYS = 60_000
_FILTERS = "shard int, level int, block bigint, seed int, segment bigint, n_keys bigint, prints binary"


@dataclass
class History:
    """``firsts``: one row a batch and key with the first row of the key in the batch. ``filters``: one row a shard, level and block."""

    firsts: DataFrame
    filters: DataFrame
    keys: list[str]
    batches: int
    shards: int


def build_history(rows: DataFrame, key: dict[str, Column], day: Column, order: Column, row_id: Column) -> History:
    """Seal the batches of ``rows``. Rows with a null in the key have no key. A null day or order counts as the earliest. Ties in order go by row id."""
    names = list(key)
    base = rows.select(*[c.alias(n) for n, c in key.items()], day.cast("int").alias("_day"), F.struct(order.alias("o"), row_id.alias("r")).alias("_first"))
    base = base.where(" AND ".join(f"`{n}` IS NOT NULL" for n in names))
    firsts = base.groupBy("_day", *names).agg(F.min("_first").alias("_first")).select(*names, "_day", "_first", F.xxhash64(*names).alias("_h"))
    firsts = stage(firsts, "firsts")
    low, high, n = firsts.agg(F.min("_day"), F.max("_day"), F.count(F.lit(1))).first()
    low, high = low or 0, high or 0
    shards = max(1, -(-n // SHARD_KEYS))
    batch = F.coalesce(F.col("_day") - F.lit(low - 1), F.lit(0)).cast("bigint").alias("_t")  # 0 is the batch of null days
    firsts = firsts.select(*names, "_first", "_h", batch, _shard(shards))
    batches = high - low + 2
    filters = stage(firsts.select("_shard", "_t", "_h").groupBy("_shard").applyInPandas(_build_blocks, _FILTERS), "filters")
    return History(firsts, filters, names, batches, shards)


def _shard(shards: int) -> Column:
    return F.pmod(F.shiftright("_h", 32), F.lit(shards)).cast("int").alias("_shard")


def _build_blocks(pdf: pd.DataFrame) -> pd.DataFrame:
    t, h = pdf["_t"].to_numpy(np.int64), pdf["_h"].to_numpy(np.int64)
    order = np.argsort(t, kind="stable")
    t, h = t[order], h[order]
    out = []
    for level in range(int(t[-1]).bit_length() + 1):
        block = t >> level
        cuts = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        for a, b in zip(cuts, np.append(cuts[1:], len(t)), strict=True):
            if block[a] % 2 == 0:
                seed, segment, table = peel.build(h[a:b])
                out.append((int(pdf["_shard"].iloc[0]), level, int(block[a]), seed, segment, b - a, table))
    return pd.DataFrame(out, columns=["shard", "level", "block", "seed", "segment", "n_keys", "prints"])


def _probe_blocks(t: np.ndarray, h: np.ndarray, filters: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """For each key whether a filter of the batches before t takes it for a member, and how many filters were asked."""
    seen, asked = np.zeros(len(t), bool), np.zeros(len(t), np.int32)
    for f in filters.itertuples(index=False):
        rows = np.flatnonzero((t >> f.level) == f.block + 1)  # the block is even, so t has this bit set and the block ends where t's part begins
        if len(rows):
            asked[rows] += 1
            seen[rows] |= peel.probe(h[rows], f.seed, f.segment, f.prints)
    return seen, asked


def probe(history: History, keys: DataFrame, extra: Sequence[str]) -> DataFrame:
    """``keys`` has the key columns, ``_h``, ``_t`` and ``_shard``. Adds ``maybe`` and ``asked``: what the filters of the batches before ``_t`` say."""
    cols = [*history.keys, *extra, "_h", "_t", "_shard"]
    source = keys.select(*cols)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in source.schema) + ", maybe boolean, asked int"

    def ask(pdf: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
        if not len(pdf):
            return pdf.assign(maybe=pd.Series(dtype=bool), asked=pd.Series(dtype="int32"))
        maybe, asked = _probe_blocks(pdf["_t"].to_numpy(np.int64), pdf["_h"].to_numpy(np.int64), filters)
        return pdf.assign(maybe=maybe, asked=asked)

    return source.groupBy("_shard").cogroup(history.filters.withColumnRenamed("shard", "_shard").groupBy("_shard")).applyInPandas(ask, schema)


def _earlier(history: History, positives: DataFrame) -> DataFrame:
    """Of probed keys, those that really are in a batch before ``_t``."""
    known = history.firsts.groupBy(*[F.col(k).alias(f"_x{k}") for k in history.keys]).agg(F.min("_t").alias("_xt"))  # one row a key, so that no key meets all its batches
    same = F.lit(True)
    for k in history.keys:
        same = same & (F.col(k) == F.col(f"_x{k}"))
    return positives.join(known, same & (F.col("_xt") < F.col("_t")), "left_semi")


def first_rows(history: History) -> tuple[DataFrame, DataFrame]:
    """The rows that bring a new key (``row_id``), and the probed table with ``maybe``, ``asked`` and ``seen`` (checked exactly)."""
    source = history.firsts.withColumn("_row", F.col("_first.r"))
    probed = stage(probe(history, source, ["_row"]), "probed")
    sure = _earlier(history, probed.where("maybe")).select(*history.keys, "_t", F.lit(True).alias("seen"))
    checked = probed.join(sure, [*history.keys, "_t"], "left").withColumn("seen", F.coalesce("seen", F.lit(False)))
    return checked.where("NOT seen").select(F.col("_row").alias("row_id")), checked


def present(history: History, rows: DataFrame, key: dict[str, Column], keep: dict[str, Column]) -> DataFrame:
    """``keep`` columns and ``present``: whether the key of a row is in any batch. Rows with a null in the key are not present. Repeated rows count once."""
    names = list(key)
    asked = rows.select(*[c.alias(n) for n, c in key.items()], *[c.alias(f"_keep_{n}") for n, c in keep.items()]).distinct()
    asked = asked.select("*", F.xxhash64(*names).alias("_h"), F.lit(history.batches).cast("bigint").alias("_t")).select("*", _shard(history.shards))
    probed = probe(history, asked, [f"_keep_{n}" for n in keep])
    maybe = probed.where("maybe")
    known = history.firsts.select(*history.keys).distinct().withColumn("_in", F.lit(True))
    checked = maybe.join(known, history.keys, "left").select(*[F.col(f"_keep_{n}").alias(n) for n in keep], F.coalesce("_in", F.lit(False)).alias("present"))
    return probed.where("NOT maybe").select(*[F.col(f"_keep_{n}").alias(n) for n in keep], F.lit(False).alias("present")).unionByName(checked)


def error_report(history: History) -> DataFrame:
    """Per batch: keys asked about, positives, wrong positives, and the compounded bound 1-(1-rate)^filters on the share of wrong answers."""
    _, checked = first_rows(history)
    bound = F.lit(1.0) - F.pow(F.lit(1.0 - peel.RATE), F.max("asked"))
    return checked.groupBy(F.col("_t").alias("batch")).agg(
        F.count(F.lit(1)).alias("n_keys"),
        F.sum(F.col("maybe").cast("bigint")).alias("n_positive"),
        F.sum((F.col("maybe") & ~F.col("seen")).cast("bigint")).alias("n_wrong"),
        F.max("asked").alias("n_filters"),
        bound.alias("error_bound"),
    )


def answer_report(asked: DataFrame, run: str, sketch: str, real: str, positive: str) -> DataFrame:
    """Per ``run`` of ``asked`` (one row an answer, with ``present``): answers, those that say seen or new wrongly, their share as ``wrong_rate``, and how many recorded real
    counts and recorded wrong positives disagree with the truth. A null count is no answer; a null run is a run."""
    seen, here = F.col(sketch) > 0, F.col("present")
    said_seen, said_new = seen & ~here, (F.col(sketch) == 0) & here
    n = F.count(F.col(sketch))
    return asked.groupBy(run).agg(
        n.alias("n_answers"), F.count_if(said_seen).alias("n_said_seen"), F.count_if(said_new).alias("n_said_new"), F.count_if((F.col(real) > 0) != here).alias("n_real_wrong"),
        F.count_if((F.col(positive) > 0) != (seen & ~here)).alias("n_positive_wrong"), F.round(F.try_divide(F.count_if(said_seen | said_new), n), 9).alias("wrong_rate"),
    )
