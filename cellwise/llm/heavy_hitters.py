"""Most frequent items of a weighted stream in bounded memory.

Pass 1: every partition keeps a space-saving summary of at most ``capacity`` counters a group; summaries are merged in a tree. A counter has a
guaranteed count (``low``) and an upper bound (``up``); an untracked item has at most ``floor``. Pass 2: rows of the surviving candidates are
counted exactly. With shares above 1/capacity no frequent item can be missed, as floor <= total/capacity.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import stage

#: Nodes of the levels of the tree in which the summaries of partitions are merged; no node merges more than about 32 others of the level before.
LEVELS = (1024, 32, 1)
#: Candidates up to this number are broadcast to the second pass (16 bytes each); more are joined by shuffle.
BROADCAST_ROWS = 200_000
_FLUSH = 200_000
_SCHEMA = "node int, g bigint, h bigint, low bigint, up bigint, floor bigint, total bigint"


class Summary:
    """Space-saving summaries of several groups: arrays sorted by (g, h), and a floor and a total of each group."""

    def __init__(self, capacity: int) -> None:
        self.capacity = capacity
        self.g = self.h = self.low = self.up = np.zeros(0, np.int64)
        self.floors: dict[int, int] = {}
        self.totals: dict[int, int] = {}

    def _floor_of(self, g: np.ndarray) -> np.ndarray:
        groups, at = np.unique(g, return_inverse=True)
        return np.array([self.floors.get(int(x), 0) for x in groups], np.int64)[at] if len(g) else np.zeros(0, np.int64)

    def add(self, g: np.ndarray, h: np.ndarray, w: np.ndarray) -> None:
        """Merge rows, that is, an exact summary with floor 0."""
        groups, at = np.unique(g, return_inverse=True)
        for x, n in zip(groups.tolist(), _sums(at, w, len(groups)).tolist(), strict=True):
            self.totals[x] = self.totals.get(x, 0) + n
        self._merge(g, h, w, w, dict.fromkeys(groups.tolist(), 0))

    def merge(self, g: np.ndarray, h: np.ndarray, low: np.ndarray, excess: np.ndarray, floors: dict[int, int], totals: dict[int, int]) -> None:
        """Merge other summaries, already added up: ``excess`` is up minus the floor of the summary that held the counter."""
        for x, n in totals.items():
            self.totals[x] = self.totals.get(x, 0) + n
        self._merge(g, h, low, excess, floors)

    def _merge(self, g: np.ndarray, h: np.ndarray, low: np.ndarray, excess: np.ndarray, floors: dict[int, int]) -> None:
        own = self.up - self._floor_of(self.g)
        g, h = np.concatenate((self.g, g)), np.concatenate((self.h, h))
        low, excess = np.concatenate((self.low, low)), np.concatenate((own, excess))
        for x, f in floors.items():
            self.floors[x] = self.floors.get(x, 0) + f
        order = np.lexsort((h, g))
        g, h = g[order], h[order]
        head = np.flatnonzero(np.concatenate(([True], (g[1:] != g[:-1]) | (h[1:] != h[:-1])))) if len(g) else np.zeros(0, np.int64)
        self.g, self.h = g[head], h[head]
        self.low = np.add.reduceat(low[order], head) if len(head) else self.low[:0]
        self.up = (np.add.reduceat(excess[order], head) if len(head) else self.up[:0]) + self._floor_of(self.g)
        self._prune()

    def _prune(self) -> None:
        order = np.lexsort((self.h, -self.up, self.g))
        g = self.g[order]
        if not len(g):
            return
        begin = np.flatnonzero(np.concatenate(([True], g[1:] != g[:-1])))
        rank = np.arange(len(g)) - np.repeat(begin, np.diff(np.append(begin, len(g))))
        gone = order[rank >= self.capacity]
        if len(gone):
            for x, u in zip(self.g[gone].tolist(), self.up[gone].tolist(), strict=True):
                if u > self.floors.get(x, 0):
                    self.floors[x] = u
            kept = np.sort(order[rank < self.capacity])
            self.g, self.h, self.low, self.up = self.g[kept], self.h[kept], self.low[kept], self.up[kept]

    def frame(self, node: int) -> pd.DataFrame:
        floor = self._floor_of(self.g)
        items = pd.DataFrame({"node": node, "g": self.g, "h": self.h, "low": self.low, "up": self.up, "floor": floor, "total": -1})
        groups = list(self.totals)
        heads = pd.DataFrame({"node": node, "g": groups, "h": 0, "low": 0, "up": 0, "floor": [self.floors.get(x, 0) for x in groups], "total": list(self.totals.values())})
        return pd.concat([heads, items]).astype({c: "int32" if c == "node" else "int64" for c in items.columns})


def _sums(at: np.ndarray, w: np.ndarray, n: int) -> np.ndarray:
    order = np.argsort(at, kind="stable")
    at = at[order]
    return np.add.reduceat(w[order], np.searchsorted(at, np.arange(n))) if n else np.zeros(0, np.int64)


def _merge_frame(pdf: pd.DataFrame, capacity: int, nodes: int) -> pd.DataFrame:
    heads, items = pdf[pdf["total"] >= 0], pdf[pdf["total"] < 0]
    by = heads.groupby("g")
    summary = Summary(capacity)
    summary.merge(
        items["g"].to_numpy(np.int64), items["h"].to_numpy(np.int64), items["low"].to_numpy(np.int64), (items["up"] - items["floor"]).to_numpy(np.int64),
        by["floor"].sum().to_dict(), by["total"].sum().to_dict(),
    )
    return summary.frame(int(pdf["node"].iloc[0]) % nodes)


def _merger(capacity: int, nodes: int):
    return lambda pdf: _merge_frame(pdf, capacity, nodes)


def summarise(rows: DataFrame, capacity: int) -> DataFrame:
    """Merged summary of ``rows`` (g bigint, h bigint, w bigint): counters (total -1) and one head row a group with its floor and total."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        summary, held, size = Summary(capacity), [], 0
        for batch in batches:
            held.append([np.asarray(batch.column(i)) for i in range(3)])
            size += batch.num_rows
            if size >= _FLUSH:
                summary.add(*[np.concatenate(x) for x in zip(*held, strict=True)])
                held, size = [], 0
        if size:
            summary.add(*[np.concatenate(x) for x in zip(*held, strict=True)])
        if summary.totals:
            yield pa.RecordBatch.from_pandas(summary.frame(TaskContext.get().partitionId() % LEVELS[0]), preserve_index=False)

    level = rows.select("g", "h", "w").mapInArrow(partial, _SCHEMA)
    for nodes in LEVELS:
        level = level.groupBy((F.col("node") % nodes).alias("_node"), "g").applyInPandas(_merger(capacity, nodes), _SCHEMA)
    return level


def _hashed(rows: DataFrame, key: Mapping[str, Column], weight: Column, group: Sequence[str], least: Column | None = None) -> DataFrame:
    """The key columns, ``_w``, ``_g`` (hash of the group), ``_h`` (hash of the key) and ``_least`` of the rows that count."""
    names = list(key)
    base = rows.select(*[c.alias(n) for n, c in key.items()], weight.cast("bigint").alias("_w"), *([least.alias("_least")] if least is not None else []))
    base = base.where(" AND ".join([f"`{n}` IS NOT NULL" for n in names] + ["_w > 0"]))
    g = F.xxhash64(*group) if group else F.lit(0).cast("bigint")
    return base.select(*names, "_w", g.alias("_g"), F.xxhash64(*names).alias("_h"), *(["_least"] if least is not None else []))


def top_items(rows: DataFrame, key: Mapping[str, Column], weight: Column, k: int, capacity: int) -> DataFrame:
    """The k keys with the largest total weight (ties to the smaller key): the ``key`` columns, ``total`` and ``group_total``, fewer only if there are fewer keys.

    A key among the k has at least the k-th largest guaranteed count of the summary, so only keys whose upper bound reaches it are counted. If keys
    that the summary does not hold may reach it too (a flat stream), all keys are counted. Rows are left out as in ``frequent_items``.
    """
    names = list(key)
    hashed = _hashed(rows, key, weight, ())
    summary = stage(summarise(hashed.select(F.col("_g").alias("g"), F.col("_h").alias("h"), F.col("_w").alias("w")), max(capacity, k)), "top-items")
    head = summary.where("total >= 0").agg(F.coalesce(F.max("floor"), F.lit(0)).alias("floor"), F.coalesce(F.max("total"), F.lit(0)).alias("total")).first()
    lows = [r["low"] for r in summary.where("total < 0").orderBy(F.col("low").desc()).limit(k).select("low").collect()]  # k numbers
    least = lows[-1] if len(lows) == k else 0
    counted = hashed
    if head["floor"] < least or head["floor"] == 0:
        counted = hashed.join(F.broadcast(summary.where("total < 0").where(F.col("up") >= least).select(F.col("h").alias("_h"))), "_h", "left_semi")
    totals = counted.groupBy(*names).agg(F.sum("_w").alias("total"))
    return totals.orderBy(F.col("total").desc(), *names).limit(k).withColumn("group_total", F.lit(head["total"]).cast("bigint"))


def frequent_items(
    rows: DataFrame, key: Mapping[str, Column], weight: Column, share: float, capacity: int, group: Sequence[str] = (), max_groups: int | None = 1, least: Column | None = None
) -> DataFrame:
    """Keys whose total weight is at least ``share`` of their group's total, with exact totals.

    Returns the ``key`` columns, ``total`` (exact), ``low`` and ``up`` (bounds of the summary), ``group_total``, and with ``least`` the smallest value of that
    expression among the key's rows as ``least``. ``group`` names the key
    columns that make groups (none: one group). Rows with a null in a key column or a weight that is null or below 1 are left out. Keys that
    collide in the 64-bit hash share a counter: bounds then hold for their sum, totals are exact. Columns are taken by expression, others ignored.

    With a known number of groups (``max_groups``) the candidates are at most ``max_groups * capacity`` and broadcast; with None they are written,
    counted, and broadcast only up to BROADCAST_ROWS. An empty input gives an empty result.
    """
    if not share > 1 / capacity:
        raise ValueError("share must be above 1/capacity")
    names = list(key)
    hashed = _hashed(rows, key, weight, group, least)
    summary = summarise(hashed.select(F.col("_g").alias("g"), F.col("_h").alias("h"), F.col("_w").alias("w")), capacity)
    if max_groups is None:
        summary = stage(summary, "frequent-items")
    heads = summary.where("total >= 0").select(F.col("g").alias("_g"), F.col("total").alias("group_total"))
    items = summary.where("total < 0").select(F.col("g").alias("_g"), F.col("h").alias("_h"), "low", "up")
    if max_groups is None and heads.count() > BROADCAST_ROWS:
        joined = items.join(heads, "_g")
    else:
        joined = items.join(F.broadcast(heads), "_g")
    wanted = joined.where(F.col("up") >= F.lit(share) * F.col("group_total"))
    if max_groups is not None or wanted.count() <= BROADCAST_ROWS:
        counted = hashed.join(F.broadcast(wanted), ["_g", "_h"])
    else:
        smallest = [F.min("_least").alias("_least")] if least is not None else []
        counted = hashed.groupBy(*names, "_g", "_h").agg(F.sum("_w").alias("_w"), *smallest).join(wanted, ["_g", "_h"])
    smallest = [F.min("_least").alias("least")] if least is not None else []
    totals = counted.groupBy(*names).agg(F.sum("_w").alias("total"), F.first("low").alias("low"), F.first("up").alias("up"), F.first("group_total").alias("group_total"), *smallest)
    return totals.where(F.col("total") >= F.lit(share) * F.col("group_total"))
