"""Streaming histograms: at most B bins (center, count), the closest neighbours merged when there are more.

A histogram column is ARRAY<STRUCT<x DOUBLE, y DOUBLE>>, sorted by center. A batch of values is an exact histogram of its own; it is merged with the one
so far on sorted arrays. Partial histograms of partitions are merged in a tree, so no group is in one task before it is small.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = "array<struct<x:double,y:double>>"
#: Nodes of the first level of merges; a second level merges the nodes.
NODES = 64


def shrink(x: np.ndarray, y: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most ``most`` bins of sorted bins with distinct centers: neighbours whose gap is smaller than the gaps beside it become their weighted mean, smallest gaps
    first, several pairs at once. Counts and the weighted sum of centers stay as they are."""
    while len(x) > max(most, 1):
        gap = np.diff(x)
        beside = np.concatenate(([np.inf], gap, [np.inf]))
        low = np.flatnonzero((gap <= beside[:-2]) & (gap < beside[2:]))
        if not len(low):
            low = np.array([int(np.argmin(gap))])
        low = low[np.argsort(gap[low], kind="stable")][: len(x) - max(most, 1)]
        n = y[low] + y[low + 1]
        x, y = x.copy(), y.copy()
        x[low], y[low] = (x[low] * y[low] + x[low + 1] * y[low + 1]) / n, n
        x, y = np.delete(x, low + 1), np.delete(y, low + 1)
    return x, y


class StreamingHistogram:
    def __init__(self, max_bins: int, bins: Sequence[tuple[float, float]] = ()) -> None:
        self.max_bins = max_bins
        self.x = self.y = np.zeros(0)
        if len(bins):
            self.update([c for c, _ in bins], [n for _, n in bins])

    def update(self, values, counts=1) -> None:
        """Add values (one or many), each so many times (bins without a count are left out)."""
        v = np.atleast_1d(np.asarray(values, float))
        n = np.broadcast_to(np.asarray(counts, float), v.shape)
        v, n = np.concatenate((self.x, v[n > 0])), np.concatenate((self.y, n[n > 0]))
        x, of = np.unique(v, return_inverse=True)
        self.x, self.y = shrink(x, np.bincount(of, n, len(x)), self.max_bins)

    def merge(self, other: StreamingHistogram) -> StreamingHistogram:
        return StreamingHistogram(self.max_bins, [*self.bins, *other.bins])

    @property
    def bins(self) -> list[tuple[float, float]]:
        return list(zip(self.x.tolist(), self.y.tolist(), strict=True))

    @property
    def total(self) -> float:
        return float(self.y.sum())

    def above(self, value: float) -> float:
        """Counts of bins beyond ``value``."""
        return float(self.y[self.x > value].sum())

    def _at_centers(self) -> np.ndarray:
        """Estimated points up to each center: all of the bins before it and half of its own, as a trapezoid between neighbours gives."""
        return np.cumsum(self.y) - self.y / 2

    def count_up_to(self, value: float) -> float:
        """Estimated number of points at or below ``value``: bins are trapezoids between centers. Nothing lies below the first center, all up to the last."""
        if not len(self.x) or value < self.x[0]:
            return 0.0
        if value >= self.x[-1]:
            return self.total
        if value == self.x[0]:
            return float(self.y[0])
        i = int(np.searchsorted(self.x, value, "left")) - 1
        share = (value - self.x[i]) / (self.x[i + 1] - self.x[i])
        rise = self.y[i + 1] - self.y[i]
        return float(self._at_centers()[i] + share * (self.y[i] + share * rise / 2))

    def split_points(self, parts: int) -> list[float]:
        """parts-1 points that cut the total in about equal shares; none if there are fewer bins than parts.

        Between two centers the count grows by ``share * (y + share * rise / 2)``; the point is where it has grown by what the goal lacks. The counts at
        the outer centers are those of ``count_up_to``. A goal beyond the middle of the last bin is put at the last center.
        """
        if parts > len(self.x) or len(self.x) < 2:
            return []
        at = self._at_centers()
        goals = np.arange(1, parts) / parts * self.total
        i = np.clip(np.searchsorted(at, goals, "left") - 1, 0, len(at) - 2)
        lack = np.clip(goals - at[i], 0, at[i + 1] - at[i])
        first, rise = self.y[i], self.y[i + 1] - self.y[i]
        # the root of rise/2 s^2 + first s = lack in the form that needs no division by rise
        share = 2 * lack / (first + np.sqrt(np.maximum(first * first + 2 * rise * lack, 0)))
        return (self.x[i] + (self.x[i + 1] - self.x[i]) * share).tolist()

    def text(self, name: str) -> str:
        return f"{name};{self.max_bins};" + ",".join(f"{c} {n}" for c, n in self.bins)

    @staticmethod
    def from_text(text: str) -> tuple[str, StreamingHistogram]:
        name, size, bins = text.split(";")
        return name, StreamingHistogram(int(size), [(float(c), float(n)) for c, n in (b.split(" ") for b in bins.split(",") if b)])


def _pack(found: Mapping[tuple, StreamingHistogram], names: Sequence[str], **more) -> pd.DataFrame:
    rows = [(*k, [{"x": c, "y": n} for c, n in h.bins]) for k, h in found.items()]
    return pd.DataFrame(rows, columns=[*names, "bins"]).assign(**more)


def _schema(df: DataFrame, names: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([f"`{n}` {kinds[n]}" for n in names] + [f"bins {BINS}"])


def build(df: DataFrame, value: Column, groups: Mapping[str, Column], max_bins: int) -> DataFrame:
    """(groups.., bins) of the finite values; null groups are dropped. Bins depend on how rows are dealt to batches, as streaming histograms do;
    their total and their weighted mean do not."""
    names = list(groups)
    rows = df.select(*[c.alias(n) for n, c in groups.items()], value.cast("double").alias("v"))
    rows = rows.where(" AND ".join([f"`{n}` IS NOT NULL" for n in names] + ["v IS NOT NULL", "abs(v) < double('infinity')"]))

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        found: dict[tuple, StreamingHistogram] = {}
        for pdf in batches:
            v = pdf["v"].to_numpy()
            for key, at in pdf.groupby(names, sort=False).indices.items():
                key = key if isinstance(key, tuple) else (key,)
                found.setdefault(key, StreamingHistogram(max_bins)).update(v[at])
        yield _pack(found, names, node=np.int32(TaskContext.get().partitionId() % NODES))

    parts = rows.mapInPandas(partial, _schema(rows, names) + ", node int")
    return merge(merge(parts, [*names, "node"], max_bins), names, max_bins)


def merge(histograms: DataFrame, names: Sequence[str], max_bins: int) -> DataFrame:
    """Merged histogram of each group. Null or empty histograms add nothing."""

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        h = StreamingHistogram(max_bins, [(b["x"], b["y"]) for bs in pdf["bins"] if bs is not None for b in bs])
        return _pack({tuple(pdf[n].iloc[0] for n in names): h}, names)

    return histograms.groupBy(*names).applyInPandas(join, _schema(histograms, names))


def split_candidates(histograms: DataFrame, names: Sequence[str], parts: int) -> DataFrame:
    """(names.., candidates ARRAY<DOUBLE>) of histograms that have any."""
    kinds = {f.name: f.dataType.simpleString() for f in histograms.schema}
    schema = ", ".join([f"`{n}` {kinds[n]}" for n in names] + ["candidates array<double>"])

    def points(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [StreamingHistogram(len(bs), [(b["x"], b["y"]) for b in bs]).split_points(parts) for bs in pdf["bins"]]
            yield pdf[list(names)].assign(candidates=found)

    return histograms.mapInPandas(points, schema).where(F.size("candidates") > 0)


def count_up_to(bins: Column, value: Column) -> Column:
    """``StreamingHistogram.count_up_to`` as an expression over sorted bins."""
    count = lambda some: F.aggregate(some, F.lit(0.0), lambda s, b: s + b["y"])
    passed = F.filter(bins, lambda b: b["x"] < value)
    left, right = F.get(passed, F.size(passed) - 1), F.get(bins, F.size(passed))
    share = (value - left["x"]) / (right["x"] - left["x"])
    inside = count(passed) - left["y"] / 2 + share * (left["y"] + share * (right["y"] - left["y"]) / 2)
    at_first = F.when(right["x"] == value, right["y"]).otherwise(F.lit(0.0))
    return F.when(right.isNull() | (value >= F.get(bins, F.size(bins) - 1)["x"]), count(bins)).when(F.size(passed) == 0, at_first).otherwise(inside)


def count_above(bins: Column, value: Column) -> Column:
    return F.aggregate(F.filter(bins, lambda b: b["x"] > value), F.lit(0.0), lambda s, b: s + b["y"])
