"""Percentiles of very large numeric columns by merging centroid digests.

A digest of a group is a list of clusters (mean, weight, lowest and highest value). Sorted values are clustered so that a cluster spans at most one
step of the scale k(q) = delta * (asin(2q-1)/pi + 1/2): fine at the tails, coarse in the middle, at most delta+1 clusters. Digests of partitions,
days or workers are merged by clustering their clusters again. As clusters keep their extremes, every rank has hard bounds; a second counting pass
gives exact ranks where bounds are not enough. All groups of a partition are clustered at once, in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import stage

DELTA = 100
#: Cut points up to this number are broadcast to the counting pass; more are joined by shuffle, where adaptive execution splits hot groups.
BROADCAST_ROWS = 200_000
_FLUSH = 400_000
_NODES = 64
_CLUSTER = ["mean", "weight", "lo", "hi"]


def cluster(code: np.ndarray, mean: np.ndarray, weight: np.ndarray, lo: np.ndarray, hi: np.ndarray, delta: int) -> tuple[np.ndarray, ...]:
    """Cluster the clusters of all groups ``code``; returns (index of a row of the group, mean, weight, lo, hi)."""
    order = np.lexsort((mean, code))
    c, x, w = code[order], mean[order], weight[order]
    head = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
    sizes = np.diff(np.append(head, len(c)))
    upto = np.cumsum(w)
    before = np.repeat(upto[head] - w[head], sizes)
    total = np.repeat(np.add.reduceat(w, head), sizes)
    q = (upto - w / 2 - before) / total
    step = np.floor(delta * (np.arcsin(np.clip(2 * q - 1, -1, 1)) / np.pi + 0.5)).astype(np.int64)
    cut = np.flatnonzero(np.concatenate(([True], (c[1:] != c[:-1]) | (step[1:] != step[:-1]))))
    weights = np.add.reduceat(w, cut)
    low, high = np.minimum.reduceat(lo[order], cut), np.maximum.reduceat(hi[order], cut)
    means = np.clip(np.add.reduceat(x * (w / np.repeat(weights, np.diff(np.append(cut, len(c))))), cut), low, high)
    return order[cut], means, weights, low, high


def _fold(held: list[pd.DataFrame], groups: Sequence[str], delta: int) -> pd.DataFrame:
    pdf = pd.concat(held, ignore_index=True)
    code = pdf.groupby(list(groups), sort=False, dropna=False).ngroup().to_numpy() if groups else np.zeros(len(pdf), np.int64)
    at, mean, weight, lo, hi = cluster(code, *[pdf[n].to_numpy(np.float64) for n in _CLUSTER], delta)
    return pdf[list(groups)].iloc[at].reset_index(drop=True).assign(mean=mean, weight=weight, lo=lo, hi=hi)


def _folder(groups: Sequence[str], delta: int, node: bool):
    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        done, held, size = [], [], 0
        for pdf in batches:
            held.append(pdf)
            size += len(pdf)
            if size >= _FLUSH:
                done = [_fold([*done, *held], groups, delta)]
                held, size = [], 0
        if held or done:
            out = _fold([*done, *held], groups, delta) if held else done[0]
            if len(out):
                yield out.assign(node=TaskContext.get().partitionId() % _NODES) if node else out

    return fold


def _schema(df: DataFrame, groups: Sequence[str]) -> str:
    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    return ", ".join([f"`{g}` {kinds[g]}" for g in groups] + [f"{n} double" for n in _CLUSTER])


def digest(values: DataFrame, value: Column, groups: Mapping[str, Column], delta: int = DELTA) -> DataFrame:
    """Digests of the finite values of each group: one row a cluster. Nulls, NaN and infinities are no values; a group without values has no rows.

    Null group values form a group. Partitions are clustered where they are, then merged by (group, node) and by group, so a hot group is never
    in one task before it is small.
    """
    names = list(groups)
    v = value.cast("double")
    base = values.select(*[c.alias(n) for n, c in groups.items()], v.alias("mean"))
    base = base.where(F.col("mean").isNotNull() & (F.abs("mean") < F.lit(float("inf"))))
    rows = base.select(*names, "mean", F.lit(1.0).alias("weight"), F.col("mean").alias("lo"), F.col("mean").alias("hi"))
    parts = rows.mapInPandas(_folder(names, delta, True), _schema(rows, names) + ", node int")
    nodes = parts.repartition(*names, "node").drop("node").mapInPandas(_folder(names, delta, False), _schema(rows, names))
    return merge(nodes, names, delta)


def merge(digests: DataFrame, groups: Sequence[str], delta: int = DELTA) -> DataFrame:
    """Digests of coarser groups, from digests of finer ones."""
    rows = digests.select(*groups, *_CLUSTER)
    gathered = rows.repartition(*groups) if groups else rows.repartition(1)
    return gathered.mapInPandas(_folder(groups, delta, False), _schema(rows, groups))


def quantiles(digests: DataFrame, groups: Sequence[str], qs: Sequence[float]) -> DataFrame:
    """``n``, and per group and ``q`` an ``estimate``: the mean of the cluster in which rank q*n falls, bounded by its extremes."""
    rows = digests.select(*groups, *_CLUSTER)
    gathered = rows.repartition(*groups) if groups else rows.repartition(1)

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = list(batches)
        if not sum(map(len, held)):
            return
        pdf = pd.concat(held, ignore_index=True)
        code = pdf.groupby(list(groups), sort=False, dropna=False).ngroup().to_numpy() if groups else np.zeros(len(pdf), np.int64)
        order = np.lexsort((pdf["mean"].to_numpy(), code))
        pdf, code = pdf.iloc[order].reset_index(drop=True), code[order]
        w, x, lo, hi = (pdf[c].to_numpy() for c in ("weight", "mean", "lo", "hi"))
        head = np.flatnonzero(np.concatenate(([True], code[1:] != code[:-1])))
        tail = np.append(head[1:], len(code))
        out = []
        for a, b in zip(head, tail, strict=True):
            upto = np.cumsum(w[a:b])
            mid = upto - w[a:b] / 2
            for q in qs:
                # linear between cluster middles; beyond the outer middles towards the extremes; within the extremes of the cluster of rank q*n, so that a value
                # that many rows share is met
                c = a + min(int(np.searchsorted(upto, q * upto[-1], "left")), b - a - 1)
                v = np.interp(q * upto[-1], np.concatenate(([0], mid, [upto[-1]])), np.concatenate(([lo[a:b].min()], x[a:b], [hi[a:b].max()])))
                out.append((a, q, upto[-1], min(max(v, lo[c]), hi[c]), lo[c], hi[c]))
        at = [o[0] for o in out]
        yield pdf[list(groups)].iloc[at].reset_index(drop=True).assign(q=[o[1] for o in out], n=np.array([o[2] for o in out]).astype("int64"), estimate=[o[3] for o in out], lo=[o[4] for o in out], hi=[o[5] for o in out])

    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return gathered.mapInPandas(read, ", ".join([f"`{g}` {kinds[g]}" for g in groups] + ["q double", "n bigint", "estimate double", "lo double", "hi double"]))


def count_ranks(values: DataFrame, value: Column, groups: Mapping[str, Column], cuts: DataFrame, cut: str) -> DataFrame:
    """Second pass: to each row of ``cuts`` (with the group columns) the exact ``n_below``, ``n_at_or_below`` and ``n_all`` of its group."""
    names = list(groups)
    v = value.cast("double")
    base = values.select(*[c.alias(n) for n, c in groups.items()], v.alias("_v")).where(F.col("_v").isNotNull() & (F.abs("_v") < F.lit(float("inf"))))
    small = cuts.count() <= BROADCAST_ROWS
    lists = cuts.groupBy(*names).agg(F.sort_array(F.collect_set(cut)).alias("_cuts"))
    lists = lists.select(*[F.col(n).alias(f"_x{n}") for n in names], "_cuts")
    same = F.lit(True)
    for n in names:
        same = same & F.col(n).eqNullSafe(F.col(f"_x{n}"))
    hit = base.join(F.broadcast(lists) if small else lists, same)
    # a value counts in one bucket of its group: the number of cuts below it, and at or below it
    below, upto = F.size(F.filter("_cuts", lambda c: c < F.col("_v"))), F.size(F.filter("_cuts", lambda c: c <= F.col("_v")))
    buckets = hit.select(*names, below.alias("_i"), upto.alias("_j"), "_cuts").groupBy(*names, "_i", "_j").agg(F.count(F.lit(1)).alias("_n"), F.first("_cuts").alias("_cuts"))
    counted = buckets.select("*", F.posexplode("_cuts").alias("_k", "_cut")).groupBy(*names, "_cut").agg(
        F.sum(F.when(F.col("_j") <= F.col("_k"), F.col("_n")).otherwise(0)).alias("n_below"),
        F.sum(F.when(F.col("_i") <= F.col("_k"), F.col("_n")).otherwise(0)).alias("n_at_or_below"),
        F.sum("_n").alias("n_all"),
    )
    counted = counted.select(*[F.col(n).alias(f"_x{n}") for n in names], "_cut", "n_below", "n_at_or_below", "n_all")
    return cuts.join(counted, same & (F.col(cut) == F.col("_cut"))).select(*cuts.columns, "n_below", "n_at_or_below", "n_all")


def rank_bounds(digests: DataFrame, groups: Sequence[str], cuts: DataFrame, cut: str, ids: Sequence[str]) -> DataFrame:
    """To each row of ``cuts`` hard bounds of the ranks of its cut, from the extremes of the clusters of its group (inner: a group needs values)."""
    d = digests.select(*[F.col(g).alias(f"_x{g}") for g in groups], *[F.col(n).alias(f"_{n}") for n in _CLUSTER])
    same = F.lit(True)
    for g in groups:
        same = same & F.col(g).eqNullSafe(F.col(f"_x{g}"))
    w, c = F.col("_weight"), F.col(cut)
    keep = [*ids, *groups, cut]
    return cuts.join(d, same).groupBy(*keep).agg(
        F.sum(F.when(F.col("_hi") < c, w).otherwise(0.0)).alias("below_min"),
        F.sum(F.when(F.col("_lo") < c, w).otherwise(0.0)).alias("below_max"),
        F.sum(F.when(F.col("_hi") <= c, w).otherwise(0.0)).alias("upto_min"),
        F.sum(F.when(F.col("_lo") <= c, w).otherwise(0.0)).alias("upto_max"),
        F.sum(w).alias("n"),
    )


def certify(values: DataFrame, value: Column, groups: Mapping[str, Column], found: DataFrame) -> DataFrame:
    """``found`` (of ``quantiles``, staged) with the rank error of each percentile, as counted: ``rank_error`` is how far q*n is outside [n_below, n_at_or_below], over n.

    Counted are the estimate and the extremes of its cluster, and the one with the least error is the percentile: where few values hold most rows, a
    value and not a mean of two.
    """
    names = list(groups)
    cuts = found.select(*names, "q", "n", F.explode(F.array_distinct(F.array("estimate", "lo", "hi"))).alias("cut"), "estimate")
    ranked = count_ranks(values, value, groups, cuts, "cut")
    wanted = F.col("q") * F.col("n")
    off = F.greatest(F.col("n_below") - wanted, wanted - F.col("n_at_or_below"), F.lit(0.0)) / F.col("n")
    best = F.min_by(F.struct("cut", "n_below", "n_at_or_below", off.alias("off")), F.struct(off.alias("off"), F.abs(F.col("cut") - F.col("estimate")).alias("far"), "cut")).alias("b")
    chosen = ranked.groupBy(*names, "q", "n").agg(best)
    return chosen.select(*names, "q", "n", F.col("b.cut").alias("estimate"), "b.n_below", "b.n_at_or_below", F.col("b.off").alias("rank_error"))


def certified(values: DataFrame, value: Column, groups: Mapping[str, Column], qs: Sequence[float], delta: int = DELTA) -> DataFrame:
    """Percentiles per group, certified."""
    found = stage(quantiles(stage(digest(values, value, groups, delta), "digests"), list(groups), qs), "quantiles")
    return certify(values, value, groups, found)
