"""Heavy hitters: the exact top k (default), Spark's approximate one, and the order-dependent bounded queue."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def top_k(counts: DataFrame, k: int, value: str = "cnt", key: str = "key") -> DataFrame:
    """The k rows with the largest value, ties to the smaller key, with ``rank``. Spark keeps k rows a task, so nothing is sorted whole."""
    best = counts.orderBy(F.col(value).desc(), F.col(key)).limit(k)
    ranked = best.select(F.sort_array(F.collect_list(F.struct((-F.col(value)).alias("v"), F.col(key).alias("k")))).alias("a"))
    out = ranked.select(F.posexplode("a").alias("i", "e"))
    return out.select((F.col("i") + 1).alias("rank"), F.col("e.k").alias(key), (-F.col("e.v")).alias(value))


def approximate_top_k(df: DataFrame, key: str, k: int, tracked: int = 10_000) -> DataFrame:
    """Spark's ``approx_top_k``: (key, cnt) of about the k most frequent."""
    found = df.select(F.expr(f"approx_top_k(`{key}`, {k}, {tracked})").alias("a"))
    return found.select(F.explode("a").alias("e")).select(F.col("e.item").alias(key), F.col("e.count").alias("cnt"))


class BoundedQueue:
    """At most k (count, key) in numbered slots, parents before children (slot i has the slots 2i and 2i + 1), filled and replaced as updates come.

    A known key takes its new estimate and moves up past ancestors with smaller counts. A new key takes a free slot and moves up alike. In a full queue it
    takes the first slot if it is strictly larger than the key there; if not, whatever its estimate, it takes the place of the smallest of the last
    k // 2 + 1 slots (the last one of equals; never the first slot of several), and stays there. So later keys push earlier ones out.
    """

    def __init__(self, k: int) -> None:
        self.k, self.slots = k, []
        self.at: dict[str, int] = {}

    def _put(self, slot: int, entry: tuple[int, str]) -> None:
        """Entry goes to the slot, or to its highest ancestor that is reached through smaller counts only; what is passed moves down the path."""
        path = [slot]
        while path[-1] > 1 and self.slots[path[-1] // 2 - 1][0] < entry[0]:
            path.append(path[-1] // 2)
        moved = [self.slots[p - 1] for p in path[1:]] + [entry]
        for p, e in zip(path, moved, strict=True):
            self.slots[p - 1] = e
            self.at[e[1]] = p

    def update(self, key: str, estimate: int) -> None:
        if self.k == 0:
            return
        if key in self.at:
            self._put(self.at[key], (estimate, key))
        elif len(self.slots) < self.k:
            self.slots.append((estimate, key))
            self._put(len(self.slots), (estimate, key))
        else:
            tail = range(max(self.k - self.k // 2, min(self.k, 2)), self.k + 1)
            slot = 1 if estimate > self.slots[0][0] else min(tail, key=lambda i: (self.slots[i - 1][0], -i))
            del self.at[self.slots[slot - 1][1]]
            self.slots[slot - 1] = (estimate, key)
            self.at[key] = slot


def sequential_heavy_hitters(df: DataFrame, key: Column, order: Column, k: int, depth: int, width: int) -> DataFrame:
    """(slot, key, cnt) of the bounded queue after all updates in ``order``. Order-dependent, so one task handles the whole stream: for parity only."""
    from cellwise.plans.reference_hash import bucket_of

    rows = df.select(key.cast("string").alias("key"), order.alias("seq")).where("key IS NOT NULL")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        queue, counters = BoundedQueue(k), {}
        for name in pdf.sort_values("seq", kind="stable")["key"]:
            cells = [(r, bucket_of(name, r, width)) for r in range(depth)]
            for c in cells:
                counters[c] = counters.get(c, 0) + 1
            queue.update(name, min(counters[c] for c in cells))
        return pd.DataFrame([(i, n, c) for i, (c, n) in enumerate(queue.slots, 1)], columns=["slot", "key", "cnt"])

    return rows.groupBy().applyInPandas(run, "slot int, key string, cnt bigint")
