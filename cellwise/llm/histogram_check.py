"""Which stored histograms disagree with the values they claim to describe."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.llm import digests as D
from cellwise.session import stage

QS = (0.25, 0.5, 0.75, 0.9)


def _cuts(qs: Sequence[float], groups: Sequence[str]):
    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, points = [], []
            for i, bins in enumerate(pdf["_bins"]):
                pairs = [(b["x"], b["y"] or 0) for b in (bins if bins is not None else []) if b is not None and b["x"] is not None]
                if not pairs:
                    continue
                pairs.sort()
                upto = np.cumsum([y for _, y in pairs])
                if upto[-1] > 0:
                    for q in qs:
                        at.append(i)
                        points.append((q, pairs[int(np.argmax(upto >= q * upto[-1]))][0]))
            yield pdf[["_id", *groups]].iloc[at].reset_index(drop=True).assign(q=[p[0] for p in points], cut=[float(p[1]) for p in points])

    return cut


def wrong_histograms(
    histograms: DataFrame, hist_id: Column, bins: Column, values: DataFrame, sample: Column, value: Column, groups: Mapping[str, str], tolerance: float = 0.10, qs: Sequence[float] = QS
) -> DataFrame:
    """Ids of histograms with a quantile whose rank among the finite values of the same group is off by more than ``tolerance``.

    ``groups`` maps output names to column names that both tables have. Each sample counts once a group. Null or empty bins, bins without a
    count, and histograms of groups without values are no case. Digests decide all quantiles that their hard rank bounds settle; the rest is
    counted exactly. Repeated rows and bins out of order do no harm.
    """
    names = list(groups)
    own = {n: F.col(c) for n, c in groups.items()}
    finite = values.select(*[c.alias(n) for n, c in own.items()], sample.alias("_sample"), value.cast("double").alias("_v")).where(F.col("_v").isNotNull() & (F.abs("_v") < F.lit(float("inf"))))
    once = finite.groupBy(*names, "_sample").agg(F.first("_v").alias("_v"))
    key = {n: F.col(n) for n in names}
    sketch = D.digest(once, F.col("_v"), key)

    stored = histograms.select(hist_id.alias("_id"), *[c.alias(n) for n, c in own.items()], bins.alias("_bins"))
    kinds = {f.name: f.dataType.simpleString() for f in stored.schema}
    cuts = stored.mapInPandas(_cuts(qs, names), ", ".join([f"`{n}` {kinds[n]}" for n in ("_id", *names)] + ["q double", "cut double"]))
    bounds = stage(D.rank_bounds(sketch, names, cuts, "cut", ["_id", "q"]), "rank-bounds")
    q, n, t = F.col("q"), F.col("n"), F.lit(tolerance)
    sure = (F.col("below_min") / n > q + t) | (F.col("upto_max") / n < q - t)
    possible = (F.col("below_max") / n > q + t) | (F.col("upto_min") / n < q - t)
    open_ = bounds.where(possible & ~sure).select("_id", "q", *names, "cut")
    counted = D.count_ranks(once, F.col("_v"), key, open_, "cut")
    off = (F.col("n_below") / F.col("n_all") > q + t) | (F.col("n_at_or_below") / F.col("n_all") < q - t)
    return bounds.where(sure).select("_id").unionByName(counted.where(off).select("_id")).distinct()
