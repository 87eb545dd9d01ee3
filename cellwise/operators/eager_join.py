"""Aggregates over a join whose keys are skewed, without making the joined rows.

Both inputs are aggregated by join key first (partial aggregation on the map side turns a hot key into one row a task), the compact states are
joined, and the aggregates of the join follow by algebra: with n1, n2 rows and sums s1, s2 of a key, the join has n1*n2 rows, its sum of a left
column is s1*n2, of a right column n1*s2, of a product of both s1*s2; minima and maxima carry over. A last aggregation rolls up to the wanted groups.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.session import stage


def eager_join_aggregate(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[tuple[Column, Column]],
    *,
    group_left: Mapping[str, Column] | None = None,
    group_right: Mapping[str, Column] | None = None,
    sum_left: Mapping[str, Column] | None = None,
    sum_right: Mapping[str, Column] | None = None,
    sum_product: Mapping[str, tuple[Column, Column]] | None = None,
    min_left: Mapping[str, Column] | None = None,
    max_left: Mapping[str, Column] | None = None,
    count: str = "n_rows",
    weight_left: Column | None = None,
) -> DataFrame:
    """``SELECT groups, COUNT(*), SUM(..) FROM left JOIN right ON .. GROUP BY groups`` with both sides aggregated before the join.

    ``on`` pairs a left with a right expression. Groups may use columns of either side. Every expression is evaluated on its own side and
    renamed, so clashing or extra columns do no harm. ``weight_left`` is the number of rows that a left row stands for (left sums are then sums of those rows). Null keys match nothing; null values are left out of sums as in SQL; null groups form
    one group. Empty inputs give an empty result (with no groups: no row). Counts beyond 63 bits raise an error instead of wrapping.
    """
    group_left, group_right = dict(group_left or {}), dict(group_right or {})
    sum_left, sum_right, sum_product = dict(sum_left or {}), dict(sum_right or {}), dict(sum_product or {})
    min_left, max_left = dict(min_left or {}), dict(max_left or {})
    keys = [f"_k{i}" for i in range(len(on))]

    def side(df: DataFrame, which: int, groups: Mapping[str, Column], sums: Mapping[str, Column], product: Mapping, extra: list[Column]) -> DataFrame:
        tag = "lr"[which]
        own = {f"_g{tag}{i}": c for i, c in enumerate(groups.values())}
        cols = [pair[which].alias(k) for pair, k in zip(on, keys, strict=True)] + [c.alias(n) for n, c in own.items()]
        cols += [c.alias(f"_s{tag}{i}") for i, c in enumerate(sums.values())] + [c[which].alias(f"_p{tag}{i}") for i, c in enumerate(product.values())] + extra
        cols += [weight_left.cast("bigint").alias("_w")] if which == 0 and weight_left is not None else []
        weighted = which == 0 and weight_left is not None
        aggs = [(F.sum("_w") if weighted else F.count(F.lit(1))).alias(f"_n{tag}")]
        aggs += [F.sum(f"_s{tag}{i}").alias(f"_s{tag}{i}") for i in range(len(sums))] + [F.sum(f"_p{tag}{i}").alias(f"_p{tag}{i}") for i in range(len(product))]
        if which == 0:
            aggs += [F.min(f"_mi{i}").alias(f"_mi{i}") for i in range(len(min_left))] + [F.max(f"_ma{i}").alias(f"_ma{i}") for i in range(len(max_left))]
        known = df.select(*cols).where(" AND ".join(f"{k} IS NOT NULL" for k in keys))
        return known.groupBy(*keys, *own).agg(*aggs)

    lows = [c.alias(f"_mi{i}") for i, c in enumerate(min_left.values())] + [c.alias(f"_ma{i}") for i, c in enumerate(max_left.values())]
    a = side(left, 0, group_left, sum_left, sum_product, lows)
    b = side(right, 1, group_right, sum_right, sum_product, [])
    joined = a.join(b, keys)
    groups = [F.col(f"_gl{i}").alias(n) for i, n in enumerate(group_left)] + [F.col(f"_gr{i}").alias(n) for i, n in enumerate(group_right)]
    out = [F.sum(F.col("_nl") * F.col("_nr")).alias(count)]
    out += [F.sum(F.col(f"_sl{i}") * F.col("_nr")).alias(n) for i, n in enumerate(sum_left)]
    out += [F.sum(F.col("_nl") * F.col(f"_sr{i}")).alias(n) for i, n in enumerate(sum_right)]
    out += [F.sum(F.col(f"_pl{i}") * F.col(f"_pr{i}")).alias(n) for i, n in enumerate(sum_product)]
    out += [F.min(f"_mi{i}").alias(n) for i, n in enumerate(min_left)] + [F.max(f"_ma{i}").alias(n) for i, n in enumerate(max_left)]
    if groups:
        return joined.groupBy(*groups).agg(*out)
    return joined.agg(*out).where(F.col(count).isNotNull())


def form_states(rows: DataFrame, form: Column, value: Column, meaning) -> DataFrame:
    """One row a written form of a key: ``form``, ``key`` (``meaning`` of it, a struct), ``n_rows``, ``total``. Forms that are no key are left out. One pass over the rows,
    and a form is parsed once and not once a row."""
    states = rows.select(form.alias("form"), value.cast("bigint").alias("v")).where("form IS NOT NULL").groupBy("form").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("v").alias("total"))
    return states.select("form", meaning(F.col("form")).alias("key"), "n_rows", "total").where("key IS NOT NULL")


def key_totals(rows: DataFrame, form: Column, value: Column, meaning) -> DataFrame:
    """Row and value totals per key, where a key is written in several forms and a few keys hold most rows.

    The rows are aggregated by form in one pass to compact states. The states are one input, the dictionary of written forms with their meaning (read off the
    states, one row a form) is the other; they are joined on the form, counts are multiplied, and the join is rolled up to keys. ``meaning`` maps the form
    column to a struct (null: not a key). Returns the struct's fields, ``n_rows`` and ``total``. Null values are left out of totals, null forms are no keys.
    """
    states = stage(form_states(rows, form, value, meaning), "form-states")
    forms = states.select("form", "key")
    fields = forms.schema["key"].dataType.fieldNames()
    on = [(F.col("form"), F.col("form"))]
    return eager_join_aggregate(
        states, forms, on, group_right={n: F.col(f"key.{n}") for n in fields}, sum_left={"total": F.col("total")}, count="n_rows", weight_left=F.col("n_rows")
    )


def dominant(totals: DataFrame, share: float, rows: str = "n_rows") -> DataFrame:
    """The keys whose rows are at least ``share`` of all rows in ``totals`` (the grand total is a scalar subquery)."""
    whole = totals.agg(F.sum(rows).cast("double").alias("_all")).scalar()
    return totals.where(F.col(rows) >= F.lit(share) * whole)
