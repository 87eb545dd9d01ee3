"""Regression on weighted cells by gradient descent.

The linear gradient needs only five moments, so the data are read once and the steps run on the driver; the logistic gradient is one small aggregate
an iteration. Cells are (y, x.., cnt) with an intercept put in front of x.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellwise.functions.scalar import sigmoid


@dataclass
class Trace:
    """The model after every step, the start included."""

    steps: list[list[float]]

    def frame(self, spark) -> DataFrame:
        n = len(self.steps[0])
        rows = [(i, *s) for i, s in enumerate(self.steps)]
        return spark.createDataFrame(rows, "step int, " + ", ".join(f"theta{d} double" for d in range(n)))

    @property
    def model(self) -> list[float]:
        return self.steps[-1]


@dataclass(frozen=True)
class Model:
    """A fitted model: parameters with the intercept first. ``predict`` is a column expression, so it runs wherever rows are; ``gradient`` is one aggregate."""

    theta: Sequence[float]

    def linear_part(self, xs: Sequence[Column]) -> Column:
        out = F.lit(float(self.theta[0]))
        for x, t in zip(xs, self.theta[1:], strict=True):
            out = out + x.cast("double") * F.lit(float(t))
        return out

    def predict(self, xs: Sequence[Column]) -> Column:
        raise NotImplementedError

    def gradient(self, cells: DataFrame, y: Column, xs: Sequence[Column], weight: Column) -> DataFrame:
        """One row: g_d = sum((y - prediction) x_d w) / sum w. Both models below share this form."""
        cols = [F.lit(1.0), *[x.cast("double") for x in xs]]
        off = (y.cast("double") - self.predict(xs)) * weight
        return cells.agg(*[(F.sum(off * c) / F.sum(weight.cast("double"))).alias(f"g{d}") for d, c in enumerate(cols)])


class LinearModel(Model):
    def predict(self, xs: Sequence[Column]) -> Column:
        return self.linear_part(xs)


class LogisticModel(Model):
    def predict(self, xs: Sequence[Column]) -> Column:
        """The probability of 1."""
        return sigmoid(self.linear_part(xs))


#: A learning function: (cells, y, xs, weight) to the models of all steps.
LearningFunction = Callable[[DataFrame, Column, Sequence[Column], Column], Trace]


def descend(kind: type[Model], cells: DataFrame, y: Column, xs: Sequence[Column], weight: Column, start: Sequence[float] | None = None, rate: float = 0.5, steps: int = 10) -> Trace:
    """theta <- theta + rate * gradient of any model. ``cells`` should be small or staged: it is read once a step. Stops where there is no weight."""
    theta = [1.0] * (len(xs) + 1) if start is None else list(start)
    out = [list(theta)]
    for _ in range(steps):
        g = kind(theta).gradient(cells, y, xs, weight).first()
        if any(v is None or math.isnan(v) for v in g):
            break
        theta = [t + rate * v for t, v in zip(theta, g, strict=True)]
        out.append(list(theta))
    return Trace(out)


def moments(cells: DataFrame, y: Column, xs: Sequence[Column], weight: Column) -> DataFrame:
    """One row: n = sum w, and the weighted sums s_jk of x_j x_k (x_0 = 1) and t_j of x_j y. Rows with a null in any of them are left out."""
    aggs, names = moment_columns(y, xs, weight)
    return cells.select(*names).dropna().agg(*aggs)


def moment_columns(y: Column, xs: Sequence[Column], weight: Column) -> tuple[list[Column], list[Column]]:
    """The aggregates of ``moments``, and the columns they are taken over."""
    cols = [F.lit(1.0), *[x.cast("double") for x in xs]]
    names = [y.cast("double").alias("_y"), weight.cast("double").alias("_w"), *[c.alias(f"_x{i}") for i, c in enumerate(cols)]]
    n = len(cols)
    aggs = [F.sum(F.col("_w")).alias("n")]
    aggs += [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}") * F.col("_w")).alias(f"s_{i}_{j}") for i in range(n) for j in range(i, n)]
    aggs += [F.sum(F.col(f"_x{i}") * F.col("_y") * F.col("_w")).alias(f"t_{i}") for i in range(n)]
    return aggs, names


def descend_linear(m: dict[str, float], start: Sequence[float], rate: float, steps: int) -> Trace:
    """theta <- theta - rate * mean((x theta - y) x), from the moments. Without weight the model stays as it is."""
    theta, k = list(start), len(start)
    out = [list(theta)]
    for _ in range(steps):
        if m["n"]:
            slope = [(sum(m[f"s_{min(d, j)}_{max(d, j)}"] * theta[j] for j in range(k)) - m[f"t_{d}"]) / m["n"] for d in range(k)]
            theta = [t - rate * g for t, g in zip(theta, slope, strict=True)]
        out.append(list(theta))
    return Trace(out)


def linear(cells: DataFrame, y: Column, xs: Sequence[Column], weight: Column, start: Sequence[float] | None = None, rate: float = 0.5, steps: int = 10) -> Trace:
    start = [1.0] * (len(xs) + 1) if start is None else start
    row = moments(cells, y, xs, weight).first().asDict()
    return descend_linear({k: v or 0.0 for k, v in row.items()}, start, rate, steps)


def logistic(cells: DataFrame, y: Column, xs: Sequence[Column], weight: Column, start: Sequence[float] | None = None, rate: float = 0.5, steps: int = 10) -> Trace:
    return descend(LogisticModel, cells, y, xs, weight, start, rate, steps)


def logistic_newton(cells: DataFrame, y: Column, xs: Sequence[Column], weight: Column, steps: int = 8) -> Trace:
    """Maximum likelihood of the logistic model by Newton steps from 0, as a binomial GLM is fitted: gradient and Hessian are one aggregate a step.

    Stops where there is no weight or the Hessian cannot be inverted.
    """
    cols = [F.lit(1.0), *[x.cast("double") for x in xs]]
    n = len(cols)
    theta = [0.0] * n
    out = [list(theta)]
    for _ in range(steps):
        p = LogisticModel(theta).predict(xs)
        off, spread_ = (y.cast("double") - p) * weight, p * (1 - p) * weight
        row = cells.agg(*[F.sum(off * c).alias(f"g{d}") for d, c in enumerate(cols)], *[F.sum(spread_ * cols[i] * cols[j]).alias(f"h{i}_{j}") for i in range(n) for j in range(i, n)]).first()
        if any(v is None or math.isnan(v) for v in row):
            break
        hessian = np.array([[row[f"h{min(i, j)}_{max(i, j)}"] for j in range(n)] for i in range(n)])
        try:
            theta = (np.array(theta) + np.linalg.solve(hessian, np.array([row[f"g{d}"] for d in range(n)]))).tolist()
        except np.linalg.LinAlgError:
            break
        out.append(list(theta))
    return Trace(out)


def closed_form(df: DataFrame, y: Column, x: Column) -> DataFrame:
    """Least squares of one predictor: slope, intercept, r2, n."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"), F.regr_count(y, x).alias("n"))


def product_columns(y: Column, xs: Sequence[Column]) -> dict[str, Column]:
    """The products whose distributions a product sketch keeps: y x_j and x_j x_k (x_0 = 1)."""
    cols = [F.lit(1.0), *xs]
    out = {f"t_{i}": c * y for i, c in enumerate(cols)}
    out |= {f"s_{i}_{j}": cols[i] * cols[j] for i in range(len(cols)) for j in range(i, len(cols))}
    return out


def linear_by_worker(
    cells: DataFrame, worker: Column, y: Column, xs: Sequence[Column], weight: Column, start: Sequence[float] | None = None, rate: float = 0.5, steps: int = 10, most: int = 10_000
) -> tuple[dict, list[float]]:
    """Every worker learns on its own cells; the models by worker, and the mean of the models. The cells are read once for all workers (a null worker is one).

    More than ``most`` workers are an error: their moments come to the driver. Without cells the mean is the start.
    """
    start = [1.0] * (len(xs) + 1) if start is None else list(start)
    aggs, names = moment_columns(y, xs, weight)
    rows = cells.select(worker.alias("_worker"), *names).dropna(subset=[c for c in ("_y", "_w", *[f"_x{i}" for i in range(len(xs) + 1)])]).groupBy("_worker").agg(*aggs).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} workers")
    models = {r["_worker"]: descend_linear({k: v or 0.0 for k, v in r.asDict().items() if k != "_worker"}, start, rate, steps).model for r in rows}
    return models, [sum(m[d] for m in models.values()) / len(models) for d in range(len(start))] if models else start
