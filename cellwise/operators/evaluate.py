"""Comparing predictions with truth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def confusion(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """One row of counts: true/false positives and negatives. A null on either side counts as negative."""
    p, a = F.coalesce(predicted, F.lit(False)), F.coalesce(actual, F.lit(False))
    count = lambda c: F.coalesce(F.sum(c.cast("bigint")), F.lit(0))
    return df.agg(
        F.count(F.lit(1)).alias("n"), count(p & a).alias("true_positive"), count(p & ~a).alias("false_positive"),
        count(~p & a).alias("false_negative"), count(~p & ~a).alias("true_negative"),
    )


def precision_recall(counts: DataFrame) -> DataFrame:
    """Adds precision, recall and accuracy (null where the denominator is 0)."""
    tp, fp, fn, tn = (F.col(c) for c in ("true_positive", "false_positive", "false_negative", "true_negative"))
    return counts.withColumns({"precision": F.try_divide(tp, tp + fp), "recall": F.try_divide(tp, tp + fn), "accuracy": F.try_divide(tp + tn, F.col("n"))})


def truth_join(predictions: DataFrame, truth: DataFrame, id_: str, predicted: str, actual: str) -> DataFrame:
    """(id, predicted, actual): predictions with the truth of the same id, however both are ordered. Predictions without a truth are left out; an id that the truth
    has several times takes its smallest one."""
    known = truth.where(F.col(actual).isNotNull()).groupBy(F.col(id_).alias("_id")).agg(F.min(actual).alias("actual"))
    return predictions.select(F.col(id_).alias("_own"), F.col(predicted).alias("predicted")).join(known, F.col("_own") == F.col("_id")).select(F.col("_own").alias(id_), "predicted", "actual")


def accuracy(df: DataFrame, predicted: Column, actual: Column) -> DataFrame:
    """Share of rows whose prediction is the label; rows with a null label do not count, a null prediction is wrong."""
    return df.where(actual.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(F.coalesce((predicted == actual).cast("double"), F.lit(0.0))).alias("accuracy"))


def majority_vote(votes: DataFrame, sample: str, label: str) -> DataFrame:
    """(sample, label, n_votes): the most frequent label, ties to the smallest."""
    counts = votes.groupBy(sample, label).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by(F.struct(F.col(label).alias("label"), F.col("n").alias("n")), F.struct("n", (-F.col(label)).alias("l")))
    return counts.where(F.col(label).isNotNull()).groupBy(sample).agg(best.alias("b")).select(sample, F.col("b.label").alias(label), F.col("b.n").alias("n_votes"))


def error_totals(df: DataFrame, params: list[str], estimate: Column, truth: Column) -> DataFrame:
    return df.groupBy(*params).agg(F.sum(estimate - truth).alias("total_error"))


def error_histogram(df: DataFrame, error: Column, low: float, high: float, bins: int = 50) -> DataFrame:
    """(bin, n) of fixed-width bins 1..bins over [low, high); values outside fall in bin 0 or bins+1."""
    return df.select(F.width_bucket(error.cast("double"), F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).where("bin IS NOT NULL").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))


def dataset_statistics(df: DataFrame, features: Column, label: Column | None = None) -> DataFrame:
    """One row: n_samples, n_features (the most), n_labels and the sorted distinct labels."""
    lab = F.lit(None).cast("int") if label is None else label
    labels = F.sort_array(F.collect_set(lab))
    return df.agg(F.count(F.lit(1)).alias("n_samples"), F.max(F.size(features)).alias("n_features"), F.size(labels).alias("n_labels"), labels.alias("labels"))
