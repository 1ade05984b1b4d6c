"""Classification metrics from (truth, predicted) rows and score vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def join_by_id(pred: DataFrame, truth: DataFrame, key: str, label: str, ordinal: str, exclude: tuple[str, ...] = ()) -> DataFrame:
    """Predictions whose id the truth knows; of several truths of an id the last wins, excluded labels don't count."""
    last = truth.where(~F.col(label).isin(*exclude)) if exclude else truth
    return pred.join(last.groupBy(key).agg(F.max_by(label, ordinal).alias("truth")), key)


def confusion(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    return rows.groupBy(F.col(truth).alias("truth"), F.col(predicted).alias("predicted")).agg(F.count("*").alias("n"))


def per_class(counts: DataFrame) -> DataFrame:
    """(label, support, predicted, hits, precision, recall, f1) of every label in truth or prediction, from a confusion table."""
    t = counts.groupBy(F.col("truth").alias("label")).agg(F.sum("n").alias("support"), F.sum(F.when(F.col("truth") == F.col("predicted"), F.col("n")).otherwise(0)).alias("hits"))
    p = counts.groupBy(F.col("predicted").alias("label")).agg(F.sum("n").alias("predicted"))
    both = t.join(p, "label", "full").select("label", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("support", "predicted", "hits")])
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    hits, support, predicted = F.col("hits"), F.col("support"), F.col("predicted")
    return both.select("*", ratio(hits, predicted).alias("precision"), ratio(hits, support).alias("recall"), ratio(2 * hits, support + predicted).alias("f1"))


def summary(classes: DataFrame) -> DataFrame:
    """accuracy, balanced_accuracy (over labels that occur), macro precision, recall and f1 in one row."""
    return classes.agg(
        F.try_divide(F.sum("hits").cast("double"), F.sum("support")).alias("accuracy"), F.avg(F.when(F.col("support") > 0, F.col("recall"))).alias("balanced_accuracy"),
        F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"),
    )


def by_frequency(classes: DataFrame) -> DataFrame:
    """Classes with ``place``, most frequent first, and accuracy in percent; classes are few."""
    place = F.row_number().over(Window.orderBy(F.desc("support"), "label"))
    return classes.select("label", "support", (F.col("hits") * 100.0 / F.greatest("support", F.lit(1))).alias("accuracy"), place.cast("long").alias("place"))


def argmax(scores: Column) -> Column:
    """The first place of the greatest score, from 0."""
    return F.array_position(scores, F.array_max(scores)) - 1


def softmax(scores: Column) -> Column:
    shifted = F.transform(scores, lambda x: F.exp(x - F.array_max(scores)))
    return F.transform(shifted, lambda x: x / F.aggregate(shifted, F.lit(0.0), lambda a, y: a + y))


def in_top(scores: Column, label: Column, k: int) -> Column:
    """Whether fewer than ``k`` scores, ties at higher places included, stand above the label's."""
    own = F.get(scores, label)
    above = F.filter(scores, lambda x, i: (x > own) | ((x == own) & (i > label)))
    return F.size(above) < k


def best_epoch(logs: DataFrame, epoch: str, score: str, loss: str, *keys: str) -> DataFrame:
    """The first epoch with the greatest score over 0, else that with the least loss."""
    best = F.max_by(epoch, F.struct(score, -F.col(epoch)))
    return logs.groupBy(*keys).agg(F.when(F.max(score) > 0, best).otherwise(F.min_by(epoch, F.struct(loss, epoch))).alias("best"))


def weighted_mean(rows: DataFrame, value: str, weight: str, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.try_divide(F.sum(F.col(value) * F.col(weight)), F.sum(weight)).alias("mean"))


def negative_log_likelihood(probability: Column, least: float = 1e-12) -> Column:
    """Negative log likelihood of the true class's probability."""
    return -F.log(F.greatest(probability, F.lit(least)))
