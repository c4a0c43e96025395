"""Scores: pooled RMSE, means of yearly RMSEs, scores by groups and over parameter grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def rmse(pred: Column, truth: Column) -> Column:
    """Pooled over the group; rows without a prediction or a truth don't count."""
    return F.sqrt(F.avg(F.pow(pred - truth, 2)))


def yearly_scores(preds: DataFrame, keys: Sequence[str] = (), year: str = "year") -> DataFrame:
    """keys, year, n, rmse and mean_rmse, the mean of the yearly scores (not a pooled one). preds: pred, truth."""
    scores = preds.groupBy(*keys, year).agg(F.count(F.col("pred") - F.col("truth")).alias("n"), rmse(F.col("pred"), F.col("truth")).alias("rmse"))
    return scores.withColumn("mean_rmse", F.avg("rmse").over(W.partitionBy(*keys)))


def best(scores: DataFrame, order: Sequence[str], score: str = "rmse", keys: Sequence[str] = ()) -> DataFrame:
    """The row with the smallest score for each key; of equal ones the first in the grid's order."""
    rank = F.row_number().over(W.partitionBy(*keys).orderBy(score, *order))
    return scores.withColumn("r", rank).where("r = 1").drop("r")


def grid_sums(rows: DataFrame, keys: Sequence[str], truth: Column, preds: Sequence[Column]) -> DataFrame:
    """keys, n and e, the sum of squared errors of each of preds, as an array: a whole parameter grid in one aggregate.

    Rows stay single however large the grid is, and partial sums combine before the shuffle. Rows without a truth don't
    count; all of preds must have a value where there is a truth.
    """
    sums = [F.sum(F.pow(p - truth, 2)) for p in preds]
    return rows.groupBy(*keys).agg(F.count(truth).alias("n"), F.array(*sums).alias("e"))


def grid_scores(sums: DataFrame, keys: Sequence[str], grid: Sequence[dict[str, float]]) -> DataFrame:
    """keys, the grid's parameters, rmse and best (of equal ones the first of the grid): grid_sums() added up over all keys but these.

    What comes out of grid_sums() has a row for each of its keys, however many predictions they stand for.
    """
    total = sums.groupBy(*keys).agg(F.sum("n").alias("n"), *[F.sum(F.col("e")[k]).alias(str(k)) for k in range(len(grid))])
    long = total.unpivot([*keys, "n"], [str(k) for k in range(len(grid))], "k", "e").withColumn("k", F.col("k").cast("int")).where("n > 0")
    names = [F.element_at(F.array(*[F.lit(float(g[p])) for g in grid]), F.col("k") + 1).alias(p) for p in grid[0]]
    scores = long.select(*keys, *names, "k", F.sqrt(F.col("e") / F.col("n")).alias("rmse")).withColumn("__r", F.round("rmse", 9))
    first = F.row_number().over(W.partitionBy(*keys).orderBy("__r", "k")) == 1
    return scores.withColumn("best", first).drop("__r", "k")
