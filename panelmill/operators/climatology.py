"""Climatologies by calendar month and cell, for one set of years or for all folds at once, and anomalies from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def climatology(rows: DataFrame, keys: tuple[str, ...] = ("month", "cell"), value: str = "value") -> DataFrame:
    """keys, n, clim (mean) and sigma (population deviation). Missing values are skipped."""
    return rows.groupBy(*keys).agg(F.count(value).alias("n"), F.avg(value).alias("clim"), F.stddev_pop(value).alias("sigma"))


def fold_climatology(rows: DataFrame, folds: DataFrame, value: str = "value") -> DataFrame:
    """fold, month, cell, n, clim, sigma over each fold's training years, from one pass over rows.

    Totals by month and cell, less what the fold's other years hold. Values are centred on the mean of all of them first,
    so the variance doesn't cancel and sums combine where the rows are, before they shuffle. A (month, cell) without training rows has n = 0 and null clim.
    """
    used = rows.join(F.broadcast(folds.select("year").distinct()), "year", "left_semi").where(F.col(value).isNotNull())
    centred = used.join(F.broadcast(used.agg(F.avg(value).alias("c")))).withColumn("d", F.col(value) - F.col("c"))  # one row
    by_year = centred.groupBy("month", "cell", "year").agg(F.first("c").alias("c"), F.count("*").alias("n"), F.sum("d").alias("s"), F.sum(F.pow("d", 2)).alias("q"))
    total = by_year.groupBy("month", "cell").agg(F.first("c").alias("c"), F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    out = by_year.join(F.broadcast(folds.where("role <> 'train'").select("fold", "year")), "year").groupBy("fold", "month", "cell").agg(F.sum("n").alias("n0"), F.sum("s").alias("s0"), F.sum("q").alias("q0"))
    every = total.join(F.broadcast(folds.select("fold").distinct()))  # each fold has each (month, cell)
    left = every.join(out, ["fold", "month", "cell"], "left").fillna(0, ["n0", "s0", "q0"])
    n = F.when(F.col("n") > F.col("n0"), F.col("n") - F.col("n0"))
    mean = (F.col("s") - F.col("s0")) / n
    left_over = (F.col("q") - F.col("q0")) / n - mean * mean
    spread = F.sqrt(F.when((n > 1) & (left_over > 1e-12 * F.col("q") / F.col("n")), left_over).otherwise(0.0))  # what subtraction leaves of 0 is 0
    return left.select("fold", "month", "cell", F.coalesce(n, F.lit(0)).alias("n"), (F.col("c") + mean).alias("clim"), F.when(n.isNotNull(), spread).alias("sigma"))


def trend_climatology(rows: DataFrame, keys: tuple[str, ...] = ("month", "cell"), value: str = "value") -> DataFrame:
    """keys, n, slope, intercept (at year 0) and sigma of what the line leaves. With one year the slope is 0."""
    ok = rows.where(F.col(value).isNotNull())
    mean, year = F.avg(value), F.avg("year")
    slope = F.coalesce(F.regr_slope(value, "year"), F.lit(0.0))
    left = F.regr_syy(value, "year") - F.coalesce(F.pow(F.regr_sxy(value, "year"), 2) / F.when(F.regr_sxx(value, "year") > 0, F.regr_sxx(value, "year")), F.lit(0.0))
    return ok.groupBy(*keys).agg(F.count("*").alias("n"), slope.alias("slope"), (mean - slope * year).alias("intercept"), F.sqrt(F.greatest(left, F.lit(0.0)) / F.count("*")).alias("sigma"))


def recent_years(folds: DataFrame, n: int) -> DataFrame:
    """fold, year: the last n training years of each fold."""
    rank = F.dense_rank().over(W.partitionBy("fold").orderBy(F.desc("year")))
    return folds.where("role = 'train'").withColumn("r", rank).where(F.col("r") <= n).select("fold", "year")


def loo_anomaly(rows: DataFrame, value: str = "value") -> DataFrame:
    """rows with anomaly: value less the mean of the other years' values of its month and cell; null where there are none."""
    w = W.partitionBy("month", "cell")
    s, n, x = F.sum(value).over(w), F.count(value).over(w), F.col(value)
    return rows.withColumn("anomaly", F.when(n > 1, x - (s - x) / (n - 1)))


def month_sums(rows: DataFrame, values: Sequence[str] = ("value",)) -> DataFrame:
    """month, cell, and sum_<value> and n_<value> for each value: a store that anomalies and climatologies are read from."""
    return rows.groupBy("month", "cell").agg(*[f(v).alias(f"{name}_{v}") for v in values for name, f in (("sum", F.sum), ("n", F.count))])


def loo_anomaly_scaled(rows: DataFrame, value: str = "value", sums: DataFrame | None = None) -> DataFrame:
    """loo_anomaly() from month_sums(), those of rows if none are given: (x n - sum) / (n - 1)."""
    own = (month_sums(rows, [value]) if sums is None else sums).select("month", "cell", F.col(f"sum_{value}").alias("__s"), F.col(f"n_{value}").alias("__n"))
    n = F.when(F.col("__n") > 1, F.col("__n"))
    return rows.join(own, ["month", "cell"]).withColumn("anomaly", (F.col(value) * n - F.col("__s")) / (n - 1)).drop("__s", "__n")


def stored_climatology(sums: DataFrame, value: str = "value") -> DataFrame:
    """month, cell, clim from month_sums(); null where it counts none."""
    return sums.select("month", "cell", (F.col(f"sum_{value}") / F.when(F.col(f"n_{value}") > 0, F.col(f"n_{value}"))).alias("clim"))


def clip0(x: Column) -> Column:
    """max(x, 0) that leaves null as it is."""
    return F.when(x.isNotNull(), F.greatest(x, F.lit(0.0)))


def zscore(x: Column, clim: Column, sigma: Column) -> Column:
    return (x - clim) / F.when(sigma > 0, sigma)
