"""Month-level features: lags, guarded rolling means, seasonal interactions, and the shared table of all of them."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.operators.climatology import month_sums
from panelmill.operators.spatial import neighbourhood
from panelmill.panel import on_grid, with_calendar


def keep_first(months: DataFrame, rank: str, key: str = "ym") -> DataFrame:
    """One row for each key: the one of the smallest rank."""
    return months.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(rank))).where("__r = 1").drop("__r")


def every_month(months: DataFrame) -> DataFrame:
    """months with a row for each month from the first to the last, so that rows before are months before."""
    span = months.agg(F.min("ym").alias("a"), F.max("ym").alias("b")).where("a is not null")
    return span.select(F.explode(F.sequence("a", "b")).alias("ym")).join(months, "ym", "left")


def lags(months: DataFrame, columns: Sequence[str], steps: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """months with <column>_lag<k>. Month tables have a row per month, a thousand for eighty years, so one window holds them."""
    w = W.partitionBy(F.lit(0)).orderBy("ym")
    return months.select("*", *[F.lag(c, k).over(w).alias(f"{c}_lag{k}") for c in columns for k in steps])


def rolling(months: DataFrame, columns: Sequence[str], size: int = 3) -> DataFrame:
    """months with <column>_mean<size> over this and the months before; null unless all of them have a value."""
    w = W.partitionBy(F.lit(0)).orderBy("ym").rowsBetween(1 - size, 0)
    return months.select("*", *[F.when(F.count(c).over(w) == size, F.avg(c).over(w)).alias(f"{c}_mean{size}") for c in columns])


def in_season(value: Column, months: Sequence[int], shift: int = 0) -> Column:
    """value if the month (shift=0) or the month `shift` later is in the season, else 0. Predicting a month ahead, shift=1 keys on the target month."""
    return F.when(((F.col("ym") + shift) % 12 + 1).isin(*months), value).otherwise(F.lit(0.0))


def shared_table(indices: DataFrame, regions: DataFrame, seasons: dict[str, tuple[str, Sequence[int]]], lagged: Sequence[str], shift: int = 1) -> DataFrame:
    """Month features: indices full-outer-joined with regions, calendar columns, lags, rolling means and interactions."""
    t = every_month(indices.join(regions, "ym", "full"))
    angle = 2 * F.lit(3.141592653589793) * (F.col("ym") % 12 + 1) / 12
    t = rolling(lags(t.withColumns({"month_sin": F.sin(angle), "month_cos": F.cos(angle)}), lagged), lagged)
    return t.select("*", *[in_season(F.col(c), months, shift).alias(name) for name, (c, months) in seasons.items()])


def local_features(rows: DataFrame, names: Sequence[str], width: int, span: tuple[int, int], history: int) -> DataFrame:
    """ym (the target month), cell, and <name>_a, <name>_n: anomaly in the month before and its 5 x 5 mean.

    rows: ym, cell and names. Anomalies are from the mean of the other years up to history; of targets after it, for
    which no year is left out, from the mean of all these years. Missing anomalies count as 0. span: first and last origin month.
    """
    sums = month_sums(with_calendar(rows.select("ym", "cell", *names)).where(F.col("year") <= history), names)
    months = rows.select("cell").distinct().select("cell", F.explode(F.sequence(F.lit(span[0]), F.lit(span[1]))).alias("ym"))
    dense = with_calendar(months.join(rows.select("ym", "cell", *names), ["ym", "cell"], "left")).join(sums, ["month", "cell"], "left")

    def anomaly(v: str) -> Column:
        x, s, n = F.col(v), F.col(f"sum_{v}"), F.col(f"n_{v}")
        inside = F.when(n > 1, (x * n - s) / F.when(n > 1, n - 1))
        return F.coalesce(F.when((F.col("ym") + 1) / 12 >= history + 1, x - s / F.when(n > 0, n)).otherwise(inside), F.lit(0.0)).alias(f"{v}_a")

    grid = on_grid(dense.select("ym", "cell", *[anomaly(v) for v in names]), width)
    near = neighbourhood(grid, ["ym"], [f"{v}_a" for v in names])
    return near.select((F.col("ym") + 1).alias("ym"), "cell", *[c for v in names for c in (F.col(f"{v}_a"), F.col(f"{v}_a_mean").alias(f"{v}_n"))])


def freeze(df: DataFrame, dropped: Callable[[str], bool]) -> DataFrame:
    """df without the columns whose name dropped() selects."""
    return df.drop(*[c for c in df.columns if dropped(c)])
