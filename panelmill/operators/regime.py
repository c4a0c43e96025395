"""Regimes of a driver index: phases, composites by phase, and the offset that they give a prediction."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def phase(x: Column, warm: float | Column = 0.5, cold: float | Column = -0.5) -> Column:
    """1 from warm on, -1 up to cold, else 0; missing values, NaN too, are neutral."""
    return F.when(x.isNull() | F.isnan(x), 0).when(x >= warm, 1).when(x <= cold, -1).otherwise(0)


def origin_phases(driver: DataFrame, thresholds: Sequence[float]) -> DataFrame:
    """thr, ym, phase: the phase of the month before ym (the origin month) under each threshold, warm from thr and cold up to -thr."""
    thr = F.explode(F.array(*map(F.lit, thresholds)))
    return driver.select((F.col("ym") + 1).alias("ym"), "x", thr.alias("thr")).select("thr", "ym", phase(F.col("x"), F.col("thr"), -F.col("thr")).alias("phase"))


def composites(rows: DataFrame, phases: DataFrame, folds: DataFrame, keys: Sequence[str] = (), value: str = "value") -> DataFrame:
    """keys, fold, phase, month, cell, comp, n: means of training values by the phase of their month; neutral months have none.

    rows: ym and year of the target month. phases: keys, ym, phase; one pass serves all keys, such as thresholds.
    """
    train = folds.where("role = 'train'").select("fold", "year")
    joined = rows.join(F.broadcast(phases.where("phase <> 0")), "ym").join(F.broadcast(train), "year")
    return joined.groupBy(*keys, "fold", "phase", "month", "cell").agg(F.avg(value).alias("comp"), F.count(value).alias("n"))


def phase_composites(rows: DataFrame, driver: DataFrame, folds: DataFrame, warm: float = 0.5, cold: float = -0.5, value: str = "value") -> DataFrame:
    """composites() by the phase of the month before (the origin month). driver: ym, x; it may start earlier or later, months are matched by name."""
    return composites(rows, driver.select((F.col("ym") + 1).alias("ym"), phase(F.col("x"), warm, cold).alias("phase")), folds, value=value)


def offset(comp: Column, clim: Column, beta: float | Column) -> Column:
    """beta (comp - clim); 0 without a composite, so also in neutral months."""
    return F.coalesce(F.lit(beta) * (comp - clim) if isinstance(beta, float | int) else beta * (comp - clim), F.lit(0.0))
