"""Ensembles of forecasts and indices from whole fields."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.operators.spatial import box_means
from panelmill.panel import standardised, with_calendar

#: Cells whose Gram matrix one task sums, and sums of those that reach the driver.
BLOCK, SUMS = 256, 16


def ensemble_mean(members: DataFrame, value: str = "value") -> DataFrame:
    """ym, cell, value: the mean of the models' means over their members, so that models count alike."""
    models = members.groupBy("model", "ym", "cell").agg(F.avg(value).alias(value))
    return models.groupBy("ym", "cell").agg(F.avg(value).alias(value))


def debiased(fields: DataFrame, last: int, excluded: Sequence[int] = (), value: str = "value") -> DataFrame:
    """fields with anomaly: value less the mean of its calendar month and cell over years up to last that aren't excluded."""
    base = F.when((F.col("year") <= last) & ~F.col("year").isin(*excluded) if excluded else F.col("year") <= last, F.col(value))
    return with_calendar(fields).withColumn("anomaly", F.col(value) - F.avg(base).over(W.partitionBy("month", "cell")))


def anomaly_fields(fields: DataFrame, folds: DataFrame, last: int, value: str = "value") -> DataFrame:
    """fold, ym, cell, anomaly: debias of every fold by its own training years up to last."""
    rows = with_calendar(fields)
    train = F.broadcast(folds.where(f"role = 'train' and year <= {int(last)}").select("fold", "year"))
    means = rows.join(train, "year").groupBy("fold", "month", "cell").agg(F.avg(value).alias("mean"))
    return rows.join(means, ["month", "cell"]).select("fold", "ym", "cell", (F.col(value) - F.col("mean")).alias("anomaly"))


def rate_to_daily(rate: Column) -> Column:
    """Metres a second as millimetres a day."""
    return rate * 86400 * 1000


def start_field(anomalies: DataFrame, ym: int, cells: DataFrame) -> DataFrame:
    """cell, anomaly of one start month on all cells, missing ones 0; no rows if no cell has that start."""
    own = anomalies.where(F.col("ym") == ym).select("cell", "anomaly")
    there = own.limit(1).select(F.lit(1).alias("__there"))
    return cells.select("cell").distinct().join(F.broadcast(there)).join(own, "cell", "left").select("cell", F.coalesce("anomaly", F.lit(0.0)).alias("anomaly"))  # one row


def regional_anomalies(anomalies: DataFrame, cells: DataFrame, areas: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """keys, ym, box, mean: weighted box means of anomaly fields, missing ones 0."""
    means = box_means(anomalies.withColumn("__key", F.struct(*keys, "ym")).drop("ym").withColumnRenamed("__key", "ym"), cells, areas, "anomaly")
    return means.select(*[F.col("ym")[k].alias(k) for k in (*keys, "ym")], "box", F.coalesce("mean", F.lit(0.0)).alias("mean"))


def zonal_difference(rows: DataFrame, south: tuple[float, float], north: tuple[float, float], value: str = "value") -> DataFrame:
    """ym, index: standardised month anomalies of the southern band's plain mean less those of the northern one."""
    band = lambda b: F.avg(F.when(F.col("lat").between(*b), F.col(value)))
    months = with_calendar(rows.groupBy("ym").agg(band(south).alias("s"), band(north).alias("n")))
    one, two = (standardised(months.select("ym", "month", c), c).select("ym", F.col("z").alias(c)) for c in ("s", "n"))
    return one.join(two, "ym").select("ym", (F.col("s") - F.col("n")).alias("index"))


def principal_component(rows: DataFrame, driver: DataFrame, last: int, value: str = "value", basin: Column | None = None) -> DataFrame:
    """ym, pc: the leading component of anomalies less each month's mean, weighted by the root of the latitude's cosine.

    The mean is that of all rows (lat, lon and others); basin keeps a part of them for the component. Fitted on years up to last; later months are projected on the same loadings. The sign agrees with the driver's, and
    the scale is the fitted months' deviation. Only the months' Gram matrix, a number for each pair of months (a thousand
    months in eighty years), comes to the driver, added up from blocks of cells; fields stay with the executors.
    """
    fitted = F.when(F.col("year") <= last, F.col(value))
    an = rows.withColumn("an", F.col(value) - F.avg(fitted).over(W.partitionBy("month", "cell"))).where("an is not null")
    w = F.cos(F.radians("lat"))
    mean = (F.sum(F.col("an") * w) / F.sum(w)).alias("mean")
    means = an.groupBy("ym").agg(mean)
    an = (an if basin is None else an.where(basin)).join(means, "ym").select("ym", "year", "cell", ((F.col("an") - F.col("mean")) * F.sqrt(w)).alias("f"))
    months = np.array(sorted(r.ym for r in an.select("ym").distinct().collect()), int)  # a row for each month
    if not len(months):
        return driver.sparkSession.createDataFrame([], "ym int, pc double")

    def partial(part: pa.Table) -> pa.Table:
        """The Gram matrix of one block's cells."""
        at, cells = np.searchsorted(months, part.column("ym").to_numpy()), np.unique(part.column("cell").to_numpy(), return_inverse=True)
        f = np.zeros((len(months), len(cells[0])))
        f[at, cells[1]] = part.column("f").to_numpy()
        return pa.table([pa.array([int(part.column("block")[0].as_py()) % SUMS]), pa.array([(f @ f.T).tobytes()], pa.binary())], ["part", "g"])

    def added(part: pa.Table) -> pa.Table:
        return pa.table([pa.array([sum(np.frombuffer(g, float) for g in part.column("g").to_pylist()).tobytes()], pa.binary())], ["g"])

    blocks = an.select(F.floor(F.col("cell") / BLOCK).cast("bigint").alias("block"), "ym", "cell", "f").groupBy("block").applyInArrow(partial, "part bigint, g binary")
    sums = blocks.groupBy("part").applyInArrow(added, "g binary").collect()  # SUMS rows at most
    g = sum(np.frombuffer(r.g, float) for r in sums).reshape(len(months), len(months))
    fit = months // 12 <= last
    values, vectors = np.linalg.eigh(g[np.ix_(fit, fit)])
    pc = g[:, fit] @ vectors[:, -1] / np.sqrt(max(values[-1], 1e-300))
    x = dict(driver.select("ym", "x").where("x is not null").collect())  # a row for each month
    both = [(p, x[m]) for p, m, f in zip(pc, months.tolist(), fit, strict=True) if f and m in x]
    if len(both) > 1 and np.corrcoef(np.array(both).T)[0, 1] < 0:
        pc = -pc
    pc = (pc - pc[fit].mean()) / (pc[fit].std() or 1.0)
    return driver.sparkSession.createDataFrame([(int(m), float(p)) for m, p in zip(months, pc, strict=True)], "ym int, pc double")
