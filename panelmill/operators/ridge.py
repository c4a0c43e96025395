"""Ridge regressions: one design shared by all cells, and one small model per cell on what it leaves."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Cells that one task fits together, with all their months.
BLOCK = 256
#: Least deviation by which targets are divided.
FLOOR = 1e-3


def design(x: np.ndarray, train: np.ndarray, ridge: float, winsorize: float | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Standardised rows of x with a leading 1, and the matrix that takes training targets to coefficients.

    Columns are standardised on the training rows (no deviation counts as 1); winsorize clips them to that many deviations.
    The intercept is not penalised.
    """
    mu, sd = x[train].mean(0), x[train].std(0)
    z = (x - mu) / np.where(sd > 0, sd, 1.0)
    if winsorize is not None:
        z = np.clip(z, -winsorize, winsorize)
    z = np.concatenate([np.ones((len(z), 1)), z], 1)
    penalty = np.diag([0.0] + [ridge] * x.shape[1])
    return z, np.linalg.solve(z[train].T @ z[train] + penalty, z[train].T)


def lag_of(ym, seed: int = 0, most: int = 24):
    """A training month's lag, 1 to most, the same for each cell: a fixed arithmetic hash in place of a random draw."""
    return (ym * 7919 + seed) % most + 1


@dataclass(frozen=True)
class Months:
    """What a fit knows of time: months in a row, their shared features (has: months that have any), and years by fold and role."""

    ym: np.ndarray
    x: np.ndarray
    has: np.ndarray
    folds: dict[int, dict[str, list[int]]]
    #: The first month that observations may come from.
    first: int
    #: Months with a value anywhere on the grid.
    present: np.ndarray

    def seen_in(self, present: np.ndarray) -> Months:
        return replace(self, present=present)

    def without_empty(self) -> Months:
        """Months without any value count as having no features."""
        return replace(self, has=self.has & self.present)

    def years(self, fold: int, role: str) -> np.ndarray:
        return np.isin(self.ym // 12, self.folds[fold].get(role, []))

    def of(self, fold: int, role: str) -> np.ndarray:
        """Months of those years that have features."""
        return self.has & self.years(fold, role)


def months_of(features: DataFrame, folds: DataFrame, columns: Sequence[str], first: int, last: int) -> Months:
    """Months first to last. features: ym and columns, a row per month, missing ones count as 0. Month tables and folds are small enough for the driver."""
    table = features.select("ym", *columns).toPandas()
    by_fold: dict[int, dict[str, list[int]]] = {}
    for fold, year, role in folds.select("fold", "year", "role").collect():
        by_fold.setdefault(int(fold), {}).setdefault(role, []).append(int(year))
    ym = np.arange(min(first, table["ym"].min()) if len(table) else first, max(last, table["ym"].max()) + 1 if len(table) else last + 1)
    x, has = np.zeros((len(ym), len(columns))), np.zeros(len(ym), bool)
    at = table["ym"].to_numpy(int) - ym[0]
    x[at], has[at] = np.nan_to_num(table[list(columns)].to_numpy(float)), True
    return Months(ym, x, has, dict(sorted(by_fold.items())), first, np.ones(len(ym), bool))


def _climatology(y: np.ndarray, month: np.ndarray, train: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean and population deviation (FLOOR at least) by calendar month of training rows, at every row; nan without any."""
    mean, sd = np.full_like(y, np.nan), np.full_like(y, np.nan)
    for m in range(12):
        own = y[train & (month == m)]
        n = np.isfinite(own).sum(0)
        some = np.where(n > 0, n, np.nan)
        mu = np.nansum(own, 0) / some
        mean[month == m], sd[month == m] = mu, np.maximum(np.sqrt(np.nansum((own - mu) ** 2, 0) / some), FLOOR)
    return mean, sd


def _stage1(y: np.ndarray, t: Months, fold: int, ridge: float, winsorize: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """clim, sigma and z_hat of all months. Missing targets count as 0."""
    train = t.of(fold, "train")
    clim, sigma = _climatology(y, t.ym % 12, t.years(fold, "train"))
    z, solve = design(t.x, train, ridge, winsorize)
    return clim, sigma, z @ (solve @ np.nan_to_num((y[train] - clim[train]) / sigma[train]))


def _matrix(part: pa.Table, t: Months, columns: Sequence[str]) -> tuple[np.ndarray, list[np.ndarray]]:
    """Cells of a block, and its columns as months x cells; nan where there is no row."""
    cells, place = np.unique(part.column("cell").to_numpy(), return_inverse=True)
    at, out = part.column("ym").to_numpy() - t.ym[0], []
    for c in columns:
        own = np.full((len(t.ym), len(cells)), np.nan)
        own[at, place] = part.column(c).to_numpy().astype(float)
        out.append(own)
    return cells, out


def _table(rows: list[dict[str, np.ndarray]], schema: dict[str, pa.DataType]) -> pa.Table:
    """Rows as arrays that broadcast against each other; nan is null."""
    cols: dict[str, list[np.ndarray]] = {c: [] for c in schema}
    for row in rows:
        for c, v in zip(row, np.broadcast_arrays(*row.values()), strict=True):
            cols[c].append(v.ravel())
    return pa.table([pa.array(np.concatenate(v) if v else [], t, from_pandas=True) for v, t in zip(cols.values(), schema.values(), strict=True)], list(schema))


def _blocks(rows: DataFrame):
    return rows.withColumn("block", F.floor(F.col("cell") / BLOCK).cast("int")).groupBy("block")


_STAGE1 = {"ridge": pa.float64(), "fold": pa.int32(), "ym": pa.int32(), "cell": pa.int32(), "value": pa.float64(), "clim": pa.float64(), "sigma": pa.float64(), "z_hat": pa.float64()}


def shared_ridge(panel: DataFrame, features: DataFrame, folds: DataFrame, ridges: Sequence[float], columns: Sequence[str], span: tuple[int, int], winsorize: float | None = None, roles: Sequence[str] = ("test",)) -> DataFrame:
    """ridge, fold, ym, cell, value, clim, sigma, z_hat for every cell and the months of each fold's tested years (or of the given roles).

    panel: ym, cell, value within span. features: ym and columns; months without a row neither train nor are predicted.
    The design is the same for every cell, so only months reach the driver. Cells meet their months once, in blocks of
    BLOCK; each block solves every fold as one product, with the fold's own climatology, whatever the number of folds.
    A month and cell without training values has null clim, sigma and a z_hat.
    """
    t = months_of(features, folds, columns, *span)

    def work(part: pa.Table) -> pa.Table:
        cells, (y,) = _matrix(part, t, ["value"])
        rows = []
        for fold in t.folds:
            ask = np.flatnonzero(np.logical_or.reduce([t.of(fold, r) for r in roles]))
            if not len(ask) or not t.of(fold, "train").any():
                continue
            for ridge in ridges:
                clim, sigma, z = _stage1(y, t, fold, ridge, winsorize)
                values = (np.float64(ridge), fold, t.ym[ask][:, None], cells[None, :], y[ask], clim[ask], sigma[ask], z[ask])
                rows.append(dict(zip(_STAGE1, values, strict=True)))
        return _table(rows, _STAGE1)

    return _blocks(panel.select("ym", "cell", "value")).applyInArrow(work, "ridge double, fold int, ym int, cell int, value double, clim double, sigma double, z_hat double")


def with_last_observation(rows: DataFrame, observed: DataFrame, lag, value: str = "value") -> DataFrame:
    """rows (ym of the target) with last: the value `lag` months before the target, missing where there is none."""
    own = observed.select("cell", (F.col("ym")).alias("__at"), F.col(value).alias("last"))
    return rows.withColumn("lag", lag.cast("int")).withColumn("__at", F.col("ym") - F.col("lag")).join(own, ["cell", "__at"], "left").drop("__at")


def anchored(rows: DataFrame, gap: int) -> DataFrame:
    """rows with the lag to December `gap` years before their own year, the last month observed."""
    return rows.withColumn("gap", F.lit(gap)).withColumn("lag", F.col("month") + 12 * (gap - 1))


def cell_moments(rows: DataFrame, columns: Sequence[str], target: str = "r") -> DataFrame:
    """cell, n, gram, b, sx, r: sums of products, summed where the rows are (map-side) before cells meet."""
    k = len(columns)
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    sums = [F.sum(F.col(columns[i]) * F.col(columns[j])).alias(f"g{i}_{j}") for i, j in pairs] + [F.sum(F.col(c) * F.col(target)).alias(f"b{i}") for i, c in enumerate(columns)]
    agg = rows.groupBy("fold", "cell").agg(F.count("*").alias("n"), *sums, *[F.sum(c).alias(f"s{i}") for i, c in enumerate(columns)], F.sum(target).alias("r"))
    gram = F.array(*[F.col(f"g{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    return agg.select("fold", "cell", "n", gram.alias("gram"), F.array(*[f"b{i}" for i in range(k)]).alias("b"), F.array(*[f"s{i}" for i in range(k)]).alias("sx"), "r")


def column_stats(moments: DataFrame) -> DataFrame:
    """fold, k, mu, sd: mean and population deviation of each column over all months and cells, from cell_moments(). No deviation counts as 1."""
    k = F.size("sx")
    each = moments.select("fold", "n", F.posexplode(F.transform("sx", lambda s, i: F.struct(s.alias("s"), F.col("gram")[i * k + i].alias("q")))).alias("k", "c"))
    mu, square = F.sum("c.s") / F.sum("n"), F.sum("c.q") / F.sum("n")
    sd = F.sqrt(F.greatest(square - mu * mu, F.lit(0.0)))
    return each.groupBy("fold", "k").agg(mu.alias("mu"), F.when(sd > 0, sd).otherwise(1.0).alias("sd"))


def solve_cells(moments: DataFrame, ridge: float, standardise: bool = False) -> DataFrame:
    """fold, cell, w (coefficients, then the intercept). One batched solve for each Arrow batch of cells.

    The intercept is not penalised: moments are centred first. standardise penalises columns at unit deviation over
    all months and cells of the fold, from the same moments in closed form, and returns coefficients of the raw columns.
    """
    if standardise:
        stats = column_stats(moments).groupBy("fold").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "sd"))), lambda s: s["sd"]).alias("scale"))  # a number for each column
        moments = moments.join(F.broadcast(stats), "fold")  # a row for each fold
    else:
        moments = moments.withColumn("scale", F.transform("sx", lambda s: F.lit(1.0)))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            t = batch.to_pydict()
            n, r = np.array(t["n"], float), np.array(t["r"], float)
            b, sx, scale = np.array(t["b"], float), np.array(t["sx"], float), np.array(t["scale"], float)
            k = b.shape[1]
            g = np.array(t["gram"], float).reshape(-1, k, k)
            g, b = g - sx[:, :, None] * sx[:, None, :] / n[:, None, None], b - sx * (r / n)[:, None]
            a = g / scale[:, :, None] / scale[:, None, :] + ridge * np.eye(k)
            w = np.linalg.solve(a, (b / scale)[:, :, None])[:, :, 0] / scale
            w = np.concatenate([w, ((r - (w * sx).sum(1)) / n)[:, None]], 1)
            yield pa.RecordBatch.from_arrays([pa.array(t["fold"], pa.int32()), pa.array(t["cell"], pa.int32()), pa.array(list(w), pa.list_(pa.float64()))], ["fold", "cell", "w"])

    return moments.mapInArrow(work, "fold int, cell int, w array<double>")


def dot(columns: Sequence[str], w: str = "w"):
    """Prediction of a cell model: coefficients by columns, and the intercept."""
    terms = [F.col(c) * F.col(w)[i] for i, c in enumerate(columns)]
    return sum(terms, F.col(w)[len(columns)])


def pooled(weights: DataFrame, other: DataFrame, alpha: float, keys: Sequence[str] = ("fold", "cell", "k"), own: Sequence[int] = ()) -> DataFrame:
    """weights (keys, w) as alpha w + (1 - alpha) of another table's w: 1 leaves each cell its own, as do coefficients k in own, such as the intercept."""
    mixed = alpha * F.col("w") + (1 - alpha) * F.col("__o")
    kept = F.when(F.col("k").isin(*own), F.col("w")).otherwise(mixed) if own else mixed
    return weights.join(other.withColumnRenamed("w", "__o"), list(keys)).select(*keys, kept.alias("w"))


def region_weights(weights: DataFrame, inside: DataFrame) -> DataFrame:
    """fold, cell, k, w: for each cell the mean over its boxes of the boxes' mean coefficients, the overall mean if it is in none. inside: box, cell."""
    means = weights.join(inside, "cell").groupBy("fold", "k", "box").agg(F.avg("w").alias("m"))
    own = inside.join(F.broadcast(means), "box").groupBy("fold", "cell", "k").agg(F.avg("m").alias("m"))  # a row for each fold, coefficient and box
    every = weights.groupBy("fold", "k").agg(F.avg("w").alias("__all"))
    return weights.join(F.broadcast(every), ["fold", "k"]).join(own, ["fold", "cell", "k"], "left").select("fold", "cell", "k", F.coalesce("m", "__all").alias("w"))  # a row for each fold and coefficient


def recursion(cells: DataFrame, coefficient: str, start: str, months: str, anchored: int = 0) -> DataFrame:
    """cells with path: predictions in sequence. months: array of <base double, normal double> structs in order.

    Each month is clip0(base + coefficient * (state - normal)). The state of the first `anchored` months is the value at
    `start`, the last one observed; each later month's is the prediction before it. One expression per cell, so cells
    stay where they are. A missing state counts as normal.
    """
    def step(acc, m):
        state = F.when(F.size(acc) <= anchored, acc[0]).otherwise(F.element_at(acc, -1))
        return F.concat(acc, F.array(F.greatest(m["base"] + F.col(coefficient) * F.coalesce(state - m["normal"], F.lit(0.0)), F.lit(0.0))))

    path = F.aggregate(F.col(months), F.array(F.col(start).cast("double")), step)
    return cells.withColumn("path", F.slice(path, 2, F.size(months)))
