"""Two-stage models, fitted, pooled and applied in separate steps: a ridge that all cells share, then one per cell on what it leaves.

Cells meet their months in blocks of BLOCK. A block keeps its cells' moments by year in a ledger: sums of products of
the features of a year's training months. They don't depend on the fold, so they are made once, and a fold's are the
total less its other years. What does depend on the fold (residuals, and forecasts that are debiased by the fold's own
years) adds one row of moments for each fold. Coefficients come out as a table, fold, cell and an array, that can be
pooled over neighbours and boxes before it meets the months again to predict.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelmill.operators.ridge import BLOCK, Months, _climatology, _matrix, _stage1, _table, lag_of
from panelmill.operators.spatial import in_bounds

#: What a cell's last observation adds to its features: its anomaly, its age in months, and their product.
OBSERVED = ("last", "lag", "product")
#: A sum of squares of which subtraction leaves less than this share is added up anew.
LEFT = 1e-8
#: Side of the square of cells that one task smooths, and cells that one row of a stored ledger holds.
TILE, PART = 32, 32


@dataclass(frozen=True)
class Model:
    """What a model consists of.

    ridges: penalties of both stages. local: columns of the panel, by target month. observed: what the last observation
    adds. dynamic: a column with raw forecasts by target month, used as anomalies from the means over the fold's training
    years, as far as starts up to the year hindcast go; missing starts count as 0. history: last year of the means that
    observations are anomalies from. winsorize: bound of the shared features, in deviations. standardise: the second
    penalty counts columns at unit deviation over all training months and cells of the fold. skip_empty: months without
    any value on the whole grid don't train the first stage either, where they otherwise count as mean months.
    """

    ridges: tuple[float, float]
    local: tuple[str, ...] = ()
    observed: tuple[str, ...] = OBSERVED
    dynamic: str | None = None
    hindcast: int | None = None
    history: int | None = None
    winsorize: float | None = None
    standardise: bool = False
    skip_empty: bool = False

    @property
    def columns(self) -> list[str]:
        """The columns of the second stage, in the order of the coefficients; the intercept comes after them."""
        return [*self.local, *self.observed, *([self.dynamic] if self.dynamic else [])]


def with_presence(panel: DataFrame, t: Months) -> Months:
    """t with what a block can't know: which months have a value anywhere. One number for each month comes to the driver."""
    some = [r.ym for r in panel.where(F.col("value").isNotNull()).select("ym").distinct().collect()]
    return t.seen_in(np.isin(t.ym, some))


class Block:
    """The months of one block's cells."""

    def __init__(self, part: pa.Table, t: Months, model: Model):
        names = ["value", *model.local, *([model.dynamic] if model.dynamic else [])]
        self.cells, (self.y, *rest) = _matrix(part, t, names)
        self.t, self.model = t, model
        self.local = np.stack([np.nan_to_num(c) for c in rest[: len(model.local)]], 2) if model.local else np.zeros((*self.y.shape, 0))
        self.raw = rest[-1] if model.dynamic else None
        self.normal, _ = _climatology(self.y, t.ym % 12, t.ym // 12 <= (model.history if model.history is not None else 10**6))

    def base(self, fold: int) -> tuple[np.ndarray, np.ndarray]:
        """Climatology and the first stage's prediction, not clipped, of all months."""
        t = self.t.without_empty() if self.model.skip_empty else self.t
        clim, sigma, z = _stage1(self.y, t, fold, self.model.ridges[0], self.model.winsorize)
        return clim, clim + sigma * z

    def forecast(self, fold: int) -> np.ndarray:
        """Forecasts as anomalies from the fold's means by calendar month of the start, the month before the target."""
        start, out = self.t.ym - 1, np.zeros_like(self.raw)
        own = np.isin(start // 12, self.t.folds[fold].get("train", []))
        if self.model.hindcast is not None:
            own &= start // 12 <= self.model.hindcast
        for m in range(12):
            at = start % 12 == m
            base = self.raw[at & own]
            n = np.isfinite(base).sum(0)
            out[at] = self.raw[at] - np.nansum(base, 0) / np.where(n > 0, n, np.nan)
        return np.nan_to_num(out)

    def features(self, at: np.ndarray, lag: np.ndarray, last: np.ndarray | None = None) -> np.ndarray:
        """All but the forecasts, as months x cells x columns, of target months `at`; last is the anomaly `lag` months before unless it is given."""
        if last is None:
            last = np.nan_to_num(self.y[at - lag] - self.normal[at - lag])
        every = {"last": last, "lag": np.broadcast_to(lag[:, None].astype(float), last.shape), "product": lag[:, None] * last}
        return np.concatenate([self.local[at], *[every[k][:, :, None] for k in self.model.observed]], 2)

    def ledger(self) -> Ledger:
        t = self.t
        age = lag_of(t.ym)
        fit = np.flatnonzero(t.has & t.present & (t.ym - age >= t.first))
        x = self.features(fit, age[fit])
        shift = x.mean(0) if len(fit) else np.zeros(x.shape[1:])
        x = x - shift  # an intercept takes up any shift, and sums of squares don't cancel
        year = t.ym[fit] // 12
        years = np.unique(year)
        own = [x[year == y].transpose(1, 2, 0) for y in years]
        gram = np.array([a @ a.transpose(0, 2, 1) for a in own]).reshape(len(years), *x.shape[1:], x.shape[2])
        folds, b, r, d = [], [], [], []
        for fold in t.folds:
            train = np.isin(year, t.folds[fold].get("train", []))
            if not train.any():
                continue
            rows, xt = fit[train], x[train]
            left = np.nan_to_num(self.y[rows] - self.base(fold)[1][rows])
            folds.append(fold)
            b.append(np.einsum("nck,nc->ck", xt, left))
            r.append(left.sum(0))
            if self.raw is not None:
                f = self.forecast(fold)[rows]
                d.append(np.concatenate([np.einsum("nck,nc->ck", xt, f), (f * f).sum(0)[:, None], f.sum(0)[:, None], (f * left).sum(0)[:, None]], 1))
        shape = len(folds), len(self.cells)
        return Ledger(
            self.cells, shift, years, np.array([(year == y).sum() for y in years], int), gram, np.array([a.sum(2) for a in own]).reshape(gram.shape[:3]),
            folds, np.array(b).reshape(*shape, x.shape[2]), np.array(r).reshape(shape), np.array(d).reshape(*shape, -1) if d else None,
        )


@dataclass
class Ledger:
    """Moments of a block's cells: by year those of the features less shift, by fold those with residuals and forecasts."""

    cells: np.ndarray
    shift: np.ndarray  # cells, columns
    years: np.ndarray
    n: np.ndarray  # training months of each year
    gram: np.ndarray  # years, cells, columns, columns
    sums: np.ndarray  # years, cells, columns
    folds: list[int]
    b: np.ndarray  # folds, cells, columns
    r: np.ndarray  # folds, cells
    d: np.ndarray | None  # folds, cells, columns + 3: a forecast's products with the columns, itself, 1 and the residual

    def fold(self, i: int, t: Months) -> tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """n, gram, sums, b, r and shift of the i-th fold, with the forecast as the last column."""
        train = np.isin(self.years, t.folds[self.folds[i]].get("train", []))
        if (~train).sum() < train.sum():
            if not hasattr(self, "_total"):
                self._total = self.gram.sum(0), self.sums.sum(0)
            gram, sums = self._total[0] - self.gram[~train].sum(0), self._total[1] - self.sums[~train].sum(0)
            thin = (np.einsum("ckk->ck", gram) < LEFT * np.einsum("ckk->ck", self._total[0])).any(1)
            gram[thin], sums[thin] = self.gram[train][:, thin].sum(0), self.sums[train][:, thin].sum(0)
        else:
            gram, sums = self.gram[train].sum(0), self.sums[train].sum(0)
        b, shift = self.b[i], self.shift
        if self.d is not None:
            own, k = self.d[i], gram.shape[1]
            gram = np.concatenate([np.concatenate([gram, own[:, :k, None]], 2), own[:, None, : k + 1]], 1)
            sums, b, shift = (np.concatenate([a, c[:, None]], 1) for a, c in ((sums, own[:, k + 1]), (b, own[:, k + 2]), (shift, np.zeros(len(shift)))))
        return int(self.n[train].sum()), gram, sums, b, self.r[i], shift

    def weights(self, i: int, t: Months, ridge: float, scale: np.ndarray | None = None) -> np.ndarray:
        """Coefficients of the i-th fold and then the intercept, which is not penalised, for each cell; scale: deviations at which the penalty counts columns."""
        n, gram, sums, b, r, shift = self.fold(i, t)
        penalty = np.diag(ridge * (np.ones(gram.shape[1]) if scale is None else scale**2))
        a, c = gram - sums[:, :, None] * sums[:, None, :] / n + penalty, b - sums * (r / n)[:, None]
        w = np.linalg.solve(a, c[:, :, None])[:, :, 0]
        return np.concatenate([w, ((r - (w * sums).sum(1)) / n - (w * shift).sum(1))[:, None]], 1)

    def parts(self) -> Iterator[Ledger]:
        """The same for PART cells at a time, so that a stored row stays small."""
        for k in range(0, len(self.cells), PART):
            at = slice(k, k + PART)
            yield Ledger(self.cells[at], self.shift[at], self.years, self.n, self.gram[:, at], self.sums[:, at], self.folds, self.b[:, at], self.r[:, at], None if self.d is None else self.d[:, at])

    def columns(self, i: int, t: Months) -> tuple[int, np.ndarray, np.ndarray]:
        """Months times cells of the i-th fold, and each column's sum and sum of squares over them."""
        n, gram, sums, _, _, shift = self.fold(i, t)
        square = np.einsum("ckk->ck", gram) + 2 * shift * sums + n * shift**2
        return n * len(self.cells), (sums + n * shift).sum(0), square.sum(0)


_LEDGER = "cells binary, shift binary, years binary, n binary, gram binary, sums binary, folds array<int>, b binary, r binary, d binary"
_WHOLE = ("cells", "years", "n")


def _stored(led: Ledger) -> pa.Table:
    k = led.shift.shape[1]
    upper = np.triu_indices(k)
    own = {f: getattr(led, f) for f in ("cells", "shift", "years", "n", "sums", "b", "r")} | {"gram": led.gram[:, :, upper[0], upper[1]]}
    row = {f: np.ascontiguousarray(v, np.int64 if f in _WHOLE else float).tobytes() for f, v in own.items()} | {"folds": led.folds, "d": None if led.d is None else led.d.tobytes()}
    names = [c.split()[0] for c in _LEDGER.split(", ")]
    return pa.table([pa.array([row[f]], pa.list_(pa.int32()) if f == "folds" else pa.binary()) for f in names], names)


def _ledger_of(row: dict) -> Ledger:
    a = {f: np.frombuffer(v, np.int64 if f in _WHOLE else float) for f, v in row.items() if f != "folds" and v is not None}
    c, y, f = len(a["cells"]), len(a["years"]), len(row["folds"])
    shift = a["shift"].reshape(c, -1)
    k = shift.shape[1]
    upper, gram = np.triu_indices(k), np.zeros((y, c, k, k))
    gram[:, :, upper[0], upper[1]] = a["gram"].reshape(y, c, -1)
    gram[:, :, upper[1], upper[0]] = a["gram"].reshape(y, c, -1)
    return Ledger(a["cells"], shift, a["years"], a["n"], gram, a["sums"].reshape(y, c, k), row["folds"], a["b"].reshape(f, c, k), a["r"].reshape(f, c), a["d"].reshape(f, c, k + 3) if "d" in a else None)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def blocks(panel: DataFrame, t: Months, model: Model) -> DataFrame:
    """The columns and months of panel that a model needs, with block, ranges of BLOCK cells, which a panel may hold as a column already."""
    names = ["ym", "cell", "value", *model.local, *([model.dynamic] if model.dynamic else [])]
    block = F.col("block") if "block" in panel.columns else F.floor(F.col("cell") / BLOCK).cast("int").alias("block")
    return panel.where(F.col("ym").between(int(t.ym[0]), int(t.ym[-1]))).select(block, *names)


def ledger(panel: DataFrame, t: Months, model: Model) -> DataFrame:
    """A row for every PART cells of each block, to be written once: any penalty, scale and set of folds is solved from it without the panel."""
    return blocks(panel, t, model).groupBy("block").applyInArrow(lambda part: pa.concat_tables(_stored(led) for led in Block(part, t, model).ledger().parts()), _LEDGER)


def scales(ledgers: DataFrame, t: Months) -> dict[int, np.ndarray]:
    """Deviation of each column over all training months and cells of a fold (none counts as 1), from the blocks' additive sums. A number for each fold and column comes to the driver."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            led = _ledger_of(row)
            for i, fold in enumerate(led.folds):
                n, s, q = led.columns(i, t)
                cols = [pa.array([fold] * len(s), pa.int32()), pa.array(range(len(s)), pa.int32()), pa.array([n] * len(s), pa.int64()), pa.array(s), pa.array(q)]
                yield pa.RecordBatch.from_arrays(cols, ["fold", "k", "n", "s", "q"])

    sums = ledgers.mapInArrow(work, "fold int, k int, n bigint, s double, q double").groupBy("fold", "k").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    out: dict[int, dict[int, float]] = {}
    for fold, k, n, s, q in sums.collect():
        sd = max(q / n - (s / n) ** 2, 0.0) ** 0.5
        out.setdefault(fold, {})[k] = sd if sd > 1e-12 * (q / n) ** 0.5 else 1.0
    return {fold: np.array([own[k] for k in sorted(own)]) for fold, own in out.items()}


def coefficients(ledgers: DataFrame, t: Months, model: Model) -> DataFrame:
    """fold, cell, w: coefficients of model.columns, then the intercept."""
    scale = scales(ledgers, t) if model.standardise else {}

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            led = _ledger_of(row)
            for i, fold in enumerate(led.folds):
                w = led.weights(i, t, model.ridges[1], scale.get(fold))
                yield pa.RecordBatch.from_arrays([pa.array([fold] * len(w), pa.int32()), pa.array(led.cells.astype(np.int32)), pa.array(list(w), pa.list_(pa.float64()))], ["fold", "cell", "w"])

    return ledgers.mapInArrow(work, "fold int, cell int, w array<double>")


def smoothed(weights: DataFrame, shape: tuple[int, int], size: int = 5) -> DataFrame:
    """fold, cell, w, near: with each cell's coefficients their means over the size x size cells around it, the edge repeated outwards.

    Squares of TILE cells get the cells around their border sent along, so one shuffle serves all coefficients and folds.
    A cell that is missing makes those around it missing. shape: rows and columns of the grid; cells are numbered by rows.
    """
    (rows, cols), r = shape, size // 2
    tiles = lambda at, n: F.explode(F.sequence(F.floor(F.greatest(at - r, F.lit(0)) / TILE).cast("int"), F.floor(F.least(at + r, F.lit(n - 1)) / TILE).cast("int")))
    sent = weights.withColumn("ty", tiles(F.floor(F.col("cell") / cols), rows)).withColumn("tx", tiles(F.col("cell") % cols, cols))

    def work(part: pa.Table) -> pa.Table:
        fold, ty, tx = (part.column(c)[0].as_py() for c in ("fold", "ty", "tx"))
        cell, w = part.column("cell").to_numpy(), np.array(part.column("w").to_pylist(), float)
        y, x, top, left = cell // cols, cell % cols, max(ty * TILE - r, 0), max(tx * TILE - r, 0)
        grid = np.full((TILE + 2 * r, TILE + 2 * r, w.shape[1]), np.nan)
        grid[y - top, x - left] = w
        at = np.flatnonzero((y // TILE == ty) & (x // TILE == tx))
        near = np.zeros((len(at), w.shape[1]))
        for i in range(-r, r + 1):
            for j in range(-r, r + 1):
                near += grid[np.clip(y[at] + i, 0, rows - 1) - top, np.clip(x[at] + j, 0, cols - 1) - left]
        many = pa.list_(pa.float64())
        return pa.table([pa.array([fold] * len(at), pa.int32()), pa.array(cell[at], pa.int32()), pa.array(list(w[at]), many), pa.array(list(near / size**2), many)], ["fold", "cell", "w", "near"])

    return sent.groupBy("fold", "ty", "tx").applyInArrow(work, "fold int, cell int, w array<double>, near array<double>")


def pooled(weights: DataFrame, n: int, shape: tuple[int, int], alpha: float | None = None, regional: float | None = None, boxes: Sequence[tuple] = (), lat: Column | None = None, lon: Column | None = None, intercept: bool = True, size: int = 5) -> DataFrame:
    """fold, cell, w: weights (n coefficients, then the intercept) shrunk to what is around them.

    alpha keeps that share of a cell's own and takes the rest from its neighbourhood's mean. regional then keeps that
    share and takes the rest from the means of the boxes (name, west, east, south, north) that the cell is in, by its own
    coefficients before smoothing: the mean of their means, or of all cells if it is in none. lat and lon are columns of
    cell. Without intercept the intercept stays as it is. Means by fold and box are sums of one aggregate, a row a fold.
    """
    out = smoothed(weights, shape, size) if alpha is not None and alpha < 1 else weights.withColumn("near", F.col("w"))
    keep, places = 1.0 if alpha is None else alpha, range(n + 1)
    mixed = [keep * F.col("w")[k] + (1 - keep) * F.col("near")[k] for k in places]
    if regional is not None:
        inside = [in_bounds(lat, lon, *b[1:]) for b in boxes]
        mean = lambda where: F.array(*[F.avg(F.when(where, F.col("w")[k])) for k in places])
        means = weights.groupBy("fold").agg(mean(F.lit(True)).alias("__all"), *[mean(i).alias(f"__box{j}") for j, i in enumerate(inside)])
        out = out.join(F.broadcast(means), "fold")  # a row for each fold
        count = sum((i.cast("int") for i in inside), F.lit(0))
        own = [sum((F.when(i, F.col(f"__box{j}")[k]).otherwise(0.0) for j, i in enumerate(inside)), F.lit(0.0)) for k in places]
        mixed = [regional * m + (1 - regional) * F.when(count > 0, F.try_divide(o, count)).otherwise(F.col("__all")[k]) for k, (m, o) in enumerate(zip(mixed, own, strict=True))]
    if not intercept:
        mixed[n] = F.col("w")[n]
    return out.select("fold", "cell", F.array(*mixed).alias("w"))


_PREDS = {"fold": pa.int32(), "gap": pa.int32(), "ym": pa.int32(), "cell": pa.int32(), "lag": pa.int32(), "value": pa.float64(), "clim": pa.float64(), "base": pa.float64(), "corr": pa.float64()}
_PREDS_DDL = "fold int, gap int, ym int, cell int, lag int, value double, clim double, base double, corr double"


def _dot(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    return (x * w[None, :, :-1]).sum(2) + w[None, :, -1]


def _predicted(own: Block, fold: int, w: np.ndarray, gaps: Sequence[int]) -> list[dict]:
    """Rows of the tested months of a fold: base, and corr by the cells' coefficients w."""
    t, rows = own.t, []
    test = np.flatnonzero(t.of(fold, "test"))
    clim, base = own.base(fold)
    forecast = own.forecast(fold) if own.raw is not None else None
    for gap in gaps:
        lag = t.ym[test] % 12 + 1 + 12 * (gap - 1)
        ok = t.ym[test] - lag >= t.first
        at, age = test[ok], lag[ok]
        x = own.features(at, age)
        if forecast is not None:
            x = np.concatenate([x, forecast[at][:, :, None]], 2)
        rows.append(dict(zip(_PREDS, (fold, gap, t.ym[at][:, None], own.cells[None, :], age[:, None], own.y[at], clim[at], base[at], _dot(x, w)), strict=True)))
    return rows


def two_stage(panel: DataFrame, t: Months, model: Model, gaps: Sequence[int] = (1, 2)) -> DataFrame:
    """fold, gap, ym, cell, lag, value, clim, base, corr for the tested months: the table that scores and sweeps start from.

    base is the shared ridge's prediction (not clipped), corr that of a ridge per cell on what the shared one leaves of the
    training months. A test's last observation is the December `gap` years before, that of a training month lag_of()
    before it. Missing features and residuals count as 0; training months whose observation lies before t.first are left
    out, and so are tests of that kind and months without any value on the grid (with_presence()). panel may have rows of
    target months without value. Fit and prediction are one pass over the blocks; a model that standardises over all
    blocks has none such: write ledger(), then coefficients() and predict().
    """
    if model.standardise:
        raise ValueError("deviations over all cells need ledger(), coefficients() and predict()")

    def work(part: pa.Table) -> pa.Table:
        own, rows = Block(part, t, model), []
        led = own.ledger()
        for i, fold in enumerate(led.folds):
            rows += _predicted(own, fold, led.weights(i, t, model.ridges[1]), gaps)
        return _table(rows, _PREDS)

    return blocks(panel, t, model).groupBy("block").applyInArrow(work, _PREDS_DDL)


def _with_weights(panel: DataFrame, weights: DataFrame, t: Months, model: Model, work, schema: str) -> DataFrame:
    """work(block, fold, w) over the folds of every block that have coefficients; both sides meet by block."""
    given = weights.withColumn("block", F.floor(F.col("cell") / BLOCK).cast("int"))

    def both(part: pa.Table, told: pa.Table) -> pa.Table:
        own, rows = Block(part, t, model), []
        for fold in sorted(set(told.column("fold").to_pylist())):
            mine = told.filter(pc.equal(told.column("fold"), fold))
            w = np.full((len(own.cells), len(model.columns) + 1), np.nan)
            w[np.searchsorted(own.cells, mine.column("cell").to_numpy())] = np.array(mine.column("w").to_pylist(), float)
            rows += work(own, fold, w)
        return _table(rows, {c.split()[0]: {"int": pa.int32(), "double": pa.float64()}[c.split()[1]] for c in schema.split(", ")})

    return blocks(panel, t, model).groupBy("block").cogroup(given.select("block", "fold", "cell", "w").groupBy("block")).applyInArrow(both, schema)


def predict(panel: DataFrame, weights: DataFrame, t: Months, model: Model, gaps: Sequence[int] = (1, 2)) -> DataFrame:
    """two_stage()'s table by coefficients that were made before, pooled or not. Cells without coefficients have no corr."""
    return _with_weights(panel, weights, t, model, lambda own, fold, w: _predicted(own, fold, w, gaps), _PREDS_DDL)


_CHAIN = {"fold": pa.int32(), "ym": pa.int32(), "cell": pa.int32(), "position": pa.int32(), "value": pa.float64(), "pred": pa.float64()}


def recursive(panel: DataFrame, weights: DataFrame, t: Months, model: Model) -> DataFrame:
    """fold, ym, cell, position, value, pred: 24 months in sequence from the December two years before each tested year.

    Months 1 to 12 take that December as their last observation, 1 to 12 months old. Each later month takes the
    prediction of the month before it, clipped at 0, as an observation one month old; all other features, those of the
    neighbourhood too, are real ones. Predictions are clipped. A fold whose December lies before t.first has no rows.
    """

    def chain(own: Block, fold: int, w: np.ndarray) -> list[dict]:
        place, rows = {int(m): i for i, m in enumerate(t.ym)}, []
        for year in sorted(t.folds[fold].get("test", [])):
            anchor = (year - 2) * 12 + 11
            if anchor < t.first or anchor not in place:
                continue
            base = own.base(fold)[1]
            forecast = own.forecast(fold) if own.raw is not None else None
            before = None
            for k in range(1, 25):
                at = place.get(anchor + k)
                if at is None:
                    break
                one = np.array([at])
                last = None if k <= 12 else np.nan_to_num(before - own.normal[at - 1])[None]
                x = own.features(one, np.array([k if k <= 12 else 1]), last)
                if forecast is not None:
                    x = np.concatenate([x, forecast[one][:, :, None]], 2)
                before = np.maximum(base[at] + _dot(x, w)[0], 0.0)
                rows.append(dict(zip(_CHAIN, (fold, int(t.ym[at]), own.cells, k, own.y[at], before), strict=True)))
        return rows

    return _with_weights(panel, weights, t, model, chain, "fold int, ym int, cell int, position int, value double, pred double")
