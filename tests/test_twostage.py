"""Two-stage models in separate steps against loops over months and cells: pooling, recursion, forecasts, deviations, empty months."""

from __future__ import annotations

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import ridge as R
from panelmill.operators import twostage as Q
from panelmill.operators.evaluate import grid_scores, grid_sums
from panelmill.plans import twostage as plans
from panelmill.sources import store

ROWS, COLS = 5, 6
CELLS, YEARS, TEST = ROWS * COLS, range(1990, 1998), 1996
YM = np.arange(1990 * 12, 1998 * 12)
SPAN, EMPTY = (int(YM[0]), int(YM[-1])), 40
NAMES = tuple(f"v{k}" for k in range(6))
TRAIN = [y for y in YEARS if abs(y - TEST) > 1]
FULL = Q.Model((3.0, 7.0), NAMES, history=1994)


class Made:
    """Values with gaps and one wholly empty month, six local columns by target month, forecasts with missing starts, two month features."""

    def __init__(self):
        rng = np.random.default_rng(8)
        n = len(YM)
        self.x = rng.normal(size=(n, 2))
        self.local = rng.normal(size=(n, CELLS, len(NAMES))) * np.array([1, 1, 20, 0.1, 1, 1])
        self.forecast = 3 + rng.normal(size=(n, CELLS)) + np.sin(YM % 12)[:, None]
        self.forecast[rng.random(n) < 0.1] = np.nan
        self.forecast[rng.random((n, CELLS)) < 0.03] = np.nan
        self.value = 5 + np.sin(YM % 12)[:, None] + 0.5 * self.x[:, :1] + 0.4 * self.local[:, :, 0] + 0.3 * np.nan_to_num(self.forecast) + rng.normal(size=(n, CELLS))
        self.value[rng.random(self.value.shape) < 0.05] = np.nan
        self.value[EMPTY] = np.nan


@pytest.fixture(scope="module")
def made():
    return Made()


@pytest.fixture(scope="module")
def frames(spark, made):
    none = lambda v: None if np.isnan(v) else float(v)
    rows = [(int(m), c, none(made.value[i, c]), none(made.forecast[i, c]), *map(float, made.local[i, c])) for i, m in enumerate(YM) for c in range(CELLS)]
    panel = spark.createDataFrame(rows, "ym int, cell int, value double, f double, " + ", ".join(f"{v} double" for v in NAMES)).repartition(5)
    features = spark.createDataFrame([(int(m), *map(float, made.x[i])) for i, m in enumerate(YM)], "ym int, p double, q double")
    folds = spark.createDataFrame([(TEST, y, "test" if y == TEST else "banned" if y not in TRAIN else "train") for y in YEARS], "fold int, year int, role string")
    t = Q.with_presence(panel, R.months_of(features, folds, ["p", "q"], *SPAN))
    return panel, t, folds


@pytest.fixture(autouse=True)
def small_blocks(monkeypatch):
    monkeypatch.setattr(Q, "BLOCK", 7)
    monkeypatch.setattr(Q, "TILE", 2)
    monkeypatch.setattr(Q, "PART", 3)


class Loops:
    """The model by loops, one cell after another."""

    def __init__(self, made, model, skip_empty=False):
        self.made, self.model = made, model
        month = YM % 12
        self.train = [i for i in range(len(YM)) if YM[i] // 12 in TRAIN]
        first = [i for i in self.train if i != EMPTY or not skip_empty]
        mu, sd = made.x[first].mean(0), made.x[first].std(0)
        z = np.concatenate([np.ones((len(YM), 1)), (made.x - mu) / sd], 1)
        self.clim, self.base, self.normal = np.zeros((len(YM), CELLS)), np.zeros((len(YM), CELLS)), np.zeros((12, CELLS))
        self.f = np.zeros((len(YM), CELLS))
        for c in range(CELLS):
            own = {m: [made.value[i, c] for i in self.train if month[i] == m] for m in range(12)}
            clim, sigma = {m: np.nanmean(v) for m, v in own.items()}, {m: max(np.nanstd(v), 1e-3) for m, v in own.items()}
            target = np.array([np.nan_to_num((made.value[i, c] - clim[month[i]]) / sigma[month[i]]) for i in first])
            w = np.linalg.solve(z[first].T @ z[first] + np.diag([0, model.ridges[0], model.ridges[0]]), z[first].T @ target)
            for i in range(len(YM)):
                self.clim[i, c] = clim[month[i]]
                self.base[i, c] = clim[month[i]] + sigma[month[i]] * float(z[i] @ w)
                starts = [made.forecast[j, c] for j in range(len(YM)) if (YM[j] - 1) % 12 == (YM[i] - 1) % 12 and (YM[j] - 1) // 12 in TRAIN and (YM[j] - 1) // 12 <= 1993]
                starts = [s for s in starts if np.isfinite(s)]
                self.f[i, c] = np.nan_to_num(made.forecast[i, c] - np.mean(starts)) if starts else 0.0
            for m in range(12):
                self.normal[m, c] = np.nanmean([made.value[i, c] for i in range(len(YM)) if month[i] == m and YM[i] // 12 <= model.history])
        self.w = self.fit()

    def row(self, i, c, lag, last=None):
        if last is None:
            last = np.nan_to_num(self.made.value[i - lag, c] - self.normal[YM[i - lag] % 12, c])
        return [*self.made.local[i, c], last, lag, lag * last, *([self.f[i, c]] if self.model.dynamic else [])]

    def fit(self):
        rows, left = [], []
        for c in range(CELLS):
            at = [(i, int(YM[i] * 7919 % 24 + 1)) for i in self.train if i != EMPTY]
            at = [(i, lag) for i, lag in at if i - lag >= 0]
            rows.append([self.row(i, c, lag) for i, lag in at])
            left.append([np.nan_to_num(self.made.value[i, c] - self.base[i, c]) for i, _ in at])
        x, r = np.array(rows), np.array(left)
        k = x.shape[2]
        mu, sd = x.reshape(-1, k).mean(0), x.reshape(-1, k).std(0)
        if not self.model.standardise:
            mu, sd = np.zeros(k), np.ones(k)
        out = []
        for c in range(CELLS):
            a = np.concatenate([(x[c] - mu) / sd, np.ones((x.shape[1], 1))], 1)
            w = np.linalg.solve(a.T @ a + np.diag([self.model.ridges[1]] * k + [0]), a.T @ r[c])
            out.append([*(w[:k] / sd), w[k] - (w[:k] / sd) @ mu])
        return np.array(out)

    def corr(self, i, c, lag, last=None):
        return float(np.array([*self.row(i, c, lag, last), 1.0]) @ self.w[c])

    def preds(self):
        lags = lambda i, gap: int(YM[i] % 12 + 1 + 12 * (gap - 1))
        return {(gap, int(YM[i]), c): (lags(i, gap), self.clim[i, c], self.base[i, c], self.corr(i, c, lags(i, gap))) for i in range(len(YM)) if YM[i] // 12 == TEST for c in range(CELLS) for gap in (1, 2)}


def same(preds, loops):
    got, want = {(r.gap, r.ym, r.cell): (r.lag, r.clim, r.base, r.corr) for r in preds.collect()}, loops.preds()
    return got.keys() == want.keys() and all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


MODELS = {
    "plain": FULL,
    "forecast": Q.Model((3.0, 7.0), NAMES, dynamic="f", hindcast=1993, history=1994),
    "deviations": Q.Model((3.0, 7.0), NAMES, history=1994, standardise=True),
    "both": Q.Model((3.0, 7.0), NAMES, dynamic="f", hindcast=1993, history=1994, standardise=True),
    "skipped": Q.Model((3.0, 7.0), NAMES, history=1994, skip_empty=True),
}


@pytest.mark.parametrize("name", MODELS)
def test_fit_and_predict(spark, made, frames, tmp_path, name):
    """The ledger, its coefficients and predictions from them, and the one-pass form, all as loops do it; nine columns, ten with the forecast."""
    panel, t, _ = frames
    model, loops = MODELS[name], Loops(made, MODELS[name], MODELS[name].skip_empty)
    Q.ledger(panel, t, model).write.parquet(str(tmp_path / "ledger"))
    w = Q.coefficients(spark.read.parquet(str(tmp_path / "ledger")), t, model)
    got = {r.cell: r.w for r in w.collect()}
    assert len(got) == CELLS and len(model.columns) == len(got[0]) - 1
    assert all(np.allclose(got[c], loops.w[c], atol=1e-8) for c in range(CELLS))
    assert same(Q.predict(panel, w, t, model), loops)
    if model.standardise:
        with pytest.raises(ValueError):
            Q.two_stage(panel, t, model)
    else:
        assert same(Q.two_stage(panel, t, model), loops)


def test_an_empty_month_does_not_train_the_second_stage(made, frames):
    """Whatever local features an empty month has, the coefficients stay; one cell's value in it makes it train."""
    panel, t, _ = frames
    spoiled = panel.withColumn("v0", F.when(F.col("ym") == int(YM[EMPTY]), F.lit(1e3)).otherwise(F.col("v0")))
    plain, other = (sorted(Q.coefficients(Q.ledger(p, t, FULL), t, FULL).collect()) for p in (panel, spoiled))
    assert not t.present[EMPTY] and all(np.allclose(a.w, b.w) for a, b in zip(plain, other, strict=True))
    seen = t.seen_in(np.ones(len(YM), bool))
    trained = sorted(Q.coefficients(Q.ledger(spoiled, seen, FULL), seen, FULL).collect())
    assert not any(np.allclose(a.w, b.w) for a, b in zip(plain, trained, strict=True))


BOXES = [("west", 0, 2, 0, 4), ("low", 0, 5, 0, 1), ("none", 50, 60, 0, 4)]


@pytest.mark.parametrize(("alpha", "regional", "intercept"), [(0.6, None, True), (None, 0.3, True), (0.25, 0.7, False), (1.0, None, True), (0.0, 0.0, True)])
def test_pooling(spark, made, frames, alpha, regional, intercept):
    panel, t, _ = frames
    raw = Loops(made, FULL).w
    near, region = np.zeros_like(raw), np.zeros_like(raw)
    for c in range(CELLS):
        y, x = divmod(c, COLS)
        for i in range(-2, 3):
            for j in range(-2, 3):
                near[c] += raw[min(max(y + i, 0), ROWS - 1) * COLS + min(max(x + j, 0), COLS - 1)] / 25
        held = [raw[[d for d in range(CELLS) if w <= d % COLS <= e and s <= d // COLS <= n]].mean(0) for _, w, e, s, n in BOXES if w <= x <= e and s <= y <= n]
        region[c] = np.mean(held, 0) if held else raw.mean(0)
    want = raw if alpha is None else alpha * raw + (1 - alpha) * near
    want = want if regional is None else regional * want + (1 - regional) * region
    if not intercept:
        want = np.concatenate([want[:, :-1], raw[:, -1:]], 1)
    w = Q.coefficients(Q.ledger(panel, t, FULL), t, FULL)
    lat, lon = F.floor(F.col("cell") / COLS).cast("double"), (F.col("cell") % COLS).cast("double")
    got = Q.pooled(w, len(FULL.columns), (ROWS, COLS), alpha, regional, BOXES, lat, lon, intercept)
    rows = {r.cell: r.w for r in got.collect()}
    assert len(rows) == CELLS and all(np.allclose(rows[c], want[c], atol=1e-9) for c in range(CELLS))
    preds = {(r.ym, r.cell): r.corr for r in Q.predict(panel, got, t, FULL, (1,)).collect()}
    loops = Loops(made, FULL)
    loops.w = want
    assert all(abs(v - loops.corr(ym - YM[0], c, ym % 12 + 1)) < 1e-8 for (ym, c), v in preds.items()) and len(preds) == 12 * CELLS


@pytest.mark.parametrize("name", ["plain", "both"])
def test_recursion_through_the_model(spark, made, frames, name):
    panel, t, _ = frames
    model, loops = MODELS[name], Loops(made, MODELS[name])
    want = {}
    for c in range(CELLS):
        before = None
        for k in range(1, 25):
            i = (TEST - 1) * 12 + k - 1 - YM[0]
            corr = loops.corr(i, c, k) if k <= 12 else loops.corr(i, c, 1, before - loops.normal[YM[i - 1] % 12, c])
            before = max(loops.base[i, c] + corr, 0.0)
            want[c, k] = before
    rows = Q.recursive(panel, Q.coefficients(Q.ledger(panel, t, model), t, model), t, model).collect()
    assert len(rows) == len(want) and all(abs(r.pred - want[r.cell, r.position]) < 1e-8 and r.ym == (TEST - 1) * 12 + r.position - 1 for r in rows)


def test_recursion_sees_only_what_it_may(made, frames):
    """Values after the anchor change no prediction, nor do values of other cells."""
    panel, t, _ = frames
    w = Q.coefficients(Q.ledger(panel, t, FULL), t, FULL).collect()
    fixed = panel.sparkSession.createDataFrame([(r.fold, r.cell, r.w) for r in w], "fold int, cell int, w array<double>")
    spoiled = panel.withColumn("value", F.when(F.col("ym") >= (TEST - 1) * 12, F.col("value") + 50).otherwise(F.col("value")))
    one, two = ({(r.ym, r.cell): r.pred for r in Q.recursive(p, fixed, t, FULL).collect()} for p in (panel, spoiled))
    assert one.keys() == two.keys() and all(abs(one[k] - two[k]) < 1e-9 for k in one)


def test_downdated_moments(made, frames, monkeypatch):
    """A fold's sums by subtraction are those of its years added up, also where almost nothing is left."""
    rng = np.random.default_rng(1)
    years = np.arange(1990, 1998)
    x = rng.normal(size=(8, 12, 3, 2))
    x[years > 1991, :, 1] *= 1e7  # a cell whose training years hold next to nothing of the total
    gram, sums = np.einsum("ymck,ymcl->yckl", x, x), x.sum(1)
    _, t, _ = frames
    led = Q.Ledger(np.arange(3), np.zeros((3, 2)), years, np.full(8, 12), gram, sums, [1, 2], np.zeros((2, 3, 2)), np.zeros((2, 3)), None)
    t = R.Months(t.ym, t.x, t.has, {1: {"train": [1990, 1991, 1992, 1993, 1994, 1995]}, 2: {"train": [1990, 1991]}}, t.first, t.present)
    for i, own in ((0, years < 1996), (1, years < 1992)):
        n, g, s, *_ = led.fold(i, t)
        assert n == 12 * own.sum() and np.allclose(g, gram[own].sum(0), rtol=1e-7) and np.allclose(s, sums[own].sum(0), rtol=1e-6, atol=1e-6)
    only = R.Months(t.ym, t.x, t.has, {1: {"train": [1990, 1991, *range(1992, 1994), 1995]}}, t.first, t.present)
    thin = gram.copy()
    thin[years == 1994, 1] *= 1e12  # subtracting this year leaves nothing of the others' digits
    led = Q.Ledger(np.arange(3), np.zeros((3, 2)), years[:6], np.full(6, 12), thin[:6], sums[:6], [1], np.zeros((1, 3, 2)), np.zeros((1, 3)), None)
    assert np.allclose(led.fold(0, only)[1], thin[:6][years[:6] != 1994].sum(0), rtol=1e-9)


def test_folds_without_training_months_or_cells(spark, frames):
    panel, t, _ = frames
    bare = R.Months(t.ym, t.x, t.has, {1: {"test": [1996]}, 2: {}}, t.first, t.present)
    assert Q.two_stage(panel, bare, FULL).count() == 0 and Q.coefficients(Q.ledger(panel, bare, FULL), bare, FULL).count() == 0
    assert Q.two_stage(panel.limit(0), t, FULL).count() == 0
    w = Q.coefficients(Q.ledger(panel, t, FULL), t, FULL).where("cell <> 3")
    assert {r.cell for r in Q.predict(panel, w, t, FULL).where("corr is null").collect()} == {3}


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_a_stored_panel_is_fitted_without_a_shuffle(spark, made, frames, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "BLOCK", 7)
    panel, t, _ = frames
    store.save_blocks(panel, "stored_panel", str(tmp_path / "panel"), 3)
    kept = store.load_blocks(spark, "stored_panel", ["value", *NAMES])
    for made_of in (Q.two_stage(kept, t, FULL), Q.ledger(kept, t, FULL)):
        assert "Exchange" not in plan(made_of) and "FlatMapGroupsInArrow" in plan(made_of)
    assert "Exchange" in plan(Q.two_stage(panel, t, FULL)) and "f:double" not in plan(kept)  # the forecast isn't read
    assert same(Q.two_stage(kept, t, FULL), Loops(made, FULL))
    w = Q.coefficients(Q.ledger(kept, t, FULL), t, FULL)
    assert same(Q.predict(kept, w, t, FULL), Loops(made, FULL))
    eager = store.load_blocks(spark, "stored_panel", ["value", *NAMES], eager=True)
    assert same(Q.two_stage(eager, t, FULL), Loops(made, FULL)) and eager.storageLevel.useMemory
    eager.unpersist()
    spark.sql("DROP TABLE stored_panel")


def test_prediction_store(spark, frames, tmp_path):
    panel, t, _ = frames
    preds = Q.two_stage(panel, t, FULL)
    store.save_preds(preds, str(tmp_path))
    store.save_preds(preds.where("gap = 2").withColumn("corr", F.lit(0.0)), str(tmp_path))  # one folder anew, the other stays
    back = store.load_preds(spark, str(tmp_path))
    assert back.count() == preds.count() and back.where("gap = 2 and corr <> 0").count() == 0 and back.where("gap = 1 and corr <> 0").count() > 0
    assert "PartitionFilters: [isnotnull(gap" in plan(back.where("gap = 1"))


def test_a_grid_is_scored_without_more_rows(spark):
    rng = np.random.default_rng(0)
    base, value = rng.normal(size=200), rng.normal(size=200)
    rows = spark.createDataFrame([(int(i % 3), float(b), None if i == 7 else float(v)) for i, (b, v) in enumerate(zip(base, value, strict=True))], "key int, base double, value double")
    grid = [{"w": w} for w in (0.5, 0.25, 0.5, 0.0)]
    sums = grid_sums(rows, ["key"], F.col("value"), [g["w"] * F.col("base") for g in grid])
    scores = grid_scores(sums, ["key"], grid)
    assert not any(x in plan(scores) for x in ("Generate", "CartesianProduct", "NestedLoop")) and "Expand" not in plan(sums)
    got = sorted((r.key, r.w, round(r.rmse, 9)) for r in scores.collect())
    ok = np.arange(200) != 7
    want = sorted((k, g["w"], round(float(np.sqrt(np.mean((g["w"] * base - value)[ok & (np.arange(200) % 3 == k)] ** 2))), 9)) for k in range(3) for g in grid)
    assert got == want
    assert {(r.key, r.w) for r in scores.where("best").collect()} == {(k, 0.0) for k in range(3)} and scores.where("best").count() == 3


def test_sweeps_read_one_store(spark, monkeypatch):
    """All parts of the sweeps come from one pass over the stored predictions, which adds no rows."""
    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("needs the driver's tables")
    monkeypatch.setattr(Q, "BLOCK", 256)
    preds = plans._stored_preds(spark, "/root/testdata/sf0.001")
    swept = plan(plans._swept(spark, "/root/testdata/sf0.001", preds))
    assert sum("FileScan" in line and "preds-" in line for line in swept.split("\n")) == 1
