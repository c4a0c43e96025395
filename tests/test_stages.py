"""Two-stage models against loops, what they must not see, and the algebra of files."""

from __future__ import annotations

import os
import re

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from panelmill import queries
from panelmill.operators import combine as P
from panelmill.operators import ensemble as E
from panelmill.operators import features as M
from panelmill.operators import ridge as R
from panelmill.operators import spatial as S
from panelmill.operators import twostage as Q
from panelmill.sources import tables

SF = "/root/testdata/sf0.001"
SPAN, CELLS = (1990 * 12, 1997 * 12 + 11), 12
NAMES = ["u", "v", "w"]


@pytest.fixture(scope="module")
def made(spark):
    """A panel of 3 x 4 cells with three variables, some values missing, and two month features."""
    rng = np.random.default_rng(4)
    ym = np.arange(SPAN[0], SPAN[1] + 1)
    x = rng.normal(size=(len(ym) + 1, 2))
    field = rng.normal(size=(len(ym), CELLS, 3))
    value = 5 + np.sin(ym % 12)[:, None] + 0.5 * x[:-1, :1] + rng.normal(size=(len(ym), CELLS))
    value[1:] += 0.3 * field[:-1, :, 0]
    value[rng.random(value.shape) < 0.05] = np.nan
    rows = [(int(m), c, None if np.isnan(value[i, c]) else float(value[i, c]), *map(float, field[i, c])) for i, m in enumerate(ym) for c in range(CELLS)]
    panel = spark.createDataFrame(rows, "ym int, cell int, value double, u double, v double, w double")
    features = spark.createDataFrame([(int(m) + 1, float(a), float(b)) for m, (a, b) in zip(ym, x[1:], strict=True)], "ym int, p double, q double")
    return ym, value, field, x, panel, features


def folds(spark, test=1996):
    years = range(1990, 1998)
    return spark.createDataFrame([(test, y, "test" if y == test else "banned" if abs(y - test) <= 1 else "train") for y in years], "fold int, year int, role string")


def staged(panel, features, folds, history=1997):
    local = M.local_features(panel.select("ym", "cell", *NAMES), NAMES, 4, SPAN, history)
    rows = panel.select("ym", "cell", "value").join(local, ["ym", "cell"], "full")
    columns = [c for v in NAMES for c in (f"{v}_a", f"{v}_n")]
    t = Q.with_presence(rows, R.months_of(features, folds, ["p", "q"], *SPAN))
    out = Q.two_stage(rows, t, Q.Model((3.0, 7.0), tuple(columns), history=history)).collect()
    return {(r.gap, r.ym, r.cell): (r.lag, r.clim, r.base, r.corr) for r in out}


def brute(ym, value, field, x, test=1996):
    """The same by loops over months and cells."""
    months = {int(m): i for i, m in enumerate(ym)}
    train_years = [y for y in range(1990, 1998) if abs(y - test) > 1]
    anomaly = np.zeros_like(field)
    for m in range(12):
        own = np.flatnonzero(ym % 12 == m)
        for i in own:
            others = [j for j in own if j != i]
            anomaly[i] = field[i] - field[others].mean(0)
    grid = np.pad(anomaly.reshape(len(ym), 3, 4, 3), ((0, 0), (2, 2), (2, 2), (0, 0)), "edge")
    near = sum(grid[:, a : a + 3, b : b + 4] for a in range(5) for b in range(5)).reshape(anomaly.shape) / 25
    normal = {(m, c): np.nanmean(value[ym % 12 == m, c]) for m in range(12) for c in range(CELLS)}
    trained = [i for i, m in enumerate(ym) if m // 12 in train_years]
    with_features = [i for i in trained if i > 0]  # the first month has no month before it
    mu, sd = x[with_features].mean(0), x[with_features].std(0)
    z = np.concatenate([np.ones((len(ym), 1)), (x[:-1] - mu) / sd], 1)
    out = {}
    for c in range(CELLS):
        clim = {m: np.nanmean([value[i, c] for i in trained if ym[i] % 12 == m]) for m in range(12)}
        sigma = {m: max(np.nanstd([value[i, c] for i in trained if ym[i] % 12 == m]), 1e-3) for m in range(12)}
        target = np.array([np.nan_to_num((value[i, c] - clim[ym[i] % 12]) / sigma[ym[i] % 12]) for i in with_features])
        w = np.linalg.solve(z[with_features].T @ z[with_features] + np.diag([0, 3.0, 3.0]), z[with_features].T @ target)
        base = [clim[m % 12] + sigma[m % 12] * float(z[i] @ w) for i, m in enumerate(ym)]

        def row(i, lag):
            local = [f for k in range(3) for f in (anomaly[i - 1, c, k], near[i - 1, c, k])]
            last = np.nan_to_num(value[i - lag, c] - normal[ym[i - lag] % 12, c])
            return [1.0, *local, last, lag, lag * last]

        rows, left = [], []
        for i in with_features:
            lag = int(ym[i] * 7919 % 24 + 1)
            if i - lag >= 0:
                rows.append(row(i, lag))
                left.append(np.nan_to_num(value[i, c] - base[i]))
        a = np.array(rows)
        w2 = np.linalg.solve(a.T @ a + np.diag([0.0] + [7.0] * (a.shape[1] - 1)), a.T @ np.array(left))
        for i in (months[test * 12 + k] for k in range(12)):
            for gap in (1, 2):
                lag = int(ym[i] % 12 + 1 + 12 * (gap - 1))
                out[gap, int(ym[i]), c] = (lag, clim[ym[i] % 12], base[i], float(np.array(row(i, lag)) @ w2))
    return out


def test_two_stage_agrees_with_loops(spark, made):
    ym, value, field, x, panel, features = made
    got, want = staged(panel, features, folds(spark)), brute(ym, value, field, x)
    assert got.keys() == want.keys()
    assert all(np.allclose(got[k], want[k], atol=1e-8) for k in want)


def test_features_see_nothing_after_their_origin(spark, made):
    """Features of a target in a year after history stay as they are when all months from the target on are spoiled."""
    ym, _, _, _, panel, _ = made
    target = 1997 * 12 + 5
    spoiled = panel.withColumns({v: F.when(F.col("ym") >= target, F.lit(1e6)).otherwise(F.col(v)) for v in NAMES})
    one, two = (M.local_features(p.select("ym", "cell", *NAMES), NAMES, 4, SPAN, 1996).where(F.col("ym") == target).orderBy("cell").collect() for p in (panel, spoiled))
    assert len(one) == CELLS and one == two


def test_two_stage_does_not_learn_from_banned_years(spark, made):
    """Spoiled values of the tested and banned years leave what a fold fits unchanged; observations and their means are taken from elsewhere."""
    _, _, _, _, panel, features = made
    spoiled = panel.withColumn("value", F.when(F.floor(F.col("ym") / 12).isin(1996, 1997), F.col("value") + 1e3).otherwise(F.col("value")))
    one, two = (staged(p, features, folds(spark), 1994) for p in (panel, spoiled))
    assert all(np.allclose(one[k][1:3], two[k][1:3]) for k in one)


def test_shared_ridge_of_all_roles(spark, made):
    ym, _, _, _, panel, features = made
    rows = R.shared_ridge(panel, features, folds(spark), (3.0,), ["p", "q"], SPAN, roles=("train", "test")).collect()
    assert {r.ym // 12 for r in rows} == {1990, 1991, 1992, 1993, 1994, 1996} and len(rows) == (6 * 12 - 1) * CELLS


def test_global_standardisation(spark):
    """Two cells share the deviation of a column."""
    rng = np.random.default_rng(3)
    x, r = rng.normal(size=(2, 30, 2)) * np.array([1.0, 50.0]), rng.normal(size=(2, 30))
    x[1] *= 3
    df = spark.createDataFrame([(1, c, *map(float, x[c, i]), float(r[c, i])) for c in range(2) for i in range(30)], "fold int, cell int, a double, b double, r double")
    sd = x.reshape(-1, 2).std(0)
    got = {row.cell: row.w for row in R.solve_cells(R.cell_moments(df, ["a", "b"]), 4.0, True).collect()}
    for c in range(2):
        own, left = (x[c] - x[c].mean(0)) / sd, r[c] - r[c].mean()
        want = np.linalg.solve(own.T @ own + 4 * np.eye(2), own.T @ left) / sd
        assert np.allclose(got[c][:2], want)


def test_recursion_with_an_anchor(spark):
    df = spark.createDataFrame([(1, 0.5, 4.0, [(1.0, 2.0), (1.0, 3.0), (0.5, 1.0), (-9.0, 0.0)])], "cell int, s double, start double, months array<struct<base:double,normal:double>>")
    assert R.recursion(df, "s", "start", "months", 2).first().path == [2.0, 1.5, 0.75, 0.0]
    assert R.recursion(df, "s", "start", "months").first().path == [2.0, 0.5, 0.25, 0.0]


def test_ids_that_do_not_fit_stop_the_query(spark):
    one = spark.createDataFrame([("2023_01_-60.00_-90.00", 1.0), ("2023_02_-59.75_-89.50", 2.0)], "id string, value double")
    assert sorted((r.ym, r.cell) for r in P.on_cells(one, 10, 5).collect()) == [(2023 * 12, 0), (2023 * 12 + 1, 12)]
    for bad in ("2023_01_-58.50_-90.00", "2023_13_-60.00_-90.00", "total", None):
        with pytest.raises(PySparkException):
            P.on_cells(one.union(spark.createDataFrame([(bad, 1.0)], "id string, value double")), 10, 5).collect()
    with pytest.raises(PySparkException):
        P.blend([(one, 1), (one.limit(1), 1)]).collect()


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", ["file_damped", "file_offset", "id_order"])
def test_ids_are_not_made_for_lines(spark, name):
    plan = queries.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"l_shipdate|l_partkey", plan)  # the panel is aggregated once, before its ids are made and parsed


def test_ids_in_order_and_kept(spark, tmp_path):
    ids = P.expected_ids(spark, [24000, 24001], 3, 2)
    rows = [r.id for r in ids.orderBy("row_id").collect()]
    assert rows[:4] == ["2000_01_-60.00_-90.00", "2000_01_-60.00_-89.75", "2000_01_-60.00_-89.50", "2000_01_-59.75_-90.00"] and len(rows) == 12
    ids.withColumn("value", F.lit(1.0)).orderBy("row_id").select("id", "value").coalesce(1).write.option("header", True).csv(str(tmp_path / "csv"))
    for _ in range(2):
        kept = tables.cached_ids(spark, str(tmp_path / "csv"), str(tmp_path / "ids"))
        assert [tuple(r) for r in kept.orderBy("row_id").collect()] == list(enumerate(rows))


def test_start_that_is_not_there(spark):
    an = spark.createDataFrame([(5, 0, 1.5)], "ym int, cell int, anomaly double")
    cells = spark.range(2).select(F.col("id").cast("int").alias("cell"))
    assert {r.cell: r.anomaly for r in E.start_field(an, 5, cells).collect()} == {0: 1.5, 1: 0.0} and E.start_field(an, 6, cells).count() == 0
    assert spark.range(1).select(E.rate_to_daily(F.lit(1e-8)), S.recentred(F.lit(350)), S.recentred(F.lit(180))).first()[1:] == (-10, 180)


def test_pooling_can_leave_the_intercept(spark):
    w, o = (spark.createDataFrame([(1, 0, 0, a), (1, 0, 1, b)], "fold int, cell int, k int, w double") for a, b in ((2.0, 8.0), (4.0, 0.0)))
    assert {r.k: r.w for r in R.pooled(w, o, 0.5).collect()} == {0: 3.0, 1: 4.0}
    assert {r.k: r.w for r in R.pooled(w, o, 0.5, own=[1]).collect()} == {0: 3.0, 1: 8.0}


def test_first_path_there(spark, tmp_path):
    (tmp_path / "b").mkdir()
    assert tables.first_there(spark, [str(tmp_path / "a"), str(tmp_path / "b")]).endswith("b")
    with pytest.raises(FileNotFoundError):
        tables.first_there(spark, [str(tmp_path / "a")])
