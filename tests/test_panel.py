"""Panel operators: every query with SQL against DuckDB, and properties that SQL doesn't show."""

from __future__ import annotations

import os
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill import queries
from panelmill.operators import climatology as C
from panelmill.operators import combine as P
from panelmill.operators import ensemble as E
from panelmill.operators import features as M
from panelmill.operators import regime as G
from panelmill.operators import ridge as R
from panelmill.operators import spatial as S
from panelmill.panel import driver_index, loyo_folds, month_index, panel_a
from panelmill.sources import tables

SF = "/root/testdata/sf0.001"


def values(df):
    columns = sorted(df.columns)
    clean = lambda x: None if x is None or x != x else round(float(x), 6) if isinstance(x, int | float | np.number) and not isinstance(x, bool | np.bool_) else str(x)
    return sorted([tuple(clean(x) for x in row) for row in df[columns].astype(object).to_numpy().tolist()], key=str)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
@pytest.mark.parametrize("name", list(queries.ORACLES))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in os.listdir(SF):
        con.execute(f"CREATE VIEW {t.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{t}')")
    got, want = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    a, b = values(got), values(want)
    assert len(a) == len(b)
    for x, y in zip(a, b, strict=True):
        assert all(p == q or isinstance(p, float) and isinstance(q, float) and abs(p - q) <= 2e-5 * max(1, abs(q)) for p, q in zip(x, y, strict=True)), (x, y)


def test_loo_group(spark):
    df = spark.createDataFrame([(1, 0, float(v)) for v in (1, 2, 3, 6)] + [(2, 0, 5.0)], "month int, cell int, value double")
    for f in (C.loo_anomaly, C.loo_anomaly_scaled):
        got = {(r.month, r.value): r.anomaly for r in f(df).collect()}
        assert [round(got[1, v], 6) for v in (1.0, 2.0, 3.0, 6.0)] == [round(-8 / 3, 6), round(-4 / 3, 6), 0, 4]
        assert got[2, 5.0] is None


def test_folds(spark):
    rows = loyo_folds(spark).collect()
    train = {f: {r.year for r in rows if r.fold == f and r.role == "train"} for f in {r.fold for r in rows}}
    assert len(train) == 6 and train[1998] == {1995, 1996, 2000} and train[1995] == {1997, 1998, 1999, 2000}


def test_fold_climatology_ignores_what_it_must_not_see(spark):
    rng = np.random.default_rng(0)
    rows = [(y, m, c, float(rng.normal())) for y in range(1995, 2001) for m in (1, 2) for c in range(3)]
    schema, folds = "year int, month int, cell int, value double", loyo_folds(spark)
    spoiled = [(y, m, c, v if y in (1995, 1996, 2000) else 1e6) for y, m, c, v in rows]
    one, two = ({(r.month, r.cell): (r.n, round(r.clim, 6), round(r.sigma, 4)) for r in C.fold_climatology(spark.createDataFrame(x, schema), folds).where("fold = 1998").collect()} for x in (rows, spoiled))
    assert {k: v[0] for k, v in one.items()} == {k: v[0] for k, v in two.items()}
    assert all(abs(one[k][1] - two[k][1]) < 1e-6 for k in one)


def test_rolling_and_lags(spark):
    df = spark.createDataFrame([(k, v) for k, v in enumerate((1.0, None, 3.0, 4.0, 5.0))], "ym int, v double")
    got = M.rolling(M.lags(df, ["v"]), ["v"]).orderBy("ym").collect()
    assert [r.v_mean3 for r in got] == [None, None, None, None, 4.0] and [r.v_lag1 for r in got] == [None, 1.0, None, 3.0, 4.0]


def test_neighbourhood(spark):
    df = spark.createDataFrame([(0, k // 3, k % 3, float(k + 1)) for k in range(9)], "ym int, gy int, gx int, value double")
    got = {(r.gy, r.gx): round(r["mean"], 6) for r in S.neighbourhood(df, ["ym"]).collect()}
    assert got[1, 1] == 5 and got[0, 0] == 3.4


def test_wrap_box(spark):
    cells = spark.createDataFrame([(k, 0.0, float(lon)) for k, lon in enumerate((0, 10, 11, 339, 340, 360))], "cell int, lat double, lon double")
    inside = S.members(cells, S.boxes(spark, [("w", 340, 370, -1, 1)])).collect()
    assert {r.lon for r in inside} == {0, 10, 340, 360}


def test_phase(spark):
    nan = float("nan")
    df = spark.createDataFrame([(x,) for x in (1.0, 0.5, 0.49, -0.49, -0.5, -0.7, nan, None)], "x double")
    assert [r[0] for r in df.select(G.phase(F.col("x"))).collect()] == [1, 1, 0, 0, -1, -1, 0, 0]
    assert spark.range(1).select(G.phase(F.lit(0.3), 0.2)).first()[0] == 1
    one = lambda comp, beta: spark.range(1).select(G.offset(F.lit(comp).cast("double"), F.lit(1.0), beta)).first()[0]
    assert one(3.0, 0.5) == 1.0 and one(3.0, 0.0) == 0.0 and one(None, 0.5) == 0.0


def test_prediction_algebra(spark):
    df = spark.createDataFrame([("2023_01_a", 1.0), ("2024_01_a", 3.0)], "id string, value double")
    other = spark.createDataFrame([("2023_01_a", 5.0), ("2024_01_a", 7.0)], "id string, value double")
    one, two = (dict(map(tuple, P.blend([(df, w), (other, v)]).collect())) for w, v in ((65, 35), (0.65, 0.35)))
    assert all(abs(one[k] - two[k]) < 1e-12 for k in one) and abs(one["2023_01_a"] - 2.4) < 1e-12
    assert dict(map(tuple, P.splice(df, other, 2024).collect())) == {"2023_01_a": 1.0, "2024_01_a": 7.0}
    assert [r[0] for r in spark.createDataFrame([(None,), (-1.0,), (2.0,)], "x double").select(C.clip0(F.col("x"))).collect()] == [None, 0.0, 2.0]
    assert df.select(P.damp(F.col("value"), F.lit(9.0), 1.0)).first()[0] == 1.0
    assert P.same_ids(df, other).first()[0] == 0 and P.same_ids(df, other.limit(1)).first()[0] == 1


def test_cell_solver_agrees_with_numpy(spark):
    rng = np.random.default_rng(1)
    x, r = rng.normal(size=(40, 3)), rng.normal(size=40)
    df = spark.createDataFrame([(1, 0, *map(float, a), float(b)) for a, b in zip(x, r, strict=True)], "fold int, cell int, a double, b double, c double, r double")
    moments = R.cell_moments(df, ["a", "b", "c"])
    xc, rc = x - x.mean(0), r - r.mean()
    want = np.linalg.solve(xc.T @ xc + 5 * np.eye(3), xc.T @ rc)
    got = R.solve_cells(moments, 5.0).first().w
    assert np.allclose(got[:3], want) and np.isclose(got[3], r.mean() - want @ x.mean(0))
    sd = x.std(0)
    want = np.linalg.solve((xc / sd).T @ (xc / sd) + 5 * np.eye(3), (xc / sd).T @ rc) / sd
    assert np.allclose(R.solve_cells(moments, 5.0, True).first().w[:3], want)


def test_principal_component_finds_a_planted_mode(spark):
    rng = np.random.default_rng(2)
    mode, series = rng.normal(size=8), rng.normal(size=60)
    rows = [(t, t // 12, t % 12 + 1, c, 0.0, float(series[t] * mode[c] + 0.01 * rng.normal())) for t in range(60) for c in range(8)]
    df = spark.createDataFrame(rows, "ym int, year int, month int, cell int, lat double, value double")
    driver = spark.createDataFrame([(t, float(-series[t])) for t in range(60)], "ym int, x double")
    pc = {r.ym: r.pc for r in E.principal_component(df, driver, 4).collect()}
    normal = np.array([series[m::12].mean() for m in range(12)])
    assert np.corrcoef([pc[t] for t in range(60)], -(series - normal[np.arange(60) % 12]))[0, 1] > 0.99


def test_a_submission_is_sorted_in_parallel(spark, tmp_path):
    """Many rows from many partitions: several sorted files, joined in their order."""
    rows = spark.range(3000).repartition(7).select(F.col("id").alias("row_id"), F.format_string("r%05d", F.col("id")).alias("id"), (F.col("id") % 7 - 1.0).alias("value"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        path = tables.write_submission(rows, str(tmp_path / "csv"), 3000)
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len([p for p in (tmp_path / "csv" / "parts").iterdir() if p.name.startswith("part-")]) > 1
    lines = open(path).read().split("\n")
    assert lines[0] == "id,value" and lines[1:-1] == [f"r{i:05d},{max(i % 7 - 1, 0):.6f}" for i in range(3000)] and lines[-1] == ""


def test_sources(spark, tmp_path):
    (tmp_path / "index.data").write_text(" 1948 1950\n 1948 " + " ".join(["0.5"] * 11) + " -99.99\n 1949 " + " ".join(["-1.25"] * 12) + "\n -99.99\n notes 1 2\n")
    got = {r.ym: r.value for r in tables.month_index_text(spark, str(tmp_path / "index.data")).collect()}
    assert len(got) == 24 and got[1948 * 12] == 0.5 and got[1948 * 12 + 11] is None and got[1949 * 12] == -1.25
    out = spark.createDataFrame([(1, "b", -1.0), (0, "a", 2.0)], "row_id int, id string, value double")
    path = tables.write_submission(out, str(tmp_path / "csv"), 2)
    assert (tmp_path / "csv" / "submission.csv").read_text() == "id,value\na,2.000000\nb,0.000000\n"
    assert {r.id for r in tables.read_ids(spark, path).collect()} == {"a", "b"}
    with pytest.raises(ValueError):
        tables.write_submission(out, str(tmp_path / "csv"), 3)
    spark.range(1).coalesce(1).write.parquet(str(tmp_path / "x"))
    part = next(p for p in (tmp_path / "x").iterdir() if p.name.endswith(".parquet"))
    part.rename(tmp_path / "NCEP_v2_run.parquet")
    assert tables.with_model(spark.read.parquet(str(tmp_path / "NCEP_v2_run.parquet"))).first().model == "NCEP"


def test_month_index(spark):
    df = spark.createDataFrame([(datetime(2000, 1, 31),)], "t timestamp_ntz")
    assert df.select(month_index(F.col("t"))).first()[0] == 24000


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_regridded_holds_every_month(spark):
    """Every month against a loop over its grid."""
    rows = panel_a(spark, SF).select("ym", "gy", "gx", "value").collect()
    node = {(r.ym, r.gy, r.gx): r.value for r in rows}
    want = {}
    for ym in {r.ym for r in rows}:
        for cell in range(12 * 23):
            (y, v), (x, u) = divmod(cell // 23 * 4, 10), divmod(cell % 23 * 4 + 1, 10)
            around = [(w, node.get((ym, y + i, x + j))) for i, a in ((0, 1 - v / 10), (1, v / 10)) for j, b in ((0, 1 - u / 10), (1, u / 10)) if (w := a * b) > 0]
            if all(z is not None for _, z in around):
                want[ym, cell] = sum(w * z for w, z in around)
    got = {(r.ym, r.cell): r.value for r in queries.QUERIES["regridded"](spark, SF).collect()}
    assert got.keys() == want.keys() and max(ym for ym, _ in got) >= 23952
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_blended_holds_every_month(spark):
    """Every row of the panel against a loop over it."""
    rows = panel_a(spark, SF).collect()
    x, by = {r.ym: r.x for r in driver_index(spark, SF).collect()}, {}
    for r in rows:
        if r.value is not None:
            by.setdefault((r.month, r.cell), []).append(r.value)
    want = {}
    for r in rows:
        clim, mixed = np.mean(by[r.month, r.cell]), max(0.65 * r.value + 0.35 * r.price / 1000, 0)
        gamma = 1.2 if (x.get(r.ym - 1) or 0) >= 0.5 else 0.8
        want["%d_%02d_%.2f_%.2f" % (r.year, r.month, r.gy * 0.25 - 60, r.gx * 0.25 - 90)] = r.price / 1000 if r.year == 2000 else max(clim + gamma * (mixed - clim), 0)
    got = {r.id: r.value for r in queries.QUERIES["blended"](spark, SF).collect()}
    assert got.keys() == want.keys() and min(got).startswith("1995_")
    assert all(abs(got[k] - want[k]) < 2e-5 for k in want)
