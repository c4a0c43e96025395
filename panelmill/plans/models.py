"""Queries: regimes, ridge models, sweeps, and the algebra of prediction tables."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.operators import climatology as C
from panelmill.operators import combine as P
from panelmill.operators import regime as G
from panelmill.operators import ridge as R
from panelmill.operators import spatial as S
from panelmill.operators.evaluate import best, rmse, yearly_scores
from panelmill.panel import FOLDS_SQL, INDEX_SQL, PANEL_A_SQL, densify, driver_index, final_fit_years, loyo_folds, on_grid, panel_a
from panelmill.plans.climatology import CLIM_SQL
from panelmill.sources import tables

_R = lambda c, name, k=6: F.round(c, k).alias(name)
#: Months of the panel, first and last.
SPAN = (1995 * 12, 2001 * 12 + 10)
_A = lambda spark, d: panel_a(spark, d).select("ym", "year", "month", "cell", "value")


def phase_composites(spark, sf_dir):
    """Composites of every fold by the driver's phase in the month before."""
    out = G.phase_composites(_A(spark, sf_dir), driver_index(spark, sf_dir), loyo_folds(spark))
    return out.select("fold", "phase", "month", "cell", _R("comp", "comp"), "n")


_PHASED = """ph AS (SELECT ym + 1 AS ym, CASE WHEN x >= {0} THEN 1 WHEN x <= -{0} THEN -1 ELSE 0 END AS phase FROM idx)"""
_COMPOSITES = f"""WITH {PANEL_A_SQL}, {FOLDS_SQL}, {INDEX_SQL}, {_PHASED.format(0.5)}
SELECT fold, phase, month, cell, round(avg(value), 6) AS comp, count(value) AS n FROM a JOIN ph USING (ym) JOIN folds USING (year) WHERE role = 'train' AND phase <> 0 GROUP BY 1, 2, 3, 4"""


def _offsets(spark, sf_dir, thresholds):
    """The tested months with climatology, and the composite of their phase for each threshold, all thresholds in one pass."""
    a, folds = _A(spark, sf_dir), loyo_folds(spark)
    phases = G.origin_phases(driver_index(spark, sf_dir), thresholds)
    comp = G.composites(a, phases, folds, ["thr"]).drop("n")
    base = a.withColumn("fold", F.col("year")).join(C.fold_climatology(a, folds), ["fold", "month", "cell"]).select("fold", "ym", "month", "cell", "value", "clim")
    every = base.withColumn("thr", F.explode(F.array(*map(F.lit, thresholds)))).join(F.broadcast(phases), ["thr", "ym"], "left").fillna(0, ["phase"])
    return every.join(comp, ["thr", "fold", "phase", "month", "cell"], "left")


def offset_scores(spark, sf_dir):
    """RMSE of climatology plus phase offset over a grid of beta and threshold, and whether it is the best."""
    grid = _offsets(spark, sf_dir, (0.4, 0.5, 0.8)).withColumn("beta", F.explode(F.array(*map(F.lit, (0.0, 0.25, 0.33)))))
    pred = C.clip0(F.col("clim") + G.offset(F.col("comp"), F.col("clim"), F.col("beta")))
    scores = grid.groupBy("thr", "beta").agg(rmse(pred, F.col("value")).alias("rmse"))
    scores = scores.select("thr", "beta", _R("rmse", "rmse", 9))
    top = best(scores, ["thr", "beta"]).select("thr", "beta", F.lit(True).alias("best"))
    return scores.join(top, ["thr", "beta"], "left").select("thr", "beta", _R("rmse", "rmse"), F.coalesce("best", F.lit(False)).alias("best"))


_OFFSETS = f"""WITH {PANEL_A_SQL}, {CLIM_SQL}, {INDEX_SQL},
g AS (SELECT CAST(thr AS DOUBLE) AS thr, CAST(beta AS DOUBLE) AS beta FROM (VALUES (.4), (.5), (.8)) t(thr), (VALUES (0), (.25), (.33)) b(beta)),
ph AS (SELECT thr, ym + 1 AS ym, CASE WHEN x >= thr THEN 1 WHEN x <= -thr THEN -1 ELSE 0 END AS phase FROM idx, (SELECT DISTINCT thr FROM g)),
comp AS (SELECT thr, fold, phase, month, cell, avg(value) AS comp FROM a JOIN ph USING (ym) JOIN folds USING (year) WHERE role = 'train' AND phase <> 0 GROUP BY ALL),
p AS (SELECT g.thr, beta, greatest(clim + coalesce(beta * (comp - clim), 0), 0) - value AS e FROM a JOIN clim ON clim.fold = a.year AND clim.month = a.month AND clim.cell = a.cell CROSS JOIN g
      LEFT JOIN ph ON ph.thr = g.thr AND ph.ym = a.ym LEFT JOIN comp ON comp.thr = g.thr AND comp.fold = a.year AND comp.phase = ph.phase AND comp.month = a.month AND comp.cell = a.cell),
s AS (SELECT thr, beta, round(sqrt(avg(e ** 2)), 9) AS rmse FROM p GROUP BY ALL)
SELECT thr, beta, round(rmse, 6) AS rmse, row_number() OVER (ORDER BY rmse, thr, beta) = 1 AS best FROM s"""


def _targets(spark, sf_dir, folds=None):
    """z-scores of training and tested months by fold, and the clim, sigma (FLOOR at least) that they are made with. Folds of leave-one-year-out unless others are given."""
    a, folds = _A(spark, sf_dir), loyo_folds(spark) if folds is None else folds
    clim = C.fold_climatology(a, folds).withColumn("sigma", F.greatest("sigma", F.lit(R.FLOOR)))
    dense = densify(a, (1995 * 12, 2001 * 12 + 11)).join(F.broadcast(folds), "year")
    z = dense.join(clim, ["fold", "month", "cell"], "left").withColumn("z", (F.col("value") - F.col("clim")) / F.col("sigma"))
    return z, clim


def _month_features(spark, sf_dir):
    m = panel_a(spark, sf_dir).groupBy("ym").agg((F.avg("price") / 1000).alias("price"))
    return driver_index(spark, sf_dir).join(m, "ym", "full").select((F.col("ym") + 1).alias("ym"), "x", F.col("price").alias("p"))


def shared_ridge(spark, sf_dir):
    """Scores by penalty and year of the ridge on two month features that all cells share, features of the month before."""
    hat = R.shared_ridge(_A(spark, sf_dir), _month_features(spark, sf_dir), loyo_folds(spark), (0.0, 10.0, 100.0), ["x", "p"], SPAN)
    preds = hat.where("value is not null and clim is not null")
    preds = preds.select("ridge", F.col("fold").alias("year"), C.clip0(F.col("clim") + F.col("sigma") * F.col("z_hat")).alias("pred"), F.col("value").alias("truth"))
    return yearly_scores(preds, ["ridge"]).select("ridge", "year", _R("rmse", "rmse", 5), _R("mean_rmse", "mean_rmse", 5))


_Z_SQL = f"""{PANEL_A_SQL}, {CLIM_SQL}, {INDEX_SQL},
c0 AS (SELECT DISTINCT cell FROM a), m0 AS (SELECT CAST(unnest(range({1995 * 12}, {2001 * 12})) AS INTEGER) AS ym),
z AS (SELECT folds.fold, folds.role, m0.ym, m0.ym // 12 AS year, c0.cell, value, clim, CASE WHEN clim IS NOT NULL THEN greatest(sigma, 1e-3) END AS sigma,
      coalesce((value - clim) / greatest(sigma, 1e-3), 0) AS z
      FROM m0 CROSS JOIN c0 JOIN folds ON folds.year = m0.ym // 12 LEFT JOIN a ON a.ym = m0.ym AND a.cell = c0.cell
      LEFT JOIN clim ON clim.fold = folds.fold AND clim.month = m0.ym % 12 + 1 AND clim.cell = c0.cell),
pm AS (SELECT ym, avg(price) / 1000 AS p FROM a GROUP BY 1),
ft AS (SELECT coalesce(idx.ym, pm.ym) + 1 AS ym, x, p FROM idx FULL JOIN pm ON pm.ym = idx.ym),
f0 AS (SELECT fold, role, m0.ym, coalesce(x, 0) AS x, coalesce(p, 0) AS p FROM m0 JOIN folds ON folds.year = m0.ym // 12 JOIN ft ON ft.ym = m0.ym),
fs AS (SELECT fold, avg(x) FILTER (role = 'train') AS mx, stddev_pop(x) FILTER (role = 'train') AS sx, avg(p) FILTER (role = 'train') AS mp, stddev_pop(p) FILTER (role = 'train') AS sp FROM f0 GROUP BY 1)"""


def _ridge_sql(clip: str) -> str:
    return f"""f AS (SELECT fold, role, ym, {clip.format('(x - mx) / sx')} AS u, {clip.format('(p - mp) / sp')} AS v FROM f0 JOIN fs USING (fold)),
s AS (SELECT fold, cell, count(*) AS n, regr_sxx(z, u) AS uu, regr_sxx(z, v) AS vv, covar_pop(u, v) * count(*) AS uv, covar_pop(u, z) * count(*) AS uz, covar_pop(v, z) * count(*) AS vz, avg(z) AS mz, avg(u) AS mu, avg(v) AS mv
      FROM f JOIN z USING (fold, role, ym) WHERE role = 'train' GROUP BY 1, 2),
w AS (SELECT l AS ridge, s.*, ((vv + l) * uz - uv * vz) / ((uu + l) * (vv + l) - uv * uv) AS wu, ((uu + l) * vz - uv * uz) / ((uu + l) * (vv + l) - uv * uv) AS wv FROM s, lam)"""


_SHARED_RIDGE = f"""WITH {_Z_SQL}, lam AS (SELECT CAST(unnest([0, 10, 100]) AS DOUBLE) AS l), {_ridge_sql('{0}')},
e AS (SELECT ridge, z.year, greatest(clim + sigma * (mz + wu * (u - mu) + wv * (v - mv)), 0) - value AS e FROM w JOIN z USING (fold, cell) JOIN f USING (fold, role, ym) WHERE role = 'test' AND value IS NOT NULL AND clim IS NOT NULL),
t AS (SELECT ridge, CAST(year AS INTEGER) AS year, sqrt(avg(e ** 2)) AS rmse FROM e GROUP BY ALL)
SELECT ridge, year, round(rmse, 5) AS rmse, round(avg(rmse) OVER (PARTITION BY ridge), 5) AS mean_rmse FROM t"""


def winsorized_ridge(spark, sf_dir):
    """Predictions of the shared ridge with features clipped at one deviation."""
    hat = R.shared_ridge(_A(spark, sf_dir), _month_features(spark, sf_dir), loyo_folds(spark), (10.0,), ["x", "p"], SPAN, 1.0)
    return hat.select("fold", "ym", "cell", _R("z_hat", "z_hat", 5))


_WINSORIZED = f"""WITH {_Z_SQL}, lam AS (SELECT CAST(10 AS DOUBLE) AS l), {_ridge_sql('greatest(-1, least(1, {0}))')}
SELECT fold, ym, cell, round(mz + wu * (u - mu) + wv * (v - mv), 5) AS z_hat FROM w JOIN z USING (fold, cell) JOIN f USING (fold, role, ym) WHERE role = 'test'"""


def _cell_rows(spark, sf_dir):
    """Training rows of the cell models: residual r of the climatology, and the anomaly x of a lagged last observation."""
    z, clim = _targets(spark, sf_dir)
    obs = densify(_A(spark, sf_dir), SPAN)
    train = z.where("role = 'train'").select("fold", "ym", "month", "cell", F.coalesce(F.col("value") - F.col("clim"), F.lit(0.0)).alias("r"))
    train = R.with_last_observation(train, obs, R.lag_of(F.col("ym"))).where(F.col("ym") - F.col("lag") >= SPAN[0])
    at = (F.col("ym") - F.col("lag")) % 12 + 1
    rows = train.withColumn("at", at.cast("int")).join(clim.select("fold", F.col("month").alias("at"), "cell", F.col("clim").alias("c")), ["fold", "at", "cell"], "left")
    return rows.withColumn("x", F.coalesce(F.col("last") - F.col("c"), F.lit(0.0))), z, obs, clim


def cell_ridge(spark, sf_dir):
    """Coefficients of one ridge per cell and fold on the anomaly of the last observation, lags drawn by month."""
    rows = _cell_rows(spark, sf_dir)[0]
    w = R.solve_cells(R.cell_moments(rows, ["x"]), 50.0)
    return w.select("fold", "cell", _R(F.col("w")[0], "slope", 5), _R(F.col("w")[1], "intercept", 5))


_CELL_SQL = f"""{_Z_SQL},
cl AS (SELECT DISTINCT fold, ym % 12 AS k, cell, clim FROM z),
tr AS (SELECT z.fold, z.cell, z.ym, z.ym - ((z.ym * 7919) % 24 + 1) AS ob, coalesce(value - clim, 0) AS r FROM z WHERE role = 'train'),
rw AS (SELECT tr.fold, tr.cell, r, coalesce(a.value - cl.clim, 0) AS x FROM tr JOIN cl ON cl.fold = tr.fold AND cl.cell = tr.cell AND cl.k = tr.ob % 12 LEFT JOIN a ON a.ym = tr.ob AND a.cell = tr.cell WHERE ob >= 23940),
cw AS (SELECT fold, cell, regr_sxy(r, x) / (regr_sxx(r, x) + 50) AS s, avg(r) AS mr, avg(x) AS mx FROM rw GROUP BY 1, 2)"""
_CELL = f"WITH {_CELL_SQL} SELECT fold, cell, round(s, 5) AS slope, round(mr - s * mx, 5) AS intercept FROM cw"


def two_regimes(spark, sf_dir):
    """Scores of climatology plus cell model with the last observation one (gap 1) and two Decembers back (gap 2)."""
    rows, z, obs, clim = _cell_rows(spark, sf_dir)
    w = R.solve_cells(R.cell_moments(rows, ["x"]), 50.0)
    tests = z.where("role = 'test' and value is not null").select("fold", "ym", "month", "cell", "value", "clim")
    december = clim.where("month = 12").select("fold", "cell", F.col("clim").alias("c"))
    out = None
    for gap in (1, 2):
        own = R.with_last_observation(R.anchored(tests, gap), obs, F.col("lag"))
        out = own if out is None else out.unionByName(own)
    x = F.coalesce(F.col("last") - F.col("c"), F.lit(0.0)).alias("x")
    preds = out.join(december, ["fold", "cell"], "left").select("*", x).join(w, ["fold", "cell"])
    preds = preds.where(F.col("ym") - F.col("lag") >= SPAN[0]).select("gap", F.col("fold").alias("year"), C.clip0(F.col("clim") + R.dot(["x"])).alias("pred"), F.col("value").alias("truth"))
    return yearly_scores(preds, ["gap"]).select("gap", "year", _R("rmse", "rmse", 5), _R("mean_rmse", "mean_rmse", 5))


_GAPS = f"""WITH {_CELL_SQL}, g AS (SELECT unnest([1, 2]) AS gap),
e AS (SELECT gap, z.year, z.ym - (z.ym % 12 + 1 + 12 * (gap - 1)) AS ob, greatest(z.clim + mr - s * mx + s * coalesce(o.value - cl.clim, 0), 0) - z.value AS e FROM z JOIN cw USING (fold, cell) CROSS JOIN g
      LEFT JOIN a o ON o.cell = z.cell AND o.ym = z.ym - (z.ym % 12 + 1 + 12 * (gap - 1)) LEFT JOIN cl ON cl.fold = z.fold AND cl.cell = z.cell AND cl.k = 11 WHERE role = 'test' AND z.value IS NOT NULL AND z.clim IS NOT NULL),
t AS (SELECT CAST(gap AS INTEGER) AS gap, CAST(year AS INTEGER) AS year, sqrt(avg(e ** 2)) AS rmse FROM e WHERE ob >= 23940 AND e IS NOT NULL GROUP BY ALL)
SELECT gap, year, round(rmse, 5) AS rmse, round(avg(rmse) OVER (PARTITION BY gap), 5) AS mean_rmse FROM t"""


def pooled_coefficients(spark, sf_dir):
    """Cell slopes shrunk to the means of the cells' boxes, and smoothed over their neighbourhood, with each shrinkage's relative change."""
    rows = _cell_rows(spark, sf_dir)[0]
    w = R.solve_cells(R.cell_moments(rows, ["x"]), 50.0).select("fold", "cell", F.lit(0).alias("k"), F.col("w")[0].alias("w"))
    inside = S.boxes(spark, [("low", 0, 9, 0, 2), ("left", 0, 4, 0, 4)])
    cells = on_grid(w.select("cell").distinct(), 10).select("cell", F.col("gy").cast("double").alias("lat"), F.col("gx").cast("double").alias("lon"))
    box = R.pooled(w, R.region_weights(w, S.members(cells, inside).select("box", "cell")), 0.6)
    near = S.neighbourhood(on_grid(w, 10), ["fold"], "w").select("fold", "cell", "k", F.col("mean").alias("w"))
    both = w.withColumnRenamed("w", "raw").join(box.withColumnRenamed("w", "box"), ["fold", "cell", "k"]).join(near.withColumnRenamed("w", "near"), ["fold", "cell", "k"])
    change = lambda c: F.sqrt(F.sum(F.pow(F.col(c) - F.col("raw"), 2)) / F.sum(F.pow("raw", 2)))
    changes = both.groupBy("fold").agg(change("box").alias("box_change"), change("near").alias("near_change"))
    return both.join(F.broadcast(changes), "fold").select("fold", "cell", _R("box", "box", 5), _R("near", "near", 5), _R("box_change", "box_change", 5), _R("near_change", "near_change", 5))  # a row for each fold


_POOLED = f"""WITH {_CELL_SQL}, i AS (SELECT DISTINCT box, cell FROM cw, (VALUES ('low', 9, 2), ('left', 4, 4)) b(box, e, n) WHERE cell % 10 <= e AND cell // 10 <= n),
bm AS (SELECT fold, box, avg(s) AS m FROM cw JOIN i USING (cell) GROUP BY 1, 2), cm AS (SELECT fold, i.cell, avg(m) AS m FROM i JOIN bm USING (box) GROUP BY 1, 2),
bx AS (SELECT cw.fold, cw.cell, s, .6 * s + .4 * coalesce(m, avg(s) OVER (PARTITION BY cw.fold)) AS b FROM cw LEFT JOIN cm ON cm.fold = cw.fold AND cm.cell = cw.cell),
nr AS (SELECT x.fold, x.cell, avg(y.s) AS m FROM cw x, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j), cw y WHERE y.fold = x.fold AND y.cell = greatest(0, least(4, x.cell // 10 + i)) * 10 + greatest(0, least(9, x.cell % 10 + j)) GROUP BY 1, 2)
SELECT bx.fold, bx.cell, round(b, 5) AS box, round(m, 5) AS near, round(sqrt(sum((b - s) ** 2) OVER f / sum(s ** 2) OVER f), 5) AS box_change, round(sqrt(sum((m - s) ** 2) OVER f / sum(s ** 2) OVER f), 5) AS near_change
FROM bx JOIN nr USING (fold, cell) WINDOW f AS (PARTITION BY fold)"""


def recursive_forecast(spark, sf_dir):
    """Twelve months in sequence from December 2000, each from the prediction before it, by cell."""
    a = _A(spark, sf_dir)
    clim = C.climatology(a.where(F.col("year").isin(final_fit_years()))).select("month", "cell", "clim")
    after = clim.select((F.col("month") % 12 + 1).alias("month"), "cell", F.col("clim").alias("before"))
    base = clim.join(after, ["month", "cell"], "left").withColumn("base", F.col("clim") - 0.3 * F.coalesce("before", F.lit(0.0)))
    cells = base.groupBy("cell").agg(F.sort_array(F.collect_list(F.struct("month", "base", F.lit(0.0).alias("normal")))).alias("months"))  # twelve a cell
    start = a.where("ym = 24011").select("cell", F.col("value").alias("start"))
    out = R.recursion(cells.join(start, "cell").withColumn("c", F.lit(0.3)), "c", "start", "months")
    return out.select("cell", F.posexplode("path").alias("pos", "pred"), "months").select("cell", F.col("months")[F.col("pos")]["month"].alias("month"), _R("pred", "pred"))


_RECURSIVE = f"""WITH RECURSIVE {PANEL_A_SQL}, c AS (SELECT month, cell, avg(value) AS clim FROM a WHERE year BETWEEN 1995 AND 2000 GROUP BY 1, 2),
bs AS (SELECT x.month, x.cell, x.clim - .3 * coalesce(y.clim, 0) AS base, row_number() OVER (PARTITION BY x.cell ORDER BY x.month) AS k FROM c x LEFT JOIN c y ON y.cell = x.cell AND y.month % 12 + 1 = x.month),
st AS (SELECT cell, value FROM a WHERE ym = 24011),
r AS (SELECT bs.cell, bs.month, k, greatest(base + .3 * value, 0) AS pred FROM bs JOIN st USING (cell) WHERE k = 1
      UNION ALL SELECT bs.cell, bs.month, bs.k, greatest(base + .3 * r.pred, 0) FROM r JOIN bs ON bs.cell = r.cell AND bs.k = r.k + 1)
SELECT cell, month, round(pred, 6) AS pred FROM r"""


def _submission(a, value):
    i = P.make_id(F.col("year"), F.col("month"), F.col("gy") * 0.25 - 60, F.col("gx") * 0.25 - 90)
    return a.select(i.alias("id"), value.alias("value"), "ym", "month", "cell")


_ID_SQL = "printf('%d_%02d_%.2f_%.2f', year, month, gy * 0.25 - 60, gx * 0.25 - 90)"


def blended(spark, sf_dir):
    """Two tables blended 65 to 35, damped to 0.8, inflated to 1.2 in warm months, with 2000 spliced in from the second, and ids."""
    a = panel_a(spark, sf_dir)
    one = _submission(a, F.col("value"))
    two = _submission(a, F.col("price") / 1000).select("id", "value")
    mixed = P.blend([(one.select("id", "value"), 65), (two, 35)]).withColumnRenamed("value", "mixed")
    clim = C.climatology(panel_a(spark, sf_dir)).select("month", "cell", "clim")
    warm = driver_index(spark, sf_dir).select((F.col("ym") + 1).alias("ym"), G.phase(F.col("x")).alias("phase"))
    t = one.join(mixed, "id").join(clim, ["month", "cell"]).join(F.broadcast(warm), "ym", "left")
    gamma = F.when(F.coalesce("phase", F.lit(0)) == 1, 1.2).otherwise(0.8)
    inflated = t.select("id", P.damp(F.col("mixed"), F.col("clim"), gamma).alias("value"))
    return P.splice(inflated, two, 2000).select("id", _R("value", "value"))


_BLENDED = f"""WITH {PANEL_A_SQL}, {INDEX_SQL}, c AS (SELECT month, cell, avg(value) AS clim FROM a GROUP BY 1, 2),
t AS (SELECT {_ID_SQL} AS id, year, clim, .65 * value + .35 * price / 1000 AS m, price / 1000 AS two, CASE WHEN x >= .5 THEN 1.2 ELSE .8 END AS g FROM a JOIN c USING (month, cell) LEFT JOIN idx ON idx.ym = a.ym - 1)
SELECT id, round(CASE WHEN year = 2000 THEN two ELSE greatest(clim + g * (m - clim), 0) END, 6) AS value FROM t"""


def weight_gamma_sweep(spark, sf_dir):
    """RMSE over blend weights and damping, by lag bucket and in total, from one pass over the predictions."""
    b = panel_a(spark, sf_dir).join(C.climatology(panel_a(spark, sf_dir)).select("month", "cell", "clim"), ["month", "cell"])
    t = b.withColumn("lags", F.when(F.col("month") <= 6, "1-6").otherwise("7-12"))
    t = t.withColumn("w", F.explode(F.array(*map(F.lit, (0.5, 0.65))))).withColumn("gamma", F.explode(F.array(*map(F.lit, (0.8, 1.0, 1.1)))))
    pred = P.damp(F.col("w") * F.col("clim") + (1 - F.col("w")) * F.col("price") / 1000, F.col("clim"), F.col("gamma"))
    s = t.select("w", "gamma", "lags", F.pow(pred - F.col("value"), 2).alias("e")).groupBy("w", "gamma", "lags").agg(F.sum("e").alias("e"), F.count("e").alias("n"))
    s = s.rollup("w", "gamma", "lags").agg(F.sqrt(F.sum("e") / F.sum("n")).alias("rmse")).where("gamma is not null")
    return s.select("w", "gamma", F.coalesce("lags", F.lit("all")).alias("lags"), _R("rmse", "rmse"))


_SWEEP = f"""WITH {PANEL_A_SQL}, c AS (SELECT month, cell, avg(value) AS clim FROM a GROUP BY 1, 2),
t AS (SELECT CAST(w AS DOUBLE) AS w, CAST(gamma AS DOUBLE) AS gamma, CASE WHEN month <= 6 THEN '1-6' ELSE '7-12' END AS lags, (greatest(clim + gamma * (w * clim + (1 - w) * price / 1000 - clim), 0) - value) ** 2 AS e
      FROM a JOIN c USING (month, cell), (VALUES (.5), (.65)) x(w), (VALUES (.8), (1.0), (1.1)) y(gamma))
SELECT w, gamma, coalesce(lags, 'all') AS lags, round(sqrt(avg(e)), 6) AS rmse FROM t GROUP BY GROUPING SETS ((w, gamma, lags), (w, gamma))"""


def validation(spark, sf_dir):
    """The validator on a good table, one with a gap, one with a negative value and one in another order, of all months."""
    a = panel_a(spark, sf_dir)
    good = _submission(a, F.col("value")).withColumn("row_id", (F.col("ym") * 100 + F.col("cell")).cast("bigint")).select("row_id", "id", "value")
    cases = {
        "good": good, "gap": good.withColumn("value", F.when(F.col("row_id") % 7 != 0, F.col("value"))), "short": good.where("row_id % 7 <> 0"),
        "negative": good.withColumn("value", F.when(F.col("row_id") % 7 == 0, -1.0).otherwise(F.col("value"))), "moved": good.withColumn("row_id", F.col("row_id") + 1),
    }
    out = None
    for name, df in cases.items():
        one = P.validate(df, good.select("row_id", "id")).select(F.lit(name).alias("case"), "*")
        out = one if out is None else out.unionByName(one)
    return out


_VALIDATION = f"""WITH {PANEL_A_SQL}, g AS (SELECT ym * 100 + cell AS row_id, {_ID_SQL} AS id, value FROM a),
c AS (SELECT 'good' AS "case", row_id, id, value FROM g UNION ALL SELECT 'gap', row_id, id, CASE WHEN row_id % 7 <> 0 THEN value END FROM g UNION ALL SELECT 'short', row_id, id, value FROM g WHERE row_id % 7 <> 0
      UNION ALL SELECT 'negative', row_id, id, CASE WHEN row_id % 7 = 0 THEN -1 ELSE value END FROM g UNION ALL SELECT 'moved', row_id + 1, id, value FROM g),
f AS (SELECT k."case", c.id AS got, g.id AS want, c.value FROM (SELECT DISTINCT "case" FROM c) k CROSS JOIN g LEFT JOIN c ON c."case" = k."case" AND c.row_id = g.row_id
      UNION ALL SELECT "case", id, NULL, value FROM c WHERE row_id NOT IN (SELECT row_id FROM g)),
r AS (SELECT "case", count(got) = count(want) AS rows_ok, count(*) FILTER (got IS DISTINCT FROM want) = 0 AS ids_ok, count(*) FILTER (got IS NOT NULL AND value IS NULL) = 0 AS no_missing, coalesce(min(value) >= 0, true) AS non_negative FROM f GROUP BY 1)
SELECT "case", true AS columns_ok, rows_ok, ids_ok, no_missing, non_negative, rows_ok AND ids_ok AND no_missing AND non_negative AS valid FROM r"""


def oof_store(spark, sf_dir):
    """Out-of-fold predictions written by method and fold, one fold written again, and read back."""
    a, folds = _A(spark, sf_dir), loyo_folds(spark)
    clim = C.fold_climatology(a, folds)
    preds = a.withColumn("fold", F.col("year")).join(clim.where("n > 0"), ["fold", "month", "cell"]).select("ym", "cell", F.col("clim").alias("pred"), "fold")
    folder = f"{tables.shared_folder(spark)}/oof-{uuid.uuid4().hex}"
    for via, scale in (("clim", 1.0), ("half", 0.5)):
        tables.save_oof(preds.withColumn("pred", F.col("pred") * scale), folder, via)
    tables.save_oof(preds.where("fold = 1997").withColumn("pred", F.lit(0.0)), folder, "half")
    return tables.load_oof(spark, folder).groupBy("via", "fold").agg(F.count("*").alias("n"), _R(F.avg("pred"), "pred"))


_OOF = f"""WITH {PANEL_A_SQL}, {CLIM_SQL}, p AS (SELECT fold, clim FROM a JOIN clim ON fold = a.year AND clim.month = a.month AND clim.cell = a.cell)
SELECT via, fold, count(*) AS n, round(avg(CASE WHEN via = 'half' AND fold = 1997 THEN 0 ELSE clim * s END), 6) AS pred FROM p, (VALUES ('clim', 1.0), ('half', .5)) v(via, s) GROUP BY 1, 2"""


def month_sample(spark, sf_dir):
    """Seven cells of every month, by an arithmetic hash."""
    a = panel_a(spark, sf_dir)
    r = F.row_number().over(W.partitionBy("ym").orderBy((F.col("cell").cast("bigint") * 7919 + F.col("ym").cast("bigint") * 104729) % 65537, "cell"))
    return a.withColumn("r", r).where("r <= 7").select("ym", "cell", F.col("r").cast("bigint").alias("r"))


_SAMPLE = f"""WITH {PANEL_A_SQL}, s AS (SELECT ym, cell, row_number() OVER (PARTITION BY ym ORDER BY (cell * 7919 + CAST(ym AS BIGINT) * 104729) % 65537, cell) AS r FROM a) SELECT ym, cell, r FROM s WHERE r <= 7"""

QUERIES = {f.__name__: f for f in (phase_composites, offset_scores, shared_ridge, winsorized_ridge, cell_ridge, two_regimes, pooled_coefficients, recursive_forecast, blended, weight_gamma_sweep, validation, oof_store, month_sample)}
ORACLES = dict(zip(QUERIES, (_COMPOSITES, _OFFSETS, _SHARED_RIDGE, _WINSORIZED, _CELL, _GAPS, _POOLED, _RECURSIVE, _BLENDED, _SWEEP, _VALIDATION, _OOF, _SAMPLE), strict=True))
