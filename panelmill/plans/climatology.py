"""Queries: climatologies, anomalies and their scores."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.operators import climatology as C
from panelmill.operators.evaluate import rmse, yearly_scores
from panelmill.panel import FOLDS_SQL, HOLDOUT, INDEX_SQL, PANEL_A_SQL, PANEL_B_SQL, YEARS, driver_index, final_fit_years, loyo_folds, panel_a, panel_b

BIG = "WITH"
_R = lambda c, name, k=6: F.round(c, k).alias(name)


def clim_rmse_loyo(spark, sf_dir):
    """Leave-one-year-out score of the climatology: one row per tested year, with the mean of the yearly scores."""
    a, folds = panel_a(spark, sf_dir), loyo_folds(spark)
    clim = C.fold_climatology(a.select("year", "month", "cell", "value"), folds)
    tests = a.join(F.broadcast(folds.where("role = 'test'")), "year")
    preds = tests.join(clim, ["fold", "month", "cell"], "left").select("year", F.col("clim").alias("pred"), F.col("value").alias("truth"))
    return yearly_scores(preds).select("year", F.col("n").cast("bigint").alias("n"), _R("rmse", "rmse"), _R("mean_rmse", "mean_rmse"))


CLIM_SQL = f"""{FOLDS_SQL},
clim AS (SELECT fold, month, cell, count(value) AS n, avg(value) AS clim, stddev_pop(value) AS sigma
         FROM a JOIN folds USING (year) WHERE role = 'train' GROUP BY 1, 2, 3)"""

_LOYO = f"""{BIG} {PANEL_A_SQL}, {CLIM_SQL},
s AS (SELECT a.year, count(clim) AS n, sqrt(avg((clim - value) ** 2)) AS rmse FROM a JOIN yrs USING (year) LEFT JOIN clim ON fold = a.year AND clim.month = a.month AND clim.cell = a.cell GROUP BY 1)
SELECT year, n, round(rmse, 6) AS rmse, round(avg(rmse) OVER (), 6) AS mean_rmse FROM s"""


def climatology_by_fold(spark, sf_dir):
    """fold, month, cell, n, clim, sigma of every fold, by subtracting banned years from totals."""
    out = C.fold_climatology(panel_a(spark, sf_dir).select("year", "month", "cell", "value"), loyo_folds(spark))
    return out.where("n > 0").select("fold", "month", "cell", F.col("n").cast("bigint").alias("n"), _R("clim", "clim"), _R("sigma", "sigma"))


_BY_FOLD = f"{BIG} {PANEL_A_SQL}, {CLIM_SQL} SELECT fold, month, cell, n, round(clim, 6) AS clim, round(sigma, 6) AS sigma FROM clim"


def climatology_trend(spark, sf_dir):
    """Linear trend by month and cell over the training years, and what it predicts for the year held out."""
    a = panel_a(spark, sf_dir)
    t = C.trend_climatology(a.where(F.col("year").isin(final_fit_years())))
    return t.select("month", "cell", F.col("n").cast("bigint").alias("n"), _R("slope", "slope"), _R("sigma", "sigma"), _R(C.clip0(F.col("intercept") + F.col("slope") * HOLDOUT[0]), "pred"))


_TREND = f"""{BIG} {PANEL_A_SQL},
t AS (SELECT month, cell, count(*) AS n, CASE WHEN regr_sxx(value, year) > 0 THEN regr_slope(value, year) ELSE 0 END AS slope, avg(value) AS m, avg(year) AS y,
      CASE WHEN regr_sxx(value, year) > 0 THEN regr_syy(value, year) - regr_sxy(value, year) ** 2 / regr_sxx(value, year) ELSE 0 END AS rest FROM a WHERE year BETWEEN {YEARS[0]} AND {YEARS[-1]} GROUP BY 1, 2)
SELECT month, cell, n, round(slope, 6) AS slope, round(sqrt(greatest(rest, 0) / n), 6) AS sigma, round(greatest(m + slope * ({HOLDOUT[0]} - y), 0), 6) AS pred FROM t"""


def climatology_recent(spark, sf_dir):
    """Scores of climatologies over the last 2, 3 and all training years of each fold."""
    a, folds = panel_a(spark, sf_dir).select("year", "month", "cell", "value"), loyo_folds(spark)
    wide = None
    for n in (2, 3, 99):
        w = C.recent_years(folds, n).withColumn("window", F.lit(n))
        wide = w if wide is None else wide.unionByName(w)
    clim = a.join(F.broadcast(wide), "year").groupBy("window", "fold", "month", "cell").agg(F.avg("value").alias("clim"))
    preds = a.withColumnRenamed("year", "fold").join(clim, ["fold", "month", "cell"]).select("window", F.col("fold").alias("year"), F.col("clim").alias("pred"), F.col("value").alias("truth"))
    return yearly_scores(preds, ["window"]).select("window", "year", _R("rmse", "rmse"), _R("mean_rmse", "mean_rmse"))


_RECENT = f"""{BIG} {PANEL_A_SQL}, {FOLDS_SQL},
r AS (SELECT fold, year, dense_rank() OVER (PARTITION BY fold ORDER BY year DESC) AS k FROM folds WHERE role = 'train'),
w AS (SELECT unnest([2, 3, 99]) AS "window"),
c AS (SELECT "window", fold, month, cell, avg(value) AS clim FROM a JOIN r USING (year) JOIN w ON k <= "window" GROUP BY ALL),
s AS (SELECT "window", a.year, sqrt(avg((clim - value) ** 2)) AS rmse FROM a JOIN c ON fold = a.year AND c.month = a.month AND c.cell = a.cell GROUP BY ALL)
SELECT "window", year, round(rmse, 6) AS rmse, round(avg(rmse) OVER (PARTITION BY "window"), 6) AS mean_rmse FROM s"""


def climatology_zscore(spark, sf_dir):
    """Climatology of all years and each value's z-score; null without deviation."""
    a = panel_a(spark, sf_dir)
    out = a.join(C.climatology(a), ["month", "cell"])
    return out.select("ym", "cell", _R("clim", "clim"), _R(C.zscore(F.col("value"), F.col("clim"), F.when(F.col("n") > 1, F.col("sigma"))), "z", 4))


_ZSCORE = f"""{BIG} {PANEL_A_SQL},
c AS (SELECT month, cell, count(*) AS n, avg(value) AS clim, stddev_pop(value) AS sigma FROM a GROUP BY 1, 2)
SELECT ym, cell, round(clim, 6) AS clim, round(CASE WHEN n > 1 AND sigma > 0 THEN (value - clim) / sigma END, 4) AS z FROM a JOIN c USING (month, cell)"""


def persistence_rmse(spark, sf_dir):
    """Scores by month of predicting last month's value: the month before, not the row before."""
    b = panel_b(spark, sf_dir).select("ym", "cell", "value")
    before = b.select((F.col("ym") + 1).alias("ym"), "cell", F.col("value").alias("pred"))
    scores = b.join(before, ["ym", "cell"]).groupBy("ym").agg(rmse(F.col("pred"), F.col("value")).alias("rmse"))
    return scores.select("ym", _R("rmse", "rmse", 3), _R(F.avg("rmse").over(W.partitionBy()), "mean_rmse", 3))


_PERSISTENCE = f"""{BIG} {PANEL_B_SQL}, s AS (SELECT x.ym, sqrt(avg((y.value - x.value) ** 2)) AS rmse FROM b x JOIN b y ON y.ym = x.ym - 1 AND y.cell = x.cell GROUP BY 1)
SELECT ym, round(rmse, 3) AS rmse, round(avg(rmse) OVER (), 3) AS mean_rmse FROM s"""


def rmse_by_regime(spark, sf_dir):
    """The climatology's scores by tested year and the driver's phase, as columns, with the mean of the phases."""
    a, folds = panel_a(spark, sf_dir), loyo_folds(spark)
    phase = driver_index(spark, sf_dir).select("ym", F.when(F.col("x") >= 0.5, "warm").when(F.col("x") <= -0.5, "cold").otherwise("neutral").alias("regime"))
    clim = C.fold_climatology(a.select("year", "month", "cell", "value"), folds)
    preds = a.withColumn("fold", F.col("year")).join(clim, ["fold", "month", "cell"]).join(F.broadcast(phase), "ym")
    scores = preds.groupBy("year", "regime").agg(rmse(F.col("clim"), F.col("value")).alias("rmse"))
    wide = scores.groupBy("year").pivot("regime", ["cold", "neutral", "warm"]).agg(F.first("rmse"))
    return wide.select("year", *[_R(c, c) for c in ("cold", "neutral", "warm")])


_REGIME = f"""{BIG} {PANEL_A_SQL}, {CLIM_SQL}, {INDEX_SQL},
p AS (SELECT a.year, CASE WHEN x >= .5 THEN 'warm' WHEN x <= -.5 THEN 'cold' ELSE 'neutral' END AS regime, (clim - value) ** 2 AS e
      FROM a JOIN clim ON fold = a.year AND clim.month = a.month AND clim.cell = a.cell JOIN idx USING (ym))
SELECT year, round(sqrt(avg(e) FILTER (regime = 'cold')), 6) AS cold, round(sqrt(avg(e) FILTER (regime = 'neutral')), 6) AS neutral, round(sqrt(avg(e) FILTER (regime = 'warm')), 6) AS warm FROM p GROUP BY 1"""


def rmse_by_month(spark, sf_dir):
    """The climatology's scores by calendar month, pooled over the folds."""
    a, folds = panel_a(spark, sf_dir), loyo_folds(spark)
    clim = C.fold_climatology(a.select("year", "month", "cell", "value"), folds)
    preds = a.withColumn("fold", F.col("year")).join(clim, ["fold", "month", "cell"])
    return preds.groupBy("month").agg(_R(rmse(F.col("clim"), F.col("value")), "rmse"), F.count("clim").alias("n"))


_BY_MONTH = f"{BIG} {PANEL_A_SQL}, {CLIM_SQL} SELECT a.month, round(sqrt(avg((clim - value) ** 2)), 6) AS rmse, count(clim) AS n FROM a JOIN clim ON fold = a.year AND clim.month = a.month AND clim.cell = a.cell GROUP BY 1"


def loo_anomalies(spark, sf_dir):
    """Leave-one-out anomalies by the window form and by the form from stored sums."""
    a = panel_a(spark, sf_dir)
    one = C.loo_anomaly(a).select("ym", "cell", _R("anomaly", "anomaly"))
    two = C.loo_anomaly_scaled(a).select("ym", "cell", _R("anomaly", "scaled"))
    return one.join(two, ["ym", "cell"])


_LOO = f"""{BIG} {PANEL_A_SQL}, o AS (SELECT x.ym, x.cell, x.value - avg(y.value) AS d FROM a x LEFT JOIN a y ON y.month = x.month AND y.cell = x.cell AND y.year <> x.year GROUP BY x.ym, x.cell, x.value)
SELECT ym, cell, round(d, 6) AS anomaly, round(d, 6) AS scaled FROM o"""


def base_period_index(spark, sf_dir):
    """Monthly means of two part-size boxes as anomalies from the means of a fixed base period, and their difference."""
    a = panel_a(spark, sf_dir)
    m = a.groupBy("ym", "year", "month").agg(F.avg(F.when(F.col("gx") < 5, F.col("value"))).alias("west"), F.avg(F.when(F.col("gx") >= 5, F.col("value"))).alias("east"))
    w = W.partitionBy("month")
    out = [(F.col(c) - F.avg(F.when(F.col("year").between(1995, 1998), F.col(c))).over(w)).alias(c) for c in ("west", "east")]
    return m.select("ym", *out).select("ym", _R("west", "west"), _R("east", "east"), _R(F.col("west") - F.col("east"), "west_east"))


_BASE = f"""{BIG} {PANEL_A_SQL}, m AS (SELECT ym, year, month, avg(value) FILTER (gx < 5) AS w, avg(value) FILTER (gx >= 5) AS e FROM a GROUP BY 1, 2, 3),
d AS (SELECT ym, w - avg(w) FILTER (year BETWEEN 1995 AND 1998) OVER (PARTITION BY month) AS w, e - avg(e) FILTER (year BETWEEN 1995 AND 1998) OVER (PARTITION BY month) AS e FROM m)
SELECT ym, round(w, 6) AS west, round(e, 6) AS east, round(w - e, 6) AS west_east FROM d"""

QUERIES = {f.__name__: f for f in (clim_rmse_loyo, climatology_by_fold, climatology_trend, climatology_recent, climatology_zscore, persistence_rmse, rmse_by_regime, rmse_by_month, loo_anomalies, base_period_index)}
ORACLES = dict(zip(QUERIES, (_LOYO, _BY_FOLD, _TREND, _RECENT, _ZSCORE, _PERSISTENCE, _REGIME, _BY_MONTH, _LOO, _BASE), strict=True))
