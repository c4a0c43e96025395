"""Queries: two-stage models by their coefficients, pooled, recursive, with forecasts, at unit deviations, and from a stored panel."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from panelmill.operators import climatology as C
from panelmill.operators import regime as G
from panelmill.operators import twostage as Q
from panelmill.operators.evaluate import grid_scores, grid_sums, rmse
from panelmill.panel import driver_index, loyo_folds, panel_a, with_calendar
from panelmill.plans.models import SPAN
from panelmill.plans.stages import _PAIR, _RUNS_SQL, HISTORY, PAIR, RIDGES, YEARS, _months, _runs, _scores, _stage2, _stage2_sql
from panelmill.sources import store, tables

_R = lambda c, name, k=5: (F.round(c, k) + 0.0).alias(name)  # noqa: E731  no negative zero
SHAPE = (5, 10)
ALPHA, REGIONAL = 0.6, 0.7
BOXES = [("low", 0, 9, 0, 2), ("left", 0, 4, 0, 4)]
HINDCAST = 1999


def _ledger(spark, rows, t, model):
    """The blocks' moments, written once."""
    folder = f"{tables.shared_folder(spark)}/ledger-{uuid.uuid4().hex}"
    Q.ledger(rows, t, model).write.parquet(folder)
    return spark.read.parquet(folder)


def _fitted(spark, sf_dir, model=PAIR):
    """The panel, its months, and the cells' coefficients."""
    rows, _ = _stage2(spark, sf_dir, ["price"])
    t = _months(spark, sf_dir, rows, loyo_folds(spark))
    return rows, t, Q.coefficients(_ledger(spark, rows, t, model), t, model)


def _pooled(weights):
    lat, lon = F.floor(F.col("cell") / SHAPE[1]).cast("double"), (F.col("cell") % SHAPE[1]).cast("double")
    return Q.pooled(weights, len(PAIR.columns), SHAPE, ALPHA, REGIONAL, BOXES, lat, lon, intercept=False)


def two_stage_coefficients(spark, sf_dir):
    """Each cell's coefficients of the second stage, and the same shrunk to the neighbourhood and to boxes, all but the intercept."""
    _, _, w = _fitted(spark, sf_dir)
    both = w.join(_pooled(w).withColumnRenamed("w", "p"), ["fold", "cell"])
    names = ["price", "last", "intercept"]
    return both.select("fold", "cell", *[_R(F.col("w")[k], n) for k, n in enumerate(names)], *[_R(F.col("p")[k], f"{n}_pooled") for k, n in enumerate(names)])


_POOLED_CTE = f"""cf AS (SELECT fold, cell, wx, wy, mr - wx * mx - wy * my AS wi FROM w2),
i AS (SELECT DISTINCT box, cell FROM cf, (VALUES ('low', 9, 2), ('left', 4, 4)) b(box, e, n) WHERE cell % 10 <= e AND cell // 10 <= n),
bm AS (SELECT fold, box, avg(wx) AS x, avg(wy) AS y FROM cf JOIN i USING (cell) GROUP BY 1, 2), cm AS (SELECT fold, i.cell, avg(x) AS x, avg(y) AS y FROM i JOIN bm USING (box) GROUP BY 1, 2),
al AS (SELECT fold, avg(wx) AS x, avg(wy) AS y FROM cf GROUP BY 1),
nr AS (SELECT a1.fold, a1.cell, avg(a2.wx) AS x, avg(a2.wy) AS y FROM cf a1, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j), cf a2
       WHERE a2.fold = a1.fold AND a2.cell = greatest(0, least(4, a1.cell // 10 + i)) * 10 + greatest(0, least(9, a1.cell % 10 + j)) GROUP BY 1, 2),
pw AS (SELECT cf.fold, cf.cell, wx, wy, wi, {REGIONAL} * ({ALPHA} * wx + {1 - ALPHA} * nr.x) + {1 - REGIONAL} * coalesce(cm.x, al.x) AS px, {REGIONAL} * ({ALPHA} * wy + {1 - ALPHA} * nr.y) + {1 - REGIONAL} * coalesce(cm.y, al.y) AS py
       FROM cf JOIN nr USING (fold, cell) JOIN al USING (fold) LEFT JOIN cm ON cm.fold = cf.fold AND cm.cell = cf.cell)"""
_COEFFICIENTS = f"""WITH {_stage2_sql()}, {_POOLED_CTE}
SELECT CAST(fold AS INTEGER) AS fold, cell, round(wx, 5) + 0.0 AS price, round(wy, 5) + 0.0 AS "last", round(wi, 5) + 0.0 AS intercept, round(px, 5) + 0.0 AS price_pooled, round(py, 5) + 0.0 AS last_pooled, round(wi, 5) + 0.0 AS intercept_pooled FROM pw"""


def two_stage_pooled(spark, sf_dir):
    """Scores of the two-stage model by its pooled coefficients, under both gaps."""
    rows, t, w = _fitted(spark, sf_dir)
    return _scores(Q.predict(rows, _pooled(w), t, PAIR))


_SCORED = """t AS (SELECT CAST(gap AS INTEGER) AS gap, CAST(year AS INTEGER) AS year, sqrt(avg((one - value) ** 2)) AS rmse_first, sqrt(avg((two - value) ** 2)) AS rmse FROM e GROUP BY ALL)
SELECT gap, year, round(rmse_first, 5) AS rmse_first, round(rmse, 5) AS rmse, round(avg(rmse) OVER (PARTITION BY gap), 5) AS mean_rmse FROM t"""


def _tests_sql(weights: str, local: str, corr: str) -> str:
    """e: both stages' predictions of the tested months under both gaps."""
    return f"""e AS (SELECT gap, s1.fold AS year, s1.value, greatest(base, 0) AS one, greatest(base + {corr}, 0) AS two
      FROM s1 JOIN {weights} USING (fold, cell) CROSS JOIN (SELECT unnest([1, 2]) AS gap) LEFT JOIN {local} LEFT JOIN ob ON ob.cell = s1.cell AND ob.ym = s1.ym - (s1.ym % 12 + 1 + 12 * (gap - 1))
      WHERE role = 'test' AND s1.ym - (s1.ym % 12 + 1 + 12 * (gap - 1)) >= {SPAN[0]} AND s1.value IS NOT NULL AND base IS NOT NULL)"""


_LP = "lp ON lp.ym = s1.ym AND lp.cell = s1.cell"
_MEANS = "mr + wx * (coalesce(lp.p, 0) - mx) + wy * (coalesce(ob.o, 0) - my)"
_POOLED_SCORES = f"WITH {_stage2_sql()}, {_POOLED_CTE}, {_tests_sql('pw', _LP, 'wi + px * coalesce(lp.p, 0) + py * coalesce(ob.o, 0)')}, {_SCORED}"


def two_stage_recursion(spark, sf_dir):
    """Scores by position of 24 months in sequence through the two-stage model: twelve from an observed December, twelve from the prediction before them."""
    rows, t, w = _fitted(spark, sf_dir)
    chain = Q.recursive(rows, w, t, PAIR).where("position > 12 and value is not null and pred is not null")
    return chain.groupBy(F.col("fold").alias("year"), "position").agg(_R(rmse(F.col("pred"), F.col("value")), "rmse"), F.count("*").alias("n"))


_RECURSION = f"""WITH RECURSIVE {_stage2_sql()}, cf AS (SELECT fold, cell, wx, wy, mr - wx * mx - wy * my AS wi FROM w2),
bs AS (SELECT s1.fold, s1.cell, s1.ym, s1.value, base, coalesce(lp.p, 0) AS p, s1.ym - ((s1.fold - 2) * 12 + 11) AS k, coalesce(ob.o, 0) AS o, wx, wy, wi, ps.c
       FROM s1 JOIN cf USING (fold, cell) LEFT JOIN {_LP} LEFT JOIN ob ON ob.cell = s1.cell AND ob.ym = (s1.fold - 2) * 12 + 11 LEFT JOIN ps ON ps.cell = s1.cell AND ps.month = (s1.ym - 1) % 12 + 1
       WHERE s1.fold - 2 >= {YEARS[0]} AND s1.ym BETWEEN (s1.fold - 1) * 12 AND s1.fold * 12 + 11),
r AS (SELECT fold, cell, k, CASE WHEN base IS NOT NULL THEN greatest(base + wi + wx * p + wy * o, 0) END AS pred FROM bs WHERE k = 1
      UNION ALL SELECT b.fold, b.cell, b.k, CASE WHEN b.base IS NOT NULL THEN greatest(b.base + b.wi + b.wx * b.p + b.wy * CASE WHEN b.k <= 12 THEN b.o ELSE coalesce(r.pred - b.c, 0) END, 0) END
      FROM r JOIN bs b ON b.fold = r.fold AND b.cell = r.cell AND b.k = r.k + 1)
SELECT CAST(r.fold AS INTEGER) AS year, CAST(r.k AS INTEGER) AS position, round(sqrt(avg((pred - value) ** 2)), 5) AS rmse, count(*) AS n FROM r JOIN bs ON bs.fold = r.fold AND bs.cell = r.cell AND bs.k = r.k
WHERE r.k > 12 AND value IS NOT NULL AND pred IS NOT NULL GROUP BY ALL"""


def two_stage_forecast(spark, sf_dir):
    """Scores of the two-stage model on the last observation and a dynamical forecast, debiased by each fold's own training years."""
    rows, _ = _stage2(spark, sf_dir, ["price"])
    runs = _runs(spark, sf_dir).select((F.col("ym") + 1).alias("ym"), "cell", F.col("value").alias("f"))  # a start forecasts the month after it
    both = rows.select("ym", "cell", "value").join(runs, ["ym", "cell"], "full")
    model = Q.Model(RIDGES, (), ("last",), "f", HINDCAST, HISTORY)
    return _scores(Q.two_stage(both, _months(spark, sf_dir, both, loyo_folds(spark)), model))


_FX = "fx lp ON lp.fold = s1.fold AND lp.ym = s1.ym AND lp.cell = s1.cell"
_FX_SQL = f"""{_RUNS_SQL}, mn AS (SELECT fold, ym % 12 AS k, cell, avg(v) AS m FROM en JOIN folds ON year = ym // 12 WHERE role = 'train' AND year <= {HINDCAST} GROUP BY ALL),
fx AS (SELECT fold, ym + 1 AS ym, en.cell, v - m AS p FROM en JOIN mn ON mn.k = ym % 12 AND mn.cell = en.cell),
t2 AS"""
_FORECAST = f"WITH {_stage2_sql().replace(_LP, _FX).replace('t2 AS', _FX_SQL, 1)}, {_tests_sql('w2', _FX, _MEANS)}, {_SCORED}"


def two_stage_deviations(spark, sf_dir):
    """Scores of the two-stage model whose second penalty counts columns at unit deviation over all training months and cells of the fold."""
    model = Q.Model(RIDGES, PAIR.local, PAIR.observed, history=HISTORY, standardise=True)
    rows, t, w = _fitted(spark, sf_dir, model)
    return _scores(Q.predict(rows, w, t, model))


_DEVIATIONS = f"""WITH {_stage2_sql().replace(f"regr_sxx(r, x) + {RIDGES[1]}", f"regr_sxx(r, x) + {RIDGES[1]} * any_value(vx)").replace(f"regr_sxx(r, y) + {RIDGES[1]}", f"regr_sxx(r, y) + {RIDGES[1]} * any_value(vy)").replace(
    "FROM t2 GROUP BY 1, 2", "FROM t2 JOIN (SELECT fold, var_pop(x) AS vx, var_pop(y) AS vy FROM t2 GROUP BY 1) USING (fold) GROUP BY 1, 2")}, {_tests_sql('w2', _LP, _MEANS)}, {_SCORED}"""


def two_stage_stored(spark, sf_dir):
    """The two-stage model from a panel that is stored by blocks of cells: fit and prediction without a shuffle of the panel."""
    rows, _ = _stage2(spark, sf_dir, ["price"])
    key = uuid.uuid4().hex
    store.save_blocks(rows, f"panel_{key}", f"{tables.shared_folder(spark)}/panel-{key}", 1)  # fifty cells are one block
    kept = store.load_blocks(spark, f"panel_{key}", ["value", "price_a"])
    return _scores(Q.two_stage(kept, _months(spark, sf_dir, kept, loyo_folds(spark)), PAIR))


#: Weights of the first stage, inflation, and offsets with their thresholds, in the order in which ties are settled.
WEIGHTS, GAMMAS, OFFSETS = (0.5, 0.65, 0.8, 1.0), (0.9, 1.0, 1.1, 1.2), ((0.0, 0.8), (0.25, 0.5), (0.25, 0.8), (0.33, 0.8))
GRID = [{"w": w, "gamma": g, "beta": b, "thr": t} for w in WEIGHTS for g in GAMMAS for b, t in OFFSETS]


def _stored_preds(spark, sf_dir):
    """Predictions of every fold under both gaps, written once and read from there."""
    rows, _ = _stage2(spark, sf_dir, ["price"])
    folder = f"{tables.shared_folder(spark)}/preds-{uuid.uuid4().hex}"
    store.save_preds(Q.two_stage(rows, _months(spark, sf_dir, rows, loyo_folds(spark)), PAIR), folder)
    return store.load_preds(spark, folder)


def _swept(spark, sf_dir, preds):
    """Squared errors of the whole grid by gap, fold, lag and phase: the one pass over the predictions that all sweeps share."""
    thresholds = sorted({t for _, t in OFFSETS})
    phases = G.origin_phases(driver_index(spark, sf_dir), thresholds)
    comp = G.composites(panel_a(spark, sf_dir).select("ym", "year", "month", "cell", "value"), phases, loyo_folds(spark), ["thr"])
    own = lambda t, p: F.max(F.when((F.col("thr") == t) & (F.col("phase") == p), F.col("comp"))).alias(f"comp_{t}_{p}".replace(".", ""))
    wide = comp.groupBy("fold", "month", "cell").agg(*[own(t, p) for t in thresholds for p in (1, -1)])
    months = phases.groupBy("ym").agg(*[F.max(F.when(F.col("thr") == t, F.col("phase"))).alias(f"phase_{t}".replace(".", "")) for t in thresholds])
    rows = with_calendar(preds.where("value is not null and base is not null")).join(F.broadcast(months), "ym", "left").join(wide, ["fold", "month", "cell"], "left")  # a row for each month

    def offset(beta, t):
        name = f"{t}".replace(".", "")
        comp = F.when(F.col(f"phase_{name}") == 1, F.col(f"comp_{name}_1")).when(F.col(f"phase_{name}") == -1, F.col(f"comp_{name}_-1"))
        return G.offset(comp, F.col("clim"), beta)

    one, two = C.clip0(F.col("base")), C.clip0(F.col("base") + F.col("corr"))
    made = [C.clip0(F.col("clim") + g["gamma"] * (g["w"] * one + (1 - g["w"]) * two - F.col("clim")) + offset(g["beta"], g["thr"])) for g in GRID]
    rows = rows.withColumn("phase", F.coalesce("phase_08", F.lit(0)))
    return grid_sums(rows, ["gap", "fold", "lag", "phase"], F.col("value"), made)


def prediction_sweeps(spark, sf_dir):
    """RMSE over weight, inflation, offset and threshold, in all, by phase, by lag bucket, by lag and by year, with the best of each: one store, one pass."""
    sums = _swept(spark, sf_dir, _stored_preds(spark, sf_dir))
    folder = f"{tables.shared_folder(spark)}/sums-{uuid.uuid4().hex}"
    sums.write.parquet(folder)
    sums = spark.read.parquet(folder)
    bucket = F.floor((F.col("lag") - 1) / 6)
    parts = {"all": F.lit("all"), "phase": F.col("phase").cast("string"), "bucket": F.concat((bucket * 6 + 1).cast("string"), F.lit("-"), (bucket * 6 + 6).cast("string")), "lag": F.col("lag").cast("string"), "year": F.col("fold").cast("string")}
    out = None
    for name, key in parts.items():
        one = grid_scores(sums.withColumn("part", F.lit(name)).withColumn("key", key), ["gap", "part", "key"], GRID)
        out = one if out is None else out.unionByName(one)
    return out.select("gap", "part", "key", "w", "gamma", "beta", "thr", _R("rmse", "rmse"), "best")


_GRID_ROWS = ", ".join(str((k, *g.values())) for k, g in enumerate(GRID))
_SWEEPS = f"""WITH {_stage2_sql()}, p AS (SELECT gap, s1.fold, s1.ym, s1.cell, s1.ym % 12 + 1 + 12 * (gap - 1) AS lag, s1.value, s1.clim, base, {_MEANS} AS corr
      FROM s1 JOIN w2 USING (fold, cell) CROSS JOIN (SELECT unnest([1, 2]) AS gap) LEFT JOIN {_LP} LEFT JOIN ob ON ob.cell = s1.cell AND ob.ym = s1.ym - (s1.ym % 12 + 1 + 12 * (gap - 1))
      WHERE role = 'test' AND s1.ym - (s1.ym % 12 + 1 + 12 * (gap - 1)) >= {SPAN[0]} AND s1.value IS NOT NULL AND base IS NOT NULL),
g AS (SELECT k, CAST(w AS DOUBLE) AS w, CAST(gamma AS DOUBLE) AS gamma, CAST(beta AS DOUBLE) AS beta, CAST(thr AS DOUBLE) AS thr FROM (VALUES {_GRID_ROWS}) v(k, w, gamma, beta, thr)),
ph AS (SELECT thr, ym + 1 AS ym, CASE WHEN x >= thr THEN 1 WHEN x <= -thr THEN -1 ELSE 0 END AS phase FROM idx, (SELECT DISTINCT thr FROM g)),
co AS (SELECT thr, fold, phase, month, cell, avg(value) AS comp FROM a JOIN ph USING (ym) JOIN folds USING (year) WHERE role = 'train' AND phase <> 0 GROUP BY ALL),
q AS (SELECT p.*, g.thr, coalesce(ph.phase, 0) AS phase, comp FROM p CROSS JOIN (SELECT DISTINCT thr FROM g) g LEFT JOIN ph ON ph.thr = g.thr AND ph.ym = p.ym
      LEFT JOIN co ON co.thr = g.thr AND co.fold = p.fold AND co.phase = ph.phase AND co.month = p.ym % 12 + 1 AND co.cell = p.cell),
z8 AS (SELECT ym, max(phase) AS phase FROM ph WHERE thr = .8 GROUP BY 1),
er AS (SELECT gap, q.fold, q.lag, coalesce(z8.phase, 0) AS phase, k, g.w, gamma, beta, g.thr, (greatest(clim + gamma * (g.w * greatest(base, 0) + (1 - g.w) * greatest(base + corr, 0) - clim) + coalesce(beta * (comp - clim), 0), 0) - value) ** 2 AS e
       FROM q JOIN g ON g.thr = q.thr LEFT JOIN z8 ON z8.ym = q.ym),
sf AS (SELECT gap, fold, lag, phase, k, w, gamma, beta, thr, sum(e) AS e, count(*) AS n FROM er GROUP BY ALL),
sl AS (SELECT *, part, CASE part WHEN 'all' THEN 'all' WHEN 'phase' THEN CAST(phase AS VARCHAR) WHEN 'bucket' THEN concat((lag - 1) // 6 * 6 + 1, '-', (lag - 1) // 6 * 6 + 6) WHEN 'lag' THEN CAST(lag AS VARCHAR) ELSE CAST(fold AS VARCHAR) END AS "key"
      FROM sf, (SELECT unnest(['all', 'phase', 'bucket', 'lag', 'year']) AS part)),
sr AS (SELECT CAST(gap AS INTEGER) AS gap, part, "key", k, w, gamma, beta, thr, sqrt(sum(e) / sum(n)) AS rmse FROM sl GROUP BY ALL)
SELECT gap, part, "key", w, gamma, beta, thr, round(rmse, 5) AS rmse, row_number() OVER (PARTITION BY gap, part, "key" ORDER BY round(rmse, 9), k) = 1 AS best FROM sr"""

QUERIES = {f.__name__: f for f in (two_stage_coefficients, two_stage_pooled, two_stage_recursion, two_stage_forecast, two_stage_deviations, two_stage_stored, prediction_sweeps)}
ORACLES = dict(zip(QUERIES, (_COEFFICIENTS, _POOLED_SCORES, _RECURSION, _FORECAST, _DEVIATIONS, _PAIR, _SWEEPS), strict=True))
