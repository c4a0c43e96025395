"""Queries: two-stage models, submissions and files, indices of boxes, dynamical fields, and matrices for trees."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.operators import climatology as C
from panelmill.operators import combine as P
from panelmill.operators import ensemble as E
from panelmill.operators import features as M
from panelmill.operators import regime as G
from panelmill.operators import ridge as R
from panelmill.operators import spatial as S
from panelmill.operators import trees as T
from panelmill.operators import twostage as Q
from panelmill.operators.evaluate import rmse
from panelmill.panel import FOLDS_SQL, INDEX_SQL, PANEL_A_SQL, YEARS, densify, driver_index, final_fit_years, loyo_folds, month_index, panel_a, with_calendar
from panelmill.plans.grid import _CELLS_SQL, AREAS
from panelmill.plans.grid import _AREAS_SQL as AREAS_SQL
from panelmill.plans.grid import component_sql
from panelmill.plans.grid import _cells as cells_of
from panelmill.plans.models import _CELL_SQL, _ID_SQL, _Z_SQL, SPAN, _cell_rows, _month_features, _ridge_sql, _targets
from panelmill.sources import tables

_R = lambda c, name, k=6: F.round(c, k).alias(name)
_Z = lambda c, k=6: (F.round(c, k) + 0.0).alias(c)  # noqa: E731  no negative zero
HISTORY = YEARS[-1]
#: Small trees that stop early: the panel's noise is large.
GROWTH = T.Fit(leaves=15, least=40, rate=0.1, rounds=30, patience=5, bins=64, features=0.8, rows=0.8)
VARIABLES = ["price", "discount", "tax"]
RIDGES = (10.0, 50.0)
#: One local anomaly and the last observation's: few enough columns for SQL.
PAIR = Q.Model(RIDGES, ("price_a",), ("last",), history=HISTORY)


def _stage2(spark, sf_dir, names):
    """The panel by target month with the local features of names, also for target months that have no value."""
    a = panel_a(spark, sf_dir)
    local = M.local_features(a.select("ym", "cell", *names), names, 10, SPAN, HISTORY)
    folder = f"{tables.shared_folder(spark)}/stage2-{uuid.uuid4().hex}"
    a.select("ym", "cell", "value").join(local, ["ym", "cell"], "full").write.parquet(folder)  # read twice: for the months that have values, and to fit
    return spark.read.schema("ym int, cell int, value double, " + ", ".join(f"{v}_a double, {v}_n double" for v in names)).parquet(folder), [c for v in names for c in (f"{v}_a", f"{v}_n")]


def _months(spark, sf_dir, panel, folds):
    """Month features, folds and the months that have a value anywhere."""
    return Q.with_presence(panel, R.months_of(_month_features(spark, sf_dir), folds, ["x", "p"], *SPAN))


def _scores(preds):
    """Scores of both stages and of the first alone, by gap and tested year."""
    some = preds.where("value is not null and base is not null")
    both = rmse(C.clip0(F.col("base") + F.col("corr")), F.col("value"))
    s = some.groupBy("gap", F.col("fold").alias("year")).agg(rmse(C.clip0(F.col("base")), F.col("value")).alias("rmse_first"), both.alias("rmse"))
    return s.select("gap", "year", _R("rmse_first", "rmse_first", 5), _R("rmse", "rmse", 5), _R(F.avg("rmse").over(W.partitionBy("gap")), "mean_rmse", 5))


def two_stage_pair(spark, sf_dir):
    """Scores of the shared ridge and the cells' ridges on what it leaves, on one local anomaly and the last observation's, under both gaps."""
    rows, _ = _stage2(spark, sf_dir, ["price"])
    return _scores(Q.two_stage(rows, _months(spark, sf_dir, rows, loyo_folds(spark)), PAIR))


def _stage2_sql() -> str:
    """s1: both roles with base; ob: anomalies of observations; lp: local anomalies by target month; cf: means up to the last year of history; w2: the cells' ridges."""
    return f"""{_Z_SQL}, lam AS (SELECT CAST({RIDGES[0]} AS DOUBLE) AS l), {_ridge_sql('{0}')},
s1 AS (SELECT z.fold, z.role, z.ym, z.cell, z.value, z.clim, z.clim + z.sigma * (mz + wu * (u - mu) + wv * (v - mv)) AS base FROM w JOIN z USING (fold, cell) JOIN f USING (fold, role, ym)),
ps AS (SELECT month, cell, sum(price) AS s, count(price) AS n, avg(value) AS c FROM a WHERE year <= {HISTORY} GROUP BY 1, 2),
lp AS (SELECT ym + 1 AS ym, cell, CASE WHEN (ym + 1) // 12 > {HISTORY} THEN price - s / n WHEN n > 1 THEN (price * n - s) / (n - 1) END AS p FROM a JOIN ps USING (month, cell)),
ob AS (SELECT a.ym, a.cell, value - c AS o FROM a JOIN ps USING (month, cell)),
t2 AS (SELECT s1.fold, s1.cell, coalesce(s1.value - s1.base, 0) AS r, coalesce(lp.p, 0) AS x, coalesce(ob.o, 0) AS y FROM s1 LEFT JOIN lp ON lp.ym = s1.ym AND lp.cell = s1.cell
       LEFT JOIN ob ON ob.cell = s1.cell AND ob.ym = s1.ym - ((s1.ym * 7919) % 24 + 1) WHERE role = 'train' AND s1.ym - ((s1.ym * 7919) % 24 + 1) >= {SPAN[0]}),
m2 AS (SELECT fold, cell, avg(r) AS mr, avg(x) AS mx, avg(y) AS my, regr_sxx(r, x) + {RIDGES[1]} AS xx, regr_sxx(r, y) + {RIDGES[1]} AS yy, regr_sxy(x, y) AS xy, regr_sxy(r, x) AS xr, regr_sxy(r, y) AS yr FROM t2 GROUP BY 1, 2),
w2 AS (SELECT *, (yy * xr - xy * yr) / (xx * yy - xy * xy) AS wx, (xx * yr - xy * xr) / (xx * yy - xy * xy) AS wy FROM m2)"""


_PAIR = f"""WITH {_stage2_sql()},
e AS (SELECT gap, s1.fold AS year, s1.value, greatest(base, 0) AS one, greatest(base + mr + wx * (coalesce(lp.p, 0) - mx) + wy * (coalesce(ob.o, 0) - my), 0) AS two
      FROM s1 JOIN w2 USING (fold, cell) CROSS JOIN (SELECT unnest([1, 2]) AS gap) LEFT JOIN lp ON lp.ym = s1.ym AND lp.cell = s1.cell LEFT JOIN ob ON ob.cell = s1.cell AND ob.ym = s1.ym - (s1.ym % 12 + 1 + 12 * (gap - 1))
      WHERE role = 'test' AND s1.ym - (s1.ym % 12 + 1 + 12 * (gap - 1)) >= {SPAN[0]} AND s1.value IS NOT NULL AND base IS NOT NULL),
t AS (SELECT CAST(gap AS INTEGER) AS gap, CAST(year AS INTEGER) AS year, sqrt(avg((one - value) ** 2)) AS rmse_first, sqrt(avg((two - value) ** 2)) AS rmse FROM e GROUP BY ALL)
SELECT gap, year, round(rmse_first, 5) AS rmse_first, round(rmse, 5) AS rmse, round(avg(rmse) OVER (PARTITION BY gap), 5) AS mean_rmse FROM t"""


def two_stage(spark, sf_dir):
    """The same with all local anomalies, their 5 x 5 means, and the last observation's anomaly, age and their product."""
    rows, local = _stage2(spark, sf_dir, VARIABLES)
    return _scores(Q.two_stage(rows, _months(spark, sf_dir, rows, loyo_folds(spark)), Q.Model(RIDGES, tuple(local), history=HISTORY)))


def _final_folds(spark):
    """One fold that trains on all years but the one held out, and predicts it."""
    rows = [(HISTORY + 1, y, "train") for y in final_fit_years()] + [(HISTORY + 1, HISTORY + 1, "test")]
    return spark.createDataFrame(rows, "fold int, year int, role string")


def submission(spark, sf_dir):
    """Fit on all years, predict the year after from its December, add the phase offset, write the CSV, validate it and read it back."""
    rows, _ = _stage2(spark, sf_dir, ["price"])
    folds, a = _final_folds(spark), panel_a(spark, sf_dir)
    preds = Q.two_stage(rows, _months(spark, sf_dir, rows, folds), PAIR, (1,)).where("base is not null")
    phases = G.origin_phases(driver_index(spark, sf_dir), [0.5])
    comp = G.composites(a, phases, folds).select("phase", "month", "cell", "comp")
    both = with_calendar(preds).join(F.broadcast(phases.select("ym", "phase")), "ym", "left").join(comp, ["phase", "month", "cell"], "left")
    value = F.col("base") + F.col("corr") + G.offset(F.col("comp"), F.col("clim"), 0.25)
    lat, lon = F.floor(F.col("cell") / 10) * 0.25 - 60, F.col("cell") % 10 * 0.25 - 90
    out = both.select((F.col("ym").cast("bigint") * 100 + F.col("cell")).alias("row_id"), P.make_id(F.col("year"), F.col("month"), lat, lon).alias("id"), C.clip0(value).alias("value"))
    folder = f"{tables.shared_folder(spark)}/submission-{uuid.uuid4().hex}"
    out.write.parquet(f"{folder}/rows")
    out = spark.read.parquet(f"{folder}/rows")
    if not P.validate(out, out.select("row_id", "id")).first().valid:
        raise ValueError("the submission is not valid")
    path = tables.write_submission(out, f"{folder}/csv", out.count())
    return spark.read.schema("id string, value double").option("header", True).csv(path).select("id", _R("value", "value", 5))


_FINAL_SQL = f"folds AS (SELECT {HISTORY + 1} AS fold, year, 'train' AS role FROM yrs UNION ALL SELECT {HISTORY + 1}, {HISTORY + 1}, 'test')"
_SUBMISSION = f"""WITH {_stage2_sql().replace(FOLDS_SQL[FOLDS_SQL.index('folds AS'):], _FINAL_SQL).replace(f'range({1995 * 12}, {2001 * 12})', f'range({1995 * 12}, {2002 * 12})')},
ph AS (SELECT ym + 1 AS ym, CASE WHEN x >= .5 THEN 1 WHEN x <= -.5 THEN -1 ELSE 0 END AS phase FROM idx),
co AS (SELECT phase, month, cell, avg(value) AS comp FROM a JOIN ph USING (ym) WHERE year <= {HISTORY} AND phase <> 0 GROUP BY ALL)
SELECT printf('%d_%02d_%.2f_%.2f', s1.ym // 12, s1.ym % 12 + 1, (s1.cell // 10) * 0.25 - 60, (s1.cell % 10) * 0.25 - 90) AS id,
 round(round(greatest(base + mr + wx * (coalesce(lp.p, 0) - mx) + wy * (coalesce(ob.o, 0) - my) + coalesce(.25 * (comp - clim), 0), 0), 6), 5) AS value
FROM s1 JOIN w2 USING (fold, cell) LEFT JOIN lp ON lp.ym = s1.ym AND lp.cell = s1.cell LEFT JOIN ob ON ob.cell = s1.cell AND ob.ym = s1.ym - (s1.ym % 12 + 1)
LEFT JOIN ph ON ph.ym = s1.ym LEFT JOIN co ON co.phase = ph.phase AND co.month = s1.ym % 12 + 1 AND co.cell = s1.cell WHERE role = 'test' AND base IS NOT NULL"""


def _stored(spark, sf_dir):
    """The panel, written once and read back. Ids are made from it and parsed again; over its own plan Spark would move the joins' conditions on them to the lines, below the aggregate."""
    a = panel_a(spark, sf_dir).select("ym", "year", "month", "cell", "gy", "gx", "value", "price")
    folder = f"{tables.shared_folder(spark)}/panel-{uuid.uuid4().hex}"
    a.write.parquet(folder)
    return spark.read.schema(a.schema).parquet(folder)


def _file(a):
    """A prediction table as a file holds it: ids and values."""
    return a.select(P.make_id(F.col("year"), F.col("month"), F.col("gy") * 0.25 - 60, F.col("gx") * 0.25 - 90).alias("id"), (F.col("price") / 1000).alias("value"))


def file_damped(spark, sf_dir):
    """A table of ids damped to 0.8, and inflated to 1.2 in warm months alone, its ids read back to places."""
    a = _stored(spark, sf_dir)
    t = P.on_cells(_file(a), 10, 5)
    clim = C.climatology(a).select("month", "cell", "clim")
    warm = G.origin_phases(driver_index(spark, sf_dir), [0.5]).select("ym", "phase")
    t = t.join(clim, ["month", "cell"]).join(F.broadcast(warm), "ym", "left")
    gated = F.when(F.coalesce("phase", F.lit(0)) == 1, P.damp(F.col("value"), F.col("clim"), 1.2)).otherwise(F.col("value"))
    return t.select("id", _R(P.damp(F.col("value"), F.col("clim"), 0.8), "damped", 8), _R(gated, "gated", 8))


_DAMPED = f"""WITH {PANEL_A_SQL}, {INDEX_SQL}, c AS (SELECT month, cell, avg(value) AS clim FROM a GROUP BY 1, 2)
SELECT {_ID_SQL} AS id, round(greatest(clim + .8 * (price / 1000 - clim), 0), 8) AS damped, round(CASE WHEN x >= .5 THEN greatest(clim + 1.2 * (price / 1000 - clim), 0) ELSE price / 1000 END, 8) AS gated
FROM a JOIN c USING (month, cell) LEFT JOIN idx ON idx.ym = a.ym - 1"""


def file_offset(spark, sf_dir):
    """The phase offset of all years, beta 0.25 and threshold 0.8, added to a table of ids."""
    a = _stored(spark, sf_dir)
    phases = G.origin_phases(driver_index(spark, sf_dir), [0.8]).drop("thr")
    folds = spark.createDataFrame([(0, y, "train") for y in YEARS], "fold int, year int, role string")
    comp = G.composites(a, phases, folds).select("phase", "month", "cell", "comp")
    clim = C.climatology(a.where(F.col("year").isin(*YEARS))).select("month", "cell", "clim")
    t = P.on_cells(_file(a), 10, 5).join(clim, ["month", "cell"], "left").join(F.broadcast(phases), "ym", "left").join(comp, ["phase", "month", "cell"], "left")
    return t.select("id", _R(C.clip0(F.col("value") + G.offset(F.col("comp"), F.col("clim"), 0.25)), "value"))


_FILE_OFFSET = f"""WITH {PANEL_A_SQL}, {INDEX_SQL}, ph AS (SELECT ym + 1 AS ym, CASE WHEN x >= .8 THEN 1 WHEN x <= -.8 THEN -1 ELSE 0 END AS phase FROM idx),
c AS (SELECT month, cell, avg(value) AS clim FROM a WHERE year <= {HISTORY} GROUP BY 1, 2), co AS (SELECT phase, month, cell, avg(value) AS comp FROM a JOIN ph USING (ym) WHERE year <= {HISTORY} AND phase <> 0 GROUP BY 1, 2, 3)
SELECT {_ID_SQL.replace("month", "a.month")} AS id, round(greatest(price / 1000 + coalesce(.25 * (comp - clim), 0), 0), 6) AS value FROM a LEFT JOIN c ON c.month = a.month AND c.cell = a.cell LEFT JOIN ph ON ph.ym = a.ym
LEFT JOIN co ON co.phase = ph.phase AND co.month = a.month AND co.cell = a.cell"""


def id_order(spark, sf_dir):
    """Ids of the canonical order against those of a CSV that is parsed once and kept: rows, ids that agree in place, and ids that only one side has."""
    a = _stored(spark, sf_dir)
    months = [r.ym for r in a.select("ym").distinct().collect()]  # a row for each month
    ids = P.expected_ids(spark, months, 10, 5)
    folder = f"{tables.shared_folder(spark)}/ids-{uuid.uuid4().hex}"
    path = tables.write_submission(ids.withColumn("value", F.lit(0.0)), f"{folder}/csv", ids.count())
    kept = tables.cached_ids(spark, path, f"{folder}/ids")
    pair = ids.join(kept.withColumnRenamed("id", "kept"), "row_id", "full")
    lost = P.same_ids(ids, _file(a))
    return pair.agg(F.count("*").alias("n"), F.count(F.when(F.col("id") == F.col("kept"), 1)).alias("n_equal")).join(F.broadcast(lost))  # one row


_ID_ORDER = f"""WITH {PANEL_A_SQL}, n AS (SELECT count(DISTINCT ym) * 50 AS n FROM a) SELECT n, n AS n_equal, n - (SELECT count(*) FROM a) AS n_missing FROM n"""

#: Ocean boxes (west, east, south, north; degrees east, east of 360 wraps).
OCEAN_BOXES = [
    ("nino12", 270, 280, -10, 0),
    ("nino3", 210, 270, -5, 5),
    ("nino34", 190, 240, -5, 5),
    ("nino4", 160, 210, -5, 5),
    ("tna", 305, 345, 5.5, 23.5),
    ("tsa", 330, 370, -20, 0),
    ("atl3", 340, 360, -3, 3),
    ("tio", 40, 110, -20, 20),
    ("saod_n", 330, 370, -25, -10),
    ("saod_s", 300, 330, -45, -35),
    ("pmm_n", 180, 265, 10, 30),
    ("npac", 150, 210, 20, 60),
]
#: Values up to this are fillings, not measurements.
FILLING = -50.0


def _ocean(spark, sf_dir):
    """Monthly means of line quantities on a 13 x 36 grid of ten degrees, some of them fillings."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_partkey", "l_quantity")
    g = li.groupBy(month_index(F.col("l_shipdate")).alias("ym"), (F.col("l_partkey") % 468).cast("int").alias("cell")).agg(F.avg("l_quantity").alias("value"))
    g = g.withColumn("value", F.when(F.col("cell") % 13 == 5, F.lit(-99.0)).otherwise(F.col("value")))
    places = spark.range(468).select(F.col("id").cast("int").alias("cell"), (F.floor(F.col("id") / 36) * 10.0 - 60).alias("lat"), (F.col("id") % 36 * 10.0).alias("lon"))
    return g.withColumn("value", F.when(F.col("value") > FILLING, F.col("value"))), places


_OCEAN_SQL = """o AS (SELECT ym, cell, value, (cell // 36) * 10.0 - 60 AS lat, (cell % 36) * 10.0 AS lon FROM
(SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS ym, CAST(l_partkey % 468 AS INTEGER) AS cell, avg(l_quantity) AS value FROM lineitem GROUP BY 1, 2) WHERE cell % 13 <> 5)"""


def box_indices(spark, sf_dir):
    """Anomalies of twelve ocean boxes from their means by month of a base period, and four indices derived from them."""
    rows, places = _ocean(spark, sf_dir)
    means = with_calendar(S.box_means(rows, places, S.boxes(spark, OCEAN_BOXES)))
    base = F.avg(F.when(F.col("year").between(1995, 1998), F.col("mean"))).over(W.partitionBy("box", "month"))
    wide = means.select("ym", "box", (F.col("mean") - base).alias("an")).groupBy("ym").pivot("box", [b[0] for b in OCEAN_BOXES]).agg(F.first("an"))
    wide = wide.select("*", (F.col("tna") - F.col("tsa")).alias("amm"), (F.col("saod_n") - F.col("saod_s")).alias("saod"), (F.col("nino3") - F.col("nino4")).alias("ep_cp"), (F.col("npac") * F.col("nino34")).alias("pdo_x_nino34"))
    return wide.select("ym", *[_Z(c) for c in wide.columns if c != "ym"])


_BOX_ROWS = ", ".join(str(b) for b in OCEAN_BOXES)
_INDICES = f"""WITH {_OCEAN_SQL}, bx AS (SELECT * FROM (VALUES {_BOX_ROWS}) AS v(box, west, east, south, north)),
m AS (SELECT ym, box, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS mean FROM o JOIN bx ON lat BETWEEN south AND north AND (lon BETWEEN west AND least(east, 360) OR (east > 360 AND lon BETWEEN 0 AND east - 360)) GROUP BY 1, 2),
d AS (SELECT ym, box, mean - avg(mean) FILTER (ym // 12 BETWEEN 1995 AND 1998) OVER (PARTITION BY box, ym % 12) AS an FROM m),
p AS (SELECT ym, {', '.join(f"max(an) FILTER (box = '{b[0]}') AS {b[0]}" for b in OCEAN_BOXES)} FROM d GROUP BY 1)
SELECT ym, {', '.join(f'round({b[0]}, 6) + 0.0 AS {b[0]}' for b in OCEAN_BOXES)}, round(tna - tsa, 6) + 0.0 AS amm, round(saod_n - saod_s, 6) + 0.0 AS saod, round(nino3 - nino4, 6) + 0.0 AS ep_cp, round(npac * nino34, 6) + 0.0 AS pdo_x_nino34 FROM p"""


def basin_means(spark, sf_dir):
    """Plain monthly means of a basin that lies on both sides of the meridian, in longitudes of -180 to 180."""
    rows, places = _ocean(spark, sf_dir)
    basin = places.withColumn("lon", S.recentred(F.col("lon"))).where(F.col("lon").between(-70, 20) & F.col("lat").between(-40, 40))
    return rows.join(basin, "cell").groupBy("ym").agg(_R(F.avg("value"), "mean"), F.count("value").alias("n"))


_BASIN = f"""WITH {_OCEAN_SQL} SELECT ym, round(avg(value), 6) AS mean, count(value) AS n FROM o WHERE CASE WHEN lon > 180 THEN lon - 360 ELSE lon END BETWEEN -70 AND 20 AND lat BETWEEN -40 AND 40 GROUP BY 1"""


def component_products(spark, sf_dir):
    """The leading component of the northern Pacific, the difference of two southern bands, and the products of both with the driver's anomaly."""
    rows, places = _ocean(spark, sf_dir)
    means = with_calendar(S.box_means(rows, places, S.boxes(spark, [b for b in OCEAN_BOXES if b[0] == "nino34"])))
    base = F.avg(F.when(F.col("year").between(1995, 1998), F.col("mean"))).over(W.partitionBy("month"))
    driver = means.select("ym", (F.col("mean") - base).alias("x"))
    placed = with_calendar(rows).join(places, "cell")
    pc = E.principal_component(placed, driver, HISTORY, basin=(F.col("lat") >= 20) & F.col("lon").between(110, 260))
    sam = E.zonal_difference(placed, (-45.0, -35.0), (-65.0, -55.0))
    t = driver.join(pc, "ym", "full").join(sam, "ym", "full").withColumns({"pc_x_nino34": F.col("pc") * F.col("x"), "sam_x_nino34": F.col("index") * F.col("x")})
    return t.select("ym", *[_Z(c, 5) for c in ("x", "pc", "index", "pc_x_nino34", "sam_x_nino34")])


_PRODUCTS = f"""WITH {_OCEAN_SQL}, nm AS (SELECT ym, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS m FROM o WHERE lat BETWEEN -5 AND 5 AND lon BETWEEN 190 AND 240 GROUP BY 1),
dr AS (SELECT ym, m - avg(m) FILTER (ym // 12 BETWEEN 1995 AND 1998) OVER (PARTITION BY ym % 12) AS x FROM nm), {component_sql('o', 'dr', HISTORY, 'lat >= 20 AND lon BETWEEN 110 AND 260')},
bd AS (SELECT ym, avg(value) FILTER (lat BETWEEN -45 AND -35) AS s, avg(value) FILTER (lat BETWEEN -65 AND -55) AS n FROM o GROUP BY 1),
ba AS (SELECT ym, s - avg(s) OVER (PARTITION BY ym % 12) AS s, n - avg(n) OVER (PARTITION BY ym % 12) AS n FROM bd),
sm AS (SELECT ym, s / (SELECT stddev_pop(s) FROM ba) - n / (SELECT stddev_pop(n) FROM ba) AS index FROM ba)
SELECT ym, round(x, 5) + 0.0 AS x, round(pc, 5) + 0.0 AS pc, round(index, 5) + 0.0 AS index, round(pc * x, 5) + 0.0 AS pc_x_nino34, round(index * x, 5) + 0.0 AS sam_x_nino34 FROM dr FULL JOIN pc USING (ym) FULL JOIN sm USING (ym)"""


def _runs(spark, sf_dir):
    """Ensemble means of forecasts, in millimetres a day."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_partkey", "l_linenumber", "l_quantity")
    rate = E.rate_to_daily(F.col("l_quantity") * 1e-8)
    runs = li.select(month_index(F.col("l_shipdate")).alias("ym"), (F.col("l_suppkey") % 3).cast("int").alias("model"), F.col("l_linenumber").alias("member"), (F.col("l_partkey") % 50).cast("int").alias("cell"), rate.alias("value"))
    return E.ensemble_mean(runs.groupBy("model", "ym", "member", "cell").agg(F.avg("value").alias("value")))


_RUNS_SQL = """mb AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS ym, l_suppkey % 3 AS model, l_linenumber, CAST(l_partkey % 50 AS INTEGER) AS cell, avg(l_quantity * 1e-8 * 86400 * 1000) AS v FROM lineitem GROUP BY ALL),
en AS (SELECT ym, cell, avg(v) AS v FROM (SELECT model, ym, cell, avg(v) AS v FROM mb GROUP BY ALL) GROUP BY ALL)"""


def fold_fields(spark, sf_dir):
    """Forecast anomalies of every fold, from means of its own training years of the hindcast."""
    return E.anomaly_fields(_runs(spark, sf_dir), loyo_folds(spark), 1999).select("fold", "ym", "cell", _Z("anomaly"))


_FIELDS = f"""WITH {_RUNS_SQL}, {FOLDS_SQL}, mn AS (SELECT fold, ym % 12 AS k, cell, avg(v) AS m FROM en JOIN folds ON year = ym // 12 WHERE role = 'train' AND year <= 1999 GROUP BY ALL)
SELECT fold, ym, en.cell, round(v - m, 6) + 0.0 AS anomaly FROM en JOIN mn ON k = ym % 12 AND mn.cell = en.cell"""


def regional_fields(spark, sf_dir):
    """Means by box of every fold's forecast anomalies."""
    places = cells_of(panel_a(spark, sf_dir))
    fields = E.anomaly_fields(_runs(spark, sf_dir), loyo_folds(spark), 1999)
    return E.regional_anomalies(fields, places, S.boxes(spark, AREAS), ["fold"]).select("fold", "ym", "box", _Z("mean"))


_REGIONAL = f"""WITH {PANEL_A_SQL}, {AREAS_SQL}, {_CELLS_SQL}, {_RUNS_SQL}, {FOLDS_SQL}, mn AS (SELECT fold, ym % 12 AS k, cell, avg(v) AS m FROM en JOIN folds ON year = ym // 12 WHERE role = 'train' AND year <= 1999 GROUP BY ALL),
fa AS (SELECT fold, ym, en.cell, v - m AS an FROM en JOIN mn ON k = ym % 12 AND mn.cell = en.cell)
SELECT fold, ym, box, round(coalesce(sum(an * cos(radians(lat))) / sum(cos(radians(lat))), 0), 6) + 0.0 AS mean FROM fa JOIN inside USING (cell) GROUP BY ALL"""


def stored_regrid(spark, sf_dir):
    """Models' fields on a finer grid, written once by model and read from the first path that exists, and the mean over the models that have a value."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_partkey", "l_quantity")
    coarse = li.groupBy(month_index(F.col("l_shipdate")).alias("ym"), (F.col("l_suppkey") % 2).cast("int").alias("model"), (F.col("l_partkey") % 20).cast("int").alias("cell")).agg(F.avg("l_quantity").alias("value"))
    coarse = coarse.select("model", "ym", (F.floor(F.col("cell") / 5) * 10.0).alias("lat"), (F.col("cell") % 5 * 10.0).alias("lon"), "value")
    targets = spark.range(7 * 9).select(F.col("id").cast("int").alias("cell"), (F.floor(F.col("id") / 9) * 5.0).alias("lat"), (F.col("id") % 9 * 5.0).alias("lon"))
    folder = f"{tables.shared_folder(spark)}/regrid-{uuid.uuid4().hex}"
    tables.save_models(S.regrid(coarse, targets, (10.0, 10.0), ["model", "ym"]), folder)
    fields = spark.read.schema("ym int, cell int, value double, model int").parquet(tables.first_there(spark, [f"{folder}-old", folder])).where("value is not null")
    return fields.groupBy("ym", "cell").agg(_R(F.avg("value"), "value"), F.count("*").alias("n"))


_STORED_REGRID = """WITH c AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS ym, l_suppkey % 2 AS model, l_partkey % 20 AS k, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
t AS (SELECT CAST(id AS INTEGER) AS cell, (id // 9) / 2.0 AS y, (id % 9) / 2.0 AS x FROM range(63) r(id)),
n AS (SELECT cell, floor(y) + i AS gy, floor(x) + j AS gx, (CASE WHEN i = 1 THEN y - floor(y) ELSE 1 - y + floor(y) END) * (CASE WHEN j = 1 THEN x - floor(x) ELSE 1 - x + floor(x) END) AS w FROM t, (VALUES (0), (1)) a(i), (VALUES (0), (1)) b(j)),
s AS (SELECT model, ym, n.cell, sum(w) AS w, sum(w * v) AS v FROM n JOIN c ON c.k // 5 = n.gy AND c.k % 5 = n.gx WHERE w > 0 GROUP BY ALL)
SELECT ym, cell, round(avg(v), 6) AS value, count(*) AS n FROM s WHERE w > 1 - 1e-9 GROUP BY 1, 2"""


def start_field(spark, sf_dir):
    """The anomaly field of one start month on the whole grid, missing cells 0; a start that isn't there gives no rows."""
    fields = E.debiased(_runs(spark, sf_dir), 1999, [1997])
    grid = spark.range(60).select(F.col("id").cast("int").alias("cell"))
    both = E.start_field(fields, 2000 * 12 + 4, grid).unionByName(E.start_field(fields, 1900 * 12, grid))
    return both.select("cell", _Z("anomaly"))


_START = f"""WITH {_RUNS_SQL}, d AS (SELECT ym, cell, v - avg(v) FILTER (ym // 12 <= 1999 AND ym // 12 <> 1997) OVER (PARTITION BY ym % 12, cell) AS an FROM en)
SELECT CAST(id AS INTEGER) AS cell, round(coalesce(an, 0), 6) + 0.0 AS anomaly FROM range(60) r(id) LEFT JOIN d ON d.cell = id AND ym = {2000 * 12 + 4} WHERE EXISTS (SELECT 1 FROM d WHERE ym = {2000 * 12 + 4})"""


def stored_anomalies(spark, sf_dir):
    """Anomalies and climatologies of four variables from sums and counts by month and cell that are written once."""
    a, names = panel_a(spark, sf_dir), ["value", *VARIABLES]
    folder = f"{tables.shared_folder(spark)}/sums-{uuid.uuid4().hex}"
    C.month_sums(a, names).write.parquet(folder)
    sums, out = spark.read.parquet(folder), a.select("ym", "month", "cell", *names)
    for v in names:
        out = C.loo_anomaly_scaled(out, v, sums).withColumnRenamed("anomaly", f"{v}_a")
    clim = C.stored_climatology(sums)
    return out.join(clim, ["month", "cell"]).select("ym", "cell", _R("clim", "clim"), *[_Z(f"{v}_a", 8) for v in names])


_STORED = f"""WITH {PANEL_A_SQL}, s AS (SELECT month, cell, avg(value) AS clim, count(*) AS n, {', '.join(f'sum({v}) AS s_{v}' for v in ['value', *VARIABLES])} FROM a GROUP BY 1, 2)
SELECT ym, cell, round(clim, 6) AS clim, {', '.join(f'round(CASE WHEN n > 1 THEN {v} - (s_{v} - {v}) / (n - 1) END, 8) + 0.0 AS {v}_a' for v in ['value', *VARIABLES])} FROM a JOIN s USING (month, cell)"""


def standardised_cells(spark, sf_dir):
    """Coefficients of one ridge per cell and fold, penalised at unit deviation of the feature over all months and cells."""
    rows = _cell_rows(spark, sf_dir)[0]
    w = R.solve_cells(R.cell_moments(rows, ["x"]), 50.0, True)
    return w.select("fold", "cell", _R(F.col("w")[0], "slope", 5), _R(F.col("w")[1], "intercept", 5))


_STANDARD = f"""WITH {_CELL_SQL}, v AS (SELECT fold, var_pop(x) AS v FROM rw GROUP BY 1),
k AS (SELECT fold, cell, regr_sxy(r, x) / (regr_sxx(r, x) + 50 * any_value(v)) AS s, avg(r) AS mr, avg(x) AS mx FROM rw JOIN v USING (fold) GROUP BY 1, 2)
SELECT fold, cell, round(s, 5) AS slope, round(mr - s * mx, 5) AS intercept FROM k"""


def two_part_recursion(spark, sf_dir):
    """Scores by position of 24 months in sequence: the first twelve from an observed December, the others from the prediction before them."""
    rows, z, obs, clim = _cell_rows(spark, sf_dir)
    w = R.solve_cells(R.cell_moments(rows, ["x"]), 50.0).select("fold", "cell", F.col("w")[0].alias("s"), F.col("w")[1].alias("i"))
    c = clim.select("fold", "month", "cell", "clim")
    before = c.select("fold", (F.col("month") % 12 + 1).alias("month"), "cell", F.col("clim").alias("origin"))
    december = c.where("month = 12").select("fold", "cell", F.col("clim").alias("december"))
    k = F.explode(F.sequence(F.lit(1), F.lit(24)))
    steps = w.where(F.col("fold") - 2 >= YEARS[0]).withColumn("k", k).withColumn("month", ((F.col("k") - 1) % 12 + 1).cast("int"))
    steps = steps.join(c, ["fold", "month", "cell"], "left").join(before, ["fold", "month", "cell"], "left").join(december, ["fold", "cell"], "left")
    base, normal = F.coalesce("clim", F.lit(0.0)) + F.col("i"), F.when(F.col("k") <= 12, F.col("december")).otherwise(F.col("origin"))
    cells = steps.groupBy("fold", "cell").agg(F.first("s").alias("s"), F.sort_array(F.collect_list(F.struct("k", base.alias("base"), normal.alias("normal")))).alias("months"))  # 24 a cell
    start = obs.where("month = 12").select((F.col("year") + 2).alias("fold"), "cell", F.col("value").alias("start"))
    paths = R.recursion(cells.join(start, ["fold", "cell"], "left"), "s", "start", "months", 12)
    steps = paths.select("fold", "cell", F.posexplode("path").alias("pos", "pred")).where("pos >= 12").select((F.col("fold") * 12 + F.col("pos") - 12).alias("ym"), "cell", "pred", (F.col("pos") + 1).alias("position"))
    both = steps.join(obs.where("value is not null").select("ym", "cell", "value"), ["ym", "cell"])
    return both.groupBy("position").agg(_R(rmse(F.col("pred"), F.col("value")), "rmse", 5), F.count("*").alias("n"))


_TWO_PART = f"""WITH RECURSIVE {_CELL_SQL},
st AS (SELECT cw.fold, cw.cell, s, mr - s * mx AS i, o.value AS start, d.clim AS december FROM cw LEFT JOIN a o ON o.cell = cw.cell AND o.ym = (cw.fold - 2) * 12 + 11 LEFT JOIN cl d ON d.fold = cw.fold AND d.cell = cw.cell AND d.k = 11 WHERE cw.fold - 2 >= {YEARS[0]}),
r AS (SELECT fold, cell, 0 AS k, CAST(NULL AS DOUBLE) AS pred FROM st
      UNION ALL SELECT r.fold, r.cell, r.k + 1, greatest(coalesce(c.clim, 0) + i + s * coalesce(CASE WHEN r.k < 12 THEN start - december ELSE r.pred - b.clim END, 0), 0) FROM r JOIN st ON st.fold = r.fold AND st.cell = r.cell
      LEFT JOIN cl c ON c.fold = r.fold AND c.cell = r.cell AND c.k = r.k % 12 LEFT JOIN cl b ON b.fold = r.fold AND b.cell = r.cell AND b.k = (r.k + 11) % 12 WHERE r.k < 24)
SELECT r.k AS position, round(sqrt(avg((pred - value) ** 2)), 5) AS rmse, count(*) AS n FROM r JOIN a ON a.cell = r.cell AND a.ym = r.fold * 12 + r.k - 13 WHERE r.k > 12 GROUP BY 1"""


def _tree_rows(spark, sf_dir, folds=None):
    """Rows of the matrices for trees, and a function that adds the last observation to rows that have a lag."""
    z, clim = _targets(spark, sf_dir, folds)
    a = panel_a(spark, sf_dir)
    local = M.local_features(a.select("ym", "cell", *VARIABLES), VARIABLES, 10, SPAN, HISTORY)
    obs = densify(a.select("ym", "cell", "value"), SPAN)
    return T.tree_rows(z, local, _month_features(spark, sf_dir), 10), lambda rows: T.finished(rows, obs, clim)


def tree_matrix(spark, sf_dir):
    """The training matrix, twenty cells of each month and fold."""
    rows, finished = _tree_rows(spark, sf_dir)
    m = finished(T.sampled(rows.where("role = 'train'").withColumn("lag", R.lag_of(F.col("ym"))), 20, SPAN[0]))
    return m.select("fold", "ym", "cell", "lag", *[_Z(c) for c in ("last_a", "clim", "sigma", "price_a", "tax_n", "lat", "lon", "month_sin", "month_cos", "x", "p", "z")])


_TREE_ROWS_SQL = f"""{_Z_SQL}, sm AS (SELECT month, cell, count(*) AS n, sum(price) AS sp, sum(tax) AS st FROM a WHERE year <= {HISTORY} GROUP BY 1, 2),
an AS (SELECT ym + 1 AS ym, cell, coalesce(CASE WHEN n > 1 THEN (price * n - sp) / (n - 1) END, 0) AS price_a, coalesce(CASE WHEN n > 1 THEN (tax * n - st) / (n - 1) END, 0) AS tax_a FROM a JOIN sm USING (month, cell)),
nb AS (SELECT g.ym, c0.cell, greatest(0, least(4, c0.cell // 10 + i)) * 10 + greatest(0, least(9, c0.cell % 10 + j)) AS near FROM c0, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j), (SELECT DISTINCT ym FROM m0) g),
nm AS (SELECT nb.ym, nb.cell, sum(coalesce(tax_a, 0)) / 25 AS tax_n FROM nb LEFT JOIN an ON an.ym = nb.ym AND an.cell = nb.near GROUP BY 1, 2),
cl AS (SELECT DISTINCT fold, ym % 12 AS k, cell, clim FROM z),
rows0 AS (SELECT z.*, CAST((z.ym * 7919) % 24 + 1 AS INTEGER) AS lag FROM z WHERE role = 'train' AND clim IS NOT NULL)"""
_TREE = f"""WITH {_TREE_ROWS_SQL}, r1 AS (SELECT * FROM rows0 WHERE ym - lag >= {SPAN[0]}),
r2 AS (SELECT *, row_number() OVER (PARTITION BY fold, ym ORDER BY (cell * 7919 + CAST(ym AS BIGINT) * 104729) % 65537, cell) AS k FROM r1)
SELECT r2.fold, r2.ym, r2.cell, lag, round(coalesce(o.value - cl.clim, 0), 6) + 0.0 AS last_a, round(r2.clim, 6) AS clim, round(r2.sigma, 6) AS sigma, round(coalesce(price_a, 0), 6) + 0.0 AS price_a, round(tax_n, 6) + 0.0 AS tax_n,
 (r2.cell // 10) * 1.0 AS lat, (r2.cell % 10) * 1.0 AS lon, round(sin(2 * pi() * (r2.ym % 12 + 1) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (r2.ym % 12 + 1) / 12), 6) + 0.0 AS month_cos, round(coalesce(ft.x, 0), 6) + 0.0 AS x, round(coalesce(ft.p, 0), 6) + 0.0 AS p, round(z, 6) + 0.0 AS z
FROM r2 LEFT JOIN a o ON o.cell = r2.cell AND o.ym = r2.ym - lag LEFT JOIN cl ON cl.fold = r2.fold AND cl.cell = r2.cell AND cl.k = (r2.ym - lag) % 12 LEFT JOIN an ON an.ym = r2.ym AND an.cell = r2.cell LEFT JOIN nm ON nm.ym = r2.ym AND nm.cell = r2.cell LEFT JOIN ft ON ft.ym = r2.ym WHERE r2.k <= 20"""


_MATRIX = ("last_a", "clim", "sigma", "price_a", "tax_n", "lat", "lon", "month_sin", "month_cos", "x", "p", "z")


def tree_test_matrix(spark, sf_dir):
    """The matrix of the year after the last training year, all cells: anomalies leave no year out, the last observation is December's."""
    rows, finished = _tree_rows(spark, sf_dir, _final_folds(spark))
    m = finished(R.anchored(rows.where("role = 'test'"), 1))
    return m.select("fold", "ym", "cell", "lag", *[_Z(c) for c in _MATRIX if c != "z"])


def tree_eval_matrix(spark, sf_dir):
    """The matrices of every fold's tested months, all cells, under both gaps, as far as observations go back."""
    rows, finished = _tree_rows(spark, sf_dir)
    tests = rows.where("role = 'test'")
    m = finished(R.anchored(tests, 1).unionByName(R.anchored(tests, 2)).where(F.col("ym") - F.col("lag") >= SPAN[0]))
    return m.select("fold", "gap", "ym", "cell", "lag", *[_Z(c) for c in _MATRIX])


_TREE_COLUMNS = _TREE[_TREE.index("round(coalesce(o.value - cl.clim"):]
_TREE_COLUMNS = _TREE_COLUMNS[: _TREE_COLUMNS.index(" WHERE r2.k <= 20")]
_EVAL_ROWS = "r2 AS (SELECT z.*, CAST(gap AS INTEGER) AS gap, CAST(z.ym % 12 + 1 + 12 * (gap - 1) AS INTEGER) AS lag FROM z CROSS JOIN (SELECT unnest({}) AS gap) WHERE role = 'test' AND clim IS NOT NULL AND z.ym - (z.ym % 12 + 1 + 12 * (gap - 1)) >= {})"
_TREE_EVAL = f"WITH {_TREE_ROWS_SQL}, {_EVAL_ROWS.format('[1, 2]', SPAN[0])}\nSELECT r2.fold, gap, r2.ym, r2.cell, lag, {_TREE_COLUMNS}"
#: The same over one fold that tests the year after the last; anomalies of its months are from the mean of all years of history.
_TREE_TEST = f"WITH {_TREE_ROWS_SQL}, {_EVAL_ROWS.format('[1]', SPAN[0])}\nSELECT r2.fold, r2.ym, r2.cell, lag, {_TREE_COLUMNS}".replace(", round(z, 6) + 0.0 AS z\n", "\n")
_TREE_TEST = _TREE_TEST.replace(FOLDS_SQL[FOLDS_SQL.index("folds AS"):], _FINAL_SQL).replace(f"range({1995 * 12}, {2001 * 12})", f"range({1995 * 12}, {2002 * 12})")
for _v, _s in (("price", "sp"), ("tax", "st")):
    _TREE_TEST = _TREE_TEST.replace(f"CASE WHEN n > 1 THEN ({_v} * n - {_s})", f"CASE WHEN (ym + 1) // 12 > {HISTORY} THEN {_v} - {_s} / n WHEN n > 1 THEN ({_v} * n - {_s})")


def boosted_trees(spark, sf_dir):
    """Scores of boosted trees on every fold's matrix, stopped early on its last training year, under both gaps."""
    rows, finished = _tree_rows(spark, sf_dir)
    folds = loyo_folds(spark).where("role = 'train'").groupBy("fold").agg(F.max("year").alias("newest"))
    train = finished(T.sampled(rows.where("role = 'train'").withColumn("lag", R.lag_of(F.col("ym"))), 50, SPAN[0])).join(F.broadcast(folds), "fold")  # a row for each fold
    train = train.withColumns({"valid": F.floor(F.col("ym") / 12) == F.col("newest"), "key": F.col("ym").cast("bigint") * 100 + F.col("cell")})
    columns = [c for v in VARIABLES for c in (f"{v}_a", f"{v}_n")] + ["last_a", "lag", "clim", "sigma", "lat", "lon", "month_sin", "month_cos", "x", "p"]
    forest = T.fit_trees(train, columns, "z", "valid", tables.shared_folder(spark), GROWTH)
    tests = rows.where("role = 'test' and value is not null")
    both = finished(R.anchored(tests, 1).unionByName(R.anchored(tests, 2)).where(F.col("ym") - F.col("lag") >= SPAN[0]))
    preds = T.predict_trees(forest, both).withColumn("pred", C.clip0(F.col("clim") + F.col("sigma") * F.col("z_hat")))
    return preds.groupBy("gap", F.col("fold").alias("year")).agg(_R(rmse(F.col("pred"), F.col("value")), "rmse", 4), F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (two_stage_pair, two_stage, submission, file_damped, file_offset, id_order, box_indices, basin_means, component_products, fold_fields, regional_fields, stored_regrid, start_field, stored_anomalies, standardised_cells, two_part_recursion, tree_matrix, tree_eval_matrix, tree_test_matrix, boosted_trees)}
ORACLES = {
    "two_stage_pair": _PAIR, "submission": _SUBMISSION, "file_damped": _DAMPED, "file_offset": _FILE_OFFSET, "id_order": _ID_ORDER, "box_indices": _INDICES, "basin_means": _BASIN, "component_products": _PRODUCTS, "fold_fields": _FIELDS, "regional_fields": _REGIONAL,
    "stored_regrid": _STORED_REGRID, "start_field": _START, "stored_anomalies": _STORED, "standardised_cells": _STANDARD, "two_part_recursion": _TWO_PART, "tree_matrix": _TREE, "tree_eval_matrix": _TREE_EVAL, "tree_test_matrix": _TREE_TEST,
}
