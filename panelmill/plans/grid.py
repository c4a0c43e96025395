"""Queries: spatial operators, month features, ensembles and derived indices."""

from __future__ import annotations

from pyspark.sql import functions as F

from panelmill.operators import features as M
from panelmill.operators import spatial as S
from panelmill.operators.ensemble import debiased, ensemble_mean, principal_component, zonal_difference
from panelmill.panel import INDEX_SQL, PANEL_A_SQL, densify, driver_index, on_grid, panel_a

_R = lambda c, name, k=6: F.round(c, k).alias(name)
#: Boxes over gy * 10 - 20 (latitude) and gx * 36 (longitude): two overlap, one wraps around, one is empty.
AREAS = [("all", 0, 330, -20, 20), ("west", 0, 150, -10, 10), ("middle", 100, 230, -20, 10), ("wrap", 300, 400, -20, 20), ("nowhere", 1, 2, 50, 60)]
_AREAS_SQL = "areas AS (SELECT * FROM (VALUES ('all', 0, 330, -20, 20), ('west', 0, 150, -10, 10), ('middle', 100, 230, -20, 10), ('wrap', 300, 400, -20, 20), ('nowhere', 1, 2, 50, 60)) AS v(box, west, east, south, north))"
_CELLS_SQL = """cells AS (SELECT DISTINCT cell, gy * 10.0 - 20 AS lat, gx * 36.0 AS lon FROM a),
inside AS (SELECT box, cell, lat FROM cells JOIN areas ON lat BETWEEN south AND north AND (lon BETWEEN west AND least(east, 360) OR (east > 360 AND lon BETWEEN 0 AND east - 360)))"""


def _cells(a):
    return a.select("cell", (F.col("gy") * 10.0 - 20).alias("lat"), (F.col("gx") * 36.0).alias("lon")).distinct()


def region_means(spark, sf_dir):
    """Cosine-weighted means by month of overlapping, wrapped and empty boxes."""
    a = panel_a(spark, sf_dir)
    return S.box_means(a, _cells(a), S.boxes(spark, AREAS)).select("ym", "box", _R("mean", "mean"))


_REGION = f"""WITH {PANEL_A_SQL}, {_AREAS_SQL}, {_CELLS_SQL}
SELECT ym, box, round(sum(value * cos(radians(lat))) / sum(cos(radians(lat))), 6) AS mean FROM a JOIN inside USING (cell) GROUP BY 1, 2"""


def box_membership(spark, sf_dir):
    """How many boxes each cell is in, also none."""
    a = panel_a(spark, sf_dir)
    return S.members(_cells(a), S.boxes(spark, AREAS[1:]), "left").groupBy("cell").agg(F.count("box").alias("n_boxes"), F.min("box").alias("first_box"))


_MEMBERS = f"""WITH {PANEL_A_SQL}, {_AREAS_SQL}, {_CELLS_SQL}
SELECT cell, count(box) AS n_boxes, min(box) AS first_box FROM cells LEFT JOIN (SELECT * FROM inside WHERE box <> 'all') i USING (cell) GROUP BY 1"""


def neighbourhood_mean(spark, sf_dir):
    """5 x 5 means with repeated edges, months dense, missing where a neighbour is."""
    a = densify(panel_a(spark, sf_dir), (1995 * 12, 2001 * 12 + 10))
    return S.neighbourhood(on_grid(a, 10), ["ym"]).select("ym", "cell", _R("mean", "mean"))


_NEIGHBOURHOOD = f"""WITH {PANEL_A_SQL}, c AS (SELECT DISTINCT cell FROM a), m AS (SELECT CAST(unnest(range({1995 * 12}, {2001 * 12 + 11})) AS INTEGER) AS ym),
d AS (SELECT ym, cell, value, cell // 10 AS gy, cell % 10 AS gx FROM m CROSS JOIN c LEFT JOIN a USING (ym, cell)),
k AS (SELECT x.ym, x.cell, greatest(0, least(4, x.gy + i)) AS gy, greatest(0, least(9, x.gx + j)) AS gx FROM d x, (SELECT unnest(range(-2, 3)) AS i), (SELECT unnest(range(-2, 3)) AS j))
SELECT k.ym, k.cell, round(CASE WHEN count(value) = 25 THEN avg(value) END, 6) AS mean FROM k JOIN d ON d.ym = k.ym AND d.gy = k.gy AND d.gx = k.gx GROUP BY 1, 2"""


def regridded(spark, sf_dir):
    """The 5 x 10 grid of every month bilinearly on a finer one that reaches over its edge."""
    a = panel_a(spark, sf_dir).select("ym", "value", (F.col("gy") * 10.0).alias("lat"), (F.col("gx") * 10.0).alias("lon"))
    t = spark.range(0, 12 * 23).select(F.col("id").cast("int").alias("cell"), (F.floor(F.col("id") / 23) * 4.0).alias("lat"), (F.col("id") % 23 * 4.0 + 1).alias("lon"))
    return S.regrid(a, t, (10.0, 10.0), ["ym"]).where("value is not null").select("ym", "cell", _R("value", "value"))


_REGRID = f"""WITH {PANEL_A_SQL}, t AS (SELECT CAST(id AS INTEGER) AS cell, (id // 23) * 4.0 AS lat, (id % 23) * 4.0 + 1 AS lon FROM range(276) r(id)),
n AS (SELECT cell, floor(lat / 10) + i AS gy, floor(lon / 10) + j AS gx, (CASE WHEN i = 1 THEN lat / 10 - floor(lat / 10) ELSE 1 - lat / 10 + floor(lat / 10) END) * (CASE WHEN j = 1 THEN lon / 10 - floor(lon / 10) ELSE 1 - lon / 10 + floor(lon / 10) END) AS w
      FROM t, (VALUES (0), (1)) x(i), (VALUES (0), (1)) y(j)),
s AS (SELECT ym, n.cell, sum(w) AS w, sum(w * value) AS v FROM n JOIN a ON a.gy = n.gy AND a.gx = n.gx WHERE w > 0 GROUP BY 1, 2)
SELECT ym, cell, round(v, 6) AS value FROM s WHERE w > 1 - 1e-9"""


def shared_features(spark, sf_dir):
    """The month table: driver index and box means, lags, guarded rolling means, seasonal interactions keyed on the target month, frozen columns dropped."""
    a = panel_a(spark, sf_dir)
    regions = S.box_means(a, _cells(a), S.boxes(spark, AREAS)).groupBy("ym").pivot("box", ["all", "west", "middle"]).agg(F.first("mean"))
    old = driver_index(spark, sf_dir).select("ym", "x", F.lit(0).alias("rank"))
    again = old.where("ym >= 24000").select("ym", (F.col("x") + 1).alias("x"), F.lit(1).alias("rank"))  # a second copy of some months: the first stays
    index = M.keep_first(old.unionByName(again), "rank").drop("rank")
    t = M.shared_table(index, regions, {"x_djf": ("x", (12, 1, 2)), "west_jja": ("west", (6, 7, 8))}, ["x", "west"])
    t = M.freeze(t, lambda c: c.startswith("middle"))
    return t.select("ym", *[_R(F.round(F.col(c), 6) + 0.0, c) for c in t.columns if c != "ym"])  # no negative zero


_SHARED = f"""WITH {PANEL_A_SQL}, {INDEX_SQL}, {_AREAS_SQL}, {_CELLS_SQL},
r AS (SELECT ym, box, sum(value * cos(radians(lat))) / sum(cos(radians(lat))) AS mean FROM a JOIN inside USING (cell) GROUP BY 1, 2),
w AS (SELECT ym, max(mean) FILTER (box = 'all') AS "all", max(mean) FILTER (box = 'west') AS west, max(mean) FILTER (box = 'middle') AS middle FROM r GROUP BY 1),
j AS (SELECT ym, x, "all", west, middle FROM idx FULL JOIN w USING (ym)),
t AS (SELECT m.ym, x, "all", west, middle FROM (SELECT CAST(unnest(range((SELECT min(ym) FROM j), (SELECT max(ym) FROM j) + 1)) AS INTEGER) AS ym) m LEFT JOIN j USING (ym))
SELECT ym, round(x, 6) AS x, round("all", 6) AS "all", round(west, 6) AS west, round(sin(2 * pi() * (ym % 12 + 1) / 12), 6) + 0.0 AS month_sin, round(cos(2 * pi() * (ym % 12 + 1) / 12), 6) + 0.0 AS month_cos,
 round(lag(x, 1) OVER o, 6) AS x_lag1, round(lag(x, 2) OVER o, 6) AS x_lag2, round(lag(x, 3) OVER o, 6) AS x_lag3, round(lag(west, 1) OVER o, 6) AS west_lag1, round(lag(west, 2) OVER o, 6) AS west_lag2, round(lag(west, 3) OVER o, 6) AS west_lag3,
 round(CASE WHEN count(x) OVER k = 3 THEN avg(x) OVER k END, 6) AS x_mean3, round(CASE WHEN count(west) OVER k = 3 THEN avg(west) OVER k END, 6) AS west_mean3,
 round(CASE WHEN (ym + 1) % 12 + 1 IN (12, 1, 2) THEN x ELSE 0 END, 6) AS x_djf, round(CASE WHEN (ym + 1) % 12 + 1 IN (6, 7, 8) THEN west ELSE 0 END, 6) AS west_jja
FROM t WINDOW o AS (ORDER BY ym), k AS (ORDER BY ym ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)"""


def zonal_index(spark, sf_dir):
    """Difference of two bands' standardised month anomalies."""
    a = panel_a(spark, sf_dir).withColumn("lat", F.col("gy") * 10.0 - 20)
    return zonal_difference(a, (-20.0, -10.0), (10.0, 20.0)).select("ym", _R("index", "index"))


_ZONAL = f"""WITH {PANEL_A_SQL}, m AS (SELECT ym, avg(value) FILTER (gy IN (0, 1)) AS s, avg(value) FILTER (gy IN (3, 4)) AS n FROM a GROUP BY 1),
d AS (SELECT ym, s - avg(s) OVER (PARTITION BY ym % 12) AS s, n - avg(n) OVER (PARTITION BY ym % 12) AS n FROM m)
SELECT ym, round(s / (SELECT stddev_pop(s) FROM d) - n / (SELECT stddev_pop(n) FROM d), 6) AS index FROM d"""


def ensemble_anomalies(spark, sf_dir):
    """Mean of models' means of members, as anomalies from each start month's mean over the hindcast years that aren't excluded."""
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_shipdate", "l_suppkey", "l_linenumber", "l_quantity")
    runs = li.select((F.year("l_shipdate") * 12 + F.month("l_shipdate") - 1).cast("int").alias("ym"), (F.col("l_suppkey") % 3).cast("int").alias("model"), "l_linenumber", (F.col("l_suppkey") % 5).cast("int").alias("cell"), "l_quantity")
    members = runs.groupBy("model", "ym", F.col("l_linenumber").alias("member"), "cell").agg(F.avg("l_quantity").alias("value"))
    return debiased(ensemble_mean(members), 1999, [1997]).select("ym", "cell", _R("value", "value"), _R("anomaly", "anomaly"))


_ENSEMBLE = """WITH m AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS ym, l_suppkey % 3 AS model, l_linenumber, CAST(l_suppkey % 5 AS INTEGER) AS cell, avg(l_quantity) AS v FROM lineitem GROUP BY ALL),
e AS (SELECT ym, cell, avg(v) AS v FROM (SELECT model, ym, cell, avg(v) AS v FROM m GROUP BY ALL) GROUP BY ALL)
SELECT ym, cell, round(v, 6) AS value, round(v - avg(v) FILTER (ym // 12 <= 1999 AND ym // 12 <> 1997) OVER (PARTITION BY ym % 12, cell), 6) AS anomaly FROM e"""


def first_component(spark, sf_dir):
    """The first principal component of the panel's anomalies, fitted on the training years and oriented by the driver."""
    a = densify(panel_a(spark, sf_dir), (1995 * 12, 2001 * 12 + 10)).join(_cells(panel_a(spark, sf_dir)), "cell")
    return principal_component(a, driver_index(spark, sf_dir), 2000).select("ym", _R("pc", "pc"))


#: How often the months' Gram matrix is squared: its powers' columns are then the leading vector to all digits.
SQUARINGS = 14


def component_sql(rows: str, driver: str, last: int, basin: str = "true") -> str:
    """pc (ym, pc) of a table (ym, cell, lat, lon, value) and a driver (ym, x), as WITH clauses: powers of the Gram matrix in place of an eigensolver."""
    squares = "".join(f"""
g{k + 1} AS MATERIALIZED (SELECT i, j, x / max(abs(x)) OVER () AS x FROM (SELECT u.i, v.j, sum(u.x * v.x) AS x FROM g{k} u JOIN g{k} v ON u.j = v.i GROUP BY 1, 2)),""" for k in range(SQUARINGS))
    return f"""
n0 AS (SELECT ym, cell, lat, lon, value - avg(value) FILTER (ym // 12 <= {last}) OVER (PARTITION BY ym % 12, cell) AS an FROM {rows}),
n1 AS (SELECT ym, sum(an * cos(radians(lat))) / sum(cos(radians(lat))) AS m FROM n0 WHERE an IS NOT NULL GROUP BY 1),
n2 AS MATERIALIZED (SELECT ym, cell, (an - m) * sqrt(cos(radians(lat))) AS f FROM n0 JOIN n1 USING (ym) WHERE an IS NOT NULL AND {basin}),
gm AS MATERIALIZED (SELECT u.ym AS i, v.ym AS j, sum(u.f * v.f) AS x FROM n2 u JOIN n2 v USING (cell) GROUP BY 1, 2),
g0 AS MATERIALIZED (SELECT i, j, x / max(abs(x)) OVER () AS x FROM gm WHERE i // 12 <= {last} AND j // 12 <= {last}),{squares}
ve AS (SELECT i, x FROM g{SQUARINGS} WHERE j = (SELECT arg_max(i, x) FROM g{SQUARINGS} WHERE i = j)),
p0 AS (SELECT gm.i AS ym, sum(gm.x * ve.x) AS p FROM gm JOIN ve ON ve.i = gm.j GROUP BY 1),
p1 AS (SELECT ym, p * CASE WHEN (SELECT corr(p, x) FROM p0 JOIN {driver} USING (ym) WHERE ym // 12 <= {last} AND x IS NOT NULL) < 0 THEN -1 ELSE 1 END AS p FROM p0),
pc AS (SELECT ym, (p - (SELECT avg(p) FROM p1 WHERE ym // 12 <= {last})) / (SELECT stddev_pop(p) FROM p1 WHERE ym // 12 <= {last}) AS pc FROM p1)"""


_COMPONENT = f"""WITH {PANEL_A_SQL}, {INDEX_SQL}, al AS (SELECT ym, cell, gy * 10.0 - 20 AS lat, gx * 36.0 AS lon, value FROM a), {component_sql('al', 'idx', 2000)}
SELECT ym, round(pc, 6) AS pc FROM pc"""

QUERIES = {f.__name__: f for f in (region_means, box_membership, neighbourhood_mean, regridded, shared_features, zonal_index, ensemble_anomalies, first_component)}
ORACLES = {"region_means": _REGION, "box_membership": _MEMBERS, "neighbourhood_mean": _NEIGHBOURHOOD, "regridded": _REGRID, "shared_features": _SHARED, "zonal_index": _ZONAL, "ensemble_anomalies": _ENSEMBLE, "first_component": _COMPONENT}
