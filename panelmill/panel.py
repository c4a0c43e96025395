"""The panel: one row per month and cell, with month arithmetic, folds and the driver tables as panels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Years of the panels made from the driver's tables: training folds and the year held out.
YEARS, HOLDOUT = tuple(range(1995, 2001)), (2001,)


def month_index(ts: Column) -> Column:
    """Months since year 0, so that adding months is adding integers."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def with_calendar(df: DataFrame, ym: str = "ym") -> DataFrame:
    """df with year and month (1 to 12) of a month index, as plain columns that a scan can filter on."""
    return df.withColumn("year", F.floor(F.col(ym) / 12).cast("int")).withColumn("month", (F.col(ym) % 12 + 1).cast("int"))


def panel(rows: DataFrame, ts: Column, cell: Column, values: dict[str, Column]) -> DataFrame:
    """Monthly means of values by cell: ym, cell, year, month and the values. NaN counts as missing."""
    means = [F.avg(F.when(~F.isnan(v.cast("double")), v.cast("double"))).alias(name) for name, v in values.items()]
    return with_calendar(rows.groupBy(month_index(ts).alias("ym"), cell.cast("int").alias("cell")).agg(*means))


def on_grid(df: DataFrame, width: int) -> DataFrame:
    """df with grid row gy and column gx of its cells."""
    return df.withColumn("gy", F.floor(F.col("cell") / width).cast("int")).withColumn("gx", (F.col("cell") % width).cast("int"))


def densify(df: DataFrame, months: tuple[int, int], value: str = "value") -> DataFrame:
    """One row per cell and month of the range (both ends), value null where df has none. Lags by row are then lags by month."""
    cells = df.select("cell").distinct().select("cell", F.explode(F.sequence(F.lit(months[0]), F.lit(months[1]))).alias("ym"))
    return with_calendar(cells.join(df.select("cell", "ym", value), ["cell", "ym"], "left"))


def loyo_folds(spark: SparkSession, years: Sequence[int] = YEARS, holdout: Sequence[int] = HOLDOUT, embargo: int = 1) -> DataFrame:
    """fold, year, role: each year not held out is tested once; years within the embargo of it, and held-out years, don't train."""
    rows = []
    for fold in sorted(set(years) - set(holdout)):
        for y in sorted(set(years) - set(holdout)):
            rows.append((fold, y, "test" if y == fold else "banned" if abs(y - fold) <= embargo else "train"))
    return spark.createDataFrame(rows, "fold int, year int, role string")


def final_fit_years(years: Sequence[int] = YEARS, holdout: Sequence[int] = HOLDOUT) -> list[int]:
    """Years of a final fit: all but the ones held out."""
    return sorted(set(years) - set(holdout))


def panel_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem by part size: ym, cell 0 to 49 on a 5 x 10 grid, value and three further variables."""
    lines = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select("l_partkey", "l_shipdate", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_size")
    joined = lines.join(parts, F.col("l_partkey") == F.col("p_partkey"))
    values = {"value": F.col("l_quantity"), "price": F.col("l_extendedprice"), "discount": F.col("l_discount"), "tax": F.col("l_tax")}
    return on_grid(panel(joined, F.col("l_shipdate"), F.col("p_size") - 1, values), 10)


def panel_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders by the customer's nation: ym, cell 0 to 24 on a 5 x 5 grid, value."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_custkey", "o_orderdate", "o_totalprice")
    customers = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey")
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey"))
    return on_grid(panel(joined, F.col("o_orderdate"), F.col("c_nationkey"), {"value": F.col("o_totalprice")}), 5)


def driver_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ym, x: the month's mean order price as an anomaly of its calendar month, divided by the anomalies' deviation."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderdate", "o_totalprice")
    months = with_calendar(orders.groupBy(month_index(F.col("o_orderdate")).alias("ym")).agg(F.avg("o_totalprice").alias("v")))
    return standardised(months, "v").select("ym", F.col("z").alias("x"))


def standardised(months: DataFrame, value: str) -> DataFrame:
    """months (ym, month, value) with z: the anomaly of the calendar month over the deviation of all anomalies, null if that is 0."""
    normal = months.groupBy("month").agg(F.avg(value).alias("normal"))
    anomalies = months.join(normal, "month").withColumn("anomaly", F.col(value) - F.col("normal"))
    spread = anomalies.agg(F.stddev_pop("anomaly").alias("spread"))
    return anomalies.join(F.broadcast(spread)).withColumn("z", F.col("anomaly") / F.when(F.col("spread") > 0, F.col("spread")))  # one row


#: The same panels in DuckDB's SQL, as the start of a WITH clause.
PANEL_A_SQL = """
pa AS (SELECT CAST(year(l_shipdate) * 12 + month(l_shipdate) - 1 AS INTEGER) AS ym, CAST(p_size - 1 AS INTEGER) AS cell, avg(l_quantity) AS value,
       avg(l_extendedprice) AS price, avg(l_discount) AS discount, avg(l_tax) AS tax
       FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1, 2),
a AS (SELECT *, CAST(ym // 12 AS INTEGER) AS year, CAST(ym % 12 + 1 AS INTEGER) AS month, CAST(cell // 10 AS INTEGER) AS gy, CAST(cell % 10 AS INTEGER) AS gx FROM pa)"""
PANEL_B_SQL = """
pb AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS ym, CAST(c_nationkey AS INTEGER) AS cell, avg(o_totalprice) AS value
       FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2),
b AS (SELECT *, CAST(ym // 12 AS INTEGER) AS year, CAST(ym % 12 + 1 AS INTEGER) AS month, CAST(cell // 5 AS INTEGER) AS gy, CAST(cell % 5 AS INTEGER) AS gx FROM pb)"""
INDEX_SQL = """
im AS (SELECT CAST(year(o_orderdate) * 12 + month(o_orderdate) - 1 AS INTEGER) AS ym, avg(o_totalprice) AS v FROM orders GROUP BY 1),
ia AS (SELECT ym, v - avg(v) OVER (PARTITION BY ym % 12) AS an FROM im),
idx AS (SELECT ym, an / nullif((SELECT stddev_pop(an) FROM ia), 0) AS x FROM ia)"""
FOLDS_SQL = f"""
yrs AS (SELECT CAST(unnest(range({YEARS[0]}, {YEARS[-1] + 1})) AS INTEGER) AS year),
folds AS (SELECT f.year AS fold, y.year, CASE WHEN y.year = f.year THEN 'test' WHEN abs(y.year - f.year) <= 1 THEN 'banned' ELSE 'train' END AS role FROM yrs f, yrs y)"""
