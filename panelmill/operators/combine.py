"""Prediction tables (id, value): blends, damping, gated inflation, splices, ids and the validator."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.climatology import clip0


def make_id(year: Column, month: Column, lat: Column, lon: Column) -> Column:
    """2023_01_-60.00_-90.00"""
    return F.format_string("%d_%02d_%.2f_%.2f", year, month, lat, lon)


def parse_id(key: Column, step: float = 0.25, south: float = -60.0, west: float = -90.0) -> dict[str, Column]:
    """year, month, gy and gx of an id; gy and gx count grid steps from the south and the west."""
    part = F.split(key, "_")
    place = lambda k, low: F.round((part[k].cast("double") - low) / step).cast("int")
    return {"year": part[0].cast("int"), "month": part[1].cast("int"), "gy": place(2, south), "gx": place(3, west)}


def on_cells(table: DataFrame, width: int, height: int, key: str = "id") -> DataFrame:
    """table with year, month, ym and cell of its ids, on a grid of width x height. An id beyond the grid, or none at all, stops the query."""
    where = table.withColumns(parse_id(F.col(key)))
    inside = F.coalesce(F.col("gy").between(0, height - 1) & F.col("gx").between(0, width - 1) & F.col("month").between(1, 12), F.lit(False))
    cell = F.when(inside, F.col("gy") * width + F.col("gx")).otherwise(F.raise_error(F.concat(F.lit("not on the grid: "), F.coalesce(F.col(key), F.lit("no id")))).cast("int"))
    return where.withColumn("ym", F.col("year") * 12 + F.col("month") - 1).withColumn("cell", cell).drop("gy", "gx")


def expected_ids(spark: SparkSession, months: Sequence[int], width: int, height: int, step: float = 0.25, south: float = -60.0, west: float = -90.0) -> DataFrame:
    """row_id, id of all months and places in the canonical order: time, latitude, longitude."""
    cells = width * height
    first = spark.createDataFrame([(k, int(ym)) for k, ym in enumerate(sorted(months))], "k bigint, ym int")
    rows = spark.range(cells).join(F.broadcast(first)).withColumn("row_id", F.col("k") * cells + F.col("id"))  # a row for each month
    lat, lon = F.floor(F.col("id") / width) * step + south, F.col("id") % width * step + west
    return rows.select("row_id", make_id(F.floor(F.col("ym") / 12).cast("int"), (F.col("ym") % 12 + 1).cast("int"), lat, lon).alias("id"))


def blend(parts: Sequence[tuple[DataFrame, float]], key: str = "id", value: str = "value") -> DataFrame:
    """Weighted mean of tables with the same ids, weights normalised to a sum of 1, clipped at 0. An id that a table lacks stops the query."""
    total, out = sum(w for _, w in parts), None
    for k, (df, w) in enumerate(parts):
        own = df.select(key, (F.col(value) * (w / total)).alias(f"__{k}"), F.lit(True).alias(f"__has{k}"))
        out = own if out is None else out.join(own, key, "full")
    every = F.lit(True)
    for k in range(len(parts)):
        every = every & F.col(f"__has{k}").isNotNull()
    stop = F.raise_error(F.concat(F.lit("not in all tables: "), F.col(key))).cast("double")
    return out.select(key, F.when(every, clip0(sum((F.col(f"__{k}") for k in range(1, len(parts))), F.col("__0")))).otherwise(stop).alias(value))


def same_ids(a: DataFrame, b: DataFrame, key: str = "id") -> DataFrame:
    """n_missing: ids that only one of both tables has."""
    one = a.select(key).join(b.select(key), key, "left_anti").unionAll(b.select(key).join(a.select(key), key, "left_anti"))
    return one.agg(F.count("*").alias("n_missing"))


def damp(value: Column, clim: Column, gamma: float | Column) -> Column:
    """clip0(clim + gamma (value - clim)): 1 leaves the value, less pulls it to the climatology, more pushes it away."""
    return clip0(clim + gamma * (value - clim))


def splice(a: DataFrame, b: DataFrame, year: int, key: str = "id") -> DataFrame:
    """Rows of a, but for ids of the given year those of b."""
    own = F.col(key).startswith(f"{year}_")
    return a.where(~own).unionByName(b.where(own))


def validate(out: DataFrame, expected: DataFrame, key: str = "id", value: str = "value", order: str = "row_id") -> DataFrame:
    """One row: columns_ok, rows_ok, ids_ok (same ids in the same order), no_missing, non_negative, valid."""
    columns = [c for c in out.columns if c != order] == [key, value]
    pair = out.select(order, F.col(key).alias("__got"), F.col(value).cast("double").alias("__v")).join(expected.select(order, F.col(key).alias("__want")), order, "full")
    missing = F.col("__v").isNull() | F.isnan("__v")
    one = pair.agg(
        (F.count("__got") == F.count("__want")).alias("rows_ok"), (F.coalesce(F.sum(F.when(F.col("__got").eqNullSafe(F.col("__want")), 0).otherwise(1)), F.lit(0)) == 0).alias("ids_ok"),
        (F.coalesce(F.sum(F.when(F.col("__got").isNotNull() & missing, 1).otherwise(0)), F.lit(0)) == 0).alias("no_missing"),
        F.coalesce(F.min(F.when(~F.isnan("__v"), F.col("__v"))) >= 0, F.lit(True)).alias("non_negative"),
    )
    one = one.select(F.lit(columns).alias("columns_ok"), "*")
    return one.withColumn("valid", F.expr("columns_ok and rows_ok and ids_ok and no_missing and non_negative"))
