"""Operators over the grid: weighted box means, box membership, wrap-around boxes, neighbourhood means, regridding."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def boxes(spark, rows: Sequence[tuple[str, float, float, float, float]]) -> DataFrame:
    """box, west, east, south, north. A box with east over 360 wraps around; both its pieces include their bounds."""
    return spark.createDataFrame([(n, *map(float, b)) for n, *b in rows], "box string, west double, east double, south double, north double")


def in_box(lat: Column, lon: Column) -> Column:
    """Whether a place is in the box of the same row; bounds are inside."""
    plain = lon.between(F.col("west"), F.col("east"))
    wrapped = lon.between(F.col("west"), F.lit(360.0)) | lon.between(F.lit(0.0), F.col("east") - 360)
    return lat.between(F.col("south"), F.col("north")) & F.when(F.col("east") > 360, wrapped).otherwise(plain)


def in_bounds(lat: Column, lon: Column, west: float, east: float, south: float, north: float) -> Column:
    """in_box() for a box given as numbers."""
    around = lon.between(west, 360.0) | lon.between(0.0, east - 360) if east > 360 else lon.between(west, east)
    return lat.between(south, north) & around


def members(cells: DataFrame, areas: DataFrame, how: str = "inner") -> DataFrame:
    """cells (cell, lat, lon) with the boxes that they lie in: none, one or several rows; left keeps cells in no box. areas is a handful of rows."""
    return cells.join(F.broadcast(areas), in_box(F.col("lat"), F.col("lon")), how)


def box_means(rows: DataFrame, cells: DataFrame, areas: DataFrame, value: str = "value", weighted: bool = True) -> DataFrame:
    """ym, box, mean: by the cosine of latitude (weights of missing values don't count) or plain; a box without values has no row."""
    inside = members(cells, areas).select("box", "cell", "lat")
    joined = rows.join(inside, "cell")  # cells times boxes grow with the grid: their size decides how they join
    w = F.cos(F.radians("lat")) if weighted else F.lit(1.0)
    some = F.when(F.col(value).isNotNull(), w)
    return joined.groupBy("ym", "box").agg((F.sum(F.col(value) * w) / F.sum(some)).alias("mean"))


def recentred(lon: Column) -> Column:
    """Longitudes of 0 to 360 as -180 to 180."""
    return F.when(lon > 180, lon - 360).otherwise(lon)


def neighbourhood(rows: DataFrame, keys: Sequence[str], value: str | Sequence[str] = "value", size: int = 5) -> DataFrame:
    """rows with mean: over the size x size cells around each, the edge repeated outwards. rows hold a full grid gy, gx for each key.

    Two passes, along rows and along columns; a missing neighbour makes the mean missing. Of several values the means
    are <value>_mean, all from the same two passes.
    """
    values = [value] if isinstance(value, str) else list(value)

    def along(df: DataFrame, sources: Sequence[str], to: Sequence[str], line: str, order: str) -> DataFrame:
        w = W.partitionBy(*keys, line).orderBy(order)
        whole, half = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing), size // 2
        place, n = F.row_number().over(w), F.count(F.lit(1)).over(W.partitionBy(*keys, line))

        def mean(source: str) -> Column:
            first, last = F.first(source).over(whole), F.last(source).over(whole)
            terms = [F.when(place - k < 1, first).otherwise(F.lag(source, k).over(w)) for k in range(half, 0, -1)]
            terms += [F.col(source)] + [F.when(place + k > n, last).otherwise(F.lead(source, k).over(w)) for k in range(1, half + 1)]
            return sum(terms[1:], terms[0]) / size

        return df.select("*", *[mean(c).alias(name) for c, name in zip(sources, to, strict=True)])

    half_way = [f"__row{k}" for k in range(len(values))]
    names = ["mean"] if isinstance(value, str) else [f"{v}_mean" for v in values]
    return along(along(rows, values, half_way, "gy", "gx"), half_way, names, "gx", "gy").drop(*half_way)


def regrid(source: DataFrame, targets: DataFrame, step: tuple[float, float], keys: Sequence[str], value: str = "value") -> DataFrame:
    """Bilinear values at targets (cell, lat, lon) from a regular grid (lat, lon multiples of step); null outside of it.

    Each target joins the up to four nodes around it; nodes of no weight needn't exist.
    """
    low = lambda c, s: F.floor(F.col(c) / s)
    f = lambda c, s: F.col(c) / s - low(c, s)
    node = F.explode(F.array(*[F.struct((low("lat", step[0]) + i).cast("long").alias("i"), (low("lon", step[1]) + j).cast("long").alias("j"),
        ((f("lat", step[0]) if i else 1 - f("lat", step[0])) * (f("lon", step[1]) if j else 1 - f("lon", step[1]))).alias("w")) for i in (0, 1) for j in (0, 1)]))
    around = targets.select("cell", node.alias("node")).select("cell", "node.*").where("w > 0")
    nodes = source.select(*keys, F.round(F.col("lat") / step[0]).cast("long").alias("i"), F.round(F.col("lon") / step[1]).cast("long").alias("j"), value)
    got = around.join(nodes, ["i", "j"]).groupBy(*keys, "cell").agg(F.sum("w").alias("__w"), F.sum(F.col("w") * F.col(value)).alias("__v"), F.count(value).alias("__n"), F.count("*").alias("__m"))
    return got.select(*keys, "cell", F.when((F.col("__w") > 1 - 1e-9) & (F.col("__n") == F.col("__m")), F.col("__v")).alias(value))
