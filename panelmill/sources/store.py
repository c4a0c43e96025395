"""A panel kept by blocks of cells, so that fits scan it without a shuffle, and the store of predictions that sweeps read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelmill.operators.ridge import BLOCK


def save_blocks(panel: DataFrame, name: str, folder: str, buckets: int) -> None:
    """Write a panel (ym, cell and others) as the table `name` under folder, in buckets of whole blocks of BLOCK cells, sorted by cell and month.

    One shuffle deals the rows out by block; one file holds each bucket. buckets: at most the grid's number of blocks.
    """
    rows = panel.withColumn("block", F.floor(F.col("cell") / BLOCK).cast("int")).repartition(buckets, "block")
    rows.write.mode("overwrite").option("path", folder).bucketBy(buckets, "block").sortBy("cell", "ym").saveAsTable(name)


def load_blocks(spark: SparkSession, name: str, columns: Sequence[str], eager: bool = False) -> DataFrame:
    """block, ym, cell and columns of a stored panel; others are not read. eager keeps them in memory, and on disk beyond it, until unpersist()."""
    rows = spark.table(name).select("block", "ym", "cell", *columns)
    return rows.persist(StorageLevel.MEMORY_AND_DISK) if eager else rows


_PREDS = "ym int, cell int, lag int, value double, clim double, base double, corr double, fold int, gap int"


def save_preds(preds: DataFrame, folder: str) -> None:
    """Write predictions in folders by fold and gap; only the folds and gaps that preds has are replaced."""
    names = [c.split()[0] for c in _PREDS.split(", ")]
    preds.select(*names).repartition("fold", "gap").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("fold", "gap").parquet(folder)


def load_preds(spark: SparkSession, folder: str) -> DataFrame:
    """What save_preds() has written; filters on fold and gap leave other folders unread."""
    return spark.read.schema(_PREDS).parquet(folder)
