"""Exact duplicates by content sort: range partitions, sorted texts, and full comparison of neighbours.

Sampled splitters deal the normalised texts into ranges, each range is sorted (Spark spills to disk), and each text is
compared in full with its neighbour. The sort key starts with a short prefix and the digest, so the samples that reach
the driver stay small, and ends with the id, so one text that fills a third of the table is cut over many ranges. Runs
of equal texts leave as segments of at most SEGMENT ids, and only these meet again to settle the run's keeper and size.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import ascii_lower, column, materialize, partitions, semi, unused

SEGMENT = 1000
_SEGMENTS = "ids array<bigint>, sha binary, low bigint, high bigint, n bigint"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Segments of equal neighbours. A run that crosses a batch or a range yields several segments of one digest."""
    for batch in batches:
        n, texts, ids = batch.num_rows, column(batch, "norm"), column(batch, "id").to_numpy(zero_copy_only=False)
        if not n:
            continue
        equal = pc.equal(texts.slice(1), texts.slice(0, n - 1)).to_numpy(zero_copy_only=False).astype(bool)
        starts = np.concatenate([[0], 1 + np.flatnonzero(~equal)])
        length = np.diff(np.concatenate([starts, [n]]))
        within = np.arange(n) - np.repeat(starts, length)
        starts = np.flatnonzero(within % SEGMENT == 0)
        offsets = pa.array(np.concatenate([starts, [n]]).astype(np.int32))
        yield pa.RecordBatch.from_arrays(
            [
                pa.ListArray.from_arrays(offsets, pa.array(ids)),
                column(batch, "sha").take(pa.array(starts)),
                pa.array(np.minimum.reduceat(ids, starts)),
                pa.array(np.maximum.reduceat(ids, starts)),
                pa.array(np.diff(np.concatenate([starts, [n]])).astype(np.int64)),
            ],
            ["ids", "sha", "low", "high", "n"],
        )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "min") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after lower-casing A-Z only; null counts as empty, and empty texts equal each other.
    keep names whether the smallest or the largest id of equal texts stays. Rows that repeat an id and its text all
    count in group_size and share the verdict. A null id counts as the smallest possible one and comes back as null.
    Other columns of docs, whatever their names, are not read.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    spark, null_id = docs.sparkSession, -(2**63)
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(null_id)).alias("id"), F.coalesce(ascii_lower(F.col(text_col)), F.lit("")).alias("norm"))
    rows = rows.select("id", "norm", F.substring("norm", 1, 24).alias("head"), F.unhex(F.sha2("norm", 256)).alias("sha"))
    key = ["head", "sha", "id"]
    ranged = rows.repartitionByRange(partitions(spark), *key).sortWithinPartitions("head", "sha", "norm", "id")
    segments = materialize(ranged.select("id", "norm", "sha").mapInArrow(_runs, _SEGMENTS), "segments")
    best = F.min("low") if keep == "min" else F.max("high")
    groups = segments.groupBy("sha").agg(best.alias("best"), F.sum("n").alias("size"), F.count("*").alias("parts"))
    groups = materialize(groups.where("parts > 1").drop("parts"), "groups")
    own = F.col("low" if keep == "min" else "high")
    out = segments.join(groups, "sha", "left").select(
        F.explode("ids").alias("id"), F.coalesce("best", own).alias("keep_id"), F.coalesce("size", "n").alias("group_size"), F.lower(F.hex("sha")).alias("text_sha256")
    )
    back = lambda c: F.when(F.col(c) != null_id, F.col(c))
    return out.select(back("id").alias("doc_id"), back("keep_id").alias("keep_id"), "group_size", (F.col("id") == F.col("keep_id")).alias("kept"), "text_sha256")


def unique_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that stay when of equal texts the smallest doc_id is kept.

    A row that repeats an id and its text to the letter goes too.
    """
    label = unused("name", docs.columns)
    name = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.sha2(F.coalesce(ascii_lower(F.col("text")), F.lit("")), 256))
    found = materialize(exact_dedup(docs), "found")
    verdict = found.select(F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_sha256").alias(label), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("stays"))
    named = semi(docs.withColumn(label, name), verdict.where(~F.col("stays")), label, "left_anti")
    again = materialize(verdict.where("stays").groupBy(label).agg(F.count("*").alias("n")).where("n > 1"), "again")
    if again.limit(1).count():
        many = semi(named, again, label).dropDuplicates([label])
        named = semi(named, again, label, "left_anti").unionByName(many)
    return named.drop(label)


def op3_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents; of equal texts the row with the largest doc_id stays."""
    return exact_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep="max")


SQL = """
WITH norm AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
grouped AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM norm GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM norm JOIN grouped USING (t)
"""
