"""Helpers that the training-data operators share: the shared folder, cut lineage, and Arrow text chunks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Written tables of up to this many bytes may be broadcast (some 16 bytes for a row and 16 for each of its columns); beyond it the same join shuffles.
BROADCAST_BYTES = 32 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, by the session's spark.checkpoint.dir."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where


#: What holds while an intermediate table is written: a query's shuffle files go as soon as it has ended, since all that
#: is read again is a written table, and rows of whole texts go to Python few at a time.
_WRITING = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true", "spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}


def written(df: DataFrame, path: str, mode: str = "error") -> DataFrame:
    """Write df as Parquet under _WRITING and read it back."""
    spark = df.sparkSession
    was = {key: spark.conf.get(key, None) for key in _WRITING}
    for key, value in _WRITING.items():
        spark.conf.set(key, value)
    try:
        df.write.mode(mode).parquet(path)
    finally:
        for key, value in was.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    return spark.read.schema(df.schema).parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimiser takes df's size to be: of files, their bytes."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: cuts lineage, so a lost executor costs a reread and no rerun."""
    return written(df, f"{shared_dir(df.sparkSession)}/mill-{uuid.uuid4().hex}/{name}")


class Scratch:
    """Tables of one run in the shared folder, which it deletes as soon as nothing reads them any more."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root, self.paths = spark, f"{shared_dir(spark)}/mill-{uuid.uuid4().hex}", {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """As materialize(). What an earlier call of that name wrote stays until free()."""
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        self.paths.setdefault(name, []).append(path)
        return written(df, path)

    def free(self, *names: str) -> None:
        """Delete the tables of these names, those that exist."""
        jvm, conf = self.spark._jvm, self.spark._jsc.hadoopConfiguration()
        for path in [p for name in names for p in self.paths.pop(name, [])]:
            where = jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


#: Bytes of records that one bucket holds, of operators whose tasks work on a bucket as a whole.
BUCKET_BYTES = 64 << 20


def buckets_for(spark: SparkSession, size: int) -> int:
    """Buckets for so many bytes of records: they grow with the input, and are at least the session's shuffle partitions."""
    return max(partitions(spark), -(-size // BUCKET_BYTES))


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z alone. lower() touches other letters too, so it serves only texts that are ASCII throughout."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def small(df: DataFrame) -> DataFrame:
    """A written table of a few short columns, marked for broadcast if its rows are counted to be few; else a join shuffles it."""
    return F.broadcast(df) if df.count() * 16 * (1 + len(df.columns)) <= BROADCAST_BYTES else df


def partition_starts(parts: DataFrame) -> DataFrame:
    """parts (part, n; a row per partition of some table) with base, the sum of n over all earlier partitions."""
    return parts.select("part", "n", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("base"))


#: Bytes of input for each task that runs at once, below which an input is dealt out anew.
SPREAD_BYTES = 8 << 20


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as tasks run at once, if it is a small input of few files, whose file may be one row group and so one task.

    Larger inputs have splits enough and stay where they are: no shuffle.
    """
    tasks = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(tasks) if estimated_bytes(df) < tasks * SPREAD_BYTES and len(df.inputFiles()) < tasks else df


def semi(df: DataFrame, ids: DataFrame, key: str, how: str = "left_semi") -> DataFrame:
    """Semi or anti join on an id column. ids is broadcast if it is counted to be small, else both sides shuffle."""
    return df.join(small(materialize(ids.select(key).distinct(), "ids")), key, how)


def chunks(batch: pa.RecordBatch, column: str, limit: int = 1 << 21) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Cut an Arrow batch into runs of rows whose texts hold some limit bytes (one longer text is a run by itself).

    Yields first row, end row, the bytes of their texts as uint8, and each text's offsets in those. Null texts are empty.
    """
    texts = batch.column(batch.schema.get_field_index(column))
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, texts.offset * 8)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None and offsets[-1] else np.zeros(0, np.uint8)
    a = 0
    while a < len(texts):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + limit, "right")) - 1)
        b = min(b, len(texts))
        yield a, b, data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def unused(name: str, columns: list[str]) -> str:
    """name with underscores before it, so many that no column has it (in any case)."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def texts_bytes(batch: pa.RecordBatch, name: str) -> Iterator[bytes]:
    """The texts of a batch one by one as UTF-8 bytes; null is empty."""
    for _, _, data, offsets in chunks(batch, name):
        raw, ends = data.tobytes(), offsets.tolist()
        for a, b in zip(ends, ends[1:], strict=False):
            yield raw[a:b]


#: Bases of the polynomial hashes over bytes: the usual one, and one for further bits of the same bytes. Both are odd, so they have inverses modulo 2**64.
BASE, OTHER_BASE = 0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base**0 .. base**(n-1) modulo 2**64, kept between calls."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, 1 << 12)
        have = np.ones(1, np.uint64)
        while len(have) < size:
            have = np.concatenate([have, have * np.uint64(pow(base, len(have), 1 << 64))])
        if size <= 1 << 23:
            _powers[base] = have
    return have[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values (a bijection), so that low and high bits are uniform."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def prefix_hash(data: np.ndarray, base: int = BASE) -> np.ndarray:
    """C with C[i] the polynomial hash of data[:i]; span_hash() takes spans' hashes from it."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(base, len(data)), out=out[1:])
    return out


def span_hash(c: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice, base: int = BASE) -> np.ndarray:
    """64-bit hashes of data[start:end], alike wherever the bytes stand. base: that of prefix_hash()."""
    return mix((c[end] - c[start]) * powers(pow(base, -1, 1 << 64), len(c))[start])
