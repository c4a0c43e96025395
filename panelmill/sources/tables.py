"""Sources and sinks: out-of-fold stores, submission files, month-index texts and model names from paths."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, by the session's spark.checkpoint.dir."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return where


def save_oof(preds: DataFrame, folder: str, via: str) -> None:
    """Write predictions (ym, cell, pred, fold) under via and fold; only the folds that preds has are replaced."""
    out = preds.select("ym", "cell", "pred", F.lit(via).alias("via"), "fold").repartition("fold")
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("via", "fold").parquet(folder)


def load_oof(spark: SparkSession, folder: str, via: str | None = None) -> DataFrame:
    """All predictions, or those of one method (other partitions are not read)."""
    out = spark.read.schema("ym int, cell int, pred double, via string, fold int").parquet(folder)
    return out if via is None else out.where(F.col("via") == via)


def write_csv(rows: DataFrame, folder: str, order: str) -> None:
    """CSV files without headers that hold rows in order: each task sorts a range, and the files' names ascend with the ranges."""
    rows.orderBy(order).drop(order).write.mode("overwrite").csv(folder)


def join_files(spark: SparkSession, folder: str, path: str, header: str) -> None:
    """One file of a header line and the bytes of all part files of folder in the order of their names, copied in the file system a buffer at a time."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    source, target = jvm.org.apache.hadoop.fs.Path(folder), jvm.org.apache.hadoop.fs.Path(path)
    fs = source.getFileSystem(conf)
    names = sorted(s.getPath().getName() for s in fs.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = target.getFileSystem(conf).create(target, True)
    try:
        out.write((header + "\n").encode())
        for name in names:
            own = fs.open(jvm.org.apache.hadoop.fs.Path(source, name))
            try:
                jvm.org.apache.hadoop.io.IOUtils.copyBytes(own, out, conf, False)
            finally:
                own.close()
    finally:
        out.close()


def write_submission(out: DataFrame, folder: str, rows: int, order: str = "row_id") -> str:
    """The path of a CSV of id and value (six decimals, clipped at 0) in the order of row_id, under folder; another number of rows raises ValueError.

    Ranges of rows are sorted and written in parallel, then their files are joined byte by byte.
    """
    if (n := out.count()) != rows:
        raise ValueError(f"{n} rows, {rows} expected")
    value = F.when(F.col("value").isNotNull(), F.greatest("value", F.lit(0.0)))
    write_csv(out.select(order, "id", F.format_string("%.6f", value).alias("value")), f"{folder}/parts", order)
    join_files(out.sparkSession, f"{folder}/parts", f"{folder}/submission.csv", "id,value")
    return f"{folder}/submission.csv"


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """The ids of a CSV with columns id and value; the other column is not parsed."""
    return spark.read.schema("id string, value double").option("header", True).csv(path).select("id")


def cached_ids(spark: SparkSession, path: str, folder: str) -> DataFrame:
    """read_ids() with row_id, the place in the file; parsed once and kept as Parquet in folder, which later calls read."""
    jvm = spark._jvm
    done = jvm.org.apache.hadoop.fs.Path(f"{folder}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        ids = read_ids(spark, path).withColumn("at", F.monotonically_increasing_id())  # ascends with the file's lines
        before = ids.groupBy(F.spark_partition_id().alias("part")).agg(F.count("*").alias("n"))
        before = before.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each split
        place = F.col("before") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
        rows = ids.withColumn("part", F.shiftright("at", 33).cast("int")).join(F.broadcast(before), "part")
        rows.select(place.alias("row_id"), "id").write.mode("overwrite").parquet(folder)
    return spark.read.schema("row_id bigint, id string").parquet(folder)


def month_index_text(spark: SparkSession, path: str, missing: float = -99.99) -> DataFrame:
    """ym, value from lines `year v1 .. v12`; missing values are null; header, notes and anything else are left out."""
    parts = spark.read.text(path).select(F.split(F.btrim("value"), r"\s+").alias("p")).where(F.size("p") == 13)
    number = r"^-?\d+(\.\d+)?$"
    parts = parts.where(F.col("p")[0].rlike(r"^\d{4}$") & F.forall("p", lambda x: x.rlike(number)))
    rows = parts.select(F.col("p")[0].cast("int").alias("year"), F.posexplode(F.slice("p", 2, 12)).alias("m", "v"))
    v = F.col("v").cast("double")
    return rows.select((F.col("year") * 12 + F.col("m")).cast("int").alias("ym"), F.when(v > missing + 1e-6, v).alias("value"))


def first_there(spark: SparkSession, paths: Sequence[str]) -> str:
    """The first of several paths that exists, in any file system that Spark reads; FileNotFoundError if none does."""
    for path in paths:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        if p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p):
            return path
    raise FileNotFoundError(", ".join(paths))


def save_models(fields: DataFrame, folder: str) -> None:
    """Write fields (model and others) by model; only the models that fields has are replaced."""
    fields.repartition("model").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("model").parquet(folder)


def with_model(df: DataFrame) -> DataFrame:
    """df with model: the file's name up to its first underscore."""
    return df.withColumn("model", F.regexp_extract(F.col("_metadata.file_name"), r"^([^_]+)_", 1))
