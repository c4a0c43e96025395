"""Importance resampling towards a target distribution: bucketed n-gram counts, exact scores, and ranks from a histogram.

Each text's features are its runs of one to three words; a feature's bucket is its CRC-32 modulo BUCKETS. One pass over
the texts writes every document's bucket numbers, two bytes each, and counts are sums of those. The gain of a bucket is
an integer, looked up in one array, and a document's weight is the sum over its numbers. Scores add noise that depends on
the id alone, so that taking the highest ones draws without replacement in proportion to the weights.

Scores are integers. Their histogram is dealt out by ranges of scores, and suffix sums within and over the ranges tell
how many documents stand above a score. Those sums give the cutoff, and only documents at or above it are numbered, by
doc_id within each score. The noise spreads texts that are alike over thousands of scores (no score gets more than
about one in 2,700 of them), so a score has few documents however many copies a text has.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch, column, partition_starts, partitions, small, spread, texts_bytes

BUCKETS, LONGEST, LEAST_WORDS, PERCENT, SEED = 10_000, 3, 20, 5, 42
#: Bytes of a text whose words are objects at one time.
SEGMENT = 1 << 20
_WORD = frozenset(b"0123456789abcdefghijklmnopqrstuvwxyz") | frozenset(range(128, 256))
#: Lower-case A-Z, and a space for every byte that is not part of a word.
_FOLD = bytes(c if c in _WORD else 32 for c in bytes(range(256)).lower())


def words(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text in runs, so that a text of any length has few of them as objects."""
    data, at = text.translate(_FOLD), 0
    while at < len(data):
        end = data.find(b" ", at + SEGMENT)
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


def features(text: bytes, longest: int = LONGEST) -> tuple[int, np.ndarray]:
    """Number of words, and the CRC-32 of every run of 1 to `longest` words joined by a space."""
    n, out, before = 0, [], []
    for own in words(text):
        k, run = len(before), before + own
        n += len(own)
        spaced, crcs = [b" " + w for w in run], list(map(zlib.crc32, run))
        for size in range(longest):  # a run's CRC goes on from that of the run without its last word
            if size:
                crcs = list(map(zlib.crc32, spaced[size:], crcs))
            out.append(np.array(crcs[max(k - size, 0) :], np.uint32))
        before = run[-(longest - 1) :] if longest > 1 else []
    return n, np.concatenate(out) if out else np.zeros(0, np.uint32)


def hashed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, longest: int = LONGEST) -> DataFrame:
    """doc_id, n_words, buckets (the features' bucket numbers as little-endian integers) of each row."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, own = [], []
            for text in texts_bytes(batch, "text"):
                count, crcs = features(text, longest)
                n.append(count)
                own.append((crcs % np.uint32(buckets)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(n, pa.int64()), pa.array(own, pa.binary())], ["doc_id", "n_words", "buckets"])

    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(work, "doc_id bigint, n_words bigint, buckets binary")


def bucket_counts(rows: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket over all rows of hashed(); tasks send one number for each bucket at most."""
    kind = "<u2" if buckets <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in column(batch, "buckets"):
                held += np.bincount(np.frombuffer(raw.as_buffer(), kind), minlength=buckets)
        some = np.flatnonzero(held)
        yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(held[some])], ["bucket", "n"])

    sums = rows.select("buckets").mapInArrow(work, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).collect()  # a row for each bucket
    out = np.zeros(buckets, np.int64)
    for bucket, n in sums:
        out[bucket] = n
    return out


def gains(target: np.ndarray, source: np.ndarray) -> np.ndarray:
    """Thousandths of the logarithm of a bucket's smoothed share of the target over that of the source, rounded down."""
    t, s, n = target.astype(float), source.astype(float), float(len(source))
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, rounded down, from the digest of seed and id."""
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(name, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("bigint")


def weighed(rows: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight of rows of hashed(): the sum of the gains of a row's features."""
    kind = "<u2" if len(gain) <= 1 << 16 else "<u4"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(raw.as_buffer(), kind) for raw in column(batch, "buckets")]
            cols = [column(batch, "doc_id"), column(batch, "n_words"), pa.array([len(x) for x in own], pa.int64()), pa.array([int(gain[x].sum()) for x in own], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(work, "doc_id bigint, n_words bigint, n_features bigint, weight bigint")


def _above(rows: DataFrame) -> DataFrame:
    """part, score, n, before: the histogram of scores, dealt out by ranges from the highest score on, with the rows above each score in its range."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = column(batch, "n").to_numpy(zero_copy_only=False)
            ends = before + np.cumsum(n)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(n), part, np.int32)), column(batch, "score"), column(batch, "n"), pa.array(ends - n)], ["part", "score", "n", "before"])
            before = int(ends[-1]) if len(n) else before

    hist = rows.groupBy("score").agg(F.count("*").alias("n"))
    ranged = hist.repartitionByRange(partitions(rows.sparkSession), F.desc("score")).sortWithinPartitions(F.desc("score"))
    return ranged.mapInArrow(work, "part int, score bigint, n bigint, before bigint")


def ranked(scored: DataFrame, eligible: Column, percent: int = PERCENT) -> DataFrame:
    """scored (doc_id, n_features, weight, score and others) with rank: 1, 2, ... from the highest score on, for `percent` of the eligible rows (rounded down).

    Ties go to the smaller doc_id, a null one first, then to the fewer features. Rows that are not drawn have a null rank.
    """
    scratch = Scratch(scored.sparkSession)
    rows = scratch.write(scored.withColumn("eligible", F.coalesce(eligible, F.lit(False))), "scored")
    hist = scratch.write(_above(rows.where("eligible")), "histogram")
    parts = scratch.write(partition_starts(hist.groupBy("part").agg(F.sum("n").alias("n"))), "parts")
    total = parts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    draw = percent * total // 100
    scores = hist.join(small(parts.select("part", "base")), "part").select("score", (F.col("base") + F.col("before")).alias("above")).where(F.col("above") < draw)
    scores = scratch.write(scores, "surviving")
    cutoff = scores.agg(F.min("score")).first()[0]
    if cutoff is None:
        return rows.drop("eligible").withColumn("rank", F.lit(None).cast("bigint"))
    survives = F.col("eligible") & (F.col("score") >= cutoff)
    place = F.row_number().over(W.partitionBy("score").orderBy(F.asc_nulls_first("doc_id"), "n_features")) + F.col("above")
    top = rows.where(survives).join(small(scores), "score").withColumn("rank", place.cast("bigint"))
    top = top.withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank"))).select(*rows.columns, "rank")
    return top.unionByName(rows.where(~survives).withColumn("rank", F.lit(None).cast("bigint"))).drop("eligible")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, seed: int = SEED, least_words: int = LEAST_WORDS, buckets: int = BUCKETS, longest: int = LONGEST, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_features, weight, score, rank (null where it isn't drawn).

    target has texts in a column of the same name. Null and empty texts have no features, weigh 0 and are not drawn; so are
    texts of fewer than least_words words. Rows that repeat an id have the same noise and are drawn each by its own
    score. A null id counts as an empty one in the noise and stays null. An empty table gives no rows; an empty target is
    even over all buckets. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    own = scratch.write(hashed(docs, id_col, text_col, buckets, longest), "hashed")
    wanted = hashed(target.withColumn("__none", F.lit(None)), "__none", text_col, buckets, longest)
    gain = gains(bucket_counts(wanted, buckets), bucket_counts(own, buckets))
    scored = weighed(own, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed))
    out = ranked(scored, F.col("n_words") >= least_words, percent)
    scratch.free("hashed")
    return out


def op12_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """5 per cent of the documents of 20 words and more, drawn towards the benchmark's texts."""
    docs, target = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: CRC-32 by a table that is made from its polynomial, once for each different feature.
SQL = r"""
WITH crc AS MATERIALIZED (SELECT list_transform(range(256), lambda k: list_reduce([k, 0, 0, 0, 0, 0, 0, 0, 0], lambda x, i: xor(x >> 1, 3988292384 * (x & 1)))) AS tab),
ws AS (SELECT kind, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
       FROM (SELECT 'd' AS kind, doc_id, text FROM documents UNION ALL SELECT 'b', NULL, text FROM benchmark)),
ft AS MATERIALIZED (SELECT kind, doc_id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]), list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]))) AS f FROM ws),
di AS (SELECT f, count(*) FILTER (kind = 'd') AS s, count(*) FILTER (kind = 'b') AS t FROM ft GROUP BY f),
bu AS MATERIALIZED (SELECT f, s, t, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(octet_length(encode(f))), lambda i: ('0x' || substr(hex(encode(f)), 2 * i + 1, 2))::BIGINT)),
       lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 10000 AS bucket FROM di, crc),
co AS (SELECT bucket, sum(s)::DOUBLE AS s, sum(t)::DOUBLE AS t FROM bu GROUP BY 1),
ga AS (SELECT bucket, floor(1000 * ln((t + 1) * (sum(s) OVER () + 10000) / ((s + 1) * (sum(t) OVER () + 10000))))::BIGINT AS gain FROM co),
we AS (SELECT doc_id, count(*) AS n, sum(gain) AS weight FROM ft JOIN bu USING (f) JOIN ga USING (bucket) WHERE kind = 'd' GROUP BY 1),
sc AS (SELECT ws.doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
       coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || ws.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score FROM ws LEFT JOIN we ON we.doc_id = ws.doc_id WHERE kind = 'd'),
rk AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM sc WHERE n_words >= 20)
SELECT sc.doc_id, CAST(n_features AS BIGINT) AS n_features, CAST(weight AS BIGINT) AS weight, CAST(score AS BIGINT) AS score, CAST(CASE WHEN r <= 5 * n // 100 THEN r END AS BIGINT) AS rank FROM sc LEFT JOIN rk ON rk.doc_id = sc.doc_id
"""
