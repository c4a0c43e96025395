"""Packing by concatenate and cut: all documents' ids as one stream, cut into windows of fixed length.

The first pass encodes each document once and writes its ids with the ids before it in its own partition. Prefix sums
over the partitions' totals, one row each, then tell where every document stands in the stream of all of them. The
second pass cuts the ids at the windows' ends and gives a boundary record for each piece: the window, the place there,
the place in the document. No shuffle moves ids, and nothing depends on how many ids one document or partition has.

What is left behind the last full window is cut into windows whose lengths are powers of two, the largest first, so no
window needs padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch, column, partition_starts, small, spread
from panelmill.llm.tokens import WordLevel, encoder, texts

SEQUENCE, END = 4096, 2
_ENCODED = "part int, doc_id bigint, before bigint, n bigint, ids binary"
_PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def edges(total: int, sequence: int = SEQUENCE) -> list[int]:
    """Where the windows behind the last full one start, and where the stream ends."""
    at, rest = total - total % sequence, total % sequence
    out = [at]
    for bit in reversed(range(rest.bit_length())):
        if rest >> bit & 1:
            out.append(out[-1] + (1 << bit))
    return out


def cuts(first: int, n: int, tail: list[int], sequence: int = SEQUENCE) -> Iterator[tuple[int, int, int, int]]:
    """(start in the document, length, window, place in the window) of the pieces of ids first to first + n of the stream."""
    at, full = first, tail[0]
    while at < first + n:
        k = bisect_right(tail, at) - 1
        low, high, window = (at - at % sequence, at - at % sequence + sequence, at // sequence) if at < full else (tail[k], tail[k + 1], full // sequence + k)
        end = min(high, first + n)
        yield at - first, end - at, window, at - low
        at = end


def encoded(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """part, doc_id, before (ids before it in its partition), n, ids (little-endian 32-bit, with the end id)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, before, last = encoder(WordLevel, path), TaskContext.get().partitionId(), 0, end.to_bytes(4, "little")
        for batch in batches:
            own = [encode(text) + last for text in texts(batch, "text")]
            n = np.array([len(x) // 4 for x in own], np.int64)
            ends = before + np.cumsum(n)
            cols = [pa.array(np.full(len(n), part, np.int32)), column(batch, "doc_id"), pa.array(ends - n), pa.array(n), pa.array(own, pa.binary())]
            before = int(ends[-1]) if len(n) else before
            yield pa.RecordBatch.from_arrays(cols, ["part", "doc_id", "before", "n", "ids"])

    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(work, _ENCODED)


def concatenate(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and with_ids also ids (array of int).

    Every row of docs, also one that repeats an id, is encoded by itself and ends with the id `end`, so null and empty
    texts make a piece of one id. A document is cut wherever a window ends, as often as that happens. Windows hold
    `sequence` ids, but for the last ones, whose lengths are powers of two. A null id stays null. An empty table gives no
    rows. Other columns of docs are not read.
    """
    scratch = Scratch(docs.sparkSession)
    rows = scratch.write(encoded(docs, path, id_col, text_col, end), "encoded")
    parts = rows.groupBy("part").agg(F.sum("n").alias("n"))
    parts = scratch.write(partition_starts(parts), "parts")
    total = parts.agg(F.coalesce(F.max(F.col("base") + F.col("n")), F.lit(0))).first()[0]
    tail = edges(total, sequence)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, firsts, sizes, raws = (column(batch, c) for c in ("doc_id", "first", "n", "ids"))
            which, found, crcs, own = [], [], [], []
            for i, (first, n, raw) in enumerate(zip(firsts.to_pylist(), sizes.to_pylist(), raws, strict=True)):
                ids = memoryview(raw.as_buffer())
                for piece in cuts(first, n, tail, sequence):
                    span = ids[4 * piece[0] : 4 * (piece[0] + piece[1])]
                    which.append(i)
                    found.append(piece)
                    crcs.append(zlib.crc32(span))
                    if with_ids:
                        own.append(np.frombuffer(span, "<u4").astype(np.int32))
            which, found = pa.array(which, pa.int32()), np.array(found, np.int64).reshape(-1, 4)
            cols = [docs.take(which), pa.array(found[:, 0]), pa.array(found[:, 1]), pa.array(crcs, pa.int64()), sizes.take(which), pa.array(found[:, 2]), pa.array(found[:, 3])]
            if with_ids:
                cols.append(pa.array(own, pa.list_(pa.int32())))
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids)

    placed = rows.join(small(parts.select("part", "base")), "part").select("doc_id", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    return placed.mapInArrow(cut, _PIECES + ", ids array<int>" * with_ids)


def op11_packing(spark, sf_dir: str) -> DataFrame:
    """All documents' ids as one stream in windows of 4096."""
    import public_tokenizers

    return concatenate(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
