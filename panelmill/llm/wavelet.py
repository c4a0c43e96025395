"""Token ids as wavelet matrices: one compressed file per shard, with access, counting and occurrence lookup.

Documents are dealt to shards by ranges of doc_id. A shard holds its ids as BITS bit planes: plane k has bit k (from the
most significant) of each id, in an order that puts ids with a 0 in plane k-1 before those with a 1, otherwise as before.
A directory of ones before each block is stored with it, so a token, a token's count and its n-th place come from BITS
steps. Reading back finds the documents' ends by select() of END and holds them against the stored lengths.
Shards are rows of a Parquet folder in the shared file system, written and read by Spark, so a lost executor's shards
are written again. A shard is cut at SHARD ids (a longer document has a shard by itself): none outgrows a task.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.llm.common import column, partitions, shared_dir
from panelmill.llm.tokens import ByteLevel, encoder, texts

BITS, SHARD, BLOCK, END = 16, 1 << 20, 512, 2
SCHEMA = "part int, shard int, n bigint, docs binary, lengths binary, planes array<binary>, ranks array<binary>, zeros array<bigint>"


class Wavelet:
    """A wavelet matrix over ids below 2**BITS.

    Planes are packed bits. ranks holds for each plane the ones before every block of BLOCK bits, as it is stored, so
    rank() reads one number and the bits of one block. Stored planes are compressed one by one and opened when they are first used.
    """

    def __init__(self, n: int, planes: list[np.ndarray | bytes], ranks: list[np.ndarray], zeros: list[int]):
        self.n, self._planes, self.ranks, self.zeros = n, planes, ranks, zeros

    @classmethod
    def build(cls, ids: np.ndarray) -> Wavelet:
        if len(ids) and int(ids.max()) >= 1 << BITS:
            raise ValueError(f"an id of {int(ids.max())} does not fit into {BITS} bits")
        seq, planes, ranks, zeros = ids.astype(np.uint16), [], [], []
        for k in range(BITS):
            bit = (seq & np.uint16(1 << (BITS - 1 - k))).astype(bool)
            planes.append(np.packbits(bit))
            ones = np.add.reduceat(np.bitwise_count(planes[-1]).astype(np.int64), np.arange(0, len(planes[-1]), BLOCK // 8)) if len(bit) else np.zeros(0, np.int64)
            ranks.append(np.concatenate([[0], np.cumsum(ones)]).astype("<u4"))
            low = seq[~bit]
            zeros.append(len(low))
            seq = np.concatenate([low, seq[bit]])
        return cls(len(ids), planes, ranks, zeros)

    def dump(self) -> tuple[list[bytes], list[bytes], list[int]]:
        """Planes, rank directories and zeros as they are stored."""
        small = zstandard.ZstdCompressor(level=1)
        return [small.compress(self.plane(k).tobytes()) for k in range(BITS)], [r.tobytes() for r in self.ranks], self.zeros

    @classmethod
    def load(cls, n: int, planes: list[bytes], ranks: list[bytes], zeros: list[int]) -> Wavelet:
        return cls(n, list(planes), [np.frombuffer(r, "<u4") for r in ranks], list(zeros))

    def plane(self, k: int) -> np.ndarray:
        if isinstance(self._planes[k], bytes):
            self._planes[k] = np.frombuffer(zstandard.ZstdDecompressor().decompress(self._planes[k], -(-self.n // 8)), np.uint8)
        return self._planes[k]

    def all(self) -> np.ndarray:
        """The ids in their order: the planes' moves undone from the last to the first."""
        seq = np.zeros(self.n, np.uint16)
        for k in range(BITS - 1, -1, -1):
            bit = np.unpackbits(self.plane(k), count=self.n).view(bool)
            out, z = np.empty_like(seq), self.zeros[k]
            out[np.flatnonzero(~bit)] = seq[:z]
            out[np.flatnonzero(bit)] = seq[z:] | np.uint16(1 << (BITS - 1 - k))
            seq = out
        return seq

    def rank(self, k: int, i: int) -> int:
        """Ones in plane k before place i."""
        b = i // BLOCK
        ones = int(self.ranks[k][b])
        return ones + int(np.unpackbits(self.plane(k)[b * BLOCK // 8 : -(-i // 8)], count=i - b * BLOCK).sum()) if i > b * BLOCK else ones

    def access(self, i: int) -> int:
        value = 0
        for k in range(BITS):
            bit = self.plane(k)[i // 8] >> (7 - i % 8) & 1
            ones = self.rank(k, i)
            i = self.zeros[k] + ones if bit else i - ones
            value = value << 1 | int(bit)
        return value

    def span(self, token: int, i: int) -> tuple[int, int]:
        """Where, behind the last plane, a token's places before place i stand."""
        a, b = 0, i
        for k in range(BITS):
            x, y = self.rank(k, a), self.rank(k, b)
            a, b = (self.zeros[k] + x, self.zeros[k] + y) if token >> (BITS - 1 - k) & 1 else (a - x, b - y)
        return a, b

    def count(self, token: int, i: int | None = None) -> int:
        """How often a token stands before place i (by default the end)."""
        a, b = self.span(token, self.n if i is None else i)
        return b - a

    def select(self, token: int, nth: int) -> int:
        """Place of a token's nth occurrence, from 0; -1 if there are fewer."""
        a, b = self.span(token, self.n)
        return int(self._back(token, np.array([a + nth]))[0]) if nth < b - a else -1

    def places(self, token: int) -> np.ndarray:
        """All places of a token in ascending order: select() of every occurrence at once."""
        a, b = self.span(token, self.n)
        return self._back(token, np.arange(a, b))

    def _back(self, token: int, at: np.ndarray) -> np.ndarray:
        """Places of a token's occurrences from where they stand behind the last plane: a select on each plane, from the last to the first."""
        for k in range(BITS - 1, -1, -1):
            bit = token >> (BITS - 1 - k) & 1
            need = at - self.zeros[k] if bit else at
            if len(at) > 32:  # the whole plane costs less than so many blocks
                at = np.flatnonzero(np.unpackbits(self.plane(k), count=self.n) == bit)[need]
                continue
            before = self.ranks[k].astype(np.int64)
            if not bit:
                before = np.arange(len(before)) * BLOCK - before
            block = np.searchsorted(before[:-1], need, "right") - 1  # the last block with at most `need` such bits before it
            out = np.empty_like(at)
            for c in np.unique(block):
                own = block == c
                bits = np.unpackbits(self.plane(k)[c * BLOCK // 8 : (c + 1) * BLOCK // 8], count=min(BLOCK, self.n - c * BLOCK))
                out[own] = c * BLOCK + np.flatnonzero(bits == bit)[need[own] - before[c]]
            at = out
        return at


def write_shards(docs: DataFrame, path: str, folder: str, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every row of docs and write its ids and END, in ascending id order (a null id first; equal ids by their texts' digests)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, shard = encoder(ByteLevel, path), TaskContext.get().partitionId(), 0
        held: list[tuple[int | None, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            raw = b"".join(x for _, x in held)
            wave = Wavelet.build(np.frombuffer(raw, "<u4"))
            ids = np.array([-(2**63) if d is None else d for d, _ in held], "<i8").tobytes()
            row = [part, shard, wave.n, ids, np.array([len(x) // 4 for _, x in held], "<i8").tobytes(), *wave.dump()]
            types = [pa.int32(), pa.int32(), pa.int64(), pa.binary(), pa.binary(), pa.list_(pa.binary()), pa.list_(pa.binary()), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, types, strict=True)], ["part", "shard", "n", "docs", "lengths", "planes", "ranks", "zeros"])

        for batch in batches:
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts(batch, "text"), strict=True):
                raw = encode(text) + END.to_bytes(4, "little")
                if held and size + len(raw) > 4 * SHARD:
                    yield flush()
                    held, size, shard = [], 0, shard + 1
                held.append((doc, raw))
                size += len(raw)
        if held:
            yield flush()

    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    order = [F.col("doc_id"), F.xxhash64("text"), F.octet_length("text")]
    ranged = rows.repartitionByRange(partitions(docs.sparkSession), "doc_id").sortWithinPartitions(*order)
    ranged.mapInArrow(work, SCHEMA).write.parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids (array of int), read back from the files."""
    return _read(spark, folder, True)


def _read(spark: SparkSession, folder: str, with_ids: bool) -> DataFrame:
    shards = spark.read.schema(SCHEMA).parquet(folder)
    sizes = shards.select("part", "shard", "n")
    inside = W.partitionBy("part").orderBy("shard")
    totals = sizes.groupBy("part").agg(F.sum("n").alias("n"))
    parts = totals.withColumn("base", F.sum("n").over(W.orderBy("part")) - F.col("n")).select("part", "base")  # a row per partition
    starts = sizes.select("part", "shard", (F.sum("n").over(inside) - F.col("n")).alias("before")).join(parts, "part")
    starts = starts.select("part", "shard", (F.col("base") + F.col("before")).alias("first"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: column(batch, c)[i].as_py() for c in ("n", "docs", "lengths", "planes", "ranks", "zeros", "first")}
                wave = Wavelet.load(row["n"], row["planes"], row["ranks"], row["zeros"])
                docs, lengths = (np.frombuffer(row[c], "<i8") for c in ("docs", "lengths"))
                ends = np.cumsum(lengths)
                if not np.isin(ends - 1, wave.places(END)).all():
                    raise ValueError("a shard's documents don't end with the end id")
                ids = wave.all().astype("<u4")
                cuts = [ids[b - n : b] for b, n in zip(ends.tolist(), lengths.tolist(), strict=True)]
                cols = [pa.array(docs, mask=docs == -(2**63)), pa.array(row["first"] + ends - lengths), pa.array(lengths), pa.array([zlib.crc32(c.tobytes()) for c in cuts], pa.int64())]
                if with_ids:
                    cols.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(cols, ["doc_id", "start", "n_tokens", "ids_crc32"] + ["ids"] * with_ids)

    schema = "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<int>" * with_ids
    return shards.join(starts, ["part", "shard"]).select("n", "docs", "lengths", "planes", "ranks", "zeros", "first").mapInArrow(work, schema)


def lookup(spark: SparkSession, folder: str, tokens: list[int]) -> DataFrame:
    """token, part, shard, n and first_place (in the shard) of each token that a shard holds, by count() and select()."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                part, shard, n, planes, ranks, zeros = (column(batch, c)[i].as_py() for c in ("part", "shard", "n", "planes", "ranks", "zeros"))
                wave = Wavelet.load(n, planes, ranks, zeros)
                rows += [(t, part, shard, c, wave.select(t, 0)) for t in tokens if (c := wave.count(t))]
            cols = zip(*rows, strict=True) if rows else [[]] * 5
            types = [pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["token", "part", "shard", "n", "first_place"])

    return spark.read.schema(SCHEMA).parquet(folder).mapInArrow(work, "token int, part int, shard int, n bigint, first_place bigint")


def op8_token_output(spark, sf_dir: str) -> DataFrame:
    """All documents' ids written as wavelet shards and read back: doc_id, start, n_tokens, ids_crc32.

    Null and empty texts have the end id alone; an empty table gives no rows; repeated rows are written each; a null id
    stays null. Other columns are not read.
    """
    import public_tokenizers

    folder = f"{shared_dir(spark)}/mill-{uuid.uuid4().hex}/shards"
    write_shards(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), folder)
    return _read(spark, folder, False)
