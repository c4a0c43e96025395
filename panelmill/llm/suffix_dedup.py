"""Repeated passages by a depth-limited radix sort of suffixes.

Suffixes are ordered only through WINDOW bytes, digit by digit, and a suffix leaves as soon as its group cannot span two
documents. The first digit is the window's anchor: of its GRAM-byte strings the one with the smallest hash. Windows with
one anchor stand in a row, so a run of them is one record. The second digit is the HALF bytes that an anchor and the
bytes before or after it take up: every window of the run holds one of these two strings. Runs that are equal
throughout settle there, for all their windows at once; runs that share a second digit but differ somewhere take the
last digit, all WINDOW bytes of each window. Equal groups of the last digit are exactly the repeated windows.

Digits are hashes of byte strings in place of the bytes, since bytes of every suffix would be many times the input on
the way: 31 bits of each half that a run has and 64 of all its bytes, and 96 bits of all bytes of a window, from two
polynomials of different bases. Texts of any length are taken in segments of SEGMENT bytes.

Records travel in blobs, one for each batch and range of hashes, so that Spark shuffles few rows, and equal runs of a
task are merged before the shuffle: a passage that a third of all documents holds goes out once from each task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import OTHER_BASE, buckets_for, chunks, column, materialize, mix, prefix_hash, semi, span_hash, unused

WINDOW, GRAM = 50, 16
#: Gram places in a window, and the bytes of the second digit.
PLACES, HALF = WINDOW - GRAM + 1, (WINDOW + GRAM) // 2
SIDE = HALF - GRAM
NULL_ID = -(2**63)
#: Records that a task gathers before it sends them.
FLUSH = 1 << 18
#: A record's run: digits, place of its first window in the text, and number of windows.
RUN = np.dtype([("left", "<u4"), ("right", "<u4"), ("all", "<u8"), ("doc", "<u4"), ("start", "<u4"), ("n", "u1")])
SPAN = np.dtype([("doc", "<u4"), ("start", "<u4"), ("n", "<u4")])
POINT = np.dtype([("hash", "<u8"), ("more", "<u4"), ("doc", "<u4"), ("start", "<u4")])
DOC = np.dtype([("id", "<i8"), ("text", "<u8")])
_BLOBS = "bucket int, kind int, docs binary, data binary"
#: Kinds of blobs: runs on their way to the second digit, windows that are repeated, runs that need the last digit.
RUNS, COVERED, OPEN = 0, 1, 2


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of windows with one anchor in texts that stand one after the other, and their anchors' hashes. Field doc is the text's number."""
    none = np.zeros(0, RUN), np.zeros(0, np.uint64)
    if len(data) < WINDOW:
        return none
    c = prefix_hash(data)
    at = np.arange(len(data) - GRAM + 1)
    key = (span_hash(c, at, at + GRAM) & np.uint64(0xFFFFFFFF00000000)) | at.astype(np.uint64)
    span = 1
    while span * 2 <= PLACES:  # sliding minimum by doubling; of equal hashes the leftmost
        key = np.minimum(key[: len(key) - span], key[span:])
        span *= 2
    n = len(data) - WINDOW + 1
    anchor = (np.minimum(key[:n], key[PLACES - span : PLACES - span + n]) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    length = np.diff(offsets)
    valid = np.zeros(len(data) + 1, np.int8)
    own = length >= WINDOW
    np.add.at(valid, offsets[:-1][own], 1)
    np.add.at(valid, offsets[1:][own] - WINDOW + 1, -1)
    s = np.flatnonzero(np.cumsum(valid[:n]))
    if not len(s):
        return none
    a = anchor[s]
    first = np.concatenate([[0], 1 + np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1] + 1))])
    n = np.diff(np.concatenate([first, [len(s)]]))
    s, a = s[first], a[first]
    out = np.zeros(len(s), RUN)
    out["doc"] = np.searchsorted(offsets, s, "right") - 1
    out["start"], out["n"] = s - offsets[out["doc"]], n
    has = a - s >= SIDE
    out["left"][has] = (span_hash(c, a[has] - SIDE, a[has] + GRAM) >> np.uint64(32)) | np.uint64(1)
    has = a - (s + n - 1) < SIDE
    out["right"][has] = (span_hash(c, a[has], a[has] + HALF) >> np.uint64(32)) | np.uint64(1)
    out["all"] = span_hash(c, s, s + n - 1 + WINDOW)
    return out, span_hash(c, a, a + GRAM)


#: Bytes of a text that are hashed at once; longer ones are taken in segments that overlap by a window, so that memory doesn't grow with a text.
SEGMENT = 1 << 20


def text_hash(raw: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(raw, digest_size=8).digest(), "little")


def runs_of_long(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """runs() of one text of any length. A run that a segment's end cuts makes two, which the last digit compares window by window."""
    parts = []
    for a in range(0, max(1, len(data) - WINDOW + 1), SEGMENT):
        own = data[a : a + SEGMENT + WINDOW - 1]
        r, hashes = runs(own, np.array([0, len(own)]))
        r["start"] += np.uint32(a)
        parts.append((r, hashes))
    return np.concatenate([r for r, _ in parts]), np.concatenate([h for _, h in parts])


def window_hashes(raw: bytes, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64 and another 32 bits of each window that begins at start (ascending), both of all its bytes."""
    data, hashes, more = np.frombuffer(raw, np.uint8), np.zeros(len(start), np.uint64), np.zeros(len(start), np.uint32)
    cuts = np.searchsorted(start, np.arange(0, len(data) + SEGMENT, SEGMENT))
    for k, (a, b) in enumerate(zip(cuts.tolist(), cuts[1:].tolist(), strict=False)):
        if a < b:
            own = data[k * SEGMENT : (k + 1) * SEGMENT + WINDOW]
            at = start[a:b] - k * SEGMENT
            hashes[a:b] = span_hash(prefix_hash(own), at, at + WINDOW)
            more[a:b] = (span_hash(prefix_hash(own, OTHER_BASE), at, at + WINDOW, OTHER_BASE) >> np.uint64(32)).astype(np.uint32)
    return hashes, more


def settle(r: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which of runs are equal to one of a document with a smaller id, and the order that was sorted into."""
    ids = docs["id"][r["doc"]]
    order = np.lexsort((ids, r["all"], r["right"], r["left"]))
    q, ids = r[order], ids[order]
    head = np.ones(len(q), bool)
    head[1:] = (q["left"][1:] != q["left"][:-1]) | (q["right"][1:] != q["right"][:-1]) | (q["all"][1:] != q["all"][:-1])
    least = ids[np.flatnonzero(head)][np.cumsum(head) - 1] if len(q) else ids
    return ids > least, order


def _many(values: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each place whether its value (not 0) also stands with another id."""
    order = np.argsort(values, kind="stable")
    v, i = values[order], ids[order]
    head = np.ones(len(v), bool)
    head[1:] = v[1:] != v[:-1]
    starts = np.flatnonzero(head)
    out = np.zeros(len(v), bool)
    if len(v):
        group = np.cumsum(head) - 1
        mixed = np.minimum.reduceat(i, starts) != np.maximum.reduceat(i, starts)
        out[order] = mixed[group] & (v != 0)
    return out


def _blobs(bucket: np.ndarray, kind: int, docs: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with the documents that its records name and nothing else."""
    order = np.argsort(bucket, kind="stable")
    bucket, data = bucket[order], data[order]
    cuts = np.concatenate([[0], 1 + np.flatnonzero(bucket[1:] != bucket[:-1]), [len(bucket)]]) if len(bucket) else np.zeros(1, int)
    rows: tuple[list, list, list] = ([], [], [])
    for a, b in zip(cuts, cuts[1:], strict=False):
        own = data[a:b].copy()
        used, own["doc"] = np.unique(own["doc"], return_inverse=True)
        for out, x in zip(rows, (int(bucket[a]), docs[used].tobytes(), own.tobytes()), strict=True):
            out.append(x)
    return pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int32()), pa.array([kind] * len(rows[0]), pa.int32()), pa.array(rows[1], pa.binary()), pa.array(rows[2], pa.binary())], ["bucket", "kind", "docs", "data"])


def _gather(blobs: list[tuple[bytes, bytes]], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The documents and records of blobs; equal documents of different blobs stay apart."""
    docs, data, n = [np.zeros(0, DOC)], [np.zeros(0, kind)], 0
    for d, raw in blobs:
        own = np.frombuffer(raw, kind).copy()
        own["doc"] += n
        docs.append(np.frombuffer(d, DOC))
        n += len(docs[-1])
        data.append(own)
    return np.concatenate(docs), np.concatenate(data)


def by_doc(docs: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(docs["id"].view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _rows(batch: pa.RecordBatch) -> Iterator[tuple[int, int, bytes, bytes]]:
    for row in zip(*(column(batch, c) for c in ("bucket", "kind", "docs", "data")), strict=True):
        yield tuple(x.as_py() for x in row)


def _first(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            docs = np.concatenate([h[0] for h in held])
            base = np.cumsum([0] + [len(h[0]) for h in held[:-1]])
            for h, b in zip(held, base, strict=True):
                h[1]["doc"] += np.uint32(b)
            r, hashes = np.concatenate([h[1] for h in held]), np.concatenate([h[2] for h in held])
            covered, order = settle(r, docs)
            r, hashes = r[order], hashes[order]
            if covered.any():
                yield _blobs(by_doc(docs, buckets)[r["doc"][covered]], COVERED, docs, r[covered][["doc", "start", "n"]].astype(SPAN))
            yield _blobs((hashes[~covered] % np.uint64(buckets)).astype(np.int32), RUNS, docs, r[~covered])

        for batch in batches:
            ids = column(batch, "id").to_numpy(zero_copy_only=False)
            for a, b, data, offsets in chunks(batch, "text", 1 << 18):
                found = runs(data, offsets) if b - a > 1 or len(data) <= SEGMENT else runs_of_long(data)
                if not len(found[0]):
                    continue
                docs, raw, ends = np.zeros(b - a, DOC), data.tobytes(), offsets.tolist()
                docs["id"], docs["text"] = ids[a:b], [text_hash(raw[x:y]) for x, y in zip(ends, ends[1:], strict=False)]
                held.append((docs, *found))
                size += len(found[0])
                if size >= FLUSH:
                    yield from flush()
                    held, size = [], 0
        if held:
            yield from flush()

    return work


def _second(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            rest = [row for row in _rows(batch) if row[1] != RUNS or held.setdefault(row[0], []).append(row[2:])]
            if rest:
                cols = zip(*rest, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "docs", "data"])
        for bucket in list(held):
            docs, r = _gather(held.pop(bucket), RUN)
            covered, order = settle(r, docs)
            r = r[order]
            where = by_doc(docs, buckets)
            out = [(COVERED, r[covered])]
            r = r[~covered]
            ids = docs["id"][r["doc"]]
            out.append((OPEN, r[_many(r["left"], ids) | _many(r["right"], ids)]))
            for kind, own in out:
                if len(own):
                    yield _blobs(where[own["doc"]], kind, docs, own[["doc", "start", "n"]].astype(SPAN))

    return work


def _texts(table: pa.Table) -> dict[tuple[int, int], bytes]:
    """Texts by id and text hash, so that rows which repeat an id keep apart."""
    out = {}
    for batch in table.combine_chunks().to_batches():
        ids = column(batch, "id").to_pylist()
        for a, b, data, offsets in chunks(batch, "text", 1 << 18):
            raw, ends = data.tobytes(), offsets.tolist()
            for k in range(b - a):
                own = raw[ends[k] : ends[k + 1]]
                out[ids[a + k], text_hash(own)] = own
    return out


def _by_text(blobs: pa.Table) -> Iterator[tuple[tuple[int, int], np.ndarray]]:
    docs, spans = _gather(list(zip(blobs.column("docs").to_pylist(), blobs.column("data").to_pylist(), strict=True)), SPAN)
    if not len(spans):
        return
    kinds, number = np.unique(docs, return_inverse=True)
    key = number[spans["doc"]]
    order = np.lexsort((spans["start"], key))
    spans, key = spans[order], key[order]
    cuts = np.concatenate([[0], 1 + np.flatnonzero(key[1:] != key[:-1]), [len(key)]])
    for a, b in zip(cuts, cuts[1:], strict=False):
        yield (int(kinds["id"][key[a]]), int(kinds["text"][key[a]])), spans[a:b]


def _windows(buckets: int):
    def work(blobs: pa.Table, texts: pa.Table) -> pa.Table:
        """The last digit: a hash of each window of the open runs."""
        known, docs, points = _texts(texts), [], []
        for key, spans in _by_text(blobs):
            start = np.concatenate([np.arange(a, a + n, dtype=np.int64) for a, n in zip(spans["start"].tolist(), spans["n"].tolist(), strict=True)])
            own = np.zeros(len(start), POINT)
            own["hash"], own["more"] = window_hashes(known[key], start)
            own["start"], own["doc"] = start, len(docs)
            docs.append(key)
            points.append(own)
        table = np.array(docs, DOC) if docs else np.zeros(0, DOC)
        p = np.concatenate(points) if points else np.zeros(0, POINT)
        return pa.Table.from_batches([_blobs((p["hash"] % np.uint64(buckets)).astype(np.int32), OPEN, table, p)])

    return work


def _last(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple[bytes, bytes]]] = {}
        for batch in batches:
            for bucket, _, docs, data in _rows(batch):
                held.setdefault(bucket, []).append((docs, data))
        for bucket in list(held):
            docs, p = _gather(held.pop(bucket), POINT)
            ids = docs["id"][p["doc"]]
            order = np.argsort(p["hash"], kind="stable")
            if (p["hash"][order][1:] == p["hash"][order][:-1])[p["more"][order][1:] != p["more"][order][:-1]].any():
                order = np.lexsort((p["more"], p["hash"]))
            p, ids = p[order], ids[order]
            head = np.ones(len(p), bool)
            head[1:] = (p["hash"][1:] != p["hash"][:-1]) | (p["more"][1:] != p["more"][:-1])
            least = np.minimum.reduceat(ids, np.flatnonzero(head))[np.cumsum(head) - 1] if len(p) else ids
            p = p[ids > least]
            out = np.zeros(len(p), SPAN)
            out["doc"], out["start"], out["n"] = p["doc"], p["start"], 1
            if len(out):
                yield _blobs(by_doc(docs, buckets)[out["doc"]], COVERED, docs, out)

    return work


def merge(spans: np.ndarray, size: int) -> np.ndarray:
    """Maximal removed byte runs, as rows of start and end, from runs of repeated windows sorted by start."""
    start = spans["start"].astype(np.int64)
    end = np.maximum.accumulate(np.minimum(start + spans["n"] - 1 + WINDOW, size))
    first = np.concatenate([[0], 1 + np.flatnonzero(start[1:] > end[:-1])])
    return np.stack([start[first], np.concatenate([end[first[1:] - 1], end[-1:]])], 1)


def _remove(blobs: pa.Table, texts: pa.Table) -> pa.Table:
    known, rows = _texts(texts), []
    for key, spans in _by_text(blobs):
        raw = known[key]
        removed, kept, at = merge(spans, len(raw)), [], 0
        for a, b in removed.tolist():
            kept.append(raw[at:a])
            at = b
        left = b"".join([*kept, raw[at:]])
        rows.append((key[0], hashlib.sha256(raw).hexdigest(), int((removed[:, 1] - removed[:, 0]).sum()), len(removed), hashlib.sha256(left).hexdigest(), removed.ravel().tolist(), left.decode("utf-8", "ignore")))
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.string()]
    cols = zip(*rows, strict=True) if rows else [[]] * 7
    return pa.table([pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["id", "sha", "removed", "spans", "kept_sha", "bounds", "left"])


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per text with repeated windows: id, sha (of the text), removed, spans, kept_sha, bounds (start, end, start, ...), left (what remains, without characters that were cut apart).

    id is doc_id, or NULL_ID for null. Rows that repeat an id and its text are one row here.
    """
    spark = docs.sparkSession
    rows = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = buckets_for(spark, 2 * size)  # one in 18 windows begins a run, of some 30 bytes with its document
    first = rows.mapInArrow(_first(buckets), _BLOBS).repartitionById(buckets, F.col("bucket"))
    found = materialize(first.mapInArrow(_second(buckets), _BLOBS), "found")

    def with_texts(blobs: DataFrame, work, schema: str) -> DataFrame:
        ids = blobs.mapInArrow(_ids, "id bigint")
        bucketed = semi(rows, ids, "id").mapInArrow(_dealt(buckets), "bucket int, id bigint, text string")
        return blobs.groupBy("bucket").cogroup(bucketed.groupBy("bucket")).applyInArrow(work, schema)

    windows = with_texts(found.where(F.col("kind") == OPEN), _windows(buckets), _BLOBS)
    last = materialize(windows.repartitionById(buckets, F.col("bucket")).mapInArrow(_last(buckets), _BLOBS), "last")
    covered = found.where(F.col("kind") == COVERED).unionByName(last)
    return with_texts(covered, _remove, "id bigint, sha string, removed bigint, spans bigint, kept_sha string, bounds array<bigint>, left string")


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = [np.frombuffer(d.as_py(), DOC)["id"] for d in column(batch, "docs")]
        yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.zeros(0, np.int64), *ids])))], ["id"])


def _dealt(buckets: int):
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs = np.zeros(batch.num_rows, DOC)
            docs["id"] = column(batch, "id").to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([pa.array(by_doc(docs, buckets), pa.int32()), column(batch, "id"), column(batch, "text")], ["bucket", "id", "text"])

    return work


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    A byte goes when a WINDOW-byte string that covers it also starts in a document with a smaller id; strings stay within
    a text. A null text is empty, and texts shorter than WINDOW bytes lose nothing. Rows with one id do not remove from
    each other; a null id is smaller than all others and comes back as null. An empty table gives no rows. Other columns
    are not read.
    """
    key = F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    base = docs.select(key.alias("id"), F.octet_length(text).cast("bigint").alias("n_bytes"), F.sha2(text, 256).alias("sha"))
    cut = materialize(repeats(docs, id_col, text_col).drop("left", "bounds"), "cut")
    out = base.join(cut, ["id", "sha"], "left")
    return out.select(
        F.when(F.col("id") != NULL_ID, F.col("id")).alias("doc_id"), "n_bytes", F.coalesce("removed", F.lit(0).cast("bigint")).alias("n_removed"),
        F.coalesce("spans", F.lit(0).cast("bigint")).alias("n_spans"), F.coalesce("kept_sha", "sha").alias("kept_sha256"),
    )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with each text's repeated bytes taken out, other columns as they are. UTF-8 characters that were cut apart are dropped.

    All rows stay, in which a null text stays null and an empty one empty. Rows that repeat an id don't remove from each
    other, and equal ones lose the same; a null id is smaller than all others. An empty table gives none. Helper columns
    take names that no column of docs has.
    """
    key, sha, left, cut = (unused(c, docs.columns) for c in ("row_key", "row_sha", "row_left", "row_cut"))
    marks = docs.withColumn(key, F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID))).withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    found = materialize(repeats(docs, id_col, text_col).select(F.col("id").alias(key), F.col("sha").alias(sha), F.col("left").alias(left), F.lit(True).alias(cut)), "cut")
    joined = marks.join(found, [key, sha], "left")
    return joined.select(*[F.when(F.col(cut), F.col(left)).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in docs.columns])


def op2_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """Repeated 50-byte strings of all documents."""
    return suffix_dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: All windows as hexadecimal strings, grouped: for small tables.
SQL = f"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
q AS (SELECT doc_id, len(h) // 2 AS n, h, unnest(range(0, greatest(len(h) // 2 - {WINDOW - 1}, 0), 200)) AS base FROM d),
o AS (SELECT doc_id, n, base, substr(h, 2 * base + 1, {2 * (199 + WINDOW)}) AS part FROM q),
p AS (SELECT doc_id, base + j AS i, substr(part, 2 * j + 1, {2 * WINDOW}) AS g FROM o, (SELECT unnest(range(200)) AS j) WHERE base + j <= n - {WINDOW}),
f AS (SELECT p.doc_id, i FROM p JOIN (SELECT g, min(doc_id) AS first FROM p GROUP BY g) m USING (g) WHERE first < p.doc_id),
n AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {WINDOW} THEN 0 ELSE 1 END AS new FROM f),
r AS (SELECT doc_id, k, min(i) AS a, max(i) + {WINDOW} AS b FROM (SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM n) GROUP BY 1, 2),
c AS (SELECT doc_id, k, a, b, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY k), 0) AS before FROM r),
kept AS (SELECT doc_id, sum(b - a) AS n_removed, count(*) AS n_spans, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY k) || substr(any_value(h), 2 * max(b) + 1) AS rest FROM c JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(rest, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (doc_id)
"""
