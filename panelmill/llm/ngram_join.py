"""N-gram Jaccard join by a token-group matrix, exact, for connected components and numbers of links.

Equal shingle sets are one class. A class takes part with a prefix of its tokens in one global order. Two sets of size s
that reach the similarity miss at most (100 - SIMILAR) % of each other, so prefixes of that many tokens and e(s) more
share at least e(s) tokens: a class with fewer shared prefix tokens is alone. What is left is ordered anew, tokens of
many classes last, and filtered again, which clears documents that only share frequent passages.

Then classes are partitioned: a class belongs to the group of its prefix token that most classes hold, so that similar
documents and documents that share a passage meet in one group. The token-group matrix holds which groups have a token in
their members' prefixes. A class counts, over its prefix, the tokens that each group ranked above its own has; a group
with fewer than e(s) can't hold a partner. Only the groups that qualify are opened, in cells of a bounded number of
members and queries, and compared in full. A cell gives back a spanning set of links and counts, never its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch, buckets_for, chunks, column, mix, prefix_hash, semi, small, span_hash, spread
from panelmill.llm.components import components

SHINGLE, SIMILAR = 5, 75
#: Members, queries and their tokens that meet in one cell when a group is opened.
CELL, CELL_TOKENS = 1024, 1 << 20
#: Bytes of full sets that one task compares, in some cells.
TASK_BYTES = 16 << 20
#: Tokens of at least FREQUENT classes count as frequent; if there are more than
#: FREQUENT_IDS in one round, this number doubles.
FREQUENT, FREQUENT_IDS = 24, 1_000_000
#: From so many classes of one task on, a token's classes learn at once that it is shared.
LOCAL = 64
NULL_ID = -(2**63)
DOC = np.dtype([("id", "<i8"), ("n", "<u4")])
TOKEN = np.dtype([("token", "<u4"), ("doc", "<u4")])
MARK = np.dtype([("token", "<u4"), ("doc", "<u4")])
_BLOBS = "bucket int, kind int, docs binary, data binary"
SENT, SHARED, COUNTED = 0, 1, 2


def extra(n: np.ndarray | int):
    """Tokens that two sets' prefixes must share, for the smaller of their sizes."""
    return 1 + n // 20


def prefix(n: np.ndarray | int):
    return (100 - SIMILAR) * n // 100 + extra(n)


def least(n: np.ndarray | int):
    """Shared prefix tokens that a set of n tokens has at least with a partner: one that is as small as a partner can be."""
    return extra(-(-SIMILAR * n // 100))


_CONSTANTS = mix(np.arange(1, SHINGLE + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[32, *range(9, 14)]] = True


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the texts' distinct shingles, in ascending order within each text, and where each text's begin."""
    n = len(offsets) - 1
    low = _LOWER[data]
    word = ~_BLANK[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[offsets] = True
    before = np.concatenate([[False], word[:-1]]) if len(word) else word
    start = np.flatnonzero(word & (~before | edge[:-1]))
    after = np.concatenate([word[1:], [False]]) if len(word) else word
    end = np.flatnonzero(word & (~after | edge[1:])) + 1
    h = span_hash(prefix_hash(low), start, end) if len(start) else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, start, "right") - 1
    count = np.bincount(doc, minlength=n)
    out, own = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(h) >= SHINGLE:
        m = len(h) - SHINGLE + 1
        whole = doc[:m] == doc[SHINGLE - 1 :]
        value = np.zeros(m, np.uint64)
        for k in range(SHINGLE):
            value += h[k : k + m] * _CONSTANTS[k]
        out, own = mix(value)[whole], doc[:m][whole]
    short = np.flatnonzero((count > 0) & (count < SHINGLE))
    if len(short):
        first = np.searchsorted(doc, short)
        more = [mix(np.array([(h[a : a + c] * _CONSTANTS[:c]).sum() + np.uint64(c)], np.uint64))[0] for a, c in zip(first.tolist(), count[short].tolist(), strict=True)]
        out, own = np.concatenate([out, np.array(more, np.uint64)]), np.concatenate([own, short])
    order = np.lexsort((out, own))
    out, own = out[order], own[order]
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != out[:-1]) | (own[1:] != own[:-1])
    out, own = out[keep], own[keep]
    return out, np.searchsorted(own, np.arange(n + 1))


def _digest(own: np.ndarray) -> bytes:
    return hashlib.md5(own.tobytes(), usedforsecurity=False).digest()


def _profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = column(batch, "doc")
        for a, b, data, offsets in chunks(batch, "text", 1 << 18):
            tokens, at = shingles(data, offsets)
            rows = []
            for x, y in zip(at.tolist(), at[1:].tolist(), strict=False):
                own = tokens[x:y]
                rows.append((y - x, _digest(own) if y > x else None, own[: prefix(y - x)].astype("<u4").tobytes()))
            n, digest, head = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(head, pa.binary())], ["doc", "n", "digest", "head"])


def _own(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of a batch (text, digest) and their sets, those whose text is the class's: other texts can have the id of its first document."""
    digests = column(batch, "digest").to_pylist()
    for a, _, data, offsets in chunks(batch, "text", 1 << 18):
        tokens, at = shingles(data, offsets)
        for k, (x, y) in enumerate(zip(at.tolist(), at[1:].tolist(), strict=False), a):
            if y > x and _digest(tokens[x:y]) == digests[k]:
                yield k, tokens[x:y]


def _heads(frequent):
    """Prefixes of classes in the second order, tokens of many classes last."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        late = frequent.value
        for batch in batches:
            rows, n, heads = [], [], [np.zeros(0, np.uint32)]
            for k, own in _own(batch):
                own = own.astype(np.uint32)
                back = late[np.minimum(np.searchsorted(late, own), len(late) - 1)] == own if len(late) else np.zeros(len(own), bool)
                rows.append(k)
                n.append(len(own))
                heads.append(np.concatenate([own[~back], own[back]])[: prefix(len(own))])
            ends = pa.array(np.cumsum([0, *map(len, heads[1:])]), pa.int32())
            head = pa.ListArray.from_arrays(ends, pa.array(np.concatenate(heads).view(np.int32)))
            yield pa.RecordBatch.from_arrays([column(batch, "id").take(pa.array(rows, pa.int64())), pa.array(n, pa.int64()), head], ["id", "n", "head"])

    return work


_CELLS = "task int, label bigint, row int, col int, id bigint, member boolean, asks boolean, `foreign` boolean, tokens binary"


def _cell_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members and queries of cells with their full sets."""
    for batch in batches:
        rows, tokens, size = [], [], 0
        names = ["task", "label", "row", "col", "id", "member", "asks", "foreign"]

        def flush(rows: list[int], tokens: list[bytes], batch: pa.RecordBatch = batch, names: list[str] = names) -> pa.RecordBatch:
            at = pa.array(rows, pa.int64())
            return pa.RecordBatch.from_arrays([*[column(batch, c).take(at) for c in names], pa.array(tokens, pa.binary())], [*names, "tokens"])

        for k, own in _own(batch):
            rows.append(k)
            tokens.append(own.astype("<u8").tobytes())
            size += len(tokens[-1])
            if size > 1 << 22:
                yield flush(rows, tokens)
                rows, tokens, size = [], [], 0
        yield flush(rows, tokens)


def _blobs(bucket: np.ndarray, kind: int, docs: np.ndarray, data: np.ndarray) -> pa.RecordBatch:
    """One row for each bucket, with the documents that its records name."""
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


def _gather(blobs: list[tuple[bytes, bytes]], kind: np.dtype, doc: np.dtype = DOC) -> tuple[np.ndarray, np.ndarray]:
    docs, data, n = [np.zeros(0, doc)], [np.zeros(0, kind)], 0
    for d, raw in blobs:
        own = np.frombuffer(raw, kind).copy()
        own["doc"] += n
        docs.append(np.frombuffer(d, doc))
        n += len(docs[-1])
        data.append(own)
    return np.concatenate(docs), np.concatenate(data)


def _by_doc(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _runs(token: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.concatenate([[0], 1 + np.flatnonzero(token[1:] != token[:-1])]) if len(token) else np.zeros(0, int)
    return starts, np.diff(np.concatenate([starts, [len(token)]]))


def _send(buckets: int):
    """Prefix tokens to the buckets of their hashes. A token that LOCAL or more classes of this task hold goes there once."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            docs = np.zeros(batch.num_rows, DOC)
            docs["id"], docs["n"] = (column(batch, c).to_numpy(zero_copy_only=False) for c in ("id", "n"))
            heads = [np.frombuffer(x.as_py(), "<u4") for x in column(batch, "head")]
            data = np.zeros(sum(map(len, heads)), TOKEN)
            data["token"], data["doc"] = np.concatenate(heads), np.repeat(np.arange(len(heads)), [len(h) for h in heads])
            data = data[np.argsort(data["token"], kind="stable")]
            starts, length = _runs(data["token"])
            many = np.repeat(length >= LOCAL, length)
            first = np.zeros(len(data), bool)
            first[starts] = True
            if many.any():
                yield _blobs(_by_doc(docs["id"], buckets)[data["doc"][many]], SHARED, docs, data[many].astype(MARK))
                hot, n = starts[length >= LOCAL], length[length >= LOCAL]
                counts = np.zeros(len(hot), TOKEN)
                counts["token"], counts["doc"] = data["token"][hot], n
                for a in range(0, len(counts), 1 << 16):
                    own = counts[a : a + (1 << 16)]
                    where = (own["token"] % np.uint32(buckets)).astype(np.int32)
                    for k in np.unique(where):
                        row = [int(k), COUNTED, b"", own[where == k].tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "docs", "data"])
            yield _blobs((data["token"][~many] % np.uint32(buckets)).astype(np.int32), SENT, docs, data[~many])

    return work


def _pair(buckets: int):
    """Tells classes which of their prefix tokens are shared (SHARED), and how many classes hold a frequent token (COUNTED)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[list, list]] = {}
        for batch in batches:
            rest = []
            for row in zip(*(column(batch, c).to_pylist() for c in ("bucket", "kind", "docs", "data")), strict=True):
                if row[1] == SHARED:
                    rest.append(row)
                else:
                    own = held.setdefault(row[0], ([], []))
                    own[0].append(row[2:]) if row[1] == SENT else own[1].append(row[3])
            if rest:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rest, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "docs", "data"])
        for bucket in list(held):
            sent, counted = held.pop(bucket)
            docs, data = _gather(sent, TOKEN)
            before = np.concatenate([np.zeros(0, TOKEN), *[np.frombuffer(c, TOKEN) for c in counted]])
            token, group = np.unique(np.concatenate([data["token"], before["token"]]), return_inverse=True)
            total = np.bincount(group, np.concatenate([np.ones(len(data)), before["doc"]]), len(token)).astype(np.int64)
            shared = data[total[group[: len(data)]] >= 2]
            if len(shared):
                yield _blobs(_by_doc(docs["id"], buckets)[shared["doc"]], SHARED, docs, shared.astype(MARK))
            often = total >= FREQUENT
            if often.any():
                counts = np.zeros(int(often.sum()), TOKEN)
                counts["token"], counts["doc"] = token[often], np.minimum(total[often], 2**32 - 1)
                row = [bucket, COUNTED, b"", counts.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int32(), pa.int32(), pa.binary(), pa.binary()), strict=True)], ["bucket", "kind", "docs", "data"])

    return work


def _enough(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a partition's classes (all marks of one stand in it) those with enough shared tokens."""
    held: dict[int, list[tuple[bytes, bytes]]] = {}
    for batch in batches:
        for row in zip(*(column(batch, c).to_pylist() for c in ("bucket", "docs", "data")), strict=True):
            held.setdefault(row[0], []).append(row[1:])
    for bucket in list(held):
        docs, marks = _gather(held.pop(bucket), MARK)
        kinds, number = np.unique(docs, return_inverse=True)
        n = np.bincount(number[marks["doc"]], minlength=len(kinds))
        yield pa.RecordBatch.from_arrays([pa.array(kinds["id"][n >= least(kinds["n"].astype(np.int64))])], ["id"])


def _filtered(heads: DataFrame, buckets: int, scratch: Scratch) -> tuple[DataFrame, np.ndarray]:
    """Ids of classes with enough shared prefix tokens, and the frequent tokens."""
    told = heads.select("id", "n", "head").mapInArrow(_send(buckets), _BLOBS).repartitionById(buckets, F.col("bucket")).mapInArrow(_pair(buckets), _BLOBS)
    told = scratch.write(told, "told")
    ids = told.where(F.col("kind") == SHARED).repartitionById(buckets, F.col("bucket")).mapInArrow(_enough, "id bigint")
    ids, late = scratch.write(ids, "near"), _frequent(told.where(F.col("kind") == COUNTED).select("data"))
    scratch.free("told")
    return ids, late


def _frequent(counted: DataFrame) -> np.ndarray:
    """The frequent tokens, FREQUENT_IDS (4 bytes each) at most. Which they are changes the order, never the result."""

    def sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(33, np.int64)
        for batch in batches:
            for x in column(batch, "data"):
                own = np.frombuffer(x.as_py(), TOKEN)["doc"]
                count += np.bincount(np.log2(own / FREQUENT).astype(int), minlength=33)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(33)), pa.array(count)], ["level", "n"])

    levels = dict(counted.mapInArrow(sizes, "level bigint, n bigint").groupBy("level").agg(F.sum("n")).collect())  # 33 rows
    level = 0
    while sum(n for k, n in levels.items() if k >= level) > FREQUENT_IDS:
        level += 1

    def take(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = [np.frombuffer(x.as_py(), TOKEN) for x in column(batch, "data")]
            own = np.concatenate([np.zeros(0, TOKEN), *own])
            yield pa.RecordBatch.from_arrays([pa.array([own["token"][np.log2(own["doc"] / FREQUENT).astype(int) >= level].tobytes()], pa.binary())], ["tokens"])

    got = [np.frombuffer(r.tokens, "<u4") for r in counted.mapInArrow(take, "tokens binary").collect()]
    return np.unique(np.concatenate([np.zeros(0, np.uint32), *got]))


def _partners(sets: list[np.ndarray], queries: list[np.ndarray]) -> Iterator[np.ndarray]:
    """For each query the numbers of the sets that reach the similarity with it, through the sets' inverted lists."""
    size = np.array([len(s) for s in sets])
    every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    for own in queries:
        a, b = np.searchsorted(every, own, "left"), np.searchsorted(every, own, "right")
        n = b - a
        both = np.bincount(owner[np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())], minlength=len(sets))
        yield np.flatnonzero(100 * both >= SIMILAR * (size + len(own) - both))


def cell_links(ids: np.ndarray, sets: list[np.ndarray], asking: np.ndarray, queries: list[np.ndarray], foreign: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """ids, roots and counts of one cell's linked members and queries; ids with one root reach each other.

    A query counts its partners, itself left out. Members count only foreign queries, those of another group, since
    queries of their own group meet them the other way round as well.
    """
    label, count, touched = np.arange(len(ids)), np.zeros(len(ids), np.int64), np.zeros(len(ids), bool)
    first, found = np.full(len(asking), -1), np.zeros(len(asking), np.int64)
    for q, partners in enumerate(_partners(sets, queries)):
        near = partners[ids[partners] != asking[q]]
        if not len(near):
            continue
        found[q], first[q] = len(near), near[0]
        touched[near] = True
        if foreign[q]:
            count[near] += 1
        own = label[partners]
        if own.min() != own.max():
            label[np.isin(label, own)] = own.min()
    used = np.flatnonzero(first >= 0)
    who, root = np.concatenate([ids[touched], asking[used]]), np.concatenate([label[touched], label[first[used]]])
    least = np.full(len(ids), np.iinfo(np.int64).max)
    np.minimum.at(least, root, who)
    return who, least[root], np.concatenate([count[touched], found[used]])


def _compare(part: pa.Table) -> pa.Table:
    """The links of some cells. Rows are members or queries; a member that asks queries its own cell."""
    part = part.sort_by([(c, "ascending") for c in ("label", "row", "col", "member", "id")])
    key = np.stack([part.column(c).to_numpy().astype(np.int64) for c in ("label", "row", "col", "member", "id")])
    if key.shape[1]:  # rows that repeat a document's id and text
        part = part.filter(pa.array(np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])))
    key = np.stack([part.column(c).to_numpy() for c in ("label", "row", "col")])
    cuts = np.concatenate([[0], 1 + np.flatnonzero((key[:, 1:] != key[:, :-1]).any(0)), [key.shape[1]]]) if key.shape[1] else np.zeros(1, int)
    ids, member, asks, foreign = (part.column(c).to_numpy() for c in ("id", "member", "asks", "foreign"))
    sets, out = [np.frombuffer(t, "<u8") for t in part.column("tokens").to_pylist()], []
    for a, b in zip(cuts.tolist(), cuts[1:].tolist(), strict=False):
        m, q = a + np.flatnonzero(member[a:b]), a + np.flatnonzero(asks[a:b])
        if len(m) and len(q):
            out.append(cell_links(ids[m], [sets[k] for k in m.tolist()], ids[q], [sets[k] for k in q.tolist()], foreign[q]))
    cols = [np.concatenate(x) for x in zip(*out, strict=True)] if out else [np.zeros(0, np.int64)] * 3
    return pa.table([pa.array(x, pa.int64()) for x in cols], ["a", "b", "n"])


def _opened(members: DataFrame, queries: DataFrame, docs: DataFrame, whose: DataFrame, scratch: Scratch, name: str, buckets: int) -> DataFrame:
    """a, b, n of all cells: members (label, row, col, id, n, asks) and queries (label, row, col, id, n, foreign) meet by label, row and col. Sets are made anew from the texts."""
    rows = members.select("label", "row", "col", "id", "n", F.lit(True).alias("member"), "asks", F.lit(False).alias("foreign"))
    rows = rows.unionByName(queries.select("label", "row", "col", "id", "n", F.lit(False).alias("member"), F.lit(True).alias("asks"), "foreign"))
    rows = scratch.write(rows.join(whose, "id"), f"{name}_rows")
    tasks = max(buckets, -(-8 * (rows.agg(F.sum("n")).first()[0] or 0) // TASK_BYTES))
    rows = rows.withColumn("task", F.pmod(F.xxhash64("label", "row", "col"), F.lit(tasks)).cast("int"))
    cells = docs.join(small(rows), "doc").mapInArrow(_cell_sets, _CELLS)
    found = scratch.write(cells.groupBy("task").applyInArrow(_compare, "a bigint, b bigint, n bigint"), name)
    scratch.free(f"{name}_rows")
    return found


def _least(n):
    """least() of a column."""
    return 1 + F.floor(F.floor((F.lit(SIMILAR) * n + 99) / 100) / 20)


def _parts(count, tokens):
    return F.ceil(F.greatest(count / CELL, tokens / CELL_TOKENS)).cast("int")


def _every(first, last):
    """Rows for all whole numbers from first to last (last >= first)."""
    return F.explode(F.sequence(first, last))


def _links(heads: DataFrame, docs: DataFrame, whose: DataFrame, buckets: int, scratch: Scratch, links_too: bool) -> DataFrame:
    """a, b, n: spanning links of classes (id, n, head), and what to add to a's number of links. whose: id, doc, digest of their texts among docs."""
    # groups: of the prefix tokens that two or more classes hold, the one that most hold names the class's group
    held = heads.select("id", "n", F.explode("head").alias("token"))
    often = held.groupBy("token").agg(F.count("*").alias("held")).where("held > 1")
    label = F.shiftleft("held", 32).bitwiseOR(F.col("token").cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF)))
    shared = held.join(often, "token").select("id", "n", "token", label.alias("label"))
    shared = shared.groupBy("id", "n").agg(F.collect_list("token").alias("head"), F.max("label").alias("label"))  # a part of one document's tokens
    shared = scratch.write(shared.where(F.size("head") >= _least(F.col("n"))), "shared")
    # the matrix, and the groups above its own that each class has to ask
    tokens = shared.select("id", "n", "label", F.explode("head").alias("token"))
    matrix = tokens.select("token", F.col("label").alias("other")).distinct()
    asks = tokens.join(matrix, "token").where("other > label").groupBy("id", "n", "other").agg(F.count("*").alias("both"))
    asks = scratch.write(asks.where(F.col("both") >= _least(F.col("n"))).select("id", "n", F.col("other").alias("label")), "asks")
    # cells: a group's members fall into so many rows, its own queries into as many columns, and foreign queries into more
    load = shared.groupBy("label").agg(F.count("*").alias("size"), _parts(F.count("*"), F.sum("n")).alias("rows"))
    guests = asks.groupBy("label").agg(_parts(F.count("*"), F.sum("n")).alias("guests"))
    load = scratch.write(load.join(guests, "label", "left").fillna(0, ["guests"]).where("size > 1 or guests > 0"), "load")
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n)).cast("int")
    inside = scratch.write(shared.select("id", "n", "label").join(load, "label").withColumn("part", part("rows")).withColumn("asks", F.lit(True)), "inside")
    found = None
    if not links_too:  # what is like its large group's first member need not meet the group's other members
        leads = inside.where("rows > 1").groupBy("label", "rows").agg(F.min(F.struct("id", "n")).alias("lead")).select("label", "rows", "lead.*")
        led = _opened(
            inside.where("rows > 1").select("label", F.col("part").alias("row"), F.lit(-1).alias("col"), "id", "n", F.lit(False).alias("asks")),
            leads.select("label", _every(F.lit(0), F.col("rows") - 1).alias("row"), F.lit(-1).alias("col"), "id", "n", F.lit(False).alias("foreign")), docs, whose, scratch, "led", buckets,
        )
        inside = inside.drop("asks").join(led.select(F.col("a").alias("id"), F.lit(False).alias("met")).distinct(), "id", "left").withColumn("asks", F.coalesce("met", F.lit(True)))
        inside, found = scratch.write(inside, "unmet"), led
    members = inside.withColumn("col", _every(F.lit(0), F.col("rows") + F.col("guests") - 1)).select("label", F.col("part").alias("row"), "col", "id", "n", (F.col("asks") & (F.col("part") == F.col("col"))).alias("asks"))
    across = inside.where("rows > 1 and asks").withColumn("row", _every(F.lit(0), F.col("rows") - 1)).where("row <> part")
    queries = across.select("label", "row", F.col("part").alias("col"), "id", "n", F.lit(False).alias("foreign"))
    visits = asks.select("id", "n", "label").join(load, "label").withColumn("col", F.col("rows") + part("guests")).withColumn("row", _every(F.lit(0), F.col("rows") - 1))
    queries = queries.unionByName(visits.select("label", "row", "col", "id", "n", F.lit(True).alias("foreign")))
    links = _opened(members, queries, docs, whose, scratch, "links", buckets)
    scratch.free("shared", "asks", "load", "inside", "unmet")
    return links if found is None else links.unionByName(found)


def jaccard_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", links_too: bool = True) -> DataFrame:
    """One row per row of docs: doc_id, n_shingles, component_id, class_id (smallest id with the same shingles), n_links.

    n_links counts all other classes that reach the similarity with the row's class; without links_too it is left out, and
    members of a large group that are like its first one are not compared with each other.
    Words are cut at space and \\t..\\r, A-Z lower-cased. Fewer than SHINGLE words make one shingle; without words or
    text the set is empty and linked with nothing. Rows that repeat an id are documents of their own. A null id counts
    as the smallest and comes back as null, also as the component's. An empty table gives no rows. Other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    rows = spread(docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("doc"), F.col(text_col).cast("string").alias("text")))
    profiles = scratch.write(rows.mapInArrow(_profiles, "doc bigint, n bigint, digest binary, head binary"), "profiles")
    buckets = buckets_for(spark, 4 * (profiles.agg(F.sum("n")).first()[0] or 0))  # 12 bytes for each token of a prefix
    # 1. classes, and a filter by shared prefix tokens in hash order
    some = profiles.where("n > 0")
    firsts = some.groupBy("digest").agg(F.min("doc").alias("doc")).withColumn("id", F.monotonically_increasing_id())
    firsts = scratch.write(firsts, "firsts")
    near, late = _filtered(some.join(small(firsts), ["digest", "doc"]), buckets, scratch)
    plain = scratch.write(profiles.select("doc", "n", "digest"), "plain")
    scratch.free("profiles")
    # 2. prefixes of what is left, in an order that puts frequent tokens last
    whose = scratch.write(semi(firsts, near, "id"), "whose")
    heads = rows.join(small(whose), "doc").mapInArrow(_heads(spark.sparkContext.broadcast(late)), "id bigint, n bigint, head array<int>")
    heads = scratch.write(heads, "heads")
    if heads.count() > heads.select("id").distinct().count():  # rows that repeat both id and text
        heads = scratch.write(heads.dropDuplicates(["id"]), "once")
    # 3. groups, their matrix, and what opened groups link
    links = _links(heads, rows, whose, buckets, scratch, links_too)
    scratch.free("heads", "once", "near", "whose")
    # 4. components of classes, named by their smallest document
    named = components(links, scratch)
    named = scratch.write(named.join(firsts.select("id", "doc"), "id"), "documents")
    named = named.join(named.groupBy("component").agg(F.min("doc").alias("smallest")), "component").select("id", "smallest")
    if links_too:
        named = named.join(links.groupBy("a").agg(F.sum("n").alias("n_links")).withColumnRenamed("a", "id"), "id")
    per_class = firsts.withColumnRenamed("doc", "class_id").join(named, "id", "left").drop("id")
    per_class = scratch.write(per_class, "classes")
    scratch.free("firsts", "links", "led", "components", "documents")
    out = plain.join(small(per_class), "digest", "left")
    back = lambda c: F.when(c != NULL_ID, c)
    return out.select(
        back(F.col("doc")).alias("doc_id"), F.col("n").alias("n_shingles"), back(F.coalesce("smallest", "class_id", "doc")).alias("component_id"),
        back(F.coalesce("class_id", "doc")).alias("class_id"), *([F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links")] if links_too else []),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, of which no smaller doc_id is in the same component. Rows that repeat an id stay or go together; those without an id stay."""
    found = jaccard_components(docs, links_too=False)
    return semi(docs, found.where("not (component_id <=> doc_id)"), "doc_id", "left_anti")


def op10_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Components of all documents under a five-word shingle Jaccard similarity of 0.75."""
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Links by joining all shingles, components by closure: for small tables.
SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END)) AS k FROM w),
cls AS (SELECT k, min(doc_id) AS class_id, len(k) AS n FROM s WHERE len(k) > 0 GROUP BY k),
x AS (SELECT class_id, n, unnest(k) AS g FROM cls),
pairs AS (SELECT a.class_id AS a, b.class_id AS b FROM x a JOIN x b ON a.g = b.g AND a.class_id <> b.class_id GROUP BY a.class_id, b.class_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r AS (SELECT class_id AS a, class_id AS b FROM cls UNION SELECT r.a, pairs.b FROM r JOIN pairs ON pairs.a = r.b),
comp AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
deg AS (SELECT a, count(*) AS n_links FROM pairs GROUP BY a)
SELECT doc_id, CAST(len(s.k) AS BIGINT) AS n_shingles, coalesce(component_id, doc_id) AS component_id, coalesce(class_id, doc_id) AS class_id, coalesce(n_links, 0) AS n_links
FROM s LEFT JOIN cls USING (k) LEFT JOIN comp ON comp.a = class_id LEFT JOIN deg ON deg.a = class_id
"""
