"""Best-fit packing by bin completion over the histogram of piece lengths.

A sequence holds at most SEQUENCE ids, so whatever the size of the corpus there are at most SEQUENCE distinct lengths.
The search therefore runs on counts by length. It starts from best-fit decreasing, so no result is worse than that, and
ends as soon as the best packing so far meets the bound of Martello and Toth. Around the largest length left it
enumerates undominated fillings and branches over them, depth first; what is left at a branch is packed best-fit, which
may be a new best. A branch ends where its waste, or the bound of what is left, no longer allows fewer sequences than
the best so far. A filling is used as often as the counts allow before it is tried once, so that a corpus of any size
takes few steps. Without limits the search is exact; with them it ends after BUDGET steps, and the lower bound that comes
with the result tells what it may have missed. Pieces find their place by their rank among pieces of their length.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from panelmill.llm.common import column, materialize, spread
from panelmill.llm.tokens import WordLevel, encoder, texts

SEQUENCE, END = 4096, 1
#: Lengths looked at for one largest piece, fillings kept for it, and largest pieces filled in all, before the best so far is taken. None: no limit.
NODES, FILLINGS, BUDGET = 400, 4, 4000
_PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, place bigint"


def dominated(items: list[int], waste: int, spare: int) -> bool:
    """Whether one spare piece could replace some pieces of a filling, fill the room at least as well, and leave these for its own place.

    Several pieces that add up to no more than the spare one, or a smaller piece. Sums are bits of an integer; spare has a bit for each length.
    """
    single = several = 0
    for x in items:
        several |= (several | single) << x
        single |= 1 << x
    reached, width = several | single << 1, max(waste, 1)  # lengths of `several` on, and from one more than a single piece on
    if not waste:
        return bool(several & spare)
    reach = 1
    while reach < width:  # all of them up to `waste` longer
        step = min(reach, width - reach)
        reached |= reached << step
        reach += step
    return bool((reached | several << waste) & spare)


def fillings(counts: np.ndarray, room: int, nodes: int | None = NODES, want: int | None = FILLINGS) -> list[tuple[int, list[int]]]:
    """(waste, lengths) of undominated fillings of a room, least waste first, with larger pieces first.

    A piece that closes a room exactly dominates whatever else could go there, so it ends its branch. want keeps the
    fullest fillings alone; after nodes lengths no more are looked for.
    """
    have = np.flatnonzero(counts[: room + 1])
    if not len(have):
        return [(room, [])]
    have = have[::-1].tolist()
    left = {x: int(counts[x]) for x in have}
    greedy, rest = [], room
    for x in have:  # the fullest of what is simply taken by size
        n = min(left[x], rest // x)
        greedy += [x] * n
        rest -= n * x
        if not rest:
            break
    best: list[tuple[int, list[int]]] = [(rest, greedy)]
    seen, budget = {tuple(greedy)}, float("inf") if nodes is None else nodes

    def add(waste: int, items: list[int]) -> None:
        if (key := tuple(items)) not in seen:
            seen.add(key)
            best.append((waste, list(items)))
            best.sort(key=lambda b: (b[0], len(b[1])))
            if want is not None:
                del best[2 * want :]

    def down(i: int, rest: int, items: list[int]) -> None:
        nonlocal budget
        while i < len(have) and have[i] > rest:
            i += 1
        fits = False
        for j in range(i, len(have)):
            x = have[j]
            if budget <= 0 or want is not None and len(best) >= 2 * want and not best[-1][0]:
                return
            if left[x]:
                fits = True
                budget -= 1
                left[x] -= 1
                if not (gap := rest - x):
                    add(0, [*items, x])
                elif gap < x and left.get(gap):
                    add(0, [*items, x, gap])
                else:
                    down(j, gap, [*items, x])
                left[x] += 1
        if not fits:
            add(rest, items)

    down(0, room, [])
    best.sort(key=lambda b: (b[0], len(b[1])))
    every = int.from_bytes(np.packbits(counts[: room + 1] > 0, bitorder="little").tobytes(), "little")
    free = lambda items: every & ~sum(1 << x for x in set(items) if left[x] == items.count(x))
    kept = [(waste, items) for waste, items in best if not dominated(items, waste, free(items))] or best[:1]
    return kept if want is None else kept[:want]


def least_bins(counts: np.ndarray, capacity: int) -> int:
    """Martello and Toth's bound: for each size a, pieces over capacity - a stand alone, other pieces over half have a sequence each, and pieces from a to half must find room beside these or take more."""
    size = np.arange(capacity + 1)
    number, length = np.cumsum(counts), np.cumsum(counts * size)  # up to each size
    half = capacity // 2
    a = size[: half + 1]
    large = number[capacity] - number[half]
    beside = number[capacity - a] - number[half]  # over half, with room for a
    room = beside * capacity - (length[capacity - a] - length[half])
    small = length[half] - np.where(a > 0, length[a - 1], 0)
    return int(large + np.maximum(0, -(-(small - room) // capacity)).max())


def best_fit(counts: np.ndarray, capacity: int) -> tuple[int, list[tuple[int, list[int]]]]:
    """Best-fit decreasing by counts: number of sequences and the (times, lengths) that make them up.

    Pieces of one length fill the tightest room that takes them, as many as fit, in all sequences that have this room,
    then the next wider one, then new sequences; one sequence after another would come out the same.
    """
    by_room: dict[int, list[tuple[int, list[int]]]] = {}
    rooms: list[int] = []  # those of by_room, ascending

    def put(room: int, times: int, items: list[int]) -> None:
        if times:
            if room not in by_room:
                by_room[room] = []
                insort(rooms, room)
            by_room[room].append((times, items))

    bins = 0
    for x in np.flatnonzero(counts)[::-1].tolist():
        n = int(counts[x])
        while n:
            k = bisect_left(rooms, x)
            room = rooms[k] if k < len(rooms) else capacity
            each = room // x
            if k == len(rooms):
                times, items = -(-n // each), []
                bins += times
            else:
                times, items = by_room[room].pop()
                if not by_room[room]:
                    del by_room[room], rooms[k]
            full = min(times, n // each)
            n -= full * each
            put(room - each * x, full, items + [x] * each)
            if full < times and n:
                put(room - n * x, 1, items + [x] * n)
                full, n = full + 1, 0
            put(room, times - full, items)
    return bins, [group for groups in by_room.values() for group in groups]


def complete(hist: np.ndarray, capacity: int, nodes: int | None = NODES, want: int | None = FILLINGS, budget: int | None = BUDGET) -> tuple[int, list[tuple[int, list[int]]], int]:
    """Number of sequences, the (times, lengths) that make them up, and least_bins(). hist: count by length, of capacity + 1 entries.

    The number is at most that of best-fit decreasing. Without limits (None) it is the optimum.
    """
    hist = hist.astype(np.int64)
    total = int((hist * np.arange(capacity + 1)).sum())
    least, steps = least_bins(hist, capacity), float("inf") if budget is None else budget
    best = best_fit(hist, capacity)

    def choices(counts: np.ndarray) -> list[tuple[int, list[int], int]]:
        """(times, lengths, waste) for the largest piece left, each filling as often as it goes and then once."""
        top = int(np.flatnonzero(counts)[-1])
        counts[top] -= 1
        found = fillings(counts, capacity - top, nodes, want) if top < capacity else [(0, [])]
        counts[top] += 1
        out = []
        for waste, rest in found:
            lengths, need = np.unique([top, *rest], return_counts=True)
            out.append((int((counts[lengths] // need).min()), [top, *rest], waste))
        return out + [(1, items, waste) for times, items, waste in out if times > 1]

    plan: list[tuple[int, list[int]]] = []
    stack = [(hist, 0, 0, choices(hist))] if best[0] > least else []
    while stack:
        counts, bins, waste, left = stack[-1]
        if not left or best[0] <= least or steps <= 0:
            stack.pop()
            if plan:
                plan.pop()
            continue
        times, items, lost = left.pop(0)
        if waste + times * lost > (best[0] - 1) * capacity - total:
            continue  # this much waste can't come out at fewer sequences
        counts = counts.copy()
        lengths, need = np.unique(items, return_counts=True)
        counts[lengths] -= times * need
        bins, waste = bins + times, waste + times * lost
        steps -= 1
        if bins + least_bins(counts, capacity) >= best[0]:
            continue  # nor can what is left
        plan.append((times, items))
        more, rest = best_fit(counts, capacity)
        if bins + more < best[0]:
            best = (bins + more, [*plan, *rest])
        stack.append((counts, bins, waste, choices(counts) if counts.any() else []))
    return *best, least


def slots(plan: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """Where the pieces of a length go, by rank: from rank `rank` on, `each` to a sequence from `sequence` on, at `offset`."""
    rows, ranks, sequence = [], {}, 0
    for times, items in plan:
        offset = 0
        for x, n in zip(*np.unique(items, return_counts=True), strict=True):
            x, n = int(x), int(n)
            rows.append((x, ranks.get(x, 0), n, sequence, offset))
            ranks[x] = ranks.get(x, 0) + times * n
            offset += x * n
        sequence += times
    table = np.array(sorted(rows), np.int64).reshape(-1, 5)
    return {name: table[:, i] for i, name in enumerate(("length", "rank", "each", "sequence", "offset"))}


def pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, and the piece's partition and place among its partition's pieces of that length."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, part, seen = encoder(WordLevel, path), TaskContext.get().partitionId(), np.zeros(SEQUENCE + 1, np.int64)
        for batch in batches:
            rows: list[tuple] = []
            for doc, text in zip(column(batch, "doc_id").to_pylist(), texts(batch, "text"), strict=True):
                ids = encode(text) + END.to_bytes(4, "little")
                for k in range(0, len(ids), 4 * SEQUENCE):
                    own = ids[k : k + 4 * SEQUENCE]
                    n = len(own) // 4
                    rows.append((doc, k // (4 * SEQUENCE), k // 4, n, zlib.crc32(own), part, int(seen[n])))
                    seen[n] += 1
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = zip(*rows, strict=True) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, types, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32", "part", "place"])

    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    return materialize(rows.mapInArrow(cut, _PIECES), "pieces")


def place(found: DataFrame) -> DataFrame:
    """found (from pieces()) with sequence_id and offset, n_sequences in all, and least_sequences, which no packing goes below."""
    counts = found.groupBy("part", "length").agg(F.count("*").alias("n"))
    counts = materialize(counts, "counts")
    hist = np.zeros(SEQUENCE + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n").alias("n")).collect():  # at most SEQUENCE rows
        hist[length] = n
    bins, plan, least = complete(hist, SEQUENCE)
    table = slots(plan)
    before = counts.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("before"))
    ranked = found.join(before, ["part", "length"]).withColumn("rank", F.col("before") + F.col("place"))

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts = np.searchsorted(table["length"], np.arange(SEQUENCE + 2))
        key = (table["length"] << 45) + table["rank"]
        for batch in batches:
            if not batch.num_rows:
                continue
            length, rank = (column(batch, c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("length", "rank"))
            at = np.searchsorted(key, (length << 45) + rank, "right") - 1
            assert (at >= firsts[length]).all()
            k = rank - table["rank"][at]
            sequence = table["sequence"][at] + k // table["each"][at]
            offset = table["offset"][at] + k % table["each"][at] * length
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([column(batch, c) for c in names] + [pa.array(sequence), pa.array(offset)], [*names, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    placed = ranked.select(*columns).mapInArrow(put, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
    return placed.withColumns({"n_sequences": F.lit(bins).cast("bigint"), "least_sequences": F.lit(least).cast("bigint")})


def pack(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, n_sequences, least_sequences.

    Every row of docs, also one that repeats an id, is encoded by itself and ends with the id END, so null and empty
    texts make a piece of one id. Only texts of more than SEQUENCE ids are cut. A null id stays null. An empty table
    gives no rows. Other columns of docs are not read.
    """
    return place(pieces(docs, path, id_col, text_col))


def op1_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    """All documents as sequences of at most 4096 ids."""
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
