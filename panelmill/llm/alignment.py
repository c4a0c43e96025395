"""Alignment of two tokenizers' ids over the same bytes, and how often each pair of ids is linked in the whole corpus.

A is a byte-level BPE, B a piece BPE whose pieces mark spaces; B puts a space before a text, so A gets one too. Inside a
task a two-pointer merge of both sides' cumulative token ends walks over every chunk of text: each step is a link (two
tokens whose bytes overlap), and where both sides end together a group ends. Texts are cut into chunks only before a
single space between two characters that are not white, where both tokenizers always cut, so a group never crosses a
cut, and a worker merges each distinct short chunk once. A text without such spaces is one chunk.

Documents travel in blocks of about BLOCK links. A block lists its distinct pairs of ids once, with their number in the
block, and each document's cells (place in that list, number). So only pairs distinct in a block are shuffled: a groupBy
sums them to the corpus' counts, both sides' maxima come from these, and a join takes counts and maxima back to each
block, whose task adds them up by document. A pair that every block holds has one row for each block, one in some
hundred thousand of all rows, so it is no hot key; AQE may split it yet.
"""

from __future__ import annotations

import gc
import hashlib
import re
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import Scratch, column, spread
from panelmill.llm.tokens import byte_letters, texts

#: Links in a block (a document with more has a block by itself).
BLOCK = 1 << 20
#: Chunks that a worker keeps before older ones that aren't used again go, twice this many at most (some 0.5 KB each), the longest chunk that it keeps, and the characters of texts that are cut and looked up together.
LIMIT, LONGEST, TEXTS = 300_000, 48, 1 << 20
#: B's mark of a space.
SPACE = "▁"
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = re.compile(r"[^\S \n]|  | \n|\n |^ | \Z")
_BYTE = re.compile(r"<0x([0-9A-F]{2})>")


def merge(a: list[int], b: list[int], size_a: Sequence[int], size_b: Sequence[int]) -> tuple[str, list[int]]:
    """Groups as text and links (A's id << 32 | B's id) of two token sequences over the same bytes; size_a and size_b: bytes of each id.

    x and y are the cumulative ends of the tokens that the pointers i and j stand at.
    """
    said, links, i, j, i0, j0 = [], [], 0, 0, 0, 0
    x, y, n = size_a[a[0]], size_b[b[0]], len(a)
    while True:
        links.append(a[i] << 32 | b[j])
        if x < y:
            i += 1
            x += size_a[a[i]]
        elif y < x:
            j += 1
            y += size_b[b[j]]
        else:
            i, j = i + 1, j + 1
            said.append(f"{a[i0]}|{b[j0]}" if i - i0 == j - j0 == 1 else f"{','.join(map(str, a[i0:i]))}|{','.join(map(str, b[j0:j]))}")
            if i == n:
                return ";".join(said), links
            i0, j0, x, y = i, j, x + size_a[a[i]], y + size_b[b[j]]


class Aligner:
    """What a text's alignment consists of, chunk by chunk. A chunk whose bytes a side doesn't give back has none."""

    def __init__(self, a_path: str, b_path: str):
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_path)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_path)
        value = {c: b for b, c in enumerate(byte_letters())}
        names = self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = {i: bytes(value[c] for c in name) for name, i in names.items() if all(c in value for c in name)}
        pieces = [self.b.id_to_piece(i) for i in range(len(self.b))]
        self.b_bytes = [bytes.fromhex(m[1]) if (m := _BYTE.fullmatch(p)) else p.replace(SPACE, " ").encode() for p in pieces]
        #: No piece goes on over a space, so that B can be cut before one.
        self.cuttable = not any(SPACE in p.lstrip(SPACE) for p in pieces)
        self.a_size, self.b_size = [len(self.a_bytes.get(i, b"")) for i in range(max(self.a_bytes) + 1)], [len(x) for x in self.b_bytes]
        #: Chunks seen of late, and those before them: what is used again moves over, so that common chunks stay.
        self.kept: dict[str, tuple | None] = {}
        self.before: dict[str, tuple | None] = {}

    def chunks(self, text: str) -> list[str]:
        if not self.cuttable:
            return [text]
        return _CUT.split(text) if _WHITE.search(text) else text.split(" ")

    def learn(self, chunks: list[str]) -> None:
        """Keep, of each chunk with a space before it, the number of A's tokens, the groups as text, and the links as 64-bit integers."""
        ids_a, ids_b = self.a.encode_batch_fast([" " + c for c in chunks], add_special_tokens=False), self.b.encode(chunks, num_threads=1)
        bytes_a, bytes_b, size_a, size_b = self.a_bytes.__getitem__, self.b_bytes.__getitem__, self.a_size, self.b_size
        for chunk, a, b in zip(chunks, ids_a, ids_b, strict=True):
            a, want = a.ids, b" " + chunk.encode()
            self.kept[chunk] = None
            if b"".join(map(bytes_a, a)) == want == b"".join(map(bytes_b, b)):
                groups, links = merge(a, b, size_a, size_b)
                self.kept[chunk] = len(a), groups, struct.pack(f"<{len(links)}Q", *links)

    def __call__(self, texts: list[str]) -> Iterator[tuple[int, int, int, str, bytes] | None]:
        """Numbers of A's and B's tokens and of groups, the groups as text, and the links of each text; None for one that is empty or of which either side's bytes differ."""
        cut = [self.chunks(text) if text else [] for text in texts]
        used = {c for chunks in cut for c in chunks}
        if len(self.kept) > LIMIT:
            self.kept, self.before = {}, self.kept
        new = [c for c in used if c not in self.kept]
        self.kept.update((c, self.before[c]) for c in new if c in self.before)
        gc.disable()  # nothing that is learnt has cycles, and the many objects kept make each pass of the collector long
        try:
            self.learn([c for c in new if c not in self.before])
        finally:
            gc.enable()
        for chunks in cut:
            own = list(map(self.kept.__getitem__, chunks))
            if not own or None in own:
                yield None
                continue
            n_a, groups, links = zip(*own, strict=True)
            a, said, raw = sum(n_a), ";".join(groups), b"".join(links)
            n = said.count(";") + 1
            yield a, len(raw) // 8 + n - a, n, said, raw  # each link but a group's last moves one side on by one token
        for chunk in used:
            if len(chunk) > LONGEST:
                del self.kept[chunk]


_loaded: dict[tuple[str, str], Aligner] = {}


def aligned(batch: pa.RecordBatch, name: str, align: Aligner) -> Iterator[tuple[int, int, int, str, bytes] | None]:
    """Alignments of a batch's texts, some TEXTS characters of them at a time."""
    held, size = [], 0
    for text in texts(batch, name):
        held.append(text)
        size += len(text)
        if size > TEXTS:
            yield from align(held)
            held, size = [], 0
    yield from align(held)


def aligner(a_path: str, b_path: str) -> Aligner:
    """One aligner per worker, kept between tasks."""
    if (a_path, b_path) not in _loaded:
        _loaded[a_path, b_path] = Aligner(a_path, b_path)
    return _loaded[a_path, b_path]


_DOCS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "sha"]
_BLOCKS = "block bigint, doc_id array<bigint>, n_a array<bigint>, n_b array<bigint>, n_groups array<bigint>, n_links array<bigint>, sha array<string>, n_cells array<int>, place binary, times binary, pairs binary, n_pairs binary"


def groups(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and groups, the text `a1,a2|b1;a3|b2,b3` of a row's groups in order; empty without tokens."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align = aligner(a_path, b_path)
        for batch in batches:
            own = [found[3] if found else "" for found in aligned(batch, "text", align)]
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), pa.array(own, pa.string())], ["doc_id", "groups"])

    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(work, "doc_id bigint, groups string")


def blocks(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Blocks of documents: their measures, their cells, and the block's distinct pairs with their numbers."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        align, block = aligner(a_path, b_path), TaskContext.get().partitionId() << 32
        held: list[tuple] = []
        links: list[np.ndarray] = []

        def flush() -> pa.RecordBatch:
            every, place = np.unique(np.concatenate(links), return_inverse=True)
            numbers = np.bincount(place, minlength=len(every))
            cells, at = [], 0
            for own in links:
                cells.append(np.unique(place[at : at + len(own)], return_counts=True))
                at += len(own)
            row = [[x] for x in (block, *(list(c) for c in zip(*held, strict=True)), [len(p) for p, _ in cells])]
            row += [[np.concatenate([c[k] for c in cells]).astype("<u4").tobytes()] for k in (0, 1)] + [[every.tobytes()], [numbers.astype("<u4").tobytes()]]
            many = pa.list_(pa.int64())
            types = [pa.int64(), many, many, many, many, many, pa.list_(pa.string()), pa.list_(pa.int32()), *[pa.binary()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, types, strict=True)], ["block", *_DOCS, "n_cells", "place", "times", "pairs", "n_pairs"])

        size = 0
        for batch in batches:
            for doc, found in zip(column(batch, "doc_id").to_pylist(), aligned(batch, "text", align), strict=True):
                n_a, n_b, n_groups, said, raw = found or (0, 0, 0, "", b"")
                own = np.frombuffer(raw, np.uint64)
                if held and (size + len(own) > BLOCK or len(held) >= BLOCK):
                    yield flush()
                    held, links, size, block = [], [], 0, block + 1
                held.append((doc, n_a, n_b, n_groups, len(own), hashlib.sha256(said.encode()).hexdigest() if found else ""))
                links.append(own)
                size += len(own)
        if held:
            yield flush()

    rows = spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")))
    return rows.mapInArrow(work, _BLOCKS)


def block_pairs(found: DataFrame) -> DataFrame:
    """block, place, a, b, n: the distinct pairs of each block."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                pairs, n = np.frombuffer(column(batch, "pairs")[i].as_buffer(), np.uint64), np.frombuffer(column(batch, "n_pairs")[i].as_buffer(), "<u4")
                for k in range(0, len(pairs), 1 << 16):
                    own = pairs[k : k + (1 << 16)]
                    cols = [np.full(len(own), column(batch, "block")[i].as_py()), np.arange(k, k + len(own), dtype=np.int32), (own >> np.uint64(32)).astype(np.int32), own.astype(np.uint32).astype(np.int32), n[k : k + (1 << 16)].astype(np.int64)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["block", "place", "a", "b", "n"])

    return found.select("block", "pairs", "n_pairs").mapInArrow(work, "block bigint, place int, a int, b int, n bigint")


def pair_counts(pairs: DataFrame) -> DataFrame:
    """a, b, count (links of that pair in the corpus), a_best and b_best (the highest count of any pair with that a, that b)."""
    scratch = Scratch(pairs.sparkSession)
    counts = scratch.write(pairs.groupBy("a", "b").agg(F.sum("n").alias("count")), "counts")
    highest = lambda side: counts.groupBy(side).agg(F.max("count").alias(f"{side}_best"))
    return counts.join(highest("b"), "b").join(highest("a"), "a").select("a", "b", "count", "a_best", "b_best")


_OUT = "doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, n_best_a bigint, count_sum bigint, groups_sha256 string"


def align(docs: DataFrame, a_path: str, b_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_a, n_b, n_groups, n_links, n_best, n_best_a, count_sum, groups_sha256.

    n_best counts links whose pair is the corpus' commonest of its B id, n_best_a of its A id, ties included; count_sum
    is the sum of the links' corpus counts. Special tokens' strings are ordinary text. Null and empty texts, and those
    whose bytes either side doesn't give back (B takes U+2581 for a space), have no tokens: zeros and an empty digest.
    Repeated rows count each. A null id stays null. An empty table gives no rows. Other columns are not read.
    """
    scratch = Scratch(docs.sparkSession)
    found = scratch.write(blocks(docs, a_path, b_path, id_col, text_col), "blocks")
    pairs = block_pairs(found)
    counts = pair_counts(pairs)
    best = lambda side: (F.col("count") == F.col(f"{side}_best")).cast("int")
    answers = pairs.select("block", "place", "a", "b").join(counts, ["a", "b"]).select("block", "place", "count", (best("b") + 2 * best("a")).cast("tinyint").alias("best"))

    def work(own: pa.Table, told: pa.Table) -> pa.Table:
        count, best = np.zeros(told.num_rows, np.int64), np.zeros(told.num_rows, np.int8)
        at = told.column("place").to_numpy()
        count[at], best[at] = told.column("count").to_numpy(), told.column("best").to_numpy()
        row = own.to_pylist()[0]
        place, times = np.frombuffer(row["place"], "<u4"), np.frombuffer(row["times"], "<u4").astype(np.int64)
        ends = np.cumsum(np.array(row["n_cells"], np.int64))
        sums = []
        for each in (times * (best[place] & 1), times * (best[place] >> 1), times * count[place]):
            upto = np.concatenate([[0], np.cumsum(each)])
            sums.append(pa.array(np.diff(upto[np.concatenate([[0], ends])])))
        numbers = [pa.array(row[c], pa.int64()) for c in _DOCS[:-1]]
        return pa.table([*numbers, *sums, pa.array(row["sha"], pa.string())], [*_DOCS[:-1], "n_best", "n_best_a", "count_sum", "groups_sha256"])

    kept = found.select("block", *_DOCS, "n_cells", "place", "times")
    return kept.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(work, _OUT)


def op13_cross_tokenizer_alignment(spark, sf_dir: str) -> DataFrame:
    """All documents by a byte-level BPE and a piece BPE."""
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
