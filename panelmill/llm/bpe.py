"""Byte-level BPE with contiguous rank arrays, and its inverse.

A text is cut into words by the byte-level pattern. Words that a worker has not met yet are encoded together: for each
one stand, next to each other, its parts and the merge ranks of adjacent parts. Every pass takes each word's smallest
rank, deletes that boundary, closes the gap and refreshes the two neighbouring ranks. Words over SHORT bytes go through
a linked list with a heap of ranks instead, where a scan for each merge would grow with the square of the length.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import column, spread
from panelmill.llm.tokens import LIMIT, LONGEST, byte_letters, space_chunks, texts, unsure

SHORT, NONE = 32, np.int32(2**31 - 1)
#: Characters of text whose new words are encoded together.
TOGETHER = 1 << 20


class Bpe:
    """encode() and decode() by the vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, path: str):
        import public_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, letters = spec["model"]["vocab"], byte_letters()
        byte_of = {c: b for b, c in enumerate(letters)}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes_of = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items()} | {i: s.encode() for s, i in self.special.items()}
        self.first = np.array([vocab[c] for c in letters], np.int32)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]]
        self.rank = {(vocab[a], vocab[b]): r for r, (a, b) in reversed(list(enumerate(pairs)))}
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        keys = np.array([a << 20 | b for a, b in self.rank], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.array(list(self.rank.values()), np.int32)[order]
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cut = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.words: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}

    def adjacent(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Merge ranks of pairs, NONE where the file has no such merge."""
        key = (a.astype(np.int64) << 20) | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def short(self, words: list[bytes]) -> list[bytes]:
        """Ids of words of one length, 2 to SHORT bytes."""
        n, width = len(words), len(words[0])
        parts = self.first[np.frombuffer(b"".join(words), np.uint8).reshape(n, width)]
        ranks = np.concatenate([self.adjacent(parts[:, :-1], parts[:, 1:]), np.full((n, 1), NONE)], 1)  # of a part and the next
        done: list[bytes] = [b""] * n
        rows, size = np.arange(n), np.full(n, width)
        while len(rows):
            at = ranks.argmin(1)
            k = np.arange(len(rows))
            least = ranks[k, at]
            if (over := least == NONE).any():
                for r, p, m in zip(rows[over].tolist(), parts[over], size[over].tolist(), strict=True):
                    done[r] = p[:m].astype("<u4").tobytes()
                rows, size, parts, ranks, at, least = rows[~over], size[~over], parts[~over], ranks[~over], at[~over], least[~over]
                if not len(rows):
                    break
                k = np.arange(len(rows))
            # delete the boundary after part `at`: the parts and ranks behind it move up by one
            cols = np.arange(parts.shape[1] - 1)
            src = cols + (cols > at[:, None])
            parts, ranks = np.take_along_axis(parts, src, 1), np.take_along_axis(ranks, cols + (cols >= at[:, None]), 1)
            parts[k, at] = self.made[least]
            size = size - 1
            has = at < size - 1
            ranks[k, at] = NONE
            ranks[k[has], at[has]] = self.adjacent(parts[k[has], at[has]], parts[k[has], at[has] + 1])
            has = at > 0
            ranks[k[has], at[has] - 1] = self.adjacent(parts[k[has], at[has] - 1], parts[k[has], at[has]])
        return done

    def long(self, word: bytes) -> bytes:
        parts = self.first[np.frombuffer(word, np.uint8)].tolist()
        n = len(parts)
        after, before, rank = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := rank.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:
                continue
            parts[i], parts[j] = int(self.made[r]), -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y < n and (r := rank.get((parts[x], parts[y]))) is not None:
                    heapq.heappush(heap, (r, x, parts[x], parts[y]))
        return np.array([p for p in parts if p >= 0], "<u4").tobytes()

    def learn(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word (a match of the pattern)."""
        out, by_length = {}, {}
        for w in words:
            raw = w.encode()
            if len(raw) == 1:
                out[w] = int(self.first[raw[0]]).to_bytes(4, "little")
            elif len(raw) > SHORT:
                out[w] = self.long(raw)
            else:
                by_length.setdefault(len(raw), []).append((w, raw))
        for own in by_length.values():
            out.update(zip([w for w, _ in own], self.short([raw for _, raw in own]), strict=True))
        return out

    def ids_of(self, stand: dict[str, str]) -> dict[str, bytes]:
        """For each name the ids of the text that it stands for, one that can be encoded by itself. Words are kept while there is room."""
        split = {c: self.pattern.findall(s) for c, s in stand.items()}
        fresh = self.learn({w for words in split.values() for w in words} - self.words.keys())
        kept = self.words
        out = {c: b"".join([fresh[w] if w in fresh else kept[w] for w in words]) for c, words in split.items()}
        if len(kept) < LIMIT:
            kept.update((k, v) for k, v in fresh.items() if len(k) <= LONGEST)
        return out

    def encode(self, many: list[str]) -> list[bytes]:
        """Each text's ids as little-endian uint32 bytes."""
        cut = []
        for text in many:
            if self.special and self.cut.search(text):
                at, parts = 0, []
                for m in self.cut.finditer(text):
                    parts += [text[at : m.start()], self.special[m.group()]]
                    at = m.end()
                cut.append([*parts, text[at:]])
            elif unsure(text):
                cut.append([text])
            else:
                head, *rest = space_chunks(text)
                cut.append((head, rest))
        whole = {c for x in cut if isinstance(x, list) for c in x if isinstance(c, str)} | {x[0] for x in cut if isinstance(x, tuple)}
        spaced = {c for x in cut if isinstance(x, tuple) for c in x[1]} - self.chunks.keys()
        one, kept = self.ids_of({c: c for c in whole}), self.chunks
        got = self.ids_of({c: c if c[:1] == "\n" else " " + c for c in spaced})
        if len(kept) < LIMIT:
            kept.update((c, got.pop(c)) for c in [c for c in got if len(c) <= LONGEST])
        out = []
        for x in cut:
            if isinstance(x, list):
                out.append(b"".join([one[c] if isinstance(c, str) else c.to_bytes(4, "little") for c in x]))
            elif got:
                out.append(one[x[0]] + b"".join([got[c] if c in got else kept[c] for c in x[1]]))
            else:
                out.append(one[x[0]] + b"".join(map(kept.__getitem__, x[1])))
        return out

    def decode(self, ids: bytes) -> str:
        table = self.bytes_of
        return b"".join([table[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")


_loaded: dict[str, Bpe] = {}


def encode_decode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with with_ids also ids (array of int) and decoded.

    One row per row of docs, repeated rows too; only inputs of few small files are dealt out anew. Null and empty texts have no
    ids. A null id stays null. An empty table gives no rows.
    Special tokens' strings in a text become their ids. Other columns are not read.
    """
    types = {"doc_id": pa.int64(), "n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}
    more = {"ids": pa.list_(pa.int32()), "decoded": pa.string()} if with_ids else {}
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * with_ids

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded.setdefault(path, None) or Bpe(path)
        _loaded[path] = bpe
        for batch in batches:
            rows: list[tuple] = []
            ids_of = iter(column(batch, "doc_id").to_pylist())
            held: list[str] = []

            def flush(held: list[str], rows: list[tuple] = rows, ids_of=ids_of) -> None:
                for ids in bpe.encode(held):
                    decoded = bpe.decode(ids)
                    row = (next(ids_of), len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append((*row, np.frombuffer(ids, "<u4").astype(np.int32), decoded) if with_ids else row)

            size = 0
            for text in texts(batch, "text"):
                held.append(text)
                size += len(text)
                if size > TOGETHER:
                    flush(held)
                    held, size = [], 0
            flush(held)
            cols = zip(*rows, strict=True) if rows else [[]] * len(types | more)
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(cols, (types | more).values(), strict=True)], list(types | more))

    return spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(work, schema)


def op7_bpe(spark, sf_dir: str) -> DataFrame:
    """Every document encoded and decoded again."""
    import public_tokenizers

    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"))
