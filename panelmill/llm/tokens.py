"""Token ids of whole texts with the tokenizers library, chunk by chunk.

A text is cut only where the tokenizer's own pre-tokenisation always cuts, each distinct chunk is encoded once per
Python worker, and a text's ids are the concatenation. Texts in which such cuts are not certain go to the library whole.
The caches hold at most LIMIT chunks; later chunks are then encoded each time, with the same ids.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex

from panelmill.llm.common import column

#: Chunks that a worker's cache holds at most (some 0.15 KB each), and the longest chunk that it keeps.
LIMIT, LONGEST = 500_000, 48
#: What the byte-level pattern calls white space.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Where cutting before each single space or line feed would not be certain.
UNSURE = re.compile(rf"[ \n][{WHITE}]|^[{WHITE}]|[{WHITE}]\Z")
#: White space other than space and line feed, and pairs of those two that UNSURE finds.
_OTHER, _PAIRS = "\t\x0b\x0c\r\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000", ("  ", " \n", "\n ", "\n\n")
#: Characters that Python calls white space and the word tokenizer's pattern does not.
ODD = re.compile(r"[\x1c-\x1f]")
#: A chunk that the patterns of both tokenizers cut in two at most: Latin letters, which have one form and one lower-case letter each, then marks.
SIMPLE = re.compile(r"([A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([.,;:!?]*)").fullmatch
PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes for themselves, others from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    out, spare = [], 256
    for b in range(256):
        out.append(chr(b if b in plain else spare))
        spare += b not in plain
    return out


#: The letters of a byte-level vocabulary that stand for the characters that SIMPLE calls letters.
LETTERS = {c: "".join(byte_letters()[b] for b in chr(c).encode()) for c in range(256) if SIMPLE(chr(c))}


def letters_of(word: str) -> str:
    """The letters that stand for a word of SIMPLE's letters."""
    return word if word.isascii() else word.translate(LETTERS)


class Cache(dict):
    """chunk -> ids as little-endian uint32 bytes, filled on demand."""

    def __init__(self, encode: Callable[[str], bytes]):
        super().__init__()
        self.encode = encode

    def __missing__(self, chunk: str) -> bytes:
        ids = self.encode(chunk)
        if len(self) < LIMIT and len(chunk) <= LONGEST:
            self[chunk] = ids
        return ids


def packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def unsure(text: str) -> bool:
    """Whether UNSURE finds anything; plain searches answer for most texts."""
    if any(c in text for c in (_OTHER[:4] if text.isascii() else _OTHER)):
        return UNSURE.search(text) is not None
    return any(p in text for p in _PAIRS) or text[:1] in (" ", "\n") or text[-1:] in (" ", "\n")


def space_chunks(text: str) -> list[str]:
    """Chunks of a text that is not unsure(): the first as it stands, others stand for a space and themselves, or start with a line feed."""
    return text.replace("\n", " \n").split(" ")


def model_ids(model) -> Callable[[str], bytes]:
    """Ids of a word that stands in a vocabulary's letters, as packed() gives them."""
    tokenize, raw = model.tokenize, {}

    def ids_of(word: str) -> bytes:
        ids = [t.id for t in tokenize(word)]
        try:
            return b"".join([raw[i] for i in ids])
        except KeyError:
            raw.update((i, i.to_bytes(4, "little")) for i in ids)
            return b"".join([raw[i] for i in ids])

    return ids_of


class ByteLevel:
    """Ids as the library's encode(text, add_special_tokens=False) gives for a byte-level BPE file."""

    def __init__(self, path: str):
        import public_tokenizers
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.letters = {b: c for b, c in enumerate(byte_letters())}
        self.words = Cache(self.word)
        self.chunks = Cache(self.chunk)
        self.ids_of = model_ids(self.model)

    def word(self, word: str) -> bytes:
        return self.ids_of(word.encode().decode("latin-1").translate(self.letters))

    def chunk(self, chunk: str) -> bytes:
        if m := SIMPLE(chunk):
            word, marks = m.groups()
            return self.chunks[word] + self.words[marks] if marks else self.ids_of("\u0120" + letters_of(word))
        return self.first(chunk if chunk[:1] == "\n" else " " + chunk)

    def first(self, chunk: str) -> bytes:
        return b"".join([self.words[w] for w in self.split(chunk)])

    def __call__(self, text: str) -> bytes:
        if not text:
            return b""
        if unsure(text) or any(s in text for s in self.special):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        head, *rest = space_chunks(text)
        return self.first(head) + b"".join(map(self.chunks.__getitem__, rest))


class WordLevel:
    """The same for a lower-casing BPE file that drops white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.pre, self.model, self.norm = self.whole.pre_tokenizer, self.whole.model, self.whole.normalizer
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.words = Cache(model_ids(self.model))
        self.chunks = Cache(self.chunk)

    def chunk(self, chunk: str) -> bytes:
        if m := SIMPLE(chunk):
            word, marks = m.groups()
            ids = self.words[letters_of(word.lower())]
            return ids + self.words[marks] if marks else ids
        if chunk.isascii() and chunk.isprintable():
            words = PLAIN.findall(chunk.lower())
        else:
            words = [w for w, _ in self.pre.pre_tokenize_str(self.norm.normalize_str(chunk))]
        return b"".join([self.words[w] for w in words])

    def __call__(self, text: str) -> bytes:
        if ODD.search(text) or any(s in text for s in self.special):
            return packed(self.whole.encode(text, add_special_tokens=False).ids)
        return b"".join(map(self.chunks.__getitem__, text.split()))


_loaded: dict[tuple, Callable[[str], bytes]] = {}


def encoder(kind: type, path: str) -> Callable[[str], bytes]:
    """One encoder per worker, kept between tasks."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def texts(batch: pa.RecordBatch, name: str) -> Iterator[str]:
    """The texts of a batch one by one; null is empty."""
    col = column(batch, name)
    for i in range(0, len(col), 256):
        for x in col.slice(i, 256).to_pylist():
            yield x or ""


def as_ids(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, "<u4")
