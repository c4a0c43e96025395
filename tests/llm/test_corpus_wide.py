"""Concatenate and cut, resampling and alignment against brute force: each result depends on the whole corpus."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelmill.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")

from panelmill.llm import alignment, concatenate, resampling  # noqa: E402
from tests.llm.test_operators import LOWER, SCHEMA, none, sample  # noqa: E402, F401


def plain(rows):
    """Rows as tuples, in an order that takes nulls."""
    return sorted((tuple(r) for r in rows), key=repr)


def long_rows(n=400):
    """Documents of very different lengths, some longer than many windows, with repeated ids and rows."""
    rng = np.random.default_rng(5)
    out = [(int(i // 2), " ".join(rng.choice(["stone", "river", "of", "Zebra", "42", "été"], int(rng.integers(0, 60)))) if i % 17 else "lamp word " * int(rng.integers(1, 9000)), "en", "s", 1, *"123456789") for i in range(n)]
    return [(i, t, a, b, c, 5, *["q"] * 8) for i, t, a, b, c, *_ in [*out, *out[:20]]]


def test_edges():
    assert concatenate.edges(0) == [0]
    assert concatenate.edges(4096 * 3) == [4096 * 3]
    assert concatenate.edges(4096 + 13) == [4096, 4104, 4108, 4109]
    for total in (1, 5, 4095, 4096, 9000, 123_457):
        pieces = list(concatenate.cuts(0, total, concatenate.edges(total)))
        assert sum(n for _, n, _, _ in pieces) == total and [p[2] for p in pieces] == list(range(len(pieces)))
        assert all(n == 4096 or n & (n - 1) == 0 for _, n, _, _ in pieces)


@pytest.mark.parametrize("rows", [sample, long_rows])
def test_concatenate(spark, none, rows):
    from tokenizers import Tokenizer

    path, given = public_tokenizers.path("word_bpe_49k.json"), rows()
    t = Tokenizer.from_file(path)
    got = concatenate.concatenate(spark.createDataFrame(given, SCHEMA).repartition(3), path, with_ids=True).collect()
    windows = {}
    for r in got:
        windows.setdefault(r.sequence_id, []).append(r)
        assert zlib.crc32(np.array(r.ids, "<u4").tobytes()) == r.ids_crc32 and len(r.ids) == r.length > 0
    total = sum(r.length for r in got)
    assert sorted(windows) == list(range(len(windows)))
    for s, own in windows.items():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == 4096 if s < total // 4096 else at & (at - 1) == 0
    stream = [r for s in sorted(windows) for r in sorted(windows[s], key=lambda r: r.offset)]
    held, found = [], []  # pieces follow one another in the stream, so documents come out whole
    for r in stream:
        assert r.start == len(held)
        held += r.ids
        if len(held) == r.doc_tokens:
            found.append((r.doc_id, tuple(held)))
            held = []
    want = [(i, (*t.encode(x or "", add_special_tokens=False).ids, 2)) for i, x, *_ in given]
    assert not held and sorted(found, key=repr) == sorted(want, key=repr)
    assert concatenate.concatenate(none, path).count() == 0


def scores(rows, target, percent, least):
    """n_features, weight, score and rank of each row, by the definition."""
    split = lambda text: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    grams = lambda w: [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 10_000
    own, wanted = [split(r[1]) for r in rows], [split(x) for x in target]
    s, t = Counter(bucket(g) for w in own for g in grams(w)), Counter(bucket(g) for w in wanted for g in grams(w))
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + 10_000) / ((s[b] + 1) * (t.total() + 10_000)))) for b in s}
    out = []
    for r, w in zip(rows, own, strict=True):
        h = int(hashlib.sha256(f"42:{'' if r[0] is None else r[0]}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[bucket(g)] for g in grams(w))
        out.append([r[0], len(w), len(grams(w)), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None])
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], -(2**63) if r[0] is None else r[0], r[2]))
    for k, r in enumerate(able[: percent * len(able) // 100]):
        r[5] = k + 1
    return out


@pytest.mark.parametrize(("rows", "percent", "segment"), [(sample, 60, 1 << 20), (long_rows, 5, 64), (long_rows, 100, 1 << 20), (sample, 0, 7)])
def test_resample(spark, none, monkeypatch, rows, percent, segment):
    monkeypatch.setattr(resampling, "SEGMENT", segment)  # on the driver, and passed on below
    given, target = rows(), ["of stone river", "lamp word lamp " * 9, None, ""]
    for size in {segment, 1}:
        monkeypatch.setattr(resampling, "SEGMENT", size)
        for text in ("", "a", "a b", "Zebra été  x1,y2 " * 30):
            n, crcs = resampling.features(text.encode())
            words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate(LOWER))
            assert n == len(words) and Counter(crcs.tolist()) == Counter(zlib.crc32(" ".join(words[i : i + k]).encode()) for k in (1, 2, 3) for i in range(n - k + 1))
    wanted = spark.createDataFrame([(x,) for x in target], "text string")
    got = resampling.resample(spark.createDataFrame(given, SCHEMA).repartition(3), wanted, percent)
    assert plain(got.select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()) == plain(scores(given, target, percent, 20))
    assert resampling.resample(none, wanted).count() == 0


def test_ranks_of_ties(spark):
    """Many rows with few scores: the cutoff falls inside one score, ids break ties."""
    rows = [(None if i == 77 else i, i % 5, 0, i % 3, i % 4 > 0) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id bigint, n_features bigint, weight bigint, score bigint, ok boolean").repartition(5)
    able = sorted((r for r in rows if r[4]), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    want = {r[0]: k + 1 for k, r in enumerate(able[: 40 * len(able) // 100])}
    got = resampling.ranked(df, F.col("ok"), 40).collect()
    assert len(got) == 200 and {r.doc_id: r.rank for r in got if r["rank"]} == want


def aligned(texts):
    """Per text n_a, n_b, n_groups, links and the groups' string, from byte ranges of whole texts."""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    letters = {v: k for k, v in enumerate(alignment.byte_letters())}
    out = []
    for text in texts:
        if not text:
            out.append(None)
            continue
        ids_a, ids_b, want = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text), (" " + text).encode()
        raw_a = [bytes(letters[c] for c in a.id_to_token(i)) for i in ids_a]
        raw_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode() for p in map(b.id_to_piece, ids_b)]
        if b"".join(raw_a) != want or b"".join(raw_b) != want:
            out.append(None)
            continue
        at_a, at_b = np.cumsum([0, *map(len, raw_a)]), np.cumsum([0, *map(len, raw_b)])
        over = (at_a[:-1, None] < at_b[None, 1:]) & (at_b[None, :-1] < at_a[1:, None])
        links = [(ids_a[i], ids_b[j]) for i, j in zip(*np.nonzero(over), strict=True)]
        shared = sorted({*at_a.tolist()} & {*at_b.tolist()})
        said = ";".join("|".join(",".join(str(x) for x, e in zip(ids, at[1:], strict=True) if low < e <= high) for ids, at in ((ids_a, at_a), (ids_b, at_b))) for low, high in zip(shared, shared[1:], strict=False))
        out.append((len(ids_a), len(ids_b), len(shared) - 1, links, said))
    return out


STRANGE = ["a▁b c", " lead", "trail ", "two  spaces", "line\nline two\n\nthree ", "\ttab and nbsp", "naïve — 日本語🙂 x", "<s> </s> <|endoftext|> <0x41>", "é ̈x", "\x1c odd \x1d", "'s it's 'll  \n x", "tail\n", " ", "\n", "x" * 60 + " yy"]


@pytest.mark.parametrize("block", [1 << 20, 50])
def test_align(spark, none, monkeypatch, block):
    given = sample() + [(100 + i, t, "en", "s", 1, 5, *["q"] * 8) for i, t in enumerate(STRANGE)] + sample()[:3]
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    monkeypatch.setattr(alignment, "BLOCK", block)
    df = spark.createDataFrame(given, SCHEMA).repartition(3)
    found = alignment.blocks(df, *paths)
    want = aligned([r[1] for r in given])
    counts = Counter(x for w in want if w for x in w[3])
    top_a, top_b = Counter(), Counter()
    for (a, b), n in counts.items():
        top_a[a], top_b[b] = max(top_a[a], n), max(top_b[b], n)
    rows = []
    for (i, *_), w in zip(given, want, strict=True):
        if w is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, 0, ""))
            continue
        links = w[3]
        rows.append((i, *w[:3], len(links), sum(counts[x] == top_b[x[1]] for x in links), sum(counts[x] == top_a[x[0]] for x in links), sum(counts[x] for x in links), hashlib.sha256(w[4].encode()).hexdigest()))
    assert plain(alignment.align(df, *paths).collect()) == plain(rows)
    assert plain(alignment.groups(df, *paths).collect()) == plain((r[0], w[4] if w else "") for r, w in zip(given, want, strict=True))
    assert sum(r.n for r in alignment.block_pairs(found).collect()) == counts.total()
    assert alignment.align(none, *paths).count() == 0 and sum(w is None for w in want) >= 4


def test_texts_of_megabytes(spark):
    """One text of a megabyte beside short and null ones, through the three operators."""
    from tokenizers import Tokenizer

    rng = np.random.default_rng(2)
    long = " ".join("".join(rng.choice(list("abcdefghij"), int(n))) for n in rng.integers(2, 8, 180_000))
    rows = [(1, long), (2, "short text"), (3, None), (4, "x" * 300_000)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    t = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    pieces = concatenate.concatenate(table, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert sum(r.length for r in pieces if r.doc_id == 1) == len(t.encode(long, add_special_tokens=False).ids) + 1
    wanted = spark.createDataFrame([(long[:5000],)], "text string")
    got = resampling.resample(table, wanted, 50).select("doc_id", "n_words", "n_features", "weight", "score", "rank").collect()
    assert plain(got) == plain(scores(rows, [long[:5000]], 50, 20))
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    short = long[:3000]
    got = {r.doc_id: r for r in alignment.align(spark.createDataFrame([(1, long), (2, short), (3, "y" * 3000)], "doc_id bigint, text string"), *paths).collect()}
    for i, w in zip((2, 3), aligned([short, "y" * 3000]), strict=True):
        assert (got[i].n_a, got[i].n_b, got[i].n_groups, got[i].n_links, got[i].groups_sha256) == (*w[:3], len(w[3]), hashlib.sha256(w[4].encode()).hexdigest())
    assert got[1].n_groups >= 180_000 and got[1].n_links == got[1].n_a + got[1].n_b - got[1].n_groups


def test_repeated_rows_and_clashing_columns(spark):
    """Every row twice gives every row's result twice where the result doesn't count the corpus; other columns are not read."""
    one = spark.createDataFrame(sample(), SCHEMA)
    for c in ("part", "before", "first", "score", "eligible", "rank", "block", "place", "a", "b", "count", "buckets"):
        one = one.withColumn(c, F.lit("q"))
    both = one.unionAll(one)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    runs = {
        "groups": lambda d: alignment.groups(d, *paths), "align": lambda d: alignment.align(d, *paths).drop("count_sum"),
        "hashed": lambda d: resampling.hashed(d), "tokens": lambda d: concatenate.concatenate(d, public_tokenizers.path("word_bpe_49k.json")).groupBy("doc_id", "doc_tokens").agg((F.sum("length") / F.col("doc_tokens")).cast("int").alias("n")),
    }
    for name, run in runs.items():
        got = [run(d).collect() for d in (one, both)]
        if name == "tokens":  # as many documents of each length, whole
            assert plain((r.doc_id, r.doc_tokens, 2 * r.n) for r in got[0]) == plain(map(tuple, got[1]))
        else:
            assert sorted(map(repr, got[1])) == sorted([*map(repr, got[0])] * 2), name
