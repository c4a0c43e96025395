"""The pipeline's stages on a small table, each against brute force on what the one before it kept."""

import re
import zlib

import numpy as np
import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_operators import LOWER, SCHEMA, brute_components, check_places, key, sample  # noqa: E402

import public_tokenizers  # noqa: E402


def good(text):
    """The policy v2 by plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if x.strip(" \t\n\x0b\x0c\r")]
    windows, where = [tuple(words[k : k + 3]) for k in range(len(words) - 2)], {}
    for k, w in enumerate(windows):
        where.setdefault(w, []).append(k)
    repeated = {p for own in where.values() if len(own) > 1 for k in own for p in (k, k + 1, k + 2)}
    chars, symbols = sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or ""))
    n = len(words)
    return not (n < 50 or 100 * len(repeated) > 50 * n or chars < 2 * n or chars > 15 * n or 10 * symbols > 6 * n or 10 * (len(lines) - len(set(lines))) > 6 * len(lines))


def without_repeats(rows):
    first, out = {}, {}
    for i, text in sorted(rows):
        raw = (text or "").encode()
        cut = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if first.get(raw[k : k + 50], i) < i:
                cut[k : k + 50] = b"\1" * 50
        for k in range(len(raw) - 49):
            first[raw[k : k + 50]] = min(i, first.get(raw[k : k + 50], i))
        out[i] = bytes(c for c, x in zip(raw, cut, strict=True) if not x).decode("utf-8", "ignore")
    return out


def test_stages(spark, tmp_path):
    from tokenizers import Tokenizer

    docs = spark.createDataFrame(sample(), SCHEMA)
    kept = {"": [(key(i), t) for i, t, *_ in sample()]}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        if k < len(corpus_pipeline.STAGES) - 1:
            assert docs.columns == SCHEMA.replace(" string", "").replace(" bigint", "").split(", ")
            kept[name] = [(key(r.doc_id), r.text) for r in docs.collect()]
    assert sorted(kept["quality"]) == sorted((i, t) for i, t in kept[""] if good(t)) and len(kept["quality"]) >= 8
    firsts = {}
    for i, t in sorted(kept["quality"]):
        firsts.setdefault(t.translate(LOWER), (i, t))
    assert sorted(kept["exact"]) == sorted(firsts.values()) and len(firsts) < len(kept["quality"])
    groups = brute_components(sorted(kept["exact"]))
    assert sorted(kept["near"]) == sorted((i, t) for i, t in kept["exact"] if groups[i][1] == i) and len(kept["near"]) < len(kept["exact"])
    assert dict(kept["passages"]) == without_repeats(kept["near"]) != dict(kept["near"])
    rows, t = docs.collect(), Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = set()
    for i, text in kept["passages"]:
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        want |= {(i, a // 4096, a, len(ids[a : a + 4096]), zlib.crc32(np.array(ids[a : a + 4096], "<u4").tobytes())) for a in range(0, len(ids), 4096)}
    assert {(key(r.doc_id), *tuple(r)[1:5]) for r in rows} == want and len(rows) == len(want)
    assert check_places(rows) == rows[0].n_sequences


def test_stages_on_an_empty_table(spark, tmp_path):
    docs = spark.createDataFrame([], SCHEMA)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_registered_run(spark, tmp_path):
    """run() is the stages one after the other."""
    rows = [r[:5] for r in sample()]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert out and check_places(out) == out[0].n_sequences
