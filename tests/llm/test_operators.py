"""Each operator against a brute-force version, over texts with nulls, copies, ties, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import itertools
import os
import random
import re
import textwrap
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("panelmill.llm.queries")
public_tokenizers = pytest.importorskip("public_tokenizers")

from panelmill.llm import bpe, exact_dedup, license_scan, ngram_join, packing, quality_rules, suffix_dedup, token_counts, tokens, toxicity, wavelet  # noqa: E402

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id bigint, n string, norm string, words string, bucket string, part string, start string, row string, toxic string"


def sample(seed=3):
    """Rows with every case that the operators must take."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "Zebra", "été", "naïve", "run,", "lamp", "stone", "river.", "Über", "x1", "42", "—", "word"]
    say = lambda n: " ".join(rng.choice(vocabulary) + (rng.choice("abcdef") if rng.random() < 0.6 else "") for _ in range(n))
    base, passage = say(120), say(30)
    words = base.split(" ")
    near = [" ".join(w if rng.random() > 0.02 else "edit" for w in words) for _ in range(6)]
    texts = [base, base.upper(), base, *near, say(80) + "\n" + passage + "\n" + say(60), passage, say(40) + " " + passage, None, "", " \n\t", "one", "one two three", "one two three", "a" * 300, "ab " * 400,
             say(3000), "idiot " + say(50), "Licensed under the Apache License, Version 2.0.\n" + say(20), "x" * 49, "y" * 50, "y" * 50, "<|endoftext|> tail", "  two  spaces\n\n", "日本語 のテキスト🙂", None]
    ids = [7, 3, 12, *range(20, 26), 30, 31, 32, 40, 41, 42, 43, 44, 45, 46, 47, 48, 49, 50, 51, 52, 53, 54, 55, 56, None]
    rows = [(i, t, "en", "s1", 1, 5, "q", "q", "q", "q", "q", "q", "q", "q") for i, t in zip(ids, texts, strict=True)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(sample(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def key(i):
    return -(2**63) if i is None else i


def test_packing(docs, none):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    got = packing.pack(docs, path).collect()
    want = set()
    for i, text, *_ in sample():
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 1]
        want |= {(i, k // 4096, k, len(ids[k : k + 4096]), zlib.crc32(np.array(ids[k : k + 4096], "<u4").tobytes())) for k in range(0, len(ids), 4096)}
    assert {tuple(r)[:5] for r in got} == want and len(got) == len(want)
    check_places(got)
    assert packing.pack(none, path).count() == 0


def check_places(got):
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for o, n in sorted(own):
            assert o == at
            at += n
        assert at <= 4096
    return len(by)


@pytest.mark.parametrize("seed", range(6))
def test_packing_is_optimal_on_small_sets(seed):
    rng = random.Random(seed)
    sizes = [rng.randint(1, 20) for _ in range(9)]
    best = min_bins(sizes, 20)
    hist = np.bincount(sizes, minlength=21)
    n, plan, least = packing.complete(hist, 20, None, None, None)
    assert least <= n == best == sum(t for t, _ in plan) <= packing.complete(hist, 20)[0]
    used = sorted(x for t, items in plan for _ in range(t) for x in items)
    assert used == sorted(sizes) and all(sum(items) <= 20 for _, items in plan)


def test_packing_search_needs_both_dominance_and_branching(monkeypatch):
    """Random sets: without limits the optimum, within the limits of production too; dominance agrees with all swaps tried out."""
    rng = random.Random(1)
    for k in range(120):
        sizes = [rng.randint(1, 100) if k % 2 else rng.randint(15, 60) for _ in range(11)]
        best, hist = min_bins(sizes, 100), np.bincount(sizes, minlength=101)
        assert packing.complete(hist, 100, None, None, None)[0] == best == packing.complete(hist, 100)[0]
    for _ in range(500):
        items, waste, spare = [rng.randint(1, 20) for _ in range(rng.randint(0, 5))], rng.randint(0, 6), {rng.randint(1, 30) for _ in range(rng.randint(0, 4))}
        swaps = [(sum(c), len(c)) for r in range(1, len(items) + 1) for c in itertools.combinations(items, r)]
        want = any(s <= x <= s + waste and (n, s) != (1, x) for s, n in swaps for x in spare)
        assert packing.dominated(items, waste, sum(1 << x for x in spare)) == want
    calls = []
    plain = packing.dominated
    monkeypatch.setattr(packing, "dominated", lambda *a: calls.append(plain(*a)) or calls[-1])
    packing.fillings(np.bincount([50, 30, 20, 10, 9, 1], minlength=101), 60)
    assert any(calls) and not all(calls)


def best_fit_decreasing(sizes, room):
    rooms = []
    for x in sorted(sizes, reverse=True):
        k = min((i for i, r in enumerate(rooms) if r >= x), key=rooms.__getitem__, default=None)
        if k is None:
            rooms.append(room - x)
        else:
            rooms[k] -= x
    return len(rooms)


def martello_toth(sizes, room):
    best = 0
    for a in {0, *(x for x in sizes if 2 * x <= room)}:
        alone, large, fill = [x for x in sizes if x > room - a], [x for x in sizes if room < 2 * x <= 2 * (room - a)], [x for x in sizes if a <= x <= room / 2]
        best = max(best, len(alone) + len(large) + max(0, -(-(sum(fill) - len(large) * room + sum(large)) // room)))
    return best


@pytest.mark.parametrize("seed", range(10))
def test_packing_is_never_worse_than_best_fit(seed):
    """Ten sets of 100 to 800 lengths each, among them the narrow ranges that searches find hard."""
    rng = random.Random(seed)
    for k in range(10):
        low = rng.randint(1, 1500)
        high = (1800 if k % 2 else 4096) if low < 1700 else 4096
        sizes = [rng.randint(low, max(low, high)) for _ in range(rng.randint(100, 800))]
        hist = np.bincount(sizes, minlength=4097)
        n, plan, least = packing.complete(hist, 4096, budget=30)
        assert packing.best_fit(hist, 4096)[0] == best_fit_decreasing(sizes, 4096) >= n >= least == martello_toth(sizes, 4096)
        used = np.zeros(4097, int)
        for times, items in plan:
            assert sum(items) <= 4096
            np.add.at(used, items, times)
        assert (used == hist).all() and sum(t for t, _ in plan) == n
    many = np.bincount([4000, 3000, 96, 1, 50], minlength=4097) * 10**9  # counts of any size take few steps
    assert packing.complete(many, 4096)[0] == 2 * 10**9


def min_bins(sizes, room):
    sizes, best = sorted(sizes, reverse=True), len(sizes)

    def down(i, bins):
        nonlocal best
        if len(bins) >= best:
            return
        if i == len(sizes):
            best = len(bins)
            return
        for k in range(len(bins)):
            if bins[k] + sizes[i] <= room:
                down(i + 1, [*bins[:k], bins[k] + sizes[i], *bins[k + 1 :]])
        down(i + 1, [*bins, sizes[i]])

    down(0, [])
    return best


def test_suffix_dedup(docs, none):
    seen, want = {}, {}
    for i, text in sorted(((key(i), t or "") for i, t, *_ in sample())):
        raw = text.encode()
        cut = bytearray(len(raw))
        for k in range(len(raw) - 49):
            if seen.get(raw[k : k + 50], i) < i:
                cut[k : k + 50] = b"\1" * 50
        for k in range(len(raw) - 49):
            seen[raw[k : k + 50]] = min(i, seen.get(raw[k : k + 50], i))
        left = bytes(c for c, x in zip(raw, cut, strict=True) if not x)
        want[i] = (len(raw), sum(cut), sum(1 for k in range(len(raw)) if cut[k] and (not k or not cut[k - 1])), hashlib.sha256(left).hexdigest())
    got = {key(r.doc_id): tuple(r)[1:] for r in suffix_dedup.suffix_dedup(docs).collect()}
    assert got == want
    assert suffix_dedup.suffix_dedup(none).count() == 0


def test_suffix_dedup_of_long_texts(spark, monkeypatch):
    """A text of megabytes, a passage that lies across a segment's end, repeated rows and a null id; also with small segments."""
    rng = random.Random(8)
    long = "".join(rng.choices("abcdefghij \n", k=3_000_000))
    at = suffix_dedup.SEGMENT - 40
    passage = long[at : at + 90]
    rows = [(5, long), (9, "x" * 30 + passage + "y" * 30), (None, "z" * 40 + passage[:60]), (9, "x" * 30 + passage + "y" * 30), (11, None)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted(((key(r.doc_id), r.n_bytes, r.n_removed, r.n_spans) for r in suffix_dedup.suffix_dedup(table).collect()))
    assert got == [(key(None), 100, 0, 0), (5, 3_000_000, 60, 1), (9, 150, 90, 1), (9, 150, 90, 1), (11, 0, 0, 0)]
    raw, plain = np.frombuffer(long[:5000].encode(), np.uint8), suffix_dedup.window_hashes(long[:5000].encode(), np.arange(4951))
    whole = suffix_dedup.runs(raw, np.array([0, 5000]))
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 700)
    assert all((a == b).all() for a, b in zip(suffix_dedup.window_hashes(long[:5000].encode(), np.arange(4951)), plain, strict=True))
    cut = suffix_dedup.runs_of_long(raw)
    assert cut[0]["n"].sum() == whole[0]["n"].sum() == 4951 and len(whole[0]) <= len(cut[0]) <= len(whole[0]) + 8


def test_window_hashes_take_all_bytes_twice():
    """Windows that agree in one half differ in both hashes; equal windows agree in both wherever they stand."""
    rng = random.Random(4)
    say = lambda n: bytes(rng.randrange(97, 123) for _ in range(n))
    one, two, three = say(25), say(25), say(25)
    raw = b"".join([one, two, one, three, three, two, one, two])
    hashes, more = suffix_dedup.window_hashes(raw, np.array([0, 50, 100, 150]))
    assert hashes[0] == hashes[3] and more[0] == more[3]
    assert len({*hashes[:3].tolist()}) == len({*more[:3].tolist()}) == 3


def test_remove_repeats_keeps_columns(docs):
    out = suffix_dedup.remove_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    assert by_id(out)[12].text == "" and by_id(out)[7].text != ""


@pytest.mark.parametrize("keep", ["min", "max"])
def test_exact_dedup(docs, none, keep):
    groups = {}
    for i, text, *_ in sample():
        groups.setdefault((text or "").translate(LOWER), []).append(key(i))
    got = exact_dedup.exact_dedup(docs, keep=keep).collect()
    assert len(got) == len(sample())
    want = {(i, (min if keep == "min" else max)(own), len(own), hashlib.sha256(t.encode()).hexdigest()) for t, own in groups.items() for i in own}
    assert {(key(r.doc_id), key(r.keep_id), r.group_size, r.text_sha256) for r in got} == want
    assert exact_dedup.exact_dedup(none).count() == 0


def test_unique_documents(docs, spark):
    out = exact_dedup.unique_documents(docs.unionAll(docs))
    texts = [(r.text or "").translate(LOWER) for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").translate(LOWER) for _, t, *_ in sample()})
    assert out.columns == docs.columns


def measured(text):
    """n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words by plain Python."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    where = {}
    for k in range(len(words) - 2):
        where.setdefault(tuple(words[k : k + 3]), []).append(k)
    repeated = {p for own in where.values() if len(own) > 1 for k in own for p in (k, k + 1, k + 2)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines), len(lines) - len(set(lines)), len(repeated)


def failures(m):
    n, chars, symbols, lines, dup, repeated = m
    rules = [n < 50, 100 * repeated > 50 * n, chars < 2 * n, chars > 15 * n, 10 * symbols > 6 * n, 10 * dup > 6 * lines, n > 1_000_000]
    return sum(1 << k for k, x in enumerate(rules) if x)


LINES = [(60, "same line\n" * 40 + "and one more\n\n \t\n", "en"), (61, "#* $% & | <> ## word\n" * 20, "en"), (62, "word " * 60, "en"), (63, "w" * 30 + " " + "x " * 55, "en")]


def test_quality_rules(docs, none, spark):
    more = spark.createDataFrame([(i, t, *[None] * 12) for i, t, _ in LINES], SCHEMA)
    table = docs.unionAll(more).unionAll(more)
    rows = [(i, t) for i, t, *_ in sample()] + 2 * [(i, t) for i, t, _ in LINES]
    got = quality_rules.verdicts(quality_rules.ledger(table)).collect()
    seen = sorted((key(r.doc_id), r.n_words, r.word_chars, r.n_symbols, r.n_lines, r.n_dup_lines, r.n_repeat_words, r.fail_bits, r.kept) for r in got)
    v2 = quality_rules.mask("v2")
    assert seen == sorted((key(i), *(m := measured(t)), f := failures(m), not f & v2) for i, t in rows)
    kept = quality_rules.kept_documents(table)
    assert kept.columns == docs.columns and sorted((key(r.doc_id), r.text) for r in kept.collect()) == sorted((key(i), t) for i, t in rows if not failures(measured(t)) & v2)
    assert quality_rules.ledger(none).count() == 0 and quality_rules.kept_documents(none).count() == 0


def test_ablations(docs):
    book = quality_rules.ledger(docs)
    got = {(r.policy, r.without): r.n_kept for r in quality_rules.ablations(book).collect()}
    bits, names = [failures(measured(t)) for _, t, *_ in sample()], [n for n, _ in quality_rules.RULES]
    want = {}
    for v, rules in quality_rules.POLICIES.items():
        for gone in (None, *rules):
            mask = sum(1 << names.index(r) for r in rules if r != gone)
            want[v, gone] = sum(not x & mask for x in bits)
    assert got == want and want["v2", None] == quality_rules.keep(book).count()


def test_token_ledger(docs, none, spark, tmp_path):
    ledger = token_counts.Ledger(spark, str(tmp_path / "ledger"))
    counts = token_counts.count_tokens(docs, {"words-1": None})
    total = lambda: {(r.source, r.lang): (r.n_docs, r.n_tokens) for r in ledger.totals().collect()}
    assert ledger.totals().count() == 0
    assert ledger.commit("a", inserts=counts) and not ledger.commit("a", inserts=counts)
    words = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, *_ in sample()}
    assert total() == {("s1", "en"): (len(sample()), sum(words.values()))}
    new = spark.createDataFrame([(7, "s2", "fr", "words-1", 5), (99, "s2", None, "words-1", 2)], "doc_id bigint, source string, lang string, tokenizer string, n_tokens bigint")
    assert ledger.commit("b", revisions=new, deletes=spark.createDataFrame([(3,), (1000,)], "doc_id bigint"))
    assert total() == {("s1", "en"): (len(sample()) - 2, sum(words.values()) - words[7] - words[3]), ("s2", "fr"): (1, 5), ("s2", None): (1, 2)}
    assert not ledger.commit("b", revisions=new)
    assert ledger.commit("c", deletes=docs.select("doc_id"))
    assert total() == {("s2", None): (1, 2)}
    assert ledger.commit("d", inserts=token_counts.count_tokens(none, {"words-1": None}))


def test_token_ledger_snapshots_and_conflicts(docs, spark, tmp_path):
    """Totals and later deletes are the same with a snapshot; a document in two parts of a batch is refused."""
    one, two = (token_counts.Ledger(spark, str(tmp_path / n)) for n in ("plain", "compacted"))
    counts = token_counts.count_tokens(docs, {"words-1": None})
    for ledger in (one, two):
        ledger.commit("a", inserts=counts)
    assert two.compact() == "00000000"
    for ledger in (one, two):
        ledger.commit("b", deletes=spark.createDataFrame([(7,), (42,), (None,)], "doc_id bigint"))
        ledger.commit("c", inserts=counts.where("doc_id = 42"))
    two.compact()
    assert not two.commit("a", inserts=counts)
    left = [t for i, t, *_ in sample() if i not in (7, None)]
    for ledger in (one, two):
        assert [tuple(r)[3:] for r in ledger.totals().collect()] == [(len(left), sum(len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for t in left))]
    for parts in ({"inserts": counts, "deletes": counts}, {"revisions": counts, "deletes": counts}, {"inserts": counts, "revisions": counts}):
        with pytest.raises(ValueError):
            one.commit("d", **parts)


def test_token_counts_query(spark, tmp_path):
    """The whole query on a small table, both tokenizers, against counts by the library: copies gone, repeated lines taken out."""
    from tokenizers import Tokenizer

    rows = [(i, t, "en", f"s{(i or 0) % 2}", 1) for i, t, *_ in sample() if i is not None] + [(90, "one two\nthree\none two\n\n", "en", "s0", 1), (91, "one two\nthree\none two\n\n", "fr", "s1", 1), (92, "a b\na b\na b", "fr", "s1", 1)]
    spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    t, want, seen = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), {}, set()
    for _, text, lang, source, _ in sorted(rows):
        if (text or "") in seen:
            continue
        seen.add(text or "")
        text = "\n".join(dict.fromkeys((text or "").split("\n")))
        for version, n in (("words-1", len(re.findall(r"[^\x20\x09-\x0D]+", text))), ("byte_bpe_50k", len(t.encode(text, add_special_tokens=False).ids))):
            was = want.get((source, lang, version), (0, 0))
            want[source, lang, version] = (was[0] + 1, was[1] + n)
    got = {(r.source, r.lang, r.tokenizer): (r.n_docs, r.n_tokens) for r in token_counts.op5_token_counts(spark, str(tmp_path)).collect()}
    assert got == want


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the driver's tables")
def test_token_counts_revises_real_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    want = {r.doc_id for r in docs.collect() if len(set((r.text or "").split("\n"))) < len((r.text or "").split("\n"))}
    assert {r.doc_id for r in token_counts.without_repeated_lines(docs).collect()} == want and len(want) > 3


def test_license_scan(docs, none):
    got = {key(r.doc_id): r for r in license_scan.scan(docs).collect()}
    phrases = [(p.split(), label) for p, label in license_scan.PHRASES.items()]
    assert len(got) == len(sample())
    for i, text, *_ in sample():
        r, words = got[key(i)], re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        places = [(k, label) for k in range(len(words)) for p, label in phrases if words[k : k + len(p)] == p]
        assert (r.n_words, r.n_base, r.base_labels) == (len(words), len(places), ",".join(sorted({x for _, x in places})))
        assert (r.first_word, r.last_word) == (min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        found, best = set(), 0.0
        for line in (text or "").translate(LOWER).split("\n"):
            block = set(re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", line))
            for label, t in license_scan.TEMPLATES:
                own = {w.decode() for w in license_scan.words(t.encode())}
                if len(own & block) >= license_scan.needed(len(own), license_scan.THRESHOLD):
                    found.add(label)
                    best = max(best, len(own & block) / len(own))
        assert r.labels == ",".join(sorted(found | {x for _, x in places})) and r.score == (1.0 if places else best)
    assert license_scan.scan(none).count() == 0


def test_license_sql_finds_wrapped_notices(spark, tmp_path):
    """Notices wrapped over lines, in and out of a window's reach, by the query and its SQL alike."""
    duckdb = pytest.importorskip("duckdb")
    texts = []
    for label, notice in license_scan.TEMPLATES:
        said = notice.split(" ")
        for width in (20, 60):
            wrapped = textwrap.fill(notice, width)
            texts += [wrapped, f"intro words\n{wrapped}\n\nafter {label}", "\n\n".join(wrapped.split("\n")), "\n".join(f"{line} " + "filler " * 9 for line in wrapped.split("\n")), wrapped + "\n" + "x " * 30 + notice]
        texts += ["\n".join(said), "\n".join(said[1:]), "\n".join(reversed(said)), "word " * 300 + "\n" + textwrap.fill(notice, 30)]
    texts += [None, "", "\n\n", "plain\ntext"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    names = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = con.execute(f"SELECT {', '.join(names[:-1])}, round(score, 9) FROM ({license_scan.SQL})").fetchall()
    got = [(*[r[c] for c in names[:-1]], round(r.score, 9)) for r in license_scan.op6_license_scan(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    by_line = [max((len(set(license_scan.words(line.encode())) & own) / len(own) for line in (t or "").split("\n") for _, x in license_scan.TEMPLATES if (own := set(license_scan.words(x.encode())))), default=0.0) for t in texts]
    assert sum(r[7] >= license_scan.THRESHOLD > c for r, c in zip(sorted(got), by_line, strict=True)) > 10  # hits that no single line makes


def test_license_filters_lose_nothing_and_skip_pairs():
    """Random blocks against full counts; the positional filter lets fewer pairs through to them than prefix and length would."""
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    templates = [(f"t{k}", " ".join(rng.sample(vocabulary, rng.randint(4, 14)))) for k in range(12)]
    df = {w.encode(): rng.randint(1, 900) for w in vocabulary}
    index, counted = license_scan.Index(templates, df, 0.8), []

    class Counted(frozenset):
        def __and__(self, other):
            counted.append(1)
            return frozenset(self) & other

    plain, loose = index.sets, 0
    index.sets = [Counted(x) for x in plain]
    for _ in range(2000):
        block = {w.encode() for w in rng.sample(vocabulary, rng.randint(3, 30))} | ({w.encode() for w in rng.choice(templates)[1].split()[:-1]} if rng.random() < 0.3 else set())
        assert index.matches(block) == [(t, len(own & block) / len(own)) for t, own in enumerate(plain) if len(own & block) >= index.need[t]]
        loose += len({t for w in block for t, _ in index.by_word.get(w, ()) if len(block) >= index.need[t]})  # by prefix and length alone
    assert len(counted) < 0.97 * loose


@pytest.mark.parametrize("opened", [ngram_join.CELL, 7])
def test_ngram_join_counts_every_link(spark, monkeypatch, opened):
    """n_links of near copies, some in a chain, against all pairs; also in cells of few members."""
    monkeypatch.setattr(ngram_join, "CELL", opened)
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(5))
    base, chain, texts = [word() for _ in range(120)], [word() for _ in range(120)], []
    for k in range(30):
        own = list(base)
        own[(7 * k) % 120] = word()
        texts.append(own)
    for k in range(8):  # neighbours of the chain are similar, its ends are not
        chain = chain[3:] + [word() for _ in range(3)]
        texts.append(chain)
    texts += [[word() for _ in range(40)] for _ in range(5)]
    sets = [{" ".join(t[i : i + 5]) for i in range(len(t) - 4)} for t in texts]
    want = [sum(100 * len(a & b) >= 75 * len(a | b) for b in sets) - 1 for a in sets]
    table = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.jaccard_components(table).collect()}
    assert [got[i] for i in range(len(texts))] == want and max(want) == 29


def test_license_notices_over_lines(spark):
    """Templates wrapped at 79 columns, bare and in comments, are found; their words far apart or in two paragraphs are not."""
    rows, want = [], []
    for label, t in license_scan.TEMPLATES:
        if len(t) > 79:
            for mark in ("", "# ", " * "):
                rows.append("a first line\n\n" + "\n".join(mark + x for x in textwrap.wrap(t, 79 - len(mark))) + "\nand more words after it\n")
                want.append(label)
            words = t.split()
            rows.append("\n".join(f"{w} {'x ' * 12}" for w in words))
            rows.append(" ".join(words[: len(words) // 2]) + "\n\n" + " ".join(words[len(words) // 2 :]))
            want += [None, None]
    table = spark.createDataFrame(list(enumerate(rows)), "doc_id bigint, text string")
    got = {r.doc_id: r for r in license_scan.scan(table).collect()}
    for i, label in enumerate(want):
        blocks = [b for b in got[i].blocks if len(license_scan.TEMPLATES[b.template][1]) > 79]
        assert {license_scan.TEMPLATES[b.template][0] for b in blocks} == ({label} if label else set()), (i, rows[i])
        if label:
            assert got[i].score == 1 and label in got[i].labels.split(",") and {b.line for b in blocks} == {2}


def test_bpe(docs, none):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    got = by_id(bpe.encode_decode(docs, path, with_ids=True))
    assert got.keys() == {i for i, *_ in sample()}
    for i, text, *_ in sample():
        ids = t.encode(text or "", add_special_tokens=False).ids
        assert list(got[i].ids) == ids and got[i].decoded == t.decode(ids, skip_special_tokens=False) == (text or "")
    assert bpe.encode_decode(none, path).count() == 0


def test_encoders_agree_with_the_library():
    from tokenizers import Tokenizer

    rng, (byte, word) = random.Random(5), (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
    one, two = Tokenizer.from_file(byte), Tokenizer.from_file(word)
    a, b, c = tokens.ByteLevel(byte), tokens.WordLevel(word), bpe.Bpe(byte)
    parts = ["a", "the", " ", " ", "\n", "\t", "\x85", "\xa0", " ", "　", "'ll", "'", "é", "é", "Σ", "́", "1", "²", "!?", "<|endoftext|>", "<|startoftext|>", "\x1c", "\x00", "日本", "🙂", "İ", "x" * 70, "क़"]
    for _ in range(800):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        want = one.encode(text, add_special_tokens=False).ids
        assert tokens.as_ids(a(text)).tolist() == want == tokens.as_ids(c.encode([text])[0]).tolist()
        assert tokens.as_ids(b(text)).tolist() == two.encode(text, add_special_tokens=False).ids


def test_wavelet_matrix():
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 1000, 5000):
        ids = rng.integers(0, 60, n) * 700
        wave = wavelet.Wavelet.build(ids)
        wave = wavelet.Wavelet.load(n, *wave.dump())
        assert wave.all().tolist() == ids.tolist()
        for i in range(0, n, 97):
            assert wave.access(i) == ids[i] and wave.count(int(ids[i]), i) == int((ids[:i] == ids[i]).sum())
        for t in (0, 700, 4200, 1):
            places = np.flatnonzero(ids == t).tolist()
            assert wave.count(t) == len(places)
            assert [wave.select(t, k) for k in range(min(3, len(places)))] == places[:3] and wave.select(t, len(places)) == -1
            assert wave.places(t).tolist() == places
            assert [int(wave._back(t, np.array([wave.span(t, n)[0] + k]))[0]) for k in range(0, len(places), 7)] == places[::7]
    with pytest.raises(ValueError):
        wavelet.Wavelet.build(np.array([1, 1 << 16]))


def test_token_output(docs, none, spark, tmp_path):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    wavelet.write_shards(docs, path, str(tmp_path / "shards"))
    got = {key(r.doc_id): r for r in wavelet.read_shards(spark, str(tmp_path / "shards")).collect()}
    rows = sorted((key(i), x or "") for i, x, *_ in sample())
    at, every = 0, []
    for i, text in rows:
        ids = [*t.encode(text, add_special_tokens=False).ids, 2]
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32, list(got[i].ids)) == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()), ids)
        at, every = at + len(ids), every + ids
    some = sorted({2, every[-2]})
    found = wavelet.lookup(spark, str(tmp_path / "shards"), some).groupBy("token").sum("n").collect()
    assert dict(map(tuple, found)) == {x: every.count(x) for x in some}
    wavelet.write_shards(none, path, str(tmp_path / "none"))
    assert wavelet.read_shards(spark, str(tmp_path / "none")).count() == 0


def test_toxicity_held_out(docs, none, spark):
    rng = random.Random(2)
    bad = ["idiot", "moron", "scum", "loser"]
    rows = []
    for i in range(600):
        words, toxic = ["".join(rng.choice("abcdefghij") for _ in range(3)) for _ in range(60)], i % 4 == 0
        if toxic:
            for _ in range(4):
                words[rng.randrange(60)] = rng.choice(bad)
        rows.append((i, " ".join(words), int(toxic)))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    chain = toxicity.train(table, table.where("doc_id < 400").select("doc_id", "toxic"))
    held = {r.doc_id: r for r in toxicity.score(table, chain).where("doc_id >= 400").collect()}
    assert sum(held[i].toxic == bool(y) for i, _, y in rows[400:]) >= 0.97 * 200
    assert all(0 <= r.p_low_quality <= 1 for r in held.values())
    assert toxicity.score(docs, chain).count() == len(sample()) and toxicity.score(none, chain).count() == 0
    bare = toxicity.train(docs, spark.createDataFrame([], "doc_id bigint, toxic int"))
    assert not toxicity.score(docs, bare).where("toxic").count()


def test_chain_feeds_out_of_fold_probabilities():
    """The chain against models fitted one by one; a second category that is the first one's copy leans on its probability."""
    rng = np.random.default_rng(6)
    x = (rng.random((300, 6)) < 0.3).astype(float)
    low = (x[:, 0] + x[:, 1] + rng.random(300) > 1.2).astype(int)
    toxic = (low & (rng.random(300) < 0.9)).astype(int)
    folds = np.arange(300) % 5
    chain = toxicity.fit_chain([b"w%d" % k for k in range(6)], ["low_quality", "toxic"], [np.arange(6), np.arange(3)], x, np.stack([low, toxic], 1), folds)
    out = np.zeros(300)
    for k in range(5):
        own = folds == k
        out[own] = toxicity.fit_linear(x[~own], low[~own].astype(float)).probability(x[own])
    second = toxicity.fit_linear(np.concatenate([x[:, :3], out[:, None]], 1), toxic.astype(float))
    split = toxicity.fit_linear(x[:, :3].astype(np.uint8), toxic.astype(float), out[:, None])
    assert np.allclose(split.weights, second.weights)
    assert np.allclose(chain.models[1].weights, second.weights) and abs(second.weights[3]) > 0.1
    p = chain.probabilities(x)
    first = toxicity.fit_linear(x, low.astype(float)).probability(x)
    assert np.allclose(p[:, 0], first) and np.allclose(p[:, 1], second.probability(np.concatenate([x[:, :3], first[:, None]], 1)))


def test_alike_rows_share_a_group():
    assert toxicity.alike([[1, 2, 3, 4], [5, 6, 7, 8], [1, 2, 9, 9], [0, 0, 9, 9], [1, 6, 3, 8]]) == [0, 1, 0, 0, 4]


def test_toxicity_does_not_depend_on_row_order(docs, spark):
    """Ids that repeat with other texts, equal rows and null texts; a second run over the rows in another order gives the same chain."""
    rows = [(i % 40, f"{'vile' if i % 3 == 0 else 'fine'} word{i % 7} text{i % 11} " * 9, int(i % 3 == 0)) for i in range(120)] + [(500, None, 1)]
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    labels = spark.createDataFrame([(i, int(i % 3 == 0), i % 2) for i in range(40)] + [(500, 1, 1), (None, 1, 0)], "doc_id bigint, toxic int, quality int")
    one, two = (toxicity.train(t, labels) for t in (table, table.orderBy(F.desc("text")).repartition(5)))
    assert one.vocabulary == two.vocabulary and all(np.allclose(a.weights, b.weights) for a, b in zip(one.models, two.models, strict=True))
    got = toxicity.score(docs.unionAll(docs), one).collect()
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((round(r.p_low_quality, 9), round(r.p_toxic, 9), r.toxic))
    assert len(got) == 2 * len(sample()) and all(len(v) % 2 == 0 for v in by.values()) and len({v[0] for k, v in by.items() if k in (40, 41, 42)}) == 1


def test_toxicity_of_small_languages(spark):
    """Recall by language on held-out rows; the small languages' toxic words are many forms, each in few rows."""
    rng, rows = random.Random(11), []
    word = lambda letters: "".join(rng.choice(letters) for _ in range(3))
    kinds = {"en": ("abcdefghij", ["vulgar", "wicked"]), "fr": ("klmnoé", [f"réeux{a}{b}" for a in "abcde" for b in "xyz"]), "de": ("pqrsü", [f"achlich{a}{b}" for a in "abcde" for b in "xyz"])}
    for i in range(1600):
        lang, toxic = "en" if i % 4 < 2 else ("fr", "de")[i % 2], i // 4 % 4 == 0
        letters, bad = kinds[lang]
        own = [word(letters) for _ in range(60)]
        if toxic:
            own[10:10] = rng.sample(bad, 2)
        rows.append((i, " ".join(own), int(toxic), lang))
    table = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int, lang string")
    got = {r.doc_id: r.toxic for r in toxicity.score(table, toxicity.train(table, table.where("doc_id < 1000").select("doc_id", "toxic"))).where("doc_id >= 1000").collect()}
    for lang in kinds:
        ids = [i for i, _, toxic, own in rows[1000:] if toxic and own == lang]
        assert sum(got[i] for i in ids) >= 0.9 * len(ids), lang
    clean = [i for i, _, toxic, _ in rows[1000:] if not toxic]
    assert sum(got[i] for i in clean) <= 0.02 * len(clean)


def brute_components(rows):
    sets, parent = {}, {}
    for i, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} if len(words) >= 5 else {tuple(words)} if words else set()
        parent[i] = i

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in itertools.combinations(sets, 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def test_ngram_join(docs, none):
    want = brute_components([(key(i), t) for i, t, *_ in sample()])
    got = {key(r.doc_id): (r.n_shingles, key(r.component_id)) for r in ngram_join.jaccard_components(docs).collect()}
    assert got == want
    assert ngram_join.jaccard_components(none).count() == 0


@pytest.mark.parametrize(("cell", "links_too"), [(ngram_join.CELL, True), (7, True), (7, False)])
def test_ngram_join_chains_and_frequent_passages(spark, monkeypatch, cell, links_too):
    """Chains of edits whose ends are far apart, and many documents that share a passage and nothing else."""
    rng = random.Random(9)
    word = lambda: f"v{rng.randint(0, 5000)}"
    passage, rows = [word() for _ in range(40)], []
    for _ in range(12):
        own = [word() for _ in range(90)]
        for _ in range(12):
            rows.append(" ".join(own))
            own = list(own)
            for _ in range(2):
                own[rng.randrange(90)] = word()
    rows += [" ".join([word() for _ in range(40)] + passage) for _ in range(90)]
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    monkeypatch.setattr(ngram_join, "CELL", cell)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngram_join.jaccard_components(df, links_too=links_too).collect()}
    assert got == brute_components(rows)


def test_repeated_rows_and_clashing_helper_names(docs, spark):
    """Every row twice gives every row's result twice; columns named like the operators' own helpers stay as they are."""
    twice = docs.unionAll(docs)
    path, words = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
    runs = {
        "pack": lambda d: packing.pack(d, words).select("doc_id", "piece", "start", "length", "ids_crc32"),
        "suffix": suffix_dedup.suffix_dedup, "exact": lambda d: exact_dedup.exact_dedup(d).drop("group_size"), "quality": quality_rules.ledger,
        "counts": lambda d: token_counts.count_tokens(d, {"words-1": None}), "license": lambda d: license_scan.scan(d).drop("blocks"),
        "bpe": lambda d: bpe.encode_decode(d, path), "join": ngram_join.jaccard_components,
    }
    for name, run in runs.items():
        one, two = (sorted(map(repr, run(d).collect())) for d in (docs, twice))
        assert two == sorted(one * 2), name
    table = spark.createDataFrame([(1, "a b " * 40, "k1"), (2, "a b " * 40, "k2"), (3, "c d " * 40, "k3")], "doc_id bigint, text string, name string")
    for c in ("row_key", "row_sha", "row_left", "row_cut", "_name"):
        table = table.withColumn(c, F.lit(c))
    for out in (exact_dedup.unique_documents(table), suffix_dedup.remove_repeats(table)):
        assert out.columns == table.columns and all((r.row_key, r.row_sha, r.row_left, r.row_cut, r._name) == ("row_key", "row_sha", "row_left", "row_cut", "_name") and r.name == f"k{r.doc_id}" for r in out.collect())
    assert {r.doc_id for r in exact_dedup.unique_documents(table).collect()} == {1, 3}


def test_repeated_rows_in_shards(docs, spark, tmp_path):
    """Rows that repeat an id are written each: starts follow one another over all rows, ids are read back by row."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    wavelet.write_shards(docs.unionAll(docs), path, str(tmp_path / "shards"))
    rows = sorted(wavelet.read_shards(spark, str(tmp_path / "shards")).collect(), key=lambda r: r.start)
    at = 0
    for r in rows:
        assert r.start == at and len(r.ids) == r.n_tokens and r.ids[-1] == wavelet.END
        at += r.n_tokens
    assert [key(r.doc_id) for r in rows] == sorted(key(r.doc_id) for r in rows) and len(rows) == 2 * len(sample())
    wavelet.write_shards(docs, path, str(tmp_path / "once"))
    once = sorted((key(r.doc_id), tuple(r.ids)) for r in wavelet.read_shards(spark, str(tmp_path / "once")).collect())
    assert sorted((key(r.doc_id), tuple(r.ids)) for r in rows) == sorted(once * 2)


def test_a_text_of_megabytes(spark, tmp_path):
    """One text of 2 MB beside short and null ones, through every operator, against the same by plain means."""
    from tokenizers import Tokenizer

    rng = random.Random(12)
    long = " ".join("".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(330_000))
    table = spark.createDataFrame([(1, long), (2, "short text"), (3, None), (4, long + " and one more word")], "doc_id bigint, text string")
    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = t.encode(long, add_special_tokens=False).ids
    got = by_id(bpe.encode_decode(table, public_tokenizers.path("byte_bpe_50k.json"), with_ids=True))
    assert list(got[1].ids) == ids and got[1].decoded == long
    assert {r.doc_id: r.component_id for r in ngram_join.jaccard_components(table).collect()} == {1: 1, 2: 2, 3: 3, 4: 1}
    assert {r.doc_id: r.n_words for r in quality_rules.ledger(table).collect()} == {1: 330_000, 2: 2, 3: 0, 4: 330_004}
    assert {r.doc_id: r.keep_id for r in exact_dedup.exact_dedup(table).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.n_words for r in license_scan.scan(table).collect()} == {1: 330_000, 2: 2, 3: 0, 4: 330_004}
    packed = packing.pack(table, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert check_places(packed) == packed[0].n_sequences >= packed[0].least_sequences
    cut = by_id(suffix_dedup.suffix_dedup(table))
    assert (cut[1].n_removed, cut[2].n_removed, cut[3].n_removed, cut[4].n_removed, cut[4].n_spans) == (0, 0, 0, len(long), 1)
    assert cut[4].kept_sha256 == hashlib.sha256(b" and one more word").hexdigest()
    counts = {(r.doc_id, r.tokenizer): r.n_tokens for r in token_counts.count_tokens(table.withColumns({"source": F.lit("s"), "lang": F.lit("en")}), {"words-1": None, "bytes": (tokens.ByteLevel, public_tokenizers.path("byte_bpe_50k.json"))}).collect()}
    assert counts[1, "words-1"] == 330_000 and counts[1, "bytes"] == len(ids) and counts[3, "bytes"] == 0
    wavelet.write_shards(table, public_tokenizers.path("byte_bpe_50k.json"), str(tmp_path / "shards"))
    held = by_id(wavelet.read_shards(spark, str(tmp_path / "shards")))
    assert list(held[1].ids) == [*ids, wavelet.END] and list(held[3].ids) == [wavelet.END]
    chain = toxicity.train(table, spark.createDataFrame([(1, 0), (2, 1)], "doc_id bigint, toxic int"))
    assert {r.doc_id for r in toxicity.score(table, chain).collect()} == {1, 2, 3, 4}


def test_latin_words_need_no_pattern(monkeypatch):
    pytest.importorskip("public_tokenizers")
    import public_tokenizers
    from panelmill.llm import tokens as T

    odd = ["Ünïcode's ÿß é.", "a,b don't", "x!? y...", "éá ÀÉ, ÿ;", "\n\nÉ!", " É:a", "ñ\r ñ\t x", "straße, İx ﬁ e\u0301", "ª µ º ×÷", "K' 's's", "A.\nB;\n\nC", "1a a1 é1, 1é", "de\u0301a Åé, Å", "été, été été"]
    for limit in (T.LIMIT, 3, 0):
        monkeypatch.setattr(T, "LIMIT", limit)
        for kind, file in ((T.ByteLevel, "byte_bpe_50k.json"), (T.WordLevel, "word_bpe_49k.json")):
            enc = kind(public_tokenizers.path(file))
            for x in odd + odd:
                assert enc(x) == T.packed(enc.whole.encode(x, add_special_tokens=False).ids), x
    byte, word = T.ByteLevel(public_tokenizers.path("byte_bpe_50k.json")), T.WordLevel(public_tokenizers.path("word_bpe_49k.json"))
    byte.split = word.norm = None  # new words of Latin letters, and marks behind them, don't need them
    assert byte.chunks["Éléoiou"] + byte.chunks["été"] == T.packed(byte.whole.encode(" Éléoiou été", add_special_tokens=False).ids)
    assert word("Éléoiou, été.") == T.packed(word.whole.encode("Éléoiou, été.", add_special_tokens=False).ids)
