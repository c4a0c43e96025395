"""License scans: an exact containment join of text blocks with license templates, and phrase places.

Every line with a word is a block, as a set of words. So is every window of a paragraph (a run of lines with words) that
is at most a quarter longer than the template, which finds notices that are wrapped over lines. Template words are ordered by their frequency over the whole
corpus, rarest first. A block that holds at least THRESHOLD of a template's words must hold one of the template's
rarest (size - needed + 1) words (prefix filter), have at least the needed number of words (length filter), and at each
shared word of the prefix enough words must be left, in the block as in the template (positional filter). Only such pairs are counted. A
paragraph that fails them holds no window that passes, so windows are looked at only where the paragraph passes.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import column, spread, texts_bytes

# Phrases and their labels.
PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
# Public license texts, one block each.
TEMPLATES = [
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This work is licensed under the GNU General Public License, version 2"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc-by-4.0", "Licensed under CC BY 4.0"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
]
#: A block belongs to a template when it holds this share of the template's distinct words.
THRESHOLD = 0.9
_WORD = re.compile(rb"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_OUT = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, blocks array<struct<line:bigint,template:int,containment:double>>"


def words(raw: bytes) -> list[bytes]:
    """Words of UTF-8 bytes: A-Z lower-cased, letters, digits and everything outside ASCII."""
    return _WORD.findall(raw.lower())


def needed(size: int, threshold: float) -> int:
    return max(1, math.ceil(threshold * size - 1e-9))


def frequencies(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """In how many rows each word of the templates stands. The result has at most as many rows as the templates have words."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count: Counter = Counter()
        for batch in batches:
            for raw in texts_bytes(batch, "text"):
                count.update(vocabulary.intersection(words(raw)))
        if count:
            yield pa.RecordBatch.from_arrays([pa.array(list(count), pa.binary()), pa.array(list(count.values()), pa.int64())], ["word", "n"])

    rows = spread(docs.select(F.col(text_col).alias("text"))).mapInArrow(work, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(w): n for w, n in rows.collect()}


class Index:
    """Templates by their prefix words under a global order of frequency."""

    def __init__(self, templates: list[tuple[str, str]], df: dict[bytes, int], threshold: float):
        self.labels, self.sets, self.need, self.width, self.by_word = [], [], [], [], {}
        every = {w for _, text in templates for w in words(text.encode())}
        self.rank = {w: i for i, w in enumerate(sorted(every, key=lambda w: (df.get(w, 0), w)))}
        for t, (label, text) in enumerate(templates):
            own = sorted(set(words(text.encode())), key=self.rank.__getitem__)
            need = needed(len(own), threshold)
            self.labels.append(label)
            self.sets.append(frozenset(own))
            self.need.append(need)
            self.width.append(5 * len(words(text.encode())) // 4)
            for place, w in enumerate(own[: len(own) - need + 1]):
                self.by_word.setdefault(w, []).append((t, place))
        self.rare = frozenset(self.by_word)

    def matches(self, block: set[bytes]) -> list[tuple[int, float]]:
        """(template, containment) of every template that the block meets.

        The block's words come in the global order, words of no template last. Behind its i-th word stand len(block) - i - 1
        words, so a template whose words, counted up to there, and whose rest and the block's rest, the smaller of both,
        don't add up to the needed number is out (positional filter); what is left is counted in full.
        """
        own = sorted((w for w in block if w in self.rank), key=self.rank.__getitem__)
        shared: dict[int, int] = {}
        for i, w in enumerate(own):
            for t, place in self.by_word.get(w, ()):
                if len(block) < self.need[t] or shared.get(t, 0) < 0:
                    continue
                both = shared.get(t, 0) + 1
                rest = min(len(own) - i - 1, len(self.sets[t]) - place - 1)
                shared[t] = both if both + rest >= self.need[t] else -1
        out = []
        for t, both in shared.items():
            if both > 0 and (n := len(self.sets[t] & block)) >= self.need[t]:
                out.append((t, n / len(self.sets[t])))
        return sorted(out)

    def windows(self, lines: list[tuple[int, list[bytes]]]) -> list[tuple[int, int, float]]:
        """(line, template, containment) of every template that a window of a paragraph's lines meets: the fullest, earliest window."""
        out = []
        for t, _ in self.matches({w for _, own in lines for w in own}):
            wanted, before, at = self.sets[t], 0, []
            for k, own in lines:
                at += [(before + i, k, w) for i, w in enumerate(own) if w in wanted]
                before += len(own)
            held: Counter = Counter()
            a, best, line = 0, 0, 0
            for place, _, w in at:
                held[w] += 1
                while place - at[a][0] >= self.width[t]:
                    held[at[a][2]] -= 1
                    if not held[at[a][2]]:
                        del held[at[a][2]]
                    a += 1
                if len(held) > best:
                    best, line = len(held), at[a][1]
            if best >= self.need[t]:
                out.append((line, t, best / len(wanted)))
        return out


def scan(docs: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: word and phrase counts, labels, score and blocks (line, template, containment).

    n_base counts the places of the PHRASES over all words of a text; first_word and last_word are their smallest and
    largest start, null without any. labels joins base labels and those of matching templates; score is 1 with a base
    place, else the largest containment of a matching block, else 0. blocks holds a window, by the line it begins in, if
    none of its paragraph's lines holds as much of the template. Null and empty texts have no words. Repeated rows
    are scanned each, null ids stay null, an empty table gives no rows, other columns are not read. Templates without words
    match nothing.
    """
    templates = [t for t in templates if words(t[1].encode())]
    df = frequencies(docs, {w for _, t in templates for w in words(t.encode())}, text_col)
    index = Index(templates, df, threshold)
    phrases = [([w.encode() for w in p.split()], p.encode().split()[-1], label) for p, label in PHRASES.items()]

    def one(raw: bytes) -> tuple:
        low, at, places, base, found = raw.lower(), 0, [], set(), []
        every: list[bytes] = []
        paragraph: list[tuple[int, list[bytes]]] = []
        hits, rare = [], False
        for k, line in enumerate([*low.split(b"\n"), b""]):
            own = _WORD.findall(line)
            every += own
            if own:
                paragraph.append((k, own))
                if not index.rare.isdisjoint(own):
                    rare = True
                    hits += [(k, t, c) for t, c in index.matches(set(own))]
            elif paragraph:
                if rare and len(paragraph) > 1:
                    full: dict[int, float] = {}
                    for _, t, c in hits:
                        full[t] = max(c, full.get(t, 0.0))
                    hits += [x for x in index.windows(paragraph) if x[2] > full.get(x[1], 0.0)]
                found += sorted(hits)
                paragraph, hits, rare = [], [], False
        for phrase, last, label in phrases:
            if last in low and phrase[0] in low:
                at, n = 0, len(phrase)
                while True:
                    try:
                        at = every.index(phrase[0], at)
                    except ValueError:
                        break
                    if every[at : at + n] == phrase:
                        places.append(at)
                        base.add(label)
                    at += 1
        labels = base | {index.labels[t] for _, t, _ in found}
        score = 1.0 if places else max((c for _, _, c in found), default=0.0)
        return (len(every), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, [{"line": k, "template": t, "containment": c} for k, t, c in found])

    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("line", pa.int64()), ("template", pa.int32()), ("containment", pa.float64())]))]
    names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "blocks"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [one(raw) for raw in texts_bytes(batch, "text")]
            cols = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id")] + [pa.array(list(c), t) for c, t in zip(cols, kinds, strict=True)], ["doc_id", *names])

    return spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(work, _OUT)


def op6_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents scanned for license phrases and template blocks."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("blocks")


def _sql() -> str:
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    low = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    base = [(p.split(), label) for p, label in PHRASES.items()]
    hit = lambda p: " AND ".join(f"w[i + {k + 1}] = '{x}'" for k, x in enumerate(p))
    cases = " ".join(f"WHEN {hit(p)} THEN '{label}'" for p, label in base)
    rows = ", ".join(f"({i}, '{label}', {5 * len(words(t.encode())) // 4}, {[w.decode() for w in sorted(set(words(t.encode())))]})" for i, (label, t) in enumerate(TEMPLATES))
    return f"""
WITH d AS (SELECT doc_id, {low.format("coalesce(text, '')")} AS t FROM documents),
ws AS (SELECT doc_id, t, regexp_extract_all(t, '{pattern}') AS w FROM d),
pos AS (SELECT doc_id, w, unnest(range(len(w))) AS i FROM ws),
hits AS (SELECT doc_id, i, CASE {cases} END AS label FROM pos),
base AS (SELECT doc_id, count(*) AS n, min(i) AS a, max(i) AS b, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM hits WHERE label IS NOT NULL GROUP BY doc_id),
tmpl AS (SELECT *, ceil({THRESHOLD} * len(tw) - 1e-9) AS need FROM (VALUES {rows}) AS v(template, label, width, tw)),
lines AS (SELECT doc_id, k, regexp_extract_all(l, '{pattern}') AS w FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS k FROM d)),
alone AS (SELECT doc_id, label, len(list_intersect(list_distinct(w), tw)) AS c, tw, need FROM lines, tmpl),
par AS (SELECT doc_id, g, flatten(list(w ORDER BY k)) AS w FROM (SELECT *, count(*) FILTER (len(w) = 0) OVER (PARTITION BY doc_id ORDER BY k) AS g FROM lines) WHERE len(w) > 0 GROUP BY doc_id, g HAVING count(*) > 1),
cand AS (SELECT * FROM par, tmpl WHERE len(list_intersect(list_distinct(w), tw)) >= need),
held AS (SELECT * FROM (SELECT doc_id, g, template, label, width, need, tw, unnest(range(len(w))) AS i, unnest(w) AS x FROM cand) WHERE list_contains(tw, x)),
wins AS (SELECT a.doc_id, a.label, a.tw, a.need, count(DISTINCT b.x) AS c FROM held a JOIN held b ON a.doc_id = b.doc_id AND a.g = b.g AND a.template = b.template AND b.i BETWEEN a.i AND a.i + a.width - 1
         GROUP BY a.doc_id, a.g, a.template, a.i, a.label, a.tw, a.need),
found AS (SELECT doc_id, label, c / len(tw) AS c FROM (SELECT doc_id, label, c, tw, need FROM alone UNION ALL SELECT doc_id, label, c, tw, need FROM wins) WHERE c >= need),
best AS (SELECT doc_id, max(c) AS c FROM found GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels
          FROM (SELECT doc_id, label FROM found UNION ALL SELECT doc_id, label FROM hits WHERE label IS NOT NULL) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_base, CAST(a AS BIGINT) AS first_word, CAST(b AS BIGINT) AS last_word,
       coalesce(base.labels, '') AS base_labels, coalesce(every.labels, '') AS labels, CASE WHEN n > 0 THEN 1.0 ELSE coalesce(c, 0) END::DOUBLE AS score
FROM ws LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


SQL = _sql()
