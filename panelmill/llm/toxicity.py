"""Toxicity by a classifier chain: linear models in sequence, later ones fed with earlier categories' probabilities.

The chain is fitted on a bounded sample of labelled rows: low_quality first, then toxic, which sees its probability.
Which words it may use comes from counts over that sample by Spark. While the chain is fitted, the earlier category's
probabilities that the later model sees are out-of-fold, so no row is judged by a model that was trained on it or on a
row that looks like it. Scoring is one pass over whole texts, without a shuffle.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelmill.llm.common import column, materialize, small, spread, texts_bytes

#: Labelled rows that a model is fitted on at most, the only bound of the sample. They and their words are fitted on the driver.
FIT_ROWS = 4_000
#: Rows whose products are summed at once while a model is fitted.
ROWS = 2048
#: Rows that a word must stand in at least, and the least association with a label (in standard errors of the share of
#: labelled rows); rows that look alike count once for this. Words below it tell no more than chance.
LEAST_ROWS, LEAST_Z = 5, 5.0
#: Rows that share two of SKETCH smallest hashes of their five-word shingles (the first two or the last two) look alike and stay in one fold.
FOLDS, RIDGE, STEPS, SKETCH = 5, 0.05, 30, 4
#: The chain's order; the verdict is the last one's.
CATEGORIES = ("low_quality", "toxic")
#: Words of more bytes also count by their first STEM, so that forms too rare to be chosen by themselves add up.
STEM = 4
CUT = 0.5
_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def stems(own: set[bytes]) -> set[bytes]:
    """Words and the stems of the longer ones; a stem ends with *, which no word holds."""
    return own | {w[:STEM] + b"*" for w in own if len(w) > STEM}


def words(raw: bytes) -> set[bytes]:
    """Distinct words of UTF-8 bytes (letters and everything outside ASCII, A-Z lower-cased) and their stems."""
    return stems(set(_WORD.findall(raw.lower())))


@dataclass
class Linear:
    """A logistic model with an intercept over words and, behind them, other columns."""

    weights: np.ndarray
    bias: float

    def probability(self, x: np.ndarray, more: np.ndarray | None = None) -> np.ndarray:
        at = x @ self.weights[: x.shape[1]] + self.bias
        return 1 / (1 + np.exp(-np.clip(at if more is None else at + more @ self.weights[x.shape[1] :], -30, 30)))


def fit_linear(x: np.ndarray, y: np.ndarray, more: np.ndarray | None = None, ridge: float = RIDGE, steps: int = STEPS) -> Linear:
    """Newton steps on the ridge-penalised logistic loss; the intercept is not penalised. Without both classes: a constant.

    x holds few values and may be of a short type; products are summed over ROWS rows at a time.
    """
    more = np.zeros((len(x), 0)) if more is None else more
    n, k = len(x), x.shape[1] + more.shape[1]
    if not n or y.min() == y.max():
        rate = (y.sum() + 0.5) / (n + 2)
        return Linear(np.zeros(k), float(np.log(rate / (1 - rate))))
    w, penalty = np.zeros(k + 1), np.full(k + 1, ridge)
    penalty[-1] = 1e-9

    def blocks() -> Iterator[tuple[slice, np.ndarray]]:
        for a in range(0, n, ROWS):
            own = slice(a, min(n, a + ROWS))
            yield own, np.concatenate([x[own].astype(float), more[own], np.ones((own.stop - a, 1))], 1)

    margin = lambda w: np.concatenate([own @ w for _, own in blocks()])
    loss = lambda w, at: np.logaddexp(0, (1 - 2 * y) * at).sum() + 0.5 * (penalty * w * w).sum()
    reach = margin(w)
    at = loss(w, reach)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(reach, -30, 30)))
        gram, slope = np.diag(penalty), penalty * w
        for rows, own in blocks():
            gram = gram + (own * (p[rows] * (1 - p[rows]))[:, None]).T @ own
            slope = slope + own.T @ (p[rows] - y[rows])
        step = np.linalg.solve(gram, slope)
        along, size = margin(step), 1.0
        while size > 1e-4 and loss(w - size * step, reach - size * along) > at:
            size /= 2
        w, reach, was = w - size * step, reach - size * along, at
        at = loss(w, reach)
        if abs(was - at) < 1e-7 * (1 + abs(at)):
            break
    return Linear(w[:-1], float(w[-1]))


@dataclass
class Chain:
    """Categories in order, each with a model over its words (columns: their places in the vocabulary) and the earlier categories' probabilities."""

    vocabulary: list[bytes]
    categories: list[str]
    models: list[Linear]
    columns: list[np.ndarray]

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros((len(x), 0))
        for m, own in zip(self.models, self.columns, strict=True):
            out = np.concatenate([out, m.probability(x[:, own], out)[:, None]], 1)
        return out

    def features(self, texts: list[set[bytes]]) -> np.ndarray:
        place = {w: i for i, w in enumerate(self.vocabulary)}
        x = np.zeros((len(texts), len(place)), np.uint8)
        for r, own in enumerate(texts):
            x[r, [place[w] for w in own & place.keys()]] = 1
        return x


def fit_chain(vocabulary: list[bytes], categories: list[str], columns: list[np.ndarray], x: np.ndarray, labels: np.ndarray, folds: np.ndarray) -> Chain:
    """x: a column for each word. labels: a column for each category. folds: each row's fold; copies of a text must share one."""
    models, earlier = [], np.zeros((len(x), 0))
    for c in range(len(categories)):
        y, seen = labels[:, c].astype(float), x[:, columns[c]]
        models.append(fit_linear(seen, y, earlier))
        if c + 1 < len(categories):
            out = np.zeros(len(y))
            for k in np.unique(folds):
                own = folds == k
                out[own] = fit_linear(seen[~own], y[~own], earlier[~own]).probability(seen[own], earlier[own])
            earlier = np.concatenate([earlier, out[:, None]], 1)
    return Chain(vocabulary, categories, models, columns)


def _vocabularies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct words and stems of each text, and its smallest shingle hashes, which copies and most near copies share."""
    for batch in batches:
        found = [_WORD.findall(r.lower()) for r in texts_bytes(batch, "text")]
        sketches = []
        for own in found:
            h = {zlib.crc32(b" ".join(own[i : i + 5])) for i in range(max(1, len(own) - 4))}
            sketches.append([min((x * (2 * k + 0x9E3779B1) + k) & 0xFFFFFFFF for x in h) for k in range(SKETCH)])
        cols = [*[column(batch, c) for c in ("row_key", *CATEGORIES)], pa.array(sketches, pa.list_(pa.int64())), pa.array([sorted(stems(set(own))) for own in found], pa.list_(pa.binary()))]
        yield pa.RecordBatch.from_arrays(cols, ["row_key", *CATEGORIES, "sketch", "words"])


def alike(rows: list) -> list[int]:
    """The group of each row (by its place): rows that share a pair of hashes of their sketches, directly or through others."""
    parent, seen = list(range(len(rows))), {}

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, sketch in enumerate(rows):
        for k in range(0, len(sketch), 2):
            a, b = root(seen.setdefault((k, *sketch[k : k + 2]), i)), root(i)
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(len(rows))]


def train(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Chain:
    """A chain of CATEGORIES from at most `rows` different labelled texts, the first by a hash of their id.

    Rows without a toxicity label or a text are left out; a missing quality counts as good. Of labels that repeat an id the
    largest toxicity and least quality count. Texts that share an id are rows of their own, equal ones are one, so the
    order of rows doesn't matter. What comes to the driver is bounded: `rows` rows, and the words that tell.
    """
    labels = labels if "quality" in labels.columns else labels.withColumn("quality", F.lit(1))
    known = labels.where("toxic is not null and doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.min("quality"), F.lit(1)) == 0).cast("int").alias("low_quality"), F.max("toxic").cast("int").alias("toxic"))
    ids = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    sample = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").where("text is not null").join(F.broadcast(ids), "doc_id")  # `rows` ids at most
    key = F.concat_ws(":", F.hex(F.xxhash64("doc_id")), F.col("doc_id").cast("string"), F.sha2("text", 256))
    sample = sample.select(key.alias("row_key"), *CATEGORIES, "text").dropDuplicates(["row_key"]).orderBy("row_key").limit(rows)
    each = materialize(sample.mapInArrow(_vocabularies, "row_key string, low_quality int, toxic int, sketch array<bigint>, words array<binary>"), "each")
    sketches = each.select("row_key", "sketch").orderBy("row_key").collect()  # `rows` rows of SKETCH numbers
    groups = [(r.row_key, g) for r, g in zip(sketches, alike([r.sketch for r in sketches]), strict=True)]
    fold = docs.sparkSession.createDataFrame(groups, "row_key string, `group` bigint")
    sample = materialize(each.drop("sketch").join(F.broadcast(fold), "row_key"), "sample")  # `rows` rows at most
    n, *hits = sample.groupBy("group").agg(*[F.max(c).alias(c) for c in CATEGORIES]).agg(F.count("*"), *[F.coalesce(F.sum(c), F.lit(0)) for c in CATEGORIES]).first()
    words_of = sample.select("group", *CATEGORIES, F.explode("words").alias("word")).groupBy("group", "word").agg(*[F.max(c).alias(c) for c in CATEGORIES])
    counts = words_of.groupBy("word").agg(F.count("*").alias("df"), *[F.sum(c).alias(c) for c in CATEGORIES]).where(F.col("df") >= LEAST_ROWS)
    tells = []
    for c, hit in zip(CATEGORIES, hits, strict=True):
        rate = min(max(hit / max(n, 1), 1e-6), 1 - 1e-6)
        tells.append((F.abs((F.col(c) - F.col("df") * rate) / F.sqrt(F.col("df") * rate * (1 - rate))) >= LEAST_Z).alias(c))
    telling = materialize(counts.select("word", *tells).where(" or ".join(CATEGORIES)), "telling")
    chosen = sorted(telling.collect(), key=lambda r: bytes(r.word))  # words of `rows` rows, five rows a word at least
    vocabulary, columns = [bytes(r.word) for r in chosen], [np.array([k for k, r in enumerate(chosen) if r[c]], int) for c in CATEGORIES]
    held = sample.select("row_key", F.explode("words").alias("word")).join(small(telling.select("word")), "word").groupBy("row_key").agg(F.collect_list("word").alias("words"))
    got = sample.select("row_key", *CATEGORIES, "group").join(held, "row_key", "left").orderBy("row_key").collect()  # `rows` rows of words that tell
    y = np.array([[r[c] for c in CATEGORIES] for r in got], int).reshape(-1, len(CATEGORIES))
    x = Chain(vocabulary, [], [], []).features([{bytes(w) for w in r.words or ()} for r in got])
    return fit_chain(vocabulary, list(CATEGORIES), columns, x, y, np.array([r.group % FOLDS for r in got], int))


def score(docs: DataFrame, chain: Chain, cut: float = CUT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, p_<category> for each category, and toxic: whether the last category's probability reaches cut.

    One row per row of docs, repeated rows too. Null and empty texts have no words and get the probabilities of that; null
    ids stay null; an empty table gives no rows; other columns are not read.
    """
    place = {w: i for i, w in enumerate(chain.vocabulary)}
    names = [f"p_{c}" for c in chain.categories]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [[place[w] for w in words(raw) & place.keys()] for raw in texts_bytes(batch, "text")]
            p = np.zeros((len(found), len(names)))
            for a in range(0, len(found), 1024):
                x = np.zeros((len(found[a : a + 1024]), len(place)))
                for r, own in enumerate(found[a : a + 1024]):
                    x[r, own] = 1
                p[a : a + 1024] = chain.probabilities(x)
            yield pa.RecordBatch.from_arrays([column(batch, "doc_id"), *[pa.array(p[:, k]) for k in range(len(names))], pa.array(p[:, -1] >= cut)], ["doc_id", *names, "toxic"])

    schema = "doc_id bigint, " + ", ".join(f"{n} double" for n in names) + ", toxic boolean"
    return spread(docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))).mapInArrow(work, schema)


def op9_toxicity(spark, sf_dir: str) -> DataFrame:
    """Every document's category probabilities and verdict, by a chain fitted on the labelled documents' sample."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
