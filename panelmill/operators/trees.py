"""Matrices of one row per month and cell for tree models, and boosted trees that grow leaf by leaf from histograms.

Features are binned once, and the rows written as chunks of small integers. A pass over the chunks counts rows and adds
up residuals by leaf, feature and bin where they are; a task sends one number for each of these. Of a split's two sides
only the smaller is counted, the other is what is left of their parent. The leaf with the highest gain splits first. A
pass counts for all leaves that may still split, so a tree takes about as many passes as it is deep, and the folds of a
fit grow side by side in the same passes. What reaches the driver are histograms, NUMBERS of them at most.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from panelmill.operators.ridge import with_last_observation


def tree_rows(targets: DataFrame, local: DataFrame, months: DataFrame, width: int) -> DataFrame:
    """targets with all but the last observation's features: local ones, place, season and month features; missing ones are 0.

    targets: fold, role, ym, month, cell, value, clim, sigma, z; rows without clim are left out. finished() adds the
    observation once a row has its lag.
    """
    angle = 2 * F.lit(3.141592653589793) * F.col("month") / 12
    rows = targets.where("clim is not null").join(local, ["ym", "cell"], "left").join(F.broadcast(months), "ym", "left")  # a row for each month
    rows = rows.withColumns({"lat": F.floor(F.col("cell") / width).cast("double"), "lon": (F.col("cell") % width).cast("double"), "month_sin": F.sin(angle), "month_cos": F.cos(angle), "z": F.coalesce("z", F.lit(0.0))})
    return rows.fillna(0.0, [c for c in (*local.columns, *months.columns) if c not in ("ym", "cell")])


def sampled(rows: DataFrame, n: int, first: int) -> DataFrame:
    """n cells of every fold and month whose lag reaches no further back than the month first, chosen by an arithmetic hash."""
    ok = rows.where(F.col("ym") - F.col("lag") >= first)
    order = (F.col("cell").cast("bigint") * 7919 + F.col("ym").cast("bigint") * 104729) % 65537
    return ok.withColumn("__r", F.row_number().over(W.partitionBy("fold", "ym").orderBy(order, "cell"))).where(F.col("__r") <= n).drop("__r")


def finished(rows: DataFrame, observed: DataFrame, normal: DataFrame) -> DataFrame:
    """rows (with lag) with last_a: the anomaly of the value `lag` months before the target from the fold's climatology; missing ones are 0."""
    out = with_last_observation(rows, observed, F.col("lag"))
    month = ((F.col("ym") - F.col("lag")) % 12 + 1).cast("int")
    own = normal.select("fold", F.col("month").alias("__m"), "cell", F.col("clim").alias("__c"))
    out = out.withColumn("__m", month).join(own, ["fold", "__m", "cell"], "left")
    return out.withColumn("last_a", F.coalesce(F.col("last") - F.col("__c"), F.lit(0.0))).drop("__m", "__c", "last")


#: Histogram entries that a pass sends to the driver at most; more folds than fit into that grow one after the other.
NUMBERS = 8_000_000
#: Rounds after which scores are written anew, so that a pass evaluates no more trees than this.
REFRESH = 16
_CHUNKS = "fold int, valid binary, bins binary, y binary, key binary, score binary"


@dataclass
class Tree:
    """feature is -1 at leaves; rows whose bin is at most cut go left."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray

    def leaf(self, bins: np.ndarray) -> np.ndarray:
        at = np.zeros(len(bins), np.int64)
        while True:
            on = np.flatnonzero(self.feature[at] >= 0)
            if not len(on):
                return at
            node = at[on]
            at[on] = np.where(bins[on, self.feature[node]] <= self.cut[node], self.left[node], self.right[node])

    def predict(self, bins: np.ndarray) -> np.ndarray:
        return self.value[self.leaf(bins)]


@dataclass
class Forest:
    """Trees of each fold, on features binned at edges: bin i holds what is above edge i - 1 and up to edge i."""

    columns: list[str]
    edges: list[np.ndarray]
    start: dict[int, float]
    trees: dict[int, list[Tree]]

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(self.edges)], 1).astype(np.uint8)

    def predict(self, fold: int, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        return sum((t.predict(bins) for t in self.trees.get(fold, [])), np.full(len(x), self.start.get(fold, np.nan)))


class Growth:
    """One tree on its way: histograms of its nodes, and the splits that are counted though not yet taken."""

    def __init__(self, leaves: int, least: int, allowed: np.ndarray):
        self.most, self.least, self.allowed = leaves, least, allowed
        self.feature, self.cut, self.left, self.right = [-1], [0], [0], [0]
        self.sums: list[tuple[np.ndarray, np.ndarray] | None] = [None]
        self.best: list[tuple[float, int, int]] = [(0.0, -1, 0)]
        self.leaves, self.taken = [0], set()

    def judge(self, node: int, n: np.ndarray, s: np.ndarray) -> None:
        """Keep a node's histograms (rows and residuals by feature and bin) and find its best split, the first of equal ones."""
        self.sums[node] = n, s
        total, whole = n[0].sum(), s[0].sum()
        nl, sl = np.cumsum(n, 1), np.cumsum(s, 1)
        nr, sr = total - nl, whole - sl
        ok = (nl >= self.least) & (nr >= self.least) & self.allowed[:, None]
        if not ok.any():
            return
        gain = np.where(ok, sl**2 / np.maximum(nl, 1) + sr**2 / np.maximum(nr, 1) - whole**2 / max(total, 1), -np.inf)
        k = int(gain.argmax())
        f, c = divmod(k, n.shape[1])
        if gain[f, c] > 1e-9 * max(1.0, whole**2 / max(total, 1)):
            self.best[node] = float(gain[f, c]), f, c

    def advance(self) -> list[tuple[int, int, int]]:
        """Take splits, best first, as long as both sides are counted; then (parent, smaller side, other side) of what to count next."""
        while len(self.leaves) < self.most:
            able = sorted((-self.best[v][0], v) for v in self.leaves if self.best[v][0] > 0)
            if not able:
                return []
            node = able[0][1]
            if self.feature[node] < 0:
                return [self._open(v) for _, v in able[: self.most - len(self.leaves)] if self.feature[v] < 0]
            self.leaves.remove(node)
            self.leaves += [self.left[node], self.right[node]]
            self.taken.add(node)
        return []

    def _open(self, node: int) -> tuple[int, int, int]:
        _, f, c = self.best[node]
        low, high = len(self.feature), len(self.feature) + 1
        self.feature[node], self.cut[node], self.left[node], self.right[node] = f, c, low, high
        for own, empty in ((self.feature, -1), (self.cut, 0), (self.left, 0), (self.right, 0), (self.sums, None), (self.best, (0.0, -1, 0))):
            own += [empty, empty]
        n = self.sums[node][0]
        return (node, low, high) if 2 * n[f, : c + 1].sum() <= n[f].sum() else (node, high, low)

    def feed(self, parent: int, counted: int, other: int, n: np.ndarray, s: np.ndarray) -> None:
        whole = self.sums[parent]
        self.judge(counted, n, s)
        self.judge(other, whole[0] - n, whole[1] - s)

    def tree(self, rate: float, all_splits: bool = False) -> Tree:
        """The tree of the splits taken; or with those only counted, to find where rows stand."""
        feature = [f if all_splits or v in self.taken else -1 for v, f in enumerate(self.feature)]
        value = [0.0 if x is None or not (total := x[0][0].sum()) else -rate * x[1][0].sum() / total for x in self.sums]
        return Tree(*(np.array(a) for a in (feature, self.cut, self.left, self.right, value)))


@dataclass
class Fit:
    """How trees grow: leaves of a tree at most, rows of a leaf at least, step, rounds at most, rounds without a better score on the held-out rows, bins, and shares of features (by round) and rows (anew every fifth round)."""

    leaves: int = 63
    least: int = 200
    rate: float = 0.05
    rounds: int = 2000
    patience: int = 80
    bins: int = 255
    features: float = 1.0
    rows: float = 1.0


def _hash(x: np.ndarray, salt: int) -> np.ndarray:
    """Numbers from 0 to 1 by an arithmetic hash."""
    with np.errstate(over="ignore"):
        h = (x.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(11)) / float(1 << 53)


def edges_of(rows: DataFrame, columns: Sequence[str], bins: int) -> list[np.ndarray]:
    """Up to bins - 1 quantiles of each column over all rows (to a tenth of a bin's share in rank), the largest value left out: every distinct value's, if they are few."""
    found = rows.approxQuantile(list(columns), [k / bins for k in range(bins + 1)], 0.1 / bins)
    return [np.unique(np.array(q, float))[:-1] for q in found]


def chunks(rows: DataFrame, forest: Forest, target: str, valid: str, key: str) -> DataFrame:
    """rows as binned chunks, one for each fold of an Arrow batch."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            own = {c: np.asarray(batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)) for c in batch.schema.names}
            bins = forest.bins(np.stack([own[f"x{k}"].astype(float) for k in range(len(forest.columns))], 1))
            for fold in np.unique(own["fold"]):
                at = own["fold"] == fold
                row = [int(fold), own["valid"][at].astype(np.uint8).tobytes(), bins[at].tobytes(), own["y"][at].astype(float).tobytes(), own["key"][at].astype(np.int64).tobytes(), np.zeros(at.sum()).tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32() if k == 0 else pa.binary()) for k, v in enumerate(row)], [c.split()[0] for c in _CHUNKS.split(", ")])

    sent = rows.select("fold", F.col(valid).alias("valid"), F.col(target).cast("double").alias("y"), F.col(key).cast("bigint").alias("key"), *[F.col(c).cast("double").alias(f"x{k}") for k, c in enumerate(forest.columns)])
    return sent.mapInArrow(work, _CHUNKS)


def _opened(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[dict, int, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1).to_pylist()[0]
            yield row, row["fold"], np.frombuffer(row["valid"], bool), np.frombuffer(row["bins"], np.uint8).reshape(-1, width), np.frombuffer(row["y"]), np.frombuffer(row["key"], np.int64), np.frombuffer(row["score"])


def _passes(data: DataFrame, width: int, bins: int, late: dict[int, list[Tree]], growing: dict[int, Tree], wanted: dict[int, list[int]], bag: Callable, validate: bool) -> dict[tuple[int, int], tuple[np.ndarray, np.ndarray]]:
    """Rows and residuals by feature and bin of the wanted nodes of each fold, and under node -1 the number of held-out rows and their squared errors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int, int], tuple[np.ndarray, np.ndarray]] = {}
        for _, fold, valid, binned, y, key, score in _opened(batches, width):
            if fold not in wanted:
                continue
            left = score + sum((t.predict(binned) for t in late.get(fold, [])), np.zeros(len(y))) - y
            if validate:
                n, s = held.setdefault((fold, -1), (np.zeros(1), np.zeros(1)))
                n += valid.sum()
                s += (left[valid] ** 2).sum()
            at = growing[fold].leaf(binned)
            at[valid | ~bag(key)] = -2
            for node in wanted[fold]:
                own = np.flatnonzero(at == node)
                n, s = held.setdefault((fold, node), (np.zeros(width * bins), np.zeros(width * bins)))
                slot = (binned[own].astype(np.int64) + np.arange(width) * bins).ravel()
                n += np.bincount(slot, minlength=width * bins)
                s += np.bincount(slot, np.repeat(left[own], width), width * bins)
        for (fold, node), (n, s) in held.items():
            some = np.flatnonzero(n)
            cols = [pa.array(np.full(len(some), fold, np.int32)), pa.array(np.full(len(some), node, np.int32)), pa.array(some.astype(np.int32)), pa.array(n[some]), pa.array(s[some])]
            yield pa.RecordBatch.from_arrays(cols, ["fold", "node", "slot", "n", "s"])

    sums = data.mapInArrow(work, "fold int, node int, slot int, n double, s double").groupBy("fold", "node", "slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).toArrow()
    fold, node, slot, n, s = (sums.column(c).to_numpy() for c in ("fold", "node", "slot", "n", "s"))
    out = {}
    for f, nodes in wanted.items():
        for v in [*nodes, *([-1] if validate else [])]:
            at = (fold == f) & (node == v)
            both = np.zeros((2, 1 if v == -1 else width * bins))
            both[0, slot[at]], both[1, slot[at]] = n[at], s[at]
            out[f, v] = (both[0], both[1]) if v == -1 else (both[0].reshape(width, bins), both[1].reshape(width, bins))
    return out


def fit_trees(rows: DataFrame, columns: Sequence[str], target: str, valid: str, folder: str, how: Fit | None = None, key: str = "key") -> Forest:
    """Boosted trees of every fold of rows (fold, columns, target, the boolean valid, a whole number key).

    Rows with valid are held out: rounds end once `patience` of them haven't lowered their error, and the trees up to the
    lowest one stay. Without such rows all rounds count. A fold without other rows has no trees. folder: where binned rows
    and scores are kept meanwhile, in the shared file system.
    """
    how, spark = how or Fit(), rows.sparkSession
    forest = Forest(list(columns), edges_of(rows.where(~F.col(valid)), columns, how.bins), {}, {})
    width, bins = len(columns), max([len(e) for e in forest.edges], default=0) + 1
    path = f"{folder}/{uuid.uuid4().hex}"
    chunks(rows, forest, target, valid, key).write.parquet(f"{path}-0")
    data, written = spark.read.schema(_CHUNKS).parquet(f"{path}-0"), 1
    means = rows.where(~F.col(valid)).groupBy("fold").agg(F.avg(target).alias("m")).collect()  # a row for each fold
    forest.start = {r.fold: r.m for r in means}
    forest.trees = {f: [] for f in forest.start}
    together = max(1, NUMBERS // max(1, how.leaves * width * bins))
    folds = sorted(forest.start)
    for k in range(0, len(folds), together):
        group = folds[k : k + together]
        active, lowest = set(group), dict.fromkeys(group, (np.inf, 0))
        late = {f: [_constant(forest.start[f])] for f in group}
        own = data.where(F.col("fold").isin(*group))
        for r in range(how.rounds + 1):
            chosen = np.argsort(_hash(np.arange(width) + r * width, 1), kind="stable")[: max(1, int(np.ceil(how.features * width)))]
            allowed = np.isin(np.arange(width), chosen)
            grown = {f: Growth(how.leaves, how.least, allowed) for f in active}
            bag = _bag(how.rows, r // 5)
            got = _passes(own, width, bins, late, {f: g.tree(0.0) for f, g in grown.items()}, {f: [0] for f in active}, bag, True)
            for f in sorted(active):
                n, e = got[f, -1]
                if n[0] and e[0] / n[0] < lowest[f][0]:
                    lowest[f] = e[0] / n[0], r
                if r == how.rounds or n[0] and r - lowest[f][1] >= how.patience:
                    active.remove(f)
                    if n[0]:
                        del forest.trees[f][lowest[f][1] :]
                else:
                    grown[f].judge(0, *got[f, 0])
            if not active:
                break
            grown = {f: grown[f] for f in active}
            while asked := {f: more for f, g in grown.items() if (more := g.advance())}:
                got = _passes(own, width, bins, late, {f: grown[f].tree(0.0, True) for f in asked}, {f: [c for _, c, _ in more] for f, more in asked.items()}, bag, False)
                for f, more in asked.items():
                    for parent, counted, other in more:
                        grown[f].feed(parent, counted, other, *got[f, counted])
            for f, g in grown.items():
                tree = g.tree(how.rate)
                forest.trees[f].append(tree)
                late[f].append(tree)
            if r % REFRESH == REFRESH - 1:
                _scored(own, width, late).write.parquet(f"{path}-{written}")
                own, late, written = spark.read.schema(_CHUNKS).parquet(f"{path}-{written}"), {f: [] for f in group}, written + 1
    return forest


def _constant(value: float) -> Tree:
    return Tree(np.array([-1]), np.zeros(1, int), np.zeros(1, int), np.zeros(1, int), np.array([value]))


def _bag(share: float, salt: int) -> Callable[[np.ndarray], np.ndarray]:
    return lambda key: _hash(key, salt + 2) < share if share < 1 else np.ones(len(key), bool)


def _scored(data: DataFrame, width: int, late: dict[int, list[Tree]]) -> DataFrame:
    """Chunks whose scores have the late trees added."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row, fold, _, binned, y, _, score in _opened(batches, width):
            row["score"] = (score + sum((t.predict(binned) for t in late.get(fold, [])), np.zeros(len(y)))).tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([row[c.split()[0]]], pa.int32() if c.endswith("int") else pa.binary()) for c in _CHUNKS.split(", ")], [c.split()[0] for c in _CHUNKS.split(", ")])

    return data.mapInArrow(work, _CHUNKS)


def predict_trees(forest: Forest, rows: DataFrame, to: str = "z_hat") -> DataFrame:
    """rows with the prediction of their fold's trees; null for a fold that has none."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            get = lambda c: batch.column(batch.schema.get_field_index(c)).to_numpy(zero_copy_only=False)  # noqa: B023, E731
            fold, out = get("fold"), np.full(batch.num_rows, np.nan)
            x = np.stack([get(c).astype(float) for c in forest.columns], 1) if batch.num_rows else np.zeros((0, len(forest.columns)))
            for f in np.unique(fold):
                at = fold == f
                out[at] = forest.predict(int(f), x[at])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, from_pandas=True)], [*batch.schema.names, to])

    return rows.mapInArrow(work, StructType([*rows.schema.fields, StructField(to, DoubleType())]))
