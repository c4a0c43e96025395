"""Boosted trees against all splits tried out, one leaf after another, and their early stop."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelmill.operators import trees as T

COLUMNS = ["a", "b", "c", "d"]


def rows_of(seed, n=160, folds=(1, 2, 3)):
    """Rows of some folds; an eighth of each is held out. b has few values, d is constant."""
    rng = np.random.default_rng(seed)
    out = {}
    for f in folds:
        x = np.stack([rng.normal(size=n), rng.integers(0, 4, n), rng.exponential(size=n), np.ones(n)], 1)
        y = np.where(x[:, 0] > 0.3, 2.0, 0.0) + x[:, 1] * (x[:, 2] > 1) + 0.3 * rng.normal(size=n) + f
        out[f] = x, y, np.arange(n) % 8 == 0
    return out


def frame(spark, data):
    rows = [(f, *map(float, x), float(y), bool(v), i) for f, (xs, ys, vs) in data.items() for i, (x, y, v) in enumerate(zip(xs, ys, vs, strict=True))]
    return spark.createDataFrame(rows, "fold int, a double, b double, c double, d double, y double, valid boolean, key bigint").repartition(5)


def grown(x, g, leaves, least, cuts, allowed=None):
    """Leaves of one tree: lists of tests, with the mean residual. The leaf with the best of all its splits goes first."""
    parts = [(np.ones(len(x), bool), [])]

    def best(rows):
        top, total = (0.0, None, None), g[rows].sum() ** 2 / rows.sum()
        for f in range(x.shape[1]) if allowed is None else np.flatnonzero(allowed):
            for c in cuts[f]:
                low = rows & (x[:, f] <= c)
                high = rows & ~low
                if low.sum() >= least and high.sum() >= least:
                    gain = g[low].sum() ** 2 / low.sum() + g[high].sum() ** 2 / high.sum() - total
                    if gain > top[0] + 1e-9:
                        top = gain, f, c
        return top

    while len(parts) < leaves:
        gains = [best(rows) for rows, _ in parts]
        k = max(range(len(parts)), key=lambda i: gains[i][0])
        if gains[k][1] is None:
            break
        (rows, tests), (_, f, c) = parts.pop(k), gains[k]
        low = x[:, f] <= c
        parts += [(rows & low, [*tests, (f, c, True)]), (rows & ~low, [*tests, (f, c, False)])]
    return [(tests, g[rows].mean()) for rows, tests in parts]


def told(leaves, x, rate):
    out = np.zeros(len(x))
    for tests, mean in leaves:
        at = np.ones(len(x), bool)
        for f, c, low in tests:
            at &= (x[:, f] <= c) == low
        out[at] = -rate * mean
    return out


def boosted(x, y, held, how, cuts):
    """Predictions of the trees up to the lowest held-out error, and how many they are."""
    score = np.full(len(y), y[~held].mean())
    errors, scores = [((score - y)[held] ** 2).mean()], [score]
    for _ in range(how.rounds):
        if len(errors) - 1 - int(np.argmin(errors)) >= how.patience:
            break
        own = grown(x[~held], (score - y)[~held], how.leaves, how.least, cuts)
        score = score + told(own, x, how.rate)
        errors.append(((score - y)[held] ** 2).mean())
        scores.append(score)
    k = int(np.argmin(errors))
    return scores[k], k


def predicted(forest, df, n, folds):
    out = {f: np.full(n, np.nan) for f in folds}
    for r in T.predict_trees(forest, df).collect():
        out[r.fold][r.key] = r.z_hat
    return out


@pytest.mark.parametrize(("how", "refresh", "numbers"), [
    (T.Fit(leaves=6, least=8, rate=0.5, rounds=5, patience=99), 16, 8_000_000),
    (T.Fit(leaves=4, least=3, rate=0.9, rounds=12, patience=2), 2, 1),
    (T.Fit(leaves=2, least=1, rate=0.3, rounds=3, patience=1), 1, 2000),
])
def test_trees_agree_with_all_splits(spark, tmp_path, monkeypatch, how, refresh, numbers):
    """Every distinct value is a bin's edge, so all splits are tried; folds grow side by side or one by one, scores are written anew or not."""
    monkeypatch.setattr(T, "REFRESH", refresh)
    monkeypatch.setattr(T, "NUMBERS", numbers)
    data = rows_of(4)
    df = frame(spark, data)
    everything = np.concatenate([x[~v] for x, _, v in data.values()])
    cuts = [np.unique(everything[:, f])[:-1] for f in range(4)]
    monkeypatch.setattr(T, "edges_of", lambda *_: cuts)
    monkeypatch.setattr(T.Forest, "bins", lambda self, x: np.stack([np.searchsorted(e, x[:, k], "left") for k, e in enumerate(cuts)], 1).astype(np.uint8) if max(map(len, cuts)) < 256 else pytest.fail("too many values"))
    small = {f: (np.round(x, 1), y, v) for f, (x, y, v) in data.items()}  # few enough values for one byte
    cuts[:] = [np.unique(np.concatenate([x[~v][:, k] for x, _, v in small.values()]))[:-1] for k in range(4)]
    df = frame(spark, small)
    forest = T.fit_trees(df, COLUMNS, "y", "valid", str(tmp_path), how)
    got = predicted(forest, df, 160, small)
    for f, (x, y, v) in small.items():
        want, n = boosted(x, y, v, how, cuts)
        assert len(forest.trees[f]) == n and np.allclose(got[f], want, atol=1e-9)
        assert all((t.feature >= 0).sum() <= how.leaves - 1 for t in forest.trees[f])


def test_edges(spark):
    few = spark.createDataFrame([(float(v), 5.0) for v in [3, 1, 2, 2, 1, 9]], "a double, b double")
    assert [list(e) for e in T.edges_of(few, ["a", "b"], 255)] == [[1.0, 2.0, 3.0], []]
    many = spark.range(10_000).select((F.col("id") * 1.0).alias("a"))
    (edges,) = T.edges_of(many, ["a"], 16)
    assert len(edges) == 16 or len(edges) == 15
    counts = np.bincount(np.searchsorted(edges, np.arange(10_000), "left"))
    assert counts.max() <= 10_000 / 16 * 1.25


def test_folds_without_rows_and_constant_targets(spark, tmp_path):
    data = rows_of(1, 40, (1, 2))
    data[2] = data[2][0], np.full(40, 7.0), data[2][2]
    df = frame(spark, data)
    how = T.Fit(leaves=5, least=2, rate=0.5, rounds=4, patience=3)
    forest = T.fit_trees(df.where("fold <> 1 or valid"), COLUMNS, "y", "valid", str(tmp_path), how)
    got = predicted(forest, df, 40, (1, 2))
    assert np.isnan(got[1]).all() and np.allclose(got[2], 7.0) and 1 not in forest.trees
    none = T.fit_trees(df.limit(0), COLUMNS, "y", "valid", str(tmp_path), how)
    assert not none.trees and T.predict_trees(none, df).where("z_hat is not null").count() == 0
    whole = T.fit_trees(df.withColumn("valid", F.lit(False)), COLUMNS, "y", "valid", str(tmp_path), how)
    assert len(whole.trees[1]) == 4  # without held-out rows all rounds count


def test_shares_of_rows_and_features(spark, tmp_path):
    """Shares change the trees, the same each time, and leave the rest of the rows out of the histograms."""
    df = frame(spark, rows_of(2))
    how = T.Fit(leaves=4, least=5, rate=0.5, rounds=6, patience=9, features=0.5, rows=0.6)
    one, two = (predicted(T.fit_trees(df.repartition(k), COLUMNS, "y", "valid", str(tmp_path), how), df, 160, (1, 2, 3)) for k in (3, 6))
    full = predicted(T.fit_trees(df, COLUMNS, "y", "valid", str(tmp_path), T.Fit(leaves=4, least=5, rate=0.5, rounds=6, patience=9)), df, 160, (1, 2, 3))
    assert all(np.allclose(one[f], two[f]) for f in one) and not np.allclose(one[1], full[1])
    assert 0.5 < T._bag(0.6, 0)(np.arange(10_000)).mean() < 0.7
