"""Forests on alike rows against a plain search over single rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameclinic.operators import binned, forest

SCHEMA = "model int, features array<double>, label int, digest long"


def rows(spark, n=400, seed=3, partitions=4):
    """Few kinds of rows, a wide column, labels that depend on two columns and chance; some labels are missing."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = [float(v) for v in (rng.integers(0, 2), rng.integers(0, 6), 1.0, rng.integers(0, 3), rng.integers(0, 2))]
        y = int((x[0] == 1) != (x[1] > 2)) if rng.random() < 0.8 else int(rng.integers(0, 2))
        out.append((i % 2, x, None if i % 40 == 0 else y, int(rng.integers(-(2**62), 2**62))))
    return out, spark.createDataFrame(out, SCHEMA).repartition(partitions)


def plain_tree(x, y, w, sizes, salt, depth, node=0):
    """A function from bins to the share of class 1, found by trying each split over the rows."""
    n, ones = w.sum(), (w * y).sum()
    leaf = ones / max(n, 1)
    best = (1e-9, None, None)
    if 0 < ones < n and depth > 0:
        def bad(at):
            m, k = w[at].sum(), (w * y)[at].sum()
            return k * (m - k) / m
        for f in forest.Histograms(np.array([node]), sizes, salt).columns[0]:
            for cut in range(sizes[f] - 1):
                left = x[:, f] <= cut
                if w[left].sum() and w[~left].sum():
                    won = bad(w >= 0) - bad(left) - bad(~left)
                    if won > best[0] * (1 + 1e-9):
                        best = (won, f, cut)
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    sides = [plain_tree(x[s], y[s], w[s], sizes, salt, depth - 1, 2 * node + i) for s, i in ((left, 1), (~left, 2))]
    if all(isinstance(s, float) for s in sides) and (sides[0] > 0.5) == (sides[1] > 0.5):
        return leaf
    return (best[1], best[2], *sides)


def plain_score(tree, x):
    while not isinstance(tree, float):
        tree = tree[2] if x[tree[0]] <= tree[1] else tree[3]
    return tree


def found(df, **options):
    scored = forest.forest_scores(df, df, {0: 5, 1: 6}, **options)
    return sorted((r.model, -1 if r.label is None else r.label, round(r.score, 9), r.alike) for r in scored.collect())


@pytest.mark.parametrize("most_rows", [1_000_000, 40])
def test_scores_equal_a_plain_search(spark, monkeypatch, most_rows):
    """Whether trees are grown in tasks alone or cut above by all tasks, with rows of several kinds drawn row by row."""
    monkeypatch.setattr(forest, "MOST_ROWS", most_rows)
    monkeypatch.setattr(forest, "TREES_TOGETHER", 3)
    data, df = rows(spark)
    want = {}
    edges = binned.bin_edges(df.where("label is not null"))
    for model, seed in ((0, 5), (1, 6)):
        every = [r for r in data if r[0] == model]
        good = [r for r in every if r[2] is not None]
        x, y = binned.bins_of(np.array([r[1] for r in good]), edges[model]), np.array([r[2] for r in good])
        digests, sizes = np.array([r[3] for r in good]), np.array([len(e) + 1 for e in edges[model]])
        trees = []
        for t in range(7):
            salts = [int(s) for s in np.random.default_rng([seed, t]).integers(2**62, size=2)]
            w = forest.drawn(digests, np.arange(len(digests)), salts[0])
            trees.append(plain_tree(x, y, w, sizes, salts[1], 5))
        for r, b in zip(every, binned.bins_of(np.array([r[1] for r in every]), edges[model])):
            key = (model, -1 if r[2] is None else r[2], tuple(b))
            n, _ = want.get(key, (0, 0))
            want[key] = (n + 1, round(float(np.mean([plain_score(t, b) for t in trees])), 9))
    assert found(df, trees=7, depth=5) == sorted((k[0], k[1], s, n) for k, (n, s) in want.items())


def test_scores_do_not_depend_on_the_split(spark):
    (_, one), (_, many) = rows(spark, partitions=1), rows(spark, partitions=7)
    assert found(one, trees=4) == found(many, trees=4)


def test_alike_rows_are_one(spark):
    """Trainers read as many rows as there are kinds, not as many as the input; no digest gets lost."""
    data, df = rows(spark, n=4000)
    kinds = binned.alike_rows(df, binned.bin_edges(df.where("label is not null")))
    assert kinds.count() < 400 and kinds.select(F.explode("digests")).count() == sum(r[2] is not None for r in data)


def test_rows_without_a_forest_have_no_score(spark):
    _, df = rows(spark, n=40)
    got = forest.forest_scores(df.where("model = 0"), df, {0: 1, 1: 2}, trees=2).groupBy("model").agg(
        F.sum("alike").alias("n"), F.count("score").alias("scored")
    )
    got = {r.model: (r.n, r.scored) for r in got.collect()}
    assert got[0][0] == 20 and got[0][1] > 0 and got[1] == (20, 0)


def test_all_values_of_features_that_have_few(spark):
    """Exactly 128 values are few, whatever an estimate says, and however rare they are; more are cut at quantiles."""
    rng = np.random.default_rng(9)
    few = rng.normal(size=(20, 128))
    wide = rng.normal(size=6000)
    data = [(i % 2, [float(c[i // 2 if i < 256 else 0]) for c in few] + ([float(wide[i])] if i % 2 else []), 0, i) for i in range(6000)]
    edges = binned.bin_edges(spark.createDataFrame(data, SCHEMA).repartition(5))
    assert [len(edges[m]) for m in (0, 1)] == [20, 21]
    for m in (0, 1):
        for found, values in zip(edges[m], few):
            assert found.tolist() == np.unique(values)[:-1].tolist()
    ranks = np.searchsorted(np.sort(wide[1::2]), edges[1][20], "right")
    assert len(ranks) == 255 and np.abs(ranks - np.arange(1, 256) * 3000 / 256).max() <= 3000 / 2560 + 1
