"""Perceptrons and boosted trees against plain numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameclinic.operators import boosting as B
from frameclinic.operators import perceptron as P

SCHEMA = "model int, features array<double>, label int, digest long"


def rows(spark, n=300, seed=1, partitions=5):
    """Model 0 has four features, one constant and one with few values; model 1 has two; some labels are missing."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        x = [float(v) for v in (rng.normal(), rng.integers(0, 3), 7.0, rng.normal())]
        y = int(x[0] * x[3] + 0.3 * rng.normal() > 0)
        out.append((0, x, None if i % 50 == 0 else y, int(rng.integers(-(2**62), 2**62))))
        out.append((1, x[:2], y, i))
    return out, spark.createDataFrame(out, SCHEMA).repartition(partitions)


def plain(data, model):
    good = [r for r in data if r[0] == model and r[2] is not None]
    return np.array([r[1] for r in good]), np.array([r[2] for r in good], float), np.array([r[3] for r in good])


def test_gradient_is_that_of_the_loss():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(20, 3)), rng.integers(0, 2, 20).astype(float)
    p = P.Perceptron(3, 5, 1)

    def loss(w):
        return P.penalised(*P.gradient_sum(x, y, w, 5), 20, w, 3, 5)[0]

    _, gradient = P.penalised(*P.gradient_sum(x, y, p.weights, 5), 20, p.weights, 3, 5)
    for i in range(len(p.weights)):
        e = np.zeros_like(p.weights)
        e[i] = 1e-6
        assert gradient[i] == pytest.approx((loss(p.weights + e) - loss(p.weights - e)) / 2e-6, abs=1e-6)


@pytest.mark.parametrize("fan_in", [64, 2])
def test_steps_equal_plain_adam(spark, monkeypatch, fan_in):
    """Three epochs over split rows, sums added up by groups of tasks or not, are the steps over the whole table."""
    monkeypatch.setattr(P, "FAN_IN", fan_in)
    data, df = rows(spark)
    found = P.fit_perceptrons(df, {0: 11, 1: 12}, hidden=6, iterations=3)
    for model, width, seed in ((0, 4, 11), (1, 2, 12)):
        x, y, _ = plain(data, model)
        w, mean, square = P.Perceptron(width, 6, seed).weights, 0.0, 0.0
        for t in (1, 2, 3):
            _, g = P.penalised(*P.gradient_sum(x, y, w, 6), len(x), w, width, 6)
            mean, square = 0.9 * mean + 0.1 * g, 0.999 * square + 0.001 * g**2
            w = w - 0.001 * (mean / (1 - 0.9**t)) / (np.sqrt(square / (1 - 0.999**t)) + 1e-8 / np.sqrt(1 - 0.999**t))
        assert found[model].steps == 3
        np.testing.assert_allclose(found[model].weights, w, rtol=1e-9, atol=1e-12)


def test_batches_are_shares_of_the_rows(spark, monkeypatch):
    monkeypatch.setattr(P, "BATCH_ROWS", 100)
    data, df = rows(spark)
    found = P.fit_perceptrons(df, {1: 5}, hidden=4, iterations=2)
    assert set(found) == {1} and found[1].steps == 6  # three batches an epoch
    scored = P.score_perceptrons(df, found)
    assert scored.where("model = 0 and score is null").count() == 300
    assert scored.where("model = 1 and score between 0 and 1").count() == 300


def test_training_stops_where_nothing_is_left_to_learn(spark):
    df = spark.createDataFrame([(0, [0.0], 1, i) for i in range(20)] + [(0, [0.0], 0, i) for i in range(20)], SCHEMA)
    found = P.fit_perceptrons(df, {0: 1}, hidden=2, iterations=500)
    assert P.PATIENCE < found[0].steps < 500
    assert P.fit_perceptrons(df.limit(0), {0: 1}) == {} and B.fit_boosters(df.limit(0), {0: 1}) == {}


def brute_tree(x, y, margin, depth, step, edges):
    """Exact greedy tree over the rows: leaf value of each row."""
    p = 1 / (1 + np.exp(-margin))
    g, h = p - y, p * (1 - p)
    out = np.zeros(len(x))

    def grow(at, left):
        splits = []
        total = g[at].sum() ** 2 / (h[at].sum() + 1.0)
        for f in range(x.shape[1] if left else 0):
            for e in edges[f]:
                low, high = at[x[at, f] <= e], at[x[at, f] > e]
                if min(h[low].sum(), h[high].sum()) < 1.0:
                    continue
                gain = g[low].sum() ** 2 / (h[low].sum() + 1.0) + g[high].sum() ** 2 / (h[high].sum() + 1.0) - total
                splits.append((gain, f, e))
        top = max((s[0] for s in splits), default=0.0)
        best = next((s for s in splits if s[0] >= top * (1 - 1e-9)), None) if top > 1e-9 else None
        if best is None:
            out[at] = -step * g[at].sum() / (h[at].sum() + 1.0)
        else:
            grow(at[x[at, best[1]] <= best[2]], left - 1)
            grow(at[x[at, best[1]] > best[2]], left - 1)

    grow(np.arange(len(x)), depth)
    return out


@pytest.mark.parametrize("fan_in", [64, 1])
def test_trees_equal_greedy_search(spark, monkeypatch, fan_in):
    """All rows, all columns: three rounds of both models are those of an exhaustive search over rows."""
    monkeypatch.setattr(B, "FAN_IN", fan_in)
    monkeypatch.setattr(B, "KEEP_EVERY", 2)
    data, df = rows(spark)
    found = B.fit_boosters(df, {0: 3, 1: 4}, rounds=3, depth=3, step=0.3, row_share=1.0, column_share=1.0)
    scored = {m: B.score_boosters(df.where(F.col("model") == m), found).count() for m in (0, 1)}
    assert scored == {0: 300, 1: 300}
    for model in (0, 1):
        x, y, _ = plain(data, model)
        margin = np.zeros(len(x))
        for _ in range(3):
            margin += brute_tree(x, y, margin, 3, 0.3, found[model].edges)
        np.testing.assert_allclose(found[model].margin(found[model].binned(x)), margin, rtol=1e-9)
        assert max(len(e) for e in found[model].edges) <= B.BINS


def test_drawn_rows_do_not_depend_on_the_split(spark):
    data, one = rows(spark, partitions=1)
    _, many = rows(spark, partitions=7)
    options = dict(rounds=4, depth=2, step=0.3, row_share=0.5, column_share=0.5)
    a, b = (B.fit_boosters(df, {0: 9}, **options)[0] for df in (one, many))
    for s, t in zip(a.trees, b.trees):
        assert (s.feature == t.feature).all() and (s.cut == t.cut).all()
        np.testing.assert_allclose(s.value, t.value, rtol=1e-9)
    assert any((s.feature >= 0).any() for s in a.trees)
    x, y, digest = plain(data, 0)
    drawn = B._uniform(digest, 77) < 0.5
    assert 0.35 < drawn.mean() < 0.65


def test_boosting_learns_an_interaction(spark):
    data, df = rows(spark, n=3000)
    found = B.fit_boosters(df.where("pmod(digest, 3) > 0"), {0: 1}, rounds=25, depth=3, step=0.2)
    scored = B.score_boosters(df.where("model = 0 and label is not null and pmod(digest, 3) = 0"), found).toPandas()
    assert ((scored.score > 0.5) == (scored.label == 1)).mean() > 0.8
