"""Hard negatives against brute force."""

import random
from math import floor, isfinite

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameclinic.llm import hard_negatives as H

SCHEMA = "vec_id long, embedding array<double>, label int, number string, p int, score int"


def brute(rows, positives, negatives, low, high, scale):
    good = [(i, y, [floor(scale * x) for x in v]) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and isfinite(x) for x in v)]
    out = []
    for a, y, u in sorted({(i, y, tuple(v)) for i, y, v in good if i % 10 == 0}):
        scored = sorted((-sum(p * q for p, q in zip(u, v)), i, z) for i, z, v in good if i != a and len(v) == len(u))
        for s, i, _ in [x for x in scored if x[2] == y][:positives]:
            fit = [x for x in scored if x[2] != y and low * -s <= 100 * -x[0] <= high * -s][:negatives]
            out += [(a, i, k + 1, j, -s, -t) for k, (t, j, _) in enumerate(fit)]
    return sorted(out)


def found(spark, rows, **options):
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], SCHEMA)
    got = H.mine_hard_negatives(table, F.col("vec_id") % 10 == 0, **options)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in got.collect())


def vectors(rng, n, d):
    """A few directions, ties, repeated rows, odd rows."""
    centres = [[rng.gauss(0, 1) for _ in range(d)] for _ in range(6)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((i, [x + rng.gauss(0, 0.4) for x in c], rng.randrange(4)))
    rows += [(n + 10 - n % 10, [1.0] * d, 1), (n + 11, [1.0] * d, 1), (n + 12, [1.0] * d, 2), (n + 13, [0.7] * d, 2), (n + 14, [0.7] * d, 3)]
    rows += [rows[10], rows[10], rows[11], (20, [0.5] * d, 2), (30, [0.0] * d, 1), (31, [0.0] * d, 2)]
    rows += [(40, None, 1), (41, [1.0] * d, None), (None, [1.0] * d, 1), (42, [float("nan")] * d, 1), (43, [float("inf")] * d, 1), (44, [None] * d, 1)]
    return rows + [(50, [1.0, 2.0], 1), (51, [1.0, 2.0], 1), (52, [1.0, 1.0], 2), (60, [], 1), (61, [], 1), (62, [], 0)]


@pytest.mark.parametrize("options", [dict(positives=5, negatives=3, low=50, high=95, scale=256.0), dict(positives=2, negatives=4, low=0, high=100, scale=3.0)])
def test_brute_force(spark, options):
    rows = vectors(random.Random(1), 400, 6)
    assert found(spark, rows, **options) == brute(rows, **options)


def test_blocks_of_anchors_and_candidates(spark, monkeypatch):
    options = dict(positives=5, negatives=3, low=50, high=95, scale=256.0)
    monkeypatch.setattr(H, "CANDIDATE_BYTES", 3000)
    monkeypatch.setattr(H, "ANCHOR_BYTES", 500)
    rows = vectors(random.Random(2), 300, 5)
    assert found(spark, rows, **options) == brute(rows, **options)


def test_lists_bound_every_member():
    """No entry scores more than its bound, and a good cluster's walk ends before the list does."""
    rng = np.random.default_rng(0)
    centre = rng.normal(size=16)
    centre /= np.linalg.norm(centre)
    members = centre + rng.normal(size=(20, 16)) * 0.05
    rows = rng.normal(size=(3000, 16)) * rng.uniform(0.1, 2, size=(3000, 1))
    order, bound = H.shared_list(members, centre, rows)
    length = np.linalg.norm(members, axis=1)
    assert sorted(order) == list(range(3000)) and (np.diff(bound) <= 0).all()
    assert (members @ rows[order].T <= length[:, None] * bound[None, :] + 1e-9).all()
    fifth = -np.sort(-(members @ rows.T), axis=1)[:, 4]
    assert (np.searchsorted(-bound, -(fifth / length)) < 1500).all()


def test_scores_beyond_doubles_are_exact():
    a, b = np.array([[2.0**40 + 1, 3.0]]), np.array([[2.0**14 + 1, 1.0], [2.0**60, 0.0]])
    assert H.products(a, b).tolist() == [[(2**40 + 1) * (2**14 + 1) + 3, H.LIMIT]]
    assert H.whole(H.pa.array([[1e308, -0.1]]), 256.0)[0][1] == -26


def test_empty(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert H.mine_hard_negatives(empty, F.col("vec_id") % 10 == 0).count() == 0
    assert found(spark, [(1, [1.0], 1)], positives=5) == [] and found(spark, [(10, [1.0], 1)], positives=5) == []
