"""Importance and hold-out figures of forests where the right numbers follow from the rows."""

import random

import pytest
from pyspark.sql import functions as F

from frameclinic.operators import cleaning, encoding, models
from frameclinic.operators.folds import hash_split


def test_importance_of_a_split_that_settles_everything(spark):
    """One dummy column decides the label, the others have one value after median filling: it gets all importance."""
    rows = [(i, "red" if i % 3 else "blue", None if i % 4 else 5.0, float(i % 3 > 0)) for i in range(120)]
    rows += [(500, "red", 5.0, None)]
    df = spark.createDataFrame(rows, "number long, colour string, size double, y double")
    got = {r.variable: r.importance for r in models.feature_importance(df, "y", ignore=["number"], trees=5).collect()}
    colour = {k: v for k, v in got.items() if k.startswith("colour")}
    assert len(got) == len(colour) + 1 and got["size"] == 0
    assert sum(colour.values()) == pytest.approx(1) and all(v >= 0 for v in colour.values())


def test_importance_follows_the_gain_of_depth_one_splits(spark):
    """The first of three columns agrees with the label in 95 % of rows, the second in 75 %, the third by chance."""
    rng = random.Random(11)
    rows = []
    for _ in range(600):
        y = rng.randrange(2)
        rows.append((*(float(y if rng.random() < p else 1 - y) for p in (0.95, 0.75, 0.5)), float(y)))
    df = spark.createDataFrame(rows, "strong double, weak double, none double, y double")
    got = {r.variable: r.importance for r in models.feature_importance(df, "y", trees=40).collect()}
    assert got["strong"] > got["weak"] > got["none"] >= 0 and sum(got.values()) == pytest.approx(1)


def test_holdout_figures_are_those_of_the_majority_per_category(spark):
    """With one category column a forest says each category's majority, so accuracy and F1 follow from the test rows."""
    rng = random.Random(12)
    rows = []
    for i in range(800):
        kind = rng.choice("abc")
        rows.append((i, kind, float((kind == "b") != (rng.random() < 0.15))))
    rows.append((900, "a", None))
    df = spark.createDataFrame(rows, "number long, kind string, y double")
    got = models.holdout_score(df, "y", "number", trees=15).first()
    held = hash_split(df.dropna(subset=["y"]), "number", 42).where(~F.col("in_training")).collect()
    pairs = [(r.y, float(r.kind == "b")) for r in held]
    f1 = 0.0
    for label in (0.0, 1.0):
        true = sum(y == p == label for y, p in pairs)
        said, are = sum(p == label for _, p in pairs), sum(y == label for y, _ in pairs)
        f1 += are / len(pairs) * (2 * true / (said + are))
    assert got.n_rows == 800 and 100 < len(pairs) < 220
    assert got.accuracy == round(sum(y == p for y, p in pairs) / len(pairs), 4) and got.f1 == round(f1, 4)


def test_tables_without_a_category_column(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None)], "number long, size double")
    assert sorted(map(tuple, encoding.dummies(df).collect())) == [(1, 2.0), (2, None)]
    assert encoding.one_hot_long(df, [], ["number"]).count() == 0
    assert cleaning.value_shares(df, []).count() == 0
