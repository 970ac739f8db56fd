import numpy as np
import pandas as pd
import pytest

from frameclinic.operators.quantiles import exact_quantiles, narrowed_quantiles

PROBS = [0.0, 0.1, 0.25, 0.5, 0.75, 0.99, 1.0]


def columns(n=6000, seed=5):
    rng = np.random.default_rng(seed)
    third_same = rng.normal(0, 1, n)
    third_same[: n // 3] = 0.25
    heavy = rng.lognormal(0, 4, n) * rng.choice([-1, 1], n)
    missing = rng.normal(0, 1, n)
    missing[: n // 2] = np.nan
    return pd.DataFrame(
        {"g": rng.integers(0, 2, n), "third_same": third_same, "heavy": heavy, "missing": missing, "few": rng.integers(0, 3, n) * 1.0}
    )


@pytest.mark.parametrize("steps", [20, 100])
def test_narrowed_equals_numpy(spark, steps):
    frame = columns()
    df = spark.createDataFrame(frame).selectExpr("g", *[f"nanvl({c}, null) as {c}" for c in frame.columns[1:]])
    names = ["third_same", "heavy", "missing", "few"]
    found = narrowed_quantiles(df, names, PROBS, ["g"], values_per_task=60, sketch_steps=steps)
    for g, part in frame.groupby("g"):
        for c in names:
            np.testing.assert_array_equal(found[(g, c)], np.quantile(part[c].dropna(), PROBS))


def test_both_ways_agree(spark):
    df = spark.createDataFrame(columns()).select("g", "third_same", "heavy")

    def rows(room):
        table = exact_quantiles(df, ["third_same", "heavy"], PROBS, ["g"], room)
        return {(r["g"], r["column"]): list(r["quantiles"]) for r in table.collect()}

    near, far = rows(1_000_000), rows(100)
    assert near.keys() == far.keys()
    assert near == far  # to the last digit


def test_groups_without_numbers(spark):
    df = spark.createDataFrame([(1, "2.5"), (1, "x"), (2, None), (None, "7"), (None, "9")], "g int, v string")
    for room in (1_000_000, 1):
        found = {r["g"]: list(r["quantiles"]) for r in exact_quantiles(df, ["v"], [0.0, 0.5], ["g"], room).collect()}
        assert found == {1: [2.5, 2.5], 2: [None, None], None: [7.0, 8.0]}
