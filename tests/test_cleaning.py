"""Recipes against a direct pandas computation on a small damaged table."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameclinic.operators.cleaning import MAX_CATEGORIES, fit_cleaning, value_shares
from frameclinic.operators.summary import boxplot_stats
from frameclinic.plans.repair import repair
from frameclinic.specs import RECIPES, recipe


def small_frame(n=400, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(10, 2, n)
    x[rng.choice(n, 25, replace=False)] *= 50
    x[rng.choice(n, 60, replace=False)] = np.nan
    few = rng.integers(0, 4, n).astype(float)
    few[:3] = 900.0
    kind = rng.choice(["a", "b", "c", "rare"], n, p=[0.5, 0.3, 0.18, 0.02]).astype(object)
    kind[rng.choice(n, 50, replace=False)] = None
    every = np.array([f"v{i % 40}" for i in range(n)], dtype=object)
    return pd.DataFrame({"x": x, "few": few, "kind": kind, "every": every, "y": rng.integers(0, 2, n)})


def expected(df, method):
    r, out = recipe(method), {}
    for c in ("x", "few"):
        v = df[c].copy()
        if r.remove and v.nunique() >= 10:
            q1, q3 = v.quantile(0.25), v.quantile(0.75)
            if q3 != q1:
                v[(v < q1 - 3 * (q3 - q1)) | (v > q3 + 3 * (q3 - q1))] = np.nan
        v = v.fillna(v.median() if r.fill else -999.0)
        if r.norm:
            v = (v - v.mean()) / (v.std(ddof=0) or 1.0)
        out[f"num__{c}"] = v
    for c in ("kind", "every"):
        v = df[c].copy()
        share = v.value_counts(normalize=True)
        valid = set(share[share >= 0.05].index)
        if r.remove and valid:
            v[v.notna() & ~v.isin(valid)] = None
        v = v.fillna(sorted(v.dropna().mode())[0] if r.fill else "MISSING")
        for value in sorted(v.unique()):
            out[f"cat__{c}_{value}"] = (v == value).astype(float)
    return pd.DataFrame(out)


@pytest.mark.parametrize("method", sorted(RECIPES))
def test_recipe(spark, method):
    frame = small_frame()
    found = repair(spark.createDataFrame(frame).coalesce(1), "y", method).toPandas()
    want = expected(frame, method)
    assert list(found.columns) == [*want.columns, "y"]
    np.testing.assert_allclose(found[want.columns].to_numpy(float), want.to_numpy(float), rtol=1e-9, atol=1e-9)
    assert found.shape[0] == len(frame)
    assert not found.isna().any().any()


def test_recipe_with_little_room_per_task(spark):
    """Narrowing instead of in-task percentiles gives the same matrix."""
    frame = small_frame()
    df = spark.createDataFrame(frame).coalesce(1)
    wide = repair(df, "y", "all").toPandas()
    narrow = repair(df, "y", "all", values_per_task=40).toPandas()
    np.testing.assert_allclose(wide.to_numpy(float), narrow.to_numpy(float), rtol=1e-12, atol=1e-12)


def test_keys_fit_each_group_alone(spark):
    a, b = small_frame(seed=1), small_frame(seed=2)
    df = spark.createDataFrame(pd.concat([a.assign(g=1), b.assign(g=2)], ignore_index=True))
    numeric, categorical = ["x", "few"], ["kind", "every"]
    fitted = fit_cleaning(df, numeric, categorical, keys=["g"])
    for g, frame in ((1, a), (2, b)):
        alone = fit_cleaning(spark.createDataFrame(frame), numeric, categorical)
        for c in numeric:
            one, many = alone.numeric_stats[()][c], fitted.numeric_stats[(g,)][c]
            assert one.lower == many.lower and one.upper == many.upper and one.median == many.median
            assert one.mean == pytest.approx(many.mean) and one.kept_var == pytest.approx(many.kept_var)
        assert alone.category_stats[()] == fitted.category_stats[(g,)]


def test_cell_equal_to_a_bound_stays(spark):
    """Quartiles 0.0 and 3.75: the upper bound is 15.0 and a 15.0 is no outlier."""
    values = [0.0] * 41 + [0.1 * i for i in range(1, 80)] + [3.6, 3.8] + [4.0 + i * 0.1 for i in range(39)] + [15.0]
    frame = pd.DataFrame({"x": values})
    q1, q3 = frame.x.quantile(0.25), frame.x.quantile(0.75)
    fitted = fit_cleaning(spark.createDataFrame(frame), methods=["remove"])
    assert fitted.numeric_stats[()]["x"].upper == q3 + 3 * (q3 - q1)


def test_unseen_category_is_all_zeros(spark):
    train = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "kind string, x double")
    fitted = fit_cleaning(train, methods=["fill"])
    row = fitted.transform(spark.createDataFrame([("z", 3.0)], "kind string, x double"), "fill").first()
    assert row["cat__kind_a"] == 0.0 and row["cat__kind_b"] == 0.0


def test_all_missing_column_is_left_out_by_median(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 2.0)], "gone double, x double")
    assert repair(df.withColumnRenamed("x", "x"), "y", "fill").columns == ["num__x"]
    assert "num__gone" in repair(df, "y", "raw").columns


def test_unknown_method(spark):
    with pytest.raises(ValueError):
        repair(spark.range(3), "y", "polish")


def test_too_many_categories_for_wide_columns(spark):
    df = spark.range(3 * MAX_CATEGORIES).selectExpr("cast(id as string) as name")
    with pytest.raises(ValueError):
        fit_cleaning(df, methods=["fill"]).transform(df, "fill")
    # Cleaning without one-hot columns works for any vocabulary.
    assert fit_cleaning(df, methods=["fill"]).clean(df, "fill").count() == 3 * MAX_CATEGORIES


@pytest.mark.parametrize("room", [1_000_000, 40])
@pytest.mark.parametrize("distinct, bounds", [(506, 0), (507, 1), (508, 1)])
def test_distinct_gate_is_exact(spark, room, distinct, bounds):
    df = spark.range(3000).selectExpr(f"cast(id % {distinct} as double) as x")
    fitted = fit_cleaning(df, ["x"], [], methods=["remove"], min_unique=507, values_per_task=room)
    assert fitted.bounds(spark).count() == bounds


def test_text_that_is_no_number_counts_as_missing(spark):
    df = spark.createDataFrame([("1",), ("2",), ("x",), (None,), ("6",)], "v string")
    fitted = fit_cleaning(df, ["v"], [], methods=["fill"])
    assert [r["v"] for r in fitted.clean(df, "fill").collect()] == [1.0, 2.0, 2.0, 2.0, 6.0]


def test_null_keys_and_nan(spark):
    """A NULL key is a group like any other: fitted, attached and cleaned."""
    rows = [(None if i % 3 else "a", float("nan") if i % 10 == 0 else float(i), None if i % 7 == 0 else "xy"[i % 2]) for i in range(60)]
    df = spark.createDataFrame(rows, "k string, v double, kind string")
    fitted = fit_cleaning(df, ["v"], ["kind"], keys=["k"], methods=["all"])
    assert set(fitted.groups) == {(None,), ("a",)}
    assert fitted.clean(df, "all").count() == 60 and fitted.clean(df, "all").where("v is null or kind is null").count() == 0
    only = fit_cleaning(df, [], ["kind"], keys=["k"], methods=["fill"]).clean(df, "fill")
    assert only.count() == 60 and only.where("k is null").count() == 40
    shares = value_shares(df, ["kind"], ["k"])
    assert shares.where("k is null").agg({"share": "sum"}).first()[0] == 1.0


def test_nan_is_no_value_to_quantiles_and_box_plots(spark):
    df = spark.createDataFrame([("g", float(i)) for i in range(9)] + [("g", float("nan"))], "g string, v double")
    box = boxplot_stats(df, "g", "v").first()
    assert (box["median"], box["n_outliers"], box["n"]) == (4.0, 0, 9)


def test_the_limit_of_categories_is_exact(spark):
    """1,000 values are listed and 1,001 are not, whatever an estimate says."""
    df = spark.range(4004).select(*[F.concat(F.lit("v"), (F.col("id") % n).cast("string")).alias(f"c{n}") for n in (999, 1000, 1001)])
    found = fit_cleaning(df, methods=["fill"]).category_stats[()]
    assert [len(found[f"c{n}"].vocabulary or ()) for n in (999, 1000, 1001)] == [999, 1000, 0]
