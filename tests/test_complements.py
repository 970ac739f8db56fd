"""Statistics of training sides from states of the folds, against fits over the training rows themselves."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameclinic.operators.cleaning import fit_cleaning
from frameclinic.operators.complements import fit_complements, merge
from frameclinic.operators.naive_bayes import fit_gaussian_nb, score_gaussian_nb

METHODS = ("raw", "norm", "fill", "remove", "remove_fill", "remove_norm", "fill_norm", "all")
SCHEMA = "id long, run int, fold int, y int, a double, b double, c long, kind string, wide string"


def table(spark, n=600, seed=5):
    """Outliers near the bounds, ties, missing cells, a NULL run, labels that are neither, a column without numbers in fold 2."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        y = int(rng.integers(0, 2))
        fold = i % 4
        a = float(rng.normal(y, 1)) * (25 if rng.random() < 0.05 else 1)
        b = None if fold != 2 or rng.random() < 0.5 else float(rng.integers(0, 30))
        rows.append((
            i, None if i % 3 == 0 else 1, fold, None if i % 41 == 0 else (5 if i % 43 == 0 else y),
            None if rng.random() < 0.1 else (float("nan") if rng.random() < 0.05 else a), b, int(rng.integers(0, 6)),
            None if rng.random() < 0.1 else str(rng.choice(["p", "q", "r", "s"], p=[0.55, 0.3, 0.13, 0.02])), f"w{rng.integers(0, 200)}",
        ))
    return spark.createDataFrame(rows, SCHEMA)


def exploded(df, folds=4):
    held = df.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    return held.where("fold <> held_out")


@pytest.mark.parametrize("room", [1_000_000, 40])
def test_equals_the_fit_over_training_rows(spark, room):
    df = table(spark).where("run is not null")
    numeric, categorical = ["a", "b", "c"], ["kind", "wide"]
    fit = fit_complements(df, numeric, categorical, "y", ["run"], 4, METHODS, values_per_task=room)
    want = fit_cleaning(exploded(df), numeric, categorical, ["run", "held_out"], METHODS)
    assert set(fit.cleaning.groups) == set(want.groups) and len(want.groups) == 4
    bounded = 0
    for g in want.groups:
        for c in numeric:
            x, y = fit.cleaning.numeric_stats[g][c], want.numeric_stats[g][c]
            bounded += y.lower is not None
            for field in ("rows", "n", "median", "lower", "upper", "kept_n", "kept_median"):
                assert getattr(x, field) == getattr(y, field), (g, c, field)
            for field in ("mean", "var", "kept_mean", "kept_var"):
                got, wanted = getattr(x, field), getattr(y, field)
                assert got is wanted is None or got == pytest.approx(wanted, rel=1e-12), (g, c, field)
        assert fit.cleaning.category_stats[g] == want.category_stats[g]
    assert bounded >= 4


def test_naive_bayes_equals_the_fit_over_cleaned_rows(spark):
    df = table(spark).where("run is not null")
    numeric, categorical = ["a", "b", "c"], ["kind", "wide"]
    fit = fit_complements(df, numeric, categorical, "y", ["run"], 4, METHODS)
    model = fit.naive_bayes(spark, lambda group: METHODS)
    keys = ["run", "held_out"]
    for method in METHODS:
        cleaned = fit.cleaning.clean(exploded(df), method)
        want = fit_gaussian_nb(cleaned, numeric, categorical, "y", keys)
        test = fit.cleaning.clean(df.withColumn("held_out", F.col("fold")), method)
        scores = [
            {r["id"]: r["score"] for r in score_gaussian_nb(test, m, numeric, categorical, keys).collect()}
            for m in (model.where(F.col("method") == method).drop("method"), want)
        ]
        assert len(scores[1]) == df.count() and scores[0] == pytest.approx(scores[1], rel=1e-6, abs=1e-12), method


def test_null_keys_are_a_group(spark):
    df = table(spark)
    fit = fit_complements(df, ["a", "c"], ["kind"], "y", ["run"], 4, ["all"])
    alone = fit_complements(df.where("run is null").withColumn("run", F.lit(7)), ["a", "c"], ["kind"], "y", ["run"], 4, ["all"])
    assert {g[0] for g in fit.cleaning.groups} == {None, 1}
    for h in range(4):
        assert fit.cleaning.category_stats[None, h] == alone.cleaning.category_stats[7, h]
        for c in ("a", "c"):
            x, y = fit.cleaning.numeric_stats[None, h][c], alone.cleaning.numeric_stats[7, h][c]
            assert (x.n, x.median, x.lower, x.kept_n, x.kept_median) == (y.n, y.median, y.lower, y.kept_n, y.kept_median)
    scored = fit.naive_bayes(spark, lambda group: ["all"])
    assert scored.where("run is null").count() == 4 and scored.where("run is null and size(hot) = 0").count() == 0


def test_empty_table_and_a_fold_that_is_everything(spark):
    df = table(spark)
    empty = fit_complements(df.limit(0), ["a"], ["kind"], "y", ["run"], 4, ["all"])
    assert empty.cleaning.groups == []
    one = fit_complements(df.where("run = 1").withColumn("fold", F.lit(0)), ["a"], ["kind"], "y", ["run"], 2, ["all"])
    assert one.cleaning.groups == [(1, 1)]  # nothing trains the side that leaves fold 0 out


def test_moments_merge_without_cancelling():
    rng = np.random.default_rng(0)
    parts = [rng.normal(1e9, 1e-3, n) for n in (1, 50, 3, 200)]
    n, mean, var = merge([(len(p), p.mean(), p.var()) for p in parts] + [(0, 0.0, 0.0)])
    whole = np.concatenate(parts)
    assert n == 254 and mean == pytest.approx(whole.mean(), rel=1e-15) and var == pytest.approx(whole.var(), rel=1e-3)


def test_wide_vocabularies_need_no_wide_columns(spark):
    """1,500 categories, more than one-hot columns may have: naive Bayes counts them and scores the held-out rows."""
    df = spark.range(6000).select(
        "id", F.lit(1).alias("run"), (F.col("id") % 4).cast("int").alias("fold"), (F.col("id") % 3 == 0).cast("int").alias("y"),
        F.concat(F.lit("w"), (F.col("id") % 1500).cast("string")).alias("wide"),
    )
    fit = fit_complements(df, [], ["wide"], "y", ["run"], 4, ["fill"])
    model = fit.naive_bayes(spark, lambda group: ["fill"]).drop("method")
    assert fit.cleaning.category_stats[1, 0]["wide"].vocabulary is None and model.agg(F.max(F.size("hot"))).first()[0] > 1000
    test = fit.cleaning.clean(df.withColumn("held_out", F.col("fold")), "fill")
    scored = score_gaussian_nb(test, model, [], ["wide"], ["run", "held_out"])
    assert scored.where("score is null").count() == 0 and scored.count() == 6000
