"""Variants stored by name, studies that go on where they stopped, corners of a curve."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from frameclinic.operators.metrics import roc_auc, roc_points
from frameclinic.plans.grid import resolve_variants
from frameclinic.plans.study import DETAIL, TASK, resume_study, stored_detail
from frameclinic.sources.tables import named_variants, read_located, variant_name, write_named
from frameclinic.specs import GRID_FAST, PROFILE_A, DatasetSpec


def test_named_variants_of_every_kind(spark, tmp_path):
    """Folders and single files, with and without a repeat, in folders with odd names; other files play no part."""
    top = tmp_path / "a b+c%20"
    top.mkdir()
    schema = "id long, x double"
    for level, repeat in ((20, 1), (20, 3), (40, None), (60, None), (60, 1)):
        df = spark.createDataFrame([(i, float(level + (repeat or 0))) for i in range(5)], schema)
        write_named(df, str(top), variant_name("t", level, repeat))
    (top / "t_prob_80_r2.csv").write_text("id|x\n7|1.5\n8|\n")
    (top / "t_prob_x.csv").write_text("id|x\n1|1\n")
    (top / "notes.txt").write_text("none")
    catalog = named_variants(spark, str(tmp_path))
    listed = {(r["damage_level"], r["damage_repeat"]) for r in catalog.collect()}
    assert listed == {(20, 1), (20, 3), (40, None), (60, None), (60, 1), (80, 2)}
    wanted = spark.createDataFrame([("t", lv, rp) for lv in (20, 40, 60, 80, 99) for rp in (1, 2, 3)], "dataset string, damage_level int, damage_repeat int")
    back = read_located(spark, resolve_variants(wanted, catalog), spark.createDataFrame([], schema).schema)
    found = {(r["damage_level"], r["damage_repeat"]): (r["n"], r["m"]) for r in back.groupBy("damage_level", "damage_repeat").agg(F.count("*").alias("n"), F.max("x").alias("m")).collect()}
    # level 60 has repeat 1 itself; the file without a repeat stands in for repeat 2, as repeat 1, and ends the level
    assert found == {(20, 1): (5, 21.0), (20, 3): (5, 23.0), (40, 1): (5, 40.0), (60, 1): (10, 61.0), (80, 2): (2, 1.5)}
    assert read_located(spark, resolve_variants(wanted.limit(0), catalog), spark.createDataFrame([], schema).schema).count() == 0


def test_a_study_resumes(spark, tmp_path):
    """Stored tasks are left as they are, also where their rows differ; a larger grid adds what it lacks."""
    rng = np.random.default_rng(0)
    rows = [(i, float(rng.normal(i % 2, 1)), "pq"[int(rng.integers(0, 2))], i % 2) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, x double, kind string, y int")
    specs = {"t": DatasetSpec("t", "y", "id", continuous=("x",))}
    grid = replace(GRID_FAST, models=("NB",), methods=("raw", "fill"), levels=(20,), damage_repeats=(1,), cv_seeds=(101,), folds=2)
    path = str(tmp_path / "detail")
    assert stored_detail(spark, path).count() == 0
    first = {tuple(r[c] for c in TASK): r["auc"] for r in resume_study({"t": df}, PROFILE_A, grid, path, specs).collect()}
    assert len(first) == 3
    own = ("t", "NB", "20%", 1, "fill")
    odd = spark.createDataFrame([(1, 101, -5.0, *own)], DETAIL)
    odd.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TASK).parquet(path)
    second = {tuple(r[c] for c in TASK): r["auc"] for r in resume_study({"t": df}, PROFILE_A, replace(grid, damage_repeats=(1, 2)), path, specs).collect()}
    assert len(second) == 5 and second[own] == -5.0
    assert all(second[k] == v for k, v in first.items() if k != own)
    with pytest.raises(ValueError):
        resume_study({"other": df}, PROFILE_A, grid, path, specs)


@pytest.mark.parametrize("rows_per_task", [2_000_000, 7])
def test_corners_keep_the_area(spark, rows_per_task):
    rng = np.random.default_rng(3)
    rows = [("a", int(rng.integers(0, 2)), float(rng.integers(0, 60))) for _ in range(300)]
    rows += [("b", 0, float(i)) for i in range(50)] + [("b", 1, float(i)) for i in range(50, 100)] + [(None, i % 2, float(i // 2)) for i in range(40)]
    rows += [("a", None, 500.0), ("b", 1, None)]
    df = spark.createDataFrame(rows, "k string, y int, s double")
    every = roc_points(df, "s", "y", ["k"]).toPandas()
    few = roc_points(df, "s", "y", ["k"], rows_per_task, corners=True).toPandas()
    auc = {r["k"]: r["auc"] for r in roc_auc(df, "s", "y", ["k"]).collect()}
    for k in ("a", "b", None):
        own = few[few.k.isna() if k is None else few.k == k].sort_values(["fpr", "tpr"])
        assert np.trapezoid(own.tpr, own.fpr) == pytest.approx(auc[k], abs=1e-12)
        assert len(own) <= len(every[every.k.isna() if k is None else every.k == k])
    assert len(few[few.k.isna()]) == 2  # equal steps all along: start and end
    assert len(few[few.k == "b"]) == 4 - 0 and set(map(tuple, few[["k", "threshold"]].dropna().values)) <= set(map(tuple, every[["k", "threshold"]].dropna().values))
