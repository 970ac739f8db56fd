from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from frameclinic.functions.levels import ORIGINAL
from frameclinic.operators import summary
from frameclinic.operators.cleaning import fit_cleaning
from frameclinic.operators.encoding import dummies, one_hot_long
from frameclinic.operators.labels import label_table, require_positive_class
from frameclinic.operators.models import get_estimator
from frameclinic.plans import evaluate
from frameclinic.plans.evaluate import run_grid
from frameclinic.plans.grid import build_grid, resolve_variants
from frameclinic.sources.tables import load_dataset, read_delimited
from frameclinic.specs import GRID_10_50, GRID_FAST, GRID_FULL, PROFILE_A, DatasetSpec, GridProfile
from frameclinic.streaming.repair import repair_stream


def labelled(spark, n=400):
    noise = F.xxhash64("id") % 100 / 100.0
    return spark.range(n).select(
        "id", (F.col("id") % 2 + noise).alias("x"), (noise * 3).alias("z"),
        F.when(F.xxhash64("id", F.lit(1)) % 2 == 0, "u").otherwise("v").alias("kind"),
        (F.col("id") % 2).cast("int").alias("y"),
    )


def test_grid_study_orders_recipes(spark):
    """On a separable table repair beats leaving the damage, and the baseline beats both."""
    spec = DatasetSpec("toy", "y", "id", continuous=("x", "z"))
    grid = GridProfile("toy", ("raw", "all"), ("NB", "RF"), (20,), (1,), (101,), 3, {"RF": {"trees": 5, "depth": 3}})
    details = run_grid(labelled(spark), spec, PROFILE_A, grid)
    auc = {(r["damage_level"], r["method"], r["model"]): r["auc_mean"] for r in summary.summarise(details).collect()}
    assert set(auc) == {
        (level, method, model)
        for model in ("NB", "RF")
        for level, method in ((ORIGINAL, "raw"), ("20%", "raw"), ("20%", "all"))
    }
    assert auc[("20%", "raw", "NB")] < auc[("20%", "all", "NB")] < auc[(ORIGINAL, "raw", "NB")]
    assert auc[(ORIGINAL, "raw", "RF")] > 0.9


def test_models_of_a_grid_share_one_fit(spark, monkeypatch):
    """Naive Bayes and forests of a grid use the same sides, fitted once; naive Bayes finds what it finds alone."""
    fits, fit = [], evaluate.fit_complements
    monkeypatch.setattr(evaluate, "fit_complements", lambda *args, **named: fits.append(1) or fit(*args, **named))
    spec = DatasetSpec("toy", "y", "id", continuous=("x", "z"))
    grid = GridProfile("toy", ("raw",), ("NB", "RF"), (20,), (1,), (101,), 2, {"RF": {"trees": 2, "depth": 3}})
    both = run_grid(labelled(spark), spec, PROFILE_A, grid)
    assert len(fits) == 1
    alone = run_grid(labelled(spark), spec, PROFILE_A, replace(grid, models=("NB",)))
    assert sorted(map(tuple, both.where("model = 'NB'").collect())) == sorted(map(tuple, alone.collect()))


@pytest.mark.parametrize("grid,tasks", [(GRID_FULL, 484), (GRID_FAST, 93), (GRID_10_50, 304)])
def test_grid_sizes(spark, grid, tasks):
    assert build_grid(spark.createDataFrame([("d",)], "dataset string"), grid).count() == tasks


def test_resolve_variants(spark):
    catalog = spark.createDataFrame(
        [("d", 20, 1, "d20r1"), ("d", 20, None, "d20"), ("d", 20, 3, "d20r3"), ("d", 40, None, "d40"), ("d", 60, 2, "d60r2")],
        "dataset string, damage_level int, damage_repeat int, location string",
    )
    wanted = spark.createDataFrame(
        [("d", lv, rp) for lv in (20, 40, 60, 80) for rp in (1, 2, 3)],
        "dataset string, damage_level int, damage_repeat int",
    )
    found = sorted(tuple(r) for r in resolve_variants(wanted, catalog).collect())
    assert found == [("d", 20, 1, "d20"), ("d", 20, 1, "d20r1"), ("d", 40, 1, "d40"), ("d", 60, 2, "d60r2")]


def test_labels(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a|target\n1|yes\n2|no\n|yes\n4|other\n")
    spec = DatasetSpec("t", "target", target_map={"yes": 1, "no": 0}, separator="|")
    rows = sorted(load_dataset(spark, str(path), spec).collect(), key=str)
    assert [(r["a"], r["target"]) for r in rows] == [(1, 1), (2, 0), (None, 1)]
    truncated = spark.createDataFrame([(1.0,), (None,)], "target double")
    assert [r["target"] for r in label_table(truncated, DatasetSpec("t", "target")).collect()] == [1]


def test_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        read_delimited(spark, str(tmp_path / "nothing.csv"))


def test_positive_class_is_needed(spark):
    with pytest.raises(ValueError):
        require_positive_class(spark.createDataFrame([(0,), (2,)], "y int"), "y")


def test_unknown_model():
    with pytest.raises(ValueError):
        get_estimator("SVM", 1, 3)


def test_summary_of_a_single_run(spark):
    row = spark.createDataFrame(
        [("d", "20%", None, "NB", 0.12344)], "dataset string, damage_level string, method string, model string, auc double"
    )
    found = summary.summarise(row).first()
    assert found["method"] is None and (found["auc_mean"], found["auc_std"], found["n_runs"]) == (0.1234, 0.0, 1)


def test_dummies(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "kind string, n int")
    assert dummies(df).columns == ["n", "kind_a", "kind_b"]
    assert dummies(df, drop_first=True).columns == ["n", "kind_b"]
    assert one_hot_long(df, ["kind"], ["n"]).count() == 2


def test_stream_is_cleaned_like_the_table(spark, tmp_path):
    batch = labelled(spark)
    fitted = fit_cleaning(batch.select("x", "z", "kind"), methods=["all"])
    batch.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(batch.schema).parquet(str(tmp_path / "in"))
    query = (
        repair_stream(stream, fitted, "all", ["id"]).writeStream.format("memory").queryName("repaired")
        .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    )
    query.awaitTermination(120)
    want = sorted(map(tuple, fitted.transform(batch, "all", ["id"]).collect()))
    assert sorted(map(tuple, spark.table("repaired").collect())) == want
    with pytest.raises(ValueError):
        repair_stream(batch, fitted, "all")


def test_study_over_described_datasets(spark, tmp_path):
    """Two of the study's datasets, one without a key of its own; detail and summary are written."""
    from pyspark.sql import functions as F

    from frameclinic.plans.study import run_study
    from frameclinic.specs import PROFILE_A, STUDY_DATASETS, GridProfile

    def column(name, i):
        return (F.col("id") * (i + 3) % 97 + F.when(F.col("id") % 2 == 0, 20).otherwise(0)).cast("double").alias(name)

    ids = spark.range(240)
    heart = ids.select(*[column(c, i) for i, c in enumerate(STUDY_DATASETS["serce"].continuous)], (F.col("id") % 2 + 1).alias("diagnoza"))
    sugar = ids.select(
        *[column(c, i) for i, c in enumerate(STUDY_DATASETS["diabetes"].continuous)],
        F.when(F.col("id") % 2 == 0, "tested_positive").otherwise("tested_negative").alias("decision"),
    )
    grid = GridProfile("small", ("raw", "fill"), ("NB",), (20,), (1,), (101,), 2)
    detail, summary = run_study({"serce": heart, "diabetes": sugar}, PROFILE_A, grid, path=str(tmp_path))
    assert {(r["dataset"], r["method"]) for r in detail.collect()} == {(d, m) for d in ("serce", "diabetes") for m in ("raw", "fill")}
    assert spark.read.option("header", True).csv(f"{tmp_path}/detail").count() == detail.count()
    assert spark.read.option("header", True).csv(f"{tmp_path}/summary").count() == summary.count()


def test_registered_grids_are_whole(spark):
    """The fast grid's 6 variants, 5 methods and 2 seeds; stored variants give the same runs; models are the spec's."""
    from frameclinic.operators import models
    from registry import queries

    folder = "/root/testdata/sf0.001"
    whole = sorted(map(tuple, queries.nb_grid_fast(spark, folder).collect()))
    assert len(whole) == 2 * (1 + 6 * 5)
    assert sorted(map(tuple, queries.stored_variant_study(spark, folder).collect())) == whole
    assert {r["suffix"] for r in queries.repaired_files_all(spark, folder).collect()} == {r.suffix for r in queries.RECIPES.values() if r.suffix}
    assert not hasattr(queries, "SMALL_MODELS") and models.get_estimator("RF", 1, 3, GRID_FAST.model_params).getNumTrees() == 180
