"""Recipes as pipeline stages."""

import pytest
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from frameclinic.operators.cleaning import fit_cleaning
from frameclinic.operators.stages import RecipeCleaner, RecipeModel
from frameclinic.specs import RECIPES


def table(spark):
    rows = [(i, None if i % 9 == 0 else float(i % 40) * (100 if i % 37 == 0 else 1), None if i % 11 == 0 else "abcz"[min(i % 31, 3)], i % 2) for i in range(400)]
    return spark.createDataFrame(rows, "id long, `odd name` double, kind string, y int")


def same(a, b):
    return a.columns == b.columns and sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_saved_and_loaded_in_another_session(spark, tmp_path):
    df = table(spark)
    model = RecipeCleaner(method="all", keep=["id", "y"]).fit(df)
    model.save(str(tmp_path / "recipe"))
    other = spark.newSession()
    loaded = RecipeModel.load(str(tmp_path / "recipe"))
    again = other.createDataFrame(df.collect(), df.schema)
    want = fit_cleaning(df.select("odd name", "kind")).transform(df, "all", keep=["id", "y"])
    assert loaded.uid == model.uid and loaded.getKeep() == ["id", "y"]
    assert same(loaded.transform(again), want) and same(model.transform(df), want)
    assert loaded.transformSchema(df.schema) == want.schema
    for method in RECIPES:
        other_way = fit_cleaning(df.select("odd name", "kind")).transform(df, method, keep=["id", "y"])
        assert same(loaded.copy().setMethod(method).transform(df), other_way), method
    with pytest.raises(ValueError):
        loaded.transformSchema(df.drop("kind").schema)
    with pytest.raises(ValueError):
        RecipeCleaner(method="polish").fit(df)


def test_stream(spark, tmp_path):
    df = table(spark)
    RecipeCleaner(method="fill_norm", keep=["id"]).fit(df.drop("y")).write().overwrite().save(str(tmp_path / "recipe"))
    loaded = RecipeModel.load(str(tmp_path / "recipe"))
    df.drop("y").repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.drop("y").schema).parquet(str(tmp_path / "in"))
    query = loaded.transform(stream).writeStream.format("memory").queryName("cleaned_stream").start()
    query.processAllAvailable()
    query.stop()
    assert same(spark.table("cleaned_stream"), loaded.transform(df.drop("y")))


def test_stage_of_a_pipeline(spark, tmp_path):
    df = table(spark)
    cleaner = RecipeCleaner(method="remove_fill", keep=["y"])
    columns = [c for c in cleaner.fit(df.drop("id")).transform(df.drop("id")).columns if c != "y"]
    assembler = VectorAssembler(inputCols=columns, outputCol="features")
    fitted = Pipeline(stages=[cleaner, assembler]).fit(df.drop("id"))
    fitted.save(str(tmp_path / "pipe"))
    loaded = PipelineModel.load(str(tmp_path / "pipe"))
    assert same(loaded.transform(df).select("y", F.col("features").cast("string")), fitted.transform(df).select("y", F.col("features").cast("string")))
    cleaner.save(str(tmp_path / "cleaner"))
    assert RecipeCleaner.load(str(tmp_path / "cleaner")).getMethod() == "remove_fill"
