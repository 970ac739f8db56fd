"""Evaluation grids and the choice of variant files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.levels import ORIGINAL, level_label
from ..specs import GridProfile


def _listed(values) -> F.Column:
    return F.explode(F.array(*[F.lit(v) for v in values]))


def build_grid(datasets: DataFrame, grid: GridProfile) -> DataFrame:
    """Every task of a grid: one raw baseline per dataset and model, then
    dataset x level x repeat x method x model."""
    base = datasets.select(
        "dataset",
        F.lit(ORIGINAL).alias("damage_level"),
        F.lit("raw").alias("method"),
        _listed(grid.models).alias("model"),
        F.lit(0).alias("damage_repeat"),
    )
    tasks = (
        datasets.select("dataset", _listed(grid.levels).alias("percent"))
        .select("*", _listed(grid.damage_repeats).alias("damage_repeat"))
        .select("*", _listed(grid.methods).alias("method"))
        .select(
            "dataset",
            level_label("percent").alias("damage_level"),
            "method",
            _listed(grid.models).alias("model"),
            "damage_repeat",
        )
    )
    return base.unionByName(tasks)


def resolve_variants(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Match wanted (dataset, damage_level, damage_repeat) with what is stored.

    ``catalog`` has dataset, damage_level, damage_repeat and location; a NULL
    repeat marks a variant stored without one. A wanted variant takes its own
    repeat; else the one without a repeat stands in as repeat 1, once per level;
    else it is left out. A level stops at the first repeat that is not stored
    under its own number and is covered by the stand-in.
    """
    own = catalog.where(F.col("damage_repeat").isNotNull()).withColumnRenamed("location", "own")
    spare = catalog.where(F.col("damage_repeat").isNull()).select(
        "dataset", "damage_level", F.col("location").alias("spare")
    )
    joined = wanted.join(own, ["dataset", "damage_level", "damage_repeat"], "left").join(
        spare, ["dataset", "damage_level"], "left"
    )
    stand_in = F.col("own").isNull() & F.col("spare").isNotNull()
    first = joined.groupBy("dataset", "damage_level").agg(
        F.min(F.when(stand_in, F.col("damage_repeat"))).alias("first_stand_in")
    )
    usable = joined.join(first, ["dataset", "damage_level"]).where(
        (F.col("own").isNotNull() | stand_in)
        & (F.col("first_stand_in").isNull() | (F.col("damage_repeat") <= F.col("first_stand_in")))
    )
    return usable.select(
        "dataset",
        "damage_level",
        F.when(F.col("own").isNotNull(), F.col("damage_repeat")).otherwise(F.lit(1)).alias("damage_repeat"),
        F.coalesce("own", "spare").alias("location"),
    )
