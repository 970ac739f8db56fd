"""The study over several datasets, from damaged or stored variants to the two result tables."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import replace

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.damage import with_content_key
from ..operators.summary import summarise
from ..sources.tables import write_results
from ..sources.workspace import materialise
from ..specs import STUDY_DATASETS, DamageProfile, DatasetSpec, GridProfile
from .evaluate import run_grid, run_variants
from .grid import build_grid

KEY = "row_key"


def keyed(df: DataFrame, spec: DatasetSpec) -> tuple[DataFrame, DatasetSpec]:
    """The table and its description with a row key; tables without one get the content key."""
    if spec.row_key is not None:
        return df, spec
    return materialise(with_content_key(df, KEY), "keyed"), spec.with_key(KEY)


#: What one task of a study is; each has a folder of its own in the stored detail table.
TASK = ("dataset", "model", "damage_level", "damage_repeat", "method")
DETAIL = "cv_repeat int, cv_seed int, auc double, dataset string, model string, damage_level string, damage_repeat int, method string"


def stored_detail(spark: SparkSession, path: str) -> DataFrame:
    """The detail rows stored under ``path`` so far; none if there is nothing yet."""
    try:
        return spark.read.schema(DETAIL).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], DETAIL)


def resume_study(
    tables: Mapping[str, DataFrame], profile: DamageProfile, grid: GridProfile, path: str,
    specs: Mapping[str, DatasetSpec] = STUDY_DATASETS,
) -> DataFrame:
    """The stored detail table after all tasks of the grid that it lacked have been run.

    Tasks of one dataset and model are run together and written by folders; a folder that a broken run left is
    overwritten, others are not touched. So a study can be stopped anywhere, or be given a larger grid, and goes on.
    """
    unknown = sorted(set(tables) - set(specs))
    if unknown:
        raise ValueError(f"no dataset description for {unknown}")
    for name, df in tables.items():
        spark = df.sparkSession
        for model in grid.models:
            wanted = build_grid(spark.createDataFrame([(name,)], "dataset string"), replace(grid, models=(model,)))
            left = wanted.join(stored_detail(spark, path).select(*TASK).distinct(), list(TASK), "left_anti").select(*TASK)
            rows = left.collect()  # as many as the grid has tasks
            if not rows:
                continue
            levels = {f"{lv}%": lv for lv in grid.levels}
            variants = sorted({(levels[r["damage_level"]], r["damage_repeat"]) for r in rows if r["damage_level"] in levels})
            methods = tuple(m for m in grid.methods if any(r["method"] == m for r in rows))
            table, spec = keyed(df, specs[name])
            part = run_variants(table, replace(spec, name=name), profile, replace(grid, models=(model,), methods=methods), variants)
            todo = F.broadcast(spark.createDataFrame([tuple(r) for r in rows], left.schema))
            part = part.join(todo, list(TASK), "left_semi").select(*[c.split()[0] for c in DETAIL.split(", ")])
            part.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*TASK).parquet(path)
    return stored_detail(next(iter(tables.values())).sparkSession, path)


def run_study(
    tables: Mapping[str, DataFrame],
    profile: DamageProfile,
    grid: GridProfile,
    specs: Mapping[str, DatasetSpec] = STUDY_DATASETS,
    path: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(detail, summary) of the grid over every table, raw as read; tables whose name no spec has are an error.

    With ``path`` both are also written as comma-separated text, under ``detail`` and ``summary``.
    """
    unknown = sorted(set(tables) - set(specs))
    if unknown:
        raise ValueError(f"no dataset description for {unknown}")
    detail = None
    for name, df in tables.items():
        table, spec = keyed(df, specs[name])
        part = run_grid(table, spec, profile, grid)
        detail = part if detail is None else detail.unionByName(part)
    if detail is None:
        raise ValueError("a study needs a dataset")
    detail = materialise(detail, "details")
    summary = materialise(summarise(detail), "summary")
    if path is not None:
        write_results(detail, f"{path}/detail")
        write_results(summary, f"{path}/summary")
    return detail, summary
