"""Result tables: summaries, change against the baseline, box plots, curves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_same, number, ref
from ..functions.levels import MODELS, ORIGINAL, level_order, model_order
from ..sources.workspace import broadcast_if_small
from .quantiles import exact_quantiles

CELL = ("dataset", "damage_level", "method", "model")


def summarise(details: DataFrame, digits: int = 4) -> DataFrame:
    """Mean, sample sd (0 for a single run) and run count of each cell, ordered by cell."""
    return (
        details.groupBy(*CELL)
        .agg(
            F.round(F.avg("auc"), digits).alias("auc_mean"),
            F.round(F.coalesce(F.stddev_samp("auc"), F.lit(0.0)), digits).alias("auc_std"),
            F.count("auc").alias("n_runs"),
        )
        .orderBy(*CELL)
    )


def known_models(summary: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Keep the reported models."""
    return summary.where(F.col("model").isin(*models))


def baseline(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("damage_level") == ORIGINAL)


def damaged(summary: DataFrame) -> DataFrame:
    return summary.where(F.col("damage_level") != ORIGINAL)


def with_baseline_delta(summary: DataFrame, digits: int = 4) -> DataFrame:
    """Left join with the undamaged score of the same dataset and model."""
    base = baseline(summary).select("dataset", "model", F.col("auc_mean").alias("auc_baseline"))
    return join_same(summary, base, ["dataset", "model"], "left").select(
        *summary.columns,
        "auc_baseline",
        F.round(F.col("auc_mean") - F.col("auc_baseline"), digits).alias("auc_delta"),
    )


def delta_curve(summary: DataFrame) -> DataFrame:
    """Change against the baseline by level, without the baseline rows."""
    return damaged(with_baseline_delta(summary)).select(
        "dataset", "model", "method", "damage_level", level_order("damage_level").alias("level_order"), "auc_delta"
    )


def method_model_table(summary: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """Per dataset, level and method: mean, sd and baseline of each model side by side."""
    joined = damaged(with_baseline_delta(known_models(summary, models)))
    wide = joined.groupBy("dataset", "damage_level", "method").pivot("model", list(models)).agg(
        F.first("auc_mean").alias("mean"), F.first("auc_std").alias("std"), F.first("auc_baseline").alias("baseline")
    )
    return wide.withColumn("level_order", level_order("damage_level"))


def boxplot_stats(df: DataFrame, group: str, value: str) -> DataFrame:
    """Quartiles, whiskers (furthest data within 1.5 IQR) and outlier count per group."""
    quartiles = exact_quantiles(df, [value], [0.25, 0.5, 0.75], [group]).select(
        group,
        F.col("quantiles")[0].alias("q1"),
        F.col("quantiles")[1].alias("median"),
        F.col("quantiles")[2].alias("q3"),
    )
    joined = _beyond_whiskers(df, group, value, quartiles)
    v, beyond = number(ref(value)), F.col("beyond")
    return joined.groupBy(group, "q1", "median", "q3").agg(
        F.least(F.col("q1"), F.min(F.when(~beyond, v))).alias("whisker_low"),
        F.greatest(F.col("q3"), F.max(F.when(~beyond, v))).alias("whisker_high"),
        F.count_if(beyond).alias("n_outliers"),
        F.count(v).alias("n"),
    )


def _beyond_whiskers(df: DataFrame, group: str, value: str, quartiles: DataFrame) -> DataFrame:
    v, reach = number(ref(value)), 1.5 * (F.col("q3") - F.col("q1"))
    beyond = (v < F.col("q1") - reach) | (v > F.col("q3") + reach)
    return join_same(df.select(group, value), broadcast_if_small(quartiles), [group]).withColumn("beyond", beyond)


def boxplot_outliers(df: DataFrame, group: str, value: str) -> DataFrame:
    """The rows beyond the whiskers' reach."""
    quartiles = exact_quantiles(df, [value], [0.25, 0.5, 0.75], [group]).select(
        group, F.col("quantiles")[0].alias("q1"), F.col("quantiles")[2].alias("q3")
    )
    return _beyond_whiskers(df, group, value, quartiles).where("beyond").select(group, value)


def top_k(df: DataFrame, by: str, k: int, group: str | None = None, tie: str | None = None) -> DataFrame:
    """The ``k`` largest by ``by``, over the table or per group."""
    order: list[Column] = [F.desc(by), *([F.asc(tie)] if tie else [])]
    if group is None:
        return df.orderBy(*order).limit(k)
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", place).where(F.col("place") <= k)


def distinct_sorted(df: DataFrame, column: str) -> DataFrame:
    """Distinct non-null values in order."""
    return df.select(column).dropna().distinct().orderBy(column)


def levels_in_order(summary: DataFrame) -> DataFrame:
    """The damage levels of a result table, the undamaged one first."""
    levels = summary.select("damage_level").dropna().distinct()
    return levels.withColumn("level_order", level_order("damage_level")).orderBy("level_order")


def models_in_order(summary: DataFrame, models: Sequence[str] = MODELS) -> DataFrame:
    """The reported models of a result table in their fixed order."""
    found = known_models(summary, models).select("model").distinct()
    return found.withColumn("model_order", model_order("model", tuple(models))).orderBy("model_order")
