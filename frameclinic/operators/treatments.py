"""Single treatments of numeric columns: z-score test, winsorising, outlier rows, mean imputation, robust scaling.

Each learns a few numbers per key group (one scan for moments, exact quartiles by narrowing) and is then a projection
or a filter over the table joined with one row per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, nan_to_null, ref
from ..sources.workspace import broadcast_if_small, small_table
from .quantiles import exact_quantiles

Z_LIMIT = 3.0
FENCE = 1.5


def _with_moments(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """``df`` with the struct ``__fit``: mean and population sd of each column (m0, s0, ...) in the row's group."""
    parts = []
    for i, c in enumerate(columns):
        parts += [F.avg(as_double(ref(c))).alias(f"m{i}"), F.stddev_pop(as_double(ref(c))).alias(f"s{i}")]
    return _joined(df, df.groupBy(*keys).agg(*parts), keys)


def _with_quartiles(df: DataFrame, columns: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """The same with the quartiles of each column (a0, b0, c0, ...)."""
    groups: dict[tuple, dict[str, list]] = {}
    for r in exact_quantiles(df, columns, [0.25, 0.5, 0.75], keys).collect():
        groups.setdefault(tuple(r[k] for k in keys), {})[r["column"]] = list(r["quantiles"])
    schema = T.StructType(
        [f for k in keys for f in df.schema.fields if f.name == k]
        + [T.StructField(f"{q}{i}", T.DoubleType()) for i in range(len(columns)) for q in "abc"]
    )
    rows = [[*g, *[v for c in columns for v in found[c]]] for g, found in groups.items()]
    return _joined(df, small_table(df.sparkSession, rows, schema), keys)


def _joined(df: DataFrame, fitted: DataFrame, keys: Sequence[str]) -> DataFrame:
    packed = fitted.select(
        *[ref(k).alias(f"__{k}") for k in keys], F.struct(*[ref(c) for c in fitted.columns if c not in keys]).alias("__fit")
    )
    if not keys:
        return df.crossJoin(F.broadcast(packed))  # one row
    same = [ref(k).eqNullSafe(ref(f"__{k}")) for k in keys]
    return df.join(broadcast_if_small(packed), same, "left").drop(*[f"__{k}" for k in keys])


def _replaced(joined: DataFrame, df: DataFrame, new: dict[str, Column]) -> DataFrame:
    return joined.select(*[new[c].alias(c) if c in new else ref(c) for c in df.columns])


def _fences(i: int, multiplier: float) -> tuple[Column, Column]:
    q1, q3 = F.col(f"__fit.a{i}"), F.col(f"__fit.c{i}")
    return q1 - multiplier * (q3 - q1), q3 + multiplier * (q3 - q1)


def zscore_outliers(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), limit: float = Z_LIMIT) -> DataFrame:
    """Cells more than ``limit`` population standard deviations from the group's mean become NULL."""
    df = nan_to_null(df)
    new = {}
    for i, c in enumerate(columns):
        x = as_double(ref(c))
        far = F.abs(x - F.col(f"__fit.m{i}")) > limit * F.col(f"__fit.s{i}")
        new[c] = F.when(~F.coalesce(far, F.lit(False)), x)
    return _replaced(_with_moments(df, columns, keys), df, new)


def winsorise(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), multiplier: float = FENCE) -> DataFrame:
    """Cells beyond the fences (quartile -/+ ``multiplier`` x interquartile range) move to the fence; missing stays."""
    df = nan_to_null(df)
    new = {}
    for i, c in enumerate(columns):
        low, high = _fences(i, multiplier)
        x = as_double(ref(c))
        new[c] = F.when(x.isNotNull(), F.least(F.greatest(x, low), high))
    return _replaced(_with_quartiles(df, columns, keys), df, new)


def drop_outlier_rows(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = (), multiplier: float = FENCE) -> DataFrame:
    """Rows with any of the columns beyond its fences go; a missing cell is no outlier."""
    df = nan_to_null(df)
    out = F.lit(False)
    for i, c in enumerate(columns):
        low, high = _fences(i, multiplier)
        x = as_double(ref(c))
        out = out | F.coalesce((x < low) | (x > high), F.lit(False))
    return _replaced(_with_quartiles(df, columns, keys).where(~out), df, {})


def impute_mean(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Missing cells get the group's mean; they stay missing where the group has no number."""
    df = nan_to_null(df)
    new = {c: F.coalesce(as_double(ref(c)), F.col(f"__fit.m{i}")) for i, c in enumerate(columns)}
    return _replaced(_with_moments(df, columns, keys), df, new)


def robust_scale(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """(cell - median) / interquartile range of the group; only centred where that range is 0."""
    df = nan_to_null(df)
    new = {}
    for i, c in enumerate(columns):
        spread = F.col(f"__fit.c{i}") - F.col(f"__fit.a{i}")
        new[c] = (as_double(ref(c)) - F.col(f"__fit.b{i}")) / F.when(spread != 0, spread).otherwise(1.0)
    return _replaced(_with_quartiles(df, columns, keys), df, new)


def distinct_counts(df: DataFrame, columns: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Exact distinct non-missing values: one row per key group and column that has any.

    Values are collapsed by hash aggregates that spread over the reducers; no task holds a column's values.
    """
    cells = F.array(*[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value")) for c in columns])
    values = nan_to_null(df).select(*keys, F.inline(cells)).where(F.col("value").isNotNull()).distinct()
    return values.groupBy(*keys, "column").agg(F.count("*").alias("n_distinct"))
