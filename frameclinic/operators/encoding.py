"""Stand-alone scalers and encoders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import nan_to_null, ref, roles_by_type
from .cleaning import MAX_CATEGORIES, _value_counts


def min_max_scale(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(c - min) / (max - min); missing cells stay missing, constants become missing."""
    source = nan_to_null(df)
    edges = source.agg(
        *[F.min(ref(c)).alias(f"lo{i}") for i, c in enumerate(columns)],
        *[F.max(ref(c)).alias(f"hi{i}") for i, c in enumerate(columns)],
    ).first()

    def scaled(name: str):
        if name not in columns:
            return ref(name)
        i = list(columns).index(name)
        lo, hi = edges[f"lo{i}"], edges[f"hi{i}"]
        if lo is None or hi == lo:
            return F.lit(None).cast("double").alias(name)
        return ((ref(name).cast("double") - F.lit(float(lo))) / F.lit(float(hi) - float(lo))).alias(name)

    return source.select(*[scaled(c) for c in df.columns])


def dummies(
    df: DataFrame, columns: Sequence[str] | None = None, drop_first: bool = False
) -> DataFrame:
    """Text columns become 0/1 columns ``<column>_<value>``; missing is all zeros."""
    if columns is None:
        columns = roles_by_type(df)[1]
    counts = _value_counts(df, [], columns)
    widths = counts.groupBy("column").agg(F.count("*").alias("width")).collect()
    too_wide = [r["column"] for r in widths if r["width"] > MAX_CATEGORIES]
    if too_wide:
        raise ValueError(f"more than {MAX_CATEGORIES} categories in {too_wide}: use one_hot_long")
    values = counts.groupBy("column").agg(F.sort_array(F.collect_set("value")).alias("values")).collect()
    known = {r["column"]: r["values"][1 if drop_first else 0 :] for r in values}
    plain = [ref(c) for c in df.columns if c not in columns]
    coded = [
        F.when(ref(c).cast("string") == F.lit(v), F.lit(1)).otherwise(F.lit(0)).alias(f"{c}_{v}")
        for c in columns
        for v in known.get(c, [])
    ]
    return df.select(*plain, *coded)


def one_hot_long(df: DataFrame, columns: Sequence[str], row_key: Sequence[str]) -> DataFrame:
    """One row per hot cell: (row key, feature, value 1.0), for vocabularies of any width."""
    cells = F.array(
        *[
            F.struct(
                F.concat(F.lit(f"cat__{c}_"), ref(c).cast("string")).alias("feature"), F.lit(1.0).alias("value")
            )
            for c in columns
        ]
    )
    cells = cells.cast("array<struct<feature:string,value:double>>")
    return df.select(*row_key, F.inline(cells)).where(F.col("feature").isNotNull())
