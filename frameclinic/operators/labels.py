"""Target handling and column dropping for labelled tables."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import present, ref
from ..specs import DatasetSpec


def mapped(column: Column, mapping: Mapping[object, int]) -> Column:
    """Dictionary lookup; values without an entry become NULL."""
    out = F.lit(None).cast("int")
    for value, code in reversed(list(mapping.items())):
        out = F.when(column == F.lit(value), F.lit(int(code))).otherwise(out)
    return out


def label_table(df: DataFrame, spec: DatasetSpec) -> DataFrame:
    """Map the target, drop rows without one, and make it an int."""
    target = ref(spec.target)
    if spec.target_map is not None:
        target = mapped(target, spec.target_map)
    return (
        df.withColumn(spec.target, target)
        .dropna(subset=[spec.target])
        .withColumn(spec.target, ref(spec.target).cast("double").cast("int"))
    )


def drop_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Drop those of ``names`` that exist."""
    return df.drop(*present(df, names))


def require_positive_class(df: DataFrame, label: str) -> None:
    """Fail unless some row has label 1: scores are the probability of class 1."""
    if df.where(F.col(label) == 1).limit(1).count() == 0:
        raise ValueError(f"no row of {label!r} has the positive class 1")
