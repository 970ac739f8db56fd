"""Column roles by type, missing-value rules and safe casts."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def ref(name: str) -> Column:
    """The column called exactly ``name``, whatever characters it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def is_numeric(data_type: T.DataType) -> bool:
    """Integers, floats and decimals are numeric; booleans are not."""
    return isinstance(data_type, T.NumericType)


def roles_by_type(df: DataFrame, exclude: Iterable[str] = ()) -> tuple[list[str], list[str]]:
    """(numeric, categorical) feature names in schema order."""
    left_out = set(exclude)
    fields = [f for f in df.schema.fields if f.name not in left_out]
    numeric = [f.name for f in fields if is_numeric(f.dataType)]
    categorical = [f.name for f in fields if not is_numeric(f.dataType)]
    return numeric, categorical


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """Those of ``names`` that ``df`` has, in the given order."""
    have = set(df.columns)
    return [n for n in names if n in have]


def nan_to_null(df: DataFrame) -> DataFrame:
    """Keep one kind of missing value: NaN becomes NULL."""
    floats = {f.name for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
    if not floats:
        return df
    return df.select(
        *[
            F.when(~F.isnan(ref(c)), ref(c)).alias(c) if c in floats else ref(c)
            for c in df.columns
        ]
    )


def as_double(column: Column) -> Column:
    """Number or NULL: text that is no number does not fail the query."""
    return column.try_cast("double")


def number(column: Column) -> Column:
    """Number or NULL; NaN counts as missing."""
    return F.nanvl(as_double(column), F.lit(None).cast("double"))


def join_same(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``left`` with the other columns of ``right`` where all ``keys`` are the same, NULL being the same as NULL."""
    if not keys:
        return left.crossJoin(right)  # one row
    named = right.withColumnsRenamed({k: f"__same_{k}" for k in keys})
    same = [ref(k).eqNullSafe(ref(f"__same_{k}")) for k in keys]
    return left.join(named, same, how).drop(*[f"__same_{k}" for k in keys])


def whole_div(number: Column, divisor: int) -> Column:
    """Exact integer division (truncating), without going through doubles."""
    return F.call_function("div", number.cast("long"), F.lit(divisor).cast("long"))
