"""Global repair: fit and apply recipes on whole tables, for inspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame

from ..functions.columns import ref
from ..operators.cleaning import fit_cleaning
from ..operators.damage import VARIANT
from ..operators.labels import drop_columns
from ..specs import RECIPES, DatasetSpec, recipe


def repair(df: DataFrame, target: str, method: str, drop: Sequence[str] = (), **options) -> DataFrame:
    """Fit ``method`` on all rows and return the cleaned matrix with the target."""
    recipe(method)
    features = drop_columns(df, [target, *drop])
    fitted = fit_cleaning(features, methods=[method], **options)
    return fitted.transform(df, method, keep=[]) if target not in df.columns else _with_target(
        fitted.transform(df, method, keep=[target]), target
    )


def _with_target(df: DataFrame, target: str) -> DataFrame:
    return df.select(*[ref(c) for c in df.columns if c != target], ref(target))


def repair_variants(df: DataFrame, spec: DatasetSpec, method: str, **options) -> DataFrame:
    """Repair every variant of a damaged table with its own statistics, in one job.

    The matrix has the union of the variants' one-hot columns.
    """
    features = drop_columns(df, spec.kept_out)
    fitted = fit_cleaning(features, keys=list(VARIANT), methods=[method], **options)
    keep = [*VARIANT, *[c for c in (*spec.id_columns, spec.target) if c in df.columns]]
    return fitted.transform(df, method, keep=keep)


def write_repaired(df: DataFrame, spec: DatasetSpec, folder: str, methods: Sequence[str] | None = None) -> None:
    """Write each method's repaired variants under its suffix, as ``|``-separated text."""
    from ..sources.tables import write_variants

    for method in methods or [m for m, r in RECIPES.items() if r.suffix]:
        write_variants(repair_variants(df, spec, method), f"{folder.rstrip('/')}/{recipe(method).suffix}")
