"""Damage-level labels, their order, and the fixed order of models."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Label of the undamaged table, and the models in report order.
ORIGINAL = "ORYGINALNY"
MODELS = ("NB", "MLP", "XGBoost", "RF")


def level_label(percent: Column | str) -> Column:
    """0 -> the undamaged label, 20 -> ``20%``."""
    p = F.col(percent) if isinstance(percent, str) else percent
    return F.when(p == 0, F.lit(ORIGINAL)).otherwise(F.concat(p.cast("string"), F.lit("%")))


def level_order(label: Column | str) -> Column:
    """Sort key of a label: -1 for the undamaged table, else the percent."""
    c = F.col(label) if isinstance(label, str) else label
    return F.when(c == ORIGINAL, F.lit(-1)).otherwise(
        F.regexp_replace(c, "%", "").try_cast("int")
    )


def model_order(model: Column | str, models: tuple[str, ...] = MODELS) -> Column:
    """Position of a model in the report order, NULL if it is unknown."""
    c = F.col(model) if isinstance(model, str) else model
    position = F.array_position(F.array(*[F.lit(m) for m in models]), c)
    return F.when(position > 0, position.cast("int"))
