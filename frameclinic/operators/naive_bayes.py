"""Gaussian naive Bayes as two aggregations and one expression.

All key groups (variant x method x seed x fold) are fitted together and scored
through a broadcast of one row per group. One-hot features are never spelled out:
a 0/1 column's mean and variance in a class are p and p(1 - p), so the block of a
categorical column follows from its value counts per class.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import join_same, ref
from ..sources.workspace import BROADCAST_ROWS, materialise

# Values of all groups' vocabularies that may be broadcast with their evidence.
BROADCAST_VALUES = 500_000
# Fixed value: share of the largest feature variance that is added to every variance.
VAR_SMOOTHING = 1e-9


def _evidence(x: Column, m0: Column, v0: Column, m1: Column, v1: Column) -> Column:
    """ln N(x; m1, v1) - ln N(x; m0, v0)."""
    return _distance(x, m0, v0) - _distance(x, m1, v1) + (F.ln(v0) - F.ln(v1)) / 2.0


def _distance(x: Column, mean: Column, var: Column) -> Column:
    return F.try_divide((x - mean) * (x - mean), var * 2.0)


def _hot_key(column: str, value: Column) -> Column:
    return F.concat(F.lit(f"{column}="), value.cast("string"))


def fit_gaussian_nb(
    df: DataFrame, numeric: Sequence[str], categorical: Sequence[str], label: str, keys: Sequence[str] = ()
) -> DataFrame:
    """One row per key group with both classes: ``offset`` (prior and all-zero one-hot
    evidence), ``hot`` (value -> change of evidence), arrays ``means0/1`` and ``vars0/1``.

    A one-hot cell that contradicts a class without exception weighs 1 / (2 smoothing),
    some 1e8 times the rest. Such cells are counted (``strong``) instead of added, so
    opposite ones cancel exactly and do not swamp the other evidence.
    The ``hot`` map holds the vocabulary of the group.
    """
    keys, y = list(keys), ref(label)
    parts = []
    for i, f in enumerate(numeric):
        x = ref(f).cast("double")
        parts.append(F.var_pop(x).alias(f"v{i}"))
        for k in (0, 1):
            x_k = F.when(y == k, x)
            parts += [F.avg(x_k).alias(f"m{k}_{i}"), F.var_pop(x_k).alias(f"v{k}_{i}")]
    grouped = df.groupBy(*keys).agg(F.count_if(y == 0).alias("n0"), F.count_if(y == 1).alias("n1"), *parts)
    if categorical:
        cells = F.array(*[_hot_key(c, ref(c)) for c in categorical])
        shown = (
            df.select(*keys, y.alias("y"), F.explode(cells).alias("value"))
            .where(F.col("value").isNotNull())
            .groupBy(*keys, "value")
            .agg(F.count_if(F.col("y") == 0).alias("h0"), F.count_if(F.col("y") == 1).alias("h1"))
            .groupBy(*keys)
            .agg(F.sort_array(F.collect_list(F.struct("value", "h0", "h1"))).alias("shown"))
        )
        grouped = join_same(grouped, shown if keys else F.broadcast(shown), keys, "left")
    else:
        grouped = grouped.withColumn("shown", F.array().cast("array<struct<value:string,h0:bigint,h1:bigint>>"))
    return weigh_evidence(grouped, numeric, keys)


def weigh_evidence(grouped: DataFrame, numeric: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """The fitted model from each group's moments: ``n0``, ``n1``, ``v<i>``, ``m<k>_<i>``, ``v<k>_<i>`` and ``shown``.

    ``shown`` lists the values of categorical columns (``column=value``) with their rows of each class; NULL is none.
    """
    grouped = grouped.withColumn("shown", F.coalesce("shown", F.array().cast("array<struct<value:string,h0:bigint,h1:bigint>>")))
    n0, n1 = F.col("n0").cast("double"), F.col("n1").cast("double")
    order = range(len(numeric))

    def spread(h: Column) -> Column:
        p = (h["h0"] + h["h1"]) / (n0 + n1)
        return p * (1.0 - p)

    widest = F.array_max(
        F.concat(F.array(*[F.col(f"v{i}") for i in order]).cast("array<double>"),
                 F.transform("shown", spread))
    )
    with_smoothing = grouped.where((n0 > 0) & (n1 > 0)).withColumn("smoothing", widest * VAR_SMOOTHING)
    smoothing = F.col("smoothing")

    def hot(h: Column) -> Column:
        p0, p1 = h["h0"] / n0, h["h1"] / n1
        v0, v1 = p0 * (1.0 - p0) + smoothing, p1 * (1.0 - p1) + smoothing

        def at(x: float, never0: Column, never1: Column) -> tuple[Column, Column]:
            """(evidence, strong) of a cell ``x`` that classes 0 and 1 never show."""
            zero, cell = F.lit(0.0), F.lit(x)
            small = F.when(never0, zero).otherwise(_distance(cell, p0, v0)) - F.when(never1, zero).otherwise(
                _distance(cell, p1, v1)
            )
            return small + (F.ln(v0) - F.ln(v1)) / 2.0, never0.cast("int") - never1.cast("int")

        cold, cold_strong = at(0.0, h["h0"] == F.col("n0"), h["h1"] == F.col("n1"))
        warm, warm_strong = at(1.0, h["h0"] == 0, h["h1"] == 0)
        return F.struct(
            h["value"].alias("value"), cold.alias("cold"), cold_strong.alias("cold_strong"),
            F.struct((warm - cold).alias("gain"), (warm_strong - cold_strong).alias("strong")).alias("change"),
        )

    weighed = with_smoothing.withColumn("weighed", F.transform("shown", hot))

    def total(field: str, zero: Column) -> Column:
        return F.aggregate(F.transform("weighed", lambda w: w[field]), zero, lambda a, b: a + b)

    return weighed.select(
        *keys,
        "smoothing",
        (F.ln(n1) - F.ln(n0) + total("cold", F.lit(0.0))).alias("offset"),
        total("cold_strong", F.lit(0)).alias("offset_strong"),
        F.map_from_entries(F.transform("weighed", lambda w: F.struct(w["value"], w["change"]))).alias("hot"),
        *[F.array(*[F.col(f"m{k}_{i}") for i in order]).alias(f"means{k}") for k in (0, 1)],
        *[F.array(*[F.col(f"v{k}_{i}") + smoothing for i in order]).alias(f"vars{k}") for k in (0, 1)],
    )


FITTED = ("smoothing", "offset", "offset_strong", "hot", "means0", "means1", "vars0", "vars1")


def log_odds(numeric: Sequence[str], categorical: Sequence[str] | Mapping[str, str]) -> Column:
    """Log posterior odds of class 1 for a row joined with its fitted group.

    A category that the training rows did not have adds nothing. ``categorical`` may map the fitted columns' names to
    those they have in the row.
    """
    total, strong = F.col("offset"), F.col("offset_strong")
    for i, f in enumerate(numeric):
        total = total + _evidence(
            ref(f).cast("double"), F.col("means0")[i], F.col("vars0")[i], F.col("means1")[i], F.col("vars1")[i]
        )
    for c in categorical:
        cell = categorical[c] if isinstance(categorical, Mapping) else c
        change = F.try_element_at("hot", _hot_key(c, ref(cell)))
        total = total + F.coalesce(change["gain"], F.lit(0.0))
        strong = strong + F.coalesce(change["strong"], F.lit(0))
    return total + F.when(strong == 0, F.lit(0.0)).otherwise(F.try_divide(strong, F.col("smoothing") * 2.0))


def score_gaussian_nb(
    df: DataFrame,
    fitted: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str] | Mapping[str, str] = (),
    keys: Sequence[str] = (),
) -> DataFrame:
    """``df`` with ``score``, the probability of class 1; NULL in groups whose training rows have one class only."""
    fitted = materialise(fitted, "naive-bayes")
    size = fitted.agg(F.count("*").alias("n"), F.sum(F.size("hot")).alias("values")).first()
    small = size["n"] <= BROADCAST_ROWS and (size["values"] or 0) <= BROADCAST_VALUES
    joined = join_same(df, F.broadcast(fitted) if small else fitted, list(keys), "left")
    odds = log_odds(numeric, categorical)
    return joined.withColumn("score", 1.0 / (1.0 + F.exp(-odds))).drop(*FITTED)
