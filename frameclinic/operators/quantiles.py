"""Exact interpolated quantiles that never gather a column in one task.

An equi-depth sketch brackets the wanted rank, the bracket is sketched again until few cells are left in it, and those
are counted exactly. Every pass is a scan with map-side combined state; rows are not shuffled. There is one way for
every size: the room of a task decides how often brackets are narrowed, not what comes out.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import number, ref
from ..sources.workspace import small_table

# Distinct values that one task may hold, over all columns of a group.
VALUES_PER_TASK = 1_000_000
# Points of the equi-depth sketch; its rank error is a tenth of a step.
SKETCH_STEPS = 500


def between(low: float, high: float, share: float) -> float:
    """Linear interpolation from the nearer end, so that round numbers stay round."""
    gap = high - low
    return high - gap * (1.0 - share) if share >= 0.5 else low + gap * share


def narrowed_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    values_per_task: int = VALUES_PER_TASK,
    sketch_steps: int = SKETCH_STEPS,
    counts: dict[tuple, int] | None = None,
) -> dict[tuple, list[float | None]]:
    """{(key values..., column): [quantile per prob]} by bracketing ranks.

    ``counts`` are the non-null counts by the same keys, if they are known.
    """
    spark = df.sparkSession
    keys = list(keys)
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), number(ref(c)).alias("value")) for c in columns]
    )
    values = df.select(*keys, F.inline(cells)).where(F.col("value").isNotNull())
    ids = [*keys, "column"]
    if counts is None:
        counted = values.groupBy(*ids).agg(F.count("*").alias("n")).collect()
        counts = {tuple(r[k] for k in ids): r["n"] for r in counted}

    key_fields = [f for f in values.schema.fields if f.name in ids]
    key_fields.sort(key=lambda f: ids.index(f.name))
    schema = T.StructType(
        [
            *key_fields,
            T.StructField("bracket", T.IntegerType()),
            T.StructField("low", T.DoubleType()),
            T.StructField("high", T.DoubleType()),
            T.StructField("ranks", T.ArrayType(T.LongType())),
        ]
    )
    # One target per (group, column, 0-based rank); low/high NULL = open end.
    targets = {
        (*group, rank): {"rank": rank, "low": None, "high": None, "held": n}
        for group, n in counts.items()
        if n > 0
        for p in probs
        for rank in {int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1)}
    }
    answers: dict[tuple, float] = {}

    def brackets(open_targets: list[tuple]) -> tuple[list[list[tuple]], DataFrame]:
        """Targets that share a bracket, and the table of brackets."""
        shared: dict[tuple, list[tuple]] = {}
        for k in open_targets:
            shared.setdefault((*k[:-1], targets[k]["low"], targets[k]["high"]), []).append(k)
        rows = [
            [*bracket[:-2], i, *bracket[-2:], sorted(k[-1] for k in members)]
            for i, (bracket, members) in enumerate(shared.items())
        ]
        return list(shared.values()), small_table(spark, rows, schema)

    value, low, high = F.col("value"), F.col("low"), F.col("high")
    above_low = low.isNull() | (value > low)
    inside = above_low & (high.isNull() | (value < high))

    def bracketed(table: DataFrame) -> DataFrame:
        named = table.drop("ranks").withColumnsRenamed({k: f"__{k}" for k in ids})
        same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in ids]
        joined = values.join(F.broadcast(named), same)
        return joined.where(high.isNull() | (value <= high)).drop(*ids, *[f"__{k}" for k in ids])

    grid = [i / sketch_steps for i in range(sketch_steps + 1)]
    wide = [k for k, t in targets.items() if t["held"] > values_per_task]
    while wide:
        members, table = brackets(wide)
        sketched = (
            bracketed(table)
            .groupBy("bracket")
            .agg(
                F.count_if(~above_low).alias("upto_low"),
                F.count_if(inside).alias("inside"),
                F.approx_count_distinct(F.when(inside, value)).alias("distinct"),
                F.percentile_approx(F.when(inside, value), grid, sketch_steps * 10).alias("steps"),
            )
            .collect()
        )
        again = []
        for r in sketched:
            for k in members[r["bracket"]]:
                t = targets[k]
                offset = t["rank"] - r["upto_low"]
                # A bound that many rows share is the answer itself or is left behind.
                if offset < 0:
                    answers[k] = t["low"]
                elif offset >= r["inside"]:
                    answers[k] = t["high"]
                elif r["distinct"] > values_per_task // 2:
                    at = int(offset / max(r["inside"] - 1, 1) * sketch_steps)
                    # The outermost steps are only near the ends, so an end bracket keeps its old bound.
                    t["low"] = r["steps"][at - 1] if at >= 2 else t["low"]
                    t["high"] = r["steps"][at + 3] if at <= sketch_steps - 4 else t["high"]
                    again.append(k)
        wide = again

    left = [k for k in targets if k not in answers]
    if left:
        members, table = brackets(left)
        in_order = Window.partitionBy("bracket").orderBy(value.asc_nulls_first())
        upto = F.sum("count").over(in_order)
        picked = (
            bracketed(table)
            .groupBy("bracket", F.when(low.isNull() | (value >= low), value).alias("value"))
            .count()
            .select("bracket", "value", upto.alias("upto"), (upto - F.col("count")).alias("before"))
            .join(F.broadcast(table.select("bracket", "ranks")), "bracket")
            .select("bracket", "value", F.explode(
                F.filter("ranks", lambda r: (r >= F.col("before")) & (r < F.col("upto")))
            ).alias("rank"))
        )
        for r in picked.collect():
            answers[(*members[r["bracket"]][0][:-1], r["rank"])] = r["value"]

    result: dict[tuple, list[float | None]] = {}
    for group, n in counts.items():
        if n == 0:
            continue
        found = []
        for p in probs:
            rank, share = int(p * (n - 1)), p * (n - 1) - int(p * (n - 1))
            at, after = answers.get((*group, rank)), answers.get((*group, min(rank + 1, n - 1)))
            if at is None or after is None:
                raise RuntimeError(f"no value found at rank {rank} of {group}")
            found.append(at if share == 0 else between(at, after, share))
        result[group] = found
    return result


def exact_quantiles(
    df: DataFrame,
    columns: Sequence[str],
    probs: Sequence[float],
    keys: Sequence[str] = (),
    values_per_task: int = VALUES_PER_TASK,
) -> DataFrame:
    """One row per key group and column: ``column`` and ``quantiles`` (array in prob order).

    A group without any number in a column has NULL quantiles there; cells that are no numbers, NaN too, count as missing.

    The result has (groups x columns) rows; groups are expected to be a reporting
    or grid key, not data-sized.
    """
    keys = list(keys)
    cells = [F.count(number(ref(c))).alias(f"n{i}") for i, c in enumerate(columns)]
    counts = {
        (*[r[k] for k in keys], c): r[f"n{i}"] for r in df.groupBy(*keys).agg(*cells).collect() for i, c in enumerate(columns)
    }
    found = narrowed_quantiles(df, columns, probs, keys, values_per_task, counts=counts)
    fields = [f for k in keys for f in df.schema.fields if f.name == k]
    schema = T.StructType(
        [*fields, T.StructField("column", T.StringType()), T.StructField("quantiles", T.ArrayType(T.DoubleType()))]
    )
    return small_table(df.sparkSession, [[*k, found.get(k, [None] * len(probs))] for k in counts], schema)
