"""Seeded stratified folds as a column, for any number of seeds at once.

Within each class rows are ordered by a digest of (seed, key) and cut into k runs
whose sizes differ by at most one. Only the k - 1 cutoff digests per seed and
class are computed; a row finds its fold by comparing its digest with them.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import ref, whole_div
from ..functions.digests import row_digest
from ..sources.workspace import small_table, spread
from .cutoffs import ROWS_PER_TASK, digest_cutoffs, fits_window, near_cutoffs, outside_collapsed, window_around

# Classes a label may have: seeds x classes x folds cutoffs are broadcast.
MAX_CLASSES = 1_000


def fold_table(
    df: DataFrame,
    row_key: str,
    label: str,
    folds: int,
    seeds: Sequence[int],
    rows_per_task: int = ROWS_PER_TASK,
) -> DataFrame:
    """One row per seed and class: ``cv_repeat``, ``cv_seed``, label, ``cuts``."""
    spark = df.sparkSession
    label_type = df.schema[label].dataType
    classes = df.groupBy(ref(label).alias(label)).count().limit(MAX_CLASSES + 1).collect()
    if len(classes) > MAX_CLASSES:
        raise ValueError(f"{label!r} has more than {MAX_CLASSES} classes")
    seed_table = small_table(
        spark, [[s] for s in seeds], T.StructType([T.StructField("cv_seed", T.IntegerType())])
    )
    n_rows = sum(r["count"] for r in classes)
    rows = spread(df.select(ref(row_key), ref(label)), n_rows).crossJoin(F.broadcast(seed_table)).select(
        "cv_seed", ref(label).alias("class"), row_digest(F.col("cv_seed"), F.lit("fold"), ref(row_key)).alias("digest")
    )

    def wanted(n: Column) -> Column:
        """Ranks of the last row of each fold but the last."""
        # Row r (from 0) is in fold r*k div n, so fold f starts at ceil(f*n/k).
        return F.array(*[whole_div(n * f + (folds - 1), folds) for f in range(1, folds)])

    # A class much smaller than the largest may fall outside; the exact search follows.
    sizes = [r["count"] for r in classes] or [0]
    shares = [f / folds for f in range(1, folds)]
    found, complete = [], not shares
    if shares and all(fits_window(p, max(sizes), rows_per_task) for p in shares):
        edges = _separate([window_around(p, max(sizes)) for p in shares])
        windows = [(F.lit(low), F.lit(high)) for low, high in edges]
        near = rows.withColumn("digest", outside_collapsed(F.col("digest"), windows))
        found, complete = near_cutoffs(near, ["cv_seed", "class"], wanted)
    if not complete:
        found = digest_cutoffs(rows, ["cv_seed", "class"], wanted, rows_per_task)
    cuts: dict[tuple, list[tuple[int, str]]] = {}
    for r in found:
        cuts.setdefault((r["cv_seed"], r["class"]), []).append((r["rank"], r["cutoff"]))
    schema = T.StructType(
        [
            T.StructField("cv_repeat", T.IntegerType()),
            T.StructField("cv_seed", T.IntegerType()),
            T.StructField(label, label_type),
            T.StructField("cuts", T.ArrayType(T.StringType())),
        ]
    )
    table = []
    for i, s in enumerate(seeds, start=1):
        for c in classes:
            n, found = c["count"], dict(cuts.get((s, c[label]), []))
            # A class smaller than k leaves folds empty; rank 0 has no row, nothing is below it.
            ends = [(n * f + folds - 1) // folds for f in range(1, folds)]
            table.append([i, s, c[label], [found.get(e, "") for e in ends]])
    return small_table(spark, table, schema)


def _separate(windows: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """Merge windows that overlap."""
    out: list[tuple[str, str]] = []
    for low, high in windows:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]))
        else:
            out.append((low, high))
    return out


def fold_column(row_key: str, folds: int) -> Column:
    """0-based fold of a row joined with its ``fold_table`` row: the cutoffs below its digest."""
    digest = row_digest(F.col("cv_seed"), F.lit("fold"), ref(row_key))
    fold = F.lit(0)
    for i in range(folds - 1):
        fold = fold + (digest > F.col("cuts")[i]).cast("int")
    return fold


def assign_folds(
    df: DataFrame,
    row_key: str,
    label: str,
    folds: int,
    seeds: Sequence[int],
    table: DataFrame | None = None,
) -> DataFrame:
    """``df`` once per seed, with ``cv_repeat``, ``cv_seed`` and ``fold``."""
    table = fold_table(df, row_key, label, folds, seeds) if table is None else table
    table = table.withColumnRenamed(label, "__class")
    return (
        df.join(F.broadcast(table), ref(label).eqNullSafe(F.col("__class")))
        .withColumn("fold", fold_column(row_key, folds))
        .select("cv_repeat", "cv_seed", "fold", *[ref(c) for c in df.columns])
    )


def hash_split(df: DataFrame, row_key: str, seed: int, train_percent: int = 80) -> DataFrame:
    """Seeded hold-out split: ``in_training`` by the row's digest."""
    number = F.conv(F.substring(row_digest(F.lit(seed), F.lit("split"), ref(row_key)), 1, 7), 16, 10).cast("long")
    return df.withColumn("in_training", number % 100 < train_percent)
