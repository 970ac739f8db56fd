"""Exact order statistics of row digests, found without sorting the table.

Picking exactly k of n rows, or cutting n rows into folds whose sizes differ by
at most one, both come down to one number per group: the digest of the row at a
given rank. Digests are uniform, so that digest lies within a few standard
deviations of k / n: rows outside that window are only counted, map-side, and the
few inside are put in order. One scan is enough. If a window misses, or would be
too large for a task, prefix histograms (4096 buckets per group) narrow the rank
down instead. With the cutoffs known, the choice itself is a comparison inside a
projection: no row is ever shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.digests import PREFIX_DIGITS, digest_prefix
from ..sources.workspace import small_table

# Rows of one group that a single task may sort.
ROWS_PER_TASK = 1_000_000
DIGEST_DIGITS = 32


# Standard deviations that a window reaches to each side.
REACH = 6.0
# A group may have this many times fewer rows than the largest and still be in reach.
SMALLER_GROUPS = 4
WINDOW_DIGITS = 8


def window_around(share: float, most_rows: int) -> tuple[str, str]:
    """Digest prefixes between which the row at rank ``share * n`` is expected."""
    fewest = max(most_rows / SMALLER_GROUPS, 1.0)
    margin = REACH * math.sqrt(share * (1.0 - share) / fewest) + 2.0 / fewest
    scale = 16**WINDOW_DIGITS
    low, high = int(max(share - margin, 0.0) * scale), int(min(share + margin, 1.0) * scale)
    return f"{low:0{WINDOW_DIGITS}x}", f"{min(high, scale - 1):0{WINDOW_DIGITS}x}"


def fits_window(share: float, most_rows: int, rows_per_task: int = ROWS_PER_TASK) -> bool:
    low, high = window_around(share, most_rows)
    return (int(high, 16) - int(low, 16) + 1) / 16**WINDOW_DIGITS * most_rows <= rows_per_task


def outside_collapsed(digest: Column, windows: list[tuple[Column, Column]]) -> Column:
    """``digest`` within the ascending windows; one stand-in per gap, in sort order, elsewhere."""
    prefix = digest_prefix(digest, WINDOW_DIGITS)
    out = F.concat(windows[-1][1], F.lit("~"))
    for i in reversed(range(len(windows))):
        low, high = windows[i]
        gap = F.concat(windows[i - 1][1], F.lit("~")) if i else F.lit("")
        out = F.when(prefix < low, gap).when(prefix <= high, digest).otherwise(out)
    return out


def near_cutoffs(near: DataFrame, groups: list[str], wanted: Callable[[Column], Column]) -> tuple[list[dict], bool]:
    """Cutoffs from rows whose digests are collapsed outside the windows.

    Also tells whether every wanted rank fell into a window.
    """
    by_group = Window.partitionBy(*groups)
    counts = (
        near.groupBy(*groups, "digest")
        .agg(F.count("*").alias("held"))
        .withColumn("n", F.sum("held").over(by_group))
        .withColumn("upto", F.sum("held").over(by_group.orderBy("digest")))
    )
    hits = F.filter(
        wanted(F.col("n")), lambda r: (r > F.col("upto") - F.col("held")) & (r <= F.col("upto"))
    )
    found = counts.select(*groups, F.explode(hits).alias("rank"), F.col("digest").alias("cutoff"), "held").collect()
    rows = [r.asDict() for r in found]
    return rows, all(len(r["cutoff"]) == DIGEST_DIGITS for r in rows)


def digest_cutoffs(
    rows: DataFrame,
    groups: list[str],
    wanted: Callable[[Column], Column],
    rows_per_task: int = ROWS_PER_TASK,
) -> list[dict]:
    """The digests at the wanted ranks of every group, by prefix histograms.

    ``rows`` has the ``groups`` columns and a unique ``digest`` per group;
    ``wanted`` maps the row count of a group to an array of 1-based ranks (ranks
    outside 1..n are ignored). Returns one dict per (group, rank) with the group
    columns, ``rank``, ``cutoff`` and ``held``, the rows that share the cutoff's digest (1 if digests are unique).
    """
    by_group = Window.partitionBy(*groups)
    histogram = (
        rows.groupBy(*groups, digest_prefix("digest").alias("prefix"))
        .agg(F.count("*").alias("held"))
        .withColumn("n", F.sum("held").over(by_group))
        .withColumn("before", F.sum("held").over(by_group.orderBy("prefix")) - F.col("held"))
    )
    targets = histogram.withColumn("rank", F.explode(wanted(F.col("n")))).where(
        (F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("held"))
    )
    spark = rows.sparkSession
    fields = [f for f in rows.schema.fields if f.name in set(groups)]
    schema = T.StructType(
        [
            *fields,
            T.StructField("rank", T.LongType()),
            T.StructField("prefix", T.StringType()),
            T.StructField("held", T.LongType()),
            T.StructField("before", T.LongType()),
        ]
    )
    targets = targets.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])
    found = targets.collect()
    if not found:
        return []

    digits = PREFIX_DIGITS
    while max(r["held"] for r in found) > rows_per_task and digits < DIGEST_DIGITS:
        known = small_table(spark, found, schema)
        by_rank = Window.partitionBy(*groups, "rank")
        finer = (
            rows.withColumn("prefix", digest_prefix("digest", digits))
            .join(F.broadcast(known.drop("held")), [*groups, "prefix"])
            .groupBy(*groups, "rank", "before", digest_prefix("digest", digits + PREFIX_DIGITS).alias("prefix"))
            .agg(F.count("*").alias("held"))
            .withColumn("before", F.col("before") + F.sum("held").over(by_rank.orderBy("prefix")) - F.col("held"))
            .where((F.col("rank") > F.col("before")) & (F.col("rank") <= F.col("before") + F.col("held")))
        )
        found = finer.select(*schema.fieldNames()).collect()
        digits += PREFIX_DIGITS

    known = small_table(spark, found, schema)
    position = F.row_number().over(Window.partitionBy(*groups, "rank").orderBy("digest"))
    alike = F.count("*").over(Window.partitionBy(*groups, "rank", "digest"))
    cutoffs = (
        rows.withColumn("prefix", digest_prefix("digest", digits))
        .join(F.broadcast(known), [*groups, "prefix"])
        .drop("held")
        .withColumn("position", position + F.col("before"))
        .withColumn("held", alike)
        .where(F.col("position") == F.col("rank"))
        .select(*groups, "rank", F.col("digest").alias("cutoff"), "held")
    )
    return [r.asDict() for r in cutoffs.collect()]
