"""Exact ROC-AUC, ROC points and threshold metrics for any number of key groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import join_same, number, ref, whole_div
from ..sources.workspace import broadcast_if_small, materialise

# Distinct scores one task may order.
SCORES_PER_TASK = 2_000_000
# Thresholds 0.01 .. 0.98 and the threshold of the single report.
THRESHOLD_STEPS = 98
REPORT_THRESHOLD = 0.01


def ranked(score: Column) -> Column:
    """The score, or minus infinity where there is none (NULL, NaN or no number)."""
    return F.coalesce(number(score), F.lit(float("-inf")))


def score_counts(df: DataFrame, score: str, label: str, keys: Sequence[str] = (), alike: str | None = None) -> DataFrame:
    """Positives and negatives per distinct score; ties collapse before any ordering.

    A score that is missing (NULL, NaN or no number) ranks below all others, as one tie at -infinity. ``alike`` names a
    column that says how many rows a row stands for.
    """

    def of_class(k: int) -> Column:
        if alike is None:
            return F.count_if(ref(label) == k)
        return F.coalesce(F.sum(F.when(ref(label) == k, ref(alike))), F.lit(0))

    return df.groupBy(*keys, ranked(ref(score)).alias("score")).agg(of_class(1).alias("pos"), of_class(0).alias("neg"))


def in_ranges(counts: DataFrame, order: str, n: int, rows_per_task: int) -> DataFrame:
    """The ``n`` rows of ``counts`` with ``piece``, the ascending number of a value range of at most ``rows_per_task`` rows.

    Written. A task orders the rows of many ranges: ranges grow in number with the rows, tasks only where cores have
    more than ``SCORES_PER_TASK`` / 2 rows each.
    """
    cores = counts.sparkSession.sparkContext.defaultParallelism
    tasks = min(-(-n // rows_per_task), max(cores, -(-n // SCORES_PER_TASK) * 2))
    ordered = counts.repartitionByRange(max(1, tasks), order).sortWithinPartitions(order)
    # the number of a row: its task, then its place there, of which no task has 2 ** 33
    piece = whole_div(F.monotonically_increasing_id(), rows_per_task)
    return materialise(ordered.withColumn("piece", piece), "ranges")


def running_sums(
    counts: DataFrame,
    keys: Sequence[str],
    order: str,
    values: Sequence[str],
    descending: bool = False,
    rows_per_task: int = SCORES_PER_TASK,
) -> DataFrame:
    """Adds ``<value>_before``: the sum over the rows that come strictly earlier.

    ``counts`` has one row per key group and ``order`` value and is read several
    times, so hand in a written table. Where a key group has more than
    ``rows_per_task`` rows the order is cut into value ranges: each range is summed
    by itself and shifted by the totals of the ranges before it.
    """
    keys = list(keys)
    direction = F.desc if descending else F.asc
    sizes = counts.groupBy(*keys).agg(F.count("*").alias("rows")).agg(F.sum("rows").alias("n"), F.max("rows").alias("most")).first()
    n = sizes["n"] or 0
    if (sizes["most"] or 0) <= rows_per_task:
        window = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(direction(order))
        return counts.select("*", *[(F.sum(v).over(window) - F.col(v)).alias(f"{v}_before") for v in values])

    ranged = in_ranges(counts, order, n, rows_per_task)
    totals = ranged.groupBy(*keys, "piece").agg(*[F.sum(v).alias(v) for v in values])
    # At most one row per key group and piece.
    across = Window.partitionBy(*(keys or [F.lit(0)])).orderBy(direction("piece"))
    shifts = totals.select(
        *keys, "piece", *[(F.sum(v).over(across) - F.col(v)).alias(f"{v}_shift") for v in values]
    )
    within = Window.partitionBy(*keys, "piece").orderBy(direction(order))
    inside = ranged.select("*", *[(F.sum(v).over(within) - F.col(v)).alias(f"{v}_inside") for v in values])
    return join_same(inside, shifts, [*keys, "piece"]).select(
        *[ref(c) for c in counts.columns],
        *[(F.col(f"{v}_inside") + F.col(f"{v}_shift")).alias(f"{v}_before") for v in values],
    )


def roc_auc(
    df: DataFrame,
    score: str,
    label: str,
    keys: Sequence[str] = (),
    rows_per_task: int = SCORES_PER_TASK,
    alike: str | None = None,
) -> DataFrame:
    """Area under the ROC curve per key group; tied scores count half. NULL with one class only or without any score.

    ``alike`` names a column that says how many rows a row stands for.
    """
    counts = materialise(score_counts(df, score, label, keys, alike), "scores")
    ordered = running_sums(counts, keys, "score", ["neg"], rows_per_task=rows_per_task)
    wins = F.col("pos") * (F.col("neg_before") + F.col("neg") / 2.0)
    return (
        ordered.groupBy(*keys)
        .agg(
            F.sum("pos").alias("n_pos"),
            F.sum("neg").alias("n_neg"),
            # no score at all, no curve
            F.when(F.max("score") > float("-inf"), F.sum(wins)).alias("wins"),
        )
        .select(
            *keys,
            "n_pos",
            "n_neg",
            F.try_divide(F.col("wins"), F.col("n_pos").cast("double") * F.col("n_neg")).alias("auc"),
        )
    )


def roc_points(
    df: DataFrame,
    score: str,
    label: str,
    keys: Sequence[str] = (),
    rows_per_task: int = SCORES_PER_TASK,
    corners: bool = False,
) -> DataFrame:
    """(fpr, tpr, threshold) per distinct score: rates when predicting score >= threshold.

    Every curve starts at (0, 0), with the threshold infinity. With ``corners`` points on the straight line between
    their neighbours are left out, as are scores that no labelled row has; the area stays the same.
    """
    counts = materialise(score_counts(df, score, label, keys), "scores")
    told = counts
    if corners:
        told = materialise(with_corners(counts.where("pos + neg > 0"), keys, rows_per_task), "corners")
    ordered = running_sums(
        told, keys, "score", ["pos", "neg"], descending=True, rows_per_task=rows_per_task
    )
    if corners:
        ordered = ordered.where("corner")
    totals = counts.groupBy(*keys).agg(F.sum("pos").alias("n_pos"), F.sum("neg").alias("n_neg"))
    joined = join_same(ordered, broadcast_if_small(totals), list(keys))
    start = totals.select(
        *keys,
        F.lit(float("inf")).alias("threshold"),
        F.when(F.col("n_neg") > 0, 0.0).alias("fpr"),
        F.when(F.col("n_pos") > 0, 0.0).alias("tpr"),
    )
    points = joined.select(
        *keys,
        F.col("score").alias("threshold"),
        F.try_divide(F.col("neg_before") + F.col("neg"), F.col("n_neg")).alias("fpr"),
        F.try_divide(F.col("pos_before") + F.col("pos"), F.col("n_pos")).alias("tpr"),
    )
    return points.unionByName(start)


def with_corners(counts: DataFrame, keys: Sequence[str], rows_per_task: int = SCORES_PER_TASK) -> DataFrame:
    """Adds ``corner``: does the curve turn at this score, or end there?

    A score's step on the curve is (neg, pos); it turns where the next lower score's step has another direction. Scores
    are looked at in value ranges, and the last one of a range is compared with the first of the next range that has any.
    """
    keys, n = list(keys), counts.count()
    ranged = in_ranges(counts, "score", n, rows_per_task)
    step = F.struct("pos", "neg")
    within = ranged.withColumn("next", F.lead(step).over(Window.partitionBy(*keys, "piece").orderBy(F.desc("score"))))
    firsts = ranged.groupBy(*keys, "piece").agg(F.max_by(step, "score").alias("first"))
    beyond = F.lead("first").over(Window.partitionBy(*(keys or [F.lit(0)])).orderBy(F.desc("piece")))  # a row for each range
    firsts = firsts.select(*keys, "piece", beyond.alias("after"))
    joined = join_same(within, firsts, [*keys, "piece"]).withColumn("next", F.coalesce("next", "after"))
    exact = "decimal(38,0)"
    straight = F.col("pos").cast(exact) * F.col("next.neg") == F.col("neg").cast(exact) * F.col("next.pos")
    return joined.select(*keys, "score", "pos", "neg", (~F.coalesce(straight, F.lit(False))).alias("corner"))


def thresholds_below(score: Column) -> Column:
    """How many of the thresholds i/100, i = 1..98, are below ``score``; a missing score is above none.

    Compares with the thresholds themselves, so a score equal to one is not above it.
    """
    score = F.least(F.greatest(ranked(score), F.lit(0.0)), F.lit(1.0))
    near = F.floor(score * 100.0)
    exact = (
        near
        + F.when(score > (near + 1) / 100.0, 1).otherwise(0)
        - F.when(score <= near / 100.0, 1).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(THRESHOLD_STEPS), exact)).cast("int")


def threshold_metrics(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """Recall of both classes and accuracy at each threshold i/100.

    One pass counts rows per score step (at most 99 per key group); the steps, not
    the rows, are then compared with the thresholds.
    """
    steps = df.groupBy(*keys, thresholds_below(ref(score)).alias("above")).agg(
        F.count_if(ref(label) == 1).alias("pos"), F.count_if(ref(label) == 0).alias("neg")
    )
    per_step = steps.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(THRESHOLD_STEPS))))
    hit = F.col("above") >= F.col("step")
    counted = per_step.groupBy(*keys, "step").agg(
        F.sum("pos").alias("n_pos"),
        F.sum("neg").alias("n_neg"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("tp"),
        F.sum(F.when(~hit, F.col("neg")).otherwise(0)).alias("tn"),
    )
    zero = F.lit(0.0)
    recall0 = F.coalesce(F.try_divide(F.col("tn"), F.col("n_neg")), zero)
    recall1 = F.coalesce(F.try_divide(F.col("tp"), F.col("n_pos")), zero)
    return counted.select(
        *keys,
        "step",
        (F.col("step") / 100.0).alias("threshold"),
        recall0.alias("recall0"),
        recall1.alias("recall1"),
        ((F.col("tp") + F.col("tn")) / (F.col("n_pos") + F.col("n_neg"))).alias("accuracy"),
        F.abs(recall0 - recall1).alias("diff"),
    )


def threshold_search(df: DataFrame, score: str, label: str, keys: Sequence[str] = ()) -> DataFrame:
    """The first threshold with the smallest recall gap; zeros if no gap is below 1."""
    ranked = F.struct("diff", "step", "threshold", "recall0", "recall1", "accuracy")
    best = threshold_metrics(df, score, label, keys).groupBy(*keys).agg(
        F.min(F.when(F.col("diff") < 1.0, ranked)).alias("best")
    )
    return best.select(
        *keys,
        *[F.coalesce(F.col("best")[c], F.lit(0.0)).alias(c) for c in ("threshold", "recall0", "recall1", "accuracy")],
    )


def threshold_report(
    df: DataFrame, score: str, label: str, keys: Sequence[str] = (), threshold: float = REPORT_THRESHOLD
) -> DataFrame:
    """Precision, recall, F1 and support per class, with accuracy and averages; a missing score is below the threshold."""
    said = ranked(ref(score)) > threshold
    y = ref(label)
    zero = F.lit(0.0)

    def ratio(a: Column, b: Column) -> Column:
        return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), zero)

    counts = df.groupBy(*keys).agg(
        F.count_if((y == 1) & said).alias("tp"),
        F.count_if((y == 0) & said).alias("fp"),
        F.count_if((y == 1) & ~said).alias("fn"),
        F.count_if((y == 0) & ~said).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    rated = counts.select(
        *keys,
        (tn + fp).alias("s0"), (tp + fn).alias("s1"),
        ratio(tn, tn + fn).alias("p0"), ratio(tp, tp + fp).alias("p1"),
        ratio(tn, tn + fp).alias("r0"), ratio(tp, tp + fn).alias("r1"),
        ratio(2 * tn, 2 * tn + fn + fp).alias("f0"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
        ratio(tp + tn, tp + tn + fp + fn).alias("acc"),
    )
    s0, s1 = F.col("s0"), F.col("s1")

    def line(name: str, precision: Column, recall: Column, f1: Column, support: Column) -> Column:
        return F.struct(
            F.lit(name).alias("class"), precision.alias("precision"), recall.alias("recall"),
            f1.alias("f1"), support.alias("support"),
        )

    def macro(kind: str) -> Column:
        return (F.col(f"{kind}0") + F.col(f"{kind}1")) / 2.0

    def weighted(kind: str) -> Column:
        return ratio(F.col(f"{kind}0") * s0 + F.col(f"{kind}1") * s1, s0 + s1)

    none = F.lit(None).cast("double")
    lines = F.array(
        line("0", F.col("p0"), F.col("r0"), F.col("f0"), s0),
        line("1", F.col("p1"), F.col("r1"), F.col("f1"), s1),
        line("accuracy", none, none, F.col("acc"), s0 + s1),
        line("macro avg", macro("p"), macro("r"), macro("f"), s0 + s1),
        line("weighted avg", weighted("p"), weighted("r"), weighted("f"), s0 + s1),
    )
    return rated.select(*keys, F.inline(lines))
