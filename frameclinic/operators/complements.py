"""Statistics of every fold's training side from states of the folds, without copying a row per held-out fold.

A training side is all folds but one. Counts subtract: all less the held-out fold. Moments merge: those of the other
folds, pairwise, so nothing cancels. Order statistics come from one table of distinct values with a vector of counts,
one entry a fold, and the running sums of those vectors: the rank of a value on any training side is all less its fold's
entry, so one pass over the table finds the ranks of all sides.

Outlier bounds differ a little from side to side. Cells inside all of a column's bounds are summed once per fold; only
those between the tightest and the widest bounds are looked at once per side.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, join_same, nan_to_null, ref
from ..sources.workspace import BROADCAST_ROWS, materialise, small_table
from ..specs import CATEGORY_FILL, IQR_MULTIPLIER, MIN_FREQUENCY, MIN_UNIQUE, RECIPES, recipe
from .cleaning import MAX_CATEGORIES, CategoryStats, FittedCleaning, NumericStats
from .naive_bayes import weigh_evidence
from .quantiles import VALUES_PER_TASK, between

#: Classes 0 and 1, and whatever else a label may be (a missing one above all).
CLASSES = 3

Moments = tuple[int, float, float]
NOTHING: Moments = (0, 0.0, 0.0)


def merge(parts: Iterable[Moments]) -> Moments:
    """Count, mean and population variance of the union of disjoint parts."""
    n, mean, square = 0, 0.0, 0.0
    for m, other, var in parts:
        if m:
            gap, total = other - mean, n + m
            square += m * var + gap * gap * n * m / total
            mean, n = mean + gap * m / total, total
    return n, mean, square / n if n else 0.0


def _moments(row, name: str) -> Moments:
    n = row[f"n_{name}"]
    return (n, row[f"m_{name}"], row[f"v_{name}"]) if n else NOTHING


def _joined(df: DataFrame, table: DataFrame, keys: Sequence[str], rows: int) -> DataFrame:
    """``df`` with the columns of a table of ``rows`` rows, one for each of the ``keys``."""
    return join_same(df, F.broadcast(table) if rows <= BROADCAST_ROWS or not keys else table, keys)


def value_counts_by_fold(cells: DataFrame, ids: Sequence[str], folds: int) -> DataFrame:
    """One row for each of ``ids`` and value: ``c0``, ``c1``, ... count it in each fold."""
    return cells.groupBy(*ids, "value").agg(*[F.count_if(F.col("fold") == f).alias(f"c{f}") for f in range(folds)])


def with_running_counts(counts: DataFrame, ids: Sequence[str], folds: int, cells: int, rows_per_task: int) -> DataFrame:
    """Adds ``b0``, ``b1``, ...: each fold's cells with a smaller value. Written, as it is read several times.

    The order of all values is cut into ranges of at most about ``rows_per_task`` rows. Each is summed by its own task
    and shifted by the totals of the ranges before it, so no group needs to fit a task.
    """
    ids, each = list(ids), range(folds)
    pieces = max(1, -(-cells // rows_per_task))
    ranged = counts.repartitionByRange(pieces, *ids, "value").withColumn("piece", F.spark_partition_id())
    ranged = materialise(ranged, "value-counts")
    totals = ranged.groupBy(*ids, "piece").agg(*[F.sum(f"c{f}").alias(f"t{f}") for f in each])
    across = Window.partitionBy(*ids).orderBy("piece")  # a row for each range
    shifts = totals.select(*ids, "piece", *[(F.sum(f"t{f}").over(across) - F.col(f"t{f}")).alias(f"s{f}") for f in each])
    # a value stands once: rows before it are those with a smaller value
    within = Window.partitionBy(*ids, "piece").orderBy("value").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    inside = ranged.select("*", *[(F.sum(f"c{f}").over(within) - F.col(f"c{f}")).alias(f"i{f}") for f in each])
    joined = join_same(inside, shifts, [*ids, "piece"])
    counted = [F.col(f"c{f}") for f in each]
    return materialise(
        joined.select(*ids, "value", *counted, *[(F.col(f"i{f}") + F.col(f"s{f}")).alias(f"b{f}") for f in each]), "running-counts"
    )


def _side(kind: str, held_out: int, folds: int) -> Column:
    """``c`` or ``b`` of the training side that leaves ``held_out`` out."""
    return reduce(Column.__add__, [F.col(f"{kind}{f}") for f in range(folds) if f != held_out], F.lit(0).cast("long"))


def values_at_ranks(running: DataFrame, ids: Sequence[str], folds: int, wanted: dict[tuple, dict[int, set[int]]]) -> dict[tuple, float]:
    """{(id values..., held_out, rank): value} for 0-based ranks of training sides, in one pass.

    ``wanted`` has for each id and held-out fold the ranks that are looked for.
    """
    schema = running.select(*ids).schema
    kind = T.ArrayType(T.StructType([T.StructField("side", T.IntegerType()), T.StructField("rank", T.LongType())]))
    rows = [[*k, [{"side": h, "rank": r} for h, ranks in sides.items() for r in sorted(ranks)]] for k, sides in wanted.items()]
    rows = [r for r in rows if r[-1]]
    if not rows:
        return {}
    most = max(len(ranks) for sides in wanted.values() for ranks in sides.values())
    # the same ranks, side by side at fixed places; no row has rank -1
    flat = [[r for h in range(folds) for r in [*sorted(sides.get(h, ())), *[-1] * most][:most]] for sides in wanted.values() if any(sides.values())]
    fields = [*schema.fields, T.StructField("wanted", kind), T.StructField("ranks", T.ArrayType(T.LongType()))]
    table = small_table(running.sparkSession, [[*r, f] for r, f in zip(rows, flat)], T.StructType(fields))
    joined = _joined(running, table, ids, len(rows))
    befores, counts = ([_side(kind, h, folds) for h in range(folds)] for kind in "bc")

    def met(h: int, j: int) -> Column:
        rank = F.col("ranks")[h * most + j]
        return (rank >= befores[h]) & (rank < befores[h] + counts[h])

    # Hardly any row has a wanted rank: plain comparisons find those, only they are looked at side by side.
    joined = joined.where(reduce(Column.__or__, [met(h, j) for h in range(folds) for j in range(most)]))
    joined = joined.select(*ids, "value", "wanted", F.array(*befores).alias("before"), F.array(*counts).alias("count"))

    def here(t: Column) -> Column:
        first = F.get("before", t["side"])
        return (t["rank"] >= first) & (t["rank"] < first + F.get("count", t["side"]))

    found = joined.select(*ids, "value", F.inline(F.filter("wanted", here)))
    return {(*(r[k] for k in ids), r["side"], r["rank"]): r["value"] for r in found.collect()}


def _ranks(n: int, probs: Sequence[float]) -> set[int]:
    return {r for p in probs for r in (int(p * (n - 1)), min(int(p * (n - 1)) + 1, n - 1))} if n else set()


def _quantile(at: Callable[[int], float], n: int, p: float) -> float:
    rank = int(p * (n - 1))
    share = p * (n - 1) - rank
    return at(rank) if share == 0 else between(at(rank), at(min(rank + 1, n - 1)), share)


@dataclass(frozen=True)
class ComplementFit:
    """What every training side learned: ``cleaning`` for recipes, the rest for naive Bayes."""

    cleaning: FittedCleaning
    keys: tuple[str, ...]
    folds: int
    #: {(key values..., held_out): rows of class 0 and of class 1}
    class_rows: dict[tuple, tuple[int, int, int]]
    #: {(key values..., held_out): {column: moments of each class}}, of all cells and of those that outlier removal keeps
    present: dict[tuple, dict[str, list[Moments]]]
    kept: dict[tuple, dict[str, list[Moments]]]
    #: keys, held_out, column, value, rows of each class (k0..k2), valid, mode; None without categorical columns
    vocabulary: DataFrame | None

    def naive_bayes(self, spark, tried: Callable[[tuple], Sequence[str]]) -> DataFrame:
        """Gaussian naive Bayes of every training side and method, as ``fit_gaussian_nb`` gives it.

        ``tried`` says which methods a key group is cleaned with. Mean and variance of a cleaned column follow from the
        moments of its present cells and the number of filled ones, so no cleaned row is made.
        """
        numeric, groups = self.cleaning.numeric, self.cleaning.groups
        columns = [f"v{i}" for i in range(len(numeric))] + [f"{x}{k}_{i}" for i in range(len(numeric)) for k in (0, 1) for x in "mv"]
        schema = T.StructType(
            [*self.cleaning.key_schema.fields, T.StructField("method", T.StringType())]
            + [T.StructField(c, T.LongType()) for c in ("n0", "n1")]
            + [T.StructField(c, T.DoubleType()) for c in columns]
        )
        rows = []
        for g in groups:
            for method in tried(g[: len(self.keys)]):
                r, row = recipe(method), {}
                for i, c in enumerate(numeric):
                    stats = self.cleaning.numeric_stats[g][c]
                    fill = stats.fill(r.remove, r.fill)
                    fill = 0.0 if fill is None else fill
                    centre, scale = stats.centre_scale(r.remove, r.fill) if r.norm else (0.0, 1.0)
                    parts = []
                    for k, cells in enumerate((self.kept if r.remove else self.present)[g][c]):
                        n, mean, var = merge([cells, (self.class_rows[g][k] - cells[0], fill, 0.0)])
                        parts.append((n, (mean - centre) / scale, var / scale**2))
                    row[f"v{i}"] = merge(parts)[2]
                    for k in (0, 1):
                        row[f"m{k}_{i}"], row[f"v{k}_{i}"] = parts[k][1:] if parts[k][0] else (None, None)
                rows.append([*g, method, *self.class_rows[g][:2], *[row[c] for c in columns]])
        grouped = small_table(spark, rows, schema)
        ids = [*self.keys, "held_out", "method"]
        if self.vocabulary is None:
            shown = F.array().cast("array<struct<value:string,h0:bigint,h1:bigint>>")
            return weigh_evidence(grouped.withColumn("shown", shown), numeric, ids)
        methods = list(dict.fromkeys(m for r in rows for m in (r[len(ids) - 1],)))

        def entry(method: str) -> Column:
            r, value = recipe(method), F.col("value")
            if r.remove:
                value = F.when((F.size("valid") == 0) | F.array_contains("valid", value), value)
            return F.struct(F.lit(method).alias("method"), F.coalesce(value, F.col("mode") if r.fill else F.lit(CATEGORY_FILL)).alias("cleaned"))

        cleaned = self.vocabulary.select(*self.keys, "held_out", "column", "k0", "k1", F.inline(F.array(*map(entry, methods))))
        cleaned = cleaned.where("cleaned is not null").groupBy(*ids, F.concat("column", F.lit("="), "cleaned").alias("value"))
        cleaned = cleaned.agg(F.sum("k0").alias("h0"), F.sum("k1").alias("h1")).groupBy(*ids)
        shown = cleaned.agg(F.sort_array(F.collect_list(F.struct("value", "h0", "h1"))).alias("shown"))
        return weigh_evidence(join_same(grouped, shown, ids, "left"), numeric, ids)


def fit_complements(
    rows: DataFrame,
    numeric: Sequence[str],
    categorical: Sequence[str],
    label: str,
    keys: Sequence[str],
    folds: int,
    methods: Sequence[str] = tuple(RECIPES),
    iqr_multiplier: float = IQR_MULTIPLIER,
    min_unique: int = MIN_UNIQUE,
    min_frequency: float = MIN_FREQUENCY,
    values_per_task: int = VALUES_PER_TASK,
) -> ComplementFit:
    """What ``methods`` need, for every ``keys`` group and held-out fold, from ``rows`` that stand once with their ``fold``.

    The same answers as ``fit_cleaning`` over each fold's training rows. NULL keys are groups of their own; a label that
    is neither 0 nor 1 counts in all statistics but those of the classes.
    """
    keys, numeric, categorical = list(keys), list(numeric), list(categorical)
    recipes = [recipe(m) for m in methods]
    removing = any(r.remove for r in recipes)
    by_median = any(r.fill for r in recipes)
    kind = F.when(ref(label) == 0, 0).when(ref(label) == 1, 1).otherwise(2).cast("int")
    source = nan_to_null(rows.select(*keys, "fold", *[as_double(ref(c)).alias(f"x{i}") for i, c in enumerate(numeric)], *[ref(c).cast("string").alias(f"y{i}") for i, c in enumerate(categorical)], kind.alias("class")))
    source = materialise(source, "folded")
    spark = source.sparkSession
    key_fields = source.select(*keys).schema.fields
    held = T.StructField("held_out", T.IntegerType())

    def states(some: DataFrame, cells: dict[str, Column]) -> dict[tuple, object]:
        """{(key values..., fold, class): row}"""
        parts = [f(v).alias(f"{x}_{name}") for name, v in cells.items() for x, f in (("n", F.count), ("m", F.avg), ("v", F.var_pop))]
        found = some.groupBy(*keys, "fold", "class").agg(F.count("*").alias("rows"), *parts).collect()
        return {(*(r[k] for k in keys), r["fold"], r["class"]): r for r in found}

    first = states(source, {f"x{i}": F.col(f"x{i}") for i in range(len(numeric))})
    bases = list(dict.fromkeys(k[:-2] for k in first))
    sides = [(*b, h) for b in bases for h in range(folds)]

    def of_side(found: dict, side: tuple, k: int, name: str) -> list[Moments]:
        return [_moments(found[(*side[:-1], f, k)], name) for f in range(folds) if f != side[-1] and (*side[:-1], f, k) in found]

    class_rows = {
        s: tuple(sum(first[(*s[:-1], f, k)]["rows"] for f in range(folds) if f != s[-1] and (*s[:-1], f, k) in first) for k in range(CLASSES))
        for s in sides
    }
    sides = [s for s in sides if sum(class_rows[s])]
    present = {s: {c: [merge(of_side(first, s, k, f"x{i}")) for k in range(CLASSES)] for i, c in enumerate(numeric)} for s in sides}
    whole = {s: {c: merge(present[s][c]) for c in numeric} for s in sides}

    stats = {s: {} for s in sides}
    kept = present
    if numeric:
        ids = [*keys, "column"]
        probs = [0.25, 0.5, 0.75] if removing else ([0.5] if by_median else [])
        found, distinct, running = {}, {}, None
        if probs:
            cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"x{i}").alias("value")) for i, c in enumerate(numeric)])
            long = source.select(*keys, "fold", F.inline(cells)).where("value is not null")
            n_cells = sum(r[f"n_x{i}"] for r in first.values() for i in range(len(numeric)))
            running = with_running_counts(value_counts_by_fold(long, ids, folds), ids, folds, n_cells, values_per_task)
            wanted: dict[tuple, dict[int, set[int]]] = {}
            for s in sides:
                for c in numeric:
                    wanted.setdefault((*s[:-1], c), {})[s[-1]] = _ranks(whole[s][c][0], probs)
            found = values_at_ranks(running, ids, folds, wanted)
        if removing:
            counted = running.groupBy(*ids).agg(*[F.count_if(_side("c", h, folds) > 0).alias(f"d{h}") for h in range(folds)])
            distinct = {(*(r[k] for k in keys), h, r["column"]): r[f"d{h}"] for r in counted.collect() for h in range(folds)}
        for s in sides:
            for c in numeric:
                n, mean, var = whole[s][c]

                def at(rank: int, s=s, c=c) -> float:
                    return found[(*s[:-1], c, s[-1], rank)]

                q = [_quantile(at, n, p) for p in probs] if n else None
                lower = upper = None
                if removing and q and distinct[(*s, c)] >= min_unique:
                    iqr = q[2] - q[0]
                    if iqr != 0 and not math.isnan(iqr):
                        lower, upper = q[0] - iqr_multiplier * iqr, q[2] + iqr_multiplier * iqr
                stats[s][c] = NumericStats(
                    rows=sum(class_rows[s]), n=n, mean=mean if n else None, var=var if n else None,
                    median=(q[1] if removing else q[0]) if q else None, lower=lower, upper=upper,
                )
        if removing:
            kept = _kept_moments(source, keys, key_fields, numeric, folds, stats, states, of_side)
            medians = _kept_medians(running, ids, folds, stats, kept) if by_median else {}
            for s in sides:
                for c in numeric:
                    n, mean, var = merge(kept[s][c])
                    stats[s][c] = replace(
                        stats[s][c], kept_n=n, kept_mean=mean if n else None, kept_var=var if n else None, kept_median=medians.get((*s, c))
                    )

    categories, vocabulary = {s: {} for s in sides}, None
    if categorical:
        vocabulary, categories = _vocabulary(source, keys, categorical, folds, sides, class_rows, min_frequency)
    fitted = FittedCleaning(numeric, categorical, T.StructType([*key_fields, held]), stats, categories)
    return ComplementFit(fitted, tuple(keys), folds, class_rows, present, kept, vocabulary)


def _kept_moments(source, keys, key_fields, numeric, folds, stats, states, of_side) -> dict[tuple, dict[str, list[Moments]]]:
    """Moments of each class without outliers: sure cells by fold, cells between the bounds of two sides by side."""
    spark, top = source.sparkSession, float("inf")
    bases = list(dict.fromkeys(s[:-1] for s in stats))
    names, rows = [], []
    for i in range(len(numeric)):
        names += [f"lo{i}", f"up{i}", f"in{i}", f"out{i}"]
    for b in bases:
        row = []
        for c in numeric:
            bounds = [stats.get((*b, h), {}).get(c) for h in range(folds)]
            low = [-top if s is None or s.lower is None else s.lower for s in bounds]
            high = [top if s is None or s.upper is None else s.upper for s in bounds]
            row += [low, high, [max(low), min(high)], [min(low), max(high)]]
        rows.append([*b, *row])
    schema = T.StructType([*key_fields, *[T.StructField(n, T.ArrayType(T.DoubleType())) for n in names]])
    joined = _joined(source, small_table(spark, rows, schema), keys, len(rows))

    def inside(i: int, which: str) -> Column:
        return (F.col(f"x{i}") >= F.col(f"{which}{i}")[0]) & (F.col(f"x{i}") <= F.col(f"{which}{i}")[1])

    sure = states(joined, {f"x{i}": F.when(inside(i, "in"), F.col(f"x{i}")) for i in range(len(numeric))})
    doubtful = F.array(
        *[
            F.struct(
                F.lit(c).alias("column"),
                F.when(inside(i, "out") & ~inside(i, "in"), F.col(f"x{i}")).alias("value"),
                F.col(f"lo{i}").alias("low"),
                F.col(f"up{i}").alias("high"),
            )
            for i, c in enumerate(numeric)
        ]
    )
    cells = joined.select(*keys, "fold", "class", F.inline(doubtful)).where("value is not null")
    cells = cells.withColumn("held_out", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    cells = cells.where((F.col("held_out") != F.col("fold")) & (F.col("value") >= F.get("low", "held_out")) & (F.col("value") <= F.get("high", "held_out")))
    found = cells.groupBy(*keys, "held_out", "class", "column").agg(F.count("*").alias("n_x"), F.avg("value").alias("m_x"), F.var_pop("value").alias("v_x"))
    more = {(*(r[k] for k in keys), r["held_out"], r["class"], r["column"]): _moments(r, "x") for r in found.collect()}
    return {
        s: {c: [merge([*of_side(sure, s, k, f"x{i}"), more.get((*s, k, c), NOTHING)]) for k in range(CLASSES)] for i, c in enumerate(numeric)}
        for s in stats
    }


def _kept_medians(running, ids, folds, stats, kept) -> dict[tuple, float]:
    """{(side..., column): median without outliers}: a rank among the kept cells is that rank plus the cells below the bounds."""
    spark, fields = running.sparkSession, running.select(*ids).schema.fields
    lows: dict[tuple, list[float]] = {}
    for s, columns in stats.items():
        for c, x in columns.items():
            lows.setdefault((*s[:-1], c), [float("-inf")] * folds)[s[-1]] = float("-inf") if x.lower is None else x.lower
    table = small_table(spark, [[*k, v] for k, v in lows.items()], T.StructType([*fields, T.StructField("low", T.ArrayType(T.DoubleType()))]))
    joined = _joined(running, table, ids, len(lows))
    below = joined.groupBy(*ids).agg(*[F.sum(F.when(F.col("value") < F.col("low")[h], _side("c", h, folds)).otherwise(0)).alias(f"below{h}") for h in range(folds)])
    skipped = {(*(r[k] for k in ids), h): r[f"below{h}"] for r in below.collect() for h in range(folds)}
    size = {(*s[:-1], c, s[-1]): merge(kept[s][c])[0] for s in stats for c in stats[s]}
    wanted: dict[tuple, dict[int, set[int]]] = {}
    for k, n in size.items():
        if n:
            wanted.setdefault(k[:-1], {})[k[-1]] = {r + skipped[k] for r in _ranks(n, [0.5])}
    found = values_at_ranks(running, ids, folds, wanted)
    return {
        (*k[:-2], k[-1], k[-2]): _quantile(lambda rank, k=k: found[(*k, rank + skipped[k])], n, 0.5) for k, n in size.items() if n
    }


def _vocabulary(source, keys, categorical, folds, sides, class_rows, min_frequency):
    """The values of every side with their rows by class, and what cleaning needs of them."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"y{i}").alias("value")) for i, c in enumerate(categorical)])
    each = [(f, k) for f in range(folds) for k in range(CLASSES)]
    long = source.select(*keys, "fold", "class", F.inline(cells)).groupBy(*keys, "column", "value")
    counts = materialise(long.agg(*[F.count_if((F.col("fold") == f) & (F.col("class") == k)).alias(f"c{f}_{k}") for f, k in each]), "vocabulary")

    def entry(h: int) -> Column:
        own = [reduce(Column.__add__, [F.col(f"c{f}_{k}") for f in range(folds) if f != h], F.lit(0).cast("long")) for k in range(CLASSES)]
        return F.struct(F.lit(h).alias("held_out"), *[x.alias(f"k{k}") for k, x in enumerate(own)])

    by_side = counts.select(*keys, "column", "value", F.inline(F.array(*map(entry, range(folds))))).withColumn("n", F.col("k0") + F.col("k1") + F.col("k2"))
    by_side = by_side.where("n > 0")
    ids = [*keys, "held_out", "column"]
    # Counted exactly: only columns that are narrow on every side have their values listed.
    sizes = by_side.where("value is not null").groupBy(*ids).agg(F.count("*").alias("values"), F.sum("n").alias("total"))
    sizes = {tuple(r[k] for k in ids): (r["values"], r["total"]) for r in sizes.collect()}
    widest = {c: max((v for k, (v, _) in sizes.items() if k[-1] == c), default=0) for c in categorical}
    listed = [c for c in categorical if widest[c] <= MAX_CATEGORIES]
    schema = T.StructType([*by_side.select(*ids).schema.fields, T.StructField("total", T.LongType())])
    totals = small_table(source.sparkSession, [[*k, t] for k, (_, t) in sizes.items()], schema)
    frequent = F.col("n") / F.col("total") >= F.lit(float(min_frequency))
    learned = _joined(by_side.where("value is not null"), totals, ids, len(sizes)).groupBy(*ids).agg(
        F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("top"),
        F.collect_list(F.when(frequent, F.col("value"))).alias("valid"),  # at most 1 / min_frequency
        F.collect_list(F.when(F.col("column").isin(listed), F.col("value"))).alias("vocabulary"),
    )
    learned = materialise(learned.select(*ids, F.col("top.value").alias("mode"), "valid", "vocabulary"), "categories")
    found = {tuple(r[k] for k in ids): r for r in learned.collect()}
    stats = {s: {} for s in sides}
    for s in sides:
        for c in categorical:
            r = found.get((*s, c))
            stats[s][c] = CategoryStats(
                rows=sum(class_rows[s]), n=sizes.get((*s, c), (0, 0))[1], mode=r["mode"] if r else None,
                valid=tuple(sorted(r["valid"])) if r else (),
                vocabulary=(tuple(sorted(r["vocabulary"])) if c in listed else None) if r else (),
            )
    named = learned.select(*ids, "mode", "valid")
    joined = join_same(by_side, F.broadcast(named) if len(found) <= BROADCAST_ROWS else named, ids, "left").select(*ids, "value", "k0", "k1", "k2", F.coalesce("valid", F.array().cast("array<string>")).alias("valid"), "mode")
    return materialise(joined, "side-values"), stats
