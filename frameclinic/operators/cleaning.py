"""Fit/transform cleaning: outliers, rare categories, imputation, scaling, one-hot.

``fit_cleaning`` learns the statistics of every recipe at once, optionally per key
group (for example per damage variant and training fold). Each pass aggregates
map-side and returns one row per key group, so what reaches the driver has the
size of the plan (groups x columns). Applying a recipe is a projection: constants
for one global fit, or a broadcast join with the one-row-per-group statistics.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import as_double, is_numeric, join_same, nan_to_null, ref
from ..sources.workspace import broadcast_if_small, small_table
from ..specs import (
    CATEGORY_FILL,
    IQR_MULTIPLIER,
    MIN_FREQUENCY,
    MIN_UNIQUE,
    NUMERIC_FILL,
    RECIPES,
    recipe,
)
from .quantiles import VALUES_PER_TASK, narrowed_quantiles

# Widest one-hot block per column; wider vocabularies need the long form.
MAX_CATEGORIES = 1_000
# Statistics, and names of categories among them, that may be broadcast.
BROADCAST_CELLS = 1_000_000
# Key groups a fit may have: their statistics are broadcast.
MAX_GROUPS = 50_000
# A distinct count is beyond doubt from this many times the limit on, by the estimate's error of a twentieth.
SURELY = 2


@dataclass(frozen=True)
class NumericStats:
    """Of one numeric column in one key group; ``kept_*`` is after outlier removal."""

    rows: int
    n: int
    mean: float | None
    var: float | None
    median: float | None
    lower: float | None = None
    upper: float | None = None
    kept_n: int = 0
    kept_mean: float | None = None
    kept_var: float | None = None
    kept_median: float | None = None

    def fill(self, removed: bool, by_median: bool) -> float | None:
        if not by_median:
            return NUMERIC_FILL
        return self.kept_median if removed else self.median

    def centre_scale(self, removed: bool, by_median: bool) -> tuple[float, float]:
        """Mean and population sd after imputation, from the moments of the present cells."""
        n, mean, var = (
            (self.kept_n, self.kept_mean, self.kept_var) if removed else (self.n, self.mean, self.var)
        )
        value = self.fill(removed, by_median)
        if value is None:
            return 0.0, 1.0
        missing = self.rows - n
        if n == 0:
            return value, 1.0
        if missing == 0:
            total_mean, total_var = mean, var
        else:
            total_mean = (n * mean + missing * value) / self.rows
            total_var = (
                n * (var + (mean - total_mean) ** 2) + missing * (value - total_mean) ** 2
            ) / self.rows
        sd = math.sqrt(max(total_var, 0.0))
        return total_mean, sd if sd > 0 else 1.0


@dataclass(frozen=True)
class CategoryStats:
    """Of one categorical column in one key group."""

    rows: int
    n: int
    mode: str | None
    valid: tuple[str, ...]
    vocabulary: tuple[str, ...] | None

    def survivors(self, removed: bool) -> tuple[str, ...] | None:
        """Values left after rare ones are nulled; all of them if none is frequent."""
        return self.valid if removed and self.valid else self.vocabulary

    def categories(self, removed: bool, by_mode: bool) -> tuple[str, ...]:
        """Sorted one-hot categories learned from the fitted rows."""
        values = self.survivors(removed)
        if values is None:
            raise ValueError(
                f"more than {MAX_CATEGORIES} categories: use one_hot_long instead of wide columns"
            )
        if by_mode:
            return tuple(sorted(values))
        blanks = self.n < self.rows or (removed and bool(self.valid) and self.rare_exist)
        return tuple(sorted({*values, CATEGORY_FILL} if blanks else values))

    @property
    def rare_exist(self) -> bool:
        return self.vocabulary is None or len(self.valid) < len(self.vocabulary)


class FittedCleaning:
    """Statistics per key group; builds the cleaned columns of any recipe."""

    def __init__(
        self,
        numeric: Sequence[str],
        categorical: Sequence[str],
        keys: T.StructType,
        numeric_stats: dict[tuple, dict[str, NumericStats]],
        category_stats: dict[tuple, dict[str, CategoryStats]],
    ):
        self.numeric, self.categorical = tuple(numeric), tuple(categorical)
        self.key_schema, self.keys = keys, tuple(keys.fieldNames())
        self.numeric_stats, self.category_stats = numeric_stats, category_stats
        self.groups = list(numeric_stats)

    # -- statistics as tables -------------------------------------------------

    def bounds(self, spark) -> DataFrame:
        """Outlier bounds: one row per key group and column that has any."""
        schema = T.StructType(
            [*self.key_schema.fields, T.StructField("column", T.StringType()),
             T.StructField("lower", T.DoubleType()), T.StructField("upper", T.DoubleType())]
        )
        rows = [
            [*g, c, s.lower, s.upper]
            for g in self.groups
            for c, s in self.numeric_stats[g].items()
            if s.lower is not None
        ]
        return small_table(spark, rows, schema)

    def valid_categories(self, spark) -> DataFrame:
        """Frequent categories: one row per key group, column and value."""
        schema = T.StructType(
            [*self.key_schema.fields, T.StructField("column", T.StringType()), T.StructField("value", T.StringType())]
        )
        rows = [
            [*g, c, v]
            for g in self.groups
            for c, s in self.category_stats[g].items()
            for v in s.valid
        ]
        return small_table(spark, rows, schema)

    # -- applying -------------------------------------------------------------

    def _parameter_values(
        self, group: tuple, methods: Sequence[str], encoding: bool
    ) -> dict[str, tuple[object, T.DataType]]:
        """Everything a projection needs to know about one key group."""
        doubles, texts = T.DoubleType(), T.ArrayType(T.StringType())
        out: dict[str, tuple[object, T.DataType]] = {}
        for i, c in enumerate(self.numeric):
            s = self.numeric_stats[group][c]
            out[f"n{i}_lower"], out[f"n{i}_upper"] = (s.lower, doubles), (s.upper, doubles)
            for m in methods:
                r = recipe(m)
                fill = s.fill(r.remove, r.fill)
                centre, scale = s.centre_scale(r.remove, r.fill)
                # An all-missing column has no median: constant zero carries no signal.
                out[f"n{i}_{m}_fill"] = (0.0 if fill is None else fill, doubles)
                if r.norm:
                    out[f"n{i}_{m}_centre"], out[f"n{i}_{m}_scale"] = (centre, doubles), (scale, doubles)
        for i, c in enumerate(self.categorical):
            s = self.category_stats[group][c]
            out[f"c{i}_valid"] = (list(s.valid), texts)
            out[f"c{i}_mode"] = (s.mode, T.StringType())
            if self.keys and encoding:
                for m in methods:
                    r = recipe(m)
                    out[f"c{i}_{m}_known"] = (list(s.categories(r.remove, r.fill)), texts)
        return out

    def attach(
        self, df: DataFrame, methods: Sequence[str], encoding: bool = False
    ) -> tuple[DataFrame, dict[str, Column]]:
        """``df`` with the parameters reachable as columns: literals, or a joined struct."""
        if not self.keys:
            literals = {
                name: F.lit(value).cast(kind) if not isinstance(kind, T.ArrayType) else F.array(*map(F.lit, value)).cast(kind)
                for name, (value, kind) in self._parameter_values((), methods, encoding).items()
            }
            return df, literals
        tables = [self._parameter_values(g, methods, encoding) for g in self.groups]
        names = list(tables[0])
        schema = T.StructType(
            [*self.key_schema.fields, *[T.StructField(n, tables[0][n][1]) for n in names]]
        )
        rows = [[*g, *[t[n][0] for n in names]] for g, t in zip(self.groups, tables)]
        wide = small_table(df.sparkSession, rows, schema)
        packed = wide.select(*self.keys, F.struct(*names).alias("fitted"))
        # One row per key group: broadcast if its cells are few, category names counted one by one.
        cells = sum(len(v) if isinstance(v, list) else 1 for r in rows for v in r)
        packed = F.broadcast(packed) if cells <= BROADCAST_CELLS else packed
        return join_same(df, packed, self.keys), {n: F.col("fitted")[n] for n in names}

    def nulled_numeric(self, column: str, params: dict[str, Column]) -> Column:
        """Values strictly outside the bounds become NULL; no bounds, no change."""
        i, c = self.numeric.index(column), as_double(ref(column))
        outside = (c < params[f"n{i}_lower"]) | (c > params[f"n{i}_upper"])
        return F.when(~F.coalesce(outside, F.lit(False)), c)

    def nulled_category(self, column: str, params: dict[str, Column]) -> Column:
        """Rare values become NULL, unless no value at all is frequent."""
        i, c = self.categorical.index(column), ref(column).cast("string")
        valid = params[f"c{i}_valid"]
        return F.when((F.size(valid) == 0) | F.array_contains(valid, c), c)

    def cleaned(self, method: str, params: dict[str, Column]) -> dict[str, Column]:
        """Cleaned column expressions by feature name, before one-hot encoding."""
        r, out = recipe(method), {}
        for i, c in enumerate(self.numeric):
            value = self.nulled_numeric(c, params) if r.remove else as_double(ref(c))
            value = F.coalesce(value, params[f"n{i}_{method}_fill"])
            if r.norm:
                value = (value - params[f"n{i}_{method}_centre"]) / params[f"n{i}_{method}_scale"]
            out[c] = value
        for i, c in enumerate(self.categorical):
            value = self.nulled_category(c, params) if r.remove else ref(c).cast("string")
            out[c] = F.coalesce(value, params[f"c{i}_mode"] if r.fill else F.lit(CATEGORY_FILL))
        return out

    def cleaned_by_method(
        self, df: DataFrame, tried: Callable[[tuple], Sequence[str]]
    ) -> tuple[DataFrame, dict[str, Column]]:
        """``df`` once for each method that ``tried`` gives for its key group, with ``method``, and the cleaned columns.

        Methods differ in the values of one table only, so one short expression serves them all.
        """
        rows = []
        for g in self.groups:
            for method in tried(g):
                r, row = recipe(method), []
                for c in self.numeric:
                    stats = self.numeric_stats[g][c]
                    row += [stats.lower, stats.upper] if r.remove else [None, None]
                    fill = stats.fill(r.remove, r.fill)
                    # An all-missing column has no median: constant zero carries no signal.
                    row += [0.0 if fill is None else fill, *(stats.centre_scale(r.remove, r.fill) if r.norm else (0.0, 1.0))]
                for c in self.categorical:
                    stats = self.category_stats[g][c]
                    row += [list(stats.valid) if r.remove else [], stats.mode if r.fill else CATEGORY_FILL]
                rows.append([*g, method, *row])
        fields = [T.StructField(f"n{i}_{x}", T.DoubleType()) for i in range(len(self.numeric)) for x in ("lower", "upper", "fill", "centre", "scale")]
        for i in range(len(self.categorical)):
            fields += [T.StructField(f"c{i}_valid", T.ArrayType(T.StringType())), T.StructField(f"c{i}_fill", T.StringType())]
        schema = T.StructType([*self.key_schema.fields, T.StructField("method", T.StringType()), *fields])
        packed = small_table(df.sparkSession, rows, schema).select(*self.keys, "method", F.struct(*[f.name for f in fields]).alias("fitted"))
        cells = sum(len(v) if isinstance(v, list) else 1 for r in rows for v in r)
        joined = join_same(df, F.broadcast(packed) if cells <= BROADCAST_CELLS else packed, self.keys)
        params, out = {f.name: F.col("fitted")[f.name] for f in fields}, {}
        for i, c in enumerate(self.numeric):
            value = F.coalesce(self.nulled_numeric(c, params), params[f"n{i}_fill"])
            out[c] = (value - params[f"n{i}_centre"]) / params[f"n{i}_scale"]
        for i, c in enumerate(self.categorical):
            out[c] = F.coalesce(self.nulled_category(c, params), params[f"c{i}_fill"])
        return joined, out

    def categories(self, method: str, column: str) -> list[str]:
        """One-hot categories of a column: the union over the key groups, sorted."""
        r = recipe(method)
        union: set[str] = set()
        for g in self.groups:
            union.update(self.category_stats[g][column].categories(r.remove, r.fill))
        return sorted(union)

    def matrix(self, method: str, params: dict[str, Column]) -> dict[str, Column]:
        """Model-ready doubles: ``num__<column>`` then ``cat__<column>_<value>``.

        A value that the key group's fitted rows did not have is all zeros.
        """
        cleaned, out = self.cleaned(method, params), {}
        for c in self.numeric:
            if not self._dropped_numeric(method, c):
                out[f"num__{c}"] = cleaned[c]
        for i, c in enumerate(self.categorical):
            for value in self.categories(method, c):
                hit = cleaned[c] == F.lit(value)
                if self.keys:
                    hit = hit & F.array_contains(params[f"c{i}_{method}_known"], F.lit(value))
                out[f"cat__{c}_{value}"] = F.when(hit, F.lit(1.0)).otherwise(F.lit(0.0))
        return out

    def _dropped_numeric(self, method: str, column: str) -> bool:
        """A median fit leaves out a column that has no value in any group."""
        r = recipe(method)
        return all(
            self.numeric_stats[g][column].fill(r.remove, r.fill) is None for g in self.groups
        )

    def clean(self, df: DataFrame, method: str) -> DataFrame:
        """``df`` with its feature columns cleaned in place (not encoded)."""
        joined, params = self.attach(nan_to_null(df), [method])
        cleaned = self.cleaned(method, params)
        return joined.select(*[cleaned[c].alias(c) if c in cleaned else ref(c) for c in df.columns])

    def transform(self, df: DataFrame, method: str, keep: Sequence[str] = ()) -> DataFrame:
        """``keep`` columns plus the model-ready matrix of ``method``."""
        joined, params = self.attach(nan_to_null(df), [method], encoding=True)
        columns = self.matrix(method, params)
        return joined.select(
            *[ref(k) for k in keep], *[value.alias(name) for name, value in columns.items()]
        )


def _group(row, keys: Sequence[str]) -> tuple:
    return tuple(row[k] for k in keys)


def _value_counts(df: DataFrame, keys: list[str], categorical: Sequence[str]) -> DataFrame:
    """One row per key group, column and value with its count."""
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), ref(c).cast("string").alias("value")) for c in categorical]
    )
    return (
        df.select(*keys, F.inline(cells.cast("array<struct<column:string,value:string>>")))
        .where(F.col("value").isNotNull())
        .groupBy(*keys, "column", "value")
        .agg(F.count("*").alias("n"))
    )


def _distinct_values(source: DataFrame, keys: list[str], columns: Sequence[str], doubted: set[tuple]) -> dict[tuple, int]:
    """Exact distinct counts of the doubted (key values..., column), each of which has few values."""
    columns = [c for c in columns if any(d[-1] == c for d in doubted)]
    if not columns:
        return {}
    cells = F.array(*[F.struct(F.lit(c).alias("column"), as_double(ref(c)).alias("value")) for c in columns])
    values = source.select(*keys, F.inline(cells)).where(F.col("value").isNotNull())
    fields = [f for k in (*keys, "column") for f in values.schema.fields if f.name == k]
    renamed = T.StructType([T.StructField(f"__{f.name}", f.dataType) for f in fields])
    wanted = small_table(source.sparkSession, [list(d) for d in doubted], renamed)
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in (*keys, "column")]
    values = values.join(F.broadcast(wanted), same, "left_semi").distinct()
    return {(*_group(r, keys), r["column"]): r["count"] for r in values.groupBy(*keys, "column").count().collect()}


def value_shares(df: DataFrame, categorical: Sequence[str], keys: Sequence[str] = ()) -> DataFrame:
    """Relative frequency of each value among the non-null values of its column."""
    keys = list(keys)
    present = df.groupBy(*keys).agg(
        F.count("*").alias("__rows"), *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(categorical)]
    )
    cells = F.array(
        *[F.struct(F.lit(c).alias("column"), F.col(f"n{i}").alias("total")) for i, c in enumerate(categorical)]
    )
    # Joining by column would put a whole vocabulary in one task.
    cells = cells.cast("array<struct<column:string,total:bigint>>")
    totals = broadcast_if_small(present.select(*keys, F.inline(cells)))
    counts = _value_counts(df, keys, categorical)
    return join_same(counts, totals, [*keys, "column"]).select(
        *keys, "column", "value", "n", "total", (F.col("n") / F.col("total")).alias("share")
    )


def fit_cleaning(
    df: DataFrame,
    numeric: Sequence[str] | None = None,
    categorical: Sequence[str] | None = None,
    keys: Sequence[str] = (),
    methods: Sequence[str] = tuple(RECIPES),
    iqr_multiplier: float = IQR_MULTIPLIER,
    min_unique: int = MIN_UNIQUE,
    min_frequency: float = MIN_FREQUENCY,
    values_per_task: int = VALUES_PER_TASK,
) -> FittedCleaning:
    """Learn what ``methods`` need, per ``keys`` group.

    Roles follow column types unless given: numbers are numeric, all else is
    categorical. Without keys the whole table is one group.
    """
    keys = list(keys)
    if numeric is None or categorical is None:
        fields = [f for f in df.schema.fields if f.name not in keys]
        numeric = [f.name for f in fields if is_numeric(f.dataType)]
        categorical = [f.name for f in fields if not is_numeric(f.dataType)]
    numeric, categorical = list(numeric), list(categorical)
    recipes = [recipe(m) for m in methods]
    removing = any(r.remove for r in recipes)
    key_schema = T.StructType([f for k in keys for f in df.schema.fields if f.name == k])
    source = nan_to_null(df.select(*[ref(c) for c in (*keys, *numeric, *categorical)]))
    features = [*numeric, *categorical]

    # Pass 1: counts and distinct estimates decide how the next passes may work.
    profile_rows = (
        source.groupBy(*keys)
        .agg(
            F.count("*").alias("rows"),
            *[F.count(ref(c)).alias(f"n{i}") for i, c in enumerate(features)],
            *[F.approx_count_distinct(ref(c)).alias(f"d{i}") for i, c in enumerate(features)],
        )
        .limit(MAX_GROUPS + 1)
        .collect()
    )
    if len(profile_rows) > MAX_GROUPS:
        raise ValueError(f"more than {MAX_GROUPS} key groups; fit them in several runs")
    profile = {_group(r, keys): r for r in profile_rows}
    groups = list(profile)
    count_of = {g: {c: profile[g][f"n{i}"] for i, c in enumerate(features)} for g in groups}
    most = {c: max((profile[g][f"d{i}"] for g in groups), default=0) for i, c in enumerate(features)}
    need_median = any(r.fill for r in recipes)

    def moments_and_quantiles(rows: DataFrame, probs: list[float]) -> dict:
        """{group: {column: (n, mean, var, quantiles)}}"""
        parts = []
        for i, c in enumerate(numeric):
            v = as_double(ref(c))
            parts += [F.count(v).alias(f"n{i}"), F.avg(v).alias(f"m{i}"), F.var_pop(v).alias(f"v{i}")]
        found = {_group(r, keys): r for r in rows.groupBy(*keys).agg(*parts).collect()}
        ranked = {}
        if probs:
            present = {(*g, c): found[g][f"n{i}"] for g in groups for i, c in enumerate(numeric)}
            ranked = narrowed_quantiles(rows, numeric, probs, keys, values_per_task, counts=present)
        return {
            g: {c: (found[g][f"n{i}"], found[g][f"m{i}"], found[g][f"v{i}"], ranked.get((*g, c))) for i, c in enumerate(numeric)}
            for g in groups
        }

    numeric_stats: dict[tuple, dict[str, NumericStats]] = {g: {} for g in groups}
    if numeric:
        probs = [0.25, 0.5, 0.75] if removing else ([0.5] if need_median else [])
        first = moments_and_quantiles(source, probs)
        estimate = {(*g, c): profile[g][f"d{features.index(c)}"] for g in groups for c in numeric}
        distinct = estimate
        if removing:
            doubted = {k for k, d in estimate.items() if d < SURELY * min_unique + 100}
            distinct = estimate | dict.fromkeys(doubted, 0) | _distinct_values(source, keys, numeric, doubted)
        for g in groups:
            for c in numeric:
                n, mean, var, q = first[g][c]
                lower = upper = None
                if removing and q and distinct[(*g, c)] >= min_unique:
                    q1, q3 = q[0], q[2]
                    iqr = q3 - q1
                    if iqr != 0 and not math.isnan(iqr):
                        lower, upper = q1 - iqr_multiplier * iqr, q3 + iqr_multiplier * iqr
                numeric_stats[g][c] = NumericStats(
                    rows=profile[g]["rows"], n=n, mean=mean, var=var,
                    median=(q[1] if removing else q[0]) if q else None, lower=lower, upper=upper,
                )
        if removing and any(r.fill or r.norm for r in recipes if r.remove):
            # Pass 3: the same moments once the outliers are gone.
            bounds_only = FittedCleaning(numeric, (), key_schema, numeric_stats, {g: {} for g in groups})
            joined, params = bounds_only.attach(source, [])
            kept_rows = joined.select(*keys, *[bounds_only.nulled_numeric(c, params).alias(c) for c in numeric])
            second = moments_and_quantiles(kept_rows, [0.5] if need_median else [])
            for g in groups:
                for c in numeric:
                    n, mean, var, q = second[g][c]
                    s = numeric_stats[g][c]
                    numeric_stats[g][c] = NumericStats(
                        **{**s.__dict__, "kept_n": n, "kept_mean": mean, "kept_var": var,
                           "kept_median": q[0] if q else None}
                    )

    category_stats: dict[tuple, dict[str, CategoryStats]] = {g: {} for g in groups}
    if categorical:
        counts = _value_counts(source, keys, categorical)
        # Near the limit the estimate does not decide: values are counted.
        doubted = [c for c in categorical if MAX_CATEGORIES / SURELY < most[c] < MAX_CATEGORIES * SURELY]
        if doubted:
            sizes = counts.where(F.col("column").isin(doubted)).groupBy(*keys, "column").count()
            most |= {r["column"]: r["most"] for r in sizes.groupBy("column").agg(F.max("count").alias("most")).collect()}
        listed = [c for c in categorical if most[c] <= MAX_CATEGORIES]
        totals_schema = T.StructType(
            [*key_schema.fields, T.StructField("column", T.StringType()), T.StructField("total", T.LongType())]
        )
        totals = small_table(
            df.sparkSession, [[*g, c, count_of[g][c]] for g in groups for c in categorical], totals_schema
        )
        # Values at or above the share are at most 1/share per group; whole
        # vocabularies are gathered only for columns estimated to be narrow.
        frequent = F.col("n") / F.col("total") >= F.lit(float(min_frequency))
        found_rows = (
            join_same(counts, F.broadcast(totals), [*keys, "column"])
            .groupBy(*keys, "column")
            .agg(
                F.min(F.struct((-F.col("n")).alias("rank"), F.col("value"))).alias("top"),
                F.collect_list(F.when(frequent, F.col("value"))).alias("valid"),
                F.collect_list(F.when(F.col("column").isin(listed), F.col("value"))).alias("vocabulary"),
            )
            .select(*keys, "column", F.col("top.value").alias("mode"), "valid", "vocabulary")
            .collect()
        )
        found = {(*_group(r, keys), r["column"]): r for r in found_rows}
        for g in groups:
            for c in categorical:
                r = found.get((*g, c))
                category_stats[g][c] = CategoryStats(
                    rows=profile[g]["rows"],
                    n=count_of[g][c],
                    mode=r["mode"] if r else None,
                    valid=tuple(sorted(r["valid"])) if r else (),
                    vocabulary=(tuple(sorted(r["vocabulary"])) if c in listed else None) if r else (),
                )
    return FittedCleaning(numeric, categorical, key_schema, numeric_stats, category_stats)
