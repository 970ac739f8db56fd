"""Controlled damage: missing cells, outliers and category noise.

Each variant (level, repeat) hits exactly the planned number of cells per column.
Which cells is decided by row digests against cutoffs (see ``cutoffs``), so
applying damage is one projection over the scan, for one variant or for a grid.
Order matters: cells are blanked first, and only the rest can become outliers or
noise.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import is_numeric, nan_to_null, present, ref, whole_div
from ..functions.digests import digest_choice, row_digest
from ..sources.workspace import small_table, spread
from ..specs import DamageProfile, DatasetSpec
from .cutoffs import ROWS_PER_TASK, digest_cutoffs, fits_window, near_cutoffs, outside_collapsed, window_around

VARIANT = ("damage_level", "damage_repeat")
WINDOWS = ("blank_low", "blank_high", "hit_low", "hit_high")


@dataclass(frozen=True)
class DamageRoles:
    candidates: tuple[str, ...]
    continuous: tuple[str, ...]
    categorical: tuple[str, ...]


def damage_roles(df: DataFrame, spec: DatasetSpec) -> DamageRoles:
    """Continuous columns are listed in the spec; every other unprotected one is categorical."""
    untouched = set(spec.kept_out)
    candidates = tuple(c for c in df.columns if c not in untouched)
    continuous = tuple(c for c in present(df, spec.continuous) if c in candidates)
    return DamageRoles(candidates, continuous, tuple(c for c in candidates if c not in continuous))


def _prepared(df: DataFrame, roles: DamageRoles) -> DataFrame:
    """Types that can hold the damage: doubles for outliers, text where 9 has no other form."""
    types = {f.name: f.dataType for f in df.schema.fields}

    def shaped(name: str) -> Column:
        if name in roles.continuous:
            return ref(name).cast("double").alias(name)
        if name in roles.categorical and not is_numeric(types[name]):
            return ref(name).cast("string").alias(name)
        return ref(name)

    return nan_to_null(df.select(*[shaped(c) for c in df.columns]))


class DamagePlan:
    """Cutoffs of a set of variants; ``apply`` turns a clean table into damaged ones."""

    def __init__(
        self,
        spec: DatasetSpec,
        profile: DamageProfile,
        roles: DamageRoles,
        variants: list[tuple[int, int]],
        steps: tuple[str, ...],
    ):
        if spec.row_key is None:
            raise ValueError("damage needs a unique row key in the dataset spec")
        self.spec, self.profile, self.roles = spec, profile, roles
        self.variants, self.steps = variants, steps
        self.cutoffs: dict[tuple[int, int, str, str], str] = {}
        self.most_rows = 0

    def _digest(self, step: str, column: str) -> Column:
        return row_digest(F.col("seed"), F.lit(step), F.lit(column), ref(self.spec.row_key))

    def _slot(self, step: str, column: str) -> str:
        return f"cut_{step}_{self.roles.candidates.index(column)}"

    def _slots(self) -> list[tuple[str, str]]:
        r = self.roles
        by_step = {"missing": r.candidates, "outlier": r.continuous, "noise": r.categorical}
        return [(s, c) for s in self.steps for c in by_step[s]]

    def _variant_table(self, df: DataFrame, most_rows: int | None = None) -> DataFrame:
        """One row per variant with the cutoffs known so far; NULL selects nothing.

        With ``most_rows`` also the windows in which cutoffs are to be expected.
        """
        slots = self._slots()
        schema = T.StructType(
            [T.StructField(n, T.IntegerType(), False) for n in (*VARIANT, "seed")]
            + [T.StructField(self._slot(s, c), T.StringType()) for s, c in slots]
            + [T.StructField(n, T.StringType()) for n in WINDOWS if most_rows is not None]
        )
        rows = []
        for lv, rp in self.variants:
            row = [lv, rp, self.profile.seed(lv, rp), *[self.cutoffs.get((lv, rp, s, c)) for s, c in slots]]
            if most_rows is not None:
                for share in self._shares(lv):
                    row += window_around(share, most_rows)
            rows.append(row)
        return small_table(df.sparkSession, rows, schema)

    def _shares(self, level: int) -> tuple[float, float]:
        """Share of the rows to blank, and of the remaining cells to hit."""
        hit = max(self.profile.share_floor, self.profile.share_scale * level) / 1000
        return level / 100, min(hit, 1.0)

    def _chosen(self, step: str, column: str) -> Column:
        """Is the cell among those the step hits? False where there is no cutoff."""
        if step not in self.steps:
            return F.lit(False)
        slot = F.col(self._slot(step, column))
        return F.when(slot.isNotNull(), self._digest(step, column) <= slot).otherwise(F.lit(False))

    def _survives(self, column: str) -> Column:
        return ref(column).isNotNull() & ~self._chosen("missing", column)

    def _with_variants(self, df: DataFrame, most_rows: int | None = None) -> DataFrame:
        # One row per variant: the grid fixes its size, not the data.
        return df.crossJoin(F.broadcast(self._variant_table(df, most_rows)))

    def _fit_step(self, df: DataFrame, steps: tuple[str, ...], most_rows: int, rows_per_task: int) -> None:
        slots = [(s, c) for s, c in self._slots() if s in steps]
        if not slots:
            return
        blanking = steps == ("missing",)
        low, high = WINDOWS[:2] if blanking else WINDOWS[2:]
        cells = F.array(
            *[
                F.struct(
                    F.lit(i).alias("slot"),
                    (self._digest(s, c) if blanking else F.when(self._survives(c), self._digest(s, c))).alias("digest"),
                )
                for i, (s, c) in enumerate(slots)
            ]
        )
        rows = (
            self._with_variants(df, most_rows)
            .select(*VARIANT, low, high, F.inline(cells))
            .where(F.col("digest").isNotNull())
        )
        percent = F.col("damage_level").cast("long")

        def wanted(n: Column) -> Column:
            if blanking:
                return F.array(whole_div(n * percent, 100))
            share = F.greatest(F.lit(self.profile.share_floor).cast("long"), percent * self.profile.share_scale)
            return F.array(F.greatest(F.lit(1).cast("long"), whole_div(n * share, 1000)))

        groups = [*VARIANT, "slot"]
        found, complete = [], False
        shares = [self._shares(lv)[0 if blanking else 1] for lv, _ in self.variants]
        if all(fits_window(p, most_rows, rows_per_task) for p in shares):
            near = rows.withColumn("digest", outside_collapsed(F.col("digest"), [(F.col(low), F.col(high))]))
            found, complete = near_cutoffs(near, groups, wanted)
        if not complete:
            found = digest_cutoffs(rows.drop(low, high), groups, wanted, rows_per_task)
        if any(r["held"] > 1 for r in found):
            raise ValueError(f"{self.spec.row_key!r} is not unique: exact counts need a key for each row, see with_content_key")
        for r in found:
            self.cutoffs[(r["damage_level"], r["damage_repeat"], *slots[r["slot"]])] = r["cutoff"]

    def fit(self, df: DataFrame, rows_per_task: int = ROWS_PER_TASK) -> "DamagePlan":
        size = df.agg(F.count("*").alias("n"), F.count(ref(self.spec.row_key)).alias("keys")).first()
        if size["keys"] < size["n"]:
            raise ValueError(f"{size['n'] - size['keys']} rows have no {self.spec.row_key!r}: see with_content_key")
        self.most_rows = most_rows = size["n"]
        source = spread(_prepared(df, self.roles), most_rows)
        self._fit_step(source, ("missing",), most_rows, rows_per_task)
        self._fit_step(source, ("outlier", "noise"), most_rows, rows_per_task)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        """The damaged rows of every variant, with ``damage_level`` and ``damage_repeat``."""
        source = spread(_prepared(df, self.roles), self.most_rows)
        types = {f.name: f.dataType for f in source.schema.fields}

        def damaged(name: str) -> Column:
            if name not in self.roles.candidates:
                return ref(name)
            kept = ref(name)
            if name in self.roles.continuous:
                factor = digest_choice(self._digest("outlier", name), self.profile.factors)
                kept = F.when(self._chosen("outlier", name), kept * factor).otherwise(kept)
            else:
                noise = F.lit(self.profile.noise_value).cast(types[name])
                kept = F.when(kept.isNotNull() & self._chosen("noise", name), noise).otherwise(kept)
            return F.when(~self._chosen("missing", name), kept).alias(name)

        return self._with_variants(source).select(*VARIANT, *[damaged(c) for c in df.columns])


def with_content_key(df: DataFrame, name: str) -> DataFrame:
    """``df`` with the unique key ``name``: the digest of the row's content and the number of the equal row.

    Unlike a running number it does not depend on how the table is split into files, so damage by it is reproducible.
    Only equal rows are numbered together.
    """
    content = F.md5(F.to_json(F.struct(*[ref(c) for c in df.columns]), {"ignoreNullFields": "false"}))
    keyed = df.withColumn("__content", content)
    nth = F.row_number().over(Window.partitionBy("__content").orderBy(F.lit(0)))
    return keyed.select(*[ref(c) for c in df.columns], F.concat_ws("-", "__content", nth.cast("string")).alias(name))


def fit_damage(
    df: DataFrame,
    spec: DatasetSpec,
    profile: DamageProfile,
    variants: Iterable[tuple[int, int]] | None = None,
    steps: tuple[str, ...] = ("missing", "outlier", "noise"),
    rows_per_task: int = ROWS_PER_TASK,
) -> DamagePlan:
    """Find the cutoffs of the given (level, repeat) variants, by default the whole profile."""
    chosen = list(profile.variants() if variants is None else variants)
    plan = DamagePlan(spec, profile, damage_roles(df, spec), chosen, steps)
    return plan.fit(df, rows_per_task)


def inject(
    df: DataFrame,
    spec: DatasetSpec,
    profile: DamageProfile,
    variants: Iterable[tuple[int, int]] | None = None,
    steps: tuple[str, ...] = ("missing", "outlier", "noise"),
) -> DataFrame:
    """Damaged copies of ``df``, one per variant, as a lazy DataFrame."""
    return fit_damage(df, spec, profile, variants, steps).apply(df)


def inject_missingness(df, spec, profile, level, repeat=1) -> DataFrame:
    return inject(df, spec, profile, [(level, repeat)], ("missing",))


def inject_continuous_outliers(df, spec, profile, level, repeat=1) -> DataFrame:
    return inject(df, spec, profile, [(level, repeat)], ("outlier",))


def inject_categorical_noise(df, spec, profile, level, repeat=1) -> DataFrame:
    return inject(df, spec, profile, [(level, repeat)], ("noise",))
