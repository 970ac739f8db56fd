"""Plan-time descriptions: datasets, damage profiles, cleaning recipes, grids."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, replace


@dataclass(frozen=True)
class DatasetSpec:
    """A labelled table: its target, key and column roles."""

    name: str
    target: str
    row_key: str | None = None
    protected: tuple[str, ...] = ()
    continuous: tuple[str, ...] = ()
    target_map: Mapping[object, int] | None = None
    separator: str = ","

    @property
    def id_columns(self) -> tuple[str, ...]:
        """Columns that are neither features nor the target."""
        key = (self.row_key,) if self.row_key else ()
        return tuple(dict.fromkeys(c for c in (*key, *self.protected) if c != self.target))

    def with_key(self, name: str) -> DatasetSpec:
        """The same table with ``name`` as its row key."""
        return replace(self, row_key=name)

    @property
    def kept_out(self) -> tuple[str, ...]:
        """Columns that damage and cleaning must not touch."""
        return (*self.id_columns, self.target)


@dataclass(frozen=True)
class DamageProfile:
    """How strongly a level hurts a table.

    ``share_scale`` per mille of the non-null cells per percent of level, and at
    least ``share_floor`` per mille, get an outlier factor or the noise value.
    """

    name: str
    seed_base: int
    levels: tuple[int, ...]
    repeats: int
    factors: tuple[float, ...]
    share_scale: int
    share_floor: int
    noise_value: int = 9

    def seed(self, level: int, repeat: int) -> int:
        return self.seed_base + 100 * repeat + level

    def variants(self) -> tuple[tuple[int, int], ...]:
        """All (level, repeat) pairs of the profile."""
        return tuple((lv, rp) for lv in self.levels for rp in range(1, self.repeats + 1))


@dataclass(frozen=True)
class Recipe:
    """Which cleaning steps a method takes."""

    method: str
    remove: bool
    fill: bool
    norm: bool
    suffix: str | None


@dataclass(frozen=True)
class GridProfile:
    """Size of an evaluation grid."""

    name: str
    methods: tuple[str, ...]
    models: tuple[str, ...]
    levels: tuple[int, ...]
    damage_repeats: tuple[int, ...]
    cv_seeds: tuple[int, ...]
    folds: int
    model_params: Mapping[str, Mapping[str, float]] = field(default_factory=dict)


# Damage profiles.
PROFILE_A = DamageProfile(
    name="20_60", seed_base=1000, levels=(20, 40, 60), repeats=5,
    factors=(25.0, 50.0, 100.0, -25.0), share_scale=10, share_floor=0,
)
PROFILE_B = DamageProfile(
    name="10_50", seed_base=5000, levels=(10, 20, 30, 40, 50), repeats=3,
    factors=(20.0, 40.0, 80.0, -20.0), share_scale=8, share_floor=50,
)

# Cleaning methods and the suffix of their written tables.
RECIPES = {
    r.method: r
    for r in (
        Recipe("raw", remove=False, fill=False, norm=False, suffix=None),
        Recipe("norm", remove=False, fill=False, norm=True, suffix="1_norm"),
        Recipe("fill", remove=False, fill=True, norm=False, suffix="2_fill"),
        Recipe("remove", remove=True, fill=False, norm=False, suffix="3_remove"),
        Recipe("remove_fill", remove=True, fill=True, norm=False, suffix="4_remove_fill"),
        Recipe("remove_norm", remove=True, fill=False, norm=True, suffix="5_remove_norm"),
        Recipe("fill_norm", remove=False, fill=True, norm=True, suffix="6_fill_norm"),
        Recipe("all", remove=True, fill=True, norm=True, suffix="7_all"),
    )
}

# Cleaning parameters.
NUMERIC_FILL = -999.0
CATEGORY_FILL = "MISSING"
IQR_MULTIPLIER = 3.0
MIN_UNIQUE = 10
MIN_FREQUENCY = 0.05

# Evaluation grids.
GRID_FULL = GridProfile(
    name="full",
    methods=("raw", "norm", "fill", "remove", "remove_fill", "remove_norm", "fill_norm", "all"),
    models=("RF", "NB", "MLP", "XGBoost"),
    levels=(20, 40, 60), damage_repeats=(1, 2, 3, 4, 5),
    cv_seeds=(101, 202, 303, 404, 505), folds=5,
    model_params={
        "RF": {"trees": 300},
        "MLP": {"hidden": 100, "iterations": 2000},
        "XGBoost": {"rounds": 250, "depth": 4, "step": 0.05, "rows": 0.9, "columns": 0.9},
    },
)
GRID_FAST = GridProfile(
    name="fast",
    methods=("raw", "fill", "remove_fill", "fill_norm", "all"),
    models=("RF", "NB", "XGBoost"),
    levels=(20, 40, 60), damage_repeats=(1, 2), cv_seeds=(101, 202), folds=3,
    model_params={
        "RF": {"trees": 180},
        "MLP": {"hidden": 80, "iterations": 1200},
        "XGBoost": {"rounds": 140, "depth": 4, "step": 0.08, "rows": 0.9, "columns": 0.9},
    },
)
GRID_10_50 = GridProfile(
    name="10_50",
    methods=("raw", "fill", "remove_fill", "fill_norm", "all"),
    models=("RF", "NB", "MLP", "XGBoost"),
    levels=(10, 20, 30, 40, 50), damage_repeats=(1, 2, 3), cv_seeds=(101, 202, 303), folds=4,
    model_params={
        "RF": {"trees": 220},
        "MLP": {"hidden": 100, "iterations": 1600},
        "XGBoost": {"rounds": 180, "depth": 4, "step": 0.07, "rows": 0.9, "columns": 0.9},
    },
)

# The study's four datasets and their column names.
STUDY_DATASETS = {
    d.name: d
    for d in (
        DatasetSpec(
            name="zapalenia", target="Zgon", row_key="Kod", protected=("Kod", "Zgon"), separator="|",
            continuous=(
                "Wiek", "Wiek_rozpoznania", "Kreatynina", "Max_CRP", "Sterydy_Dawka_g", "Anti-PR3_Wartosc",
            ),
        ),
        DatasetSpec(
            name="diabetes", target="decision", protected=("decision",),
            target_map={"tested_negative": 0, "tested_positive": 1},
            continuous=("plas", "pres", "skin", "insu", "mass", "pedi", "age"),
        ),
        DatasetSpec(
            name="serce", target="diagnoza", protected=("diagnoza",), target_map={1: 0, 2: 1},
            continuous=(
                "wiek", "cisnienie_krwi_spoczynek", "cholesterol_we_krwi", "ilosc_uderzen_serca",
                "max_obnizka_st",
            ),
        ),
        DatasetSpec(
            name="rezygnacje", target="REZYGN", row_key="NR_TEL", protected=("NR_TEL", "REZYGN"),
            continuous=(
                "CZAS_POSIADANIA", "L_WIAD_POCZTA_G", "DZIEN_MIN", "DZIEN_L_POL", "DZIEN_OPLATA",
                "WIECZOR_MIN", "WIECZ_L_POL", "WIECZ_OPLATA", "NOC_MIN", "NOC_L_POL", "NOC_OPLATA",
                "MIEDZY_MIN", "MIEDZY_L_POL", "MIEDZY_OPLATA", "L_POL_BIURO",
            ),
        ),
    )
}


def recipe(method: str) -> Recipe:
    """The recipe called ``method``; an unknown name is an error."""
    if method not in RECIPES:
        raise ValueError(f"unknown cleaning method {method!r}; choose from {sorted(RECIPES)}")
    return RECIPES[method]
