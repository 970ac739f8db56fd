"""Leak-free cross-validation of cleaning recipes.

Folds are a column: every (variant, seed, held-out fold) is a key group whose
statistics come from the states of the other folds, and one set of jobs fits and
scores the whole grid for naive Bayes; perceptrons, boosted trees and forests of all groups
are trained side by side in the same jobs. Rows stand once a seed, and are cleaned once
a method, under the fold that holds them out. Other Spark ML models need one fit per
group; those run from a small driver thread pool on shared input.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import join_same, nan_to_null, ref, roles_by_type
from ..functions.levels import level_label
from ..operators.cleaning import FittedCleaning
from ..operators.complements import ComplementFit, fit_complements
from ..operators.damage import VARIANT, fit_damage
from ..operators.folds import assign_folds, fold_table
from ..operators.forest import forest_scores
from ..operators.labels import label_table
from ..operators.boosting import fit_boosters, score_boosters
from ..operators.metrics import roc_auc
from ..operators.models import BINS, MOST_DEPTH, assembled, get_estimator
from ..operators.naive_bayes import score_gaussian_nb
from ..operators.perceptron import fit_perceptrons, score_perceptrons
from ..sources.workspace import materialise, small_table
from ..specs import DamageProfile, DatasetSpec, GridProfile

RUN_KEYS = (*VARIANT, "cv_repeat", "cv_seed")
FOLD_KEYS = (*RUN_KEYS, "held_out")
# Rows that a row stands for.
ALIKE = "__alike"
# Concurrent Spark ML fits.
FIT_THREADS = 4
# Models that are trained in the same jobs.
MODELS_TOGETHER = 64


def variant_table(
    df: DataFrame, spec: DatasetSpec, profile: DamageProfile, variants: Iterable[tuple[int, int]]
) -> DataFrame:
    """The labelled table undamaged (level 0, repeat 0) and in every variant, written once."""
    labelled = label_table(nan_to_null(df), spec)
    plan = fit_damage(labelled, spec, profile, variants)
    dirty = plan.apply(labelled)
    clean = labelled.select(
        F.lit(0).alias("damage_level"),
        F.lit(0).alias("damage_repeat"),
        *[ref(f.name).cast(f.dataType).alias(f.name) for f in dirty.schema.fields if f.name not in VARIANT],
    )
    return materialise(clean.unionByName(dirty), "variants")


def folded_rows(table: DataFrame, spec: DatasetSpec, folds: int, seeds: Sequence[int]) -> DataFrame:
    """``table`` once per seed, with ``fold``; the same row has the same fold in every variant."""
    cuts = fold_table(table.where(F.col("damage_level") == 0), spec.row_key, spec.target, folds, seeds)
    return assign_folds(table, spec.row_key, spec.target, folds, seeds, cuts)


def held_out_rows(folded: DataFrame) -> DataFrame:
    """``folded`` rows under the fold that holds them out."""
    return folded.withColumn("held_out", F.col("fold"))


def _features(table: DataFrame, spec: DatasetSpec) -> tuple[list[str], list[str]]:
    return roles_by_type(table, exclude=(*spec.kept_out, *VARIANT))


def fit_by_fold(folded: DataFrame, table: DataFrame, spec: DatasetSpec, methods: Sequence[str], folds: int) -> ComplementFit:
    """Cleaning statistics of every key group, from the folds it trains on."""
    numeric, categorical = _features(table, spec)
    return fit_complements(folded, numeric, categorical, spec.target, RUN_KEYS, folds, methods)


def sides_of(
    table: DataFrame, spec: DatasetSpec, methods: Sequence[str], folds: int, seeds: Sequence[int]
) -> tuple[DataFrame, ComplementFit]:
    """The folded rows and the statistics of every key group; all kinds of model that a grid evaluates can share them."""
    folded = folded_rows(table, spec, folds, seeds)
    return folded, fit_by_fold(folded, table, spec, methods, folds)


def methods_of(group: tuple, methods: Sequence[str]) -> Sequence[str]:
    """The undamaged table is only cleaned as ``raw``, if that is among the methods."""
    return ["raw"] if group[0] == 0 and "raw" in methods else methods


def cleaned_by_fold(
    rows: DataFrame, fitted: FittedCleaning, spec: DatasetSpec, methods: Sequence[str], keep: Sequence[str]
) -> tuple[DataFrame, list[str], list[str]]:
    """Each row once per method, cleaned but not encoded; the undamaged table only as ``raw``.

    Returns the rows, with their ``keep`` columns, and the names of their numeric and categorical columns.
    """
    joined, cleaned = fitted.cleaned_by_method(rows, lambda group: methods_of(group, methods))
    numeric = {c: f"x{i}" for i, c in enumerate(fitted.numeric)}
    categorical = {c: f"c{i}" for i, c in enumerate(fitted.categorical)}
    slots = {**numeric, **categorical}
    out = joined.select(
        *FOLD_KEYS, *[ref(k) for k in keep], ref(spec.target).alias("label"), "method", *[cleaned[c].alias(s) for c, s in slots.items()]
    )
    return out, list(numeric.values()), list(categorical.values())


def nb_scores(
    table: DataFrame, spec: DatasetSpec, methods: Sequence[str], folds: int, seeds: Sequence[int],
    sides: tuple[DataFrame, ComplementFit] | None = None,
) -> DataFrame:
    """Held-out probability of class 1 for the rows of every seed, method and fold.

    Rows of a fold with the same cells and label are one row, of ``alike`` rows: they are cleaned and scored alike.
    """
    folded, fit = sides or sides_of(table, spec, methods, folds, seeds)
    model = fit.naive_bayes(table.sparkSession, lambda group: methods_of(group, methods))
    cells = [ref(c) for c in (spec.target, *fit.cleaning.numeric, *fit.cleaning.categorical)]
    rows = held_out_rows(folded).groupBy(*FOLD_KEYS, *cells).agg(F.count("*").alias(ALIKE))
    cleaned, numeric, categorical = cleaned_by_fold(rows, fit.cleaning, spec, methods, [ALIKE])
    categorical = dict(zip(fit.cleaning.categorical, categorical))
    keys = [*FOLD_KEYS, "method"]
    scored = score_gaussian_nb(cleaned, model, numeric, categorical, keys)
    return scored.select(*keys, ALIKE, "label", "score")


def run_details(fold_aucs: DataFrame, dataset: str, model: str, digits: int = 4) -> DataFrame:
    """Mean fold AUC of each run, rounded, in the layout of the detail table; NULL if a fold has none."""
    return (
        fold_aucs.groupBy(*VARIANT, "method", "cv_repeat", "cv_seed")
        .agg(F.when(F.count("auc") == F.count("*"), F.round(F.avg("auc"), digits)).alias("auc"))
        .select(
            F.lit(dataset).alias("dataset"),
            level_label("damage_level").alias("damage_level"),
            "method",
            F.lit(model).alias("model"),
            "damage_repeat",
            "cv_repeat",
            "cv_seed",
            "auc",
        )
    )


def cross_validate_nb(
    table: DataFrame, spec: DatasetSpec, methods: Sequence[str], folds: int, seeds: Sequence[int],
    sides: tuple[DataFrame, ComplementFit] | None = None,
) -> DataFrame:
    """Detail rows for naive Bayes over all variants, methods and seeds."""
    scored = nb_scores(table, spec, methods, folds, seeds, sides)
    aucs = roc_auc(scored, "score", "label", [*FOLD_KEYS, "method"], alike=ALIKE)
    return run_details(aucs, spec.name, "NB")


def cv_seed_of(group: tuple) -> int:
    return group[FOLD_KEYS.index("cv_seed")]


def _feature_rows(folded: DataFrame, fit: ComplementFit, spec: DatasetSpec, method: str, numbers: dict[tuple, int]) -> DataFrame:
    """model, in_training, label, digest and features of every row for each side it is trained or scored on.

    Each side cleans a row in its own way, so features differ from side to side; they are made in place, without a shuffle.
    """
    held = small_table(folded.sparkSession, [[h] for h in range(fit.folds)], T.StructType([T.StructField("held_out", T.IntegerType())]))
    rows = folded.crossJoin(F.broadcast(held)).withColumn("__label", ref(spec.target)).withColumn("__key", ref(spec.row_key))
    keep = [*FOLD_KEYS, "fold", "__label", "__key"]
    matrix = fit.cleaning.transform(rows, method, keep=keep)
    features = [F.coalesce(ref(c).cast("double"), F.lit(0.0)) for c in matrix.columns if c not in keep]
    schema = T.StructType([*matrix.select(*FOLD_KEYS).schema.fields, T.StructField("model", T.IntegerType())])
    table = small_table(folded.sparkSession, [[*k[:-1], n] for k, n in numbers.items() if k[-1] == method], schema)
    return join_same(matrix, F.broadcast(table), FOLD_KEYS).select(
        "model",
        (F.col("fold") != F.col("held_out")).alias("in_training"),
        F.col("__label").cast("int").alias("label"),
        F.xxhash64("cv_seed", "__key").alias("digest"),
        F.array(*features).cast("array<double>").alias("features"),
    )


def cross_validate_together(
    table: DataFrame, spec: DatasetSpec, methods: Sequence[str], models: Sequence[str], folds: int, seeds: Sequence[int],
    params: dict | None = None, sides: tuple[DataFrame, ComplementFit] | None = None,
) -> DataFrame:
    """Detail rows for perceptrons, boosted trees and forests: all sides, methods and variants are trained in the same jobs."""
    folded, fit = sides or sides_of(table, spec, methods, folds, seeds)
    every = [(*g, m) for g in fit.cleaning.groups for m in methods_of(g, methods)]
    params, parts = params or {}, []
    for begin in range(0, len(every), MODELS_TOGETHER):
        numbers = {k: n for n, k in enumerate(every[begin : begin + MODELS_TOGETHER], begin)}
        own = [_feature_rows(folded, fit, spec, m, numbers) for m in dict.fromkeys(k[-1] for k in numbers)]
        rows = materialise(reduce(DataFrame.unionByName, own), "features")
        of_model = {n: cv_seed_of(k) for k, n in numbers.items()}
        training, test = rows.where("in_training"), rows.where("not in_training")
        schema = T.StructType([T.StructField("model", T.IntegerType()), *[T.StructField(k, T.IntegerType()) for k in FOLD_KEYS], T.StructField("method", T.StringType())])
        names = small_table(table.sparkSession, [[n, *k] for k, n in numbers.items()], schema)
        for model in models:
            p = params.get(model, {})
            if model == "MLP":
                fitted = fit_perceptrons(training, of_model, int(p.get("hidden", 100)), int(p.get("iterations", 2000)))
                scored = score_perceptrons(test, fitted)
            elif model == "RF":
                scored = forest_scores(
                    training, test, of_model, int(p.get("trees", 100)), int(p.get("depth", MOST_DEPTH)), int(p.get("bins", BINS))
                )
            else:
                fitted = fit_boosters(
                    training, of_model, int(p.get("rounds", 250)), int(p.get("depth", 4)), float(p.get("step", 0.05)),
                    float(p.get("rows", 0.9)), float(p.get("columns", 0.9)), int(p.get("bins", BINS)),
                )
                scored = score_boosters(test, fitted)
            aucs = roc_auc(scored, "score", "label", ["model"], alike="alike" if model == "RF" else None).join(F.broadcast(names), "model")
            parts.append(run_details(aucs, spec.name, model))
    return reduce(DataFrame.unionByName, parts)


def cross_validate_models(
    table: DataFrame,
    spec: DatasetSpec,
    methods: Sequence[str],
    models: Sequence[str],
    folds: int,
    seeds: Sequence[int],
    params: dict | None = None,
    threads: int = FIT_THREADS,
    sides: tuple[DataFrame, ComplementFit] | None = None,
) -> DataFrame:
    """Detail rows for Spark ML models: one distributed fit per variant, method, seed and fold.

    The rows of a variant and seed are kept while its folds and methods are fitted.
    """
    spark = table.sparkSession
    folded, fit = sides or sides_of(table, spec, methods, folds, seeds)
    fitted = fit.cleaning

    def run(own: DataFrame, group: tuple, method: str) -> list[list]:
        held_out = group[-1]
        local = FittedCleaning(
            fitted.numeric, fitted.categorical, T.StructType([]),
            {(): fitted.numeric_stats[group]}, {(): fitted.category_stats[group]},
        )
        matrix = local.transform(own, method, keep=["label", "fold"])
        features = [c for c in matrix.columns if c not in ("label", "fold")]
        vectors = assembled(matrix, features, ["label", "fold"]).persist()
        evaluator = BinaryClassificationEvaluator(
            rawPredictionCol="probability", labelCol="label", metricName="areaUnderROC", numBins=0
        )
        try:
            out = []
            for model in models:
                estimator = get_estimator(model, cv_seed_of(group), len(features), params)
                trained = estimator.fit(vectors.where(F.col("fold") != held_out))
                auc = evaluator.evaluate(trained.transform(vectors.where(F.col("fold") == held_out)))
                out.append([*group, method, model, float(auc)])
            return out
        finally:
            vectors.unpersist()

    found: list[list] = []
    with ThreadPoolExecutor(max_workers=threads) as pool:
        for level, repeat, seed in dict.fromkeys((g[0], g[1], cv_seed_of(g)) for g in fitted.groups):
            own = (
                folded.where(
                    (F.col("damage_level") == level) & (F.col("damage_repeat") == repeat) & (F.col("cv_seed") == seed)
                )
                .withColumn("label", ref(spec.target))
                .persist()
            )
            mine = [g for g in fitted.groups if (g[0], g[1], cv_seed_of(g)) == (level, repeat, seed)]
            jobs = [pool.submit(run, own, g, m) for g in mine for m in methods_of(g, methods)]
            found += [row for job in jobs for row in job.result()]
            own.unpersist()
    schema = T.StructType(
        [T.StructField(k, T.IntegerType()) for k in FOLD_KEYS]
        + [T.StructField("method", T.StringType()), T.StructField("model", T.StringType()),
           T.StructField("auc", T.DoubleType())]
    )
    # One row per fit.
    aucs = small_table(spark, found, schema)
    parts = [run_details(aucs.where(F.col("model") == m), spec.name, m) for m in models]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def run_grid(
    df: DataFrame, spec: DatasetSpec, profile: DamageProfile, grid: GridProfile
) -> DataFrame:
    """Detail rows of a dataset over a whole grid profile."""
    return run_variants(df, spec, profile, grid, [(lv, rp) for lv in grid.levels for rp in grid.damage_repeats])


def run_variants(
    df: DataFrame, spec: DatasetSpec, profile: DamageProfile, grid: GridProfile, variants: Sequence[tuple[int, int]]
) -> DataFrame:
    """Detail rows of the undamaged table and the given (level, repeat) variants, for a grid's methods and models."""
    table = variant_table(df, spec, profile, variants)
    sides = sides_of(table, spec, grid.methods, grid.folds, grid.cv_seeds)
    parts = []
    if "NB" in grid.models:
        parts.append(cross_validate_nb(table, spec, grid.methods, grid.folds, grid.cv_seeds, sides))
    together = [m for m in grid.models if m in ("MLP", "XGBoost", "RF")]
    if together:
        parts.append(
            cross_validate_together(
                table, spec, grid.methods, together, grid.folds, grid.cv_seeds, dict(grid.model_params), sides=sides
            )
        )
    others = [m for m in grid.models if m not in ("NB", *together)]
    if others:
        parts.append(
            cross_validate_models(
                table, spec, grid.methods, others, grid.folds, grid.cv_seeds, dict(grid.model_params), sides=sides
            )
        )
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
