"""The registered queries: every operator on the driver's tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from frameclinic.functions.columns import as_double
from frameclinic.functions.levels import level_label, level_order, model_order
from frameclinic.operators import damage, encoding, metrics, models, summary, treatments
from frameclinic.operators.cleaning import fit_cleaning, value_shares
from frameclinic.operators.folds import assign_folds, hash_split
from frameclinic.operators.labels import drop_columns, label_table, require_positive_class
from frameclinic.operators.naive_bayes import fit_gaussian_nb, score_gaussian_nb
from frameclinic.operators.quantiles import exact_quantiles
from frameclinic.operators.stages import RecipeCleaner, RecipeModel
from frameclinic.plans import evaluate
from frameclinic.plans.grid import build_grid, resolve_variants
from frameclinic.plans.repair import repair_variants, write_repaired
from frameclinic.plans.study import resume_study
from frameclinic.sources.tables import (
    load_dataset,
    named_variants,
    read_delimited,
    read_located,
    read_variants,
    stored_variants,
    variant_name,
    with_row_key,
    write_named,
    write_results,
    write_variants,
)
from frameclinic.sources.workspace import materialise, new_folder
from frameclinic.specs import GRID_10_50, GRID_FAST, GRID_FULL, PROFILE_A, PROFILE_B, RECIPES, DatasetSpec, GridProfile

ORDERS = DatasetSpec(
    name="orders", target="o_orderstatus", row_key="o_orderkey", continuous=("o_totalprice",),
    target_map={"F": 1, "O": 0, "P": 0},
)
DOCS = DatasetSpec(name="documents", target="quality", row_key="doc_id", continuous=("n_chars",))
CUSTOMERS = DatasetSpec(
    name="customer", target="c_mktsegment", row_key="c_custkey", protected=("c_name",), continuous=("c_acctbal",)
)
EVENTS = DatasetSpec(name="events", target="label", row_key="event_id", continuous=("value",))

CV_SEEDS = (101, 202)
CV_FOLDS = 3
NB_METHODS = ("raw", "fill", "remove", "all")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def orders(spark, folder) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", "o_custkey", "o_orderpriority"
    )


def labelled_docs(spark, folder) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "n_chars", "lang", "source")
    return docs.join(table(spark, folder, "labels").select("doc_id", "quality"), "doc_id")


def customers(spark, folder) -> DataFrame:
    return table(spark, folder, "customer")


def r6(column, digits: int = 6):
    """Rounded for comparison across engines, without a negative zero."""
    return F.round(column, digits) + F.lit(0.0)


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    doubles = {f.name for f in df.schema.fields if isinstance(f.dataType, T.DoubleType)}
    return df.select(
        *[r6(F.col(f"`{c}`"), digits).alias(c) if c in doubles else F.col(f"`{c}`") for c in df.columns]
    )


# -- cleaning statistics -------------------------------------------------------


def iqr_bounds(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events").select("event_type", "value", "user_id")
    fitted = fit_cleaning(rows, ["value", "user_id"], [], keys=["event_type"], methods=["remove"])
    return rounded(fitted.bounds(spark))


def outlier_to_null(spark, folder) -> DataFrame:
    rows = table(spark, folder, "events").select("event_id", "event_type", "value")
    fitted = fit_cleaning(rows, ["value"], [], methods=["remove"])
    joined, params = fitted.attach(rows, ["remove"])
    return joined.select("event_id", "event_type", fitted.nulled_numeric("value", params).alias("value"))


def rare_categories(spark, folder) -> DataFrame:
    rows = table(spark, folder, "part").select("p_brand", "p_type")
    return fit_cleaning(rows, [], ["p_brand", "p_type"], methods=["remove"], min_frequency=0.04).valid_categories(spark)


def _rare_to_null(spark, folder, min_frequency) -> DataFrame:
    rows = table(spark, folder, "part").select("p_partkey", "p_brand", "p_type")
    fitted = fit_cleaning(rows, [], ["p_brand", "p_type"], methods=["remove"], min_frequency=min_frequency)
    joined, params = fitted.attach(rows, ["remove"])
    return joined.select(
        "p_partkey", *[fitted.nulled_category(c, params).alias(c) for c in ("p_brand", "p_type")]
    )


def rare_to_null(spark, folder) -> DataFrame:
    return _rare_to_null(spark, folder, 0.04)


def rare_all_invalid(spark, folder) -> DataFrame:
    return _rare_to_null(spark, folder, 0.05)


def relative_frequency(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderstatus", "o_orderpriority")
    return rounded(value_shares(rows, ["o_orderpriority"], ["o_orderstatus"]))


def distinct_counts(spark, folder) -> DataFrame:
    """Non-null distinct values per column: one long, map-side combined grouping."""
    rows = table(spark, folder, "lineitem")
    columns = ["l_quantity", "l_discount", "l_tax", "l_linenumber"]
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])
    values = rows.select(F.inline(cells)).dropna().distinct()
    return values.groupBy("column").agg(F.count("*").alias("n_distinct"))


def quantiles(spark, folder) -> DataFrame:
    rows = table(spark, folder, "lineitem")
    found = exact_quantiles(rows, ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.75], ["l_returnflag"])
    return rounded(
        found.select(
            "l_returnflag", "column",
            *[F.col("quantiles")[i].alias(n) for i, n in enumerate(("q1", "median", "q3"))],
        )
    )


# -- damage --------------------------------------------------------------------


def inject_missing(spark, folder) -> DataFrame:
    return damage.inject_missingness(orders(spark, folder), ORDERS, PROFILE_A, 20)


def inject_outliers_a(spark, folder) -> DataFrame:
    return rounded(damage.inject_continuous_outliers(orders(spark, folder), ORDERS, PROFILE_A, 20))


def inject_outliers_b(spark, folder) -> DataFrame:
    return rounded(damage.inject_continuous_outliers(orders(spark, folder), ORDERS, PROFILE_B, 10))


def inject_noise_a(spark, folder) -> DataFrame:
    return damage.inject_categorical_noise(orders(spark, folder), ORDERS, PROFILE_A, 20)


def inject_noise_b(spark, folder) -> DataFrame:
    return damage.inject_categorical_noise(orders(spark, folder), ORDERS, PROFILE_B, 10)


def _dirty_orders(spark, folder, variants=((20, 1),), profile=PROFILE_A) -> DataFrame:
    return damage.inject(orders(spark, folder), ORDERS, profile, variants)


def dirty_variant(spark, folder) -> DataFrame:
    return rounded(_dirty_orders(spark, folder))


def dirty_variant_b(spark, folder) -> DataFrame:
    return rounded(_dirty_orders(spark, folder, ((50, 3),), PROFILE_B))


def variant_grid(spark, folder) -> DataFrame:
    """Profile A's 15 variants of the customers, counted."""
    dirty = damage.inject(customers(spark, folder), CUSTOMERS, PROFILE_A)
    return rounded(
        dirty.groupBy("damage_level", "damage_repeat").agg(
            F.count("*").alias("n_rows"),
            F.count("c_acctbal").alias("n_acctbal"),
            F.sum("c_acctbal").alias("sum_acctbal"),
            F.count("c_nationkey").alias("n_nationkey"),
            F.sum("c_nationkey").alias("sum_nationkey"),
        ),
        2,
    )


def variant_round_trip(spark, folder) -> DataFrame:
    """Write damaged customers as delimited text, read them back, count."""
    path = new_folder(spark, "variants")
    dirty = damage.inject(customers(spark, folder), CUSTOMERS, PROFILE_B, ((10, 1), (50, 2)))
    write_variants(dirty, path)
    schema = T.StructType([f for f in dirty.schema.fields if not f.name.startswith("damage_")])
    back = read_delimited(spark, path, "|", schema)
    return rounded(
        back.groupBy("damage_level", "damage_repeat").agg(
            F.count("*").alias("n_rows"), F.count("c_acctbal").alias("n_acctbal"),
            F.sum("c_acctbal").alias("sum_acctbal"), F.sum("c_nationkey").alias("sum_nationkey"),
        ),
        2,
    )


def stored_variant_grid(spark, folder) -> DataFrame:
    """Store profile A's variants, list and resolve what is there, read the resolved ones and count."""
    path = new_folder(spark, "stored")
    dirty = damage.inject(customers(spark, folder), CUSTOMERS, PROFILE_A)
    write_variants(dirty, path)
    schema = T.StructType([f for f in dirty.schema.fields if not f.name.startswith("damage_")])
    catalog = stored_variants(spark, path, "customer", schema)
    wanted = spark.createDataFrame(
        [("customer", lv, rp) for lv in (*PROFILE_A.levels, 99) for rp in range(1, PROFILE_A.repeats + 1)],
        "dataset string, damage_level int, damage_repeat int",
    )
    chosen = [(r["damage_level"], r["damage_repeat"]) for r in resolve_variants(wanted, catalog).collect()]
    back = read_variants(spark, path, chosen, schema)
    return rounded(
        back.groupBy("damage_level", "damage_repeat").agg(
            F.count("*").alias("n_rows"),
            F.count("c_acctbal").alias("n_acctbal"),
            F.sum("c_acctbal").alias("sum_acctbal"),
            F.count("c_nationkey").alias("n_nationkey"),
            F.sum("c_nationkey").alias("sum_nationkey"),
        ),
        2,
    )


# -- repair --------------------------------------------------------------------


def _fitted_orders(spark, folder, methods):
    dirty = materialise(_dirty_orders(spark, folder).drop("damage_level", "damage_repeat"), "dirty")
    features = drop_columns(dirty, ORDERS.kept_out)
    return dirty, fit_cleaning(features, methods=methods)


def _imputed(spark, folder, method, columns) -> DataFrame:
    dirty, fitted = _fitted_orders(spark, folder, [method])
    return rounded(fitted.clean(dirty, method).select("o_orderkey", *columns))


def impute_constant(spark, folder) -> DataFrame:
    return _imputed(spark, folder, "raw", ["o_totalprice", "o_custkey", "o_orderpriority"])


def impute_median(spark, folder) -> DataFrame:
    return _imputed(spark, folder, "fill", ["o_totalprice", "o_custkey"])


def impute_mode(spark, folder) -> DataFrame:
    return _imputed(spark, folder, "fill", ["o_orderpriority"])


def standardise(spark, folder) -> DataFrame:
    return _imputed(spark, folder, "fill_norm", ["o_totalprice", "o_custkey"])


def one_hot(spark, folder) -> DataFrame:
    dirty, fitted = _fitted_orders(spark, folder, ["fill"])
    coded = fitted.transform(dirty, "fill", keep=["o_orderkey"])
    return coded.select("o_orderkey", *[f"`{c}`" for c in coded.columns if c.startswith("cat__")])


def one_hot_long(spark, folder) -> DataFrame:
    rows = table(spark, folder, "part")
    hot = encoding.one_hot_long(rows, ["p_brand", "p_type"], ["p_partkey"])
    return hot


def minmax(spark, folder) -> DataFrame:
    dirty = _dirty_orders(spark, folder).select("o_orderkey", "o_totalprice", "o_custkey")
    return rounded(encoding.min_max_scale(dirty, ["o_totalprice", "o_custkey"]))


def dummies(spark, folder) -> DataFrame:
    return encoding.dummies(table(spark, folder, "orders").select("o_orderkey", "o_orderpriority"))


def dummies_drop_first(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority")
    return encoding.dummies(rows, drop_first=True)


def _clean(method: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, folder) -> DataFrame:
        dirty, fitted = _fitted_orders(spark, folder, [method])
        return rounded(fitted.transform(dirty, method, keep=["o_orderkey", "o_orderstatus"]))

    return run


def saved_recipe(spark, folder) -> DataFrame:
    """The whole recipe fitted as a pipeline stage, saved, loaded and applied."""
    dirty = materialise(_dirty_orders(spark, folder).drop("damage_level", "damage_repeat"), "dirty")
    path = new_folder(spark, "recipe")
    RecipeCleaner(method="all", keep=["o_orderkey", "o_orderstatus"]).fit(dirty).save(path)
    return rounded(RecipeModel.load(path).transform(dirty))


def repair_by_variant(spark, folder) -> DataFrame:
    """Two damaged variants, each repaired with its own statistics."""
    dirty = materialise(_dirty_orders(spark, folder, ((20, 1), (40, 2))), "dirty")
    return rounded(repair_variants(dirty, ORDERS, "all"))


def repaired_files(spark, folder) -> DataFrame:
    """Repaired customer variants written as text under the method's suffix, and read back."""
    path = new_folder(spark, "repaired")
    dirty = materialise(damage.inject(customers(spark, folder), CUSTOMERS, PROFILE_A, ((20, 1), (60, 5))), "dirty")
    write_repaired(dirty, CUSTOMERS, path, ["remove_fill"])
    back = read_delimited(spark, f"{path}/4_remove_fill", "|")
    return rounded(
        back.groupBy("damage_level", "damage_repeat").agg(
            F.count("*").alias("n_rows"), F.sum("num__c_acctbal").alias("sum_acctbal"),
            F.sum("num__c_nationkey").alias("sum_nationkey"),
        ),
        2,
    )


def repaired_files_all(spark, folder) -> DataFrame:
    """The same under the suffix of every method that has one, counted by suffix."""
    path = new_folder(spark, "repaired")
    dirty = materialise(damage.inject(customers(spark, folder), CUSTOMERS, PROFILE_A, ((20, 1), (60, 5))), "dirty")
    write_repaired(dirty, CUSTOMERS, path)
    parts = [
        read_delimited(spark, f"{path}/{r.suffix}", "|").groupBy("damage_level", "damage_repeat").agg(
            F.lit(r.suffix).alias("suffix"), F.count("*").alias("n_rows"), F.sum("num__c_acctbal").alias("sum_acctbal"),
            F.sum("num__c_nationkey").alias("sum_nationkey"),
        )
        for r in RECIPES.values() if r.suffix
    ]
    return rounded(reduce(DataFrame.unionByName, parts), 2)


# -- labels, levels, grids -----------------------------------------------------


def map_target(spark, folder) -> DataFrame:
    """Unmapped statuses become missing and their rows are dropped."""
    spec = DatasetSpec(name="orders", target="o_orderstatus", row_key="o_orderkey", target_map={"F": 1, "O": 0})
    mapped = label_table(orders(spark, folder), spec)
    return drop_columns(mapped, ["o_custkey", "no_such_column"]).select("o_orderkey", "o_orderstatus", "o_totalprice")


def labelled_file(spark, folder) -> DataFrame:
    """Write orders as delimited text and load them as a labelled dataset."""
    path = new_folder(spark, "orders")
    orders(spark, folder).write.option("header", True).option("sep", "|").csv(path)
    spec = DatasetSpec(
        name="orders", target="o_orderstatus", row_key="o_orderkey", target_map={"F": 1, "O": 0}, separator="|"
    )
    return load_dataset(spark, path, spec).groupBy("o_orderstatus", "o_orderpriority").agg(
        F.count("*").alias("n"), r6(F.sum("o_totalprice"), 2).alias("total")
    )


def text_to_number(spark, folder) -> DataFrame:
    """Text that is no number becomes missing."""
    props = F.regexp_extract("props", r'"k": *([^}]*)', 1)
    return table(spark, folder, "events").select(
        "event_id", as_double(props).alias("k"), as_double(F.col("event_type")).alias("not_a_number")
    )


def level_order_query(spark, folder) -> DataFrame:
    """Damage labels in order, derived from the line numbers (0 = undamaged)."""
    percent = ((F.col("l_linenumber") - 1) * 10).cast("int")
    rows = table(spark, folder, "lineitem").select(level_label(percent).alias("damage_level"))
    counted = rows.groupBy("damage_level").agg(F.count("*").alias("n"))
    return counted.withColumn("level_order", level_order("damage_level")).orderBy("level_order")


def grid(spark, folder) -> DataFrame:
    """The fast grid over one dataset per document source."""
    sources = table(spark, folder, "documents").select(F.col("source").alias("dataset")).distinct()
    return build_grid(sources, GRID_FAST)


def resolve_variant(spark, folder) -> DataFrame:
    """Which stored variant stands for each wanted one; order lines play the catalog."""
    lines = table(spark, folder, "lineitem")
    stored = lines.groupBy(
        F.col("l_returnflag").alias("dataset"),
        (F.col("l_linenumber") * 10).cast("int").alias("damage_level"),
        (F.col("l_suppkey") % 7).cast("int").alias("slot"),
    ).agg(F.count("*").alias("n"))
    catalog = stored.where((F.col("n") + F.col("slot")) % 3 != 0).select(
        "dataset", "damage_level",
        F.when((F.col("slot") > 0) & (F.col("slot") <= 5), F.col("slot")).alias("damage_repeat"),
        F.concat_ws("/", "dataset", F.col("damage_level").cast("string"), F.col("slot").cast("string")).alias("location"),
    ).where("damage_repeat is not null or location like '%/0'")
    wanted = stored.where("slot between 1 and 5").select(
        "dataset", "damage_level", F.col("slot").alias("damage_repeat")
    )
    return resolve_variants(wanted, catalog)


# -- folds, naive Bayes, metrics -----------------------------------------------


def stratified_folds(spark, folder) -> DataFrame:
    rows = orders(spark, folder).select("o_orderkey", "o_orderstatus")
    return assign_folds(rows, "o_orderkey", "o_orderstatus", 5, [101, 202, 303])


def holdout_split(spark, folder) -> DataFrame:
    return hash_split(orders(spark, folder).select("o_orderkey"), "o_orderkey", 42)


def _orders_by_fold(spark, folder, methods):
    table_ = evaluate.variant_table(orders(spark, folder), ORDERS, PROFILE_A, [(20, 1)])
    folded = evaluate.folded_rows(table_, ORDERS, CV_FOLDS, [101])
    return folded, evaluate.fit_by_fold(folded, table_, ORDERS, methods, CV_FOLDS).cleaning


def fold_stats(spark, folder) -> DataFrame:
    """Outlier bounds learned from the training rows of every fold."""
    _, fitted = _orders_by_fold(spark, folder, ["remove"])
    return rounded(fitted.bounds(spark))


def clean_by_fold(spark, folder) -> DataFrame:
    """Held-out rows cleaned with the statistics of their training folds."""
    folded, fitted = _orders_by_fold(spark, folder, ["all"])
    test = evaluate.held_out_rows(folded)
    keep = ["damage_level", "damage_repeat", "cv_seed", "held_out", "o_orderkey"]
    coded = fitted.transform(test, "all", keep=keep)
    return rounded(coded.select(*keep, *[f"`{c}`" for c in coded.columns if c.startswith("num__")]))


def _doc_scores(spark, folder) -> DataFrame:
    """In-sample naive Bayes scores of the labelled documents."""
    docs = materialise(labelled_docs(spark, folder), "docs")
    require_positive_class(docs, "quality")
    fitted = fit_cleaning(docs.select("n_chars", "lang", "source"), methods=["fill_norm"])
    cleaned = fitted.clean(docs, "fill_norm")
    model = fit_gaussian_nb(cleaned, fitted.numeric, fitted.categorical, "quality")
    scored = score_gaussian_nb(cleaned, model, fitted.numeric, fitted.categorical)
    return scored.select("doc_id", "lang", "quality", "score")


def nb_scores(spark, folder) -> DataFrame:
    return rounded(_doc_scores(spark, folder))


def auc(spark, folder) -> DataFrame:
    return rounded(metrics.roc_auc(_doc_scores(spark, folder), "score", "quality", ["lang"]))


def auc_of_discounts(spark, folder) -> DataFrame:
    """AUC with heavy ties: does the discount tell returned lines apart, per line status?"""
    rows = table(spark, folder, "lineitem").select(
        "l_linestatus", "l_discount", F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("returned")
    )
    return rounded(metrics.roc_auc(rows, "l_discount", "returned", ["l_linestatus"]))


def roc_points(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders").select(
        F.col("o_totalprice"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    )
    return rounded(metrics.roc_points(rows, "o_totalprice", "label"))


def threshold_metrics(spark, folder) -> DataFrame:
    return rounded(metrics.threshold_metrics(_doc_scores(spark, folder), "score", "quality"))


def threshold_search(spark, folder) -> DataFrame:
    return rounded(metrics.threshold_search(_discount_scores(spark, folder), "score", "label", ["l_linestatus"]))


def threshold_report(spark, folder) -> DataFrame:
    return rounded(metrics.threshold_report(_discount_scores(spark, folder), "score", "label", ["l_linestatus"], 0.5))


def _discount_scores(spark, folder) -> DataFrame:
    """Scores that fall exactly on thresholds: two-decimal numbers from order lines."""
    return table(spark, folder, "lineitem").select(
        "l_linestatus",
        (F.col("l_quantity") / 50.0).alias("score"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("label"),
    )


def nb_cv_auc(spark, folder) -> DataFrame:
    """The whole study for naive Bayes: damage, folds, per-fold cleaning, scores, AUC, runs."""
    table_ = evaluate.variant_table(labelled_docs(spark, folder), DOCS, PROFILE_A, [(20, 1), (40, 2)])
    return evaluate.cross_validate_nb(table_, DOCS, NB_METHODS, CV_FOLDS, CV_SEEDS)


def nb_grid_fast(spark, folder) -> DataFrame:
    """Naive Bayes over the whole fast grid: its variants, methods, seeds and folds."""
    return evaluate.run_grid(labelled_docs(spark, folder), DOCS, PROFILE_A, replace(GRID_FAST, models=("NB",)))


def nb_grid_full(spark, folder) -> DataFrame:
    """Naive Bayes over the whole full grid: 15 variants, eight methods, five seeds, five folds."""
    return evaluate.run_grid(labelled_docs(spark, folder), DOCS, PROFILE_A, replace(GRID_FULL, models=("NB",)))


def nb_grid_10_50(spark, folder) -> DataFrame:
    """Naive Bayes over the whole grid of the milder profile."""
    return evaluate.run_grid(labelled_docs(spark, folder), DOCS, PROFILE_B, replace(GRID_10_50, models=("NB",)))


def resumed_study(spark, folder) -> DataFrame:
    """The fast grid's study over two tables in two goes: one level first, then what is left of the whole grid."""
    path = new_folder(spark, "study")
    tables = {"documents": labelled_docs(spark, folder), "short": labelled_docs(spark, folder).where("n_chars < 2000")}
    specs = {n: replace(DOCS, name=n) for n in tables}
    grid = replace(GRID_FAST, models=("NB",))
    resume_study(dict(list(tables.items())[:1]), PROFILE_A, replace(grid, levels=(20,), methods=("raw", "fill")), path, specs)
    detail = resume_study(tables, PROFILE_A, grid, path, specs)
    return summary.summarise(detail, digits=6)


def stored_stand_in(spark, folder) -> DataFrame:
    """Variants stored by name, one level without a repeat, are listed, resolved and read from where they lie."""
    path = new_folder(spark, "named")
    stored = [(20, 1, 1), (20, 2, 2), (40, 1, None)]
    dirty = materialise(damage.inject(customers(spark, folder), CUSTOMERS, PROFILE_A, variants=[s[:2] for s in stored]), "dirty")
    features = [f for f in dirty.schema.fields if not f.name.startswith("damage_")]
    for level, repeat, name in stored:
        one = dirty.where((F.col("damage_level") == level) & (F.col("damage_repeat") == repeat))
        write_named(one.select(*[f.name for f in features]), path, variant_name("customer", level, name))
    wanted = spark.createDataFrame(
        [("customer", lv, rp) for lv in (20, 40, 60) for rp in (1, 2, 3)], "dataset string, damage_level int, damage_repeat int"
    )
    back = read_located(spark, resolve_variants(wanted, named_variants(spark, path)), T.StructType(features))
    return rounded(
        back.groupBy("damage_level", "damage_repeat").agg(
            F.count("*").alias("n_rows"),
            F.count("c_acctbal").alias("n_acctbal"),
            F.sum("c_acctbal").alias("sum_acctbal"),
            F.count("c_nationkey").alias("n_nationkey"),
            F.sum("c_nationkey").alias("sum_nationkey"),
        ),
        2,
    )


def roc_corners(spark, folder) -> DataFrame:
    """Only the corners of the curve, with an order cut into many ranges."""
    return rounded(metrics.roc_points(_ranked_orders(spark, folder), "score", "label", rows_per_task=300, corners=True))


def roc_corners_gaps(spark, folder) -> DataFrame:
    """Corners of several curves with long straight stretches, keys and scores missing."""
    return rounded(metrics.roc_points(_gaps(spark, folder), "score", "label", ["flag"], rows_per_task=5, corners=True))


def stored_variant_study(spark, folder) -> DataFrame:
    """The fast grid's variants are stored, listed, resolved and read, and naive Bayes is evaluated on what was read."""
    path = new_folder(spark, "stored")
    variants = [(lv, rp) for lv in GRID_FAST.levels for rp in GRID_FAST.damage_repeats]
    table_ = evaluate.variant_table(labelled_docs(spark, folder), DOCS, PROFILE_A, variants)
    write_variants(table_, path, "parquet")
    schema = table_.schema
    catalog = stored_variants(spark, path, DOCS.name, schema, "parquet")
    wanted = spark.createDataFrame(
        [(DOCS.name, lv, rp) for lv, rp in ((0, 0), *variants)], "dataset string, damage_level int, damage_repeat int"
    )
    chosen = [(r["damage_level"], r["damage_repeat"]) for r in resolve_variants(wanted, catalog).collect()]
    back = read_variants(spark, path, chosen, schema, "parquet")
    return evaluate.cross_validate_nb(back, DOCS, GRID_FAST.methods, GRID_FAST.folds, GRID_FAST.cv_seeds)


def nb_study(spark, folder) -> DataFrame:
    """The study's summary with the change against the undamaged table."""
    # Means of two 4-digit runs end in 5 at the fifth digit: six digits avoid rounding ties.
    summed = summary.summarise(nb_cv_auc(spark, folder), digits=6)
    return summary.with_baseline_delta(summed, digits=6)


# -- Spark ML models -----------------------------------------------------------

# One variant, two methods, one seed and three folds; the models are those of the fast grid.
MODEL_VARIANTS, MODEL_METHODS, MODEL_SEEDS = ((20, 1),), ("raw", "all"), (101,)


def _model_cv(model: str) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark, folder) -> DataFrame:
        table_ = evaluate.variant_table(labelled_docs(spark, folder), DOCS, PROFILE_A, MODEL_VARIANTS)
        return evaluate.cross_validate_together(table_, DOCS, MODEL_METHODS, [model], CV_FOLDS, MODEL_SEEDS, dict(GRID_FAST.model_params))

    return run


def feature_importance(spark, folder) -> DataFrame:
    docs = materialise(labelled_docs(spark, folder), "docs")
    ranked = models.feature_importance(docs, "quality", ignore=["doc_id"])
    return summary.top_k(ranked, "importance", 5, tie="variable")


def holdout_score(spark, folder) -> DataFrame:
    docs = materialise(labelled_docs(spark, folder), "docs")
    return models.holdout_score(docs, "quality", "doc_id")


def model_grid(spark, folder) -> DataFrame:
    """A small grid with two kinds of model, summarised."""
    small = GridProfile(
        name="small", methods=("raw", "remove_fill"), models=("NB", "RF"), levels=(20,), damage_repeats=(1,),
        cv_seeds=(101,), folds=CV_FOLDS, model_params=GRID_FAST.model_params,
    )
    return summary.summarise(evaluate.run_grid(labelled_docs(spark, folder), DOCS, PROFILE_A, small))


# -- result tables -------------------------------------------------------------


def _runs(spark, folder) -> DataFrame:
    """Run-shaped rows from order lines: every line is a run of one cell."""
    percent = ((F.col("l_linenumber") - 1) * 10).cast("int")
    names = F.array(*[F.lit(m) for m in ("NB", "MLP", "XGBoost", "RF", "OTHER")])
    return table(spark, folder, "lineitem").select(
        F.col("l_returnflag").alias("dataset"),
        level_label(percent).alias("damage_level"),
        F.when(percent == 0, F.lit("raw"))
        .otherwise(F.when(F.col("l_linestatus") == "O", F.lit("fill")).otherwise(F.lit("all")))
        .alias("method"),
        F.get(names, (F.col("l_suppkey") % 5).cast("int")).alias("model"),
        (0.5 + F.col("l_quantity") / 200.0).alias("auc"),
    )


def _run_summary(spark, folder) -> DataFrame:
    return summary.summarise(_runs(spark, folder), digits=6)


def result_summary(spark, folder) -> DataFrame:
    return _run_summary(spark, folder)


def baseline_delta(spark, folder) -> DataFrame:
    return summary.with_baseline_delta(_run_summary(spark, folder), digits=5)


def delta_curve(spark, folder) -> DataFrame:
    summed = summary.known_models(_run_summary(spark, folder))
    return rounded(summary.delta_curve(summed), 4)


def method_model_table(spark, folder) -> DataFrame:
    return summary.method_model_table(_run_summary(spark, folder))


def model_list(spark, folder) -> DataFrame:
    found = summary.models_in_order(_runs(spark, folder))
    return found.select("model", model_order("model").alias("model_order"))


def level_list(spark, folder) -> DataFrame:
    return summary.levels_in_order(_runs(spark, folder))


def distinct_values(spark, folder) -> DataFrame:
    return summary.distinct_sorted(table(spark, folder, "documents"), "source")


def top_orders(spark, folder) -> DataFrame:
    rows = table(spark, folder, "orders").select("o_orderkey", "o_orderpriority", "o_totalprice")
    return summary.top_k(rows, "o_totalprice", 5, "o_orderpriority", "o_orderkey")


def boxplot_stats(spark, folder) -> DataFrame:
    return rounded(summary.boxplot_stats(table(spark, folder, "events"), "event_type", "value"))


def boxplot_outliers(spark, folder) -> DataFrame:
    return summary.boxplot_outliers(table(spark, folder, "events"), "event_type", "value")


def _values(spark, folder) -> DataFrame:
    """Event values, every seventh one missing."""
    value = F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value")
    return table(spark, folder, "events").select("event_id", "event_type", value)


def zscore_outliers(spark, folder) -> DataFrame:
    return rounded(treatments.zscore_outliers(_values(spark, folder), ["value"], ["event_type"], limit=2.0))


def winsorise(spark, folder) -> DataFrame:
    return rounded(treatments.winsorise(_values(spark, folder), ["value"], ["event_type"]))


def drop_outlier_rows(spark, folder) -> DataFrame:
    return rounded(treatments.drop_outlier_rows(_values(spark, folder), ["value"], ["event_type"]))


def impute_mean(spark, folder) -> DataFrame:
    return rounded(treatments.impute_mean(_values(spark, folder), ["value"], ["event_type"]))


def robust_scale(spark, folder) -> DataFrame:
    return rounded(treatments.robust_scale(_values(spark, folder), ["value"], ["event_type"]))


def distinct_by_group(spark, folder) -> DataFrame:
    return treatments.distinct_counts(table(spark, folder, "lineitem"), ["l_suppkey", "l_extendedprice"], ["l_returnflag"])


def quantiles_narrowed(spark, folder) -> DataFrame:
    """The same as ``quantiles`` with hardly any room in a task."""
    rows = table(spark, folder, "lineitem")
    found = exact_quantiles(rows, ["l_extendedprice", "l_quantity"], [0.25, 0.5, 0.75], ["l_returnflag"], 500)
    q = F.col("quantiles")
    return rounded(found.select("l_returnflag", "column", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")))


def _ranked_orders(spark, folder) -> DataFrame:
    """Orders scored by price, every ninth score missing."""
    price = F.when(F.col("o_orderkey") % 9 != 0, F.col("o_totalprice")).alias("score")
    label = F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("label")
    return table(spark, folder, "orders").select("o_orderpriority", price, label)


def auc_ranges(spark, folder) -> DataFrame:
    """Missing scores and an order cut into many ranges."""
    return rounded(metrics.roc_auc(_ranked_orders(spark, folder), "score", "label", ["o_orderpriority"], rows_per_task=300))


def roc_ranges(spark, folder) -> DataFrame:
    return rounded(metrics.roc_points(_ranked_orders(spark, folder), "score", "label", rows_per_task=300))


def _gaps(spark, folder) -> DataFrame:
    """Order lines with a key that is NULL for a quarter, and a score and value that are missing or NaN for some."""
    score = F.when(F.col("l_orderkey") % 5 == 0, F.lit(None)).when(F.col("l_orderkey") % 7 == 0, F.lit(float("nan")))
    return table(spark, folder, "lineitem").select(
        F.when(F.col("l_suppkey") % 4 != 0, F.col("l_returnflag")).alias("flag"),
        score.otherwise(F.col("l_quantity") / 50.0).alias("score"),
        score.otherwise(F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_partkey") % 6 != 0, F.col("l_linestatus")).alias("status"),
        F.when(F.col("l_linestatus") == "O", 1).otherwise(0).alias("label"),
    )


def auc_gaps(spark, folder) -> DataFrame:
    return rounded(metrics.roc_auc(_gaps(spark, folder), "score", "label", ["flag"]))


def auc_gaps_ranges(spark, folder) -> DataFrame:
    """The same with five scores to a task."""
    return rounded(metrics.roc_auc(_gaps(spark, folder), "score", "label", ["flag"], rows_per_task=5))


def roc_gaps(spark, folder) -> DataFrame:
    return rounded(metrics.roc_points(_gaps(spark, folder), "score", "label", ["flag"], rows_per_task=5))


def threshold_metrics_gaps(spark, folder) -> DataFrame:
    return rounded(metrics.threshold_metrics(_gaps(spark, folder), "score", "label", ["flag"]))


def threshold_search_gaps(spark, folder) -> DataFrame:
    return rounded(metrics.threshold_search(_gaps(spark, folder), "score", "label", ["flag"]))


def threshold_report_gaps(spark, folder) -> DataFrame:
    return rounded(metrics.threshold_report(_gaps(spark, folder), "score", "label", ["flag"], 0.5))


def quantiles_gaps(spark, folder) -> DataFrame:
    q = F.col("quantiles")
    found = exact_quantiles(_gaps(spark, folder), ["price", "score"], [0.25, 0.5, 0.75], ["flag"])
    return rounded(found.select("flag", "column", q[0].alias("q1"), q[1].alias("median"), q[2].alias("q3")))


def boxplot_gaps(spark, folder) -> DataFrame:
    return rounded(summary.boxplot_stats(_gaps(spark, folder), "flag", "price"))


def relative_frequency_gaps(spark, folder) -> DataFrame:
    return rounded(value_shares(_gaps(spark, folder), ["status"], ["flag"]))


def clean_gaps(spark, folder) -> DataFrame:
    """Outlier removal, median and mode per NULL or other key, and what comes of it."""
    rows = _gaps(spark, folder).select("flag", "price", "status")
    fitted = fit_cleaning(rows, ["price"], ["status"], keys=["flag"], methods=["remove_fill"], iqr_multiplier=0.5)
    cleaned = fitted.clean(rows, "remove_fill")
    return rounded(cleaned.groupBy("flag", "status").agg(F.count("*").alias("n"), F.round(F.sum("price"), 2).alias("total")), 2)


def baseline_gaps(spark, folder) -> DataFrame:
    """Results without a dataset's name have their own baseline."""
    runs = _runs(spark, folder).withColumn("dataset", F.when(F.col("dataset") != "R", F.col("dataset")))
    return summary.with_baseline_delta(summary.summarise(runs, digits=6), digits=5)


def dirty_keyless(spark, folder) -> DataFrame:
    """Line items have no key: the content key makes one, and each column loses exactly its share."""
    rows = damage.with_content_key(
        table(spark, folder, "lineitem").select("l_quantity", "l_extendedprice", "l_returnflag"), "row"
    )
    spec = DatasetSpec("lineitem", target="l_returnflag", row_key="row", continuous=("l_quantity", "l_extendedprice"))
    dirty = damage.inject_missingness(materialise(rows, "keyed"), spec, PROFILE_A, 20)
    return dirty.agg(
        F.count("*").alias("n_rows"), F.count("l_quantity").alias("n_quantity"), F.count("l_extendedprice").alias("n_price")
    )


def result_files(spark, folder) -> DataFrame:
    """Write the summary as comma-separated text and read it back."""
    path = new_folder(spark, "results")
    write_results(_run_summary(spark, folder), path)
    return read_delimited(
        spark, path,
        schema="dataset string, damage_level string, method string, model string, auc_mean double, "
        "auc_std double, n_runs long",
    )


def keyed_rows(spark, folder) -> DataFrame:
    """A table without a unique key gets one: as many keys as rows."""
    keyed = with_row_key(table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber"))
    return keyed.agg(F.count("*").alias("n_rows"), F.count_distinct("row_key").alias("n_keys"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        iqr_bounds, outlier_to_null, rare_categories, rare_to_null, rare_all_invalid, relative_frequency,
        distinct_counts, quantiles, inject_missing, inject_outliers_a, inject_outliers_b, inject_noise_a,
        inject_noise_b, dirty_variant, dirty_variant_b, variant_grid, variant_round_trip, impute_constant,
        impute_median, impute_mode, standardise, one_hot, one_hot_long, minmax, dummies, dummies_drop_first,
        saved_recipe, repair_by_variant, repaired_files, map_target, labelled_file, text_to_number, grid, resolve_variant,
        stratified_folds, holdout_split, fold_stats, clean_by_fold, nb_scores, auc, auc_of_discounts, roc_points,
        threshold_metrics, threshold_search, threshold_report, nb_cv_auc, nb_study, nb_grid_fast, nb_grid_full, nb_grid_10_50, resumed_study, stored_stand_in, roc_corners, roc_corners_gaps, stored_variant_study,
        repaired_files_all, feature_importance,
        zscore_outliers, winsorise, drop_outlier_rows, impute_mean, robust_scale, distinct_by_group, quantiles_narrowed,
        auc_ranges, roc_ranges, auc_gaps, auc_gaps_ranges, roc_gaps, threshold_metrics_gaps, threshold_search_gaps,
        threshold_report_gaps, quantiles_gaps, boxplot_gaps, relative_frequency_gaps, clean_gaps, baseline_gaps, dirty_keyless, stored_variant_grid,
        holdout_score, model_grid, result_summary, baseline_delta, delta_curve, method_model_table, model_list,
        level_list, distinct_values, top_orders, boxplot_stats, boxplot_outliers, result_files, keyed_rows,
    )
}
QUERIES["level_order"] = level_order_query
QUERIES.update({f"clean_{m}": _clean(m) for m in RECIPES})
QUERIES.update({"rf_cv_auc": _model_cv("RF"), "gbt_cv_auc": _model_cv("XGBoost"), "mlp_cv_auc": _model_cv("MLP")})
