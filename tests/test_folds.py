from pyspark.sql import functions as F

from frameclinic.operators.damage import VARIANT
from frameclinic.operators.folds import assign_folds, fold_table
from frameclinic.plans.evaluate import FOLD_KEYS, fit_by_fold, folded_rows, variant_table
from frameclinic.specs import PROFILE_A, DatasetSpec

SPEC = DatasetSpec("t", "y", "id", continuous=("x",))


def rows(spark, n=700, shift=None):
    x = F.col("id") * 1.0
    if shift is not None:
        x = F.when(F.col("id") == shift, F.lit(1e9)).otherwise(x)
    return spark.range(n).select(
        "id", x.alias("x"), F.concat(F.lit("k"), (F.col("id") % 3).cast("string")).alias("kind"),
        (F.col("id") % 5 == 0).cast("int").alias("y"),
    )


def test_each_row_once_and_balanced(spark):
    df = rows(spark)
    found = assign_folds(df, "id", "y", 4, [101, 202])
    assert found.count() == 2 * df.count()
    assert found.select("cv_seed", "id").distinct().count() == 2 * df.count()
    sizes = found.groupBy("cv_seed", "y", "fold").count().collect()
    for seed in (101, 202):
        for y in (0, 1):
            held = [r["count"] for r in sizes if r["cv_seed"] == seed and r["y"] == y]
            assert len(held) == 4 and max(held) - min(held) <= 1


def test_histogram_search_agrees(spark):
    df = rows(spark)
    near = fold_table(df, "id", "y", 5, [101]).collect()
    searched = fold_table(df, "id", "y", 5, [101], rows_per_task=3).collect()
    assert sorted(map(str, near)) == sorted(map(str, searched))


def test_class_smaller_than_the_fold_count(spark):
    df = spark.range(203).select("id", F.when(F.col("id") < 3, 1).otherwise(0).alias("y"))
    folds = [r["fold"] for r in assign_folds(df, "id", "y", 5, [1]).where("y = 1").collect()]
    assert len(folds) == 3 and len(set(folds)) == 3


def test_held_out_values_do_not_leak(spark):
    """Changing one row changes the statistics of every fold but the one that holds it out."""

    def statistics(shift):
        table = rows(spark, shift=shift).select(F.lit(0).alias("damage_level"), F.lit(0).alias("damage_repeat"), "*")
        folded = folded_rows(table, SPEC, 4, [101])
        return folded, fit_by_fold(folded, table, SPEC, ["fill_norm"], 4).cleaning.numeric_stats

    folded, before = statistics(None)
    _, after = statistics(17)
    own = folded.where("id = 17").first()["fold"]
    for group in before:
        held_out = dict(zip(FOLD_KEYS, group))["held_out"]
        assert (before[group] == after[group]) == (held_out == own)


def test_variant_table_holds_the_clean_table_too(spark):
    table = variant_table(rows(spark), SPEC, PROFILE_A, [(20, 1)])
    counts = {tuple(r[k] for k in VARIANT): r["count"] for r in table.groupBy(*VARIANT).count().collect()}
    assert counts == {(0, 0): 700, (20, 1): 700}
