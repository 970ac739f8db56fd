import pytest
from pyspark.sql import functions as F

from frameclinic.operators.damage import damage_roles, fit_damage, inject, inject_missingness, with_content_key
from frameclinic.specs import PROFILE_A, PROFILE_B, DatasetSpec

SPEC = DatasetSpec("t", "y", "id", protected=("code",), continuous=("x",))
N = 1000


@pytest.fixture(scope="module")
def table(spark):
    return spark.range(N).select(
        F.col("id"),
        F.concat(F.lit("k"), F.col("id").cast("string")).alias("code"),
        (F.col("id") * 1.5 + 1).alias("x"),
        (F.col("id") % 7).cast("int").alias("grade"),
        F.when(F.col("id") % 3 == 0, "a").otherwise("b").alias("kind"),
        (F.col("id") % 2 == 0).alias("flag"),
        (F.col("id") % 2).cast("int").alias("y"),
    )


def test_roles(table):
    roles = damage_roles(table, SPEC)
    assert roles.continuous == ("x",)
    assert roles.categorical == ("grade", "kind", "flag")


@pytest.mark.parametrize("profile,level,share", [(PROFILE_A, 20, 200), (PROFILE_A, 60, 600), (PROFILE_B, 10, 80)])
def test_exact_counts(table, profile, level, share):
    clean = {r["id"]: r for r in table.collect()}
    rows = inject(table, SPEC, profile, [(level, 1)]).collect()
    assert len(rows) == N
    hit = (N - N * level // 100) * share // 1000
    for c in ("x", "grade", "kind", "flag"):
        assert sum(r[c] is None for r in rows) == N * level // 100
    changed = [r for r in rows if r["x"] is not None and r["x"] != clean[r["id"]]["x"]]
    assert len(changed) == hit
    ratios = {round(r["x"] / clean[r["id"]]["x"], 6) for r in changed}
    assert ratios <= set(profile.factors) and len(ratios) == len(profile.factors)
    for c in ("kind", "flag"):
        assert sum(r[c] == "9" for r in rows) == hit
    assert sum(r["grade"] == 9 for r in rows) == hit
    assert all(r["y"] == clean[r["id"]]["y"] and r["code"] == clean[r["id"]]["code"] for r in rows)


def test_share_floor_and_at_least_one_cell(spark):
    few = spark.range(10).select("id", F.lit("k").alias("code"), F.lit(2.0).alias("x"), F.lit(0).alias("y"))
    rows = inject(few, SPEC, PROFILE_B, [(1, 1)]).collect()
    assert sum(r["x"] is None for r in rows) == 0
    assert sum(r["x"] != 2.0 for r in rows) == 1


def test_all_missing_column_is_skipped(spark):
    rows = spark.range(50).select(
        "id", F.lit("k").alias("code"), F.lit(None).cast("double").alias("x"), F.lit(0).alias("y")
    )
    assert inject(rows, SPEC, PROFILE_A, [(20, 1)]).where("x is not null").count() == 0


def test_histogram_search_finds_the_same_cutoffs(table):
    near = fit_damage(table, SPEC, PROFILE_A, [(20, 1), (40, 2)]).cutoffs
    searched = fit_damage(table, SPEC, PROFILE_A, [(20, 1), (40, 2)], rows_per_task=2).cutoffs
    assert near == searched and len(near) == 2 * (4 + 1 + 3)


def test_window_that_misses_falls_back(spark):
    """Mostly missing cells: the hit window is far off for that column, the count is still exact."""
    sparse = spark.range(20_000).select(
        "id", F.lit("k").alias("code"), F.when(F.col("id") % 1000 == 0, 3.0).alias("x"), F.lit(0).alias("y")
    )
    damaged = inject(sparse, SPEC, PROFILE_A, [(20, 1)])
    left = damaged.where("x is not null").count()
    assert damaged.where("x is not null and x <> 3.0").count() == max(1, left * 200 // 1000)


def test_repeatable_and_seeded(table):
    def blanks(repeat):
        return {r["id"] for r in inject_missingness(table, SPEC, PROFILE_A, 20, repeat).where("x is null").collect()}

    assert blanks(1) == blanks(1)
    assert blanks(1) != blanks(2)


def test_damage_needs_a_key(table):
    with pytest.raises(ValueError):
        fit_damage(table, DatasetSpec("t", "y"), PROFILE_A, [(20, 1)])


@pytest.mark.parametrize("key", ["if(id < 900, id, null)", "id div 7", "id div 333"])
def test_bad_keys_are_refused(table, key):
    with pytest.raises(ValueError, match="with_content_key"):
        inject(table.withColumn("id", F.expr(key)), SPEC, PROFILE_A, [(20, 1)])


def test_content_key_is_unique_and_does_not_depend_on_the_files(spark, table):
    rows = table.drop("id").unionByName(table.drop("id").limit(300))
    one = with_content_key(rows.repartition(7), "id")
    two = with_content_key(rows.coalesce(1), "id")
    assert one.select("id").distinct().count() == N + 300
    assert sorted(map(str, one.collect())) == sorted(map(str, two.collect()))
    damaged = [inject(x, SPEC, PROFILE_A, [(20, 1)]) for x in (one, two)]
    assert sorted(map(str, damaged[0].collect())) == sorted(map(str, damaged[1].collect()))
    assert damaged[0].where("x is null").count() == (N + 300) * 20 // 100
