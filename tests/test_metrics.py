import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from frameclinic.operators import metrics
from frameclinic.operators.metrics import (
    roc_auc,
    roc_points,
    threshold_metrics,
    threshold_report,
    threshold_search,
    thresholds_below,
)


def scores(n=500, seed=2):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 2, n)
    s = np.clip(rng.normal(0.4 + 0.2 * y, 0.2), 0, 1)
    s[: n // 3] = 0.5  # a third of the rows share one score
    return pd.DataFrame({"g": rng.integers(0, 2, n), "label": y, "score": s})


def brute_auc(frame):
    p, q = frame.score[frame.label == 1].to_numpy(), frame.score[frame.label == 0].to_numpy()
    return ((p[:, None] > q).sum() + 0.5 * (p[:, None] == q).sum()) / (len(p) * len(q))


@pytest.mark.parametrize("rows_per_task", [2_000_000, 40])
def test_auc(spark, rows_per_task):
    frame = scores()
    found = roc_auc(spark.createDataFrame(frame), "score", "label", ["g"], rows_per_task).collect()
    for r in found:
        assert r["auc"] == pytest.approx(brute_auc(frame[frame.g == r["g"]]), abs=1e-12)
    whole = roc_auc(spark.createDataFrame(frame), "score", "label", rows_per_task=rows_per_task).first()
    assert whole["auc"] == pytest.approx(brute_auc(frame), abs=1e-12)


def test_auc_of_one_class_is_null(spark):
    df = spark.createDataFrame([(1, 0.2), (1, 0.3)], "label int, score double")
    assert roc_auc(df, "score", "label").first()["auc"] is None


@pytest.mark.parametrize("rows_per_task", [2_000_000, 40])
def test_roc_points(spark, rows_per_task):
    frame = scores()
    found = roc_points(spark.createDataFrame(frame), "score", "label", rows_per_task=rows_per_task).toPandas()
    start = found[np.isinf(found.threshold)]
    assert start[["fpr", "tpr"]].values.tolist() == [[0.0, 0.0]]  # every curve starts there
    found = found.drop(start.index)
    assert len(found) == frame.score.nunique()
    for r in found.itertuples():
        said = frame.score >= r.threshold
        assert r.tpr == pytest.approx(said[frame.label == 1].mean())
        assert r.fpr == pytest.approx(said[frame.label == 0].mean())


def test_score_equal_to_a_threshold_is_not_above_it(spark):
    values = [i / 100 for i in range(0, 101)] + [0.005, 0.0701, 0.9999]
    df = spark.createDataFrame([(v,) for v in values], "s double")
    for r in df.select("s", thresholds_below(F.col("s")).alias("n")).collect():
        assert r["n"] == sum(r["s"] > i / 100 for i in range(1, 99))


def test_threshold_search(spark):
    frame = scores()
    best = (0.0, 0.0, 0.0, 0.0)
    smallest = 1.0
    for i in range(1, 99):
        said = frame.score > i / 100
        r0, r1 = (~said)[frame.label == 0].mean(), said[frame.label == 1].mean()
        if abs(r0 - r1) < smallest:
            smallest, best = abs(r0 - r1), (i / 100, r0, r1, (said == (frame.label == 1)).mean())
    assert tuple(threshold_search(spark.createDataFrame(frame), "score", "label").first()) == pytest.approx(best)


def test_threshold_search_without_any_gap_below_one(spark):
    df = spark.createDataFrame([(0, 0.0), (1, 0.0)], "label int, score double")
    assert tuple(threshold_search(df, "score", "label").first()) == (0.0, 0.0, 0.0, 0.0)
    assert threshold_metrics(df, "score", "label").count() == 98


def test_threshold_report(spark):
    df = spark.createDataFrame([(0, 0.0), (0, 0.5), (1, 0.5), (1, 0.9), (1, 0.0)], "label int, score double")
    lines = {r["class"]: r for r in threshold_report(df, "score", "label").collect()}
    assert lines["1"]["precision"] == pytest.approx(2 / 3) and lines["1"]["recall"] == pytest.approx(2 / 3)
    assert lines["0"]["precision"] == pytest.approx(1 / 2) and lines["0"]["support"] == 2
    assert lines["accuracy"]["f1"] == pytest.approx(3 / 5)
    assert lines["weighted avg"]["recall"] == pytest.approx(3 / 5)


@pytest.mark.parametrize("rows_per_task", [2_000_000, 40])
def test_missing_scores_rank_below_all(spark, rows_per_task):
    frame = scores()
    frame.loc[::7, "score"] = None
    frame.loc[3::11, "score"] = float("nan")
    low = frame.assign(score=frame.score.fillna(-1.0))
    df = spark.createDataFrame(list(frame.astype(object).where(frame.notna(), None).itertuples(index=False)), "g int, label int, score double")
    found = {r["g"]: r["auc"] for r in roc_auc(df, "score", "label", ["g"], rows_per_task).collect()}
    want = {r["g"]: r["auc"] for r in roc_auc(spark.createDataFrame(low), "score", "label", ["g"]).collect()}
    assert found == want
    none = roc_auc(df.selectExpr("label", "cast(null as double) as score"), "score", "label").first()
    assert none["auc"] is None and none["n_pos"] == int((frame.label == 1).sum())


def gaps(spark):
    """NULL keys, NULL and NaN scores, a key without any score."""
    rows = [(None, 1, 0.9), (None, 0, 0.2), (None, 1, None), (None, 0, float("nan")), ("a", 1, 0.4), ("a", 0, 0.4), ("a", 1, 0.8),
            ("a", 0, None), ("b", 1, None), ("b", 0, float("nan"))]
    return spark.createDataFrame(rows * 3, "k string, label int, score double")


def test_null_keys_stay_at_every_size(spark):
    df = gaps(spark)
    for f in (roc_auc, roc_points):
        few, many = (sorted(map(str, f(df, "score", "label", ["k"], rows_per_task=n).collect())) for n in (5, 2_000_000))
        assert few == many and any("k=None" in r for r in few)
    found = {r["k"]: r["auc"] for r in roc_auc(df, "score", "label", ["k"], rows_per_task=1).collect()}
    assert found == {None: pytest.approx(0.625), "a": pytest.approx(0.875), "b": None}


def test_missing_scores_are_below_every_threshold(spark):
    df = gaps(spark)
    lines = {(r["k"], r["class"]): r for r in threshold_report(df, "score", "label", ["k"], 0.01).collect()}
    assert all(lines[k, "accuracy"]["support"] == n for k, n in ((None, 12), ("a", 12), ("b", 6)))
    assert lines[None, "1"]["recall"] == 0.5 and lines[None, "0"]["recall"] == 0.5 and lines["b", "1"]["recall"] == 0.0
    steps = {(r["k"], r["step"]): r for r in threshold_metrics(df, "score", "label", ["k"]).collect()}
    assert steps["b", 1]["recall1"] == 0.0 and steps["b", 98]["recall0"] == 1.0
    assert len(steps) == 3 * 98 and steps[None, 1]["recall1"] == 0.5
    odd = spark.createDataFrame([(float("inf"),), (float("-inf"),), (1e300,), (-5.0,), (None,)], "s double")
    assert [r[0] for r in odd.select(thresholds_below(F.col("s"))).collect()] == [98, 0, 98, 0, 0]


def test_ranges_are_many_but_tasks_are_few(spark, monkeypatch):
    """Five scores to a range: 4,000 of them are not cut into hundreds of tasks, and all come out right."""
    written, longest = {}, {}

    def recorded(df, label):
        written[label] = df.rdd.getNumPartitions()
        out = materialise(df, label)
        if label == "ranges":
            longest[label] = out.groupBy("piece").count().agg({"count": "max"}).first()[0]
        return out

    materialise = metrics.materialise
    monkeypatch.setattr(metrics, "materialise", recorded)
    rng = np.random.default_rng(4)
    frame = pd.DataFrame({"g": np.arange(4000) % 2, "score": rng.permutation(4000) / 4000, "label": rng.integers(0, 2, 4000)})
    df = spark.createDataFrame(frame)
    for r in roc_auc(df, "score", "label", ["g"], rows_per_task=5).collect():
        assert r["auc"] == pytest.approx(brute_auc(frame[frame.g == r["g"]]), abs=1e-12)
    assert written["ranges"] <= spark.sparkContext.defaultParallelism and longest["ranges"] == 5
    order = ["g", "threshold", "fpr", "tpr"]
    for corners in (False, True):
        few, one = (roc_points(df, "score", "label", ["g"], n, corners=corners).select(order).toPandas() for n in (5, 10_000))
        assert few.sort_values(order).values.tolist() == one.sort_values(order).values.tolist()


def test_rows_that_stand_for_several(spark, monkeypatch):
    """Counted rows give the area of the rows they stand for; many small key groups are not cut into ranges."""

    def never(*_):
        raise AssertionError("no group is large")

    monkeypatch.setattr(metrics, "in_ranges", never)
    frame = scores()
    frame["n"] = np.random.default_rng(5).integers(1, 4, len(frame))
    every = frame.loc[frame.index.repeat(frame.n)]
    found = roc_auc(spark.createDataFrame(frame), "score", "label", ["g"], rows_per_task=int(frame.groupby("g").score.nunique().max()), alike="n")
    for r in found.collect():
        own = every[every.g == r["g"]]
        assert r["auc"] == pytest.approx(brute_auc(own), abs=1e-12)
        assert (r["n_pos"], r["n_neg"]) == ((own.label == 1).sum(), (own.label == 0).sum())
