import numpy as np
import pandas as pd
import pytest

from frameclinic.operators.naive_bayes import fit_gaussian_nb, score_gaussian_nb


def brute_scores(train, test, numeric, categorical):
    """Gaussian naive Bayes over explicit 0/1 columns."""
    blocks = [(train[numeric].to_numpy(float), test[numeric].to_numpy(float))]
    for c in categorical:
        values = sorted(train[c].unique())
        blocks.append(tuple(np.array([[float(v == u) for u in values] for v in part[c]]) for part in (train, test)))
    x, z = np.hstack([b[0] for b in blocks]), np.hstack([b[1] for b in blocks])
    y, smooth = train.y.to_numpy(), 1e-9 * x.var(axis=0).max()
    odds = 0.0
    for k, sign in ((1, 1), (0, -1)):
        m, v = x[y == k].mean(axis=0), x[y == k].var(axis=0) + smooth
        odds = odds + sign * (np.log((y == k).mean()) - 0.5 * np.log(2 * np.pi * v).sum() - ((z - m) ** 2 / (2 * v)).sum(axis=1))
    return 1 / (1 + np.exp(-odds))


def test_scores(spark):
    rng = np.random.default_rng(4)
    n = 300
    y = rng.integers(0, 2, n)
    frame = pd.DataFrame(
        {"id": range(n), "g": rng.integers(0, 2, n), "a": rng.normal(y, 1), "b": rng.normal(0, 3, n),
         "kind": rng.choice(["p", "q", "r"], n), "y": y}
    )
    test = frame.assign(kind=np.where(frame.id % 50 == 0, "unseen", frame.kind))
    df, later = spark.createDataFrame(frame), spark.createDataFrame(test)
    model = fit_gaussian_nb(df, ["a", "b"], ["kind"], "y", ["g"])
    found = score_gaussian_nb(later, model, ["a", "b"], ["kind"], ["g"]).toPandas().set_index("id").score
    for g in (0, 1):
        part = test[test.g == g]
        want = brute_scores(frame[frame.g == g], part, ["a", "b"], ["kind"])
        np.testing.assert_allclose(found[part.id], want, rtol=1e-9)


def test_opposite_contradictions_cancel(spark):
    """A value only class 1 has, with one only class 0 has: the other evidence decides."""
    rows = [("only1", "s", 1.0, 1), ("both", "only0", 0.0, 0), ("both", "s", 0.2, 1), ("both", "s", 0.1, 0)] * 5
    df = spark.createDataFrame(rows, "u string, v string, x double, y int")
    model = fit_gaussian_nb(df, ["x"], ["u", "v"], "y")
    mixed = spark.createDataFrame([("only1", "only0", 0.1), ("only1", "s", 0.1)], "u string, v string, x double")
    mixed_score, sure = [r["score"] for r in score_gaussian_nb(mixed, model, ["x"], ["u", "v"]).collect()]
    assert 0.0 < mixed_score < 1.0 and sure == 1.0


def test_numeric_only(spark):
    df = spark.createDataFrame([(0.0, 0), (1.0, 0), (4.0, 1), (5.0, 1)], "x double, y int")
    scored = score_gaussian_nb(df, fit_gaussian_nb(df, ["x"], [], "y"), ["x"]).collect()
    assert [r["score"] > 0.5 for r in scored] == [False, False, True, True]
    assert scored[0]["score"] == pytest.approx(1 - scored[3]["score"])
