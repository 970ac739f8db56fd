"""Spark ML classifiers by name, feature importance and hold-out scores."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.ml import Estimator
from pyspark.ml.classification import (
    GBTClassifier,
    MultilayerPerceptronClassifier,
    NaiveBayes,
    RandomForestClassifier,
)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import ref
from ..specs import GRID_FULL, NUMERIC_FILL
from .cleaning import fit_cleaning
from .encoding import dummies
from .folds import hash_split

FEATURES = "features"
#: Spark's deepest trees: trees grow fully unless a spec says ``depth``.
MOST_DEPTH = 30
#: Candidate splits of a column, unless a spec says ``bins``; columns with more values are split at quantiles.
BINS = 256


def get_estimator(
    model: str,
    seed: int,
    width: int,
    params: Mapping[str, Mapping[str, float]] | None = None,
    label: str = "label",
) -> Estimator:
    """The estimator called ``model`` for ``width`` features; an unknown name is an error."""
    p = dict((GRID_FULL.model_params if params is None else params).get(model, {}))
    shared = {"featuresCol": FEATURES, "labelCol": label}
    if model == "RF":
        return RandomForestClassifier(
            numTrees=int(p.get("trees", 100)), maxDepth=int(p.get("depth", MOST_DEPTH)), maxBins=int(p.get("bins", BINS)),
            featureSubsetStrategy="sqrt", seed=seed, **shared,
        )
    if model == "NB":
        return NaiveBayes(modelType="gaussian", **shared)
    if model == "MLP":
        return MultilayerPerceptronClassifier(
            layers=[width, int(p.get("hidden", 100)), 2], maxIter=int(p.get("iterations", 2000)), seed=seed, **shared
        )
    if model == "XGBoost":
        return GBTClassifier(
            maxIter=int(p.get("rounds", 250)), maxDepth=int(p.get("depth", 4)), stepSize=float(p.get("step", 0.05)),
            maxBins=int(p.get("bins", BINS)), subsamplingRate=float(p.get("rows", 0.9)), featureSubsetStrategy=str(p.get("columns", 0.9)),
            seed=seed, **shared,
        )
    raise ValueError(f"unknown model {model!r}")


def assembled(df: DataFrame, features: Sequence[str], keep: Sequence[str]) -> DataFrame:
    """``keep`` columns and the feature vector; leftover missing cells become 0."""
    safe = [F.coalesce(ref(f).cast("double"), F.lit(0.0)).alias(f"f{i}") for i, f in enumerate(features)]
    names = [f"f{i}" for i in range(len(features))]
    flat = df.select(*[ref(k) for k in keep], *safe)
    return VectorAssembler(inputCols=names, outputCol=FEATURES).transform(flat).select(*keep, FEATURES)


def positive_score(predictions: DataFrame) -> DataFrame:
    """Adds ``score``: the probability of class 1."""
    return predictions.withColumn("score", vector_to_array("probability")[1])


def feature_importance(
    df: DataFrame, target: str, ignore: Sequence[str] = (), trees: int = 100, seed: int = 42
) -> DataFrame:
    """Importance of each feature in a random forest on dummy-coded, median-filled features."""
    rows = dummies(df.drop(*ignore).dropna(subset=[target]))
    features = [c for c in rows.columns if c != target]
    fitted = fit_cleaning(rows.select(*[ref(c) for c in features]), methods=["fill"])
    filled = fitted.transform(rows, "fill", keep=[target])
    vectors = assembled(filled, [f"num__{c}" for c in features], [target])
    model = get_estimator("RF", seed, len(features), {"RF": {"trees": trees}}, label=target).fit(vectors)
    weights = model.featureImportances.toArray()
    # As many rows as the model has features.
    return df.sparkSession.createDataFrame(
        [(f, float(w)) for f, w in zip(features, weights)], "variable string, importance double"
    )


def holdout_score(
    df: DataFrame, target: str, row_key: str, ignore: Sequence[str] = (), trees: int = 100, seed: int = 42
) -> DataFrame:
    """Rows, accuracy and weighted F1 of a forest on an 80/20 split."""
    rows = dummies(df.drop(*ignore).dropna(subset=[target]), drop_first=True)
    features = [c for c in rows.columns if c not in (target, row_key)]
    filled = rows.select(
        ref(target), ref(row_key), *[F.coalesce(ref(c).cast("double"), F.lit(NUMERIC_FILL)).alias(c) for c in features]
    )
    split = hash_split(assembled(filled, features, [target, row_key]), row_key, seed).persist()
    try:
        model = get_estimator("RF", seed, len(features), {"RF": {"trees": trees}}, label=target).fit(
            split.where("in_training")
        )
        predicted = model.transform(split.where("NOT in_training")).select(target, "prediction").persist()
        evaluator = MulticlassClassificationEvaluator(labelCol=target, predictionCol="prediction")
        accuracy = evaluator.setMetricName("accuracy").evaluate(predicted)
        f1 = evaluator.setMetricName("f1").evaluate(predicted)
        n = split.count()
        predicted.unpersist()
    finally:
        split.unpersist()
    return df.sparkSession.createDataFrame(
        [(n, round(accuracy, 4), round(f1, 4))], "n_rows long, accuracy double, f1 double"
    )
