"""Recipes as pipeline stages: fitted, saved, loaded again and applied to tables and streams."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark import keyword_only
from pyspark.ml import Estimator, Model
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.util import (
    DefaultParamsReadable,
    DefaultParamsReader,
    DefaultParamsWritable,
    DefaultParamsWriter,
    MLReadable,
    MLReader,
    MLWritable,
    MLWriter,
)
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from ..functions.columns import present, roles_by_type
from ..specs import RECIPES, recipe
from .cleaning import CategoryStats, FittedCleaning, NumericStats, fit_cleaning


class _RecipeParams(Params):
    method = Param(Params._dummy(), "method", "name of the recipe", typeConverter=TypeConverters.toString)
    keep = Param(Params._dummy(), "keep", "columns that are passed on as they are", typeConverter=TypeConverters.toListString)

    def getMethod(self) -> str:
        return self.getOrDefault(self.method)

    def getKeep(self) -> list[str]:
        return self.getOrDefault(self.keep)


class RecipeCleaner(Estimator, _RecipeParams, DefaultParamsReadable, DefaultParamsWritable):
    """Learns a recipe's statistics from a table; all columns but ``keep`` are features, by type."""

    @keyword_only
    def __init__(self, *, method: str = "all", keep: Sequence[str] = ()):
        super().__init__()
        self._setDefault(method="all", keep=[])
        self._set(method=method, keep=list(keep))

    def setMethod(self, value: str) -> RecipeCleaner:
        return self._set(method=value)

    def setKeep(self, value: Sequence[str]) -> RecipeCleaner:
        return self._set(keep=list(value))

    def _fit(self, dataset: DataFrame) -> RecipeModel:
        recipe(self.getMethod())
        numeric, categorical = roles_by_type(dataset, exclude=self.getKeep())
        fitted = fit_cleaning(dataset, numeric, categorical, methods=list(RECIPES))
        return self._copyValues(RecipeModel(fitted))


class RecipeModel(Model, _RecipeParams, MLWritable, MLReadable):
    """A fitted recipe: ``keep`` columns and the model-ready matrix. ``method`` may be changed; every recipe was fitted."""

    def __init__(self, fitted: FittedCleaning | None = None):
        super().__init__()
        self._setDefault(method="all", keep=[])
        self.fitted = fitted

    def setMethod(self, value: str) -> RecipeModel:
        recipe(value)
        return self._set(method=value)

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return self.fitted.transform(dataset, self.getMethod(), keep=present(dataset, self.getKeep()))

    def transformSchema(self, schema: T.StructType) -> T.StructType:
        """The columns that ``transform`` gives a table of this schema; a missing feature is an error."""
        missing = [c for c in (*self.fitted.numeric, *self.fitted.categorical) if c not in schema.fieldNames()]
        if missing:
            raise ValueError(f"columns {missing} are missing")
        return self._transform(SparkSession.active().createDataFrame([], schema)).schema

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)


STATS = "place int, column string, numeric boolean, stats string"


class _Writer(MLWriter):
    """The stage's settings as Spark writes them, and a row of statistics per column under ``data``."""

    def __init__(self, model: RecipeModel):
        super().__init__()
        self.model = model

    def saveImpl(self, path: str) -> None:
        spark, fitted = self.sparkSession, self.model.fitted
        DefaultParamsWriter.saveMetadata(self.model, path, spark)
        rows = [(i, c, True, json.dumps(fitted.numeric_stats[()][c].__dict__)) for i, c in enumerate(fitted.numeric)]
        rows += [(i, c, False, json.dumps(fitted.category_stats[()][c].__dict__)) for i, c in enumerate(fitted.categorical)]
        spark.createDataFrame(rows, STATS).coalesce(1).write.parquet(f"{path}/data")


class _Reader(MLReader):
    def __init__(self, kind: type[RecipeModel]):
        super().__init__()
        self.kind = kind

    def load(self, path: str) -> RecipeModel:
        spark: SparkSession = self.sparkSession
        metadata = DefaultParamsReader.loadMetadata(path, spark)
        rows = sorted(spark.read.schema(STATS).parquet(f"{path}/data").collect(), key=lambda r: r["place"])
        numeric = {r["column"]: NumericStats(**json.loads(r["stats"])) for r in rows if r["numeric"]}
        listed = {r["column"]: json.loads(r["stats"]) for r in rows if not r["numeric"]}
        categories = {
            c: CategoryStats(**{k: tuple(v) if isinstance(v, list) else v for k, v in s.items()}) for c, s in listed.items()
        }
        model = self.kind(FittedCleaning(list(numeric), list(categories), T.StructType([]), {(): numeric}, {(): categories}))
        model._resetUid(metadata["uid"])
        DefaultParamsReader.getAndSetParams(model, metadata)
        return model
