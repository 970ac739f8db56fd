"""Reading labelled tables and writing variants and results."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import nan_to_null, ref
from ..operators.labels import label_table
from ..specs import DatasetSpec
from .workspace import materialise, small_table


def read_delimited(
    spark: SparkSession, path: str, separator: str = ",", schema: T.StructType | str | None = None
) -> DataFrame:
    """Delimited text with a header; empty cells are missing. Types are inferred
    without a schema, which costs one more scan."""
    reader = spark.read.option("header", True).option("sep", separator)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    return nan_to_null(reader.csv(path))


def read_table(spark: SparkSession, path: str, separator: str = ",", schema=None) -> DataFrame:
    """Parquet by file or folder name, delimited text otherwise."""
    if path.rstrip("/").endswith(".parquet"):
        return nan_to_null(spark.read.parquet(path))
    return read_delimited(spark, path, separator, schema)


def load_dataset(spark: SparkSession, path: str, spec: DatasetSpec, schema=None) -> DataFrame:
    """Read a labelled table, map its target and drop rows without one."""
    return label_table(read_table(spark, path, spec.separator, schema), spec)


def with_row_key(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Give a table without a key one, and write it so that the key never changes."""
    return materialise(df.withColumn(name, F.monotonically_increasing_id()), "keyed")


def write_variants(df: DataFrame, path: str, form: str = "csv", separator: str = "|") -> None:
    """Write damaged or repaired variants under ``damage_level=/damage_repeat=`` folders."""
    writer = df.write.partitionBy("damage_level", "damage_repeat")
    if form == "csv":
        writer.option("header", True).option("sep", separator).csv(path)
    else:
        writer.format(form).save(path)


def _stored(spark: SparkSession, path: str, form: str, separator: str, schema: T.StructType | str) -> DataFrame:
    reader = spark.read.schema(schema)
    if form == "csv":
        return reader.option("header", True).option("sep", separator).csv(path)
    return reader.format(form).load(path)


def stored_variants(
    spark: SparkSession, path: str, dataset: str, schema: T.StructType | str, form: str = "csv", separator: str = "|"
) -> DataFrame:
    """What lies under ``path``: dataset, damage_level, damage_repeat and location, one row per variant folder.

    Only the folder names are needed, so no column of the files is read.
    """
    found = _stored(spark, path, form, separator, schema).select("damage_level", "damage_repeat").distinct()
    location = F.format_string(f"{path.rstrip('/').replace('%', '%%')}/damage_level=%d/damage_repeat=%d", "damage_level", "damage_repeat")
    return found.select(F.lit(dataset).alias("dataset"), "damage_level", "damage_repeat", location.alias("location"))


def read_variants(
    spark: SparkSession,
    path: str,
    chosen: list[tuple[int, int]],
    schema: T.StructType | str,
    form: str = "csv",
    separator: str = "|",
) -> DataFrame:
    """The chosen (level, repeat) variants under ``path``; the folders of others are not opened."""
    table = _stored(spark, path, form, separator, schema)
    wanted = F.lit(False)
    for level, repeat in chosen:
        wanted = wanted | ((F.col("damage_level") == level) & (F.col("damage_repeat") == repeat))
    return nan_to_null(table.where(wanted))


#: Names of variants that are stored one by one: dataset, level and, if it has one, repeat.
NAMED = r"/([^/]+)_prob_([0-9]+)(?:_r([0-9]+))?(?:\.[a-z]+)?(?:/[^/]*)?$"


def variant_name(dataset: str, level: int, repeat: int | None = None) -> str:
    """The name of a variant's file or folder; one stored without a repeat is named by its level only."""
    return f"{dataset}_prob_{level}" + ("" if repeat is None else f"_r{repeat}")


def write_named(df: DataFrame, folder: str, name: str, form: str = "csv", separator: str = "|") -> None:
    """Write one variant under its name."""
    path = f"{folder.rstrip('/')}/{name}"
    if form == "csv":
        df.write.option("header", True).option("sep", separator).csv(path)
    else:
        df.write.format(form).save(path)


def _named(path: Column) -> list[Column]:
    repeat = F.regexp_extract(path, NAMED, 3)
    return [
        F.regexp_extract(path, NAMED, 1).alias("dataset"),
        F.regexp_extract(path, NAMED, 2).cast("int").alias("damage_level"),
        F.when(repeat != "", repeat.try_cast("int")).alias("damage_repeat"),
    ]


def named_variants(spark: SparkSession, folder: str) -> DataFrame:
    """Catalog of the named variants anywhere below ``folder``, files or folders: dataset, damage_level, damage_repeat, location.

    A variant stored without a repeat has a NULL one. Files are listed by Spark, none is opened; other files are left out.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).select("path")
    files = files.where(F.col("path").rlike(NAMED))
    location = F.regexp_extract("path", r"^(.*/[^/]+_prob_[0-9]+(?:_r[0-9]+)?(?:\.[a-z]+)?)(?:/[^/]*)?$", 1)
    return files.select(*_named(F.col("path")), location.alias("location")).distinct()


def read_located(
    spark: SparkSession, chosen: DataFrame, schema: T.StructType, form: str = "csv", separator: str = "|"
) -> DataFrame:
    """The variants of a resolved catalog, each from its ``location`` and under the repeat it was resolved to.

    ``chosen`` is plan-sized. Only its locations are opened; a row is told by the name of the file it comes from.
    """
    rows = chosen.select("dataset", "damage_level", "damage_repeat", "location").collect()
    keys = T.StructType(
        [T.StructField("dataset", T.StringType()), T.StructField("damage_level", T.IntegerType()), T.StructField("damage_repeat", T.IntegerType())]
    )
    if not rows:
        return spark.createDataFrame([], T.StructType([*schema.fields, *keys.fields]))
    reader = spark.read.schema(schema)
    reader = reader.option("header", True).option("sep", separator).format("csv") if form == "csv" else reader.format(form)
    told = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
    found = reader.load([r["location"] for r in rows]).select("*", F.struct(*_named(told)).alias("__named"))
    spare = T.StructType([*keys.fields[:2], T.StructField("stored_repeat", T.IntegerType()), keys.fields[2]])
    names = [re.search(NAMED, r["location"]) for r in rows]
    table = small_table(
        spark, [[r["dataset"], r["damage_level"], int(m[3]) if m[3] else None, r["damage_repeat"]] for r, m in zip(rows, names)], spare
    )
    table = table.select(F.struct("dataset", "damage_level", F.col("stored_repeat").alias("damage_repeat")).alias("__named"), F.struct("dataset", "damage_level", "damage_repeat").alias("__as"))
    same = [F.col("__named")[k].eqNullSafe(F.col("__told")[k]) for k in keys.fieldNames()]
    joined = found.join(F.broadcast(table.withColumnRenamed("__named", "__told")), same[0] & same[1] & same[2])
    return nan_to_null(joined.select(*[ref(c) for c in schema.fieldNames()], "__as.*"))


def write_results(df: DataFrame, path: str) -> None:
    """Write a detail or summary table as comma-separated text with a header."""
    df.write.option("header", True).csv(path)
