"""Intermediate tables in the folder all executors share."""

from __future__ import annotations

import re
import tempfile
from collections.abc import Sequence
from uuid import uuid4

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

_local_folders: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only in local mode."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if folder:
        return folder
    context = spark.sparkContext
    if not re.fullmatch(r"local(\[.*\])?", context.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors can reach")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="frameclinic-")
    return _local_folders[context.applicationId]


def new_folder(spark: SparkSession, label: str) -> str:
    """Path of a folder that does not exist yet."""
    return f"{shared_folder(spark).rstrip('/')}/frameclinic/{label}-{uuid4().hex}"


def materialise(df: DataFrame, label: str = "stage", partition_by: tuple[str, ...] = ()) -> DataFrame:
    """Write ``df`` as parquet once and return the written table.

    Used where a result is scanned several times: it cuts lineage, survives the
    loss of executors, and later scans read only the columns they need.
    """
    path = new_folder(df.sparkSession, label)
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path).select(*df.columns)


# Rows up to which a table may be broadcast; checked by counting, not assumed.
BROADCAST_ROWS = 50_000
# A table with fewer rows than this may sit in fewer splits than there are cores.
FEW_ROWS = 1_000_000


def spread(df: DataFrame, rows: int) -> DataFrame:
    """Deal a small table in few splits out to all cores before costly work; others stay as they are, on any cluster."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if rows <= FEW_ROWS and df.rdd.getNumPartitions() < cores else df


def small_table(spark: SparkSession, rows: Sequence[Sequence[object]], schema: T.StructType) -> DataFrame:
    """A local relation of plan-sized rows, for example one per variant or fold."""
    arrow_schema = to_arrow_schema(schema)
    columns = [
        pa.array([r[i] for r in rows], type=field.type) for i, field in enumerate(arrow_schema)
    ]
    return spark.createDataFrame(pa.Table.from_arrays(columns, schema=arrow_schema), schema)


def broadcast_if_small(df: DataFrame, most_rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` as a broadcast local relation if it has at most ``most_rows`` rows, else as it is.

    Fetches one row more than the limit at most. For per-group results whose join
    would otherwise shuffle a large side by a possibly hot key.
    """
    rows = df.limit(most_rows + 1).collect()
    return F.broadcast(small_table(df.sparkSession, rows, df.schema)) if len(rows) <= most_rows else df
