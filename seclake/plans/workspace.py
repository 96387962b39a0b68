"""Where jobs keep checkpoints and intermediate tables."""

from __future__ import annotations

import atexit
import os
import shutil
import uuid
from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

SETTING = "spark.checkpoint.dir"


def _local(spark: SparkSession) -> bool:
    master = spark.sparkContext.master
    return master == "local" or master.startswith("local[")


def can_store(spark: SparkSession) -> bool:
    """Whether the session has a folder for intermediate tables."""
    return bool(spark.conf.get(SETTING, None)) or _local(spark)


def shared_folder(spark: SparkSession) -> str:
    """A new folder below the cluster's shared checkpoint folder.

    A cluster must name that folder: one that only the driver sees would lose the rows that executors write. A
    local session that names none gets a folder beside its warehouse, which is removed when the process ends.
    """
    base = spark.conf.get(SETTING, None)
    if not base:
        if not _local(spark):
            raise ValueError(f"{SETTING} must name a folder that all executors share")
        warehouse = spark.conf.get("spark.sql.warehouse.dir").removeprefix("file:")
        base = os.path.join(warehouse, f"scratch-{spark.sparkContext.applicationId}")
        atexit.register(shutil.rmtree, base, ignore_errors=True)
        spark.conf.set(SETTING, base)
    return f"{base.rstrip('/')}/{uuid.uuid4().hex}"


def written(table: DataFrame, folder: str | None = None) -> DataFrame:
    """Store a table in the shared folder and read it back: a cut in the lineage that survives lost executors."""
    path = folder or shared_folder(table.sparkSession)
    table.write.mode("overwrite").parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)


def listed(spark: SparkSession, rows: Sequence[tuple], schema: T.StructType | str) -> DataFrame:
    """A few rows as a table within the plan. A list given to the session is an RDD, whose tasks start a Python worker on each core."""
    kind = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(kind.names, r, strict=True)) for r in rows], to_arrow_schema(kind)), kind)
