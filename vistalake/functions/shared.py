"""Tables in the folder that all executors share."""

from __future__ import annotations

import functools
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


@functools.cache
def _local_dir() -> str:
    return tempfile.mkdtemp(prefix="vistalake-")


def shared_dir(spark: SparkSession) -> str:
    """A new folder name under spark.checkpoint.dir. Where that is unset, a local session gets a temporary folder; on a cluster it is an error."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.conf.get("spark.master", "").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = _local_dir()
    return f"{root.rstrip('/')}/vistalake-{uuid.uuid4().hex}"


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """Writes ``df`` as Parquet in the shared folder and reads it again: its lineage ends there, and a lost executor costs no more than its own tasks."""
    path = shared_dir(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    order = [c for c in df.columns if c not in partition_by] + list(partition_by)
    return df.sparkSession.read.schema(df.select(*order).schema).parquet(path).select(*df.columns)
