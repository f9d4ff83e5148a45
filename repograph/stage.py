"""Materialise an intermediate result that several later steps read."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def stage_folder(spark: SparkSession) -> str:
    """The shared folder the cluster names: `spark.checkpoint.dir`, or the context's own."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return named.rstrip("/")


def staged(df: DataFrame, *partition_by: str) -> DataFrame:
    """The same rows, read back from a table written to the shared folder.

    Cuts the lineage, survives lost executors, and gives the planner real sizes. With
    `partition_by`, a later filter on these columns reads only its own files.
    """
    path = f"{stage_folder(df.sparkSession)}/staged-{uuid.uuid4().hex}"
    writer = df.write.partitionBy(*partition_by) if partition_by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
