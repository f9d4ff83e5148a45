"""Stored chunks and vectors by repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from repograph.operators.chunks import split_documents
from repograph.operators.embedding import Embedder, embed
from repograph.operators.skew import salted_join


def reusable_repositories(stored: DataFrame) -> DataFrame:
    """Repositories with at least one stored vector that is not empty."""
    return stored.where(F.size("vector") > 0).select("repo").distinct()


def refreshed_chunks(stored: DataFrame, documents: DataFrame, embedder: Embedder | None = None,
                     wanted: DataFrame | None = None) -> DataFrame:
    """Stored chunks where any vector is usable, freshly embedded ones elsewhere.

    Documents of reusable repositories are dropped before splitting: they cost nothing.
    """
    good = reusable_repositories(stored)
    keep = salted_join(stored, good, ["repo"], ["text"], "left_semi")
    stale = salted_join(documents, good, ["repo"], ["text"], "left_anti")
    fresh = embed(split_documents(stale), embedder)
    return keep.unionByName(fresh.select(*stored.columns))


def save_chunks(chunks: DataFrame, path: str) -> None:
    """Replace the stored chunks of the repositories at hand, and only those.

    Each repository is a partition. Rows are spread by chunk text as well as repository, so a
    large repository is not written by one task.
    """
    spread = chunks.withColumn("_part", F.pmod(F.xxhash64("text"), F.lit(32))).repartition(
        "repo", "_part").drop("_part")
    spread.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        "repo").parquet(path)


def load_chunks(spark: SparkSession, path: str, repos: list[str] | None = None) -> DataFrame:
    """Stored chunks; naming repositories prunes the scan to their partitions."""
    chunks = spark.read.parquet(path).withColumn("repo", F.col("repo").cast("string"))
    return chunks.where(F.col("repo").isin(*repos)) if repos else chunks
