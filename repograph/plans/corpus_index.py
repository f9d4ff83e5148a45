"""From repository files to validated chunks with vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repograph.operators import corpus
from repograph.operators.chunks import split_documents
from repograph.operators.embedding import Embedder, embed
from repograph.operators.vectors import valid_vectors
from repograph.stage import staged


def corpus_chunks(files: DataFrame, limits: dict[str, int] | None = None, **filters) -> DataFrame:
    """Chunks of the files that pass the filters and the token limits, if any, with metadata."""
    kept = corpus.documents(corpus.select_files(files, **filters), **(limits or {}))
    return split_documents(kept.withColumnRenamed("content", "text"))


def corpus_index(files: DataFrame, embedder: Embedder | None = None,
                 limits: dict[str, int] | None = None, **filters) -> DataFrame:
    """Chunks with a usable vector, one vector size per repository.

    The size check reads the vectors twice, so the embedded chunks are written out first.
    """
    embedded = staged(embed(corpus_chunks(files, limits, **filters), embedder))
    placed = embedded.withColumn("_place", F.struct("path", "chunk_no"))
    return valid_vectors(placed, ["repo"], "_place").drop("_place")
