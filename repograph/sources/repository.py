"""Repository folders as tables of files."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repograph.functions.paths import ends_with_any
from repograph.sources.folders import list_tree, open_folder, task_count

_BATCH_BYTES = 32 << 20


def list_files(spark: SparkSession, root: str, repo: str | None = None,
               budget: int = 10_000) -> DataFrame:
    """Files below a folder as `(repo, path, size)`.

    Without a repository name each folder of the first level is a repository, and files beside
    those folders belong to none and are left out. See `list_tree` for the budget.
    """
    found = list_tree(spark, root, budget)
    if repo:
        return found.select(F.lit(repo).alias("repo"), "path", "size")
    first = F.substring_index("path", "/", 1)
    return found.where(F.col("path").contains("/")).select(
        first.alias("repo"), F.substr("path", F.length(first) + 2).alias("path"), "size")


def read_files(spark: SparkSession, root: str, suffixes: list[str] | None = None,
               repo: str | None = None, tasks: int | None = None) -> DataFrame:
    """Files below a folder as `(repo, path, content)`, content still binary.

    Suffixes are applied to the listing, so other files are never opened. Files are dealt out
    over tasks by path: a repository with most of the files is read by all of them.
    """
    listed = list_files(spark, root, repo)
    if suffixes:
        listed = listed.where(ends_with_any(F.col("path"), suffixes))
    inside = bool(repo)

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(root)
        rows, held = [], 0

        def gathered() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), (pa.string(), pa.string(), pa.binary()))],
                names=["repo", "path", "content"])

        for batch in batches:
            for name, path in zip(*(batch.column(k).to_pylist() for k in range(2))):
                with store.open_input_stream(f"{base}/{path}" if inside else
                                             f"{base}/{name}/{path}") as stream:
                    rows.append((name, path, stream.read()))
                held += len(rows[-1][2])
                if held >= _BATCH_BYTES:
                    yield gathered()
                    rows, held = [], 0
        if rows:
            yield gathered()

    return listed.select("repo", "path").repartition(
        tasks or task_count(spark), "repo", "path").mapInArrow(
        contents, "repo string, path string, content binary")


def strict_text(content: Column) -> Column:
    """UTF-8 text, null where the bytes are not valid."""
    return F.try_validate_utf8(content.cast("string"))


def decoded(files: DataFrame) -> DataFrame:
    """Files `(repo, path, content)` with their content as text and a reason.

    A content that `strict_text` refuses becomes null and has a reason; others have none.
    """
    text = strict_text(F.col("content"))
    refused = F.col("content").isNotNull() & text.isNull()
    return files.withColumns({"content": text, "reason": F.when(refused, "not valid UTF-8")})


def repaired_text(content: Column) -> Column:
    """UTF-8 text with invalid bytes replaced."""
    return F.make_valid_utf8(content.cast("string"))


def listed_paths(listing: DataFrame) -> DataFrame:
    """File paths of a hosting site's tree listing, without its directories."""
    return listing.where(F.col("type").isin("blob", "commit_file")).select("repo", "path")
