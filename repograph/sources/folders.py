"""Folder trees as tables of files, listed and read by tasks.

Spark's own file sources leave out empty files and every name that starts with a dot or an
underscore, `__init__.py` among them. So tasks list and read the folders through Arrow's file
systems, which know local paths and the usual object stores.

A tree is listed in rounds. The rows of a round are folders; a task lists the tree below each of
them until it has seen so many entries, and hands the folders it has not reached to the next round,
which deals them over all tasks. A small tree takes one round; a large one spreads by its size and
not by the number of its first-level folders. A round is written out, so a lost executor repeats no
other round.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from repograph.stage import staged

_BATCH_ROWS = 10_000


def open_folder(root: str) -> tuple[fs.FileSystem, str]:
    """The file system of a root folder and the folder's path in it."""
    store, base = fs.FileSystem.from_uri(root.rstrip("/"))
    return store, base.rstrip("/")


def task_count(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism * 4,
               int(spark.conf.get("spark.sql.shuffle.partitions")))


def _entries(found: list[tuple]) -> pa.RecordBatch:
    columns = zip(*found) if found else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.bool_(), pa.string(), pa.int64()))],
        names=["is_folder", "path", "size"])


def _listing(root: str, budget: int):
    """From folders to the files below them and the folders that were not reached."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(root)
        for batch in batches:
            for folder in batch.column(0).to_pylist():
                left, seen, found = [folder], 0, []
                while left and seen < budget:
                    here = left.pop()
                    entries = store.get_file_info(fs.FileSelector(f"{base}/{here}" if here else base))
                    seen += len(entries) + 1
                    for e in entries:
                        path = f"{here}/{e.base_name}" if here else e.base_name
                        if e.type == fs.FileType.Directory:
                            left.append(path)
                        elif e.type == fs.FileType.File:
                            found.append((False, path, e.size))
                        if len(found) >= _BATCH_ROWS:
                            yield _entries(found)
                            found = []
                yield _entries(found + [(True, path, None) for path in left])
    return run


def list_tree(spark: SparkSession, root: str, budget: int = 10_000) -> DataFrame:
    """All files below a folder as `(path, size)`, the path relative to the folder.

    Empty and hidden files are listed too. `budget`: entries a task lists below one folder before
    it hands on the rest; a single folder is listed in one call.
    """
    rounds = []
    frontier = spark.createDataFrame([("",)], "path string")
    while True:
        found = staged(frontier.repartition(task_count(spark), "path").mapInArrow(
            _listing(root, budget), "is_folder boolean, path string, size bigint"))
        rounds.append(found.where("NOT is_folder").select("path", "size"))
        frontier = found.where("is_folder").select("path")
        if frontier.isEmpty():
            return reduce(DataFrame.unionByName, rounds)


def write_files(files: DataFrame, root: str) -> None:
    """Write each row `(path, content)` as a file below a folder; content is text or binary.

    Tasks write the files; a repeated task writes the same bytes to the same names. Paths are
    unique. A null content gives an empty file.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(root)
        made = set()
        for batch in batches:
            for path, content in zip(*(batch.column(k).to_pylist() for k in range(2))):
                folder = f"{base}/{path}".rpartition("/")[0]
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content or b"")
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["written"])

    files.select("path", F.col("content").cast("binary").alias("content")).mapInArrow(
        write, "written bigint").write.format("noop").mode("overwrite").save()
