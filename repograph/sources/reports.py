"""Tool reports on disk, and reading them by pieces.

A report is a file `<root>/<run>/<tool>.<ext>`. The files are listed first and joined with the tools
that succeeded, so no other file is opened. Formats of one finding a line are cut into byte ranges
and each range is read by itself: a range has the lines that begin in it. `normalise` takes such
pieces as it takes whole reports. All other formats are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from repograph.normalize import LINE_TOOLS
from repograph.sources.folders import list_tree, open_folder, task_count, write_files

TOOL_RESULT_SCHEMA = (
    "run_id string, tool string, success boolean, sarif_path string, stdout string, "
    "stderr string, return_code int, duration_seconds double, error string")

_BATCH_BYTES = 32 << 20
_LOOK_BYTES = 1 << 16
_PIECE = "run_id string, doc_idx bigint, tool string, raw binary, offset bigint, after binary"


def report_files(spark: SparkSession, root: str, tool_results: DataFrame) -> DataFrame:
    """`(run_id, doc_idx, tool, path, size)` of the reports of tools that succeeded and wrote one.

    `tool_results` may give the order of the tools of a run as `tool_no`.
    """
    parts = F.split("path", "/")
    files = list_tree(spark, root).select(
        F.try_element_at(parts, F.lit(-2)).alias("run_id"),
        F.regexp_extract(F.element_at(parts, -1), r"\A(.+?)(?:\.[^.]+)?\z", 1).alias("tool"),
        "path", "size")
    order = F.col("tool_no") if "tool_no" in tool_results.columns else F.lit(0)
    done = tool_results.where(
        F.col("success") & F.col("sarif_path").isNotNull() & (F.col("sarif_path") != "")).select(
        "run_id", "tool", order.cast("bigint").alias("doc_idx"))
    return files.join(done, ["run_id", "tool"]).select("run_id", "doc_idx", "tool", "path", "size")


def _behind_line_end(stream, at: int, size: int) -> int:
    """The place behind the first line feed at or behind `at`, or the end of the file."""
    while at < size:
        look = stream.read_at(min(_LOOK_BYTES, size - at), at)
        found = look.find(b"\n")
        if found >= 0:
            return at + found + 1
        at += len(look)
    return size


def read_range(stream, begin: int, end: int, size: int) -> tuple[int, bytes, bytes] | None:
    """Where the first line that begins in [begin, end) begins, the lines that do, and the line
    after them. Ranges that tile a file give each of its lines once; an empty file has one
    empty piece."""
    start = _behind_line_end(stream, begin - 1, size) if begin else 0
    stop = _behind_line_end(stream, end - 1, size) if end < size else size
    if start >= stop and size:
        return None
    following = _behind_line_end(stream, stop, size)
    return start, stream.read_at(stop - start, start), stream.read_at(following - stop, stop)


def read_reports(spark: SparkSession, root: str, tool_results: DataFrame) -> DataFrame:
    """Whole reports `(run_id, doc_idx, tool, raw)` of the tools that succeeded, one row each."""
    return read_report_pieces(spark, root, tool_results, frozenset()).drop("offset", "after")


def read_report_pieces(spark: SparkSession, root: str, tool_results: DataFrame,
                       line_tools: frozenset[str] = LINE_TOOLS,
                       split_bytes: int = 32 << 20) -> DataFrame:
    """Reports `(run_id, doc_idx, tool, raw, offset, after)` of the tools that succeeded.

    A report of one of the `line_tools` is one row per `split_bytes`, each with whole lines;
    `offset` is the number of bytes before `raw`, `after` the line behind it (empty at the end).
    Other reports are one row, of up to 2 GB. Bytes that are not UTF-8 are replaced.
    """
    cut = F.when(F.col("tool").isin(*line_tools), F.lit(split_bytes)).otherwise(
        F.greatest("size", F.lit(1)))
    ranges = report_files(spark, root, tool_results).withColumn("split", cut.cast("bigint")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.greatest(
            F.col("size") - 1, F.lit(0)), F.col("split"))).alias("begin"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = open_folder(root)
        rows, held = [], 0

        def gathered() -> pa.RecordBatch:
            kinds = (pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64(), pa.binary())
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*rows), kinds)],
                names=["run_id", "doc_idx", "tool", "raw", "offset", "after"])

        for batch in batches:
            for r in batch.to_pylist():
                with store.open_input_file(f"{base}/{r['path']}") as stream:
                    piece = read_range(stream, r["begin"], r["begin"] + r["split"], r["size"])
                if piece is None:
                    continue
                rows.append((r["run_id"], r["doc_idx"], r["tool"], piece[1], piece[0], piece[2]))
                held += len(piece[1])
                if held >= _BATCH_BYTES:
                    yield gathered()
                    rows, held = [], 0
        if rows:
            yield gathered()

    pieces = ranges.repartition(task_count(spark), "path", "begin").mapInArrow(read, _PIECE)
    valid = lambda c: F.make_valid_utf8(F.col(c).cast("string")).alias(c)
    return pieces.select("run_id", "doc_idx", "tool", valid("raw"), "offset", valid("after"))


def write_reports(reports: DataFrame, path: str) -> None:
    """Store reports by tool, the layout each converter's branch prunes on."""
    reports.write.mode("overwrite").partitionBy("tool").parquet(path)


def write_report_files(reports: DataFrame, root: str, suffix: str = "json") -> None:
    """Write each report `(run_id, tool, raw)` as the file `<root>/<run_id>/<tool>.<suffix>`."""
    write_files(reports.select(
        F.concat(F.col("run_id"), F.lit("/"), F.col("tool"), F.lit(f".{suffix}")).alias("path"),
        F.col("raw").alias("content")), root)
