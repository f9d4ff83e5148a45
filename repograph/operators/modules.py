"""Summaries of the directories of an analysed tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import paths
from repograph.functions.text import nonempty, strip
from repograph.model import MERGED_ORDER
from repograph.operators.once import compute_once
from repograph.operators.ordering import first_n
from repograph.stage import staged

_SCRIPT_SUFFIXES = (".js", ".ts", ".tsx", ".jsx")


def python_doc(content: Column) -> Column:
    """First line of the docstring that opens a Python file; null when there is none."""
    double = r'(?s)\A"""(.*?)"""'
    single = r"(?s)\A'''(.*?)'''"
    body = F.when(content.rlike(double), F.regexp_extract(content, double, 1)).when(
        content.rlike(single), F.regexp_extract(content, single, 1))
    return strip(F.substring_index(strip(body), "\n", 1))


def script_comment(content: Column) -> Column:
    """First text line of the first block comment of a script; null when there is none."""
    block = r"(?s)/\*\*?\s*(.*?)(?:\*/|\n\s*\*\s*@)"
    body = F.when(content.rlike(block), F.regexp_extract(content, block, 1))
    rows = F.transform(F.split(strip(body), "\n"), lambda x: strip(
        F.regexp_replace(x, r"\A\s*\*\s?", "")))
    return F.get(F.filter(rows, lambda x: x != ""), F.lit(0))


def file_purpose(path: Column, content: Column) -> Column:
    """What a file says about itself, by file type."""
    return nonempty(F.when(path.endswith(".py"), python_doc(content)).when(
        paths.ends_with_any(path, _SCRIPT_SUFFIXES), script_comment(content)))


def module_summaries(files: DataFrame, findings: DataFrame, max_files: int,
                     max_samples: int) -> DataFrame:
    """Per directory: its own docstring, first file purposes, first messages, and how many of each.

    Only the `max_files` and `max_samples` entries that are shown get collected; the counts,
    file_count and finding_count, are of all. Directories
    without any of these are left out, and so are findings outside the tree.
    """
    told = files.select("run_id", "path", paths.directory(F.col("path")).alias("module"),
                        paths.file_name(F.col("path")).alias("name"), "content")
    told = compute_once(told, "purpose", file_purpose(F.col("path"), F.col("content")))
    # Three results read this, and the contents are large: written out, they are read once.
    told = staged(told.drop("content").where(F.col("purpose").isNotNull()))
    shown = first_n(told, ["run_id", "module"], ["name"], max_files).groupBy(
        "run_id", "module").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            "name", F.concat_ws(": ", "name", "purpose").alias("text")))),
            lambda x: x["text"]).alias("file_summaries"))
    said = told.groupBy("run_id", "module").agg(F.count(F.lit(1)).alias("file_count"))
    docs = told.where(F.col("name") == "__init__.py").select(
        "run_id", "module", F.col("purpose").alias("module_doc"))

    located = findings.select("run_id", *MERGED_ORDER, "message", F.posexplode("locations").alias(
        "nth", "place")).where(nonempty(F.col("place.uri")).isNotNull()).withColumn(
        "module", paths.directory(F.col("place.uri")))
    counts = located.groupBy("run_id", "module").agg(F.count(F.lit(1)).alias("finding_count"))
    place = [*MERGED_ORDER, "nth"]
    samples = first_n(located, ["run_id", "module"], place, max_samples).groupBy(
        "run_id", "module").agg(F.transform(F.array_sort(F.collect_list(F.struct(
            *place, F.coalesce("message", F.lit("")).alias("text")))),
            lambda x: x["text"]).alias("sample_findings"))

    keys = ["run_id", "module"]
    out = (_directories(files).join(docs, keys, "left").join(shown, keys, "left")
           .join(said, keys, "left").join(counts, keys, "left").join(samples, keys, "left"))
    none = F.array().cast("array<string>")
    return out.where(F.col("file_summaries").isNotNull() | F.col("finding_count").isNotNull()).select(
        *keys, F.coalesce("module_doc", F.lit("")).alias("module_doc"),
        F.coalesce("file_summaries", none).alias("file_summaries"),
        F.coalesce("file_count", F.lit(0)).cast("bigint").alias("file_count"),
        F.coalesce("finding_count", F.lit(0)).cast("bigint").alias("finding_count"),
        F.coalesce("sample_findings", none).alias("sample_findings"))


def _directories(files: DataFrame) -> DataFrame:
    """Every directory of the tree, those without files of their own included."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.when(
        i == 0, "(root)").otherwise(F.array_join(F.slice(parts, F.lit(1), i), "/")))
    own = files.select("run_id", "path").withColumn("dir", paths.directory(F.col("path")))
    # Directories first, then their ancestors: far fewer rows than files.
    dirs = own.groupBy("run_id", "dir").agg(F.min("path").alias("path"))
    return dirs.select("run_id", F.explode(above).alias("module")).distinct()
