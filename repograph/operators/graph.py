"""Import graph of Python files."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repograph.operators.once import compute_once
from repograph.operators.skew import salted_join

# Fixed value: what counts as an import line. Line ends are plain newlines only.
_IMPORT = r"(?Umd)^\s*(?:from|import)\s+([\w.]+)"


def import_edges(files: DataFrame, known: DataFrame) -> DataFrame:
    """Imports `(run_id, source, target, type)` where either end is a known file.

    `known(run_id, id)` lists the files with findings. The OR over both ends is two equi-joins:
    the source is looked up once per file, before its imports are exploded. The known files grow
    with the tree, and their table is larger than its files look: they are not broadcast.
    """
    ids = known.select("run_id", "id").distinct().withColumn("hit", F.lit(True))
    python = files.where(F.col("path").endswith(".py")).select(
        "run_id", F.col("path").alias("source"), "content")
    python = compute_once(python, "modules", F.regexp_extract_all(
        "content", F.lit(_IMPORT), F.lit(1))).drop("content").where(F.size("modules") > 0)
    by_source = ids.select("run_id", F.col("id").alias("source"), F.col("hit").alias("source_hit"))
    by_target = ids.select("run_id", F.col("id").alias("target"), F.col("hit").alias("target_hit"))
    edges = python.join(by_source.hint("merge"), ["run_id", "source"], "left").select(
        "run_id", "source", "source_hit", F.explode("modules").alias("module")).withColumn(
        "target", F.concat(F.replace("module", F.lit("."), F.lit("/")), F.lit(".py")))
    # A module nearly every file imports is one target.
    found = salted_join(edges, by_target, ["run_id", "target"], ["source"], "left")
    return found.where(F.col("source_hit") | F.col("target_hit")).select(
        "run_id", "source", "target", F.lit("import").alias("type"))
