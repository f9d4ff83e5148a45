"""The analysis report as ordered Markdown fragments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.operators import findings as ops
from repograph.operators.ordering import first_n

_HEADER, _ARCHITECTURE, _MODULES, _KEY_FINDINGS = range(4)
REPORT_ORDER = ["section", "part", "position"]


def _fragment(df: DataFrame, section: int, text: Column, part: Column | None = None,
              position: Column | None = None) -> DataFrame:
    part = F.lit("") if part is None else part
    position = F.lit(0) if position is None else position
    return df.select("run_id", F.lit(section).alias("section"), part.alias("part"),
                     position.cast("bigint").alias("position"), text.alias("text"))


def _count(label: str, c) -> Column:
    return F.concat(F.lit(f"- **{label}**: "), F.col(c).cast("string"), F.lit("\n"))


def _more(count: Column, listed: int) -> Column:
    return F.concat(F.lit("- ... and "), (count - listed).cast("string"), F.lit(" more\n"))


def analysis_report(targets: DataFrame, metrics: DataFrame, nodes: DataFrame, edges: DataFrame,
                    modules: DataFrame, flat: DataFrame, listed: int = 20) -> DataFrame:
    """Fragments of each run's report; sorted in REPORT_ORDER they read as one document.

    Lists show their first entries and a count, as counted by separate aggregates.
    """
    head = metrics.join(targets, "run_id", "left")
    parts = [_fragment(head, _HEADER, F.concat(
        F.lit("# Code Analysis Report\n\nTarget: `"), F.coalesce("target", F.lit("unknown")),
        F.lit("`\n## Summary\n"), _count("Tools executed", "tool_count"),
        _count("Total findings", "total_findings"), _count("Errors", "error_count"),
        _count("Warnings", "warning_count"), _count("Notes", "note_count")))]

    sizes = nodes.groupBy("run_id").agg(F.count(F.lit(1)).alias("files")).join(
        edges.groupBy("run_id").agg(F.count(F.lit(1)).alias("edges")), "run_id", "left").fillna(
        0, ["edges"])
    parts.append(_fragment(sizes, _ARCHITECTURE, F.concat(
        F.lit("## Architecture\n"), _count("Files analyzed", "files"),
        _count("Dependency edges", "edges"))))
    parts += _listing(listed, nodes, _ARCHITECTURE, "type", ["place"],
                      F.concat(F.lit("- `"), F.col("id"), F.lit("`\n")),
                      F.concat(F.lit("\n### "), F.initcap("type"), F.lit(" files (")))

    parts.append(_fragment(modules.select("run_id").distinct(), _MODULES,
                           F.lit("\n## Module Analysis\n")))
    told = F.size("file_summaries") > 0
    parts.append(_fragment(modules, _MODULES, F.concat(
        F.lit("\n### "), F.col("module"), F.lit("\n"),
        F.when(F.col("module_doc") != "", F.concat(F.lit("_"), F.col("module_doc"), F.lit("_\n")))
        .otherwise(""),
        F.when(told, F.concat(F.lit("\nFiles:\n"), F.array_join(F.transform(
            "file_summaries", lambda x: F.concat(F.lit("- "), x, F.lit("\n"))), ""))).otherwise(""),
        F.when(F.col("finding_count") > 0, F.concat(
            F.lit("\nFindings: "), F.col("finding_count").cast("string"), F.lit("\n")))
        .otherwise("")), F.col("module"), F.lit(1)))

    parts.append(_fragment(metrics, _KEY_FINDINGS, F.lit("\n## Key Findings\n")))
    serious = flat.where(F.col("level").isin("error", "warning"))
    line = F.concat(F.lit("- **"), F.col("rule_id"), F.lit("** in `"), F.col("file"), F.lit(":"),
                    F.col("line").cast("string"), F.lit("` -- "), F.col("message"), F.lit("\n"))
    parts += _listing(listed, serious, _KEY_FINDINGS, "level", ops.MERGED_ORDER, line, F.concat(
        F.lit("\n### "), F.when(F.col("level") == "error", "Errors").otherwise("Warnings"),
        F.lit(" (")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _listing(listed: int, df: DataFrame, section: int, group: str, order: list[str], line: Column,
             title: Column) -> list[DataFrame]:
    """A title with the count of each group, its first entries, and the number left out."""
    counts = df.groupBy("run_id", group).agg(F.count(F.lit(1)).alias("n"))
    top = first_n(df, ["run_id", group], order, listed, "position")
    return [
        _fragment(counts, section, F.concat(title, F.col("n").cast("string"), F.lit(")\n")),
                  F.col(group)),
        _fragment(top, section, line, F.col(group), F.col("position")),
        _fragment(counts.where(F.col("n") > listed), section, _more(F.col("n"), listed), F.col(group),
                  F.lit(listed + 1))]
