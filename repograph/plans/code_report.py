"""Topology, module summaries and the report over one batch of findings."""

from __future__ import annotations

from pyspark.sql import DataFrame

from repograph.model import MERGED_ORDER
from repograph.operators import findings as ops, graph, modules, report
from repograph.stage import staged


def topology(findings: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes with findings and the import edges that touch them."""
    nodes = ops.file_nodes(findings)
    return nodes, graph.import_edges(files, nodes)


def code_report(findings: DataFrame, runs: DataFrame, files: DataFrame,
                targets: DataFrame, listed: int = 20, files_shown: int = 20,
                samples_shown: int = 5) -> DataFrame:
    """Report fragments of every run that has findings.

    `listed`, `files_shown` and `samples_shown` are how many entries the report lists.

    `files(run_id, path, content)` are the analysed trees, `targets(run_id, target)` their names.

    The findings, the nodes and the summaries are written out: a dozen parts of the report read
    them. The contents of the files are read twice, for imports and for summaries.
    """
    findings = staged(findings.select("run_id", *MERGED_ORDER, "rule_id", "level", "message",
                                      "locations"))
    worth = ops.runs_with_findings(runs, findings)
    nodes = staged(ops.file_nodes(findings))
    edges = graph.import_edges(files, nodes)
    reported = runs.join(worth, "run_id", "left_semi")
    return report.analysis_report(
        targets, staged(ops.run_metrics(findings, reported)), nodes, edges,
        staged(modules.module_summaries(files, findings, files_shown, samples_shown)),
        ops.project_findings(findings), listed)
