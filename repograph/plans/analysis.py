"""From tool reports to merged, deduplicated findings and their metrics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from repograph.normalize import Converter, normalise
from repograph.operators import findings as ops, merge, sarif
from repograph.stage import staged


@dataclass(frozen=True)
class Analysis:
    """Results of one batch of reports, keyed by run."""

    findings: DataFrame
    rules: DataFrame
    runs: DataFrame
    rejects: DataFrame
    metrics: DataFrame
    artifacts: DataFrame

    def document(self) -> DataFrame:
        """The unified SARIF text as ordered fragments."""
        return sarif.unified_document(self.findings, self.rules, self.runs, self.artifacts)


def analyse(reports: DataFrame, tools: list[str] | None = None,
            extra: dict[str, Converter] | None = None, keep: bool = True) -> Analysis:
    """Normalise, merge by tool, deduplicate and count.

    Findings need no shuffle for the merge: sorting by tool name is the merged order. The only
    shuffle of findings is the one on (run, fingerprint). What several results read is written out
    first: the parsed reports, the findings, the runs and the deduplicated findings. Each report is
    read and parsed once; `keep=False` leaves everything lazy.
    """
    hold = staged if keep else lambda df: df
    raw = normalise(reports, tools, extra, keep=keep)
    findings, runs = hold(raw.findings), hold(raw.runs)
    unique = hold(ops.deduplicate(ops.with_fingerprint(findings)).drop("fp"))
    return Analysis(
        findings=unique, rules=merge.merge_rules(raw.rules, runs), runs=merge.merge_runs(runs),
        rejects=raw.rejects, metrics=ops.run_metrics(unique, runs),
        artifacts=ops.artifacts(findings).unionByName(raw.artifacts).distinct())
