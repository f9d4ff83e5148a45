"""Turn tool reports into findings, rules and runs.

`normalise` dispatches each report by tool: tools with a format of their own go to their
converter, everything else is read as a SARIF document. Keep the report table partitioned by
tool; each branch then scans only its own partitions.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, functions as F, types as T

from repograph.model import (
    ARTIFACT_SCHEMA, FINDING_SCHEMA, ORIGINAL, PROPERTIES, REJECT_SCHEMA, RULE_SCHEMA, RUN_SCHEMA)
from repograph.normalize import native
from repograph.normalize.base import KEYS, Converter, Rule, parse_lines, report_heads
from repograph.normalize.json_tools import (
    CARGO_AUDIT, CARGO_UDEPS, HORUSEC, LIZARD, PYRIGHT, SHELLCHECK)
from repograph.normalize.line_tools import (
    CARGO_DENY, CHKTEX, CLIPPY, DEPTRAC, LACHECK, TAPLO, TRUFFLEHOG)
from repograph.normalize.xml_tools import PHPCS
from repograph.operators.ordering import first_n
from repograph.stage import staged

CONVERTERS = {c.tool: c for c in (
    PYRIGHT, LIZARD, TRUFFLEHOG, PHPCS, DEPTRAC, HORUSEC, CLIPPY, CARGO_AUDIT, CARGO_DENY,
    CARGO_UDEPS, CHKTEX, LACHECK, TAPLO, SHELLCHECK)}
# Tools whose reports are lines: such a report may come in pieces.
LINE_TOOLS = frozenset(name for name, c in CONVERTERS.items() if c.parse is parse_lines)
# Tools whose output has no converter and is not SARIF either.
UNREADABLE = {"detect-secrets": "no converter for this format"}


@dataclass(frozen=True)
class Normalised:
    findings: DataFrame
    rules: DataFrame
    runs: DataFrame
    rejects: DataFrame
    artifacts: DataFrame


def normalise(reports: DataFrame, tools: list[str] | None = None,
              extra: dict[str, Converter] | None = None,
              processed_at: str | None = None, keep: bool = False) -> Normalised:
    """Read reports `(run_id, doc_idx, tool, raw)`, or pieces of them as `read_report_pieces` gives.

    `tools` narrows the branches to the tools known to occur; `extra` adds or replaces
    converters by tool name. Documents that cannot be read end up in `rejects`.

    The five results come from one parsed form of each report. With `keep` it is written out, a
    table per branch, and no report is parsed twice; without, every result parses what it reads.
    """
    hold = staged if keep else lambda df: df
    known = {**CONVERTERS, **(extra or {})}
    wanted = [c for name, c in known.items() if tools is None or name in tools]
    parts = [_converted(reports, c, hold) for c in wanted]
    if tools is None or any(t not in known for t in tools):
        parts.append(_native(reports, set(known), processed_at, hold))
        parts.append(_unreadable(reports))
    def gather(name):
        have = [p[name] for p in parts if p.get(name) is not None]
        return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), have) if have else None

    return Normalised(*[_shape(reports, gather(n), s) for n, s in (
        ("findings", f"{FINDING_SCHEMA}, {ORIGINAL}"), ("rules", f"{RULE_SCHEMA}, {ORIGINAL}"),
        ("runs", RUN_SCHEMA), ("rejects", REJECT_SCHEMA), ("artifacts", ARTIFACT_SCHEMA))])


def _shape(reports: DataFrame, df: DataFrame | None, schema: str) -> DataFrame:
    """Cast to the declared layout; an empty table where no branch has such rows."""
    declared = T.StructType.fromDDL(schema)
    if df is None:
        return reports.sparkSession.createDataFrame([], declared)
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in declared])


def rule_catalogue(results: DataFrame, converter: Converter, accepted: DataFrame) -> DataFrame:
    """Rules per report: the first result of each id brings the rule.

    A constant rule is added for every report; a fallback rule only where no result brought one.
    """
    columns = ["run_idx", "rule_idx", "tool", "rule_id", "name", "description", "level",
               "help_uri"]

    def stated(reports: DataFrame, rule: Rule) -> DataFrame:
        values = (0, 0, converter.driver, rule.rule_id, rule.name, rule.description, rule.level)
        return reports.select(*KEYS, *[F.lit(v).alias(n) for v, n in zip(values, columns)],
                              F.lit(None).cast("string").alias("help_uri"))

    if converter.always:
        reports = accepted.where(converter.always_when()) if converter.always_when else accepted
        return stated(reports, converter.always)
    first = first_n(results, [*KEYS, "rule_id"], ["result_idx"], 1).select(
        *KEYS, "run_idx", F.col("result_idx").alias("rule_idx"), "tool", "rule_id",
        F.col("rule_name").alias("name"), F.col("rule_description").alias("description"), "level",
        F.lit(None).cast("string").alias("help_uri"))
    if not converter.fallback:
        return first
    bare = accepted.join(results.select(*KEYS).distinct(), KEYS, "left_anti")
    return first.unionByName(stated(bare, converter.fallback))


def _converted(reports: DataFrame, c: Converter, hold) -> dict[str, DataFrame]:
    mine = c.parse(reports.where(F.col("tool") == c.tool))
    reason = c.reason() if c.reason else F.lit(None).cast("string")
    judged = hold(mine.withColumn("reason", reason))
    rejects, accepted = None, judged
    if c.reason:
        rejects = judged.where(F.col("reason").isNotNull()).select(*KEYS, "tool", "reason")
        accepted = judged.where(F.col("reason").isNull())
    results = c.results(accepted)
    accepted = report_heads(accepted)
    runs = accepted.select(
        *KEYS, F.lit(0).alias("run_idx"), F.lit(c.driver).alias("tool"),
        (c.version() if c.version else F.lit("unknown")).alias("version"),
        F.lit(None).cast("string").alias("extensions"),
        F.lit(None).cast(PROPERTIES).alias("properties"))
    return {"findings": results.drop("rule_name", "rule_description"),
            "rules": rule_catalogue(results, c, accepted), "runs": runs, "rejects": rejects}


def _native(reports: DataFrame, converted: set[str], processed_at, hold) -> dict[str, DataFrame]:
    mine = reports.where(~F.col("tool").isin(*converted, *UNREADABLE))
    judged = hold(native.parse(mine).withColumn("reason", native.reason()))
    accepted = judged.where(F.col("reason").isNull())
    return {"findings": native.findings(accepted), "rules": native.rules(accepted),
            "runs": native.runs(accepted, processed_at), "artifacts": native.artifacts(accepted),
            "rejects": judged.where(F.col("reason").isNotNull()).select(*KEYS, "tool", "reason")}


def _unreadable(reports: DataFrame) -> dict[str, DataFrame]:
    pairs = [F.lit(x) for kv in UNREADABLE.items() for x in kv]
    mine = reports.where(F.col("tool").isin(*UNREADABLE))
    return {"rejects": mine.select(
        *KEYS, "tool", F.element_at(F.create_map(*pairs), F.col("tool")).alias("reason"))}
