"""Operators over findings: deduplication, metrics, queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import paths, text
from repograph.model import MERGED_ORDER, first_location, level_name, level_rank
from repograph.operators.ordering import dense_index, first_n
from repograph.operators.skew import split_join
from repograph.stage import staged


def level_or_warning() -> Column:
    return F.coalesce(F.col("level"), F.lit("warning"))


def with_fingerprint(findings: DataFrame) -> DataFrame:
    """Add `fp`: the tool's own first fingerprint, else a hash of place, rule and message.

    The map keeps document order, so its first value is the first one written.
    """
    own = F.get(F.map_values("fingerprints"), F.lit(0))
    made = text.finding_fingerprint(first_location("uri"), first_location("start_line"),
                                    F.col("rule_id"), F.col("message"))
    return findings.withColumn("fp", F.coalesce(own, made))


def deduplicate(findings: DataFrame, order: list[str] = MERGED_ORDER) -> DataFrame:
    """Keep the most severe finding per (run, fingerprint); ties go to the first one.

    `row_number() = 1` lets Spark drop all but one row per fingerprint in every map task,
    which is what keeps a fingerprint shared by very many findings harmless.
    """
    ranked = findings.withColumn("_rank", level_rank(level_or_warning()))
    best = first_n(ranked, ["run_id", "fp"], [F.desc("_rank"), *order], 1)
    return best.drop("_rank")


def run_metrics(findings: DataFrame, runs: DataFrame) -> DataFrame:
    """Counts per run, with the tools of every run whether or not they found anything."""
    level = level_or_warning()
    counts = findings.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("total_findings"),
        F.count_if(level == "error").alias("error_count"),
        F.count_if(level == "warning").alias("warning_count"),
        F.count_if(level == "note").alias("note_count"))
    tools = runs.groupBy("run_id").agg(F.array_sort(F.collect_set("tool")).alias("tools_run"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint").alias(c)
    return tools.join(counts, "run_id", "left").select(
        "run_id", zero("total_findings"), zero("error_count"), zero("warning_count"),
        zero("note_count"), "tools_run", F.size("tools_run").cast("bigint").alias("tool_count"))


def severity_counts(findings: DataFrame) -> DataFrame:
    """Findings per run, tool and level."""
    return findings.groupBy("run_id", "tool", level_or_warning().alias("level")).agg(
        F.count(F.lit(1)).alias("findings"))


def dashboard_metrics(findings: DataFrame, tool_results: DataFrame) -> DataFrame:
    """One row per run: counts by severity and by tool, files touched, tool outcomes.

    Maps are built from pre-aggregated counts; their size is the number of tools or levels.
    """
    counts = severity_counts(findings)
    as_map = lambda k: F.map_from_entries(
        F.array_sort(F.collect_list(F.struct(F.col(k), F.col("n")))))
    by_level = counts.groupBy("run_id", "level").agg(F.sum("findings").alias("n")).groupBy(
        "run_id").agg(as_map("level").alias("by_severity"), F.sum("n").alias("total_findings"))
    by_tool = counts.groupBy("run_id", "tool").agg(F.sum("findings").alias("n")).groupBy(
        "run_id").agg(as_map("tool").alias("by_tool"))
    files = findings.where(text.nonempty(F.col("file")).isNotNull()).select(
        "run_id", "file").distinct().groupBy("run_id").agg(
        F.count(F.lit(1)).alias("files_affected"))
    status = tool_results.groupBy("run_id").agg(
        F.count(F.lit(1)).alias("tools_run"),
        F.count_if("success").alias("tools_succeeded"),
        F.count_if(~F.col("success")).alias("tools_failed"),
        F.sum("duration_seconds").alias("duration_seconds"))
    return (status.join(by_level, "run_id", "left").join(by_tool, "run_id", "left")
            .join(files, "run_id", "left")
            .fillna(0, ["total_findings", "files_affected"]))


def project_findings(findings: DataFrame) -> DataFrame:
    """Flat view of each result: first location only, defaults for missing fields."""
    kept = [c for c in MERGED_ORDER if c in findings.columns]
    return findings.select(
        "run_id", *kept,
        F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"),
        level_or_warning().alias("level"), F.col("level").alias("raw_level"),
        F.coalesce("message", F.lit("")).alias("message"),
        F.coalesce(first_location("uri"), F.lit("")).alias("file"),
        F.coalesce(first_location("start_line"), F.lit(0)).alias("line"),
        F.coalesce(first_location("end_line"), first_location("start_line"),
                   F.lit(0)).alias("end_line"))


def query_findings(flat: DataFrame, run_id: str | None = None, severity: str | None = None,
                   tool: str | None = None, file: str | None = None, limit: int | None = None,
                   order: list[str] = MERGED_ORDER) -> DataFrame:
    """Findings of a run by exact level, exact tool and part of the file name.

    A finding without a level of its own matches no severity. The filters reach the scan;
    the limit becomes a top-n, not a full sort.
    """
    out = flat
    if run_id:
        out = out.where(F.col("run_id") == run_id)
    if tool:
        out = out.where(F.col("tool") == tool)
    if severity:
        out = out.where(F.col("raw_level") == severity)
    if file:
        out = out.where(F.col("file").contains(file))
    return out if limit is None else out.orderBy("run_id", *order).limit(limit)


def findings_with_severity(findings: DataFrame, severity: str) -> DataFrame:
    """Whole results of one level."""
    return findings.where(F.col("level") == severity)


def filter_view(view: DataFrame, severity: str | None = None, tool: str | None = None,
                file: str | None = None) -> DataFrame:
    """Report view filter; the file test ignores case."""
    out = view
    if severity:
        out = out.where(F.col("severity") == severity)
    if tool:
        out = out.where(F.col("tool") == tool)
    if file:
        out = out.where(F.lower("file").contains(file.lower()))
    return out


def view_projection(raw: DataFrame) -> DataFrame:
    """Columns of the report view, reading either spelling of each field."""
    have = set(raw.columns)

    def pick(names, default):
        cols = [F.col(n) for n in names if n in have]
        return F.coalesce(*cols, F.lit(default))

    def optional(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    return raw.select(
        "run_id", "index", pick(["tool"], "").alias("tool"),
        pick(["rule_id", "ruleId"], "").alias("rule_id"), pick(["message"], "").alias("message"),
        pick(["level", "severity"], "warning").alias("severity"), pick(["file"], "").alias("file"),
        pick(["line", "startLine"], 0).alias("start_line"),
        pick(["endLine", "end_line", "line"], 0).alias("end_line"),
        optional("snippet").alias("snippet"), optional("fingerprint").alias("fingerprint"))


def global_index(findings: DataFrame, name: str = "index") -> DataFrame:
    """Number the findings of each run across its tools, from zero."""
    return dense_index(findings, ["run_id"], ["tool", "doc_idx", "run_idx"], "result_idx", name)


def explain_findings(findings: DataFrame, rules: DataFrame, wanted: DataFrame) -> DataFrame:
    """Rule text for the findings named by `wanted(run_id, index)`.

    Only the runs asked about are numbered, and rules are joined after the index lookup, so only
    the asked findings meet them. One run, or one rule, may have most of the findings.
    """
    runs = split_join(findings, wanted.select("run_id").distinct(), ["run_id"], "left_semi")
    asked = staged(global_index(runs).join(wanted, ["run_id", "index"], "left_semi"))
    # One entry per (run, tool, rule id); a later entry replaces an earlier one.
    texts = rules.groupBy("run_id", "tool", "rule_id").agg(
        F.max_by(F.struct("description", "help_uri"), F.struct(
            F.col("doc_idx"), F.col("run_idx"), F.col("rule_idx"))).alias("rule"))
    flat = asked.select(
        "run_id", "index", "tool", F.coalesce("rule_id", F.lit("unknown")).alias("rule_id"),
        level_or_warning().alias("level"), F.coalesce("message", F.lit("")).alias("message"),
        first_location("uri").alias("file"), first_location("start_line").alias("line"))
    return split_join(flat, texts, ["run_id", "tool", "rule_id"], "left").select(
        *flat.columns, F.coalesce("rule.description", F.lit("")).alias("description"),
        F.coalesce("rule.help_uri", F.lit("")).alias("help_uri"))


def explanation_text(explained: DataFrame) -> DataFrame:
    """Readable explanation of each asked finding."""
    line = lambda label, c: F.concat(F.lit(label), c, F.lit("\n"))
    body = F.concat(
        line("Finding #", F.col("index").cast("string")), line("Tool: ", F.col("tool")),
        line("Rule: ", F.col("rule_id")), line("Level: ", F.col("level")),
        line("Message: ", F.col("message")),
        F.when(F.col("description") != "", line("\nDescription: ", F.col("description")))
        .otherwise(""),
        F.when(F.col("help_uri") != "", line("Reference: ", F.col("help_uri"))).otherwise(""),
        F.when(F.col("file").isNotNull(), F.concat(
            F.lit("\nLocation: "), F.col("file"), F.lit(":"),
            F.coalesce(F.col("line").cast("string"), F.lit("?")), F.lit("\n"))).otherwise(""))
    return explained.select("run_id", "index", body.alias("explanation"))


def severity_order() -> Column:
    return F.desc(level_rank(F.col("level")))


def sort_by_severity(flat: DataFrame, order: list[str] = MERGED_ORDER) -> DataFrame:
    """Errors, warnings, notes, then the rest; stable by the finding's place in its run."""
    return flat.orderBy("run_id", severity_order(), *order)


def page_of(view: DataFrame, page: int, order: list, page_size: int = 20) -> DataFrame:
    """One page of a view sorted on any columns."""
    return view.orderBy(*order).offset(page * page_size).limit(page_size)


def tool_breakdown(findings: DataFrame, tool_results: DataFrame) -> DataFrame:
    """Findings per tool with the tool's outcome, most findings first."""
    counts = findings.groupBy("run_id", "tool").agg(F.count(F.lit(1)).alias("findings"))
    status = tool_results.select("run_id", "tool", "success", "duration_seconds")
    return counts.join(status, ["run_id", "tool"], "left").select(
        "run_id", "tool", "findings", F.coalesce("success", F.lit(True)).alias("success"),
        "duration_seconds").orderBy("run_id", F.desc("findings"), "tool")


def tool_run_totals(tool_results: DataFrame) -> DataFrame:
    """Tools succeeded and failed per run, and the error texts in tool order."""
    failed = ~F.col("success")
    with_error = failed & text.nonempty(F.col("error")).isNotNull()
    entry = F.when(with_error, F.struct(
        F.col("tool"), F.concat_ws(": ", "tool", "error").alias("text")))
    return tool_results.groupBy("run_id").agg(
        F.count_if("success").alias("succeeded"), F.count_if(failed).alias("failed"),
        F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["text"]).alias("errors"))


def top_per_level(flat: DataFrame, n: int = 20, order: list[str] = MERGED_ORDER) -> DataFrame:
    """First n findings per run and level with the number left out.

    Counts come from a separate aggregate so that the ranking can prune before its shuffle.
    """
    totals = flat.groupBy("run_id", "level").agg(F.count(F.lit(1)).alias("level_total"))
    top = first_n(flat, ["run_id", "level"], order, n, "position")
    return top.join(totals, ["run_id", "level"]).withColumn(
        "remaining", F.greatest(F.col("level_total") - n, F.lit(0)))


def runs_with_findings(runs: DataFrame, findings: DataFrame) -> DataFrame:
    """Runs worth reporting on: those with at least one finding."""
    return runs.select("run_id").distinct().join(
        findings.select("run_id").distinct(), "run_id", "left_semi")


def file_nodes(findings: DataFrame) -> DataFrame:
    """One node per file, counting every location of every finding.

    `place` is where the file was first named; nodes are listed in that order.
    """
    places = findings.select(
        "run_id", *MERGED_ORDER, level_rank(level_or_warning()).alias("rank"),
        F.posexplode("locations").alias("nth", "location"))
    return places.where(text.nonempty(F.col("location.uri")).isNotNull()).groupBy(
        "run_id", F.col("location.uri").alias("id")).agg(
        F.count(F.lit(1)).alias("finding_count"), F.max("rank").alias("rank"),
        F.min(F.struct(*MERGED_ORDER, "nth")).alias("place")).select(
        "run_id", "id", paths.classify_file(F.col("id")).alias("type"), "finding_count",
        level_name(F.col("rank")).alias("severity_max"), "place")


def artifacts(findings: DataFrame) -> DataFrame:
    """Distinct files named by the results of each run, one row per file."""
    return findings.select("run_id", F.explode("locations.uri").alias("uri")).where(
        text.nonempty(F.col("uri")).isNotNull()).distinct()
