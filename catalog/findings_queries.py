"""Queries over findings."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import query, table
from catalog.views import FINDINGS, LEVELLED, TOOL_RESULTS
from repograph.functions import severity, text
from repograph.model import PROPERTIES, one_location
from repograph.operators import findings as ops, merge, sarif

NORMAL = r"""
normal AS (SELECT *, CASE WHEN strpos(rule_id, '/') > 0
    THEN lower(substr(rule_id, strpos(rule_id, '/') + 1)) ELSE lower(rule_id) END AS rule_key,
  regexp_replace(regexp_replace(regexp_replace(lower(trim(message)), '\b[0-9a-f]{8,}\b',
    '<hash>', 'g'), '[''"][^''"]*[''"]', '<str>', 'g'), '\s+', ' ', 'g') AS message_key
  FROM levelled)"""
MARKED = NORMAL + r""",
marked AS (SELECT *, sha256(concat(file, ':', line, ':', rule_key, ':', message_key)) AS fp,
  CASE level WHEN 'error' THEN 3 WHEN 'warning' THEN 2 WHEN 'note' THEN 1 ELSE 0 END AS rank
  FROM normal),
best AS (SELECT run_id, fp, max(rank) AS rank FROM marked GROUP BY ALL),
first_best AS (SELECT m.run_id, m.fp, min(tool || lpad(seq::VARCHAR, 12, '0')) AS place
  FROM marked m JOIN best b ON m.run_id = b.run_id AND m.fp = b.fp AND m.rank = b.rank GROUP BY ALL),
deduped AS (SELECT m.* FROM marked m JOIN first_best f ON m.run_id = f.run_id AND m.fp = f.fp
  AND m.tool || lpad(m.seq::VARCHAR, 12, '0') = f.place)"""
BASE = f"WITH {LEVELLED}"
DEDUP = f"WITH {LEVELLED}, {MARKED}"


def deduped(spark, sf):
    return ops.deduplicate(ops.with_fingerprint(views.findings(spark, sf)))


@query("severity_mapping", f"""{BASE}
SELECT tool, native_severity, level, count(*) AS findings FROM levelled GROUP BY ALL""")
def severity_mapping(spark, sf):
    raw = views.raw_findings(spark, sf)
    return raw.withColumn("level", severity.map_severity(
        F.col("tool"), F.col("native_severity"))).groupBy("tool", "native_severity", "level").agg(
        F.count(F.lit(1)).alias("findings"))


@query("severity_registered_tool", f"""WITH findings_v AS ({FINDINGS})
SELECT seq, CASE WHEN tool = 'clippy' AND lower(trim(native_severity)) = 'high' THEN 'note'
  WHEN tool = 'clippy' AND native_severity = 'odd-word' THEN 'error'
  WHEN native_severity = 'HIGH' THEN 'error' WHEN native_severity = ' low ' THEN 'note'
  WHEN native_severity = 'unknown' THEN 'none' ELSE 'warning' END AS level FROM findings_v""")
def severity_registered_tool(spark, sf):
    words = severity.SeverityVocabulary().register_tool("Clippy", {"HIGH": "note",
                                                                   "odd-word": "error"})
    vocabulary = severity.vocabulary_table(spark, words)
    return severity.map_with_vocabulary(views.raw_findings(spark, sf), vocabulary).select(
        "seq", "level")


@query("normalised_text", f"""WITH {LEVELLED}, {NORMAL}
SELECT DISTINCT rule_id, message, rule_key, message_key FROM normal""")
def normalised_text(spark, sf):
    return views.raw_findings(spark, sf).select("rule_id", "message").distinct().select(
        "rule_id", "message", text.normalise_rule(F.col("rule_id")).alias("rule_key"),
        text.normalise_message(F.col("message")).alias("message_key"))


@query("finding_fingerprints", f"{DEDUP} SELECT seq, fp FROM marked")
def finding_fingerprints(spark, sf):
    return ops.with_fingerprint(views.findings(spark, sf)).select(
        F.col("result_idx").alias("seq"), "fp")


@query("deduplicated_findings", f"""{DEDUP}
SELECT run_id, tool, seq, rule_id, level, file, line, message, fp FROM deduped""")
def deduplicated_findings(spark, sf):
    place = F.get("locations", F.lit(0))
    return deduped(spark, sf).select(
        "run_id", "tool", F.col("result_idx").alias("seq"), "rule_id", "level",
        place["uri"].alias("file"), place["start_line"].alias("line"), "message", "fp")


@query("run_metrics", f"""{DEDUP}
SELECT f.run_id, count(d.seq) AS total_findings,
  count(*) FILTER (d.level = 'error') AS error_count,
  count(*) FILTER (d.level = 'warning') AS warning_count,
  count(*) FILTER (d.level = 'note') AS note_count,
  (SELECT string_agg(DISTINCT tool, ',' ORDER BY tool) FROM findings_v t
    WHERE t.run_id = f.run_id) AS tools_run,
  (SELECT count(DISTINCT tool) FROM findings_v t WHERE t.run_id = f.run_id) AS tool_count
FROM (SELECT DISTINCT run_id FROM findings_v) f LEFT JOIN deduped d ON d.run_id = f.run_id
GROUP BY f.run_id""")
def run_metrics(spark, sf):
    runs = views.findings(spark, sf).select("run_id", "tool").distinct()
    return ops.run_metrics(deduped(spark, sf), runs).withColumn(
        "tools_run", F.array_join("tools_run", ","))


@query("dashboard_metrics", f"""{BASE}, results AS ({TOOL_RESULTS}),
lv AS (SELECT run_id, string_agg(level || '=' || n, ',' ORDER BY level) AS by_severity,
  sum(n)::BIGINT AS total_findings FROM (SELECT run_id, level, count(*) AS n FROM levelled
  GROUP BY ALL) GROUP BY run_id),
tl AS (SELECT run_id, string_agg(tool || '=' || n, ',' ORDER BY tool) AS by_tool FROM
  (SELECT run_id, tool, count(*) AS n FROM levelled GROUP BY ALL) GROUP BY run_id),
fl AS (SELECT run_id, count(DISTINCT file) AS files_affected FROM levelled GROUP BY run_id)
SELECT r.run_id, count(*) AS tools_run, count(*) FILTER (success) AS tools_succeeded,
  count(*) FILTER (NOT success) AS tools_failed, round(sum(duration_seconds), 4) AS duration_seconds,
  any_value(by_severity) AS by_severity, any_value(total_findings) AS total_findings,
  any_value(by_tool) AS by_tool, any_value(files_affected) AS files_affected
FROM results r JOIN lv USING (run_id) JOIN tl USING (run_id) JOIN fl USING (run_id)
GROUP BY r.run_id""")
def dashboard_metrics(spark, sf):
    as_text = lambda c: F.array_join(F.transform(
        F.map_entries(c), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))), ",")
    out = ops.dashboard_metrics(views.flat_findings(spark, sf), views.tool_results(spark, sf))
    return out.withColumns({"by_severity": as_text("by_severity"), "by_tool": as_text("by_tool"),
                            "duration_seconds": F.round("duration_seconds", 4)})


@query("file_nodes", f"""{DEDUP}
SELECT run_id, file AS id, CASE WHEN file LIKE '%test%' OR file LIKE '%spec%' THEN 'test'
    WHEN file LIKE '%.yaml' THEN 'config' WHEN file LIKE '%.md' THEN 'docs' ELSE 'source' END AS type,
  count(*) AS finding_count, CASE max(rank) WHEN 3 THEN 'error' WHEN 2 THEN 'warning'
    WHEN 1 THEN 'note' ELSE 'none' END AS severity_max
FROM deduped GROUP BY ALL""")
def file_nodes(spark, sf):
    return ops.file_nodes(deduped(spark, sf)).drop("place")


@query("artifact_files", f"WITH f AS ({FINDINGS}) SELECT DISTINCT run_id, file AS uri FROM f")
def artifact_files(spark, sf):
    return ops.artifacts(views.findings(spark, sf))


# Tool runs before merging: a report for every 64 events.
TOOL_RUNS = f"""
SELECT run_id, tool, cast(floor(seq / 64) AS bigint) AS doc_idx, 0 AS run_idx,
  CASE cast(floor(seq / 64) AS bigint) % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN ''
    ELSE concat('1.', cast(min(seq) AS string)) END AS version,
  cast(count(*) AS string) AS size
FROM ({FINDINGS}) f GROUP BY run_id, tool, cast(floor(seq / 64) AS bigint)"""


def _tool_runs(spark, sf):
    runs = views._sql(spark, sf, TOOL_RUNS, "events")
    props = F.create_map(F.lit("size"), F.col("size"),
                         F.concat(F.lit("v"), F.col("doc_idx") % 3), F.col("version"))
    return runs.select("run_id", "tool", "doc_idx", "run_idx", "version",
                       F.lit(None).cast("string").alias("extensions"), props.alias("properties"))


@query("merged_runs", f"""WITH runs AS ({TOOL_RUNS}),
props AS (SELECT run_id, tool, doc_idx, 'size' AS k, size AS v FROM runs UNION ALL
  SELECT run_id, tool, doc_idx, 'v' || (doc_idx % 3), version FROM runs),
kept AS (SELECT run_id, tool, k, arg_min(v, doc_idx) AS v FROM props GROUP BY ALL)
SELECT r.run_id, r.tool, coalesce(
    arg_max(version, doc_idx) FILTER (version NOT IN ('', 'unknown')),
    arg_min(version, doc_idx)) AS version,
  (SELECT string_agg(k || '=' || v, ',' ORDER BY k) FROM kept
    WHERE kept.run_id = r.run_id AND kept.tool = r.tool) AS properties,
  dense_rank() OVER (PARTITION BY r.run_id ORDER BY r.tool) - 1 AS merged_idx
FROM runs r GROUP BY r.run_id, r.tool""")
def merged_runs(spark, sf):
    runs = _tool_runs(spark, sf)
    shown = F.array_join(F.transform(F.map_entries("properties"), lambda e: F.concat_ws(
        "=", e["key"], e["value"])), ",")
    return merge.merge_runs(runs).join(merge.merged_run_index(runs), ["run_id", "tool"]).select(
        "run_id", "tool", "version", shown.alias("properties"),
        F.col("merged_idx").cast("bigint").alias("merged_idx"))


@query("merged_rules", f"""WITH f AS ({FINDINGS}),
rules AS (SELECT *, cast(floor(seq / 64) AS bigint) AS doc_idx FROM f),
starts AS (SELECT run_id, tool, min(doc_idx) AS start FROM rules GROUP BY ALL),
ranked AS (SELECT r.*, row_number() OVER (PARTITION BY r.run_id, r.tool, rule_id
    ORDER BY doc_idx, CASE WHEN doc_idx = start THEN -seq ELSE seq END) AS rn
  FROM rules r JOIN starts s ON r.run_id = s.run_id AND r.tool = s.tool)
SELECT run_id, tool, rule_id, message AS description, seq FROM ranked WHERE rn = 1""")
def merged_rules(spark, sf):
    rules = _rules(spark, sf)
    runs = rules.select("run_id", "tool", "doc_idx", "run_idx").distinct()
    return merge.merge_rules(rules, runs).select(
        "run_id", "tool", "rule_id", "description", F.col("rule_idx").alias("seq"))


def _rules(spark, sf):
    return views.raw_findings(spark, sf).select(
        "run_id", F.floor(F.col("seq") / 64).cast("bigint").alias("doc_idx"),
        F.lit(0).alias("run_idx"), F.col("seq").alias("rule_idx"), "tool", "rule_id",
        F.col("rule_id").alias("name"), F.col("message").alias("description"),
        F.lit("warning").alias("level"), F.concat(F.lit("https://x/"), "rule_id").alias("help_uri"))


@query("finding_index", f"""WITH findings_v AS ({FINDINGS})
SELECT run_id, tool, seq, row_number() OVER (PARTITION BY run_id ORDER BY tool, seq) - 1 AS "index"
FROM findings_v""")
def finding_index(spark, sf):
    return ops.global_index(views.findings(spark, sf)).select(
        "run_id", "tool", F.col("result_idx").alias("seq"), "index")


@query("explained_findings", f"""WITH {LEVELLED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tool, seq) - 1 AS "index"
  FROM levelled),
last_rule AS (SELECT run_id, tool, rule_id, max(seq) AS seq FROM findings_v
  GROUP BY ALL),
asked AS (SELECT run_id, count(*) // 2 AS "index" FROM findings_v GROUP BY run_id)
SELECT n.run_id, n."index", n.tool, n.rule_id, n.level, n.message, n.file, n.line,
  coalesce(r.message, '') AS description, 'https://x/' || n.rule_id AS help_uri
FROM numbered n JOIN asked a ON n.run_id = a.run_id AND n."index" = a."index"
LEFT JOIN last_rule l ON l.run_id = n.run_id AND l.tool = n.tool AND l.rule_id = n.rule_id
LEFT JOIN findings_v r ON r.seq = l.seq""")
def explained_findings(spark, sf):
    findings = views.findings(spark, sf)
    # Ask for the middle finding of every run.
    wanted = findings.groupBy("run_id").agg(
        F.floor(F.count(F.lit(1)) / 2).cast("bigint").alias("index"))
    return ops.explain_findings(findings, _rules(spark, sf), wanted)


@query("explanation_texts", f"""WITH {LEVELLED},
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tool, seq) - 1 AS "index"
  FROM levelled),
texts AS (SELECT run_id, tool, rule_id, arg_max(message, seq) AS description FROM findings_v
  GROUP BY ALL)
SELECT n.run_id, n."index", 'Finding #' || n."index" || chr(10) || 'Tool: ' || n.tool || chr(10)
  || 'Rule: ' || n.rule_id || chr(10) || 'Level: ' || level || chr(10) || 'Message: ' || message
  || chr(10) || chr(10) || 'Description: ' || description || chr(10) || 'Reference: https://x/'
  || n.rule_id || chr(10) || chr(10) || 'Location: ' || file || ':' || line || chr(10) AS explanation
FROM numbered n JOIN texts t ON t.run_id = n.run_id AND t.tool = n.tool AND t.rule_id = n.rule_id
WHERE level = 'error'""")
def explanation_texts(spark, sf):
    findings = views.findings(spark, sf)
    wanted = ops.global_index(findings).where("level = 'error'").select("run_id", "index")
    return ops.explanation_text(ops.explain_findings(findings, _rules(spark, sf), wanted))


@query("projected_findings", f"""{BASE}
SELECT run_id, tool, seq, rule_id, level, message, file, line, line AS end_line FROM levelled""")
def projected_findings(spark, sf):
    return views.flat_findings(spark, sf).select(
        "run_id", "tool", F.col("result_idx").alias("seq"), "rule_id", "level", "message", "file",
        "line", "end_line")


@query("findings_by_filters", f"""{BASE}
SELECT tool, seq, rule_id, level, file, line, message FROM levelled
WHERE run_id = 'run-1' AND tool = 'bandit' AND level = 'warning' AND contains(file, '_test')
ORDER BY seq LIMIT 50""")
def findings_by_filters(spark, sf):
    return ops.query_findings(
        views.flat_findings(spark, sf), "run-1", "warning", "bandit", "_test", 50).select(
        "tool", F.col("result_idx").alias("seq"), "rule_id", "level", "file", "line", "message")


@query("findings_of_one_level", f"""{BASE}
SELECT run_id, tool, seq, rule_id, message FROM levelled WHERE level = 'error'""")
def findings_of_one_level(spark, sf):
    return ops.findings_with_severity(views.findings(spark, sf), "error").select(
        "run_id", "tool", F.col("result_idx").alias("seq"), "rule_id", "message")


@query("report_view", f"""{BASE},
numbered AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY tool, seq) - 1 AS "index"
  FROM levelled)
SELECT run_id, "index", tool, rule_id, message, level AS severity, file, line AS start_line,
  line AS end_line FROM numbered WHERE level = 'note' AND contains(lower(file), 'm3/f')""")
def report_view(spark, sf):
    indexed = ops.global_index(views.flat_findings(spark, sf))
    return ops.filter_view(ops.view_projection(indexed), severity="note", file="M3/F").drop(
        "snippet", "fingerprint")


@query("findings_by_severity", f"""{BASE}
SELECT run_id, tool, seq, level, rule_id FROM levelled""")
def findings_by_severity(spark, sf):
    return ops.sort_by_severity(views.flat_findings(spark, sf)).select(
        "run_id", "tool", F.col("result_idx").alias("seq"), "level", "rule_id")


@query("findings_page", f"""{BASE}
SELECT run_id, tool, seq, rule_id, file FROM levelled ORDER BY file DESC, seq LIMIT 20 OFFSET 40""")
def findings_page(spark, sf):
    return ops.page_of(views.flat_findings(spark, sf), 2, [F.desc("file"), "result_idx"]).select(
        "run_id", "tool", F.col("result_idx").alias("seq"), "rule_id", "file")


@query("tool_breakdown", f"""WITH f AS ({FINDINGS}), r AS ({TOOL_RESULTS})
SELECT f.run_id, f.tool, count(*) AS findings, coalesce(any_value(success), true) AS success,
  any_value(duration_seconds) AS duration_seconds
FROM f LEFT JOIN r ON r.run_id = f.run_id AND r.tool = f.tool AND r.success GROUP BY ALL""")
def tool_breakdown(spark, sf):
    known = views.tool_results(spark, sf).where("success")
    return ops.tool_breakdown(views.findings(spark, sf), known)


@query("tool_run_totals", f"""WITH r AS ({TOOL_RESULTS})
SELECT run_id, count(*) FILTER (success) AS succeeded, count(*) FILTER (NOT success) AS failed,
  coalesce(string_agg(tool || ': ' || error, ';' ORDER BY tool) FILTER (NOT success), '') AS errors
FROM r GROUP BY run_id""")
def tool_run_totals(spark, sf):
    return ops.tool_run_totals(views.tool_results(spark, sf)).withColumn(
        "errors", F.array_join("errors", ";"))


@query("top_findings_per_level", f"""{DEDUP},
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, level ORDER BY tool, seq) AS position,
  count(*) OVER (PARTITION BY run_id, level) AS level_total FROM deduped)
SELECT run_id, level, position::INT AS position, seq, level_total,
  greatest(level_total - 20, 0) AS remaining
FROM ranked WHERE position <= 20""")
def top_findings_per_level(spark, sf):
    return ops.top_per_level(ops.project_findings(deduped(spark, sf))).select(
        "run_id", "level", "position", F.col("result_idx").alias("seq"), "level_total", "remaining")


@query("runs_with_findings", f"""{BASE}
SELECT run_id FROM levelled GROUP BY run_id HAVING count(*) FILTER (level = 'error') > 0""")
def runs_with_findings(spark, sf):
    findings = views.findings(spark, sf)
    return ops.runs_with_findings(findings, ops.findings_with_severity(findings, "error"))


@query("unified_sarif", f"""{DEDUP},
tools AS (SELECT DISTINCT run_id, tool FROM findings_v),
rules AS (SELECT run_id, tool, rule_id, min(seq) AS seq FROM findings_v GROUP BY ALL),
files AS (SELECT DISTINCT run_id, file FROM findings_v),
lines AS (
  SELECT run_id, 0 AS section, '' AS tool, '{{"$schema":"https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/sarif-2.1/schema/sarif-schema-2.1.0.json","version":"2.1.0","runs":[' AS text
  FROM (SELECT DISTINCT run_id FROM tools)
  UNION ALL SELECT run_id, 9, '', ']}}' FROM (SELECT DISTINCT run_id FROM tools)
  UNION ALL SELECT run_id, 0, tool, CASE WHEN tool = min(tool) OVER (PARTITION BY run_id) THEN ''
    ELSE ',' END || '{{"tool":{{"driver":{{"name":"' || tool || '","version":"unknown","rules":['
    FROM tools
  UNION ALL SELECT run_id, 1, tool, CASE WHEN seq = min(seq) OVER (PARTITION BY run_id, tool)
    THEN '' ELSE ',' END || '{{"id":"' || rule_id || '","name":"' || rule_id
    || '","defaultConfiguration":{{"level":"warning"}}}}' FROM rules
  UNION ALL SELECT run_id, 1, tool, ']}}}},"results":[' FROM tools
  UNION ALL SELECT run_id, 2, tool, CASE WHEN seq = min(seq) OVER (PARTITION BY run_id, tool)
    THEN '' ELSE ',' END || '{{"ruleId":"' || rule_id || '","level":"' || level
    || '","message":{{"text":' || to_json(message)::VARCHAR
    || '}},"locations":[{{"physicalLocation":{{"artifactLocation":{{"uri":"' || file
    || '"}},"region":{{"startLine":' || line || '}}}}}}]}}' FROM deduped
  UNION ALL SELECT f.run_id, 3, t.tool, CASE WHEN file = min(file) OVER (PARTITION BY f.run_id)
    THEN '],"artifacts":[' ELSE ',' END || '{{"location":{{"uri":"' || file || '"}}}}'
    FROM files f JOIN tools t ON t.run_id = f.run_id
  UNION ALL SELECT run_id, 4, tool, ']}}' FROM tools)
SELECT run_id, section, tool, text FROM lines""")
def unified_sarif(spark, sf):
    findings = deduped(spark, sf)
    every = views.findings(spark, sf)
    merged = every.select("run_id", "tool").distinct().select(
        "run_id", "tool", F.lit("unknown").alias("version"),
        F.lit(None).cast("string").alias("extensions"),
        F.lit(None).cast(PROPERTIES).alias("properties"))
    rules = every.groupBy("run_id", "tool", "rule_id").agg(F.min("result_idx").alias("rule_idx"))
    rules = rules.select(
        "run_id", "tool", "rule_id", "rule_idx", F.lit(0).cast("bigint").alias("doc_idx"),
        F.lit(0).alias("run_idx"), F.col("rule_id").alias("name"), F.lit("").alias("description"),
        F.lit("warning").alias("level"))
    out = sarif.unified_document(findings, rules, merged, ops.artifacts(every))
    last = F.col("tool") == "\U0010ffff"
    return out.select("run_id", F.when(last, 9).otherwise(F.col("section")).alias("section"),
                      F.when(last, "").otherwise(F.col("tool")).alias("tool"), "text")


# Scale runs: a line item is a finding, its supplier the tool and its part the file.
LINE_FINDINGS = """
SELECT concat('run-', cast(l_orderkey % 3 AS string)) AS run_id,
  concat('tool-', cast(l_suppkey % 20 AS string)) AS tool,
  l_orderkey * 8 + l_linenumber AS seq, concat('R', cast(l_linenumber AS string)) AS rule_id,
  CASE l_returnflag WHEN 'R' THEN 'error' WHEN 'A' THEN 'warning' ELSE 'note' END AS level,
  concat('p', cast(l_partkey % 997 AS string)) AS file, l_linenumber AS line,
  concat('Status ', l_linestatus) AS message
FROM lineitem"""


def line_findings(spark, sf):
    raw = views._sql(spark, sf, LINE_FINDINGS, "lineitem")
    return raw.select(
        "run_id", F.lit(0).cast("bigint").alias("doc_idx"), F.lit(0).alias("run_idx"),
        F.col("seq").alias("result_idx"), "tool", "rule_id", "level", "message",
        one_location(F.col("file"), F.col("line")).alias("locations"),
        F.lit(None).cast("map<string,string>").alias("fingerprints"),
        F.lit(None).cast(PROPERTIES).alias("properties"))


@query("line_item_metrics", f"""WITH f AS ({LINE_FINDINGS}),
ranked AS (SELECT *, row_number() OVER (PARTITION BY run_id, file, line, rule_id, message ORDER BY
  CASE level WHEN 'error' THEN 0 WHEN 'warning' THEN 1 ELSE 2 END, tool, seq) AS rn FROM f)
SELECT run_id, tool, level, count(*) AS findings FROM ranked WHERE rn = 1 GROUP BY ALL""")
def line_item_metrics(spark, sf):
    marked = ops.with_fingerprint(line_findings(spark, sf))
    return ops.severity_counts(ops.deduplicate(marked))


@query("line_item_index", f"""WITH f AS ({LINE_FINDINGS})
SELECT run_id, seq, row_number() OVER (PARTITION BY run_id ORDER BY tool, seq) - 1 AS "index" FROM f""")
def line_item_index(spark, sf):
    return ops.global_index(line_findings(spark, sf)).select(
        "run_id", F.col("result_idx").alias("seq"), "index")
