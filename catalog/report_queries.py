"""Converters over reports that Spark builds from the events table.

Every report holds the findings of one run whose number falls into one block of 32, so the
number of reports grows with the table. The SQL never sees the reports: it states the expected
findings straight from the events.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F

from catalog import views
from catalog.registry import query
from catalog.views import FINDINGS
from repograph import normalize
from repograph.functions import text
from repograph.model import one_location
from repograph.operators.findings import global_index
from repograph.sources import reports as reports_on_disk
from repograph.stage import stage_folder

BASE = f"""WITH findings_v AS ({FINDINGS}),
base AS (SELECT *, cast(floor(seq / 32) AS bigint) AS doc_idx, split_part(rule_id, '/', -1) AS kind,
  row_number() OVER (PARTITION BY run_id, floor(seq / 32) ORDER BY seq) - 1 AS pos,
  seq % 9 AS col FROM findings_v)
"""
COLUMNS = ["run_id", "doc_idx", "result_idx", "rule_id", "level", "message", "file", "start_line",
           "start_col", "end_line", "end_col", "fp", "props"]


def _expected(rule, level, message, where="true", file="file", start_line="line", start_col="NULL",
              end_line="NULL", end_col="NULL", fp="NULL", props="''", idx="pos"):
    values = [("run_id", "run_id"), ("doc_idx", "doc_idx"), ("result_idx", f"({idx})::BIGINT"),
              ("rule_id", rule), ("level", level), ("message", message),
              ("file", f"({file})::VARCHAR"), ("start_line", f"({start_line})::INT"),
              ("start_col", f"({start_col})::INT"), ("end_line", f"({end_line})::INT"),
              ("end_col", f"({end_col})::INT"), ("fp", f"({fp})::VARCHAR"), ("props", props)]
    return BASE + "SELECT " + ", ".join(f"{v} AS {n}" for n, v in values) + f" FROM base WHERE {where}"


def base(spark, sf) -> DataFrame:
    return views.raw_findings(spark, sf).select(
        "*", F.floor(F.col("seq") / 32).cast("bigint").alias("doc_idx"),
        F.element_at(F.split("rule_id", "/"), -1).alias("kind"), (F.col("seq") % 9).alias("col"))


def reports(df: DataFrame, tool: str, item, prefix="", suffix="", separator="\n") -> DataFrame:
    """One report per (run, block); at most 32 items are gathered per report."""
    items = F.array_sort(F.collect_list(F.struct("seq", item.alias("text"))))
    body = F.array_join(F.transform(items, lambda x: x["text"]), separator)
    return df.groupBy("run_id", "doc_idx").agg(
        F.concat(F.lit(prefix), body, F.lit(suffix)).alias("raw")).withColumn("tool", F.lit(tool))


def flatten(findings: DataFrame) -> DataFrame:
    place = F.get("locations", F.lit(0))
    shown = F.transform_values("properties", lambda k, v: v.cast("string"))
    entries = F.transform(F.array_sort(F.map_entries(shown)), lambda e: F.concat_ws(
        "=", e["key"], e["value"]))
    return findings.select(
        "run_id", "doc_idx", "result_idx", "rule_id", "level", "message",
        place["uri"].alias("file"), *[place[c].alias(c) for c in (
            "start_line", "start_col", "end_line", "end_col")],
        F.get(F.map_values("fingerprints"), F.lit(0)).alias("fp"),
        F.coalesce(F.array_join(entries, ","), F.lit("")).alias("props"))


def converted(df: DataFrame, tool: str, item, **shape) -> DataFrame:
    return flatten(normalize.normalise(reports(df, tool, item, **shape), tools=[tool]).findings)


def obj(**fields):
    return F.struct(*[c.alias(n) for n, c in fields.items()])


c = F.col
unless = lambda kind, col: F.when(c("kind") != kind, col)
LEVEL_WORD = ("CASE native_severity WHEN 'HIGH' THEN 'error' WHEN 'Medium' THEN 'warning' "
              "WHEN ' low ' THEN 'note' WHEN 'unknown' THEN 'none' ELSE 'warning' END")


@query("converted_pyright", _expected(
    "CASE WHEN kind = 'view' THEN 'pyright-diagnostic' ELSE rule_id END", LEVEL_WORD, "message",
    "kind <> 'signup'", start_line="line + 1", start_col="col + 1", end_line="line + 2",
    end_col="CASE WHEN kind = 'click' THEN 1 ELSE col + 4 END"))
def converted_pyright(spark, sf):
    point = lambda line, col: obj(line=line, character=col)
    item = F.to_json(obj(
        file=unless("signup", c("file")), severity=c("native_severity"), message=c("message"),
        rule=unless("view", c("rule_id")),
        range=obj(start=point(c("line"), c("col")),
                  end=point(c("line") + 1, unless("click", c("col") + 3)))))
    return converted(base(spark, sf), "pyright", item, prefix='{"generalDiagnostics":[',
                     suffix="]}", separator=",")


@query("converted_horusec", _expected(
    "'horusec/gosec' || CASE WHEN kind = 'error' THEN '' ELSE '/' || left(md5(message), 12) END",
    LEVEL_WORD, "CASE WHEN kind = 'click' THEN 'Vulnerability detected by GoSec' ELSE message END",
    "kind <> 'signup'", start_line="CASE WHEN col = 0 THEN 1 ELSE line END",
    start_col="CASE WHEN col < 1 THEN NULL ELSE col END",
    fp="sha256(CASE WHEN kind = 'error' THEN file || ':' || CASE WHEN col = 0 THEN 1 ELSE line END "
       "|| ':' || message ELSE md5(message) END)",
    props="'language=' || tool || ',securityTool=GoSec'"))
def converted_horusec(spark, sf):
    vuln = obj(vulnHash=unless("error", F.md5("message")), severity=c("native_severity"),
               line=F.when(c("col") == 0, "x").otherwise(c("line").cast("string")),
               column=c("col").cast("string"), file=c("file"),
               details=unless("click", c("message")), securityTool=F.lit("GoSec"),
               language=c("tool"))
    item = F.to_json(obj(vulnerabilities=F.when(~c("kind").isin("view", "signup"), vuln),
                         vulnerability=F.when(c("kind") == "view", vuln)))
    return converted(base(spark, sf), "horusec", item, suffix="]}", separator=",",
                     prefix='{"version":"2","analysisVulnerabilities":[')


@query("converted_cargo_audit", _expected(
    "'cargo-audit/' || CASE WHEN kind = 'view' THEN 'UNKNOWN' ELSE kind END", "'error'",
    """CASE WHEN kind = 'view' THEN 'UNKNOWN' ELSE kind END || ': ' || message || ' in ' || tool
    || '@' || line || ' (patched: ' || CASE col % 3 WHEN 0 THEN 'none' WHEN 1 THEN '>=1'
    ELSE '>=1, >=2' END || ')' || CASE WHEN kind = 'click' THEN '' ELSE ' -- https://x/' || seq END""",
    file="NULL", start_line="NULL",
    props="""'advisory_url=' || CASE WHEN kind = 'click' THEN '' ELSE 'https://x/' || seq END
    || ',package=' || tool || ',version=' || line"""))
def converted_cargo_audit(spark, sf):
    patched = F.slice(F.array(F.lit(">=1"), F.lit(">=2")), F.lit(1), (c("col") % 3).cast("int"))
    item = F.to_json(obj(
        advisory=obj(id=unless("view", c("kind")), title=c("message"), url=unless(
            "click", F.concat(F.lit("https://x/"), c("seq")))),
        package=obj(name=c("tool"), version=c("line").cast("string")),
        versions=obj(patched=patched)))
    return converted(base(spark, sf), "cargo-audit", item, prefix='{"vulnerabilities":{"list":[',
                     suffix="]}}", separator=",")


@query("converted_shellcheck", _expected(
    "'SC' || (2000 + seq % 50)", LEVEL_WORD, "message", "kind <> 'signup'",
    start_line="greatest(line - 2, 1)", start_col="greatest(col, 1)",
    end_line="greatest(CASE WHEN kind = 'view' THEN line - 2 ELSE line END, 1)",
    end_col="greatest(col, 1)"))
def converted_shellcheck(spark, sf):
    item = F.to_json(obj(
        file=unless("signup", c("file")), line=c("line") - 2, column=c("col"),
        endLine=unless("view", c("line")), level=c("native_severity"),
        code=F.lit(2000) + c("seq") % 50, message=c("message")))
    return converted(base(spark, sf), "shellcheck", item, prefix="[", suffix="]", separator=",")


@query("converted_cargo_udeps", BASE + """
SELECT run_id, doc_idx, 'cargo-udeps/unused-dependency' AS rule_id, 'warning' AS level,
  'Unused ' || k || ' dependency ''' || CASE k WHEN 'normal' THEN tool ELSE kind END
  || ''' in crate ''c' || seq || '''' || CASE WHEN kind = 'view' THEN '' ELSE ' (' || file || ')' END
  AS message, 'crate=c' || seq || ',dependency=' || CASE k WHEN 'normal' THEN tool ELSE kind END
  || ',kind=' || k AS props
FROM base, (SELECT unnest(['normal', 'development']) AS k)""")
def converted_cargo_udeps(spark, sf):
    body = F.to_json(obj(
        manifest_path=unless("view", c("file")), normal=F.array(c("tool")),
        development=F.array(obj(name=c("kind"))), build=F.array().cast("array<string>")))
    item = F.concat(F.lit('"c'), c("seq"), F.lit('":'), body)
    return converted(base(spark, sf), "cargo-udeps", item, prefix='{"unused_deps":{', suffix="}}",
                     separator=",").select("run_id", "doc_idx", "rule_id", "level", "message",
                                           "props")


_CC = "(seq % 25)"
_LIZARD_MESSAGE = f"""'Function ''' || kind || ''' has cyclomatic complexity ' || {_CC}
  || ' (threshold 10) [NLOC=' || (line * 7) || ', tokens=' || seq || ', params=' || col || ']'"""
_LIZARD_PROPS = f"'cyclomaticComplexity=' || {_CC} || ',functionName=' || kind"


@query("converted_lizard_csv", _expected(
    "'lizard/high-cyclomatic-complexity'", "'warning'", _LIZARD_MESSAGE, f"{_CC} > 10",
    end_line="line + 30", props=_LIZARD_PROPS, idx="pos + CASE WHEN doc_idx % 2 = 0 THEN 1 ELSE 0 END"))
def converted_lizard_csv(spark, sf):
    cell = lambda x: x.cast("string")
    item = F.concat_ws(",", cell(c("line") * 7), cell(c("seq") % 25), cell(c("seq")),
                       cell(c("col")), F.lit("9"), F.lit('"a,b"'), c("file"), c("kind"),
                       cell(c("line")), cell(c("line") + 30))
    # Every second report has a header row.
    csv = reports(base(spark, sf), "lizard", item).withColumn("raw", F.when(
        c("doc_idx") % 2 == 0, F.concat(F.lit(
            "NLOC,CCN,token,PARAM,length,location,file,function,start,end\n"), c("raw")))
        .otherwise(c("raw")))
    return flatten(normalize.normalise(csv, tools=["lizard"]).findings)


@query("converted_lizard_json", _expected(
    "'lizard/high-cyclomatic-complexity'", "'warning'", _LIZARD_MESSAGE, f"{_CC} > 10",
    end_line="line + 30", props=_LIZARD_PROPS, idx="pos * 4294967296"))
def converted_lizard_json(spark, sf):
    function = obj(name=c("kind"), cyclomatic_complexity=c("seq") % 25, nloc=c("line") * 7,
                   token_count=c("seq"), parameter_count=c("col"), start_line=c("line"),
                   end_line=c("line") + 30)
    item = F.to_json(obj(filename=c("file"), function_list=F.array(function)))
    return converted(base(spark, sf), "lizard", item, prefix="[", suffix="]", separator=",")


@query("converted_trufflehog", _expected(
    "'trufflehog/' || kind", "CASE WHEN col = 3 THEN 'error' ELSE 'warning' END",
    """CASE WHEN col = 3 THEN 'VERIFIED' ELSE 'unverified' END || ' secret detected by ' || kind
    || ': ' || CASE WHEN kind = 'click' THEN '****' ELSE left(message, 4) || '****' END""",
    "kind <> 'signup'", start_line="CASE WHEN kind = 'view' THEN 1 ELSE line END",
    fp="sha256(kind || ':' || file || ':' || sha256(CASE WHEN kind = 'click' THEN 'abcd' "
       "ELSE message END))",
    props="'detector=' || kind || ',verified=' || CASE WHEN col = 3 THEN 'true' ELSE 'false' END"))
def converted_trufflehog(spark, sf):
    git = c("kind") == "error"
    place = obj(file=c("file"), line=F.when(c("kind") == "view", 0).otherwise(c("line")))
    item = F.to_json(obj(
        DetectorName=c("kind"), Verified=c("col") == 3,
        Raw=F.when(c("kind") == "click", "abcd").otherwise(c("message")),
        SourceMetadata=obj(Data=obj(Filesystem=F.when(~git, place), Git=F.when(git, place)))))
    return converted(base(spark, sf), "trufflehog",
                     F.when(c("kind") == "signup", "scanning ...").otherwise(item))


@query("converted_clippy", _expected(
    "'clippy/' || CASE WHEN kind = 'view' THEN 'clippy-diagnostic' ELSE 'clippy::' || kind END",
    "CASE col % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'warning' ELSE 'error' END", "message",
    "kind <> 'signup' AND NOT (kind = 'view' AND col % 3 = 0)",
    start_col="col", end_line="line + 1", end_col="col + 2"))
def converted_clippy(spark, sf):
    span = lambda primary, name: obj(
        is_primary=primary, file_name=name, line_start=c("line"), line_end=c("line") + 1,
        column_start=c("col"), column_end=c("col") + 2)
    first = c("kind") == "click"
    spans = F.array(span(F.lit(False), F.when(first, c("file")).otherwise("other.rs")),
                    span(~first, F.when(first, "other.rs").otherwise(c("file"))))
    words = F.element_at(F.array(*[F.lit(x) for x in ("note", "warning", "error")]),
                         (c("col") % 3 + 1).cast("int"))
    item = F.to_json(obj(
        reason=F.when(c("kind") == "signup", "build-script").otherwise("compiler-message"),
        message=obj(level=words, message=c("message"), spans=spans, code=F.when(
            c("kind") != "view", obj(code=F.concat(F.lit("clippy::"), c("kind")))))))
    return converted(base(spark, sf), "clippy", item)


@query("converted_cargo_deny", _expected(
    "'cargo-deny/' || CASE WHEN kind = 'view' THEN 'diagnostic' ELSE kind END", LEVEL_WORD, "message",
    "kind <> 'signup'", file="CASE WHEN col = 5 THEN NULL ELSE file END",
    start_line="CASE WHEN col = 5 THEN NULL ELSE line END"))
def converted_cargo_deny(spark, sf):
    span = lambda name: obj(span=obj(file=name, line_start=c("line")))
    labels = F.array(span(F.lit(None).cast("string")), span(F.when(c("col") != 5, c("file"))))
    code = F.when(c("kind") != "view", c("kind"))
    wrapped = F.to_json(obj(fields=obj(
        severity=c("native_severity"), message=unless("signup", c("message")), code=code,
        labels=labels)))
    bare = F.to_json(obj(level=c("native_severity"), message=unless("signup", c("message")),
                         code=F.when(code.isNotNull(), obj(code=code)), labels=labels))
    return converted(base(spark, sf), "cargo-deny",
                     F.when(c("col") % 2 == 0, wrapped).otherwise(bare))


@query("converted_deptrac", _expected(
    "'deptrac/forbidden-dependency'", "'warning'",
    """CASE kind WHEN 'view' THEN 'App must not depend on ' || tool
    ELSE 'A must not depend on ' || tool || ' (L' || col || ' -> L' || line || ')' END""",
    "kind <> 'signup'", file="CASE WHEN kind = 'view' THEN NULL ELSE file END",
    start_line="CASE kind WHEN 'view' THEN NULL WHEN 'click' THEN 1 ELSE line END",
    fp="""sha256(CASE kind WHEN 'view' THEN ':1:App must not depend on ' || tool ELSE file || ':'
    || CASE kind WHEN 'click' THEN 1 ELSE line END || ':A must not depend on ' || tool || ' (L' || col
    || ' -> L' || line || ')' END)""",
    props="""CASE kind WHEN 'view' THEN '' ELSE 'sourceLayer=L' || col || ',targetLayer=L' || line
    END"""))
def converted_deptrac(spark, sf):
    rest = F.concat(F.lit("A must not depend on "), c("tool"), F.lit(" (L"), c("col"),
                    F.lit(" -> L"), c("line"), F.lit(")"))
    item = (F.when(c("kind") == "signup", "-- summary --")
            .when(c("kind") == "view", F.concat(F.lit("App must not depend on "), c("tool")))
            .when(c("kind") == "click", F.concat(c("file"), F.lit("::"), rest))
            .otherwise(F.concat(F.lit("  "), c("file"), F.lit(":"), c("line"), F.lit(" - "), rest)))
    return converted(base(spark, sf), "deptrac", item)


@query("converted_taplo", _expected(
    "'taplo/' || kind", "CASE col % 3 WHEN 0 THEN 'note' WHEN 1 THEN 'warning' ELSE 'error' END",
    "message", file="CASE WHEN kind = 'view' THEN NULL ELSE file END", idx="pos * 2",
    start_line="CASE WHEN kind = 'view' THEN NULL ELSE line END",
    start_col="CASE WHEN kind = 'view' THEN NULL ELSE col END"))
def converted_taplo(spark, sf):
    word = F.element_at(F.array(*[F.lit(x) for x in ("info", "warning", "error")]),
                        (c("col") % 3 + 1).cast("int"))
    item = F.concat(word, F.lit("["), c("kind"), F.lit("]: "), c("message"), F.lit("\n"),
                    F.when(c("kind") == "view", "").otherwise(F.concat_ws(
                        ":", F.concat(F.lit("  --> "), c("file")), c("line"), c("col"))))
    return converted(base(spark, sf), "taplo", item)


@query("converted_chktex", _expected(
    "'chktex/W' || CASE WHEN kind = 'view' THEN 0 ELSE col END",
    "CASE WHEN kind = 'error' THEN 'error' ELSE 'warning' END", "message", "kind <> 'signup'",
    start_col="col"))
def converted_chktex(spark, sf):
    head = F.concat(c("file"), F.lit(":"), c("line"), F.lit(":"), c("col"), F.lit(": "),
                    F.when(c("kind") == "error", "Error").otherwise("Warning"), F.lit(": "),
                    c("message"))
    item = (F.when(c("kind") == "signup", "no line shape").when(c("kind") == "view", head)
            .otherwise(F.concat(head, F.lit(" (Warning "), c("col"), F.lit(")."))))
    return converted(base(spark, sf), "chktex", item)


@query("converted_lacheck", _expected("'lacheck/warning'", "'warning'", "message",
                                      "kind <> 'signup'"))
def converted_lacheck(spark, sf):
    item = F.when(c("kind") == "signup", "** done").otherwise(F.concat(
        F.lit('"'), c("file"), F.lit('", line '), c("line"), F.lit(": "), c("message")))
    return converted(base(spark, sf), "lacheck", item, separator="\r\n")


@query("converted_phpcs", _expected(
    "CASE WHEN kind = 'view' THEN 'phpcs/unknown-rule' ELSE rule_id END",
    "CASE WHEN col % 2 = 0 THEN 'error' ELSE 'warning' END", "message",
    start_line="CASE WHEN kind = 'click' THEN 1 ELSE line END", start_col="col",
    idx="pos * 4294967296"))
def converted_phpcs(spark, sf):
    escaped = F.replace(c("message"), F.lit('"'), F.lit("&quot;"))
    attribute = lambda n, v: F.concat(F.lit(f' {n}="'), v, F.lit('"'))
    tag = F.when(c("col") % 2 == 0, "error").otherwise("warning")
    item = F.concat(
        F.lit("<file"), attribute("name", c("file")), F.lit("><"), tag,
        F.when(c("kind") == "click", "").otherwise(attribute("line", c("line"))),
        attribute("column", c("col")), attribute("message", escaped),
        F.when(c("kind") == "view", "").otherwise(attribute("source", c("rule_id"))),
        F.lit("/></file>"))
    return converted(base(spark, sf), "phpcs", item, prefix='<checkstyle version="3">',
                     suffix="</checkstyle>", separator="")


def _sarif_reports(df: DataFrame, tool: str) -> DataFrame:
    place = obj(physicalLocation=obj(artifactLocation=obj(uri=c("file")),
                                     region=obj(startLine=c("line"))))
    item = F.to_json(obj(
        ruleId=c("rule_id"), level=unless("view", F.lit("error")), message=obj(text=c("message")),
        locations=F.array(place), fingerprints=F.when(
            c("kind") == "click", obj(z=c("seq").cast("string"), a=F.lit("x")))))
    return reports(df, tool, item, suffix="]}]}", separator=",", prefix=(
        '{"runs":[{"tool":{"driver":{"name":"native"}}},'
        '{"tool":{"driver":{"name":"native","version":"3"}},"results":['))


@query("converted_sarif", _expected(
    "rule_id", "CASE WHEN kind = 'view' THEN NULL ELSE 'error' END", "message",
    fp="CASE WHEN kind = 'click' THEN seq::VARCHAR END"))
def converted_sarif(spark, sf):
    raw = _sarif_reports(base(spark, sf), "semgrep")
    return flatten(normalize.normalise(raw, tools=["semgrep"]).findings)


@query("sarif_run_properties", BASE + """
SELECT run_id, doc_idx, run_idx, CASE run_idx WHEN 0 THEN 'unknown' ELSE '3' END AS version,
  '{"converter":"passthrough","originalTool":"trivy","category":"sca","processedAt":"now"}' AS stamp
FROM (SELECT DISTINCT run_id, doc_idx FROM base), (SELECT unnest([0, 1])::INT AS run_idx)""")
def sarif_run_properties(spark, sf):
    raw = _sarif_reports(base(spark, sf), "trivy")
    runs = normalize.normalise(raw, tools=["trivy"], processed_at="now").runs
    own = F.element_at("properties", F.lit("normalizer"))
    stamp = F.struct(*[F.variant_get(own, f"$.{k}", "string").alias(k) for k in (
        "converter", "originalTool", "category", "processedAt")])
    return runs.select("run_id", "doc_idx", "run_idx", "version", F.to_json(stamp).alias("stamp"))


@query("rejected_reports", BASE + """
SELECT run_id, doc_idx, CASE doc_idx % 6 WHEN 0 THEN 'not JSON' WHEN 1 THEN 'unsupported version'
  WHEN 2 THEN 'no runs' WHEN 3 THEN 'run without tool.driver.name'
  WHEN 4 THEN 'no converter for this format' END AS reason
FROM (SELECT DISTINCT run_id, doc_idx FROM base) WHERE doc_idx % 6 < 5""")
def rejected_reports(spark, sf):
    good = _sarif_reports(base(spark, sf), "semgrep")
    kind = c("doc_idx") % 6
    broken = good.withColumn("raw", F.when(kind == 0, F.concat(F.lit("oops "), "raw")).when(
        kind == 1, F.regexp_replace("raw", r"^\{", '{"version":"2.0.0",')).when(
        kind == 2, '{"runs":[]}').when(kind == 3, F.replace(
            c("raw"), F.lit('"name":"native"'), F.lit('"title":"n"'))).otherwise(
        c("raw"))).withColumn("tool", F.when(kind == 4, "detect-secrets").otherwise("semgrep"))
    return normalize.normalise(broken, tools=["semgrep", "detect-secrets"]).rejects.select(
        "run_id", "doc_idx", "reason")


@query("rule_catalogue", BASE + """
SELECT run_id, doc_idx, 'chktex/W' || code AS rule_id, 'chktex warning ' || code AS name,
  'chktex Warning ' || code AS description, arg_min(level, pos) AS level
FROM (SELECT *, CASE WHEN kind = 'view' THEN 0 ELSE col END AS code,
    CASE WHEN kind = 'error' THEN 'error' ELSE 'warning' END AS level FROM base
  WHERE kind <> 'signup' AND doc_idx % 5 <> 0) GROUP BY ALL
UNION ALL
SELECT DISTINCT run_id, doc_idx, 'chktex/W0', 'chktex warning', 'Generic chktex warning', 'warning'
FROM base WHERE doc_idx % 5 = 0""")
def rule_catalogue(spark, sf):
    head = F.concat(c("file"), F.lit(":"), c("line"), F.lit(":"), c("col"), F.lit(": "),
                    F.when(c("kind") == "error", "Error").otherwise("Warning"), F.lit(": "),
                    c("message"))
    item = (F.when((c("kind") == "signup") | (c("doc_idx") % 5 == 0), "no line shape")
            .when(c("kind") == "view", head)
            .otherwise(F.concat(head, F.lit(" (Warning "), c("col"), F.lit(")."))))
    raw = reports(base(spark, sf), "chktex", item)
    return normalize.normalise(raw, tools=["chktex"]).rules.select(
        "run_id", "doc_idx", "rule_id", "name", "description", "level")


def mixed_reports(spark, sf) -> DataFrame:
    """Reports of three formats: each event goes to the report of its own tool."""
    df = base(spark, sf)
    pyright = reports(df.where("tool = 'pyright'"), "pyright", F.to_json(obj(
        file=c("file"), severity=c("native_severity"), message=c("message"), rule=c("kind"),
        range=obj(start=obj(line=c("line") - 1)))), '{"generalDiagnostics":[', "]}", ",")
    lacheck = reports(df.where("tool = 'clippy'"), "lacheck", F.concat(
        F.lit('"'), c("file"), F.lit('", line '), c("line"), F.lit(": "), c("message")))
    native = _sarif_reports(df.where("tool NOT IN ('pyright', 'clippy')"), "semgrep")
    return pyright.unionByName(lacheck).unionByName(native)


MIXED_FINDINGS = BASE + """, mixed AS (
SELECT seq, run_id, CASE tool WHEN 'pyright' THEN 'pyright' WHEN 'clippy' THEN 'lacheck'
    ELSE 'native' END AS tool, file, line, message, CASE tool WHEN 'pyright' THEN kind
    WHEN 'clippy' THEN 'warning' ELSE CASE WHEN strpos(rule_id, '/') > 0
    THEN split_part(rule_id, '/', 2) ELSE rule_id END END AS rule_key,
  CASE WHEN tool = 'pyright' THEN CASE native_severity WHEN 'HIGH' THEN 'error' WHEN ' low ' THEN
    'note' WHEN 'unknown' THEN 'none' ELSE 'warning' END WHEN tool = 'clippy' OR kind = 'view' THEN
    'warning' ELSE 'error' END AS level,
  CASE WHEN tool NOT IN ('pyright', 'clippy') AND kind = 'click' THEN seq::VARCHAR END AS own_fp
FROM base),
keyed AS (SELECT *, coalesce(own_fp, concat_ws('|', file, line, rule_key, regexp_replace(
  regexp_replace(regexp_replace(lower(message), '\\b[0-9a-f]{8,}\\b', '<hash>', 'g'),
  '"[^"]*"', '<str>', 'g'), '\\s+', ' ', 'g'))) AS fp FROM mixed),
kept AS (SELECT *, row_number() OVER (PARTITION BY run_id, fp ORDER BY CASE level WHEN 'error' THEN 0
  WHEN 'warning' THEN 1 WHEN 'note' THEN 2 ELSE 3 END, tool, seq) AS rn FROM keyed)"""


@query("analysis_metrics", MIXED_FINDINGS + """
SELECT run_id, count(*) AS total_findings, count(*) FILTER (level = 'error') AS error_count,
  count(*) FILTER (level = 'warning') AS warning_count,
  count(*) FILTER (level = 'note') AS note_count, 'lacheck,native,pyright' AS tools_run,
  3::BIGINT AS tool_count
FROM kept WHERE rn = 1 GROUP BY run_id""")
def analysis_metrics(spark, sf):
    from repograph.plans.analysis import analyse
    out = analyse(mixed_reports(spark, sf), tools=["pyright", "lacheck", "semgrep"])
    return out.metrics.withColumn("tools_run", F.array_join("tools_run", ","))


@query("analysis_findings", MIXED_FINDINGS + """
SELECT run_id, tool, level, file, line, message FROM kept WHERE rn = 1""")
def analysis_findings(spark, sf):
    from repograph.plans.analysis import analyse
    place = F.get("locations", F.lit(0))
    out = analyse(mixed_reports(spark, sf), tools=["pyright", "lacheck", "semgrep"]).findings
    return out.select("run_id", "tool", F.coalesce("level", F.lit("warning")).alias("level"),
                      place["uri"].alias("file"), place["start_line"].alias("line"), "message")


# --- a converter of one's own ---


def _own_results(df):
    """Lines `rule|file|line|message`; other lines are left out."""
    lines_of = normalize.base.explode_items(df, c("doc"), "line")
    cells = lines_of.withColumn("x", F.split("line", r"\|", 4)).where(F.size("x") == 4)
    cell = lambda k: F.get("x", F.lit(k))
    return normalize.base.finish(cells.select(*normalize.base.KEYS, "result_idx", *normalize.base.fields(
        rule_id=F.concat(F.lit("own/"), cell(0)), level=F.lit("note"), message=cell(3),
        locations=one_location(cell(1), cell(2).try_cast("int")),
        properties=normalize.base.property_map(length=F.length("line")),
        rule_name=cell(0), rule_description=F.lit("stated by the converter"))), "own-tool")


OWN = normalize.base.Converter("own", "own-tool", normalize.base.parse_lines, _own_results)


@query("own_converter", _expected(
    "'own/' || kind", "'note'", "message", "kind <> 'signup'",
    props="'length=' || (length(kind) + length(file) + length(line::VARCHAR) + length(message) + 3)"))
def own_converter(spark, sf):
    item = F.when(c("kind") == "signup", "not of this form").otherwise(
        F.concat_ws("|", "kind", "file", "line", "message"))
    raw = reports(base(spark, sf), "own", item)
    return flatten(normalize.normalise(raw, tools=["own"], extra={"own": OWN}).findings)


# --- reports on disk -----------------------------------------------------------------------

# One run is 256 findings; its one tool is chktex or taplo. Every fifth run failed, and of the
# others some say that they wrote no file.
_STORED = f"""WITH findings_v AS ({FINDINGS}),
stored AS (SELECT *, concat('r', cast(cast(floor(seq / 256) AS bigint) AS string)) AS stored_run,
  CASE WHEN floor(seq / 256) % 2 = 0 THEN 'chktex' ELSE 'taplo' END AS stored_tool,
  floor(seq / 256) % 5 <> 0 AS success, floor(seq / 256) % 7 <> 3 AS wrote, seq % 9 AS col
  FROM findings_v)
"""


def _stored(spark, sf) -> DataFrame:
    run_no = F.floor(F.col("seq") / 256).cast("bigint")
    return views.raw_findings(spark, sf).select(
        "seq", "file", "line", "message", (c("seq") % 9).alias("col"),
        F.concat(F.lit("r"), run_no).alias("run_id"),
        F.when(run_no % 2 == 0, "chktex").otherwise("taplo").alias("tool"),
        (run_no % 5 != 0).alias("success"), (run_no % 7 != 3).alias("wrote"))


def stored_reports(spark, sf) -> tuple[str, DataFrame]:
    """A folder of report files made from the events, and what became of each tool."""
    rows = _stored(spark, sf)
    place = F.concat_ws(":", "file", "line", "col")
    item = F.when(c("tool") == "chktex", F.concat(place, F.lit(": Warning: "), c("message"), F.lit(
        " (Warning "), c("col"), F.lit(").\n"))).otherwise(F.concat(
            F.lit("error[k"), c("col"), F.lit("]: "), c("message"), F.lit("\n  --> "), place, F.lit("\n")))
    gathered = F.array_sort(F.collect_list(F.struct("seq", item.alias("text"))))
    by_run = rows.groupBy("run_id", "tool").agg(
        F.array_join(F.transform(gathered, lambda x: x["text"]), "").alias("raw"),
        F.first("success").alias("success"), F.first("wrote").alias("wrote"))
    root = f"{stage_folder(spark)}/reports-{uuid.uuid4().hex}"
    reports_on_disk.write_report_files(by_run, root, "txt")
    return root, by_run.select("run_id", "tool", "success", F.when(c("wrote"), F.concat_ws(
        "/", "run_id", "tool")).alias("sarif_path"))


@query("stored_reports", _STORED + """
SELECT stored_run AS run_id, row_number() OVER (PARTITION BY stored_run ORDER BY seq) - 1 AS index,
  stored_tool AS tool, CASE stored_tool WHEN 'chktex' THEN 'chktex/W' ELSE 'taplo/k' END || col
    AS rule_id, CASE stored_tool WHEN 'chktex' THEN 'warning' ELSE 'error' END AS level, message,
  file, line::INT AS start_line
FROM stored WHERE success AND wrote""")
def read_stored_reports(spark, sf):
    """Report files written, read back by pieces of 2,000 bytes and normalised."""
    root, results = stored_reports(spark, sf)
    pieces = reports_on_disk.read_report_pieces(spark, root, results, split_bytes=2_000)
    findings = normalize.normalise(pieces, tools=["chktex", "taplo"]).findings
    place = F.get("locations", F.lit(0))
    return global_index(findings).select(
        "run_id", "index", "tool", "rule_id", "level", "message", place["uri"].alias("file"),
        place["start_line"].alias("start_line"))
