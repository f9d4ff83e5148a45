"""Reports that already are SARIF documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import text
from repograph.model import LOCATION, PROPERTIES, SARIF_VERSION
from repograph.normalize.base import KEYS, as_int
from repograph.operators.once import compute_once

# What each native tool is for.
CATEGORIES = {
    "semgrep": "sast", "bandit": "sast", "ruff": "linter", "gosec": "sast", "trivy": "sca",
    "owasp-dependency-check": "sca", "brakeman": "sast", "cppcheck": "sast", "clang-sa": "sast",
    "pmd": "linter", "pmd-cpd": "duplication", "checkov": "iac", "kics": "iac",
    "slither": "sast", "ggshield": "secret-detection", "eslint": "linter", "hadolint": "linter",
}

_REGION = "struct<startLine:string,startColumn:string,endLine:string,endColumn:string>"
_RESULT = ("struct<ruleId:string,level:string,message:struct<text:string>,locations:array<struct<"
           f"physicalLocation:struct<artifactLocation:struct<uri:string>,region:{_REGION}>>>,"
           f"fingerprints:map<string,string>,properties:{PROPERTIES}>")
_RULE = ("struct<id:string,name:string,fullDescription:struct<text:string>,"
         "defaultConfiguration:struct<level:string>,helpUri:string>")
_DOCUMENT = ("`$schema` string, version string, runs array<struct<tool:struct<driver:struct<"
             f"name:string,version:string,rules:array<{_RULE}>>,extensions:string>,"
             f"results:array<{_RESULT}>,properties:{PROPERTIES}>>")
# Results and rules once more as they were written, with all that the typed columns do not hold.
_GIVEN = ("runs array<struct<tool:struct<driver:struct<rules:array<string>>>,results:array<string>,"
          "artifacts:array<struct<location:struct<uri:string>>>>>")


def parse(reports: DataFrame) -> DataFrame:
    typed = compute_once(reports, "doc", text.json_struct(F.col("raw"), _DOCUMENT))
    return compute_once(typed, "given", F.from_json("raw", _GIVEN, {"allowSingleQuotes": "false"}))


def reason() -> Column:
    """Why a document is refused: null when it is structurally sound."""
    runs = F.col("doc.runs")
    nameless = F.exists(runs, lambda r: r["tool"]["driver"]["name"].isNull())
    return (F.when(F.col("doc").isNull() | F.json_object_keys("raw").isNull(), "not JSON")
            .when(F.col("doc._corrupt").isNotNull(), "not JSON of the expected structure")
            .when(F.coalesce("doc.version", F.lit(SARIF_VERSION)) != SARIF_VERSION,
                  "unsupported version")
            .when(runs.isNull() | (F.size(runs) == 0), "no runs")
            .when(nameless, "run without tool.driver.name"))


def _runs(accepted: DataFrame) -> DataFrame:
    return accepted.select(*KEYS, F.col("tool").alias("report_tool"),
                           F.posexplode(_beside("doc.runs", "given.runs")).alias("run_idx", "both")
                           ).select(*KEYS, "report_tool", "run_idx", F.col("both.typed").alias("run"),
                                    F.col("both.original").alias("given"))


def _beside(typed: str, given: str) -> Column:
    """Typed entries, each with the entry as it was written."""
    return F.transform(typed, lambda x, i: F.struct(
        x.alias("typed"), F.get(F.col(given), i).alias("original")))


def findings(accepted: DataFrame) -> DataFrame:
    rows = _runs(accepted).select(
        *KEYS, "run_idx", F.col("run.tool.driver.name").alias("tool"),
        F.posexplode(_beside("run.results", "given.results")).alias("result_idx", "both")
    ).withColumn("r", F.col("both.typed"))

    def place(loc):
        region, uri = loc["physicalLocation"]["region"], loc["physicalLocation"][
            "artifactLocation"]["uri"]
        return F.struct(
            uri.alias("uri"), as_int(region["startLine"]).alias("start_line"),
            as_int(region["startColumn"]).alias("start_col"),
            as_int(region["endLine"]).alias("end_line"),
            as_int(region["endColumn"]).alias("end_col"))

    return rows.select(
        *KEYS, "run_idx", F.col("result_idx").cast("bigint").alias("result_idx"), "tool",
        F.col("r.ruleId").alias("rule_id"), F.col("r.level").alias("level"),
        F.coalesce("r.message.text", F.lit("")).alias("message"),
        F.transform("r.locations", place).cast(f"array<{LOCATION}>").alias("locations"),
        F.col("r.fingerprints").alias("fingerprints"), F.col("r.properties").alias("properties"),
        F.col("both.original").alias("original"))


def rules(accepted: DataFrame) -> DataFrame:
    rows = _runs(accepted).select(
        *KEYS, "run_idx", F.col("run.tool.driver.name").alias("tool"),
        F.posexplode(_beside("run.tool.driver.rules", "given.tool.driver.rules")).alias(
            "rule_idx", "both")).withColumn("r", F.col("both.typed"))
    return rows.select(
        *KEYS, "run_idx", F.col("rule_idx").cast("bigint").alias("rule_idx"), "tool",
        F.col("r.id").alias("rule_id"), F.col("r.name").alias("name"),
        F.col("r.fullDescription.text").alias("description"),
        F.col("r.defaultConfiguration.level").alias("level"), F.col("r.helpUri").alias("help_uri"),
        F.col("both.original").alias("original"))


def artifacts(accepted: DataFrame) -> DataFrame:
    """Files that the runs list themselves, whether or not a result names them."""
    return _runs(accepted).select("run_id", F.explode("given.artifacts.location.uri").alias("uri")).where(
        text.nonempty(F.col("uri")).isNotNull()).distinct()


def runs(accepted: DataFrame, processed_at: str | None = None) -> DataFrame:
    """Runs with a property that says how and when they were read."""
    pairs = [F.lit(x) for kv in CATEGORIES.items() for x in kv]
    category = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("report_tool")),
                          F.lit("unknown"))
    when = F.lit(processed_at) if processed_at else F.date_format(
        F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()),
        "yyyy-MM-dd'T'HH:mm:ss'Z'")
    stamp = F.to_variant_object(F.struct(
        F.lit("passthrough").alias("converter"), F.col("report_tool").alias("originalTool"),
        category.alias("category"), when.alias("processedAt")))
    own = F.map_filter(F.coalesce("run.properties", F.create_map().cast(PROPERTIES)),
                       lambda k, v: k != "normalizer")
    return _runs(accepted).select(
        *KEYS, "run_idx", F.col("run.tool.driver.name").alias("tool"),
        F.coalesce("run.tool.driver.version", F.lit("unknown")).alias("version"),
        F.col("run.tool.extensions").alias("extensions"),
        F.map_concat(own, F.create_map(F.lit("normalizer"), stamp)).alias("properties"))
