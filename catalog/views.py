"""Inputs derived from the test tables; the same SQL text runs in Spark and in DuckDB."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from catalog.registry import table
from repograph.functions.severity import map_severity
from repograph.model import PROPERTIES, one_location

FILES = """
SELECT doc_id, concat('src/', source, '/', lang, '/', CASE doc_id % 6 WHEN 0 THEN 'test_'
  WHEN 1 THEN 'app_' WHEN 2 THEN 'spec_' ELSE 'mod_' END, cast(doc_id AS string),
  CASE doc_id % 8 WHEN 0 THEN '.py' WHEN 1 THEN '.ts' WHEN 2 THEN '.md' WHEN 3 THEN '.rs'
  WHEN 4 THEN '.yaml' WHEN 5 THEN '.sh' WHEN 6 THEN '.png' ELSE '.json' END) AS path,
  source, lang, text AS content
FROM documents"""

FINDINGS = """
SELECT event_id AS seq, concat('run-', cast(event_id % 2 AS string)) AS run_id,
  CASE user_id % 5 WHEN 0 THEN 'trivy' WHEN 1 THEN 'bandit' WHEN 2 THEN 'pyright'
    WHEN 3 THEN 'clippy' ELSE 'horusec' END AS tool,
  concat(CASE user_id % 5 WHEN 0 THEN 'trivy/' WHEN 1 THEN 'bandit/' WHEN 2 THEN 'pyright/'
    WHEN 3 THEN 'clippy/' ELSE '' END, event_type) AS rule_id,
  CASE event_id % 5 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'Medium' WHEN 2 THEN ' low '
    WHEN 3 THEN 'unknown' ELSE 'odd-word' END AS native_severity,
  concat('src/m', cast(user_id % 7 AS string), '/f', cast(user_id % 14 AS string),
    CASE user_id % 4 WHEN 0 THEN '.py' WHEN 1 THEN '_test.py' WHEN 2 THEN '.yaml'
    ELSE '.md' END) AS file,
  cast(event_id % 4 + 1 AS int) AS line,
  concat('Issue   ', event_type, ' id ', lpad(cast(event_id % 7 AS string), 8, '0'), ' in "v',
    cast(event_id % 3 AS string), '"') AS message,
  value
FROM events"""

# Levels as the vocabularies give them for the words and tools of FINDINGS.
LEVELLED = f"""
findings_v AS ({FINDINGS}),
levelled AS (SELECT *, CASE
    WHEN native_severity = 'HIGH' THEN 'error' WHEN native_severity = 'Medium' THEN 'warning'
    WHEN native_severity = ' low ' THEN 'note' WHEN native_severity = 'unknown' THEN 'none'
    ELSE 'warning' END AS level FROM findings_v)"""

WIKI_PAGES = """
SELECT page_id % 10 AS wiki_id, page_id AS seq, concat('page-', cast(page_id AS string)) AS id,
  regexp_extract(html, '<title>(.*?)</title>', 1) AS title,
  CASE page_id % 3 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' ELSE 'low' END AS importance,
  concat('page-', cast(page_id + 10 AS string)) AS related_1,
  concat('page-', cast(page_id + 7 AS string)) AS related_2, html AS content
FROM pages"""


def _sql(spark: SparkSession, sf: str, sql: str, name: str) -> DataFrame:
    return spark.sql(sql.replace(f"FROM {name}", "FROM {src}"), src=table(spark, sf, name))


def files(spark, sf) -> DataFrame:
    return _sql(spark, sf, FILES, "documents")


def raw_findings(spark, sf) -> DataFrame:
    return _sql(spark, sf, FINDINGS, "events")


def wiki_pages(spark, sf) -> DataFrame:
    return _sql(spark, sf, WIKI_PAGES, "pages")


def findings(spark, sf) -> DataFrame:
    """FINDINGS in the common finding layout."""
    raw = raw_findings(spark, sf)
    return raw.select(
        "run_id", F.lit(0).cast("bigint").alias("doc_idx"), F.lit(0).alias("run_idx"),
        F.col("seq").alias("result_idx"), "tool", "rule_id",
        map_severity(F.col("tool"), F.col("native_severity")).alias("level"), "message",
        one_location(F.col("file"), F.col("line")).alias("locations"),
        F.lit(None).cast("map<string,string>").alias("fingerprints"),
        F.lit(None).cast(PROPERTIES).alias("properties"))


def flat_findings(spark, sf) -> DataFrame:
    from repograph.operators.findings import project_findings
    return project_findings(findings(spark, sf))


TOOL_RESULTS = f"""
SELECT run_id, tool, min(seq) % 3 <> 1 AS success, cast(max(value) AS double) AS duration_seconds,
  CASE WHEN min(seq) % 3 = 1 THEN concat('exit code ', cast(min(seq) AS string)) END AS error
FROM ({FINDINGS}) f GROUP BY run_id, tool"""


def tool_results(spark, sf) -> DataFrame:
    return _sql(spark, sf, TOOL_RESULTS, "events")


# Files with code in them: Python files import others, scripts have a header comment.
CODE_FILES = f"""
SELECT doc_id, concat('run-', cast(doc_id % 2 AS string)) AS run_id, source AS repo, lang, path,
  CASE doc_id % 8
    WHEN 0 THEN concat(CASE doc_id % 3 WHEN 0 THEN concat('\"\"\"Doc ', cast(doc_id AS string), '.',
      chr(10), 'more\"\"\"') ELSE '# none' END, chr(10), 'import os.path', chr(10), '  from src.',
      source, '.', lang, '.mod_', cast(doc_id AS string), ' import x', chr(10), content)
    WHEN 1 THEN concat(CASE doc_id % 3 WHEN 0 THEN '/* */' ELSE concat('/**', chr(10), ' * Script ',
      cast(doc_id AS string), chr(10), ' * @x */') END, chr(10), content)
    ELSE content END AS content
FROM ({FILES}) files_v"""


def code_files(spark, sf) -> DataFrame:
    return _sql(spark, sf, CODE_FILES, "documents")


# Findings of FINDINGS dealt over all files of CODE_FILES.
DOCUMENT_COUNT = "(SELECT max(doc_id) + 1 FROM documents)"
FILE_FINDINGS = f"""
code_files AS ({CODE_FILES}),
file_findings AS (SELECT v.seq, c.run_id, v.tool, v.rule_id, v.level, c.path AS file, v.line,
  v.message FROM levelled v JOIN code_files c ON c.doc_id = v.seq % {DOCUMENT_COUNT})"""


def file_findings(spark, sf) -> DataFrame:
    """FILE_FINDINGS in the common finding layout.

    Findings and files both grow: neither may be broadcast, however small its files look.
    """
    dealt = spark.sql("SELECT *, result_idx % (SELECT max(doc_id) + 1 FROM {documents}) AS doc_id "
                      "FROM {findings}", documents=table(spark, sf, "documents"),
                      findings=findings(spark, sf).drop("run_id"))
    paths = code_files(spark, sf).select("doc_id", "run_id", "path")
    placed = dealt.withColumn("line", F.get("locations", F.lit(0))["start_line"]).join(
        paths.hint("merge"), "doc_id")
    return placed.withColumn("locations", one_location(F.col("path"), F.col("line"))).drop(
        "line", "doc_id", "path")
