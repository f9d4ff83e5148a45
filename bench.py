"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads, BENCH_QUERIES a
comma-separated choice of queries (`all` for every registered one).
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

import catalog  # noqa: E402
from repograph.ship import ship_packages  # noqa: E402

HEADLINE = [
    "run_metrics", "deduplicated_findings", "dashboard_metrics", "finding_index",
    "explained_findings", "file_nodes", "top_findings_per_level", "unified_sarif",
    "line_item_metrics", "line_item_index", "converted_pyright", "converted_trufflehog",
    "converted_lizard_csv", "converted_sarif", "analysis_metrics", "corpus_documents",
    "ignored_files", "detected_languages", "import_edges", "module_summaries", "analysis_report",
    "document_chunks", "embedded_chunks", "valid_vectors", "nearest_vectors", "retrieved_chunks",
    "chat_requests", "prompts", "related_links", "section_tree", "content_budget",
    "markdown_export", "parsed_pages",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = HEADLINE if not chosen else (
        list(catalog.QUERIES) if chosen == "all" else chosen.split(","))
    builder = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g").config("spark.sql.session.timeZone", "UTC"))
    if not os.environ.get("SPARK_CHECKPOINT_DIR"):
        builder = builder.config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="run-", dir="/tmp"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    here = os.path.dirname(os.path.abspath(__file__))
    ship_packages(spark, os.path.join(here, "repograph"), os.path.join(here, "catalog"))
    # Start the JVM, the code generator and the Python workers before the clock runs.
    catalog.QUERIES["run_metrics"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(8).mapInPandas(lambda it: it, "id bigint").count()

    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)}))


if __name__ == "__main__":
    main()
