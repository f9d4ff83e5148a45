"""Merge the runs of one tool into a single run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F, types as T

from repograph.functions.text import nonempty
from repograph.operators.ordering import first_n
from repograph.operators.skew import salted_join

PLACE = ["doc_idx", "run_idx"]


def merge_runs(runs: DataFrame) -> DataFrame:
    """One row per (run, tool): last usable version, first value of every property.

    Without a usable version the first run's own text stays.
    """
    place = F.struct(*PLACE)
    usable = nonempty(F.col("version")).isNotNull() & (F.col("version") != "unknown")
    merged = runs.groupBy("run_id", "tool").agg(
        F.max_by(F.when(usable, F.col("version")), F.when(usable, place)).alias("_last"),
        F.min_by(F.coalesce("version", F.lit("unknown")), place).alias("_first"),
        F.min_by(F.coalesce("extensions", F.lit("")), place).alias("_extensions"))
    entries = runs.select("run_id", "tool", *PLACE, F.explode("properties").alias("key", "value"))
    kind = runs.schema["properties"].dataType
    typed = isinstance(kind, T.MapType) and isinstance(kind.valueType, T.VariantType)
    # Values of any kind have no order; as JSON text they can be sorted with their keys.
    value = F.to_json("value") if typed else F.col("value")
    read = (lambda k, v: F.parse_json(v)) if typed else (lambda k, v: v)
    properties = entries.groupBy("run_id", "tool", "key").agg(
        F.min_by(value, place).alias("value")).groupBy("run_id", "tool").agg(F.transform_values(
            F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "value")))), read)
        .alias("properties"))
    return merged.join(properties, ["run_id", "tool"], "left").select(
        "run_id", "tool", F.coalesce("_last", "_first").alias("version"),
        nonempty(F.col("_extensions")).alias("extensions"), "properties")


def merged_run_index(runs: DataFrame) -> DataFrame:
    """Position of each merged run: tools in name order."""
    tools = runs.select("run_id", "tool").distinct()
    return tools.select("run_id", "tool", (F.row_number().over(
        Window.partitionBy("run_id").orderBy("tool")) - 1).alias("merged_idx"))


def merge_rules(rules: DataFrame, runs: DataFrame) -> DataFrame:
    """One rule per (run, tool, id).

    The earliest run that has the id decides. Inside a tool's very first run the last entry
    counts, inside a later run the first one. Rules without id are dropped.
    """
    first = runs.groupBy("run_id", "tool").agg(F.min(F.struct(*PLACE)).alias("_start"))
    in_first = F.struct(*PLACE) == F.col("_start")
    named = rules.where(nonempty(F.col("rule_id")).isNotNull())
    keyed = salted_join(named, first, ["run_id", "tool"], [*PLACE, "rule_idx"], "left")
    ranked = keyed.withColumn(
        "_pick", F.when(in_first, -F.col("rule_idx")).otherwise(F.col("rule_idx")))
    return first_n(ranked, ["run_id", "tool", "rule_id"], [*PLACE, "_pick"], 1).drop(
        "_start", "_pick")
