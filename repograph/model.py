"""Column layouts shared by all operators.

Rows carry explicit ordinals because Spark rows have no order of their own and several
results (first-wins dedup, finding index, report excerpts) depend on order.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The SARIF constants every consumer of the unified document expects.
SARIF_VERSION = "2.1.0"
SARIF_SCHEMA_URI = (
    "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/main/"
    "sarif-2.1/schema/sarif-schema-2.1.0.json"
)
LEVELS = ("error", "warning", "note", "none")
LEVEL_RANK = {"error": 3, "warning": 2, "note": 1, "none": 0}

LOCATION = "struct<uri:string,start_line:int,start_col:int,end_line:int,end_col:int>"

# Property values of any kind: text, numbers, booleans, lists and objects stay what they are.
PROPERTIES = "map<string,variant>"

# One row per SARIF result. `level` is null where a native document omitted it.
FINDING_SCHEMA = (
    "run_id string, doc_idx bigint, run_idx int, result_idx bigint, tool string, "
    "rule_id string, level string, message string, "
    f"locations array<{LOCATION}>, "
    f"fingerprints map<string,string>, properties {PROPERTIES}"
)
RULE_SCHEMA = (
    "run_id string, doc_idx bigint, run_idx int, rule_idx bigint, tool string, "
    "rule_id string, name string, description string, level string, help_uri string"
)
RUN_SCHEMA = (
    "run_id string, doc_idx bigint, run_idx int, tool string, version string, "
    f"extensions string, properties {PROPERTIES}"
)
# JSON text of a native result or rule as it was written; null where a converter made the row.
ORIGINAL = "original string"
ARTIFACT_SCHEMA = "run_id string, uri string"
REJECT_SCHEMA = "run_id string, doc_idx bigint, tool string, reason string"

# Order of a finding inside its run once the tool runs are merged: merged runs are sorted
# by tool name and keep the order of the reports they came from.
MERGED_ORDER = ["tool", "doc_idx", "run_idx", "result_idx"]


def level_rank(level: Column) -> Column:
    """Severity rank of a level; anything unknown ranks as `none`."""
    pairs = [F.lit(x) for kv in LEVEL_RANK.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), level), F.lit(0))


def level_name(rank: Column) -> Column:
    """Inverse of `level_rank`."""
    by_rank = sorted(LEVEL_RANK, key=LEVEL_RANK.get)
    return F.element_at(F.array(*[F.lit(x) for x in by_rank]), rank + 1)


def first_location(field: str) -> Column:
    """Field of the first location, null when a result has none."""
    return F.get("locations", F.lit(0))[field]


def one_location(uri, start_line, start_col=None, end_line=None, end_col=None) -> Column:
    """Array holding one location."""
    def as_int(c):
        return (F.lit(None) if c is None else c).cast("int")

    return F.array(F.struct(
        uri.alias("uri"), as_int(start_line).alias("start_line"),
        as_int(start_col).alias("start_col"), as_int(end_line).alias("end_line"),
        as_int(end_col).alias("end_col")))


def no_locations() -> Column:
    return F.lit(None).cast(f"array<{LOCATION}>")
