"""Contract between a tool's report format and the common finding layout.

A report is one row `(run_id, doc_idx, tool, raw)`. Every converter is a narrow projection:
parse, explode, select. Nothing shuffles, so all tools together are one map-only stage.

A report of lines may come in several rows, each with whole lines: `offset` is then the number of
bytes before the row's `raw`, `after` the line behind it. A line has a byte at least, its end, so
offset + position orders the lines of all pieces.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import text
from repograph.model import LOCATION, PROPERTIES
from repograph.operators.once import compute_once

KEYS = ["run_id", "doc_idx"]

# Results before rules are split off: rule text travels with the result that carries it.
RESULT_COLUMNS = {
    "run_id": "string", "doc_idx": "bigint", "run_idx": "int", "result_idx": "bigint",
    "tool": "string", "rule_id": "string", "level": "string", "message": "string",
    "locations": f"array<{LOCATION}>", "fingerprints": "map<string,string>",
    "properties": PROPERTIES, "rule_name": "string", "rule_description": "string",
}


@dataclass(frozen=True)
class Rule:
    """A rule a converter adds by itself."""

    rule_id: str
    name: str
    description: str
    level: str = "warning"


@dataclass(frozen=True)
class Converter:
    """How one tool's reports become results.

    `parse` adds `doc`; `reason` is a reject reason over the parsed row or null; `results`
    turns accepted rows into RESULT_COLUMNS.
    """

    tool: str
    driver: str
    parse: Callable[[DataFrame], DataFrame]
    results: Callable[[DataFrame], DataFrame]
    reason: Callable[[], Column] | None = None
    version: Callable[[], Column] | None = None
    always: Rule | None = None      # rule stated for every report
    fallback: Rule | None = None    # rule stated when no result brought one
    always_when: Callable[[], Column] | None = None


def finish(df: DataFrame, driver: str) -> DataFrame:
    """Fill in the columns a converter does not set and put all in standard order."""
    have = set(df.columns)
    fixed = {"run_idx": F.lit(0), "tool": F.lit(driver)}

    def column(name, kind):
        if name in fixed:
            return fixed[name].cast(kind).alias(name)
        return (F.col(name) if name in have else F.lit(None)).cast(kind).alias(name)

    return df.select(*[column(n, k) for n, k in RESULT_COLUMNS.items()])


def fields(**columns: Column) -> list[Column]:
    return [c.alias(n) for n, c in columns.items()]


def explode_items(df: DataFrame, items: Column, name: str = "item") -> DataFrame:
    """One row per array entry, its position becoming the result ordinal."""
    if "offset" not in df.columns:
        return df.select(*KEYS, F.posexplode(items).alias("result_idx", name))
    return df.select(*KEYS, "offset", F.posexplode(items).alias("_at", name)).select(
        *KEYS, (F.col("offset") + F.col("_at")).alias("result_idx"), name)


def report_heads(df: DataFrame) -> DataFrame:
    """One row per report: the piece it begins with."""
    return df.where(F.col("offset") == 0) if "offset" in df.columns else df


def parse_lines(df: DataFrame) -> DataFrame:
    """`doc` as the array of stripped report lines."""
    return compute_once(df, "doc", F.transform(text.lines(F.col("raw")), text.strip))


def json_lines(df: DataFrame, schema: str) -> DataFrame:
    """One row per report line that is a JSON object of the expected shape."""
    rows = explode_items(df, F.col("doc"), "line").where(F.col("line").startswith("{"))
    parsed = compute_once(rows, "item", text.json_struct(F.col("line"), schema)).drop("line")
    return parsed.where(F.col("item").isNotNull() & F.col("item._corrupt").isNull())


def parse_json(schema: str) -> Callable[[DataFrame], DataFrame]:
    return lambda df: compute_once(df, "doc", text.json_struct(F.col("raw"), schema))


def json_reason() -> Column:
    return (F.when(F.col("doc").isNull(), "not JSON")
            .when(F.col("doc._corrupt").isNotNull(), "not JSON of the expected structure"))


def captured(line: Column, pattern: str, groups: int) -> Column:
    """All groups of an anchored pattern in one pass; an unused group is empty."""
    joined = "\x00".join(f"${n}" for n in range(1, groups + 1))
    return F.split(F.regexp_replace(line, pattern, joined), "\x00")


def as_int(c: Column) -> Column:
    return c.try_cast("int")


def property_map(**values: Column) -> Column:
    """Properties by name, each with its own type; null when no value is left."""
    pairs = [x for name, value in values.items() for x in (F.lit(name), value.cast("variant"))]
    kept = F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull())
    return F.when(F.size(kept) > 0, kept)
