"""Build SARIF JSON from findings, rules and runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions.text import nonempty
from repograph.model import LEVELS, SARIF_SCHEMA_URI, SARIF_VERSION
from repograph.operators.skew import salted_join


def location_object(place: Column) -> Column:
    """SARIF location; missing positions are left out, a missing start line is 1."""
    return F.struct(F.struct(
        F.struct(place["uri"].alias("uri")).alias("artifactLocation"),
        F.struct(F.coalesce(place["start_line"], F.lit(1)).alias("startLine"),
                 place["start_col"].alias("startColumn"), place["end_line"].alias("endLine"),
                 place["end_col"].alias("endColumn")).alias("region")).alias("physicalLocation"))


def valid_level(level: Column) -> Column:
    return F.when(level.isin(*LEVELS), level).otherwise("warning")


def _filled(c: Column) -> Column:
    """Null for an empty array or map, so that JSON leaves it out."""
    return F.when(F.size(c) > 0, c)


def result_object(rule_id: Column, message: Column, level: Column, locations: Column,
                  fingerprints: Column | None = None, properties: Column | None = None) -> Column:
    """SARIF result; an unknown level becomes a warning, empty parts are left out."""
    parts = [rule_id.alias("ruleId"), valid_level(level).alias("level"),
             F.struct(message.alias("text")).alias("message"),
             _filled(F.transform(locations, location_object)).alias("locations")]
    if fingerprints is not None:
        parts.append(_filled(fingerprints).alias("fingerprints"))
    if properties is not None:
        parts.append(_filled(properties).alias("properties"))
    return F.struct(*parts)


def rule_object(rule_id: Column, name: Column, description: Column, level: Column,
                help_uri: Column | None = None) -> Column:
    """SARIF rule; name, description, level and address are left out when empty or unknown."""
    known = F.when(level.isin(*LEVELS), F.struct(level.alias("level")))
    text = F.when(nonempty(description).isNotNull(), F.struct(description.alias("text")))
    parts = [rule_id.alias("id"), nonempty(name).alias("name"), text.alias("fullDescription"),
             known.alias("defaultConfiguration")]
    if help_uri is not None:
        parts.append(nonempty(help_uri).alias("helpUri"))
    return F.struct(*parts)


_VARIANTS = "map<string,variant>"
# Normalised fields that are objects: the one key of each that is normalised.
_NESTED = {"message": "text", "fullDescription": "text", "defaultConfiguration": "level"}


def _overlaid(original: Column, made: Column, replaced: list[str]) -> Column:
    """JSON of `original` with the fields named in `replaced` as `made` has them.

    A field that `made` leaves out goes; an object keeps its keys beside the normalised one.
    Values of any kind stay as they are. Without an original, or where it cannot be read, `made`.
    """
    given = F.from_json(original, _VARIANTS)
    own = F.from_json(made, _VARIANTS)
    out = F.map_filter(given, lambda k, v: ~k.isin(*replaced))
    for name in replaced:
        value, mine = F.try_element_at(given, F.lit(name)), F.try_element_at(own, F.lit(name))
        if name in _NESTED:
            part = lambda x: F.coalesce(F.try_variant_get(x, "$", _VARIANTS), F.from_json(
                F.lit("{}"), _VARIANTS))
            value = F.map_concat(F.map_filter(part(value), lambda k, v: k != _NESTED[name]), part(mine))
            kept = F.size(value) > 0
            value = F.parse_json(F.to_json(value))
        else:
            # Lists and property bags hold more than the typed columns do.
            value = F.coalesce(value, mine) if name in ("locations", "fingerprints",
                                                        "properties") else mine
            kept = mine.isNotNull()
        added = F.map_from_arrays(F.array(F.lit(name)), F.array(value))
        out = F.map_concat(out, F.map_filter(added, lambda k, v: kept))
    return F.coalesce(F.to_json(out), made)


# Sections of a run in document order.
_OPEN, _RULES, _RESULTS, _ARTIFACTS, _CLOSE = range(5)
FRAGMENT_ORDER = ["tool", "section", "doc_idx", "run_idx", "item", "item_text"]


def unified_document(findings: DataFrame, rules: DataFrame, merged: DataFrame,
                     artifacts: DataFrame | None = None) -> DataFrame:
    """The unified document of each run as ordered text fragments.

    Written in FRAGMENT_ORDER and concatenated, the fragments of a run are one SARIF log. A
    large run stays many rows: nothing gathers a document in one task.
    """
    text = lambda c: F.concat(F.when(F.col("first"), "").otherwise(","), c)
    shape = lambda df, section, body, place, item_text=F.lit(""): df.select(
        "run_id", "tool", F.lit(section).alias("section"),
        *[c.cast("bigint").alias(n) for c, n in zip(place, ("doc_idx", "run_idx", "item"))],
        item_text.alias("item_text"), body.alias("text"))
    zero = [F.lit(0)] * 3

    # Only runs and tools are compared here; a comma goes before all but the first entry.
    tools = _mark_first(merged, ["run_id"], "tool")
    opening = F.concat(
        F.lit('{"tool":{"driver":{"name":'), _quoted("tool"), F.lit(',"version":'),
        _quoted("version"), F.lit(',"rules":['))
    parts = [shape(tools, _OPEN, text(opening), zero)]

    # A rule entry is placed by where it was first stated.
    places = F.struct("doc_idx", "run_idx", "rule_idx", "rule_id")
    ruled = _mark_first(rules.withColumn("place", places), ["run_id", "tool"], "place")
    rule_json = F.to_json(rule_object(
        F.col("rule_id"), F.col("name"), F.col("description"), F.col("level"),
        F.col("help_uri") if "help_uri" in rules.columns else None))
    if "original" in rules.columns:
        rule_json = _overlaid(F.col("original"), rule_json, [
            "id", "name", "fullDescription", "defaultConfiguration", "helpUri"])
    parts.append(shape(ruled, _RULES, text(rule_json),
                       [F.col("doc_idx"), F.col("run_idx"), F.col("rule_idx")], F.col("rule_id")))

    between = F.concat(F.lit(']}'), F.when(nonempty(F.col("extensions")).isNotNull(), F.concat(
        F.lit(',"extensions":'), F.col("extensions"))).otherwise(""), F.lit('},"results":['))
    parts.append(shape(merged, _RULES, between, [F.lit(1 << 62), F.lit(0), F.lit(0)]))

    listed = _mark_first(findings.withColumn("place", F.struct("doc_idx", "run_idx", "result_idx")),
                         ["run_id", "tool"], "place")
    result_json = F.to_json(result_object(
        F.coalesce("rule_id", F.lit("")), F.col("message"), F.coalesce("level", F.lit("warning")),
        F.col("locations"), F.col("fingerprints"), F.col("properties")))
    if "original" in findings.columns:
        # Rules are merged and ordered anew: a result's old rule number would name another one.
        result_json = _overlaid(F.col("original"), result_json, [
            "ruleId", "ruleIndex", "level", "message", "locations", "fingerprints", "properties"])
    parts.append(shape(listed, _RESULTS, text(result_json),
                       [F.col("doc_idx"), F.col("run_idx"), F.col("result_idx")]))

    closing = F.concat(
        F.lit("]"), F.when(F.size("properties") > 0, F.concat(
            F.lit(',"properties":'), F.to_json("properties"))).otherwise(""))
    if artifacts is not None:
        # Every run of a log repeats the files of the whole log.
        files = _mark_first(artifacts, ["run_id"], "uri").join(
            merged.select("run_id", "tool"), "run_id")
        head = F.concat(F.when(F.col("first"), '],"artifacts":[').otherwise(","), F.to_json(
            F.struct(F.struct("uri").alias("location"))))
        parts.append(shape(files, _ARTIFACTS, head, zero, F.col("uri")))
        closing = F.regexp_replace(closing, r"^\]", "]")
    parts.append(shape(merged, _CLOSE, F.concat(closing, F.lit("}")), zero))

    runs = merged.select("run_id").distinct()
    edge = lambda tool, body: runs.select(
        "run_id", F.lit(tool).alias("tool"), F.lit(0).alias("section"),
        *[F.lit(0).cast("bigint").alias(n) for n in ("doc_idx", "run_idx", "item")],
        F.lit("").alias("item_text"), F.lit(body).alias("text"))
    parts.append(edge("", f'{{"$schema":"{SARIF_SCHEMA_URI}","version":"{SARIF_VERSION}","runs":['))
    # Sorts after every tool name: U+10FFFF is the largest code point.
    parts.append(edge("\U0010ffff", "]}"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _quoted(name: str) -> Column:
    """A JSON string."""
    return F.regexp_replace(F.to_json(F.array(F.col(name))), r"^\[|\]$", "")


def _mark_first(df: DataFrame, keys: list[str], place: str) -> DataFrame:
    """Add `first`: whether the row has the smallest place of its group."""
    least = df.groupBy(*keys).agg(F.min(place).alias("_least"))
    return salted_join(df, least, keys, [place]).withColumn("first", F.col(place) == F.col("_least")).drop("_least")
