"""Tools that print one finding per line, as text or as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import text
from repograph.functions.severity import map_severity
from repograph.model import one_location
from repograph.normalize.base import (
    KEYS, Converter, Rule, as_int, captured, explode_items, fields, finish,
    json_lines, parse_lines, property_map)
from repograph.operators.once import compute_once


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


# --- trufflehog --------------------------------------------------------------------------

_PLACE = "struct<file:string,line:string>"
_SECRET = ("DetectorName string, Verified string, Raw string, SourceMetadata struct<Data:struct<"
           f"Filesystem:{_PLACE},Git:{_PLACE},file:string,line:string>>")


def _trufflehog(df: DataFrame) -> DataFrame:
    d = json_lines(df, _SECRET)
    detector = _or(F.col("item.DetectorName"), "unknown-detector")
    verified = F.lower(_or(F.col("item.Verified"), "false")) == "true"
    secret = _or(F.col("item.Raw"), "")
    places = [F.col(f"item.SourceMetadata.Data.{p}") for p in ("Filesystem", "Git")]
    top = F.col("item.SourceMetadata.Data")
    file = text.first_nonempty(*[p["file"] for p in places], top["file"])
    # A zero line counts as missing, so the next source is asked.
    line_text = F.coalesce(*[F.nullif(text.nonempty(c), F.lit("0"))
                             for c in [*[p["line"] for p in places], top["line"]]])
    line = F.greatest(_or(as_int(line_text), 1), F.lit(1))
    level = map_severity("trufflehog", F.when(verified, "verified").otherwise("unverified"))
    message = F.concat(F.when(verified, "VERIFIED").otherwise("unverified"),
                       F.lit(" secret detected by "), detector, F.lit(": "), text.redact(secret))
    mark = F.sha2(F.concat_ws(":", detector, file, F.sha2(secret, 256)), 256)
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=F.concat(F.lit("trufflehog/"), detector), level=level, message=message,
        locations=F.when(file != "", one_location(file, line)),
        fingerprints=F.create_map(F.lit("trufflehog/v1"), mark),
        properties=property_map(detector=detector, verified=verified),
        rule_name=F.concat(F.lit("trufflehog: "), detector),
        rule_description=F.concat(F.lit("Secret detected by the "), detector,
                                  F.lit(" detector.")))), "trufflehog")


TRUFFLEHOG = Converter(
    "trufflehog", "trufflehog", parse_lines, _trufflehog,
    fallback=Rule("trufflehog/secret-detected", "Secret detected",
                  "trufflehog detected a potential secret in the source."))


# --- clippy ------------------------------------------------------------------------------

_SPAN = ("struct<is_primary:boolean,file_name:string,line_start:string,line_end:string,"
         "column_start:string,column_end:string>")


def _clippy(df: DataFrame) -> DataFrame:
    d = json_lines(df, "reason string, message struct<level:string,message:string,code:string,"
                       f"spans:array<{_SPAN}>>")
    d = d.where((F.col("item.reason") == "compiler-message") & F.col("item.message").isNotNull())
    level_word = _or(F.col("item.message.level"), "warning")
    # The code may be an object, a plain string or missing; only the object names a lint.
    code = F.when(F.col("item.message.code").startswith("{"), F.coalesce(
        F.get_json_object("item.message.code", "$.code"), F.lit("clippy-diagnostic"))).otherwise(
        "clippy-diagnostic")
    spans = F.col("item.message.spans")
    span = F.coalesce(F.get(F.filter(spans, lambda s: s["is_primary"]), F.lit(0)),
                      F.get(spans, F.lit(0)))
    d = d.select(*KEYS, "result_idx", level_word.alias("word"), code.alias("code"),
                 _or(F.col("item.message.message"), "").alias("message"), span.alias("span"))
    d = d.where((F.col("word") != "note") | F.col("code").startswith("clippy::"))
    at = lambda name: as_int(F.col(f"span.{name}"))
    level = map_severity("clippy", F.col("word"))
    return finish(d.select(*KEYS, "result_idx", "message", *fields(
        rule_id=F.concat(F.lit("clippy/"), F.coalesce(text.nonempty(F.col("code")),
                                                      F.lit("unknown"))),
        level=level,
        locations=F.when(text.nonempty(F.col("span.file_name")).isNotNull(), one_location(
            F.col("span.file_name"), _or(at("line_start"), 1), at("column_start"), at("line_end"),
            at("column_end"))),
        rule_name=F.col("code"),
        rule_description=F.concat(F.lit("Clippy lint: "), F.col("code")))), "clippy")


CLIPPY = Converter("clippy", "clippy", parse_lines, _clippy)


# --- cargo-deny --------------------------------------------------------------------------

_DIAGNOSTIC = ("severity:string,level:string,message:string,code:string,labels:array<struct<"
               "span:struct<file_name:string,file:string,line_start:string,column_start:string>>>")


def _cargo_deny(df: DataFrame) -> DataFrame:
    bare = _DIAGNOSTIC.replace("severity:", "severity ").replace(",level:", ", level ").replace(
        ",message:", ", message ").replace(",code:", ", code ").replace(",labels:", ", labels ")
    d = json_lines(df, f"fields struct<{_DIAGNOSTIC}>, {bare}")
    wrapped = F.col("item.fields").isNotNull()
    get = lambda name: F.when(wrapped, F.col(f"item.fields.{name}")).otherwise(
        F.col(f"item.{name}"))
    d = d.select(*KEYS, "result_idx", _or(get("message"), "").alias("message"),
                 F.coalesce(get("severity"), get("level"), F.lit("warning")).alias("word"),
                 get("code").alias("code"), get("labels").alias("labels"))
    d = d.where(F.col("message") != "")
    code = F.when(F.col("code").startswith("{"), F.get_json_object("code", "$.code")).otherwise(
        F.col("code"))
    d = d.withColumn("code", _or(code, ""))
    file_of = lambda span: text.first_nonempty(span["file_name"], span["file"])
    span = F.get(F.filter("labels", lambda lb: file_of(lb["span"]) != ""), F.lit(0))["span"]
    d = d.withColumn("span", span)
    named = F.col("code") != ""
    return finish(d.select(*KEYS, "result_idx", "message", *fields(
        rule_id=F.concat(F.lit("cargo-deny/"), F.when(named, F.col("code")).otherwise(
            "diagnostic")),
        level=map_severity("cargo-deny", F.col("word")),
        locations=F.when(F.col("span").isNotNull(), one_location(
            file_of(F.col("span")), _or(as_int(F.col("span.line_start")), 1),
            as_int(F.col("span.column_start")))),
        rule_name=F.when(named, F.col("code")).otherwise("cargo-deny diagnostic"),
        rule_description=F.when(named, F.concat(F.lit("cargo-deny: "), F.col("code"))).otherwise(
            "cargo-deny diagnostic"))), "cargo-deny")


CARGO_DENY = Converter("cargo-deny", "cargo-deny", parse_lines, _cargo_deny)


# --- deptrac -----------------------------------------------------------------------------

_DEPTRAC_RULE = Rule(
    "deptrac/forbidden-dependency", "Forbidden dependency",
    "A class depends on another class that is not allowed by the configured layer rules.")
# The three line shapes, tried in this order, and the layer suffix.
_WITH_LINE = r"\A([^\s:]+):(\d+)\s*[-:]\s*(.+)\z"
_WITH_FILE = r"\A([^\s:]+)::(.+)\z"
_PLAIN = r"\A([A-Z][\w\\]+)\s+(must not depend on .+)\z"
_LAYERS = r"\(([^)]+?)\s*->\s*([^)]+?)\)\s*\z"


def _deptrac(df: DataFrame) -> DataFrame:
    d = explode_items(df, F.col("doc"), "line")
    line = F.col("line")
    # The first shape that fits gives (file, line, message); the plain shape names no file.
    fits = F.when(line.rlike(_WITH_LINE), captured(line, _WITH_LINE, 3)).when(
        line.rlike(_WITH_FILE), F.array_insert(captured(line, _WITH_FILE, 2), 2, F.lit("1"))).when(
        line.rlike(_PLAIN), F.array(F.lit(""), F.lit("1"), F.array_join(
            captured(line, _PLAIN, 2), " ")))
    d = compute_once(d, "g", fits).where(F.col("g").isNotNull()).select(*KEYS, "result_idx", *fields(
        file=F.get("g", F.lit(0)), at=F.coalesce(as_int(F.get("g", F.lit(1))), F.lit(1)),
        message=text.strip(F.get("g", F.lit(2))))).where(F.col("message") != "")
    layered = F.col("message").rlike(_LAYERS)
    layer = lambda n: F.when(layered, text.strip(F.regexp_extract("message", _LAYERS, n)))
    mark = F.sha2(F.concat_ws(":", "file", F.col("at").cast("string"), "message"), 256)
    return finish(d.select(*KEYS, "result_idx", "message", *fields(
        rule_id=F.lit(_DEPTRAC_RULE.rule_id), level=F.lit("warning"),
        locations=F.when(F.col("file") != "", one_location(F.col("file"), F.col("at"))),
        fingerprints=F.create_map(F.lit("deptrac/v1"), mark),
        properties=property_map(sourceLayer=layer(1), targetLayer=layer(2)))), "deptrac")


DEPTRAC = Converter("deptrac", "deptrac", parse_lines, _deptrac, always=_DEPTRAC_RULE)


# --- taplo -------------------------------------------------------------------------------

_DIAG = r"\A(error|warning|info)\[([^\]]+)\]:\s*(.+)\z"
_WHERE = r"(?s)\A\s*-->\s*([^:]+):(\d+):(\d+).*\z"


def _taplo(df: DataFrame) -> DataFrame:
    # Each line travels with the line after it: the look-ahead needs no window.
    behind = F.coalesce("after", F.lit("")) if "after" in df.columns else F.lit("")
    following = F.arrays_zip(F.col("doc").alias("line"), F.slice(
        F.concat("doc", F.array(text.strip(behind))), 2, F.size("doc")).alias("next"))
    d = explode_items(df, following)
    d = d.where(F.col("item.line").rlike(_DIAG)).withColumns({
        "g": captured(F.col("item.line"), _DIAG, 3),
        "at": F.when(F.col("item.next").rlike(_WHERE), captured(F.col("item.next"), _WHERE, 3))})
    part = lambda n: F.get("g", F.lit(n - 1))
    place = lambda n: F.get("at", F.lit(n - 1))
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=F.concat(F.lit("taplo/"), part(2)), level=map_severity("taplo", part(1)),
        message=part(3),
        locations=F.when(F.col("at").isNotNull(), one_location(
            place(1), as_int(place(2)), as_int(place(3)))),
        rule_name=part(2), rule_description=F.concat(F.lit("taplo lint: "), part(2)))), "taplo")


TAPLO = Converter("taplo", "taplo", parse_lines, _taplo, fallback=Rule(
    "taplo/unknown", "taplo lint", "Generic taplo lint diagnostic"))


# --- chktex ------------------------------------------------------------------------------

_CHKTEX = (r"\A([^:]+):(\d+):(\d+):\s*(\w+):\s*(.+?)(?:\s*\(Warning\s+(\d+)\))?\.?\s*\z")


def _chktex(df: DataFrame) -> DataFrame:
    d = explode_items(df, F.col("doc"), "line").where(F.col("line").rlike(_CHKTEX)).withColumn(
        "g", captured(F.col("line"), _CHKTEX, 6))
    part = lambda n: F.get("g", F.lit(n - 1))
    code = F.coalesce(text.nonempty(part(6)), F.lit("0"))
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=F.concat(F.lit("chktex/W"), code), level=map_severity("chktex", part(4)),
        message=part(5), locations=one_location(part(1), as_int(part(2)), as_int(part(3))),
        rule_name=F.concat(F.lit("chktex warning "), code),
        rule_description=F.concat(F.lit("chktex Warning "), code))), "chktex")


CHKTEX = Converter("chktex", "chktex", parse_lines, _chktex, fallback=Rule(
    "chktex/W0", "chktex warning", "Generic chktex warning"))


# --- lacheck -----------------------------------------------------------------------------

_LACHECK = r'\A"([^"]+)",\s*line\s+(\d+):\s*(.+)\z'
_LACHECK_RULE = Rule("lacheck/warning", "lacheck warning",
                     "LaTeX consistency warning detected by lacheck.")


def _lacheck(df: DataFrame) -> DataFrame:
    d = explode_items(df, F.col("doc"), "line").where(F.col("line").rlike(_LACHECK)).withColumn(
        "g", captured(F.col("line"), _LACHECK, 3))
    part = lambda n: F.get("g", F.lit(n - 1))
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=F.lit(_LACHECK_RULE.rule_id), level=F.lit("warning"), message=part(3),
        locations=one_location(part(1), as_int(part(2))))), "lacheck")


LACHECK = Converter("lacheck", "lacheck", parse_lines, _lacheck, always=_LACHECK_RULE)
