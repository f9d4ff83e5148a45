"""Tools that print one JSON document per report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import text
from repograph.functions.severity import map_severity
from repograph.model import one_location
from repograph.normalize.base import (
    KEYS, Converter, Rule, as_int, property_map, explode_items, fields, finish, json_reason,
    parse_json)
from repograph.operators.once import compute_once

UNKNOWN = "unknown"


def _or(c: Column, default) -> Column:
    return F.coalesce(c, F.lit(default))


def _version() -> Column:
    return _or(F.col("doc.version"), UNKNOWN)


# --- pyright -----------------------------------------------------------------------------

_POINT = "struct<line:string,character:string>"


def _pyright(df: DataFrame) -> DataFrame:
    d = explode_items(df, F.col("doc.generalDiagnostics")).where(
        text.nonempty(F.col("item.file")).isNotNull())
    # Positions are counted from zero in the report.
    from_one = lambda path: _or(as_int(F.col(f"item.range.{path}")), 0) + 1
    rule = _or(F.col("item.rule"), "pyright-diagnostic")
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=rule, level=map_severity("pyright", _or(F.col("item.severity"), "warning")),
        message=_or(F.col("item.message"), ""),
        locations=one_location(F.col("item.file"), from_one("start.line"),
                               from_one("start.character"), from_one("end.line"),
                               from_one("end.character")),
        rule_name=rule, rule_description=F.concat(F.lit("Pyright diagnostic: "), rule))), "pyright")


PYRIGHT = Converter(
    "pyright", "pyright",
    parse_json("version string, generalDiagnostics array<struct<file:string,severity:string,"
               f"message:string,rule:string,range:struct<start:{_POINT},`end`:{_POINT}>>>"),
    _pyright, json_reason, _version)


# --- horusec -----------------------------------------------------------------------------

_VULNERABILITY = ("struct<severity:string,details:string,file:string,line:string,`column`:string,"
                  "vulnHash:string,securityTool:string,language:string,code:string,"
                  "confidence:string>")


def _horusec(df: DataFrame) -> DataFrame:
    d = explode_items(df, F.col("doc.analysisVulnerabilities"), "entry").withColumn(
        "item", F.coalesce("entry.vulnerabilities", "entry.vulnerability")).where(
        F.col("item").isNotNull())
    get = lambda name, default="": _or(F.col(f"item.{name}"), default)
    tool, vuln_hash, details, file = (get("securityTool", "horusec"), get("vulnHash"),
                                      get("details"), get("file"))
    line = F.greatest(_or(as_int(get("line", "1")), 1), F.lit(1))
    column = as_int(get("column"))
    rule = F.concat(F.lit("horusec/"), F.lower(tool), F.when(
        vuln_hash != "", F.concat(F.lit("/"), F.substring(vuln_hash, 1, 12))).otherwise(""))
    source = F.when(vuln_hash != "", vuln_hash).otherwise(
        F.concat_ws(":", file, line.cast("string"), details))
    detected = F.concat(F.lit("Vulnerability detected by "), tool)
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=rule, level=map_severity("horusec", get("severity", "MEDIUM")),
        message=F.when(details != "", details).otherwise(detected),
        locations=F.when(file != "", one_location(file, line, F.when(column >= 1, column))),
        fingerprints=F.create_map(F.lit("horusec/v1"), F.sha2(source, 256)),
        properties=property_map(
            securityTool=tool, language=text.nonempty(get("language")),
            codeSnippet=text.nonempty(get("code")), confidence=text.nonempty(get("confidence"))),
        rule_name=F.concat(F.lit("horusec: "), tool),
        rule_description=F.concat(detected, F.lit(" via Horusec.")))), "horusec")


def _blank() -> Column:
    return text.strip(F.col("raw")) == ""


HORUSEC = Converter(
    "horusec", "horusec",
    parse_json("version string, analysisVulnerabilities array<struct<"
               f"vulnerabilities:{_VULNERABILITY},vulnerability:{_VULNERABILITY}>>"),
    _horusec, lambda: F.when(~_blank(), json_reason()), _version)


# --- cargo-audit -------------------------------------------------------------------------

def _cargo_audit(df: DataFrame) -> DataFrame:
    d = explode_items(df, F.col("doc.vulnerabilities.list"))
    get = lambda path, default="": _or(F.col(f"item.{path}"), default)
    advisory, title, url = get("advisory.id", "UNKNOWN"), get("advisory.title"), get("advisory.url")
    package, version = get("package.name", UNKNOWN), get("package.version", UNKNOWN)
    patched = F.col("item.versions.patched")
    patched_text = F.when(F.size(patched) > 0, F.array_join(patched, ", ")).otherwise("none")
    message = F.concat(advisory, F.lit(": "), title, F.lit(" in "), package, F.lit("@"), version,
                       F.lit(" (patched: "), patched_text, F.lit(")"),
                       F.when(url != "", F.concat(F.lit(" -- "), url)).otherwise(""))
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=F.concat(F.lit("cargo-audit/"), advisory), level=F.lit("error"), message=message,
        properties=property_map(package=package, version=version, advisory_url=url),
        rule_name=advisory,
        rule_description=text.first_nonempty(F.col("item.advisory.description"), title))),
        "cargo-audit")


CARGO_AUDIT = Converter(
    "cargo-audit", "cargo-audit",
    parse_json("vulnerabilities struct<list:array<struct<advisory:struct<id:string,title:string,"
               "description:string,url:string>,package:struct<name:string,version:string>,"
               "versions:struct<patched:array<string>>>>>"),
    _cargo_audit, json_reason)


# --- shellcheck --------------------------------------------------------------------------

def _shellcheck(df: DataFrame) -> DataFrame:
    d = explode_items(df, F.col("doc.items")).where(text.nonempty(F.col("item.file")).isNotNull())
    number = lambda name, default: F.coalesce(as_int(F.col(f"item.{name}")), default)
    from_one = lambda c: F.greatest(c, F.lit(1))
    line, column = number("line", F.lit(1)), number("column", F.lit(1))
    code = _or(F.col("item.code"), "0")
    rule = F.concat(F.lit("SC"), code)
    return finish(d.select(*KEYS, "result_idx", *fields(
        rule_id=rule, level=map_severity("shellcheck", _or(F.col("item.level"), "warning")),
        message=_or(F.col("item.message"), ""),
        locations=one_location(F.col("item.file"), from_one(line), from_one(column),
                               from_one(number("endLine", line)),
                               from_one(number("endColumn", column))),
        rule_name=F.concat(F.lit("ShellCheck "), rule),
        rule_description=F.concat(F.lit("shellcheck rule "), rule))), "shellcheck")


def _parse_shellcheck(df: DataFrame) -> DataFrame:
    # The report is a bare array: name it so that it parses like the other documents.
    wrapped = F.concat(F.lit('{"items":'), F.col("raw"), F.lit("}"))
    return compute_once(df, "doc", text.json_struct(
        wrapped, "items array<struct<file:string,line:string,`column`:string,endLine:string,"
                 "endColumn:string,level:string,code:string,message:string>>"))


SHELLCHECK = Converter(
    "shellcheck", "shellcheck", _parse_shellcheck, _shellcheck,
    lambda: F.coalesce(json_reason(), F.when(F.col("doc.items").isNull(), "not a JSON array")))


# --- cargo-udeps -------------------------------------------------------------------------

_KINDS = ("normal", "development", "build")


def _cargo_udeps(df: DataFrame) -> DataFrame:
    crates = df.select(*KEYS, F.posexplode(F.col("doc.unused_deps")).alias("crate_no", "crate",
                                                                           "text"))
    info = crates.withColumn("info", F.from_json(
        "text", "manifest_path string, normal string, development string, build string"))
    kinds = info.select(*KEYS, "crate_no", "crate", _or(F.col("info.manifest_path"), "").alias(
        "manifest"), F.posexplode(F.array(*[
            F.struct(F.lit(k).alias("kind"), F.from_json(F.col(f"info.{k}"), "array<string>")
                     .alias("names")) for k in _KINDS])).alias("kind_no", "k"))
    names = kinds.select(*KEYS, "crate_no", "crate", "manifest", "kind_no", "k.kind",
                         F.posexplode("k.names").alias("name_no", "name"))
    # A dependency is a plain name or an object that has one.
    name = F.when(F.col("name").startswith("{"), F.coalesce(
        F.get_json_object("name", "$.name"), F.col("name"))).otherwise(F.col("name"))
    message = F.concat(
        F.lit("Unused "), F.col("kind"), F.lit(" dependency '"), name, F.lit("' in crate '"),
        F.col("crate"), F.lit("'"),
        F.when(F.col("manifest") != "", F.concat(F.lit(" ("), F.col("manifest"), F.lit(")")))
        .otherwise(""))
    # Crate, kind and name positions packed into one ordinal (names of a kind fit 32 bits).
    place = (F.col("crate_no").cast("bigint") * 4 + F.col("kind_no")) * F.lit(1 << 32) + F.col(
        "name_no")
    return finish(names.select(*KEYS, *fields(
        result_idx=place, rule_id=F.lit(_UDEPS_RULE.rule_id), level=F.lit("warning"),
        message=message,
        properties=property_map(crate=F.col("crate"), dependency=name, kind=F.col("kind")))),
        "cargo-udeps")


_UDEPS_RULE = Rule("cargo-udeps/unused-dependency", "Unused dependency",
                   "A dependency declared in Cargo.toml is not used by the crate.")
CARGO_UDEPS = Converter("cargo-udeps", "cargo-udeps", parse_json("unused_deps map<string,string>"),
                        _cargo_udeps, json_reason, always=_UDEPS_RULE)


# --- lizard ------------------------------------------------------------------------------

_FUNCTION = ("struct<ccn:string,cyclomatic_complexity:string,cc:string,filename:string,file:string,"
             "name:string,`function`:string,function_name:string,start_line:string,start:string,"
             "line:string,end_line:string,`end`:string,nloc:string,token:string,"
             "token_count:string,param:string,parameter_count:string>")
_FILE = f"struct<filename:string,function_list:array<{_FUNCTION}>>"
# Column order of a report without header.
_CSV_COLUMNS = ["nloc", "ccn", "token", "param", "length", "location", "file", "function",
                "start", "end"]
# A record may hold quoted line breaks; a quote without an end reaches to the end of the report.
_CSV_RECORD = r'(?:[^"\r\n]++|"[^"]*+(?:"|\z))++'
_CSV_CELL = r',("[^"]*+(?:""[^"]*+)*+"?[^,]*+|[^,]*+)'


def lizard(threshold: int = 10) -> Converter:
    """Functions above a cyclomatic-complexity threshold, from JSON or CSV."""
    rule = Rule("lizard/high-cyclomatic-complexity", "High cyclomatic complexity",
                f"Function cyclomatic complexity exceeds threshold of {threshold}")
    trimmed = lambda: text.strip(F.col("raw"))
    is_json = lambda: F.col("body").startswith("{") | F.col("body").startswith("[")

    def parse(df: DataFrame) -> DataFrame:
        wrapped = F.when(F.col("body").startswith("["), F.concat(
            F.lit('{"files":'), F.col("body"), F.lit("}"))).when(
            F.col("body").startswith("{"), F.col("body"))
        return compute_once(compute_once(df, "body", trimmed()), "doc", text.json_struct(
            wrapped, f"files array<{_FILE}>, filename string, function_list array<{_FUNCTION}>"))

    def json_functions(df: DataFrame) -> DataFrame:
        whole = F.array(F.struct(F.col("doc.filename").alias("filename"),
                                 F.col("doc.function_list").alias("function_list")))
        files = df.where(is_json()).select(*KEYS, F.posexplode(
            F.coalesce("doc.files", whole)).alias("file_no", "f"))
        rows = files.select(*KEYS, "file_no", F.col("f.filename").alias("in_file"),
                            F.posexplode("f.function_list").alias("no", "fn")).where(
            F.col("fn").isNotNull())
        value = lambda k: F.col(f"fn.{k}")
        return assess(rows, value, F.coalesce(value("filename"), F.col("in_file")),
                      F.col("file_no").cast("bigint") * F.lit(1 << 32) + F.col("no"))

    def csv_functions(df: DataFrame) -> DataFrame:
        quoted = lambda x: F.when(x.startswith('"'), F.replace(F.regexp_replace(
            x, r'\A"|"\z', ""), F.lit('""'), F.lit('"'))).otherwise(x)
        # Every cell follows a comma, once one is put in front.
        cells = lambda line: F.transform(F.regexp_extract_all(F.concat(
            F.lit(","), line), F.lit(_CSV_CELL), F.lit(1)), lambda x: quoted(text.strip(x)))
        split = compute_once(df.where(~is_json()), "rows", F.regexp_extract_all(
            F.col("body"), F.lit(_CSV_RECORD), F.lit(0)))
        head = compute_once(split, "first", cells(F.get("rows", F.lit(0)))).withColumn(
            "first", F.transform("first", lambda x: F.lower(text.strip(x))))
        titled = F.arrays_overlap(F.col("first"), F.array(*[F.lit(x) for x in (
            "ccn", "nloc", "cyclomatic_complexity")]))
        named = compute_once(head, "titled", F.coalesce(titled, F.lit(False))).withColumn(
            "header", F.when(F.col("titled"), F.col("first")).otherwise(
                F.array(*[F.lit(x) for x in _CSV_COLUMNS])))
        rows = named.select(*KEYS, "titled", "header", F.posexplode("rows").alias("no", "line"))
        rows = rows.where(~(F.col("titled") & (F.col("no") == 0))
                          & (F.regexp_replace("line", r"[,\s]", "") != ""))
        rows = compute_once(rows, "cells", cells(F.col("line")))
        # Position 0 means the column is missing; reading cell -1 gives null.
        at = lambda k: text.strip(F.get("cells", (F.array_position("header", F.lit(k)) - 1)
                                        .cast("int")))
        return assess(rows, at, at("filename"), F.col("no").cast("bigint"))

    def assess(rows: DataFrame, value, filename: Column, place: Column) -> DataFrame:
        number = lambda *keys: F.coalesce(*[as_int(value(k)) for k in keys])
        complexity = number("ccn", "cyclomatic_complexity", "cc")
        counted = compute_once(rows, "cc_value", complexity).where(F.col("cc_value") > threshold)
        cc = F.col("cc_value").cast("string")
        name = text.first_nonempty(value("name"), value("function"), value("function_name"))
        start = F.coalesce(F.nullif(number("start_line", "start", "line"), F.lit(0)), F.lit(1))
        label = lambda title, *keys: F.concat(F.lit(f"{title}="), number(*keys).cast("string"))
        extras = F.concat_ws(", ", label("NLOC", "nloc"), label("tokens", "token", "token_count"),
                             label("params", "param", "parameter_count"))
        message = F.concat(
            F.lit("Function '"), name, F.lit("' has cyclomatic complexity "), cc,
            F.lit(f" (threshold {threshold})"),
            F.when(extras != "", F.concat(F.lit(" ["), extras, F.lit("]"))).otherwise(""))
        return counted.select(*KEYS, *fields(
            result_idx=place, rule_id=F.lit(rule.rule_id), level=F.lit("warning"), message=message,
            locations=one_location(text.first_nonempty(filename, value("file")), start, None,
                                   number("end_line", "end")),
            properties=property_map(cyclomaticComplexity=F.col("cc_value"), functionName=name)))

    def results(df: DataFrame) -> DataFrame:
        return finish(json_functions(df).unionByName(csv_functions(df)), "lizard")

    return Converter("lizard", "lizard", parse, results, lambda: F.when(is_json(), json_reason()),
                     always=rule, always_when=lambda: F.col("body") != "")


LIZARD = lizard()
