"""Tools that print XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions import text
from repograph.functions.severity import map_severity
from repograph.model import one_location
from repograph.normalize.base import KEYS, Converter, as_int, fields, finish
from repograph.operators.once import compute_once

_ITEM = ("struct<_tag:string,_line:string,_column:string,_severity:string,_message:string,"
         "_source:string>")


def _parse(df: DataFrame) -> DataFrame:
    # All children of a file become <item tag="...">, which keeps their document order.
    opened = F.regexp_replace("raw", r"<(?!(?:checkstyle|file)\b)([A-Za-z][\w.-]*)",
                              '<item tag="$1"')
    same = F.regexp_replace(opened, r"</(?!(?:checkstyle|file)\b)[A-Za-z][\w.-]*", "</item")
    return compute_once(df, "doc", F.from_xml(
        same, f"_version string, file array<struct<_name:string,item:array<{_ITEM}>>>, "
              "_corrupt string", {"columnNameOfCorruptRecord": "_corrupt"}))


def _phpcs(df: DataFrame) -> DataFrame:
    files = df.select(*KEYS, F.posexplode("doc.file").alias("file_no", "f"))
    d = files.select(*KEYS, "file_no", F.coalesce("f._name", F.lit("")).alias("file"),
                     F.posexplode("f.item").alias("no", "item"))
    source = F.coalesce("item._source", F.lit("phpcs/unknown-rule"))
    severity = F.coalesce("item._severity", "item._tag")
    return finish(d.select(*KEYS, *fields(
        result_idx=F.col("file_no").cast("bigint") * F.lit(1 << 32) + F.col("no"),
        rule_id=text.first_nonempty(source, F.lit("phpcs/unknown-rule")),
        level=map_severity("phpcs", severity), message=F.coalesce("item._message", F.lit("")),
        locations=one_location(F.col("file"), F.coalesce(as_int(F.col("item._line")), F.lit(1)),
                               as_int(F.col("item._column"))),
        rule_name=source, rule_description=F.concat(F.lit("PHP_CodeSniffer rule: "), source))),
        "PHP_CodeSniffer")


def _reason() -> Column:
    return F.when(F.col("doc").isNull() | F.col("doc._corrupt").isNotNull(), "not XML")


PHPCS = Converter("phpcs", "PHP_CodeSniffer", _parse, _phpcs, _reason,
                  lambda: F.coalesce("doc._version", F.lit("unknown")))
