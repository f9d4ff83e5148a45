"""String functions used by several operators."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# White space as Unicode defines it, plus the four ASCII separator controls.
_SPACE = r"[\s\x1c-\x1f]"
_SPACES = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005"
           "\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


def nonempty(c: Column) -> Column:
    """The value, or null when it is the empty string."""
    return F.nullif(c, F.lit(""))


def first_nonempty(*cols: Column) -> Column:
    """First value that is neither null nor empty, else the empty string."""
    return F.coalesce(*[nonempty(c) for c in cols], F.lit(""))


def strip(c: Column) -> Column:
    """Remove Unicode white space at both ends. No regular expression: this runs on every field."""
    return F.btrim(c, F.lit(_SPACES))


def lines(c: Column) -> Column:
    """Split at every line boundary, without a trailing empty line."""
    return F.split(F.regexp_replace(c, r"\R\z", ""), r"\R|[\x1c-\x1e]")


def json_struct(raw: Column, schema: str) -> Column:
    """Parse strict JSON; `_corrupt` holds the text when it does not fit the schema."""
    return F.from_json(raw, f"{schema}, _corrupt string",
                       {"columnNameOfCorruptRecord": "_corrupt", "allowSingleQuotes": "false"})


def token_count(text: Column) -> Column:
    """Token estimate: four characters to a token."""
    return F.floor(F.length(text) / 4).cast("bigint")


def word_count(text: Column) -> Column:
    """Number of white-space separated words."""
    return F.size(F.filter(F.split(text, rf"(?U){_SPACE}+"), lambda w: w != "")).cast("bigint")


def normalise_rule(rule_id: Column) -> Column:
    """Rule id without its tool prefix, lower case."""
    return F.lower(F.regexp_replace(rule_id, r"^[^/]*/", ""))


def normalise_message(message: Column) -> Column:
    """Message with ids, quoted text and white space made comparable."""
    text = strip(F.lower(message))
    text = F.regexp_replace(text, r"(?U)\b[0-9a-f]{8,}\b", "<hash>")
    text = F.regexp_replace(text, r"""['"][^'"]*['"]""", "<str>")
    return F.regexp_replace(text, r"(?U)[\s\x1c-\x1f]+", " ")


def finding_fingerprint(uri: Column, line: Column, rule_id: Column, message: Column) -> Column:
    """Hash of place, rule and message after normalisation."""
    return F.sha2(F.concat_ws(":", F.coalesce(uri, F.lit("")),
                              F.coalesce(line, F.lit(0)).cast("string"),
                              normalise_rule(F.coalesce(rule_id, F.lit(""))),
                              normalise_message(F.coalesce(message, F.lit("")))), 256)


def redact(secret: Column, visible: int = 4) -> Column:
    """Keep the first characters of a secret; short secrets vanish entirely."""
    return F.when(F.length(secret) <= visible, F.lit("****")).otherwise(
        F.concat(F.substring(secret, 1, visible), F.lit("****")))


def strip_fences(text: Column, language: str) -> Column:
    """Remove an opening fence (with the given language tag) and a closing fence."""
    opened = F.regexp_replace(text, rf"(?i)\A```{language}\s*", "")
    return F.regexp_replace(opened, r"```\s*\z", "")


def strip_markdown_fences(text: Column) -> Column:
    return strip_fences(text, "markdown")


def strip_xml_fences(text: Column) -> Column:
    return strip_fences(text, "(?:xml)?")


def strip_control_characters(text: Column) -> Column:
    """Drop control characters that XML does not allow, keeping tab and line ends."""
    return F.regexp_replace(text, r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]", "")


def page_summary(content: Column) -> Column:
    """First paragraph after a heading."""
    found = F.regexp_extract(content, r"# [^\n\r]*?\n\n([^\n\r]*?)(?:\n\n|\z)", 1)
    has = content.rlike(r"# [^\n\r]*?\n\n[^\n\r]*?(?:\n\n|\z)")
    return F.when(has, strip(found)).otherwise(F.lit("No summary available"))


def duration_label(seconds: Column) -> Column:
    """Seconds below a minute, otherwise minutes, with one decimal."""
    return F.when(seconds < 60, F.format_string("%.1fs", seconds.cast("double"))).otherwise(
        F.format_string("%.1fm", (seconds / 60).cast("double")))


def decode_list_parameter(value: Column) -> Column:
    """Newline-separated, URL-encoded list without blank entries."""
    parts = F.filter(F.split(value, "\n"), lambda x: strip(x) != "")
    # A plus sign stays a plus sign: only percent escapes are decoded. Broken escapes stay as text.
    return F.transform(parts, lambda x: F.coalesce(
        F.try_url_decode(F.regexp_replace(x, r"\+", "%2B")), x))
