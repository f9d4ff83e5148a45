"""Ignore-file patterns."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F, types as T

_SPECIAL = set(".^$+{}()|\\")


def _segment(seg: str) -> str:
    """Regular expression of one path segment."""
    out, i = [], 0
    while i < len(seg):
        ch = seg[i]
        close = seg.find("]", i + 2) if ch == "[" else -1
        if ch == "\\" and i + 1 < len(seg):
            i += 1
            out.append("\\" + seg[i] if not seg[i].isalnum() else seg[i])
        elif ch == "*":
            out.append("[^/]*")
        elif ch == "?":
            out.append("[^/]")
        elif close > 0:
            body = seg[i + 1:close]
            negated = body[0] in "!^"
            body = (body[1:] if negated else body).replace("\\", "\\\\").replace("[", "\\[")
            out.append(f"[{'^' if negated else ''}{body}]")
            i = close
        else:
            out.append("\\" + ch if ch in _SPECIAL or ch == "[" else ch)
        i += 1
    return "".join(out)


def pattern_regex(line: str) -> tuple[str, bool] | None:
    """Anchored expression over a path relative to the ignore file, and whether it negates.

    Directories are matched with a trailing slash. Blank lines and comments give nothing.
    """
    text = line.rstrip("\r\n")
    while text.endswith(" ") and not text.endswith("\\ "):
        text = text[:-1]
    if not text or text.startswith("#"):
        return None
    negated = text.startswith("!")
    text = text[1:] if negated else text
    only_dirs = text.endswith("/")
    segments = [s for s in text.split("/")]
    anchored = "/" in text.rstrip("/")
    segments = [s for s in segments if s != ""]
    if not segments:
        return None
    head = "" if anchored or segments[0] == "**" else "(?:.+/)?"
    parts = []
    for n, seg in enumerate(segments):
        last = n == len(segments) - 1
        if seg == "**":
            parts.append(".*" if last else "(?:.+/)?")
        else:
            parts.append(_segment(seg) + ("" if last else "/"))
    tail = "" if segments[-1] == "**" else "/.*" if only_dirs else "(?:/.*)?"
    return rf"(?s)\A{head}{''.join(parts)}{tail}\z", negated


_COMPILED = T.StructType().add("regex", T.StringType()).add("negated", T.BooleanType())


@F.pandas_udf(_COMPILED)
def compiled_pattern(lines: pd.Series) -> pd.DataFrame:
    """Patterns compiled once each; the matching itself runs in Spark."""
    found = [pattern_regex(x) or (None, None) for x in lines]
    return pd.DataFrame(found, columns=["regex", "negated"])
