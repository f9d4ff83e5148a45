"""Generated wiki texts: slide plans, tables of contents, exercise marks."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from repograph.functions.text import strip

# The plan shapes tried in order, and the slides used when none fits.
_NUMBERED = r"\d+\.\s+(.*?)(?=\n\d+\.|\n*\z)"
_BRACKETED = r"\d+\)\s+(.*?)(?=\n\d+\)|\n*\z)"
_NAMED = r"(?i)Slide\s+\d+\s*:?\s*(.*?)(?=\nSlide|\n*\z)"
_ANY_LINE = r"(?m)^([^:\n]+)(?::\s*(.*?))?$"
_DEFAULT_SLIDES = (
    "Title Slide: Introduction to {repo}", "Overview: Key features and purpose of {repo}",
    "Architecture: System components and structure",
    "Features: Main capabilities and functionalities",
    "Implementation: How it works and technical details",
    "Use Cases: How to use {repo} effectively", "Conclusion: Summary and next steps")
# Fixed value: the style of inserted remarks.
_REMARK = '<div style="text-align: right; font-size: 0.85em; color: #666;">\n{}\n</div>\n\n'


def slide_plan(plan: Column, repo: Column) -> Column:
    """Array of (title, description) slides."""
    found = lambda pattern: F.regexp_extract_all(plan, F.lit(pattern), F.lit(1))
    plain = F.filter(found(_ANY_LINE), lambda x: (F.length(x) > 3) & ~F.lower(x).contains("please")
                     & ~F.lower(x).contains("here"))
    default = F.array(*[F.replace(F.lit(s), F.lit("{repo}"), repo) for s in _DEFAULT_SLIDES])
    options = [found(_NUMBERED), found(_BRACKETED), found(_NAMED), plain]
    chosen = F.coalesce(*[F.when(F.size(o) > 0, o) for o in options], default)
    part = lambda s, n: strip(F.coalesce(F.get(F.split(s, ":"), F.lit(n)), F.lit("")))
    return F.transform(chosen, lambda s: F.struct(
        part(s, 0).alias("title"), part(s, 1).alias("description")))


def heading_slug(heading: Column) -> Column:
    kept = F.regexp_replace(F.lower(heading), r"[^a-zA-Z0-9_\s-]", "")
    return F.regexp_replace(kept, r"\s+", "-")


def with_contents(content: Column) -> Column:
    """Insert a table of contents before the first section after the introduction heading."""
    headings = F.regexp_extract_all(content, F.lit(r"(?m)^## (.*)$"), F.lit(1))
    entries = F.array_join(F.transform(headings, lambda h: F.concat(
        F.lit("- ["), h, F.lit("](#"), heading_slug(h), F.lit(")\n"))), "")
    toc = F.concat(F.lit("## Table of Contents\n\n"), entries, F.lit("\n"))
    intro = F.instr(content, "# ")
    following = F.position(F.lit("## "), content, intro + 1) - 1
    has = content.contains("## Table of Contents") | content.contains("## Contents")
    inserted = F.concat(F.substr(content, F.lit(1), following), toc,
                        F.substr(content, following + 1))
    return F.when(~has & (F.size(headings) > 0) & (following > intro), inserted).otherwise(content)


def _after_line(content: Column, mark: Column, remark: Column) -> Column:
    """Insert text after the line in which a mark first occurs."""
    start = F.position(mark, content)
    end = F.position(F.lit("\n"), content, start)
    inserted = F.concat(F.substr(content, F.lit(1), end), remark, F.substr(content, end + 1))
    return F.when((start > 0) & (end > 0), inserted).otherwise(content)


def exercise_minutes(index: Column, count: Column) -> Column:
    """Time by place: first 5, last 15, after the middle 12, otherwise 10 minutes."""
    return (F.when(index == 0, 5).when(index == count - 1, 15)
            .when(index > F.floor(count / 2), 12).otherwise(10))


def with_exercise_marks(content: Column) -> Column:
    """Add `i of n` and a time estimate below each exercise heading."""
    headings = F.regexp_extract_all(content, F.lit(r"(?m)^(## Exercise \d+:)"), F.lit(1))
    remarks = F.transform(headings, lambda h, i: F.struct(h.alias("mark"), F.format_string(
        _REMARK.format("Exercise %d of %d | Estimated time: %d minutes"), i + 1, F.size(headings),
        exercise_minutes(i, F.size(headings)).cast("int")).alias("remark")))
    return F.aggregate(remarks, content, lambda text, r: _after_line(text, r["mark"], r["remark"]))


def with_project_note(content: Column) -> Column:
    """Add a remark below the final-project heading."""
    mark = F.lit("## Final Project")
    noted = _after_line(content, mark, F.lit(_REMARK.format(
        "Estimated time: 20-30 minutes | Combines concepts from all exercises")))
    return F.when(content.rlike(r"(?m)^## Final Project"), noted).otherwise(content)
