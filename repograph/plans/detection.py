"""Languages, frameworks and fitting tools of each repository."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from repograph.operators import detect


def detection(files: DataFrame, requested: DataFrame | None = None) -> DataFrame:
    """One row per repository: languages, frameworks and selected tools.

    `requested(repo, requested_languages, requested_tools)` overrides what was detected.
    """
    languages = detect.detected_languages(files)
    asked = languages.join(requested, "repo", "left") if requested is not None else languages
    none = F.array().cast("array<string>")
    return (languages.join(detect.detected_frameworks(files), "repo", "left")
            .join(detect.select_tools(asked), "repo")
            .select("repo", "languages", F.coalesce("frameworks", none).alias("frameworks"),
                    "tools"))
