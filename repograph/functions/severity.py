"""Severity vocabularies of the tools, mapped onto the four SARIF levels."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from repograph.functions.text import strip
from repograph.model import LEVELS

# Words any tool may use.
GENERIC_WORDS = {
    "critical": "error", "high": "error", "fatal": "error", "blocker": "error",
    "error": "error", "err": "error", "fail": "error", "failure": "error",
    "medium": "warning", "moderate": "warning", "warning": "warning", "warn": "warning",
    "major": "warning",
    "low": "note", "info": "note", "information": "note", "informational": "note",
    "minor": "note", "hint": "note", "style": "note", "suggestion": "note",
    "refactor": "note", "convention": "note",
    "none": "none", "unknown": "none",
}
# Words with a meaning of their own in one tool.
TOOL_WORDS = {
    "pyright": {"error": "error", "warning": "warning", "information": "note"},
    "semgrep": {"info": "note", "warning": "warning", "error": "error"},
    "bandit": {"low": "note", "medium": "warning", "high": "error"},
    "trivy": {"critical": "error", "high": "error", "medium": "warning", "low": "note",
              "unknown": "none"},
    "ruff": {"error": "error", "warning": "warning", "info": "note"},
    "phpcs": {"error": "error", "warning": "warning"},
    "horusec": {"critical": "error", "high": "error", "medium": "warning", "low": "note",
                "info": "note"},
    "trufflehog": {"verified": "error", "unverified": "warning"},
    "detect-secrets": {"true positive": "error", "possible": "warning"},
    "checkov": {"critical": "error", "high": "error", "medium": "warning", "low": "note"},
}


class SeverityVocabulary:
    """Tool words over generic words; `register_tool` returns an extended vocabulary."""

    def __init__(self, tools: dict[str, dict[str, str]] | None = None):
        self.tools = TOOL_WORDS if tools is None else tools

    def register_tool(self, tool: str, words: dict[str, str]) -> "SeverityVocabulary":
        """Replace one tool's words. Targets must be SARIF levels."""
        wrong = sorted(set(words.values()) - set(LEVELS))
        if wrong:
            raise ValueError(f"not SARIF levels: {wrong}")
        mine = {word.lower(): level for word, level in words.items()}
        return SeverityVocabulary({**self.tools, tool.lower(): mine})

    def level(self, tool: Column | str, severity: Column) -> Column:
        """Level of a severity word; unknown words are warnings."""
        word = F.lower(strip(severity))
        if isinstance(tool, str):
            own = self.tools.get(tool.lower(), {})
            override = _lookup({w: lv for w, lv in own.items()}, word)
        else:
            flat = {f"{t}\n{w}": lv for t, ws in self.tools.items() for w, lv in ws.items()}
            override = _lookup(flat, F.concat(F.lower(tool), F.lit("\n"), word))
        return F.coalesce(override, F.when(word.isin(*LEVELS), word),
                          _lookup(GENERIC_WORDS, word), F.lit("warning"))


def _lookup(words: dict[str, str], key: Column) -> Column:
    if not words:
        return F.lit(None).cast("string")
    pairs = [F.lit(x) for kv in words.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


DEFAULT_VOCABULARY = SeverityVocabulary()


def map_severity(tool: Column | str, severity: Column,
                 vocabulary: SeverityVocabulary = DEFAULT_VOCABULARY) -> Column:
    return vocabulary.level(tool, severity)


def vocabulary_table(spark: SparkSession,
                     vocabulary: SeverityVocabulary = DEFAULT_VOCABULARY) -> DataFrame:
    """The tool words as a table `(tool, word, level)`."""
    rows = [(t, w, lv) for t, ws in vocabulary.tools.items() for w, lv in ws.items()]
    return spark.createDataFrame(rows, "tool string, word string, level string")


def invalid_vocabulary_rows(vocabulary: DataFrame) -> DataFrame:
    """Registered words whose target is not a SARIF level."""
    return vocabulary.where(~F.col("level").isin(*LEVELS) | F.col("level").isNull())


def map_with_vocabulary(df: DataFrame, vocabulary: DataFrame, tool: str = "tool",
                        severity: str = "native_severity") -> DataFrame:
    """Add `level` using a vocabulary held as a table instead of literals."""
    words = vocabulary.groupBy(F.lower("tool").alias("_tool"), F.lower("word").alias("_word")).agg(
        F.max("level").alias("_level"))
    word = F.lower(strip(F.col(severity)))
    keyed = df.withColumn("_tool", F.lower(tool)).withColumn("_word", word)
    fallback = SeverityVocabulary({}).level("", F.col(severity))
    return keyed.join(words, ["_tool", "_word"], "left").withColumn(
        "level", F.coalesce("_level", fallback)).drop("_tool", "_word", "_level")
