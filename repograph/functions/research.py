"""What a research answer says about its own progress."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The tag that marks a research request, and the phrases that end one.
RESEARCH_TAG = "[DEEP RESEARCH]"
FINAL_ITERATION = 5
_CLOSING_PHRASES = (
    "This concludes our research", "This completes our investigation",
    "This concludes the deep research process", "Key Findings and Implementation Details",
    "In conclusion,")


def _has(content: Column, *phrases: str) -> Column:
    found = F.lit(False)
    for p in phrases:
        found = found | content.contains(p)
    return found


def without_tag(content: Column) -> Column:
    return F.trim(F.replace(content, F.lit(RESEARCH_TAG), F.lit("")))


def research_complete(content: Column) -> Column:
    """Whether an answer reads as the end of the research."""
    closed = _has(content, "## Conclusion", "## Summary") & ~_has(
        content, "I will now proceed to", "Next Steps", "next iteration")
    said = _has(content, *_CLOSING_PHRASES) | (_has(content, "Final") & _has(content, "Conclusion"))
    on_file = (_has(content, "Dockerfile") & _has(content, "This Dockerfile", "The Dockerfile")
               & ~_has(content, "Next Steps", "In the next iteration"))
    return _has(content, "## Final Conclusion") | closed | said | on_file


def research_stage(content: Column, iteration: Column) -> Column:
    """Struct of title, type and iteration; null when the answer shows no stage."""
    update = F.concat(F.lit("Research Update "), iteration.cast("string"))
    stage = lambda title, kind: F.struct(
        title.alias("title"), F.lit(kind).alias("type"), iteration.cast("int").alias("iteration"))
    heading = F.concat(F.lit("## "), update)
    return (F.when((iteration == 1) & _has(content, "## Research Plan"),
                   stage(F.lit("Research Plan"), "plan"))
            .when(iteration.between(1, 4) & F.contains(content, heading), stage(update, "update"))
            .when(_has(content, "## Final Conclusion"),
                  stage(F.lit("Final Conclusion"), "conclusion")))
