"""From structure answers and generated pages to exportable wikis."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F

from repograph.operators import wiki


@dataclass(frozen=True)
class Wikis:
    pages: DataFrame
    sections: DataFrame
    roots: DataFrame
    page_sections: DataFrame
    rejects: DataFrame


def build_wikis(responses: DataFrame, generated: DataFrame) -> Wikis:
    """Parse structures and attach contents. Wikis without root section get sections by title."""
    parsed = wiki.parse_structures(responses)
    pages = wiki.with_generated_content(parsed.pages, generated)
    given = wiki.first_by_id(parsed.sections).select(
        "wiki_id", F.col("seq").alias("section_no"), F.col("id").alias("section_id"),
        F.col("title").alias("section_title"), F.posexplode("pages").alias("seq", "page_id"))
    made = wiki.sections_by_category(wiki.flat_pages(parsed.pages, parsed.sections))
    return Wikis(pages, parsed.sections, wiki.root_sections(parsed.sections),
                 given.unionByName(made), parsed.rejects)
