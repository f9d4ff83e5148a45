"""Wiki structures and pages.

Pages are `(wiki_id, seq, id, title, importance, related, content, ...)`, sections
`(wiki_id, seq, id, title, pages, subsections)`; `seq` is the order inside the wiki.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from repograph.functions.text import (
    nonempty, page_summary, strip_control_characters, strip_xml_fences)
from repograph.operators.once import compute_once
from repograph.operators.ordering import first_n, first_n_salted, ordered_text
from repograph.operators.skew import salted_join
from repograph.stage import staged

# Title words of the page categories, tried in this order.
CATEGORIES = [
    ("overview", "Overview", ["overview", "introduction", "about"]),
    ("architecture", "Architecture", ["architecture", "structure", "design", "system"]),
    ("features", "Core Features", ["feature", "functionality", "core"]),
    ("components", "Components", ["component", "module", "widget"]),
    ("api", "API", ["api", "endpoint", "service", "server"]),
    ("data", "Data Flow", ["data", "flow", "pipeline", "storage"]),
    ("models", "Models", ["model", "ai", "ml", "integration"]),
    ("ui", "User Interface", ["ui", "interface", "frontend", "page"]),
    ("setup", "Setup & Configuration", ["setup", "config", "installation", "deploy"]),
    ("other", "Other", []),
]
# Section titles when pages are grouped by importance.
IMPORTANCE_SECTIONS = [("high", "Core Components"), ("medium", "Key Features"),
                       ("low", "Additional Information")]
# Fixed value: characters of wiki text that go into a prompt.
CONTENT_BUDGET = 30_000

_PAGE = ("struct<_id:string,title:string,importance:string,"
         "relevant_files:struct<file_path:array<string>>,"
         "related_pages:struct<related:array<string>>>")
_SECTION = ("struct<_id:string,title:string,pages:struct<page_ref:array<string>>,"
            "subsections:struct<section_ref:array<string>>>")


@dataclass(frozen=True)
class WikiStructure:
    wikis: DataFrame
    pages: DataFrame
    sections: DataFrame
    rejects: DataFrame


def parse_structures(responses: DataFrame) -> WikiStructure:
    """Read the first structure block in each `(wiki_id, response)`.

    Responses without a readable block go to `rejects`.
    """
    text = strip_xml_fences(F.col("response"))
    block = nonempty(F.regexp_extract(text, r"(?s)<wiki_structure>.*?</wiki_structure>", 0))
    doc = F.from_xml(strip_control_characters(F.col("block")),
                     f"title string, description string, pages struct<page:array<{_PAGE}>>, "
                     f"sections struct<section:array<{_SECTION}>>, _corrupt string",
                     {"columnNameOfCorruptRecord": "_corrupt", "ignoreSurroundingSpaces": "false"})
    blocks = compute_once(responses.select("wiki_id", "response"), "block", block)
    read = compute_once(blocks, "doc", doc).withColumn(
        "reason", F.when(F.col("block").isNull(), "no structure block").when(
            F.col("doc").isNull() | F.col("doc._corrupt").isNotNull(), "not well-formed"))
    good = read.where(F.col("reason").isNull())
    or_empty = lambda c: F.coalesce(c, F.lit(""))
    filled = lambda c: F.coalesce(F.filter(c, lambda x: nonempty(x).isNotNull()),
                                  F.array().cast("array<string>"))
    numbered = lambda kind: F.coalesce(nonempty(F.col("x._id")), F.concat(
        F.lit(f"{kind}-"), (F.col("seq") + 1).cast("string")))
    importance = F.col("x.importance")
    pages = good.select("wiki_id", F.posexplode("doc.pages.page").alias("seq", "x")).select(
        "wiki_id", "seq", numbered("page").alias("id"), or_empty(F.col("x.title")).alias("title"),
        F.when(importance.isNull(), "medium").when(importance.isin("high", "medium"), importance)
        .otherwise("low").alias("importance"),
        filled(F.col("x.relevant_files.file_path")).alias("file_paths"),
        filled(F.col("x.related_pages.related")).alias("related"))
    sections = good.select("wiki_id", F.posexplode("doc.sections.section").alias("seq", "x")).select(
        "wiki_id", "seq", numbered("section").alias("id"),
        or_empty(F.col("x.title")).alias("title"),
        filled(F.col("x.pages.page_ref")).alias("pages"),
        filled(F.col("x.subsections.section_ref")).alias("subsections"))
    wikis = good.select("wiki_id", or_empty(F.col("doc.title")).alias("title"),
                        or_empty(F.col("doc.description")).alias("description"))
    return WikiStructure(wikis, pages, sections, read.where(
        F.col("reason").isNotNull()).select("wiki_id", "reason"))


def first_by_id(rows: DataFrame) -> DataFrame:
    """First row of each id of a wiki."""
    return first_n(rows, ["wiki_id", "id"], ["seq"], 1)


def root_sections(sections: DataFrame) -> DataFrame:
    """Sections no section refers to."""
    named = sections.select("wiki_id", F.explode("subsections").alias("id")).distinct()
    return sections.join(named, ["wiki_id", "id"], "left_anti")


def section_tree(sections: DataFrame) -> DataFrame:
    """Sections as shown: `(wiki_id, place, level, id, title)`, sorted by `place`.

    A section shows once per reference; unknown references and references back to a section on the
    way are skipped, so cycles end.

    Ways from the roots double in length: round r joins the ways of fewer than 2**r references with
    the jumps, which are all ways of exactly 2**r references from any section, and then the jumps
    with each other. A tree of depth d takes about log2(d) rounds. Without cycles every jump is the
    end of a shown way, so there are never more of them than rows of the result. Rounds are written
    out, which keeps the plans short.
    """
    known = first_by_id(sections).select("wiki_id", "id", "seq", "title", "subsections")
    place_type = sections.schema["seq"].dataType
    jumps = staged(known.select("wiki_id", F.col("id").alias("start"), F.posexplode(
        "subsections").alias("nth", "end")).where("start <> end").join(
        known.select("wiki_id", F.col("id").alias("end")), ["wiki_id", "end"]).select(
        "wiki_id", "start", "end", F.array(F.col("nth").cast(place_type)).alias("steps"),
        F.array("end").alias("way")))
    ways = staged(root_sections(sections).select("wiki_id", "seq", "id").join(
        known.select("wiki_id", "id"), ["wiki_id", "id"]).select(
        "wiki_id", "id", F.array("seq").alias("place"), F.array("id").alias("way")))
    while True:
        first, then = ways.alias("f"), jumps.alias("t")
        longer = staged(first.join(then, F.expr("f.wiki_id = t.wiki_id AND f.id = t.start")).where(
            "NOT arrays_overlap(f.way, t.way)").selectExpr(
            "f.wiki_id", "t.end AS id", "concat(f.place, t.steps) AS place",
            "concat(f.way, t.way) AS way"))
        # Longer ways begin with one of exactly 2**r references, so none is left when none is found.
        if longer.isEmpty():
            break
        ways = ways.unionByName(longer)
        first = jumps.alias("f")
        jumps = staged(first.join(then, F.expr("f.wiki_id = t.wiki_id AND f.end = t.start")).where(
            "NOT arrays_overlap(f.way, t.way) AND NOT array_contains(t.way, f.start)").selectExpr(
            "f.wiki_id", "f.start", "t.end", "concat(f.steps, t.steps) AS steps",
            "concat(f.way, t.way) AS way"))
    return ways.join(known.select("wiki_id", "id", "title"), ["wiki_id", "id"]).select(
        "wiki_id", "place", (F.size("place") - 1).alias("level"), "id", "title")


def tree_pages(tree: DataFrame, sections: DataFrame, pages: DataFrame) -> DataFrame:
    """Pages below each shown section; unknown pages are skipped."""
    listed = first_by_id(sections).select("wiki_id", "id", F.posexplode("pages").alias(
        "nth", "page_id"))
    known = first_by_id(pages).select("wiki_id", F.col("id").alias("page_id"),
                                      F.col("title").alias("page_title"), "importance")
    return tree.join(listed, ["wiki_id", "id"]).join(known, ["wiki_id", "page_id"]).select(
        "wiki_id", "place", "level", F.col("id").alias("section_id"), "nth", "page_id",
        "page_title", "importance")


def flat_pages(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages of the wikis that have no root section: shown as a plain list."""
    rooted = root_sections(sections).select("wiki_id").distinct()
    return salted_join(pages, rooted, ["wiki_id"], ["seq"], "left_anti")


def related_links(pages: DataFrame) -> DataFrame:
    """Links to related pages, in the order they are named; unknown pages drop out."""
    named = pages.select("wiki_id", "seq", F.posexplode("related").alias("nth", "id"))
    known = first_by_id(pages).select("wiki_id", "id", "title")
    link = F.concat(F.lit("["), "title", F.lit("](#"), "id", F.lit(")"))
    # A page many others name is one key of this join.
    return salted_join(named, known, ["wiki_id", "id"], ["seq", "nth"]).groupBy("wiki_id", "seq").agg(ordered_text(
        F.collect_list(F.struct("nth", link.alias("text"))), ", ").alias("links"))


def with_generated_content(pages: DataFrame, generated: DataFrame) -> DataFrame:
    """Pages with their generated `(wiki_id, id, content)`, or a remark that there is none."""
    return pages.join(generated.select("wiki_id", "id", "content"), ["wiki_id", "id"],
                      "left").withColumn("content", F.coalesce(
                          nonempty(F.col("content")), F.lit("Content not generated")))


def pages_by_importance(pages: DataFrame, importance: str) -> DataFrame:
    return pages.where(F.col("importance") == importance)


def page_category() -> Column:
    """Number of the first category with a word in the title."""
    low, out = F.lower("title"), F.lit(len(CATEGORIES) - 1)
    for n, (_, _, words) in reversed(list(enumerate(CATEGORIES[:-1]))):
        hit = F.lit(False)
        for w in words:
            hit = hit | low.contains(w)
        out = F.when(hit, n).otherwise(out)
    return out


def _sections_from(pages: DataFrame, number: Column, names: list[tuple[str, str]]) -> DataFrame:
    """One row per page with its made-up section. Page lists are rows: a wiki may be large."""
    at = lambda i: F.element_at(F.array(*[F.lit(x[i]) for x in names]), number + 1)
    return pages.where(number.isNotNull()).select(
        "wiki_id", number.alias("section_no"), F.concat(F.lit("section-"), at(0)).alias(
            "section_id"), at(1).alias("section_title"), "seq", F.col("id").alias("page_id"))


def sections_by_category(pages: DataFrame) -> DataFrame:
    """Sections for wikis that have none, by words in the page titles."""
    return _sections_from(pages, page_category(), [(c[0], c[1]) for c in CATEGORIES])


def sections_by_importance(pages: DataFrame) -> DataFrame:
    """Sections by importance of the pages."""
    levels = F.array(*[F.lit(x) for x, _ in IMPORTANCE_SECTIONS])
    number = F.nullif(F.array_position(levels, F.col("importance")), F.lit(0)) - 1
    return _sections_from(pages, number.cast("int"), IMPORTANCE_SECTIONS)


def content_within_budget(pages: DataFrame, budget: int = CONTENT_BUDGET) -> DataFrame:
    """Page texts for a prompt: `(wiki_id, position, id, mode, text)`.

    Important pages come first and whole, until the budget is passed; then the others, each whole
    if it fits and as its summary if not, until the budget is passed. The added length depends on
    the choice before, so it is a fold - over lengths only. Each page adds at least six
    characters, hence the first `budget / 6 + 2` pages of a wiki always contain all that is shown.
    """
    whole = F.concat(F.lit("## "), "title", F.lit("\n"), "content", F.lit("\n\n"))
    short = F.concat(F.lit("## "), "title", F.lit("\n"), page_summary(F.col("content")),
                     F.lit("\n\n"))
    filled = pages.where(nonempty(F.col("content")).isNotNull())
    sized = filled.select(
        "wiki_id", "seq", (F.col("importance") != "high").alias("later"),
        F.length(whole).alias("whole"), F.length(short).alias("short"))
    near = first_n_salted(sized, ["wiki_id"], ["later", "seq"], budget // 6 + 2, F.col("seq"))
    entries = near.groupBy("wiki_id").agg(F.array_sort(F.collect_list(F.struct(
        "later", "seq", "whole", "short"))).alias("entries"))

    def step(state, e):
        over = state["total"] > budget
        # The others are only looked at when the important pages left room.
        closed = e["later"] & (state["important"] >= budget)
        fits = state["total"] + e["whole"] <= budget
        mode = (F.when(over | closed, "none").when(~e["later"] | fits, "whole").otherwise("summary"))
        added = F.when(over | closed, 0).when(~e["later"] | fits, e["whole"]).otherwise(e["short"])
        total = (state["total"] + added).cast("bigint")
        return F.struct(
            total.alias("total"),
            F.when(e["later"], state["important"]).otherwise(total).alias("important"),
            F.array_append(state["shown"], F.struct(e["seq"].alias("seq"), mode.alias("mode"))
                           ).alias("shown"))

    seq_type = pages.schema["seq"].dataType.simpleString()
    start = F.struct(F.lit(0).cast("bigint").alias("total"), F.lit(0).cast("bigint").alias(
        "important"), F.array().cast(f"array<struct<seq:{seq_type},mode:string>>").alias("shown"))
    shown = entries.select("wiki_id", F.posexplode(F.aggregate(
        "entries", start, step, lambda s: s["shown"])).alias("position", "s")).select(
        "wiki_id", "position", F.col("s.seq").alias("seq"), F.col("s.mode").alias("mode"))
    return filled.join(shown.where("mode != 'none'"), ["wiki_id", "seq"]).select(
        "wiki_id", "position", "id", "mode",
        F.when(F.col("mode") == "whole", whole).otherwise(short).alias("text"))


_TITLE, _CONTENTS, _PAGES = range(3)
EXPORT_ORDER = ["part", "seq"]


def markdown_export(wikis: DataFrame, pages: DataFrame, generated_at: str) -> DataFrame:
    """Each wiki as one Markdown text, in fragments ordered by EXPORT_ORDER.

    `wikis(wiki_id, repo_url)` names the repositories.
    """
    head = wikis.select(
        "wiki_id", F.lit(_TITLE).alias("part"), F.lit(-1).cast("bigint").alias("seq"),
        F.concat(F.lit("# Wiki Documentation for "), "repo_url", F.lit("\n\nGenerated on: "),
                 F.lit(generated_at), F.lit("\n\n## Table of Contents\n\n")).alias("text"))
    place = lambda part: (F.lit(part).alias("part"), F.col("seq").cast("bigint").alias("seq"))
    toc = pages.select("wiki_id", *place(_CONTENTS), F.concat(
        F.lit("- ["), "title", F.lit("](#"), "id", F.lit(")\n")).alias("text"))
    linked = pages.join(related_links(pages), ["wiki_id", "seq"], "left")
    related = F.when(F.size("related") > 0, F.concat(
        F.lit("### Related Pages\n\n"), F.when(F.col("links").isNotNull(), F.concat(
            F.lit("Related topics: "), "links", F.lit("\n\n"))).otherwise(""))).otherwise("")
    body = linked.select("wiki_id", *place(_PAGES), F.concat(
        F.lit("<a id='"), "id", F.lit("'></a>\n\n## "), "title", F.lit("\n\n"), related, "content",
        F.lit("\n\n---\n\n")).alias("text"))
    # A blank line closes the table of contents.
    blank = wikis.select("wiki_id", F.lit(_PAGES).alias("part"), F.lit(-1).cast("bigint").alias(
        "seq"), F.lit("\n").alias("text"))
    return head.unionByName(toc).unionByName(blank).unionByName(body)


def json_export(wikis: DataFrame, pages: DataFrame, generated_at: str) -> DataFrame:
    """Each wiki as one JSON text, in fragments ordered by EXPORT_ORDER."""
    counts = pages.groupBy("wiki_id").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("first"))
    known = wikis.join(counts, "wiki_id", "left")
    meta = F.to_json(F.struct(
        F.col("repo_url").alias("repository"), F.lit(generated_at).alias("generated_at"),
        F.coalesce("n", F.lit(0)).alias("page_count")))
    edge = lambda part, seq, text: known.select(
        "wiki_id", F.lit(part).alias("part"), F.lit(seq).cast("bigint").alias("seq"),
        text.alias("text"))
    page = F.to_json(F.struct(
        "id", "title", "content", F.col("file_paths").alias("filePaths"), "importance",
        F.col("related").alias("relatedPages")))
    body = salted_join(pages, counts, ["wiki_id"], ["seq"]).select(
        "wiki_id", F.lit(_PAGES).alias("part"), F.col("seq").cast("bigint").alias("seq"), F.concat(
            F.when(F.col("seq") == F.col("first"), "").otherwise(","), page).alias("text"))
    return edge(_TITLE, -1, F.concat(F.lit('{"metadata":'), meta, F.lit(',"pages":['))).unionByName(
        body).unionByName(edge(_PAGES + 1, 0, F.lit("]}")))
