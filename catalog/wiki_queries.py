"""Queries over wikis."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import views
from catalog.registry import ORACLES, query, table
from catalog.views import WIKI_PAGES
from repograph.functions import text, wiki_text
from repograph.operators import wiki
from repograph.sources import wiki_store
from repograph.stage import stage_folder

c = F.col
P = f"pages_v AS ({WIKI_PAGES})"


def pages(spark, sf):
    return views.wiki_pages(spark, sf).withColumns({
        "related": F.array("related_1", "related_2"),
        "file_paths": F.array(F.concat(F.lit("src/"), "id"))})


LINKS = f"""{P}, named AS (SELECT wiki_id, seq, 1 AS nth, related_1 AS id FROM pages_v UNION ALL
  SELECT wiki_id, seq, 2, related_2 FROM pages_v),
links AS (SELECT n.wiki_id, n.seq, string_agg('[' || p.title || '](#' || p.id || ')', ', ' ORDER BY nth)
  AS links FROM named n JOIN pages_v p ON p.wiki_id = n.wiki_id AND p.id = n.id
  GROUP BY n.wiki_id, n.seq)"""


@query("related_links", f"WITH {LINKS} SELECT * FROM links")
def related_links(spark, sf):
    return wiki.related_links(pages(spark, sf))


@query("generated_contents", f"""WITH {P}
SELECT id, CASE WHEN seq % 4 = 0 OR seq % 7 = 0 THEN 'Content not generated' ELSE content END
  AS content FROM pages_v""")
def generated_contents(spark, sf):
    known = pages(spark, sf)
    generated = known.where("seq % 4 <> 0").withColumn(
        "content", F.when(c("seq") % 7 == 0, "").otherwise(c("content")))
    return wiki.with_generated_content(known.drop("content"), generated).select("id", "content")


@query("important_pages", f"WITH {P} SELECT wiki_id, id, title FROM pages_v WHERE importance = 'high'")
def important_pages(spark, sf):
    return wiki.pages_by_importance(pages(spark, sf), "high").select("wiki_id", "id", "title")


TITLES = """CASE seq % 12 WHEN 0 THEN 'About It' WHEN 1 THEN 'System DESIGN' WHEN 2 THEN 'Core data'
  WHEN 3 THEN 'Widgets' WHEN 4 THEN 'Endpoints' WHEN 5 THEN 'Storage' WHEN 6 THEN 'Email'
  WHEN 7 THEN 'Frontend' WHEN 8 THEN 'Deploying' ELSE 'Zzz' END"""


@query("sections_by_category", f"""WITH {P}
SELECT wiki_id, least(seq % 12, 9)::INT AS section_no, 'section-' || ['overview', 'architecture',
    'features', 'components', 'api', 'data', 'models', 'ui', 'setup', 'other'][least(seq % 12, 9) + 1]
    AS section_id, ['Overview', 'Architecture', 'Core Features', 'Components', 'API', 'Data Flow',
    'Models', 'User Interface', 'Setup & Configuration', 'Other'][least(seq % 12, 9) + 1]
    AS section_title, seq, id AS page_id FROM pages_v""")
def sections_by_category(spark, sf):
    return wiki.sections_by_category(pages(spark, sf).withColumn("title", F.expr(TITLES)))


@query("sections_by_importance", f"""WITH {P}
SELECT wiki_id, CASE importance WHEN 'high' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END AS section_no,
  'section-' || importance AS section_id, CASE importance WHEN 'high' THEN 'Core Components'
    WHEN 'medium' THEN 'Key Features' ELSE 'Additional Information' END AS section_title, seq,
  id AS page_id FROM pages_v""")
def sections_by_importance(spark, sf):
    return wiki.sections_by_importance(pages(spark, sf))


# Sections form a binary tree per wiki: node n has the children 2n+1 and 2n+2. Every fifth node is
# a leaf, which makes more roots; node 7 also refers back to its ancestor, node 1.
SECTIONS = """SELECT page_id % 10 AS wiki_id, page_id AS seq, concat('s', cast(page_id AS string)) AS id,
  concat('Section ', cast(page_id AS string)) AS title, cast(floor(page_id / 10) AS bigint) AS n
FROM pages"""


def sections(spark, sf):
    base = views._sql(spark, sf, SECTIONS, "pages")
    child = lambda n: F.concat(F.lit("s"), (n * 10 + c("wiki_id")).cast("bigint").cast("string"))
    refs = F.when(c("n") % 5 == 3, F.array().cast("array<string>")).when(
        c("n") == 7, F.array(child(c("n") * 2 + 1), child(F.lit(1)), child(c("n") * 2 + 2))).otherwise(
        F.array(child(c("n") * 2 + 1), child(c("n") * 2 + 2)))
    page = lambda k: F.concat(F.lit("page-"), (c("seq") + k).cast("string"))
    return base.withColumns({"subsections": refs, "pages": F.array(page(0), page(10))})


TREE = f"""sections_v AS ({SECTIONS}),
kids AS (SELECT wiki_id, id, n, 's' || ((n * 2 + 1) * 10 + wiki_id) AS low,
    's' || ((n * 2 + 2) * 10 + wiki_id) AS high, 's' || (10 + wiki_id) AS back FROM sections_v),
edges AS (SELECT wiki_id, id AS parent, unnest(CASE WHEN n = 7 THEN [0, 1, 2] ELSE [0, 1] END)
    AS nth, unnest(CASE WHEN n = 7 THEN [low, back, high] ELSE [low, high] END) AS id
  FROM kids WHERE n % 5 <> 3),
roots AS (SELECT * FROM sections_v s WHERE NOT EXISTS (SELECT 1 FROM edges e
  WHERE e.wiki_id = s.wiki_id AND e.id = s.id))"""
TREE_REC = f"""WITH RECURSIVE {TREE},
tree AS (SELECT wiki_id, seq::VARCHAR AS place, 0 AS level, id, title, [id] AS way FROM roots
  UNION ALL SELECT t.wiki_id, t.place || '/' || e.nth, t.level + 1, e.id, s.title,
    list_append(t.way, e.id) FROM tree t JOIN edges e ON e.wiki_id = t.wiki_id AND e.parent = t.id
    JOIN sections_v s ON s.wiki_id = e.wiki_id AND s.id = e.id
  WHERE NOT list_contains(t.way, e.id))"""


@query("root_sections", f"WITH {TREE} SELECT wiki_id, id, title FROM roots")
def root_sections(spark, sf):
    return wiki.root_sections(sections(spark, sf)).select("wiki_id", "id", "title")


@query("section_tree", TREE_REC + " SELECT wiki_id, place, level, id, title FROM tree")
def section_tree(spark, sf):
    return wiki.section_tree(sections(spark, sf)).withColumn(
        "place", F.array_join(c("place").cast("array<string>"), "/"))


@query("section_tree_pages", TREE_REC + f""", {P}
SELECT t.wiki_id, t.place, t.level, t.id AS section_id, k AS nth, p.id AS page_id,
  p.title AS page_title, importance FROM tree t, (SELECT unnest([0, 1])::INT AS k), pages_v p
WHERE p.wiki_id = t.wiki_id AND p.id = 'page-' || (substr(t.id, 2)::BIGINT + 10 * k)""")
def section_tree_pages(spark, sf):
    parts = sections(spark, sf)
    return wiki.tree_pages(wiki.section_tree(parts), parts, pages(spark, sf)).withColumn(
        "place", F.array_join(c("place").cast("array<string>"), "/"))


@query("flat_pages", f"""WITH {P} SELECT wiki_id, id FROM pages_v WHERE wiki_id % 2 = 1""")
def flat_pages(spark, sf):
    return wiki.flat_pages(pages(spark, sf), sections(spark, sf).where("wiki_id % 2 = 0")).select(
        "wiki_id", "id")


# Texts of very different length: most pages are cut, every fourth keeps its whole HTML.
BUDGET = f"""WITH RECURSIVE {P},
texts AS (SELECT wiki_id, seq, id, title, importance, CASE WHEN seq % 4 = 0 THEN replace(content, '#', '') WHEN seq % 9 = 0
    THEN '' ELSE '# ' || title || chr(10) || chr(10) || left(content, 40) || chr(10) || chr(10)
    || content END AS content FROM pages_v),
sized AS (SELECT wiki_id, id, importance = 'high' AS high, '## ' || title || chr(10) || content || chr(10)
    || chr(10) AS whole, '## ' || title || chr(10) || CASE WHEN seq % 4 = 0 THEN
    'No summary available' ELSE trim(left(content, 44 + length(title))[5 + length(title):]) END
    || chr(10) || chr(10) AS short, row_number() OVER (PARTITION BY wiki_id
    ORDER BY importance <> 'high', seq) AS rn FROM texts WHERE content <> ''),
walk AS (SELECT wiki_id, 0::BIGINT AS rn, 0::BIGINT AS total, 0::BIGINT AS important, '' AS id,
    'none' AS mode FROM (SELECT DISTINCT wiki_id FROM sized)
  UNION ALL SELECT w.wiki_id, s.rn, w.total + CASE WHEN w.total > 30000 OR (NOT high AND important
      >= 30000) THEN 0 WHEN high OR w.total + length(whole) <= 30000 THEN length(whole)
      ELSE length(short) END, CASE WHEN high THEN w.total + CASE WHEN w.total > 30000 THEN 0 ELSE
      length(whole) END ELSE important END, s.id, CASE WHEN w.total > 30000 OR (NOT high AND important
      >= 30000) THEN 'none' WHEN high OR w.total + length(whole) <= 30000 THEN 'whole'
      ELSE 'summary' END
  FROM walk w JOIN sized s ON s.wiki_id = w.wiki_id AND s.rn = w.rn + 1)
SELECT w.wiki_id, w.id, mode, md5(CASE mode WHEN 'whole' THEN whole ELSE short END) AS digest
FROM walk w JOIN sized s ON s.id = w.id WHERE mode <> 'none'"""


@query("content_budget", BUDGET)
def content_budget(spark, sf):
    gap = F.lit("\n\n")
    made = F.concat(F.lit("# "), "title", gap, F.substring("content", 1, 40), gap, "content")
    known = pages(spark, sf).withColumn("content", F.when(
        c("seq") % 4 == 0, F.replace(c("content"), F.lit("#"), F.lit(""))).when(
        c("seq") % 9 == 0, "").otherwise(made))
    return wiki.content_within_budget(known).select(
        "wiki_id", "id", "mode", F.md5(c("text").cast("binary")).alias("digest"))


EXPORTED = """wikis AS (SELECT DISTINCT wiki_id, 'https://host/o/w' || wiki_id AS repo_url FROM pages_v)"""


def _wikis(spark, sf):
    return pages(spark, sf).select("wiki_id").distinct().withColumn(
        "repo_url", F.concat(F.lit("https://host/o/w"), c("wiki_id").cast("string")))


@query("markdown_export", f"""WITH {LINKS}, {EXPORTED}, nl AS (SELECT chr(10) AS n, chr(10) || chr(10) AS nn)
SELECT wiki_id, 0 AS part, (-1)::BIGINT AS seq, '# Wiki Documentation for ' || repo_url || nn
  || 'Generated on: now' || nn || '## Table of Contents' || nn AS text FROM wikis, nl
UNION ALL SELECT wiki_id, 1, seq, '- [' || title || '](#' || id || ')' || n FROM pages_v, nl
UNION ALL SELECT wiki_id, 2, -1, n FROM wikis, nl
UNION ALL SELECT p.wiki_id, 2, p.seq, '<a id=''' || id || '''></a>' || nn || '## ' || title || nn
  || '### Related Pages' || nn || coalesce('Related topics: ' || links || nn, '') || content || nn
  || '---' || nn FROM nl, pages_v p LEFT JOIN links l ON l.wiki_id = p.wiki_id AND l.seq = p.seq""")
def markdown_export(spark, sf):
    return wiki.markdown_export(_wikis(spark, sf), pages(spark, sf), "now")


@query("json_export", f"""WITH {P}, {EXPORTED}
SELECT wiki_id, 0 AS part, (-1)::BIGINT AS seq, '{{"metadata":{{"repository":"' || repo_url
  || '","generated_at":"now","page_count":' || (SELECT count(*) FROM pages_v p
    WHERE p.wiki_id = w.wiki_id) || '}},"pages":[' AS text FROM wikis w
UNION ALL SELECT wiki_id, 2, seq, CASE WHEN seq = min(seq) OVER (PARTITION BY wiki_id) THEN '' ELSE ','
  END || '{{"id":"' || id || '","title":' || to_json(title)::VARCHAR || ',"content":' || to_json(content)::VARCHAR || ',"filePaths":["src/'
  || id || '"],"importance":"' || importance || '","relatedPages":["' || related_1 || '","'
  || related_2 || '"]}}' FROM pages_v
UNION ALL SELECT wiki_id, 3, 0, ']}}' FROM wikis""")
def json_export(spark, sf):
    return wiki.json_export(_wikis(spark, sf), pages(spark, sf), "now")


json_export_all = query("json_export_all", ORACLES["json_export"])(json_export)    # its name beside a shortened one


# One structure answer per 20 pages of a wiki.
BLOCKS = f"""{P}, blocks AS (SELECT *, wiki_id * 1000 + cast(floor(seq / 200) AS bigint) AS block,
  row_number() OVER (PARTITION BY wiki_id, floor(seq / 200) ORDER BY seq) - 1 AS nth,
  regexp_replace(title, '[^A-Za-z ]', '', 'g') AS plain FROM pages_v)"""


def responses(spark, sf):
    known = pages(spark, sf).select(
        (c("wiki_id") * 1000 + F.floor(c("seq") / 200)).cast("bigint").alias("wiki_id"), "seq",
        "id", "importance", "related_1", F.regexp_replace("title", "[^A-Za-z ]", "").alias("plain"))
    tag = lambda name, body: F.concat(F.lit(f"<{name}>"), body, F.lit(f"</{name}>"))
    # Some pages lack an id, an importance or a related page.
    opening = F.when(c("seq") % 3 == 1, "<page>").otherwise(
        F.concat(F.lit('<page id="'), "id", F.lit('">')))
    level = F.when(c("seq") % 7 == 2, "").when(c("seq") % 7 == 3, tag("importance", F.lit(
        "vital"))).otherwise(tag("importance", c("importance")))
    page = F.concat(
        opening, tag("title", c("plain")), level, tag("relevant_files", F.concat(
            tag("file_path", F.concat(F.lit("a/"), "id")), tag("file_path", F.lit("b &amp; c")))),
        tag("related_pages", F.when(c("seq") % 5 == 0, "").otherwise(tag("related", c(
            "related_1")))), F.lit("</page>"))
    section = F.concat(
        F.lit('<section id="s'), c("seq"), F.lit('">'), tag("title", F.lit("S")),
        tag("pages", tag("page_ref", c("id"))), tag("subsections", F.when(
            c("seq") % 2 == 0, tag("section_ref", F.concat(F.lit("s"), c("seq") + 10))).otherwise(
            "")), F.lit("</section>"))
    rows = F.array_sort(F.collect_list(F.struct("seq", page.alias("page"), section.alias("sec"))))
    part = lambda name: F.array_join(F.transform(rows, lambda r: r[name]), "\n")
    body = F.concat(
        F.lit("Sure:\n```xml\n<wiki_structure>\n<title>W</title><description>D</description>"),
        tag("sections", part("sec")), tag("pages", part("page")), F.lit("\n</wiki_structure>\n```"))
    answers = known.groupBy("wiki_id").agg(body.alias("response"))
    return answers.withColumn("response", F.when(c("wiki_id") % 4 == 1, F.replace(
        c("response"), F.lit("wiki_structure>"), F.lit("structure>"))).otherwise(c("response")))


@query("parsed_pages", f"""WITH {BLOCKS}
SELECT block AS wiki_id, nth::INT AS seq, CASE WHEN seq % 3 = 1 THEN 'page-' || (nth + 1) ELSE id END AS id,
  plain AS title, CASE seq % 7 WHEN 2 THEN 'medium' WHEN 3 THEN 'low' ELSE importance END AS importance,
  'a/' || id || ',b & c' AS file_paths, CASE WHEN seq % 5 = 0 THEN '' ELSE related_1 END AS related
FROM blocks WHERE block % 4 <> 1""")
def parsed_pages(spark, sf):
    out = wiki.parse_structures(responses(spark, sf)).pages
    return out.withColumns({k: F.array_join(k, ",") for k in ("file_paths", "related")})


@query("parsed_sections", f"""WITH {BLOCKS}
SELECT block AS wiki_id, nth::INT AS seq, 's' || blocks.seq AS id, 'S' AS title, blocks.id AS pages,
  CASE WHEN seq % 2 = 0 THEN 's' || (seq + 10) ELSE '' END AS subsections FROM blocks
WHERE block % 4 <> 1""")
def parsed_sections(spark, sf):
    out = wiki.parse_structures(responses(spark, sf)).sections
    return out.withColumns({k: F.array_join(k, ",") for k in ("pages", "subsections")})


@query("rejected_structures", f"""WITH {BLOCKS}
SELECT DISTINCT block AS wiki_id, 'no structure block' AS reason FROM blocks WHERE block % 4 = 1""")
def rejected_structures(spark, sf):
    return wiki.parse_structures(responses(spark, sf)).rejects


@query("built_wikis", f"""WITH {BLOCKS}
SELECT block AS wiki_id, blocks.nth::INT AS section_no, 's' || blocks.seq AS section_id,
  'S' AS section_title, blocks.id AS page_id FROM blocks WHERE block % 4 <> 1""")
def built_wikis(spark, sf):
    from repograph.plans.wiki_build import build_wikis
    generated = pages(spark, sf).select("wiki_id", "id", "content")
    return build_wikis(responses(spark, sf), generated).page_sections.select(
        "wiki_id", "section_no", "section_id", "section_title", "page_id")


# --- texts -------------------------------------------------------------------------------

@query("page_summaries", """SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'No summary available'
  ELSE 'First of ' || doc_id END AS summary FROM documents""")
def page_summaries(spark, sf):
    made = F.concat(F.lit("# T\n\n First of "), c("doc_id").cast("string"), F.lit(" \n\n"), "text")
    return table(spark, sf, "documents").select("doc_id", text.page_summary(
        F.when(c("doc_id") % 3 == 0, F.replace(c("text"), F.lit("# "), F.lit("")))
        .otherwise(made)).alias("summary"))


CONTROLS = r"[\x00-\x08\x0B\x0C\x0E-\x1F\x7F]"


@query("stripped_texts", f"""WITH plain AS (SELECT doc_id, regexp_replace(replace(text, '`', ''), '^\\s+',
  '') AS body FROM documents)
SELECT doc_id, md5(body) AS markdown, md5(regexp_replace(body, '{CONTROLS}', '', 'g') || 'ab') AS xml
FROM plain""")
def stripped_texts(spark, sf):
    body = F.replace("text", F.lit("`"), F.lit(""))
    fenced = lambda head, body, tail: F.concat(F.lit(head), body, F.lit(tail))
    digest = lambda x: F.md5(x.cast("binary"))
    return table(spark, sf, "documents").select(
        "doc_id", digest(text.strip_markdown_fences(fenced("```Markdown \n", body, "```\n")))
        .alias("markdown"),
        digest(text.strip_control_characters(text.strip_xml_fences(fenced(
            "```XML\n", F.concat(body, F.lit("a\x01b")), "``` ")))).alias("xml"))


@query("slide_plans", """SELECT doc_id, nth::INT AS nth, CASE doc_id % 5
    WHEN 3 THEN ['Alpha part', 'Gamma'][nth + 1]
    WHEN 4 THEN ['Title Slide', 'Overview', 'Architecture', 'Features', 'Implementation', 'Use Cases',
      'Conclusion'][nth + 1] ELSE 'S' || nth END AS title,
  CASE doc_id % 5 WHEN 3 THEN '' WHEN 4 THEN ['Introduction to r' || doc_id,
      'Key features and purpose of r' || doc_id, 'System components and structure',
      'Main capabilities and functionalities', 'How it works and technical details',
      'How to use r' || doc_id || ' effectively', 'Summary and next steps'][nth + 1]
    ELSE CASE nth WHEN 0 THEN 'about ' || doc_id ELSE '' END END AS description
FROM documents, (SELECT unnest([0, 1, 2, 3, 4, 5, 6]) AS nth)
WHERE nth < CASE doc_id % 5 WHEN 3 THEN 2 WHEN 4 THEN 7 ELSE 2 END""")
def slide_plans(spark, sf):
    number = c("doc_id").cast("string")
    numbered = lambda a, b, z: F.concat(F.lit(f"{a}S0: about "), number, F.lit(f": x{b}S1{z}"))
    kind = c("doc_id") % 5
    plan = (F.when(kind == 0, numbered("1. ", "\n2. ", "\n\n"))
            .when(kind == 1, numbered("1) ", "\n2) ", ""))
            .when(kind == 2, numbered("slide 1: ", "\nSlide 2 ", "\n"))
            .when(kind == 3, F.lit("Alpha part: x\nHere it is\nPlease wait\nabc\nGamma"))
            .otherwise("a\nb"))
    slides = wiki_text.slide_plan(plan, F.concat(F.lit("r"), number))
    return table(spark, sf, "documents").select(
        "doc_id", F.posexplode(slides).alias("nth", "s")).select("doc_id", "nth", "s.*")


WORKSHOP = """'# Intro' || chr(10) || 'x' || chr(10) || @TOC || '## Part ' || doc_id || '!' || chr(10)
  || '## Exercise 1: a' || chr(10) || @E1 || 't' || chr(10) || '## Exercise 2:' || chr(10) || @E2
  || '## Final Project' || chr(10) || @FP || 'end ' || lang"""
_DIV = "'<div style=\"text-align: right; font-size: 0.85em; color: #666;\">' || chr(10) || "
_END = " || chr(10) || '</div>' || chr(10) || chr(10)"


@query("workshop_texts", "SELECT doc_id, " + WORKSHOP.replace(
    "@TOC", "'## Table of Contents' || chr(10) || chr(10) || '- [Part ' || doc_id || '!](#part-' || doc_id"
    " || ')' || chr(10) || '- [Exercise 1: a](#exercise-1-a)' || chr(10) || "
    "'- [Exercise 2:](#exercise-2)' || chr(10) || '- [Final Project](#final-project)' || chr(10)"
    " || chr(10)")
    .replace("@E1", f"{_DIV}'Exercise 1 of 2 | Estimated time: 5 minutes'{_END}")
    .replace("@E2", f"{_DIV}'Exercise 2 of 2 | Estimated time: 15 minutes'{_END}")
    .replace("@FP", f"{_DIV}'Estimated time: 20-30 minutes | Combines concepts from all exercises'{_END}")
    + " AS content FROM documents")
def workshop_texts(spark, sf):
    number = c("doc_id").cast("string")
    raw = F.concat(F.lit("# Intro\nx\n## Part "), number, F.lit(
        "!\n## Exercise 1: a\nt\n## Exercise 2:\n## Final Project\nend "), "lang")
    return table(spark, sf, "documents").withColumn(
        "content", wiki_text.with_contents(raw)).withColumn(
        "content", wiki_text.with_exercise_marks(c("content"))).select(
        "doc_id", wiki_text.with_project_note(c("content")).alias("content"))


@query("branch_lists", """SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'dev,main,master'
  WHEN 1 THEN 'master,main' ELSE 'main,master' END AS branches FROM pages""")
def branch_lists(spark, sf):
    from repograph.functions.urls import branches_to_try
    known = F.when(c("page_id") % 3 == 0, "dev").when(c("page_id") % 3 == 1, "master")
    return table(spark, sf, "pages").select(
        "page_id", F.array_join(branches_to_try(known), ",").alias("branches"))


# --- project catalogue -------------------------------------------------------------------

PROJECT_FILES = """SELECT page_id, concat(CASE page_id % 9 WHEN 8 THEN 'other_' ELSE 'wiki_cache_' END,
  CASE page_id % 3 WHEN 0 THEN 'github' ELSE 'gitlab' END, '_own', cast(page_id % 11 AS string),
  CASE page_id % 5 WHEN 0 THEN '' WHEN 1 THEN '_a_b' ELSE '_Repo' END, '_en.json') AS file_name
FROM pages"""


def projects(spark, sf):
    files = views._sql(spark, sf, PROJECT_FILES, "pages").withColumn(
        "modified", F.timestamp_millis(c("page_id") * 1000 + 5))
    return wiki_store.parse_projects(files)


PROJECTS = f"""files AS ({PROJECT_FILES}),
projects AS (SELECT page_id, file_name AS id, 'own' || (page_id % 11) AS owner,
  CASE page_id % 5 WHEN 1 THEN 'a_b' ELSE 'Repo' END AS repo,
  CASE page_id % 3 WHEN 0 THEN 'github' ELSE 'gitlab' END AS repo_type,
  page_id * 1000 + 5 AS submitted_at, 'en' AS language FROM files
  WHERE page_id % 9 <> 8 AND page_id % 5 <> 0)"""


@query("processed_projects", f"""WITH {PROJECTS}
SELECT id, owner, repo, owner || '/' || repo AS name, repo_type, submitted_at, language FROM projects""")
def processed_projects(spark, sf):
    return projects(spark, sf)


@query("project_search", f"""WITH {PROJECTS}
SELECT id, submitted_at FROM projects WHERE owner = 'own1' OR owner = 'own10'
ORDER BY submitted_at DESC LIMIT 7""")
def project_search(spark, sf):
    return wiki_store.search_projects(projects(spark, sf), "OWN1", 7).select("id", "submitted_at")


@query("stored_wikis", """
WITH kept AS (SELECT 'web' AS repo_type, 'o' || (page_id % 5) AS owner, 'r' || (page_id % 3) AS repo,
  CASE page_id % 4 WHEN 1 THEN 'ja' WHEN 3 THEN 'fr' ELSE 'en' END AS language,
  'page-' || page_id AS id, html FROM pages)
SELECT repo_type, owner, repo, language, id, CASE WHEN owner = 'o1' AND language = 'ja'
    THEN md5(html || ' again') ELSE md5(html) END AS digest
FROM kept WHERE NOT (owner = 'o2' AND repo = 'r2' AND language = 'en')""")
def stored_wikis(spark, sf):
    """Wikis saved, some saved again, one deleted, and all read back."""
    path = f"{stage_folder(spark)}/wikis-{uuid.uuid4().hex}"
    n = c("page_id")
    asked = F.element_at(F.array(*[F.lit(x) for x in ("en", "ja", "tlh", "fr")]), (n % 4 + 1).cast("int"))
    kept = table(spark, sf, "pages").select(
        F.lit("web").alias("repo_type"), F.concat(F.lit("o"), n % 5).alias("owner"),
        F.concat(F.lit("r"), n % 3).alias("repo"), asked.alias("language"),
        F.concat(F.lit("page-"), n).alias("id"), "html")
    wiki_store.save_wikis(kept, path)
    wiki_store.save_wikis(kept.where("owner = 'o1' AND language = 'ja'").withColumn(
        "html", F.concat("html", F.lit(" again"))), path)
    wiki_store.delete_wiki(spark, path, "web", "o2", "r2", "en")
    return wiki_store.read_wikis(spark, path).select(
        *wiki_store.KEYS, "id", F.md5(c("html").cast("binary")).alias("digest"))


@query("wiki_languages", """SELECT conv_id, CASE WHEN conv_id % 3 = 0 THEN 'en' WHEN conv_id % 3 = 1
  THEN 'ja' ELSE 'en' END AS language, count(*) AS turns FROM conversations GROUP BY ALL""")
def wiki_languages(spark, sf):
    asked = F.element_at(F.array(F.lit("en"), F.lit("ja"), F.lit("tlh")),
                         (c("conv_id") % 3 + 1).cast("int"))
    return table(spark, sf, "conversations").groupBy("conv_id", wiki_store.supported_language(
        asked).alias("language")).agg(F.count(F.lit(1)).alias("turns"))
