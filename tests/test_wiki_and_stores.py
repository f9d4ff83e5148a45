"""Wikis, stored tables, prompts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from repograph.functions import research, text, wiki_text
from repograph.operators import chat, wiki
from repograph.sources import chunk_store, wiki_store


def one(spark, value, expression):
    return spark.createDataFrame([(value,)], "v string").select(expression(F.col("v"))).first()[0]


def test_wiki_store_round_trip(spark, tmp_path):
    path = str(tmp_path / "wikis")
    page = "repo_type string, owner string, repo string, language string, id string, title string"
    save = lambda rows: wiki_store.save_wikis(spark.createDataFrame(rows, page), path)
    save([("github", "o", "r", "en", "p1", "A"), ("github", "o", "r", "xx", "p2", "B"),
          ("github", "o", "r", "ja", "p1", "J")])
    read = lambda lang: sorted(r.title for r in wiki_store.read_wiki(
        spark, path, "github", "o", "r", lang).collect())
    assert read("en") == ["A", "B"] and read("nope") == ["A", "B"] and read("ja") == ["J"]
    save([("github", "o", "r", "ja", "p1", "K")])
    assert read("ja") == ["K"] and read("en") == ["A", "B"]
    plan = wiki_store.read_wiki(spark, path, "github", "o", "r", "ja")
    assert "PartitionFilters: [" in plan._jdf.queryExecution().executedPlan().toString()
    wiki_store.delete_wiki(spark, path, "github", "o", "r", "ja")
    assert read("ja") == [] and read("en") == ["A", "B"]
    with pytest.raises(LookupError):
        wiki_store.delete_wiki(spark, path, "github", "o", "r", "ja")
    with pytest.raises(ValueError):
        wiki_store.delete_wiki(spark, path, "github", "o", "r", "xx")


def test_project_catalogue(spark, tmp_path):
    for name in ("wiki_cache_github_o_a_b_en.json", "wiki_cache_x_y.json", "other.json"):
        (tmp_path / name).write_text("{}")
    rows = wiki_store.list_projects(spark, str(tmp_path)).collect()
    assert [(r.owner, r.repo, r.name, r.repo_type, r.language) for r in rows] == [
        ("o", "a_b", "o/a_b", "github", "en")]
    assert rows[0].submitted_at > 1_600_000_000_000


def test_chunk_store(spark, tmp_path):
    path = str(tmp_path / "chunks")
    rows = [("a", "x", [1.0]), ("a", "y", []), ("b", "z", [2.0])]
    df = spark.createDataFrame(rows, "repo string, text string, vector array<float>")
    chunk_store.save_chunks(df, path)
    chunk_store.save_chunks(df.where("repo = 'b'").withColumn("text", F.lit("new")), path)
    assert sorted(r.text for r in chunk_store.load_chunks(spark, path).collect()) == ["new", "x", "y"]
    assert [r.text for r in chunk_store.load_chunks(spark, path, ["b"]).collect()] == ["new"]
    assert {r.repo for r in chunk_store.reusable_repositories(df).collect()} == {"a", "b"}


def test_structure_parsing_edges(spark):
    xml = ("```xml\n<wiki_structure><title>T</title><pages><page id=''><title>A</title>"
           "<importance>high</importance></page><page id='x'><importance>odd</importance></page></pages>"
           "</wiki_structure>\n```")
    df = spark.createDataFrame([(1, xml), (2, "nothing"), (3, "<wiki_structure><a></wiki_structure>")],
                               "wiki_id bigint, response string")
    out = wiki.parse_structures(df)
    assert [(r.id, r.title, r.importance, r.related) for r in out.pages.orderBy("seq").collect()] == [
        ("page-1", "A", "high", []), ("x", "", "low", [])]
    assert {r.wiki_id: r.reason for r in out.rejects.collect()} == {
        2: "no structure block", 3: "not well-formed"}
    assert out.wikis.collect()[0].title == "T"


def test_section_cycle_ends(spark):
    df = spark.createDataFrame([
        (1, 0, "r", "R", [], ["a"]), (1, 1, "a", "A", [], ["b", "zz"]), (1, 2, "b", "B", [], ["a"]),
        (1, 3, "a", "A2", [], [])],
        "wiki_id bigint, seq bigint, id string, title string, pages array<string>, "
        "subsections array<string>")
    got = [(r.level, r.id, r.title) for r in wiki.section_tree(df).orderBy("place").collect()]
    assert got == [(0, "r", "R"), (1, "a", "A"), (2, "b", "B")]


_SECTIONS = ("wiki_id bigint, seq bigint, id string, title string, pages array<string>, "
             "subsections array<string>")


def _shown(rows):
    """The tree by recursion."""
    first, named = {}, {x for *_, subs in rows for x in subs}
    for _, _, i, title, _, subs in rows:
        first.setdefault(i, (title, subs))
    out = []

    def show(i, place, way):
        out.append((list(place), len(place) - 1, i, first[i][0]))
        for n, sub in enumerate(first[i][1]):
            if sub in first and sub not in way:
                show(sub, [*place, n], [*way, sub])

    for _, seq, i, *_ in rows:
        if i not in named:
            show(i, [seq], [i])
    return sorted(out)


def test_random_trees_with_cycles(spark):
    rnd = random.Random(4)
    rows, want = [], []
    for w in range(40):
        n = rnd.randrange(1, 13)
        own = [(w, k, f"s{rnd.randrange(n)}" if rnd.random() < .2 else f"s{k}", f"T{k}", [],
                [f"s{rnd.randrange(n + 2)}" for _ in range(rnd.randrange(4))]) for k in range(n)]
        own.append((w, n, "root", "R", [], [f"s{rnd.randrange(n)}" for _ in range(3)]))
        rows += own
        want += [(w, *r) for r in _shown(own)]
    got = wiki.section_tree(spark.createDataFrame(rows, _SECTIONS)).collect()
    assert sorted((r.wiki_id, r.place, r.level, r.id, r.title) for r in got) == want
    assert max(r.level for r in got) > 4


def test_deep_and_shared_sections(spark, monkeypatch):
    tables = []
    staged = wiki.staged
    monkeypatch.setattr(wiki, "staged", lambda df: tables.append(staged(df)) or tables[-1])
    chain = [(1, k, f"s{k}", f"T{k}", [], [f"s{k + 1}"]) for k in range(1000)]
    got = wiki.section_tree(spark.createDataFrame(chain, _SECTIONS)).collect()
    assert sorted((r.level, r.id) for r in got) == [(k, f"s{k}") for k in range(1000)]
    assert len(tables) <= 2 + 2 * 11        # two tables a round
    tables.clear()
    # Eight layers of two sections that both refer to both of the next: 2**k ways to layer k.
    layers = [(1, 2 * k + b, f"l{k}{b}", "L", [], [f"l{k + 1}0", f"l{k + 1}1"])
              for k in range(8) for b in range(2)]
    shown = wiki.section_tree(spark.createDataFrame(layers, _SECTIONS))
    assert shown.count() == sum(2 ** (k + 1) for k in range(8))
    assert max(t.count() for t in tables) <= shown.count()


def test_sections_without_roots(spark):
    ring = [(1, k, f"s{k}", "T", [], [f"s{j}" for j in range(6)]) for k in range(6)]
    assert wiki.section_tree(spark.createDataFrame(ring, _SECTIONS)).collect() == []
    assert wiki.section_tree(spark.createDataFrame([], _SECTIONS)).collect() == []


@pytest.mark.parametrize("sizes,want", [
    ([("high", 40), ("low", 10)], ["whole", "whole"]),
    ([("high", 95), ("low", 10)], ["whole", "summary"]),
    ([("high", 120), ("high", 5), ("low", 1)], ["whole"]),
    ([("low", 60), ("high", 30), ("low", 60), ("low", 1)], ["whole", "whole", "summary"])])
def test_budget_branches(spark, sizes, want):
    # Titles are empty: a page adds six characters and its content.
    rows = [(1, i, f"p{i}", "", imp, "x" * n) for i, (imp, n) in enumerate(sizes)]
    df = spark.createDataFrame(rows, "wiki_id bigint, seq bigint, id string, title string, "
                                     "importance string, content string")
    shown = wiki.content_within_budget(df, budget=110).orderBy("position").collect()
    assert [r["mode"] for r in shown] == want


@pytest.mark.parametrize("content,done", [
    ("## Final Conclusion", True), ("## Summary ok", True), ("## Summary\nNext Steps", False),
    ("In conclusion, x", True), ("Final thoughts, Conclusion", True), ("The Dockerfile is", True),
    ("The Dockerfile\nNext Steps", False), ("plain", False)])
def test_research_complete(spark, content, done):
    assert one(spark, content, research.research_complete) is done


@pytest.mark.parametrize("content,iteration,kind", [
    ("## Research Plan", 1, "plan"), ("## Research Plan", 2, None), ("## Research Update 3", 3, "update"),
    ("## Research Update 5", 5, None), ("## Final Conclusion", 9, "conclusion")])
def test_research_stage(spark, content, iteration, kind):
    stage = one(spark, content, lambda c: research.research_stage(c, F.lit(iteration)))
    assert (stage.type if stage else None) == kind


def test_fences_and_durations(spark):
    assert one(spark, "```markdown\n# A\n```\n", text.strip_markdown_fences) == "# A\n"
    assert one(spark, "```xml\n<a/>\n``` ", text.strip_xml_fences) == "<a/>\n"
    assert one(spark, "", lambda c: text.duration_label(F.lit(59.94))) == "59.9s"
    assert one(spark, "", lambda c: text.duration_label(F.lit(90))) == "1.5m"


def test_contents_are_left_alone(spark):
    for kept in ("# A\n## Contents\n## B\n", "no headings", "## First\ntext"):
        assert one(spark, kept, wiki_text.with_contents) == kept


def test_prompts_of_any_length(spark):
    df = spark.createDataFrame([("a", 0, 0, "xx"), ("a", 2, 1, "z"), ("a", 2, 0, "y"),
                                ("b", 0, 0, "w" * 5_000_000)],
                               "conv_id string, part int, seq bigint, text string")
    whole = {r.conv_id: r.prompt for r in chat.assemble_prompts(df).collect()}
    assert whole == {"a": "xxyz", "b": "w" * 5_000_000}


def test_prompt_with_file_and_template_braces(spark):
    asked = spark.createDataFrame(
        [(1, True, 2, "q", "github", "https://h/o/r", "ja", "a.py", "code")],
        "conv_id int, is_research boolean, iteration bigint, query string, repo_type string, "
        "repo_url string, language string, file_path string, file_content string")
    table = chat.template_table(spark, {"middle": "{repo_name} {language_name} {{x}} {research_iteration}"})
    ready = chat.system_prompts(asked, table)
    none = spark.createDataFrame([], "conv_id int, turn_no bigint, user_text string, assistant_text string")
    whole = chat.assemble_prompts(chat.prompt_fragments(ready, none))
    assert whole.first().prompt == (
        "/no_think r Japanese (日本語) {x} 2\n\n<currentFileContent path=\"a.py\">\ncode\n"
        "</currentFileContent>\n\n<note>Answering without retrieval augmentation due to input size "
        "constraints.</note>\n\n<query>\nq\n</query>\n\nAssistant: ")


def test_exports_are_whole_documents(spark, tmp_path):
    import json
    from repograph.sources.documents import read_document, write_documents
    pages = spark.createDataFrame(
        [(1, 0, "a", "A", "high", ["b", "zz", "b"], ["f"], "line\n\nmore"),
         (1, 1, "b", "B", "low", [], [], 'x "y"'), (2, 0, "c", "C", "low", ["c"], [], "z")],
        "wiki_id bigint, seq bigint, id string, title string, importance string, "
        "related array<string>, file_paths array<string>, content string")
    wikis = spark.createDataFrame([(1, "u1"), (2, "u2"), (3, "u3")], "wiki_id bigint, repo_url string")
    write_documents(wiki.markdown_export(wikis, pages, "now"), str(tmp_path / "md"), "wiki_id",
                    wiki.EXPORT_ORDER)
    assert read_document(spark, str(tmp_path / "md"), "wiki_id", "1") == (
        "# Wiki Documentation for u1\n\nGenerated on: now\n\n## Table of Contents\n\n- [A](#a)\n- [B](#b)\n"
        "\n<a id='a'></a>\n\n## A\n\n### Related Pages\n\nRelated topics: [B](#b), [B](#b)\n\n"
        "line\n\nmore\n\n---\n\n<a id='b'></a>\n\n## B\n\nx \"y\"\n\n---\n\n")
    write_documents(wiki.json_export(wikis, pages, "now"), str(tmp_path / "js"), "wiki_id",
                    wiki.EXPORT_ORDER)
    doc = json.loads(read_document(spark, str(tmp_path / "js"), "wiki_id", "1"))
    assert doc["metadata"] == {"repository": "u1", "generated_at": "now", "page_count": 2}
    assert [p["content"] for p in doc["pages"]] == ["line\n\nmore", 'x "y"']
    empty = json.loads(read_document(spark, str(tmp_path / "js"), "wiki_id", "3"))
    assert empty["pages"] == [] and empty["metadata"]["page_count"] == 0


def test_broken_escapes_stay_text(spark):
    assert one(spark, "a%20b\n \n%zz\nc+d", text.decode_list_parameter) == ["a b", "%zz", "c+d"]


def test_json_export_query_holds_whole_pages(spark, tmp_path):
    from catalog.wiki_queries import json_export_all
    html = '<title>A "long" title \\ of a page</title>\n<p>tab\t, é and \U0001f600 ' + "x" * 5000
    spark.createDataFrame([(3, "u", html)], "page_id bigint, url string, html string").write.parquet(
        f"{tmp_path}/pages.parquet")
    rows = json_export_all(spark, str(tmp_path)).orderBy("part", "seq").collect()
    page, = json.loads("".join(r.text for r in rows))["pages"]
    assert (page["title"], page["content"]) == ('A "long" title \\ of a page', html)
