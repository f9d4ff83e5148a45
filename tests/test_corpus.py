"""Paths, ignore files, repository folders, documentation excerpts."""

import os

import pytest
from pyspark.sql import functions as F

from repograph.functions import paths, urls
from repograph.functions.ignore import pattern_regex
from repograph.operators import corpus, modules
from repograph.sources import reports as report_source
from repograph.sources import repository


@pytest.mark.parametrize("address,kind,name", [
    ("https://github.com/owner/repo", "github", "owner_repo"),
    ("https://github.com/owner/repo.git", "github", "owner_repo"),
    ("https://github.com/owner/repo/", "github", "owner_repo"),
    ("https://gitlab.com/owner/repo", "gitlab", "owner_repo"),
    ("https://gitlab.com/group/subgroup/repo", "gitlab", "subgroup_repo"),
    ("https://bitbucket.org/owner/repo", "bitbucket", "owner_repo"),
    ("/home/user/projects/my-repo", "local", "my-repo"),
    ("/var/repos/project.git", "local", "project"),
    ("https://github.com/repo", "github", "repo"), ("my-repo", "local", "my-repo")])
def test_repository_names(spark, address, kind, name):
    df = spark.createDataFrame([(address, kind)], "a string, k string")
    assert df.select(urls.repository_name(F.col("a"), F.col("k"))).first()[0] == name


def test_parse_repository(spark):
    rows = ["C:\\x\\y", "C:\\", "/", "github.com/o/r", "https://gitlab.x.org:8443/a/b/c.git/", "plain",
            "https://host/only"]
    df = spark.createDataFrame([(r,) for r in rows], "a string")
    got = [r[0] for r in df.select(urls.parse_repository(F.col("a"))).collect()]
    assert tuple(got[0]) == ("local", "y", "local", None, "C:\\x\\y")
    assert got[1].repo == "local-repo" and got[2].repo == "local-repo"
    assert tuple(got[3]) == ("o", "r", "github", "o/r", None)
    assert tuple(got[4]) == ("b", "c", "gitlab", "a/b/c.git", None) or got[4].repo == "c"
    assert got[5] is None and got[6] is None


@pytest.mark.parametrize("path,kind,where", [
    ("inspect.py", "test", "(root)"), ("a/b.YAML", "config", "a"), ("a/b/c.rst", "docs", "a/b"),
    ("x.py", "source", "(root)")])
def test_file_class_and_directory(spark, path, kind, where):
    df = spark.createDataFrame([(path,)], "p string")
    row = df.select(paths.classify_file(F.col("p")), paths.directory(F.col("p"))).first()
    assert tuple(row) == (kind, where)


@pytest.mark.parametrize("path,ext", [
    ("a/b.Py", ".py"), (".bashrc", ""), ("a/.env.local", ".local"), ("Makefile", ""), ("x.tar.gz", ".gz")])
def test_extension(spark, path, ext):
    df = spark.createDataFrame([(path,)], "p string")
    assert df.select(paths.extension(F.col("p"))).first()[0] == ext


@pytest.mark.parametrize("pattern,path,hit", [
    ("*.py", "a/b.py", True), ("/*.py", "a/b.py", False), ("/*.py", "b.py", True),
    ("foo", "a/foo/x", True), ("foo/", "foo", False), ("foo/", "foo/x", True),
    ("a/b", "c/a/b", False), ("a/b", "a/b/c", True), ("**/b", "x/y/b", True), ("a/**", "a/x/y", True),
    ("a/**", "a", False), ("a/**/z", "a/z", True), ("a/**/z", "a/b/c/z", True), ("?.c", "x.c", True),
    ("?.c", "xy.c", False), ("[a-c].t", "b.t", True), ("[!a-c].t", "b.t", False),
    ("a+b", "a+b", True), ("\\#x", "#x", True), ("\\!x", "!x", True), ("x ", "x", True)])
def test_ignore_patterns(spark, pattern, path, hit):
    regex, negated = pattern_regex(pattern)
    df = spark.createDataFrame([(path, regex)], "p string, r string")
    assert df.select(F.regexp_like("p", F.col("r"))).first()[0] is hit and not negated


def test_ignore_lines_without_pattern():
    assert pattern_regex("") is None and pattern_regex("# c") is None and pattern_regex("  ") is None
    assert pattern_regex("!a")[1] is True


def test_ignored_directory_cannot_be_reopened(spark):
    files = spark.createDataFrame([("r", p, "") for p in (
        "build/keep.txt", "a/keep.txt", "a/x.log", "b/x.log", "b/keep.log")],
        "repo string, path string, content string")
    rules = spark.createDataFrame([("r", "", "build/\n!build/keep.txt\n*.log\n!keep.log\n"),
                                   ("r", "a", "keep.txt\n")], "repo string, dir string, content string")
    left = corpus.respect_ignore_files(files, rules)
    assert [r.path for r in left.collect()] == ["b/keep.log"]


def test_folder_scan(spark, tmp_path):
    root = tmp_path / "repos"
    for path, data in {
        "one/src/a.py": b"x = 1\n", "one/src/bad.py": b"\xff\xfe", "one/a b+c.md": "é".encode(),
        "one/img.png": b"\x89", "two/README.md": b"hi", "two/.hidden/x.py": b"", "two/docs/y.py": b"", "one/src/__init__.py": b"",
    }.items():
        os.makedirs(root / os.path.dirname(path), exist_ok=True)
        (root / path).write_bytes(data)
    files = repository.read_files(spark, str(root))
    assert {(r.repo, r.path) for r in files.select("repo", "path").collect()} == {
        ("one", "src/a.py"), ("one", "src/bad.py"), ("one", "a b+c.md"), ("one", "img.png"),
        ("two", "README.md"), ("two", ".hidden/x.py"), ("two", "docs/y.py"),
        ("one", "src/__init__.py")}
    text = files.withColumn("content", repository.strict_text(F.col("content")))
    docs = corpus.documents(corpus.select_files(text))
    assert {r.path for r in docs.collect()} == {
        "src/a.py", "a b+c.md", "README.md", ".hidden/x.py", "src/__init__.py"}
    shown = corpus.scannable(files.withColumn("content", repository.repaired_text(F.col("content"))))
    got = {r.path: r.content for r in shown.collect()}
    assert set(got) == {
        "src/a.py", "src/bad.py", "a b+c.md", "README.md", "docs/y.py", "src/__init__.py"}
    assert got["src/bad.py"] == "\ufffd\ufffd"
    only = repository.read_files(spark, str(root), [".md"], repo="all")
    assert {r.path for r in only.collect()} == {"one/a b+c.md", "two/README.md"}
    loose = repository.read_files(spark, str(root / "one"), repo="one")
    assert {r.path for r in loose.collect()} == {
        "src/a.py", "src/bad.py", "src/__init__.py", "a b+c.md", "img.png"}
    assert [tuple(r) for r in corpus.readme(text).collect()] == [("two", "hi")]


def test_reports_of_successful_tools(spark, tmp_path):
    for run, tool in (("r1", "semgrep"), ("r1", "cargo-audit"), ("r2", "semgrep")):
        os.makedirs(tmp_path / run, exist_ok=True)
        (tmp_path / run / f"{tool}.sarif").write_text(f"{run} {tool}\nline")
    results = spark.createDataFrame(
        [("r1", "semgrep", True, "p", 1), ("r1", "cargo-audit", False, "p", 0),
         ("r2", "semgrep", True, None, 0)],
        "run_id string, tool string, success boolean, sarif_path string, tool_no int")
    rows = report_source.read_reports(spark, str(tmp_path), results).collect()
    assert [tuple(r) for r in rows] == [("r1", 1, "semgrep", "r1 semgrep\nline")]


@pytest.mark.parametrize("content,doc", [
    ('"""One.\nTwo"""', "One."), ("'''  A  '''x", "A"), ('# c\n"""no"""', None), ('"""open', None),
    ('""""""', "")])
def test_python_doc(spark, content, doc):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(modules.python_doc(F.col("c"))).first()[0] == doc


@pytest.mark.parametrize("content,doc", [
    ("x\n/**\n *\n * Hello\n * more\n */", "Hello"), ("/* a */", "a"), ("/**\n * T\n * @p x */", "T"),
    ("// no", None), ("/* */", None)])
def test_script_comment(spark, content, doc):
    df = spark.createDataFrame([(content,)], "c string")
    assert df.select(modules.script_comment(F.col("c"))).first()[0] == doc


def test_module_doc_and_empty_directories(spark):
    files = spark.createDataFrame([
        ("r", "p/__init__.py", '"""Pkg."""'), ("r", "p/sub/deep/x.js", "/* X */"), ("r", "top.py", "")],
        "run_id string, path string, content string")
    from repograph.model import FINDING_SCHEMA
    from tests.test_findings import finding
    findings = spark.createDataFrame([
        finding(0, uri="p/sub/gone.py", text="m0"), finding(1, uri="other/x.py"), finding(2, uri="top.py")],
        FINDING_SCHEMA)
    got = {r.module: (r.module_doc, r.file_summaries, r.finding_count, r.sample_findings)
           for r in modules.module_summaries(files, findings, 20, 5).collect()}
    assert got == {
        "p": ("Pkg.", ["__init__.py: Pkg."], 0, []), "p/sub": ("", [], 1, ["m0"]),
        "p/sub/deep": ("", ["x.js: X"], 0, []), "(root)": ("", [], 1, ["m"])}


def test_docs_of_any_length_and_what_limits_leave_out(spark):
    long = "x" * 10_000
    rows = [("a.py", f'"""Title.\n{long}"""\n'), ("b.py", f"'''{long}'''"), ("c.js", f"/* T\n{long} */")]
    df = spark.createDataFrame(rows, "path string, content string")
    got = [r[0] for r in df.select(modules.file_purpose(F.col("path"), F.col("content"))).collect()]
    assert got == ["Title.", long, "T"]
    files = df.withColumn("repo", F.lit("r"))
    assert corpus.documents(files).count() == 3
    assert corpus.documents(files, max_code_tokens=2501).count() == 1
    left = corpus.oversized(files, max_code_tokens=2501).collect()
    assert sorted(r.path for r in left) == ["a.py", "c.js"] and left[0].reason


def test_findings_reach_every_document(spark, tmp_path):
    from pyspark.sql import functions as F

    from catalog import views
    spark.range(2500).select(
        F.col("id").alias("doc_id"), F.lit("x").alias("text"), F.lit("en").alias("lang"),
        F.lit("src0").alias("source")).write.parquet(f"{tmp_path}/documents.parquet")
    spark.range(2500).select(
        F.col("id").alias("event_id"), F.col("id").alias("user_id"), F.lit("e").alias("event_type"),
        F.lit(1.0).alias("value")).write.parquet(f"{tmp_path}/events.parquet")
    found = views.file_findings(spark, str(tmp_path))
    assert found.select(F.explode("locations.uri")).distinct().count() == 2500
