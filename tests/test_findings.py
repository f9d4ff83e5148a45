"""Properties of the finding operators."""

import json

import pytest
from pyspark.sql import functions as F

from repograph.functions import severity
from repograph.model import FINDING_SCHEMA
from repograph.operators import findings as ops, merge, sarif
from repograph.operators.ordering import (
    dense_index, first_n, first_n_salted, running_totals)


def finding(i, run="r", tool="t", level="warning", rule="a/R", uri="f.py", line=1, text="m", fps=None,
            doc=0):
    return (run, doc, 0, i, tool, rule, level, text, [(uri, line, None, None, None)] if uri else None,
            fps, None)


@pytest.fixture(scope="module")
def many(spark):
    # One fingerprint holds most rows.
    rows = [finding(i, tool=f"t{i % 5}", level=["note", "warning", "error", None][i % 4],
                    line=1 if i % 3 else i) for i in range(900)]
    return spark.createDataFrame(rows, FINDING_SCHEMA)


def kept(df):
    return sorted((r.run_id, r.tool, r.result_idx) for r in df.collect())


def test_dedup_is_idempotent_and_independent_of_partitioning(many):
    once = ops.deduplicate(ops.with_fingerprint(many))
    again = ops.deduplicate(once)
    assert kept(once) == kept(again)
    for parts in (1, 7):
        assert kept(ops.deduplicate(ops.with_fingerprint(many.repartition(parts)))) == kept(once)
    assert once.where(F.get("locations", F.lit(0))["start_line"] == 1).count() == 1


def test_dedup_prunes_before_the_shuffle(many):
    plan = ops.deduplicate(ops.with_fingerprint(many))._jdf.queryExecution().executedPlan().toString()
    before, after = plan.index("Exchange"), plan.rindex("WindowGroupLimit")
    assert after > before, plan


def test_own_fingerprint_first_value_and_missing_location(spark):
    df = spark.createDataFrame([
        finding(0, fps={"z": "same"}), finding(1, rule="b/OTHER", fps={"z": "same"}),
        finding(2, uri=None), finding(3, rule="x/r", uri=None, text=" M  ")], FINDING_SCHEMA)
    assert [x[2] for x in kept(ops.deduplicate(ops.with_fingerprint(df)))] == [0, 2]
    text = spark.sql("SELECT from_json('{\"z\":\"1\",\"a\":\"2\"}', 'map<string,string>') fingerprints, "
                     "'' rule_id, '' message, cast(null as array<struct<uri:string,start_line:int>>) "
                     "locations")
    assert ops.with_fingerprint(text).first().fp == "1"


def test_metrics_total_is_row_count(many):
    metrics = ops.run_metrics(many, many.select("run_id", "tool").distinct()).first()
    assert metrics.total_findings == 900 and metrics.tool_count == 5
    # A finding without level counts as a warning.
    assert (metrics.error_count, metrics.warning_count, metrics.note_count) == (225, 450, 225)


def test_queries_use_the_level_a_finding_states(many):
    flat = ops.project_findings(many)
    assert ops.query_findings(flat, severity="warning", limit=None).count() == 225
    assert ops.query_findings(flat, limit=0).count() == 0
    first = ops.query_findings(flat, tool="t1", limit=3).collect()
    assert [r.result_idx for r in first] == [1, 6, 11]


def test_dense_index_over_hot_group(spark):
    rows = [("hot" if i % 10 else "cold", i * 7) for i in range(500)]
    df = spark.createDataFrame(rows, "run_id string, n bigint").repartition(6)
    got = dense_index(df, ["run_id"], [], "n", block_rows=64).collect()
    for run in ("hot", "cold"):
        want = {n: i for i, n in enumerate(sorted(n for r, n in rows if r == run))}
        assert {r.n: r["index"] for r in got if r.run_id == run} == want


@pytest.fixture
def spread_out(spark):
    """Small shuffles stay in as many partitions as are asked for."""
    names = ("spark.sql.adaptive.coalescePartitions.enabled", "spark.sql.shuffle.partitions")
    before = {n: spark.conf.get(n) for n in names}
    spark.conf.set(names[0], "false")
    spark.conf.set(names[1], "13")
    yield spark
    for n, v in before.items():
        spark.conf.set(n, v)


def test_dense_index_of_sparse_ordinals(spread_out):
    # Every row is a block of its own; nine tenths of them are in one group.
    rows = [("hot" if i % 10 else f"r{i % 3}", f"t{i % 4}", (i * 7919 % 5003 - 2500) * 10**12)
            for i in range(5003)]
    df = spread_out.createDataFrame(rows, "run_id string, tool string, n bigint").repartition(5)
    got = dense_index(df, ["run_id"], ["tool"], "n").collect()
    assert len(got) == len(rows)
    for run in {r for r, _, _ in rows}:
        want = sorted((t, n) for r, t, n in rows if r == run)
        assert [(r.tool, r.n) for r in sorted(got, key=lambda r: r["index"]) if r.run_id == run] == want
        assert sorted(r["index"] for r in got if r.run_id == run) == list(range(len(want)))


def test_running_totals_cross_partitions(spread_out):
    rows = [("a", i, i % 5) for i in range(1000)] + [("b", 3, 7), ("c", 1, 1), ("c", 2, 4)]
    df = spread_out.createDataFrame(rows, "g string, k int, n bigint").repartition(3)
    got = {(r.g, r.k): r.before for r in running_totals(df, ["g"], ["k"], "n").collect()}
    assert got == {(g, k): sum(m for h, j, m in rows if h == g and j < k) for g, k, _ in rows}


def test_dense_index_of_no_rows(spark):
    df = spark.createDataFrame([], "run_id string, n bigint")
    assert dense_index(df, ["run_id"], [], "n").collect() == []


def test_first_n_variants_agree(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("k"), "id").repartition(5)
    a = {tuple(r) for r in first_n(df, ["k"], [F.desc("id")], 50).collect()}
    b = {tuple(r) for r in first_n_salted(df, ["k"], [F.desc("id")], 50, F.col("id"), 7).collect()}
    assert a == b and len(a) == 150


def test_merge_versions_properties_and_rules(spark):
    runs = spark.createDataFrame([
        ("r", 0, 0, "t", "unknown", None, {"a": "1"}), ("r", 1, 0, "t", "2.0", "[1]", {"a": "9", "b": "2"}),
        ("r", 2, 0, "t", "", None, None), ("r", 0, 1, "u", "", None, None)],
        "run_id string, doc_idx bigint, run_idx int, tool string, version string, extensions string, "
        "properties map<string,string>")
    t, u = merge.merge_runs(runs).orderBy("tool").collect()
    assert (t.version, t.properties, t.extensions) == ("2.0", {"a": "1", "b": "2"}, None)
    assert u.version == ""
    rules = spark.createDataFrame([
        ("r", 0, 0, 0, "t", "X", "first"), ("r", 0, 0, 1, "t", "X", "last of first run"),
        ("r", 1, 0, 0, "t", "X", "late"), ("r", 1, 0, 1, "t", "Y", "y1"), ("r", 1, 0, 2, "t", "Y", "y2"),
        ("r", 1, 0, 3, "t", "", "none")],
        "run_id string, doc_idx bigint, run_idx int, rule_idx bigint, tool string, rule_id string, "
        "name string")
    got = {r.rule_id: r.name for r in merge.merge_rules(rules, runs).collect()}
    assert got == {"X": "last of first run", "Y": "y1"}


def test_unified_document_is_json(spark, tmp_path):
    from repograph.normalize import normalise
    from repograph.plans.analysis import analyse
    from repograph.sources.documents import read_document, write_documents
    source = {"runs": [{"tool": {"driver": {"name": "b", "rules": [{"id": "R", "name": ""}]}}, "results": [
        {"ruleId": "R", "level": "weird", "message": {"text": 'q"\n'}, "locations": [{"physicalLocation": {
            "artifactLocation": {"uri": "x.py"}, "region": {"startLine": 2}}}], "fingerprints": {},
         "properties": {"k": "v"}}]}, {"tool": {"driver": {"name": "a"}}}]}
    reports = spark.createDataFrame(
        [("run1", 0, "semgrep", json.dumps(source)), ("run1", 1, "lacheck", '"m.tex", line 4: odd')],
        "run_id string, doc_idx bigint, tool string, raw string")
    out = analyse(reports, tools=["semgrep", "lacheck"])
    write_documents(out.document(), str(tmp_path / "docs"), "run_id", sarif.FRAGMENT_ORDER)
    doc = json.loads(read_document(spark, str(tmp_path / "docs"), "run_id", "run1"))
    assert doc["version"] == "2.1.0"
    assert [r["tool"]["driver"]["name"] for r in doc["runs"]] == ["a", "b", "lacheck"]
    a, b, c = doc["runs"]
    assert a["results"] == [] and b["tool"]["driver"]["rules"] == [{"id": "R"}]
    assert b["results"] == [{
        "ruleId": "R", "level": "warning", "message": {"text": 'q"\n'}, "locations": [{
            "physicalLocation": {"artifactLocation": {"uri": "x.py"}, "region": {"startLine": 2}}}],
        "properties": {"k": "v"}}]
    assert c["results"][0]["message"]["text"] == "odd"
    uris = [{"location": {"uri": "m.tex"}}, {"location": {"uri": "x.py"}}]
    assert a["artifacts"] == b["artifacts"] == uris
    assert b["properties"]["normalizer"]["originalTool"] == "semgrep"
    assert normalise(reports, tools=["semgrep", "lacheck"]).rejects.count() == 0


def test_registered_vocabulary_is_checked(spark):
    with pytest.raises(ValueError):
        severity.SeverityVocabulary().register_tool("x", {"bad": "fatal"})
    table = severity.vocabulary_table(spark, severity.SeverityVocabulary().register_tool(
        "X", {"Odd": "error"}))
    assert severity.invalid_vocabulary_rows(table).count() == 0
    wrong = spark.createDataFrame([("x", "y", "fatal")], "tool string, word string, level string")
    assert severity.invalid_vocabulary_rows(wrong).count() == 1


@pytest.mark.parametrize("tool,word,level", [
    ("trivy", " UNKNOWN ", "none"), ("any", "Blocker", "error"), ("any", "hint", "note"),
    ("trufflehog", "verified", "error"), ("any", "verified", "warning"), ("any", "note", "note")])
def test_severity_words(spark, tool, word, level):
    df = spark.createDataFrame([(tool, word)], "tool string, word string")
    assert df.select(severity.map_severity(F.col("tool"), F.col("word"))).first()[0] == level
    assert df.select(severity.map_severity(tool, F.col("word"))).first()[0] == level


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_equals_plain_join(spark, how):
    from repograph.operators.skew import salted_join
    rows = spark.range(300).select(F.when(F.col("id") % 3 == 0, "hot").otherwise(
        F.concat(F.lit("k"), F.col("id") % 20)).alias("k"), "id")
    lookup = spark.createDataFrame([("hot", 1), ("k1", 2), ("none", 3)], "k string, v int")
    plain = rows.join(lookup, ["k"], how)
    salted = salted_join(rows, lookup, ["k"], ["id"], how)
    assert sorted(map(str, plain.collect())) == sorted(map(str, salted.collect()))


def test_unified_document_keeps_what_native_reports_carry(spark, tmp_path):
    from repograph.plans.analysis import analyse
    from repograph.sources.documents import read_document, write_documents
    rule = {"id": "R", "name": "n", "shortDescription": {"text": "s"}, "help": {"markdown": "**h**"},
            "fullDescription": {"text": "d", "markdown": "*d*"}, "helpUri": "https://x/R",
            "defaultConfiguration": {"level": "error", "enabled": False},
            "properties": {"tags": ["a", "b"], "precision": 2}}
    place = {"physicalLocation": {"artifactLocation": {"uri": "x.py", "uriBaseId": "%ROOT%"}, "region": {
        "startLine": 2, "snippet": {"text": 'a "b"\n'}}}, "logicalLocations": [{"name": "f"}]}
    result = {"ruleId": "R", "ruleIndex": 0, "level": "note", "message": {"text": "m", "markdown": "*m*"},
              "locations": [place], "partialFingerprints": {"p": "1"}, "codeFlows": [{"threadFlows": []}],
              "relatedLocations": [place], "suppressions": [{"kind": "inSource"}],
              "properties": {"score": 7.5, "nested": {"on": True, "n": None}, "text": "7"}}
    plain = {"ruleId": "S", "level": "weird", "message": {"id": "default", "arguments": ["é"]}, "rank": 1.5}
    source = {"runs": [{"tool": {"driver": {"name": "b", "rules": [rule]}}, "results": [result, plain],
                        "properties": {"n": 3, "on": False, "nested": {"list": [1, "2", None]}, "t": "4"},
                        "artifacts": [{"location": {"uri": "unnamed.py"}}, {"location": {"uri": "x.py"}}]}]}
    reports = spark.createDataFrame([("run1", 0, "semgrep", json.dumps(source))],
                                    "run_id string, doc_idx bigint, tool string, raw string")
    out = analyse(reports, tools=["semgrep"])
    write_documents(out.document(), str(tmp_path / "docs"), "run_id", sarif.FRAGMENT_ORDER)
    run, = json.loads(read_document(spark, str(tmp_path / "docs"), "run_id", "run1"))["runs"]
    assert run["tool"]["driver"]["rules"] == [rule]
    del result["ruleIndex"]  # rules are merged: the number no longer holds
    assert run["results"] == [result, {**plain, "level": "warning", "message": {**plain["message"], "text": ""}}]
    assert run["artifacts"] == [{"location": {"uri": u}} for u in ("unnamed.py", "x.py")]
    stamp = run["properties"].pop("normalizer")
    assert run["properties"] == source["runs"][0]["properties"] and stamp["converter"] == "passthrough"


def test_properties_of_converted_tools_keep_their_types(spark, tmp_path):
    from repograph.plans.analysis import analyse
    from repograph.sources.documents import read_document, write_documents
    secret = {"DetectorName": "AWS", "Raw": "secret", "Verified": True}
    raws = {"trufflehog": json.dumps(secret), "lizard": json.dumps(
        [{"filename": "a.py", "function_list": [{"name": "f", "cyclomatic_complexity": 12}]}])}
    reports = spark.createDataFrame([("run1", i, t, raws[t]) for i, t in enumerate(sorted(raws))],
                                    "run_id string, doc_idx bigint, tool string, raw string")
    out = analyse(reports, tools=list(raws))
    write_documents(out.document(), str(tmp_path / "docs"), "run_id", sarif.FRAGMENT_ORDER)
    runs = json.loads(read_document(spark, str(tmp_path / "docs"), "run_id", "run1"))["runs"]
    held = {r["tool"]["driver"]["name"]: r["results"][0]["properties"] for r in runs}
    assert held == {"lizard": {"cyclomaticComplexity": 12, "functionName": "f"},
                    "trufflehog": {"detector": "AWS", "verified": True}}


def test_merged_run_properties_of_any_kind(spark):
    runs = spark.sql("""SELECT 'r' AS run_id, d AS doc_idx, 0 AS run_idx, 't' AS tool, '1' AS version,
      CAST(NULL AS string) AS extensions, from_json(p, 'map<string,variant>') AS properties
      FROM VALUES (0L, '{"b":{"x":[1,true]},"a":1}'), (1L, '{"a":"later","c":null}'), (2L, NULL) AS t(d, p)""")
    row, = merge.merge_runs(runs).select(F.to_json("properties")).collect()
    assert row[0] == '{"a":1,"b":{"x":[1,true]},"c":null}'
