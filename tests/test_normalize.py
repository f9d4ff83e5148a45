"""Each converter against literal reports with hand-written rows."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from repograph.normalize import CONVERTERS, normalise
from repograph.normalize.json_tools import lizard


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def run(spark, reports, **options):
    rows = [("r", i, tool, raw) for i, (tool, raw) in enumerate(reports)]
    df = spark.createDataFrame(rows, "run_id string, doc_idx bigint, tool string, raw string")
    return normalise(df, tools=[t for t, _ in reports], **options)


def values(properties):
    """A property map as Python values, each of its own type."""
    return {k: v.toPython() for k, v in properties.items()}


def findings(spark, tool, raw):
    out = run(spark, [(tool, raw)]).findings.orderBy("doc_idx", "run_idx", "result_idx").collect()
    return [(r.rule_id, r.level, r.message,
             [tuple(x) for x in r.locations] if r.locations else None) for r in out]


def test_sarif(spark):
    raw = json.dumps({"version": "2.1.0", "runs": [{
        "tool": {"driver": {"name": "t", "rules": [{"id": "R1", "fullDescription": {"text": "d"}}]}},
        "results": [{"ruleId": "R1", "level": "error", "message": {"text": "m"}, "locations": [
            {"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 3}}}],
            "fingerprints": {"z": "1", "a": "2"}}, {"ruleId": "R2"}]}]})
    out = run(spark, [("semgrep", raw)], processed_at="2024-01-01T00:00:00Z")
    first, second = out.findings.orderBy("result_idx").collect()
    assert (first.tool, first.rule_id, first.level, first.message) == ("t", "R1", "error", "m")
    values = out.findings.where("result_idx = 0").select(F.map_values("fingerprints")).collect()
    assert values[0][0] == ["1", "2"]  # document order, not key order
    assert tuple(first.locations[0]) == ("a.py", 3, None, None, None)
    assert second.level is None and second.locations is None
    rule = out.rules.collect()[0]
    assert (rule.rule_id, rule.description, rule.tool) == ("R1", "d", "t")
    props = out.runs.collect()[0].properties["normalizer"].toPython()
    assert props == {"converter": "passthrough", "originalTool": "semgrep", "category": "sast",
                     "processedAt": "2024-01-01T00:00:00Z"}


def test_rejects(spark):
    out = run(spark, [
        ("semgrep", "not json"), ("semgrep", '{"version":"2.0.0","runs":[]}'),
        ("semgrep", '{"runs":[]}'), ("semgrep", '{"runs":[{"tool":{"driver":{}}}]}'),
        ("semgrep", '{"runs":[{"tool":{"driver":{"name":"x"}},"results":{}}]}'),
        ("detect-secrets", "{}"), ("pyright", "oops"), ("phpcs", "<a"), ("shellcheck", "{}"),
        ("lizard", "[oops"), ("horusec", "  ")])
    got = {r.doc_idx: r.reason for r in out.rejects.collect()}
    assert got == {
        0: "not JSON", 1: "unsupported version", 2: "no runs", 3: "run without tool.driver.name",
        4: "not JSON of the expected structure", 5: "no converter for this format",
        6: "not JSON of the expected structure", 7: "not XML",
        8: "not JSON of the expected structure", 9: "not JSON of the expected structure"}
    assert [r.doc_idx for r in out.runs.collect()] == [10]
    assert out.findings.count() == 0


def test_pyright(spark):
    raw = json.dumps({"version": "1", "generalDiagnostics": [
        {"file": "a.py", "severity": "information", "message": "m", "rule": "r", "range": {
            "start": {"line": 0, "character": 4}, "end": {"line": 0, "character": 9}}},
        {"message": "no file"}, {"file": "b.py"}]})
    assert findings(spark, "pyright", raw) == [
        ("r", "note", "m", [("a.py", 1, 5, 1, 10)]),
        ("pyright-diagnostic", "warning", "", [("b.py", 1, 1, 1, 1)])]


def test_lizard(spark):
    want = [("lizard/high-cyclomatic-complexity", "warning",
             "Function 'f' has cyclomatic complexity 12 (threshold 10) [NLOC=30]",
             [("a.py", 3, None, 40, None)])]
    fn = {"name": "f", "cyclomatic_complexity": 12, "start_line": 3, "end_line": 40, "nloc": 30}
    file = {"filename": "a.py", "function_list": [fn, {"name": "g", "ccn": 10}]}
    for raw in ([file], {"files": [file]}, file):
        assert findings(spark, "lizard", json.dumps(raw)) == want
    row = "30,12,100,2,38,loc,a.py,f,3,40"
    message = "Function 'f' has cyclomatic complexity 12 (threshold 10) [NLOC=30, tokens=100, params=2]"
    csv = [(want[0][0], "warning", message, [("a.py", 3, None, 40, None)])]
    header = "NLOC,CCN,token,PARAM,length,location,file,function,start,end\n"
    assert findings(spark, "lizard", row) == csv
    assert findings(spark, "lizard", header + "\n" + row + "\n30,9,1,1,1,l,b,g,1,2") == csv
    out = run(spark, [("lizard", " ")])
    assert out.rules.count() == 0 and out.runs.count() == 1
    strict = run(spark, [("lizard", row)], extra={"lizard": lizard(12)})
    assert strict.findings.count() == 0 and strict.rules.count() == 1


def test_trufflehog(spark):
    lines = [
        {"DetectorName": "AWS", "Verified": True, "Raw": "AKIA12345",
         "SourceMetadata": {"Data": {"Filesystem": {"file": "a.env", "line": 0}}}},
        {"Raw": "abcd", "SourceMetadata": {"Data": {"Git": {"file": "g", "line": 7}}}}]
    raw = json.dumps(lines[0]) + "\nnoise\n[1]\n" + json.dumps(lines[1])
    out = run(spark, [("trufflehog", raw)])
    a, b = out.findings.orderBy("result_idx").collect()
    assert (a.rule_id, a.level, a.message) == (
        "trufflehog/AWS", "error", "VERIFIED secret detected by AWS: AKIA****")
    assert a.locations[0].start_line == 1 and b.locations[0].start_line == 7
    assert a.fingerprints == {"trufflehog/v1": sha("AWS:a.env:" + sha("AKIA12345"))}
    assert values(a.properties) == {"detector": "AWS", "verified": True}
    assert (b.rule_id, b.level, b.message) == (
        "trufflehog/unknown-detector", "warning", "unverified secret detected by unknown-detector: ****")
    empty = run(spark, [("trufflehog", "noise")])
    assert [r.rule_id for r in empty.rules.collect()] == ["trufflehog/secret-detected"]


def test_horusec(spark):
    vuln = {"vulnHash": "abcdef0123456789", "severity": "HIGH", "line": "42", "column": "0",
            "file": "a.go", "details": "d", "securityTool": "GoSec"}
    raw = json.dumps({"version": "2", "analysisVulnerabilities": [
        {"vulnerabilities": vuln}, {"vulnerability": {"file": "b", "line": "x"}}, {}]})
    out = run(spark, [("horusec", raw)])
    a, b = out.findings.orderBy("result_idx").collect()
    assert (a.rule_id, a.level, a.message) == ("horusec/gosec/abcdef012345", "error", "d")
    assert tuple(a.locations[0]) == ("a.go", 42, None, None, None)
    assert a.fingerprints == {"horusec/v1": sha("abcdef0123456789")}
    assert values(a.properties) == {"securityTool": "GoSec"}
    assert (b.rule_id, b.level, b.message) == (
        "horusec/horusec", "warning", "Vulnerability detected by horusec")
    assert b.fingerprints == {"horusec/v1": sha("b:1:")}
    assert out.runs.collect()[0].version == "2"


def test_deptrac(spark):
    raw = "\n".join(["src/A.php:42 - A must not depend on B (LayerA -> LayerB)",
                     "src/C.php::C must not depend on D", r"App\X must not depend on Y", "Report:"])
    out = run(spark, [("deptrac", raw)])
    a, b, c = out.findings.orderBy("result_idx").collect()
    assert a.message == "A must not depend on B (LayerA -> LayerB)"
    assert values(a.properties) == {"sourceLayer": "LayerA", "targetLayer": "LayerB"}
    assert a.fingerprints == {"deptrac/v1": sha("src/A.php:42:" + a.message)}
    assert (b.locations[0].uri, b.locations[0].start_line, b.properties) == ("src/C.php", 1, None)
    assert c.message == r"App\X must not depend on Y" and c.locations is None


def test_clippy(spark):
    def line(level, code, spans=(), reason="compiler-message"):
        return json.dumps({"reason": reason, "message": {
            "level": level, "message": "m", "code": code, "spans": list(spans)}})
    span = lambda n, primary: {"is_primary": primary, "file_name": n, "line_start": 1,
                               "line_end": 1, "column_start": 2, "column_end": 5}
    raw = "\n".join([
        line("warning", {"code": "clippy::x"}, [span("b.rs", False), span("a.rs", True)]),
        line("note", None), line("note", {"code": "clippy::y"}, [span("c.rs", False)]),
        line("error", "E1", reason="build"), line("error", None), '{"reason":"compiler-message"}'])
    assert findings(spark, "clippy", raw) == [
        ("clippy/clippy::x", "warning", "m", [("a.rs", 1, 2, 1, 5)]),
        ("clippy/clippy::y", "note", "m", [("c.rs", 1, 2, 1, 5)]),
        ("clippy/clippy-diagnostic", "error", "m", None)]


def test_phpcs(spark):
    raw = ('<?xml version="1.0"?><checkstyle version="3"><file name="a.php">'
           '<error line="2" column="1" severity="error" message="m" source="S.R"/>'
           '<warning line="x" message="&lt;error w"/><error line="4" severity="warning"/></file>'
           '<file name="b.php"></file></checkstyle>')
    assert findings(spark, "phpcs", raw) == [
        ("S.R", "error", "m", [("a.php", 2, 1, None, None)]),
        ("phpcs/unknown-rule", "warning", "<error w", [("a.php", 1, None, None, None)]),
        ("phpcs/unknown-rule", "warning", "", [("a.php", 4, None, None, None)])]
    out = run(spark, [("phpcs", raw)])
    assert [(r.tool, r.version) for r in out.runs.collect()] == [("PHP_CodeSniffer", "3")]
    assert sorted(r.rule_id for r in out.rules.collect()) == ["S.R", "phpcs/unknown-rule"]


def test_cargo_deny(spark):
    raw = "\n".join([
        json.dumps({"type": "diagnostic", "fields": {
            "severity": "error", "message": "m", "code": "banned",
            "labels": [{"span": {}}, {"span": {"file": "Cargo.lock", "line_start": 7}}]}}),
        json.dumps({"message": "bare", "level": "note", "code": {"code": "dup"}}),
        json.dumps({"fields": {"message": ""}}), "x"])
    assert findings(spark, "cargo-deny", raw) == [
        ("cargo-deny/banned", "error", "m", [("Cargo.lock", 7, None, None, None)]),
        ("cargo-deny/dup", "note", "bare", None)]


def test_taplo(spark):
    raw = "error[syntax]: bad key\n  --> a.toml:3:5\ninfo[style]: tidy\n\n  --> b.toml:1:1\n"
    assert findings(spark, "taplo", raw) == [
        ("taplo/syntax", "error", "bad key", [("a.toml", 3, 5, None, None)]),
        ("taplo/style", "note", "tidy", None)]


def test_cargo_audit(spark):
    raw = json.dumps({"vulnerabilities": {"list": [
        {"advisory": {"id": "RUSTSEC-1", "title": "t", "url": "u"},
         "package": {"name": "p", "version": "1"}, "versions": {"patched": []}},
        {"versions": {"patched": [">=1", ">=2"]}}]}})
    assert findings(spark, "cargo-audit", raw) == [
        ("cargo-audit/RUSTSEC-1", "error", "RUSTSEC-1: t in p@1 (patched: none) -- u", None),
        ("cargo-audit/UNKNOWN", "error", "UNKNOWN:  in unknown@unknown (patched: >=1, >=2)", None)]


def test_shellcheck(spark):
    raw = json.dumps([{"file": "a.sh", "line": 0, "column": 1, "level": "style", "code": 2086,
                       "message": "m"}, {"line": 3},
                      {"file": "b.sh", "line": 4, "column": 2, "endLine": 5, "endColumn": 0}])
    assert findings(spark, "shellcheck", raw) == [
        ("SC2086", "note", "m", [("a.sh", 1, 1, 1, 1)]),
        ("SC0", "warning", "", [("b.sh", 4, 2, 5, 1)])]


def test_chktex(spark):
    raw = ("main.tex:12:5: Warning: Command terminated with space. (Warning 1).\n"
           "a.tex:1:2: Error: Plain message\nnoise")
    assert findings(spark, "chktex", raw) == [
        ("chktex/W1", "warning", "Command terminated with space.", [("main.tex", 12, 5, None, None)]),
        ("chktex/W0", "error", "Plain message", [("a.tex", 1, 2, None, None)])]


def test_cargo_udeps(spark):
    raw = json.dumps({"unused_deps": {
        "c": {"manifest_path": "Cargo.toml", "normal": ["serde"], "development": [{"name": "x"}],
              "build": []}, "bad": 1, "d": {"normal": ["y"], "build": "z"}}})
    got = findings(spark, "cargo-udeps", raw)
    assert [g[2] for g in got] == [
        "Unused normal dependency 'serde' in crate 'c' (Cargo.toml)",
        "Unused development dependency 'x' in crate 'c' (Cargo.toml)",
        "Unused normal dependency 'y' in crate 'd'"]


def test_lacheck(spark):
    assert findings(spark, "lacheck", '"main.tex", line 9: possible unwanted space\nx') == [
        ("lacheck/warning", "warning", "possible unwanted space", [("main.tex", 9, None, None, None)])]


@pytest.mark.parametrize("tool,rule", [
    ("taplo", "taplo/unknown"), ("chktex", "chktex/W0"), ("deptrac", "deptrac/forbidden-dependency"),
    ("lacheck", "lacheck/warning"), ("clippy", None)])
def test_rules_of_an_empty_report(spark, tool, rule):
    got = [r.rule_id for r in run(spark, [(tool, "")]).rules.collect()]
    assert got == ([rule] if rule else [])


def test_extra_converter(spark):
    """A new tool plugs in as another converter."""
    from dataclasses import replace
    mine = replace(CONVERTERS["lacheck"], tool="mytool")
    out = run(spark, [("mytool", '"m", line 1: x')], extra={"mytool": mine})
    assert out.findings.select(F.col("message")).collect()[0].message == "x"


def test_lizard_csv_of_any_width_and_with_quoted_breaks(spark):
    header = ",".join([f"x{k}" for k in range(40)] + ["ccn", "file", "function", "start"])
    rows = [",".join(["1"] * 40 + ["20", '"a,\n""b"".py"', "f", "3"]),
            ",".join([""] * 40 + ["30", "c.py", '"g\n\nh"', "4"])]
    got = findings(spark, "lizard", "\n".join([header, *rows]))
    assert [r[2].split(" (")[0] for r in got] == [
        "Function 'f' has cyclomatic complexity 20", "Function 'g\n\nh' has cyclomatic complexity 30"]
