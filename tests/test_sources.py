"""Listing folders and reading reports by pieces."""

import json
import os
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from repograph.normalize import normalise
from repograph.sources import folders, reports as report_source, repository


class _Stream:
    """The part of a random-access file that `read_range` uses."""

    def __init__(self, data):
        self.data = data

    def read_at(self, n, at):
        return self.data[at:at + n]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from([b"a", b"bc\r", b"\n", b"\n", b"long line " * 3]), max_size=40),
       st.integers(1, 25), st.integers(1, 9))
def test_ranges_tile_a_file_by_lines(parts, split, look):
    data = b"".join(parts)
    before, report_source._LOOK_BYTES = report_source._LOOK_BYTES, look
    try:
        pieces = [report_source.read_range(_Stream(data), b, b + split, len(data))
                  for b in range(0, max(len(data), 1), split)]
    finally:
        report_source._LOOK_BYTES = before
    pieces = [p for p in pieces if p]
    assert b"".join(p[1] for p in pieces) == data
    at = 0
    for start, raw, after in pieces:
        assert start == at
        at += len(raw)
        assert raw.endswith(b"\n") or at == len(data)
        rest = data[at:].splitlines(keepends=True) if b"\r" not in data else None
        if rest is not None:
            assert after == (rest[0] if rest else b"")


_LINES = {
    "chktex": "f{0}.tex:{0}:2: Warning: m{0} (Warning {1}).\n",
    "taplo": "error[k{1}]: m{0}\n  --> f{0}.toml:{0}:3\n",
    "lacheck": '"f{0}.tex", line {0}: m{0}\r\n',
    "deptrac": "src/F{0}.php:{0} - m{0} (A{1} -> B)\n",
    "trufflehog": '{{"DetectorName": "D{1}", "Raw": "secret{0}", "Verified": true}}\nnoise\n',
    "clippy": '{{"reason": "compiler-message", "message": {{"level": "warning", "message": "m{0}", '
              '"code": {{"code": "clippy::c{1}"}}, "spans": []}}}}\n',
    "cargo-deny": '{{"fields": {{"message": "m{0}", "severity": "error", "code": "c{1}"}}}}\n\n',
}


def _comparable(spark, reports):
    out = normalise(reports, tools=list(_LINES))
    rows = out.findings.orderBy("run_id", "tool", "doc_idx", "result_idx").drop(
        "result_idx", "original").collect()
    rules = out.rules.drop("rule_idx", "original").collect()
    runs = out.runs.collect()
    return [str(r) for r in rows], sorted(map(str, rules)), sorted(map(str, runs))


def test_pieces_normalise_like_whole_reports(spark, tmp_path):
    results = []
    for tool, line in _LINES.items():
        for run, n in (("r1", 200), ("r2", 1), ("r3", 0)):
            os.makedirs(tmp_path / run, exist_ok=True)
            body = "".join(line.format(i + 1, i % 7) for i in range(n))
            # The last line of a report may have no end.
            (tmp_path / run / f"{tool}.txt").write_bytes(body.rstrip("\n").encode())
            results.append((run, tool, True, "p"))
    results = spark.createDataFrame(
        results, "run_id string, tool string, success boolean, sarif_path string")
    whole = report_source.read_reports(spark, str(tmp_path), results)
    pieces = report_source.read_report_pieces(spark, str(tmp_path), results, split_bytes=500)
    assert whole.count() == 3 * len(_LINES) and pieces.count() > 10 * len(_LINES)
    per_task = pieces.where("run_id = 'r1' AND tool = 'clippy'").select(F.spark_partition_id())
    assert per_task.distinct().count() > 3      # one report, several tasks
    assert _comparable(spark, pieces) == _comparable(spark, whole)
    findings = normalise(pieces, tools=list(_LINES)).findings
    assert findings.count() == 201 * len(_LINES)
    assert findings.select("run_id", "tool", "result_idx").distinct().count() == 201 * len(_LINES)


def test_other_formats_are_not_cut(spark, tmp_path):
    os.makedirs(tmp_path / "r", exist_ok=True)
    raw = json.dumps({"a": ["x\n" * 10] * 50}, indent=1)
    (tmp_path / "r" / "pyright.json").write_text(raw)
    (tmp_path / "r" / "chktex").write_bytes(b"\xff\xfe:1:1: x\n")
    (tmp_path / "stray.txt").write_text("beside the runs")
    results = spark.createDataFrame([("r", "pyright", True, "p"), ("r", "chktex", True, "p"),
                                     ("r", "absent", True, "p")],
                                    "run_id string, tool string, success boolean, sarif_path string")
    got = report_source.read_report_pieces(spark, str(tmp_path), results, split_bytes=10).collect()
    assert {(r.tool, r.raw) for r in got} == {("pyright", raw), ("chktex", "��:1:1: x\n")}


def test_report_files_round_trip(spark, tmp_path):
    rows = [(f"run {i}", "semgrep", f"é{i}\n" * i) for i in range(20)] + [("empty", "semgrep", None)]
    df = spark.createDataFrame(rows, "run_id string, tool string, raw string")
    for _ in range(2):      # a repeated write changes nothing
        report_source.write_report_files(df.repartition(5), str(tmp_path / "out"))
    results = df.select("run_id", "tool", F.lit(True).alias("success"), F.lit("p").alias("sarif_path"))
    got = report_source.read_reports(spark, str(tmp_path / "out"), results).collect()
    assert {(r.run_id, r.raw) for r in got} == {(a, c or "") for a, _, c in rows}


def test_tree_is_listed_in_rounds(spark, tmp_path, monkeypatch):
    rnd = random.Random(1)
    want = {}
    for i in range(600):
        depth = rnd.randrange(6)
        folder = "/".join(["big", *(f"d{rnd.randrange(4)}" for _ in range(depth))])
        os.makedirs(tmp_path / folder, exist_ok=True)
        name = rnd.choice([".hidden", "_x", "a b+c", "é", "__init__.py"]) + str(i)
        (tmp_path / folder / name).write_bytes(b"x" * (i % 3))
        want[f"{folder}/{name}"] = i % 3
    os.makedirs(tmp_path / "big" / "empty" / "folder")
    (tmp_path / "loose").write_bytes(b"1")
    want["loose"] = 1
    rounds = []
    monkeypatch.setattr(folders, "staged", lambda df: rounds.append(1) or __import__(
        "repograph.stage", fromlist=["staged"]).staged(df))
    found = folders.list_tree(spark, str(tmp_path), budget=10)
    assert {r.path: r.size for r in found.collect()} == want
    assert len(rounds) > 2      # the large folder went back into the frontier
    rounds.clear()
    assert folders.list_tree(spark, str(tmp_path)).count() == len(want) and len(rounds) == 1
    repos = repository.list_files(spark, str(tmp_path), budget=10)
    assert {(r.repo, r.path) for r in repos.collect()} == {
        ("big", p.removeprefix("big/")) for p in want if p != "loose"}


def test_empty_and_missing_folders(spark, tmp_path):
    os.makedirs(tmp_path / "none")
    assert folders.list_tree(spark, str(tmp_path / "none")).collect() == []
    with pytest.raises(Exception, match="absent"):
        folders.list_tree(spark, str(tmp_path / "absent")).collect()


def test_undecodable_files_are_reported(spark):
    files = spark.createDataFrame([("r", "a", bytearray(b"\xff")), ("r", "b", bytearray(b"ok")),
                                   ("r", "c", None)], "repo string, path string, content binary")
    assert [tuple(r) for r in repository.decoded(files).orderBy("path").collect()] == [
        ("r", "a", None, "not valid UTF-8"), ("r", "b", "ok", None), ("r", "c", None, None)]
