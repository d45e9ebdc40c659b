"""SARIF runs: the shortest edit script against brute force, code flows, fixes that give the patched file, and the document."""

import json
import random
from pathlib import Path

from tests.test_findings import finding, table
from tracewell.operators.patch import patch_checked
from tracewell.operators.scan import scan
from tracewell.plans.corpus import TEMPLATES
from tracewell.sources.sarif import line_edits, replacements, run_results, write_run


def common(a, b):
    """Length of the longest common subsequence."""
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(new[j], row[j + 1]))
        row = new
    return row[-1]


def apply(text, made):
    """The text with regions replaced, last first."""
    lines = text.split("\n")
    start = [0]
    for x in lines:
        start.append(start[-1] + len(x) + 1)
    at = lambda line, column: start[line - 1] + column - 1
    for r in reversed(made):
        d = r["deletedRegion"]
        a, b = at(d["startLine"], d["startColumn"]), at(d["endLine"], d["endColumn"])
        text = text[:a] + r["insertedContent"]["text"] + text[b:]
    return text


def test_edit_scripts_are_right_and_shortest():
    rng = random.Random(1)
    cases = [("", ""), ("a", ""), ("", "a"), ("a", "b"), ("aaa", "aa"), ("ab", "ba")] + [("".join(rng.choices("abc", k=rng.randint(0, 9))), "".join(rng.choices("abcd", k=rng.randint(0, 9)))) for _ in range(3000)]
    for a, b in cases:
        a, b = list(a), list(b)
        out, at, edits = [], 0, 0
        for first, end, lines in line_edits(a, b):
            assert at <= first <= end <= len(a)
            out += a[at:first] + lines
            at, edits = end, edits + end - first + len(lines)
        assert out + a[at:] == b
        assert edits == len(a) + len(b) - 2 * common(a, b)


def test_replacements_give_the_other_text():
    rng = random.Random(2)
    for _ in range(2000):
        a, b = (["".join(rng.choices("xy", k=rng.randint(0, 2))) for _ in range(rng.randint(1, 6))] for _ in range(2))
        assert apply("\n".join(a), replacements(a, b, "\n")) == "\n".join(b)
    long = [str(k) for k in range(20_000)]
    assert len(replacements(long, ["import os", *long[:500], "x", *long[501:]], "\n")) == 2


def test_results(spark):
    lines = ["import db", "def f(c, uid):", '    q = f"SELECT a FROM t WHERE id = {uid}"', "    c.execute(q)", "x = 1"]
    files = spark.createDataFrame([("a.py", lines), ("b.py", ["é = open(name)"]), ("e.py", [])], "file_path string, lines array<string>")
    rows = [
        finding(path="a.py", line=4, rule="R1", source="uid", sink="c.execute(q)"), finding(path="a.py", line=2, rule="R2", source=None, sink=None), finding(path="gone.py", line=7, rule="R3", source="z"),
        finding(path="b.py", line=1, rule="R4", kind="Path Traversal", source="name"), finding(path="a.py", line=None, rule="R5", source="uid"),
    ]
    got = {r.rule_id: json.loads(r.result) for r in run_results(table(spark, *rows), files).collect()}
    flows = lambda rule: [(x["location"]["physicalLocation"]["region"]["startLine"], x["location"]["message"]["text"]) for x in got[rule]["codeFlows"][0]["threadFlows"][0]["locations"]]
    assert flows("R1") == [(3, "Taint source: variable/input 'uid'"), (4, "Taint sink: execution flow reaches 'c.execute(q)'")]
    assert flows("R2") == [(2, "Taint source: dynamic user input"), (2, "Taint sink: vulnerability execution site")]
    assert flows("R3")[0][0] == 6 and "codeFlows" not in got["R5"] and "fixes" not in got["R5"] and "fixes" not in got["R3"]
    fix = got["R1"]["fixes"][0]
    assert fix["description"]["text"] == "Suggested fix for R1" and fix["fileChanges"][0]["artifactLocation"]["uri"] == "a.py"
    assert apply("\n".join(lines), fix["fileChanges"][0]["replacements"]) == patch_checked("a.py", "\n".join(lines), [(4, "SQL Injection")])[0]
    assert apply("é = open(name)", got["R4"]["fixes"][0]["fileChanges"][0]["replacements"]) == "from werkzeug.utils import secure_filename\né = open(secure_filename(name))"


def test_the_document(spark, tmp_path):
    files = spark.createDataFrame([(f"src/f{k}{'.py' if language == 'python' else '.java' if language == 'java' else '.x'}", language, lines) for k, (language, lines) in enumerate(TEMPLATES)], "file_path string, language string, lines array<string>")
    findings = scan(files)
    write_run(findings, files, str(tmp_path / "run"), "my scanner")
    whole = json.loads("".join(p.read_text() for p in sorted(Path(tmp_path / "run").glob("part-*"))))
    run = whole["runs"][0]
    assert whole["version"] == "2.1.0" and run["tool"]["driver"]["name"] == "my scanner" and len(run["results"]) == findings.count()
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == list(dict.fromkeys(r["ruleId"] for r in run["results"]))
    assert [r["level"] for r in run["results"]] == sorted((r["level"] for r in run["results"]), key=["error", "warning", "note"].index)
    assert sum("fixes" in r for r in run["results"]) > 5 and all("codeFlows" in r for r in run["results"])
    write_run(findings.limit(0), files, str(tmp_path / "none"))
    none = json.loads("".join(p.read_text() for p in sorted(Path(tmp_path / "none").glob("part-*"))))
    assert none["runs"][0]["results"] == [] == none["runs"][0]["tool"]["driver"]["rules"]
