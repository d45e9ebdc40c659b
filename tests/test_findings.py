"""Operators on findings, syntax trees, taint, auditors' reports and streaming."""

import hashlib
import hmac
import json
import random

import pytest
from pyspark.sql import functions as F

from tracewell.operators import findings as ops
from tracewell.operators.pyast import ast_findings, file_findings
from tracewell.operators.taint import functions_of, one_per_line, sink_parameters, taint_findings
from tracewell.sources.audits import npm_audit, pattern_report, python_audit
from tracewell.sources.files import read_files
from tracewell.sources.reports import html_report, json_rows, read_json, sarif_results, sarif_rules, text_report, write_json
from tracewell.streaming.watch import file_stream, finding_trend, latest_buffers, signature_valid, snapshot_changes, watch

SCHEMA = "file_path string, line_number int, rule_id string, vulnerability_type string, severity string, severity_value int, confidence_score double, cwe_id string, source string, sink string, code_snippet string, engine string, emit_seq long"


def finding(path="a.py", line=1, rule="PY-SQLI-001", kind="SQL Injection", severity="HIGH", score=0.5, cwe="CWE-89", source=None, sink=None, snippet=None, engine="internal", seq=0):
    return (path, line, rule, kind, severity, {"INFO": 1, "LOW": 2, "MEDIUM": 3, "HIGH": 4, "CRITICAL": 5}[severity], score, cwe, source, sink, snippet, engine, seq)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), SCHEMA)


@pytest.mark.parametrize(
    ("row", "score", "severity"),
    [
        (finding(kind="Path Traversal", source="s", sink="k"), 0.8, "HIGH"),
        (finding(kind="Path Traversal", score=0.8, source="s", sink="escape(x)"), 0.7, "MEDIUM"),
        (finding(), 0.6, "HIGH"),
        (finding(kind="Hardcoded Secret", score=0.85), 0.85, "CRITICAL"),
        (finding(kind="Hardcoded Secret", score=0.6), 0.6, "HIGH"),
        (finding(kind="Path Traversal", snippet="escape(a)"), 0.1, "INFO"),
    ],
)
def test_rescoring(spark, row, score, severity):
    got = ops.rescored(table(spark, row)).first()
    assert got.confidence_score == pytest.approx(score) and got.severity == severity


def test_rank_is_global(spark):
    r = random.Random(0)
    rows = [finding(path=f"f{r.randint(0, 9)}", line=r.choice([None, 1, 5]), severity=r.choice(["INFO", "LOW", "HIGH", "CRITICAL"]), score=r.random(), seq=k) for k in range(300)]
    got = {x.emit_seq: x["rank"] for x in ops.ranked(table(spark, *rows).repartition(5), ["emit_seq"]).collect()}
    want = sorted(rows, key=lambda x: (-x[5], -x[6], x[0], x[1] or 0, x[2], x[12]))
    assert [got[x[12]] for x in want] == list(range(1, 301))


def merge(spark, *rows):
    return sorted((r.rule_id, round(r.confidence_score, 6)) for r in ops.merged(table(spark, *rows)).collect())


def test_merge(spark):
    assert merge(spark, finding(score=0.75), finding(rule="EXT-SQLI", score=0.65, engine="external", seq=1)) == [("PY-SQLI-001 + EXT-SQLI", 0.95)]
    assert len(merge(spark, finding(line=15), finding(line=2, rule="EXT-SQLI", engine="external", seq=1))) == 2
    assert merge(spark, finding(rule="A", score=0.7), finding(rule="B", score=0.6, engine="external", seq=1)) == [("A + B", 0.9)]
    assert merge(spark, finding(rule="A", score=0.7), finding(rule="B", score=0.6, cwe="CWE-1", engine="external", seq=1)) == [("A + B", 0.7)]
    assert merge(spark, finding(rule="A", score=0.5), finding(rule="B", score=0.5, engine="external", seq=1), finding(rule="C", score=0.5, engine="external", seq=2)) == [("A + B + C", 0.9)]
    assert len(merge(spark, finding(line=None), finding(line=None, engine="external", seq=1))) == 2


def test_near_pairs_match_brute_force(spark):
    r = random.Random(5)
    rows = [finding(path=r.choice("ab"), line=r.choice([None, *range(1, 60)]), engine=r.choice(["internal", "external"]), seq=k) for k in range(120)]
    t = table(spark, *rows)
    got = {(x.emit_seq, x.x_emit_seq) for x in ops.near_pairs(t.where("engine = 'internal'"), t.where("engine = 'external'")).collect()}
    assert got == {(a[12], b[12]) for a in rows for b in rows if a[11] == "internal" and b[11] == "external" and a[0] == b[0] and a[1] and b[1] and abs(a[1] - b[1]) <= 10}


def test_suppression(spark):
    t = table(spark, finding(path="src/a.py", line=2, seq=1), finding(path="src/b.py", line=3, rule="X-1", seq=2), finding(path="lib/c.py", line=1, seq=3), finding(path="src/a.py", line=None, seq=4))
    left = lambda df: sorted(r.emit_seq for r in df.collect())
    assert left(ops.without_ignored(t, ["# c", "src/*:X-1", "lib"])) == [1, 4]
    allow = spark.createDataFrame([("src/a.py", None, 2), ("src/b.py", "x-1", None), (None, None, None)], "file_path string, rule_id string, line_number int")
    assert left(ops.allowlisted(t, allow)) == [3, 4]
    files = spark.createDataFrame([("src/a.py", ["x", "y  # mark: ignore py-sqli-001"]), ("src/b.py", ["", "# mark: ignore other", "z"]), ("lib/c.py", ["# MARK: ignore"])], "file_path string, lines array<string>")
    assert left(ops.without_commented(t, files, "mark")) == [2, 4]
    joined = t.join(files, "file_path").select("emit_seq", ops.comment_suppresses(F.col("lines"), F.col("line_number"), F.col("rule_id"), "mark").alias("s"))
    assert {r.emit_seq: r.s for r in joined.collect()} == {1: True, 2: False, 3: True, 4: False}
    assert {r.severity for r in ops.with_overrides(t, {"X-1": "info", "PY-SQLI-001": "bad"}).collect()} == {"INFO", "HIGH"}


def test_rollups(spark):
    t = table(spark, finding(severity="MEDIUM"), finding(severity="LOW", path="b"))
    s = ops.summary(t).first()
    assert (s.total, s.risk_score, s.risk_level) == (2, 3, "MEDIUM")
    assert ops.summary(t.limit(0)).first().risk_level == "CLEAR"
    assert {r.severity: r.n for r in ops.by_severity(t).collect()} == {"INFO": 0, "LOW": 1, "MEDIUM": 1, "HIGH": 0, "CRITICAL": 0}
    assert {r.status for r in ops.compliance_status(t).collect()} == {"Non-Compliant"} and {r.status for r in ops.compliance_status(t.limit(0)).collect()} == {"Compliant"}
    assert ops.with_compliance(t).first().compliance["SOC 2"] == "CC7.1"
    assert ops.gate_fails(t) and not ops.gate_fails(t, "HIGH")
    d = ops.with_derived(table(spark, finding(score=0.125, line=None))).first()
    assert (d.confidence_percent, d.confidence_tier, d.location) == (12, "LOW", "a.py")


def test_evaluation(spark):
    t = table(spark, finding(rule="AB"), finding(rule="AB", seq=1), finding(rule="C", seq=2), finding(path="b", rule="D", seq=3)).withColumnRenamed("emit_seq", "seq")
    expected = table(spark, finding(rule="A"), finding(rule="C", seq=1), finding(rule="Z", seq=2)).withColumnRenamed("emit_seq", "seq")
    files = spark.createDataFrame([("a.py",), ("b",), ("clean",)], "file_path string")
    r = ops.rates(ops.evaluated(expected, t), files).first()
    assert (r.tp, r.fp, r.fn, r.tn) == (2, 2, 1, 1) and r.tpr == pytest.approx(2 / 3) and r.fpr == pytest.approx(2 / 3)


def rules_of(code):
    return {(f[1], f[0], f[5]) for f in file_findings(code.split("\n"))}


def test_syntax_tree_checks(spark):
    assert rules_of("q = f'SELECT {name}'\ncursor.execute(q)") == {("AST-PY-SQLI-001", 2, 0.95)}
    assert rules_of("cursor.execute('SELECT %s', (x,))") == set() and rules_of("cursor.execute('SELECT 1')") == set()
    assert rules_of("subprocess.run(request.args['c'], shell=True)\nos.system('a' + b)") == {("AST-PY-CMDI-001", 1, 0.90), ("AST-PY-CMDI-001", 2, 0.80)}
    assert rules_of("eval('1')\neval(user_input)") == {("AST-PY-CODEI-002", 1, 0.60), ("AST-PY-CODEI-001", 2, 0.95)}
    assert rules_of("pickle.load(f)\nyaml.load(f)\nyaml.load(f, Loader=yaml.SafeLoader)") == {("AST-PY-DESER-001", 1, 0.85), ("AST-PY-DESER-002", 2, 0.70)}
    assert rules_of("p = secure_filename(request.args['f'])\nopen(p)\nopen(input())") == {("AST-PY-PATH-001", 3, 0.75)}
    assert rules_of("def f(:") == set() and rules_of("  \n") == set()
    files = spark.createDataFrame([("a", "python", ["eval(x)"]), ("b", "java", ["eval(x)"]), ("c", "python", None)], "file_path string, language string, lines array<string>")
    assert [r.file_path for r in ast_findings(files).collect()] == ["a"]


def trace(spark, **modules):
    files = spark.createDataFrame([(k, "python", v.split("\n")) for k, v in modules.items()], "file_path string, language string, lines array<string>")
    return files, {(r.file_path, r.line_number, r.vulnerability_type, r.source) for r in taint_findings(files).collect()}


def test_taint_across_files(spark):
    _, one = trace(spark, db="def run(q):\n    cur.execute('SELECT ' + q)", app="x = request.args\ny = 1\nrun(x)")
    assert one == {("app", 3, "SQL Injection", "request.args")}
    _, two = trace(spark, db="def low(q):\n    cur.execute(f'{q}')", mid="def high(a, b):\n    c = b\n    low(c)", app="def h():\n    v = request.GET\n    w = v\n    pass\n    high(1, w)")
    assert two == {("app", 5, "SQL Injection", "request.GET")}
    files, both = trace(spark, lib="def f(a):\n    os.system(a)\n    open('x' + a)", app="f(params)")
    assert {t for _, _, t, _ in both} == {"Command Injection", "Path Traversal"}
    assert [r.vulnerability_type for r in one_per_line(taint_findings(files)).collect()] == ["Command Injection"]
    cyc, none = trace(spark, m="def a(x):\n    b(x)\ndef b(x):\n    a(x)\na(input)")
    assert none == set() and sink_parameters(functions_of(cyc)).count() == 0


def test_auditors(spark):
    reports = lambda *texts: spark.createDataFrame([("r", t) for t in texts], "file_path string, report string")
    pip = {"dependencies": [{"name": "p", "version": "1", "vulns": [{"id": "GHSA-1", "fix_versions": ["2", "3"]}, {"id": "X"}]}, {"name": "q", "version": "1", "vulns": []}]}
    got = python_audit(reports(json.dumps(pip), json.dumps(pip["dependencies"]), "no json", "{}")).collect()
    assert len(got) == 4 and {r.rule_id for r in got} == {"SCA-GHSA-1", "SCA-X"} and {r.recommendation for r in got} == {"Upgrade p to one of: 2, 3", "Upgrade p to the latest secure version."}
    npm = {"vulnerabilities": {"a": {"severity": "moderate", "via": [{"title": "t", "cwe": ["CWE-5"]}, "b"], "range": "<2", "fixAvailable": True}}, "advisories": {"9": {"module_name": "c", "severity": "low", "cwe": "CWE-7", "findings": [{"version": "1"}]}}}
    got = {(r.rule_id, r.severity, r.confidence_score, r.cwe_id) for r in npm_audit(reports(json.dumps(npm), "[]", "x")).collect()}
    assert got == {("SCA-NPM-a", "HIGH", 0.9, "CWE-5"), ("SCA-NPM-a", "HIGH", 0.8, "CWE-1104"), ("SCA-NPM-c", "LOW", 0.9, "CWE-7")}
    ext = {"results": [{"check_id": "x.sqli", "path": "p", "start": {"line": 3}, "extra": {"severity": "ERROR", "lines": " a ", "metadata": {"confidence": "HIGH"}}}]}
    r = pattern_report(reports(json.dumps(ext))).first()
    assert (r.rule_id, r.severity, r.confidence_score, r.cwe_id, r.code_snippet) == ("EXT-X.SQLI", "CRITICAL", 0.85, "CWE-89", "a")


def test_files_and_reports(spark, tmp_path):
    for name, data in {"a.py": b"\xef\xbb\xbfx = 1\r\ny", "sub/Dockerfile": b"FROM a", "node_modules/b.js": b"x", "c.bin": b"x", "d.php": b"\xe9", "e.PY": b"\n", "empty.py": b""}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = {r.file_path: r for r in read_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.py", "sub/Dockerfile", "d.php", "e.PY"}
    assert got["a.py"].code == "x = 1\ny" and got["a.py"].lines == ["x = 1", "y"] and got["d.php"].code == "é" and got["e.PY"].lines == [""] and got["sub/Dockerfile"].language == "dockerfile"
    t = table(spark, finding(snippet="s"), finding(line=None, rule="B"))
    assert json.loads(json_rows(t).first().value)["confidence_percent"] == 50
    write_json(t, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out/findings")).count() == 2
    (tmp_path / "r.json").write_text(json.dumps({"findings": [{"file_path": "a", "severity": "low"}]}))
    assert read_json(spark, str(tmp_path / "r.json")).first().vulnerability_type == "Unknown"
    prints = {r.rule_id: r.fingerprint for r in sarif_results(t).collect()}
    assert prints == {"PY-SQLI-001": hashlib.sha256(b"s").hexdigest(), "B": hashlib.sha256(b"B:a.py:None").hexdigest()}
    assert {r.id for r in sarif_rules(t).collect()} == {"PY-SQLI-001", "B"}
    assert "<table>" in html_report(t, "a<b") and "2 findings" in text_report(t)


def test_source_line(spark):
    got = spark.createDataFrame([(["a = uid", "b", "run(a)"], 3, "uid"), (["a", "b"], 2, "zz"), (["a", "b"], 2, "")], "lines array<string>, n int, s string")
    assert [r.x for r in got.select(ops.source_line(F.col("lines"), F.col("n"), F.col("s")).alias("x")).collect()] == [1, 1, 2]


def test_streams(spark, tmp_path):
    src, seen = tmp_path / "src", []
    src.mkdir()
    (src / "a.py").write_text("os.system('x' + y)\n")
    q = watch(file_stream(spark, str(src)), lambda df, n: seen.extend(r.rule_id for r in df.collect()), str(tmp_path / "cp"), "0 seconds").start()
    q.processAllAvailable()
    (src / "b.py").write_text("DEBUG = True\n")
    q.processAllAvailable()
    q.stop()
    assert seen == ["PY-CMD-001", "PSEC-CONFIG-PY-001"]
    before = spark.createDataFrame([("a", 1), ("b", 1), ("c", 2)], "file_path string, mtime int")
    now = spark.createDataFrame([("a", 1), ("b", 2), ("d", 1), ("c", 1)], "file_path string, mtime int")
    assert {(r.file_path, r.change) for r in snapshot_changes(before, now).collect()} == {("b", "modified"), ("d", "added")}
    assert {(r.file_path, r.change) for r in snapshot_changes(now, before.where("file_path <> 'a'")).collect()} == {("a", "deleted"), ("d", "deleted"), ("c", "modified")}
    assert latest_buffers(spark.createDataFrame([("u", 1, "old"), ("u", 2, "new")], "uri string, version int, text string")).first().text == "new"
    body = "x"
    good = "sha256=" + hmac.new(b"k", body.encode(), hashlib.sha256).hexdigest()
    rows = spark.createDataFrame([(body, good), (body, "sha256=0"), (body, None)], "b string, h string")
    assert [r.v for r in rows.select(signature_valid(b"k")(F.col("b"), F.col("h")).alias("v")).collect()] == [True, False, False]
    trend = finding_trend(spark.createDataFrame([("2024-01-01 00:10:00", "HIGH"), ("2024-01-01 00:20:00", "HIGH")], "t string, severity string").select(F.to_timestamp("t").alias("detected_at"), "severity"))
    assert trend.first().n == 2


def test_manifests(spark):
    from tracewell.sources.manifests import python_requirements

    toml = '[project]\ndependencies = ["a>=1"]\n[project.optional-dependencies]\nx = ["b"]\n[tool.poetry.dependencies]\npython = "^3"\nc = "^2"\nd = {version = "1.0"}\ne = "*"'
    rows = [("p/requirements.txt", "q==1  # note\n\n-r other\n"), ("p/pyproject.toml", toml), ("z/pyproject.toml", toml), ("bad/pyproject.toml", "["), ("x.py", "")]
    got = {(r.file_path, r.requirement) for r in python_requirements(spark.createDataFrame(rows, "file_path string, code string")).collect()}
    assert got == {("p/requirements.txt", "q==1"), *(("z/pyproject.toml", x) for x in ("a>=1", "b", "c>=2", "d==1.0", "e"))}


def test_command_line(spark, tmp_path, capsys):
    from tracewell.__main__ import main

    (tmp_path / "a.py").write_text("os.system('x' + y)\n")
    assert main(["scan", str(tmp_path)]) == 1 and "PY-CMD-001" in capsys.readouterr().out
    assert main(["scan", str(tmp_path), "--override", "PY-CMD-001=low", "--fail-on", "high"]) == 0


def test_deep_files_and_long_chains(spark):
    from tracewell.operators.pyast import file_findings
    from tracewell.operators.taint import functions_of, sink_parameters

    deep = "x = " + " + ".join(["a"] * 3000)
    assert file_findings([deep, "eval(request.args)"])[0][1] == "AST-PY-CODEI-001"
    lines = [deep, f"cursor.execute({' + '.join(['user_input'] * 3000)})"]
    assert [f[0] for f in file_findings(lines)] in ([2], [])
    chain = [line for k in range(12) for line in (f"def f{k}(q):", f"    f{k + 1}(q)")] + ["def f12(q):", "    cursor.execute('x' + q)", "def g(q):", "    h(q)", "def h(q):", "    g(q)"]
    files = spark.createDataFrame([("a.py", "python", chain), ("deep.py", "python", [deep])], "file_path string, language string, lines array<string>")
    assert {r.name for r in sink_parameters(functions_of(files)).collect()} == {f"f{k}" for k in range(13)}


def test_no_shared_folder_on_a_cluster():
    from types import SimpleNamespace

    from tracewell.operators.cut import shared_folder

    session = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master="yarn", getCheckpointDir=lambda: None))
    with pytest.raises(ValueError):
        shared_folder(session)
