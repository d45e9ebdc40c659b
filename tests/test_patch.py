"""Patches, user's rules and their faults."""

import json

import pytest
from pyspark.sql import functions as F

from tracewell.operators.catalogue import RULES
from tracewell.operators.patch import NO_FINDINGS, NOTHING, patch_code, patched
from tracewell.operators.registry import Registry, checked, read_rules, readable, registry_stats
from tracewell.operators.rulespec import Match, Rule
from tracewell.operators.scan import scan
from tracewell.plans.patch_queries import OWN_RULES, patch_lines, patch_rescan

SQLI, SECRET, DESER, XSS, PATH = "SQL Injection", "Hardcoded Secret", "Insecure Deserialization", "Cross-Site Scripting (XSS)", "Path Traversal"
SSRF, CSRF, XXE = "Server-Side Request Forgery (SSRF)", "Cross-Site Request Forgery (CSRF)", "XML External Entity (XXE)"


@pytest.mark.parametrize(
    ("path", "code", "findings", "want", "changed"),
    [
        ("a.py", "key = 'abc'  # mine", [(1, SECRET)], "import os\nkey = os.environ.get('key')  # mine", [1, 2]),
        ("a.py", "import os\nkey = \"abc\"\n", [(2, SECRET), (2, SECRET)], 'import os\nkey = os.environ.get("key")\n', [2]),
        ("A.java", 'private static final String key = "abc"; // x', [(1, SECRET)], 'private static final String key = System.getenv("key"); // x', [1]),
        ("a.py", "c.execute(f\"SELECT a FROM t WHERE n = '{n}' AND i = {i}\")", [(1, SQLI)], 'c.execute("SELECT a FROM t WHERE n = ? AND i = ?", (n, i))', [1]),
        ("a.py", 'q = f"DELETE FROM t WHERE n = {n}"\nx = 1\nc.execute(q)', [(3, SQLI)], 'q = "DELETE FROM t WHERE n = ?"\nx = 1\nc.execute(q, (n,))', [1, 3]),
        (
            "A.java",
            '  Statement s = db.createStatement();\r\n  String q = "SELECT a FROM t WHERE n = \'" + n + "\'";\r\n  ResultSet r = s.executeQuery(q);',
            [(3, SQLI)],
            '  // Statement s = db.createStatement();\r\n  String q = "SELECT a FROM t WHERE n = ?";\r\n  PreparedStatement pstmt = db.prepareStatement(q);\r\n  pstmt.setString(1, n);\r\n  ResultSet r = pstmt.executeQuery();',
            [1, 2, 3],
        ),
        ("a.py", "x = pickle.loads(f(a), b)", [(1, DESER)], "import json\nx = json.loads(f(a), b)", [1, 2]),
        ("a.py", "x = yaml.load(f('a,b', 1), Loader=L)", [(1, DESER)], "x = yaml.safe_load(f('a,b', 1))", [1]),
        ("a.py", "return Markup(a) + mark_safe(b)", [(1, XSS), (1, XSS)], "import html\nreturn html.escape(a) + html.escape(b)", [1, 2]),
        ("a.py", "f = open(name, 'r')", [(1, PATH)], "from werkzeug.utils import secure_filename\nf = open(secure_filename(name), 'r')", [1, 2]),
        ("a.py", "f = open(secure_filename(n))", [(1, PATH)], "f = open(secure_filename(n))", []),
        ("a.py", "  r = requests.get(url, timeout=1)", [(1, SSRF)], '  if not url.startswith(("http://example.com", "https://example.com")): raise ValueError("Forbidden URL")\n  r = requests.get(url, timeout=1)', [1]),
        ("a.py", "WTF_CSRF_ENABLED = False", [(1, CSRF)], "WTF_CSRF_ENABLED = True", [1]),
        ("A.java", " DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();", [(1, XXE)], ' DocumentBuilderFactory f = DocumentBuilderFactory.newInstance();\n f.setFeature("http://apache.org/xml/features/disallow-doctype-decl", true);', [1]),
        ("a.js", "x = pickle.loads(a)", [(1, DESER)], "x = pickle.loads(a)", []),
        ("a.py", "x = pickle.loads(a", [(1, DESER), (None, DESER), (0, DESER), (9, DESER)], "x = pickle.loads(a", []),
    ],
)
def test_patch_code(path, code, findings, want, changed):
    got, summary, lines = patch_code(path, code, findings)
    assert (got, lines) == (want, changed)
    assert (summary == NOTHING) == (not changed)


def test_patch_summary():
    code = "a = 'x'\nb = 'y'\nz = pickle.load(f)"
    got = patch_code("a.py", code, [(1, SECRET), (2, SECRET), (3, DESER)])
    assert got[1] == "Successfully patched: replaced 2 hardcoded secret(s) with environment variable access, secured 1 deserialization call(s)."
    assert got[2] == [1, 2, 3, 4, 5] and got[0].startswith("import os\nimport json\n")
    assert patch_code("a.py", code, []) == (code, NO_FINDINGS, [])


def test_patched_frame(spark):
    files = spark.createDataFrame([("a.py", "x = pickle.loads(a)", 1), ("a.py", "x = pickle.loads(a)", 2), ("b.py", None, 3), (None, "y", 4), ("c.py", "", 5)], "file_path string, code string, summary int")
    findings = spark.createDataFrame([("a.py", 1, DESER, "R"), ("b.py", 1, DESER, "R"), ("gone.py", 1, SQLI, "R"), (None, 1, None, None), ("c.py", None, SQLI, "R")], "file_path string, line_number int, vulnerability_type string, rule_id string")
    got = sorted([(str(r.file_path), r.patched, len(r.changed_lines)) for r in patched(files, findings).collect()], key=str)
    assert got == [("None", "y", 0), ("a.py", "import json\nx = json.loads(a)", 2), ("a.py", "import json\nx = json.loads(a)", 2), ("b.py", None, 0), ("c.py", "", 0)]
    assert patched(files.limit(0), findings).count() == 0 and patched(files, findings.limit(0)).where("summary = 'No findings to patch.'").count() == 4


def test_patch_queries(spark, sf_dir):
    rows = patch_lines(spark, sf_dir).collect()
    assert len(rows) > 100 and all(r.summary.startswith("Successfully patched: ") and r.changed_lines for r in rows)
    left = patch_rescan(spark, sf_dir)
    assert 0 < left.count() < len(rows) and left.where(F.col("vulnerability_type") == SECRET).count() == 0


def test_registry(spark):
    rules = Registry([*RULES, OWN_RULES[0]])
    with pytest.raises(ValueError):
        rules.register(RULES[0])
    with pytest.raises(TypeError):
        rules.register("x")
    before = len(rules.rules("Python"))
    rules.enable(OWN_RULES[0].rule_id, False)
    assert len(rules.rules("python")) == before - 1 == len(rules.rules("python", include_disabled=True)) - 1
    stats = registry_stats(rules.frame(spark)).first()
    assert (stats.total, stats.disabled) == (len(RULES) + 1, 1) and stats.enabled == len(RULES) and "terraform" in stats.languages
    rules.unregister(OWN_RULES[0].rule_id)
    rules.unregister("none")
    assert len(rules.rules(include_disabled=True)) == len(RULES)


def test_rule_files_and_faults(spark, tmp_path):
    specs = [
        {"rule_id": "O-1", "languages": ["python"], "sink": r"eval\(", "severity": "HIGH", "kind": "Code Injection", "cwe": "CWE-95", "threshold": 0.7, "signals": [{"weight": 0.7, "scope": "line", "pattern": "request"}]},
        {"rule_id": "O-2", "languages": ["python"], "sink": "eval(", "signals": []},
        {"rule_id": "O-3", "languages": ["python"], "sink": "x", "severity": "AWFUL"},
        {"rule_id": "O-4", "languages": ["python"], "sink": "x", "signals": [{"weight": 1, "scope": "lines", "pattern": "x"}]},
        {"rule_id": "O-5", "sink": "x"},
        {"rule_id": "O-6", "languages": ["*"], "sink": "eval", "enabled": False, "signals": [{"weight": 1, "pattern": "eval"}]},
    ]
    (tmp_path / "rules.json").write_text("\n".join(json.dumps(s) for s in specs))
    rules, faults = read_rules(spark, f"file://{tmp_path}")
    assert sorted(r.rule_id for r in rules) == ["O-1", "O-6"] and {r.rule_id for r in faults.collect()} == {"O-2", "O-3", "O-4", "O-5"}
    files = spark.createDataFrame([("a.py", "python", ["eval(request.x)", "eval(1)"])], "file_path string, language string, lines array<string>")
    got = scan(files, ["O-1", "O-6"], catalogue=rules).collect()
    assert [(r.rule_id, r.line_number, r.severity_value) for r in got] == [("O-1", 1, 4)]
    mixed = [*rules, Rule("O-7", ("python",), "eval", "Unknown", "LOW", "", "", ((0.6, Match("line", "eval")),))]
    assert sorted((r.rule_id, r.line_number) for r in scan(files, catalogue=mixed).collect()) == [("O-1", 1), ("O-7", 1), ("O-7", 2)]
    assert checked(spark, RULES[:3])[1].count() == 0


def test_long_lines_become_rows(spark):
    files = spark.createDataFrame([("a", ["x", "y" * 30]), ("b", ["z"]), ("c", [])], "file_path string, lines array<string>")
    kept, long = readable(files, 20)
    assert sorted(r.file_path for r in kept.collect()) == ["b", "c"] and [tuple(r) for r in long.collect()] == [("a", 2, 30)]


def test_settings(tmp_path):
    from tracewell.sources.settings import DEFAULTS, SettingsError, ignore_lines, load_settings

    assert load_settings(None, {}) == DEFAULTS == load_settings(str(tmp_path / "none.json"), {"OTHER": "x"})
    env = {"TRACEWELL__SCANNING__MIN_SEVERITY": "HIGH", "TRACEWELL__NOTIFIERS__CHAT": "true"}
    assert load_settings(None, env)["scanning"]["min_severity"] == "HIGH" and load_settings(None, env)["notifiers"]["chat"] is True
    file = tmp_path / "s.json"
    file.write_text('{"scanning": {"min_severity": "MEDIUM"}}')
    assert load_settings(str(file), env)["scanning"]["min_severity"] == "MEDIUM"
    for bad in ("{", "[1]", '{"x": {"y": 1}}', '{"scanning": {"max_file_size_kb": 0}}', '{"scanning": {"max_file_size_kb": "9"}}', '{"scanning": {"min_severity": "AWFUL"}}'):
        file.write_text(bad)
        with pytest.raises(SettingsError):
            load_settings(str(file), {})
    (tmp_path / "ignore").write_text("a/*\n# b\n")
    assert ignore_lines(str(tmp_path / "ignore")) == ["a/*", "# b"] and ignore_lines(str(tmp_path / "gone")) == []


def test_messages(spark):
    from tests.test_findings import finding, table
    from tracewell.streaming.notify import chat_message, mail_lines, tickets

    found = table(spark, *[finding(line=k, severity="HIGH" if k < 4 else "LOW", snippet=str(k)) for k in range(1, 8)])
    blocks = json.loads(chat_message(found, "repo").first().payload)["blocks"]
    assert [b["type"] for b in blocks] == ["header", "section", "section", "divider", "section"] and "*High:* 3" in str(blocks[2])
    assert blocks[4]["text"]["text"].split("\n")[1] == "1. *[HIGH]* SQL Injection at `a.py:1`" and blocks[4]["text"]["text"].endswith("5. *[LOW]* SQL Injection at `a.py:5`\n...and 2 more.")
    assert len(json.loads(chat_message(found.limit(0), "repo").first().payload)["blocks"]) == 3
    made = [json.loads(r.payload)["fields"] for r in tickets(found, "P").collect()]
    assert len(made) == 3 and made[0]["project"] == {"key": "P"} and made[0]["summary"] == "[HIGH] Security Finding: SQL Injection in a.py"
    lines = mail_lines(found).orderBy("rank").collect()
    assert len(lines) == 7 and lines[6].text.startswith("7. [LOW] SQL Injection at a.py:7\n   Remediation: Review the SQL Injection")


def test_merging_takes_files_apart(spark, sf_dir):
    from itertools import groupby

    from tracewell.operators.findings import first_repositories, merge_file, merged, organisation_totals
    from tracewell.plans.tables import derived_findings

    found = derived_findings(spark, sf_dir).withColumn("file_path", F.when(F.col("emit_seq") % 3 > 0, "hot.py").otherwise(F.col("file_path"))).withColumn("line_number", (F.col("line_number") * F.lit(37) % 5000).cast("int"))
    key = lambda r: (r["file_path"], r["vulnerability_type"])
    rows = sorted((r.asDict() for r in found.collect()), key=key)
    want = [str(sorted(r.items())) for _, g in groupby(rows, key) for r in merge_file([dict(x) for x in g])]
    assert sorted(want) == sorted(str(sorted(r.asDict().items())) for r in merged(found).collect())
    repos = spark.createDataFrame([("o", 2, "scanned"), ("o", 1, "error"), ("o", 3, None)], "organisation string, repository int, status string")
    assert [tuple(r) for r in organisation_totals(repos).collect()] == [("o", 1, 1)]
    assert [r.repository for r in first_repositories(repos, 2, "repository").collect()] == [1, 2] and first_repositories(repos, 0).count() == 3


def test_decoding_by_language(spark):
    from tracewell.sources.files import decoded

    raw = spark.createDataFrame([("go", b"a\xe9b"), ("python", b"a\xe9b"), ("go", "é".encode())], "language string, content binary")
    assert [r[0] for r in raw.select(decoded(F.col("content"), F.col("language"))).collect()] == ["a\ufffdb", "aéb", "é"]
