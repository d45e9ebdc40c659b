"""Every setting changes what a scan finds; faults and figures of a scan."""

import json
from copy import deepcopy

import pytest

from tracewell.__main__ import main
from tracewell.operators.entry import scan_tree
from tracewell.operators.rulespec import Match, Rule
from tracewell.sources.lists import read_allowlist, read_ground_truth
from tracewell.sources.settings import DEFAULTS


@pytest.fixture
def tree(tmp_path):
    root = tmp_path / "tree"
    for name, text in {
        "a.py": "os.system('x' + y)\nDEBUG = True\n", "lib/b.py": "os.system('x' + y)\n" + "# pad\n" * 400, "skip/c.py": "os.system('x' + y)\n", "d.js": "const h = crypto.createHash('md5');\n",
        "long.py": "os.system('x' + y)\nx = '" + "a" * 20_000 + "'\n",
    }.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    return str(root)


def found(spark, root, ignore=(), rules=None, **scanning):
    settings = deepcopy(DEFAULTS)
    settings["scanning"] |= {"min_severity": "INFO"} | scanning
    lines = spark.createDataFrame([(x,) for x in ignore], "line string") if ignore else None
    done = scan_tree(spark, root, settings, lines, **({"rules": rules} if rules else {}))
    return done, {(r.file_path, r.rule_id, r.severity) for r in done.findings.collect()}


def test_every_setting_changes_rows(spark, tree):
    done, every = found(spark, tree)
    assert {f for f, _, _ in every} == {"a.py", "lib/b.py", "skip/c.py", "d.js"}
    stats = done.statistics.first()
    assert (stats.files, stats.findings, stats.rules_failed) == (5, done.findings.count(), 0) and stats.lines == 2 + 401 + 1 + 1 + 2 and stats.seconds > 0 and stats.rules_run > 40
    assert [(r.kind, r.file_path, r.line_number) for r in done.faults.collect()] == [("line", "long.py", 2)]
    assert {f for f, _, _ in found(spark, tree, max_file_size_kb=1)[1]} == {"a.py", "skip/c.py", "d.js"}
    assert {f for f, _, _ in found(spark, tree, exclude_dirs=["skip"])[1]} == {"a.py", "lib/b.py", "d.js"}
    assert {f for f, _, _ in found(spark, tree, exclude_extensions=["js"])[1]} == {"a.py", "lib/b.py", "skip/c.py"}
    severe = found(spark, tree, min_severity="CRITICAL")[1]
    assert severe and severe < every and {s for _, _, s in severe} == {"CRITICAL"}
    low = found(spark, tree, severity_overrides={"PY-CMD-001": "low"}, min_severity="MEDIUM")[1]
    assert low == {x for x in every if x[1] != "PY-CMD-001"}
    assert found(spark, tree, ignore=["lib", "*.py:PSEC-CONFIG-PY-001"])[1] == {x for x in every if x[0] != "lib/b.py" and x[1] != "PSEC-CONFIG-PY-001"}


def test_a_broken_rule_is_a_fault(spark, tree):
    rules = [Rule("O-1", ("python",), r"system\(", "X", "HIGH", "", "", ((0.9, Match("line", "os")),)), Rule("O-2", ("python",), "(", "X", "HIGH", "", "")]
    done, rows = found(spark, tree, rules=rules)
    assert {r for _, r, _ in rows if r.startswith("O-")} == {"O-1"} and {f for f, r, _ in rows if r == "O-1"} == {"a.py", "lib/b.py", "skip/c.py"}
    faults = done.faults.where("kind = 'rule'").collect()
    assert [f.rule_id for f in faults] == ["O-2"] and faults[0].error and done.statistics.first().rules_failed == 1


def test_lists(spark, tmp_path):
    (tmp_path / "truth.json").write_text(json.dumps([{"file_path": "a.py", "expected_findings": [{"line_number": 3, "rule_id": "R"}, {"line_number": None, "rule_id": "S"}]}, {"file_path": "clean.py", "expected_findings": []}]))
    assert sorted(map(tuple, read_ground_truth(spark, str(tmp_path / "truth.json")).collect()), key=str) == [("a.py", 3, "R"), ("a.py", None, "S"), ("clean.py", None, None)]
    (tmp_path / "allow.json").write_text(json.dumps([{"file_path": "a.py"}, {"rule_id": "x"}, {"file_path": "b.py", "rule_id": "R", "line_number": 2}]))
    assert sorted(map(tuple, read_allowlist(spark, str(tmp_path / "allow.json")).collect()), key=str) == [("a.py", None, None), ("b.py", "R", 2)]


def test_the_command_reads_settings_and_ignore_files(spark, tree, tmp_path, capsys):
    (tmp_path / "settings.json").write_text(json.dumps({"scanning": {"exclude_dirs": ["skip"], "min_severity": "CRITICAL"}}))
    (tmp_path / "ignored").write_text("lib/*\n")
    assert main(["scan", tree, "--settings", str(tmp_path / "settings.json"), "--ignore-file", str(tmp_path / "ignored")]) == 1
    text = capsys.readouterr().out
    assert "a.py:1" in text and "lib/b.py" not in text and "skip/c.py" not in text and "d.js" not in text and "PSEC-CONFIG" not in text
