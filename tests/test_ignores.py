"""Ignore patterns against a plain match of every pattern with every path."""

import fnmatch
import random
from pathlib import PurePosixPath

from tests.test_findings import finding, table
from tracewell.operators import ignores
from tracewell.operators.findings import without_ignored
from tracewell.operators.ignores import ignored_paths, lookup_keys, parsed_pattern, read_patterns, without_patterns


def plain(path, rule, lines):
    for line in (x.strip() for x in lines):
        if not line or line.startswith("#"):
            continue
        glob, wanted = [x.strip() for x in line.rsplit(":", 1)] if ":" in line else (line, "*")
        glob = PurePosixPath(glob).as_posix()
        if any(fnmatch.fnmatchcase(path, g) for g in (glob, f"*/{glob}", f"{glob}/*")) and (wanted == "*" or wanted.upper() == rule.upper()):
            return True
    return False


def test_patterns_as_rows_are_the_plain_match(spark):
    rng = random.Random(1)
    names = ["src", "test", "a", "b.py", "test_x.py", "node", "é", "f1.py", "f23.py", "[x].py", "lib", "x y.py", "A.py"]
    paths = sorted({"/".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(400)}) + ["", "a", "."]
    bits = [*names, "*", "?", "*.py", "f?.py", "f[12]*.py", "f[!1]*", "t*t", "**", "src/*", "s*c", "[[]x].py", "."]
    lines = ["# src", "", "  src/a : r1 ", "./lib/", "src//a", "*:R2", "?:r1", ":r1", "a:b:R1"] + ["/".join(rng.choices(bits, k=rng.randint(1, 3))) + rng.choice(["", "", ":r1", ":R2", ":*", " : R1"]) for _ in range(300)]
    findings = table(spark, *[finding(path=p, rule=r) for p in paths for r in ("R1", "r2", "R3")], finding(path=None, rule="R1"))
    for some in (lines[:9], lines[9:40], lines[40:45], rng.sample(lines, 12), ["nothing/here"], []):
        kept = without_patterns(findings, spark.createDataFrame([(x,) for x in some], "line string"))
        assert kept.columns == findings.columns
        got = sorted((r.file_path or "", r.rule_id) for r in kept.collect())
        assert got == sorted([(p, r) for p in paths for r in ("R1", "r2", "R3") if not plain(p, r, some)] + [("", "R1")]), some


def test_many_patterns_give_what_the_chain_gives(spark, tmp_path):
    lines = [f"src/pkg{k % 97}/mod_{k}*.py" + (":PY-SQLI-001" if k % 3 else "") for k in range(10_000)]
    (tmp_path / "ignore").write_text("# all\n" + "\n".join(lines) + "\n")
    rows = [finding(path=f"src/pkg{k % 97}/mod_{k}.py", rule=("PY-SQLI-001", "B")[k % 2]) for k in range(9_900, 10_100)] + [finding(path=f"app/src/pkg{5}/mod_5_x.py")]
    findings = table(spark, *rows)
    got = without_patterns(findings, read_patterns(spark, f"file://{tmp_path}/ignore"))
    near = [x for x in lines if any(x.split("*")[0] in (r[0] or "") for r in rows)]
    want = without_ignored(findings, near)
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str) and 0 < got.count() < len(rows)
    assert without_patterns(findings.limit(0), read_patterns(spark, f"file://{tmp_path}/ignore")).count() == 0


def test_grams_are_literal():
    assert parsed_pattern("src/f1*.py:r")[2] == ["c/f1", "rc/f", "src/"]
    assert parsed_pattern("*")[2] == [""] and parsed_pattern("f?3.py")[2] == ["3.py"] and parsed_pattern("# x") is None


def test_a_bracket_first_in_a_set_is_one_of_it(spark):
    paths = ["bx.py", "ax.py", "]x.py", "lib/cx.py", "[!]a]x.py"]
    for line in ("[!]a]x.py", "[]a]x.py", "[]ax.py", "[!]", "[!]?x*"):
        kept = without_patterns(table(spark, *[finding(path=p) for p in paths]), spark.createDataFrame([(line,)], "line string"))
        assert sorted(r.file_path for r in kept.collect()) == sorted(p for p in paths if not plain(p, "R", [line])), line


def test_many_globs_alike_are_compared_with_few_paths(spark):
    """What begins like a glob is compared with it, not all that shares some four characters."""
    names, numbers = [f"src/f{k}.py" for k in range(100_003, 1_000_000, 300)], range(10_000, 100_000, 30)
    paths, lines = spark.createDataFrame([(x,) for x in names], "file_path string"), spark.createDataFrame([(f"f{k}?.py",) for k in numbers], "line string")
    keys = spark.createDataFrame([key for k in numbers for key in lookup_keys(f"f{k}?.py") if key[0] == ignores._BEGINS], "kind int, size int, key long")
    assert ignores._found(paths, keys, counted=False).join(keys, "key").count() <= 3_000 * 1.01
    assert {r.file_path for r in ignored_paths(paths, lines).collect()} == set(names)
    assert not ignored_paths(paths.limit(0), lines).count() and not ignored_paths(paths, lines.limit(0)).count()
