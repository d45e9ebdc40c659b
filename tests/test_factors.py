"""Literal factors lose no match, and long files are scanned like short ones."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.operators.catalogue import BY_ID, RULES
from tracewell.operators.factors import guarded_match, literal_factors, may_be_empty
from tracewell.operators.rulespec import Match
from tracewell.operators.scan import scan, sink_sites
from tracewell.plans.corpus import TEMPLATES


def patterns():
    """All patterns of the catalogue's sinks and signals."""

    def of(condition):
        if isinstance(condition, Match):
            yield condition.regex
        for part in [*getattr(condition, "parts", ()), *([condition.part] if hasattr(condition, "part") else [])]:
            yield from of(part)

    found = [p for r in RULES for p in [r.regex, *([f"(?i){r.also}"] if r.also else [])]] + [p for r in RULES for _, c in r.signals for p in of(c)]
    return sorted(set(found))


@pytest.mark.parametrize(
    ("pattern", "factors"),
    [
        (r"\bexec(?:ute)?\s*\(", {"exec"}), (r"(?i)(SELECT|Insert)\b", {"select", "insert"}), (r"a\s+bcd\s+ef", {"bcd"}), (r"(?:foo)+", {"foo"}), (r"x?yz{2}", {"yz", "xyz"}),
        (r"[\"']\s*\+", {"+"}), (r"\w+", set()), (r"a*", set()), (r"foo|\d", set()), (r"foo|b", set()), (r"(?=bar)q\.w", {"q.w"}), (r"(?:ab|cd)(?:e|f)", {"abe", "abf", "cde", "cdf"}),
    ],
)
def test_factors_of_patterns(pattern, factors):
    found = set(literal_factors(pattern)[0])
    assert found == factors or factors == {"yz", "xyz"} and found <= {"yz", "xyz", "y"}


def test_empty_matches_are_seen():
    assert may_be_empty("x*") and may_be_empty(r"\b") and not may_be_empty("x+")


def test_a_factor_stands_in_every_match():
    rng, lines = random.Random(4), [line for _, ls in TEMPLATES for line in ls]
    pieces = sorted({w for line in lines for w in re.findall(r"\w+|\W", line)})
    texts = lines + ["".join(rng.choices(pieces, k=rng.randint(2, 14))) for _ in range(4000)] + [line.upper() for line in lines] + ["\n".join(rng.choices(lines, k=6)) for _ in range(300)]
    hits = with_factors = 0
    for pattern in patterns():
        factors, ignored = literal_factors(pattern)
        with_factors += bool(factors)
        if factors:
            for text in texts:
                if re.search(pattern, text):
                    hits += 1
                    assert any(f in (text.lower() if ignored else text) for f in factors), (pattern, text)
    assert hits > 3000 and with_factors > 0.6 * len(patterns())


def test_guarded_patterns_find_what_patterns_find(spark):
    lines = sorted({line for _, ls in TEMPLATES for line in ls} | {line.upper() for _, ls in TEMPLATES for line in ls} | {"", "İstanbul EXECUTE(", "ſelect", "ΣΑΣ token='aaaaaaaaaaaa'"})
    rows = spark.createDataFrame([(x,) for x in lines], "t string").withColumn("low", F.lower("t"))
    for at in range(0, len(patterns()), 30):
        own = patterns()[at : at + 30]
        got = rows.select(*[(guarded_match(p, F.col("t"), F.col("low")) == F.col("t").rlike(p)).alias(f"c{k}") for k, p in enumerate(own)])
        assert all(all(r) for r in got.collect())


def test_sites_are_those_of_all_patterns(spark):
    rows = [(f"f{k}", language, lines) for k, (language, lines) in enumerate(TEMPLATES)]
    files = spark.createDataFrame(rows, "file_path string, language string, lines array<string>")
    rules = [r for r in RULES if r.enabled]
    got = {(r.file_path, r.line_number, r.rule_id, r.sink) for r in sink_sites(files, rules).collect()}
    want = set()
    for path, language, lines in rows:
        for r in rules:
            if language in r.languages or "*" in r.languages:
                for n, line in enumerate(lines, 1):
                    found = re.search(r.regex, line) or (r.also and re.search(f"(?i){r.also}", line))
                    start = line.strip()
                    comment = not start or start.startswith("#") and language in ("python", "php") or start.startswith(("//", "/*", "*")) and language in ("java", "go", "php", "javascript", "typescript")
                    if found and not (r.skip_comments and comment):
                        want.add((path, n, r.rule_id, found[0]))
    assert got == want and len(got) > 80


def test_long_files_and_far_definitions(spark):
    filler = [f"value_{k} = {k}" for k in range(140)]
    block = ["def find(cursor, user_input):", '    sql = "DELETE FROM t WHERE n = " + user_input', *filler, "    cursor.execute(sql)"]
    far = ["def find(cursor, user_input):", '    sql = "DELETE FROM t WHERE n = " + user_input', *filler, *filler, "    cursor.execute(sql)"]
    files = spark.createDataFrame([("long.py", "python", block * 40), ("far.py", "python", far), ("one.py", "python", ["x = '" + "a" * 200_000 + "'"])], "file_path string, language string, lines array<string>")
    found = scan(files, ["PY-SQLI-001"]).collect()
    assert sorted(r.line_number for r in found if r.file_path == "long.py") == [len(block) * k for k in range(1, 41)]
    assert not [r for r in found if r.file_path == "one.py"]
    near = scan(files, [BY_ID["PY-SQLI-001"].rule_id], first_hit=True).where("file_path = 'long.py'").collect()
    assert [r.line_number for r in near] == [len(block)]
