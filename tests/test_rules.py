"""Rules fire on what they should, not on what they should not; scores match a plain Python computation."""

import random
import re

import pytest
from pyspark.sql import functions as F

from tracewell.functions.text import context_window, line_count, split_lines
from tracewell.operators.catalogue import BY_ID, RULES, SQLI_SAFE
from tracewell.operators.rulespec import Distinct, Match, Some
from tracewell.operators.scan import evidence, scan

CASES = [
    # (rule, language, code, lines that it reports)
    ("PY-SQLI-001", "python", 'q = "SELECT a FROM t WHERE i = " + uid\ncursor.execute(q)', [2]),
    ("PY-SQLI-001", "python", 'cursor.execute("SELECT a FROM t WHERE i = %s", (uid,))', []),
    ("PY-SQLI-001", "python", 'cursor.execute("SELECT 1 FROM t")', []),
    ("PY-SQLI-001", "python", '# cursor.execute("SELECT a FROM t WHERE i = " + uid)', []),
    ("PY-SQLI-001", "python", "\n".join(['q = "DELETE FROM t WHERE n = " + user_input', *["pass"] * 40, "cursor.execute(q)"]), [42]),
    ("PY-SQLI-001", "python", "\n".join(['base = "DELETE FROM t WHERE n = " + user_input', *["pass"] * 20, "q = base", *["pass"] * 20, "cursor.execute(q)"]), [43]),
    ("PY-SQLI-001", "python", "\n".join(['q = "DELETE FROM t WHERE n = " + user_input', *["pass"] * 160, "cursor.execute(q)"]), []),
    ("GO-SQLI-001", "go", 'package main\nimport "x"\nfunc f(id string) {\n\tquery := "SELECT * FROM u WHERE id=" + id\n\t_ = 1\n\tdb.Query(query)\n}', [6]),
    ("PHP-SQLI-001", "php", '<?php\n$id = 1;\n$q = "SELECT * FROM u WHERE id=" . $id;\nmysqli_query($c, $q);', [4]),
    ("JAVA-SQLI-001", "java", 'PreparedStatement p = c.prepareStatement("SELECT a FROM t WHERE i = ?");\np.executeQuery();', []),
    ("PY-CMD-001", "python", "os.system('ping ' + host)", [1]),
    ("PY-CMD-001", "python", 'subprocess.run(["ls", d])', []),
    ("JS-CMD-001", "typescript", "exec(`ls ${dir}`)", [1]),
    ("PSEC-XSS-PY-001", "python", 'return Markup(f"<b>{user_input}</b>")', [1]),
    ("PSEC-XSS-PY-001", "python", "return Markup(escape(v))", []),
    ("PSEC-XSS-JS-001", "javascript", 'el.innerHTML = "Hello " + name', [1]),
    ("PSEC-XSS-JS-001", "typescript", 'el.innerHTML = "Hello " + name', []),
    ("PSEC-XSS-JS-001", "javascript", "el.textContent = name", []),
    ("PSEC-SSRF-PY-001", "python", "url = request.args['u']\nrequests.get(url)", [2]),
    ("PSEC-SSRF-PY-001", "python", "if url.startswith('https://a'):\n    requests.get(url)", []),
    ("PSEC-PT-PY-001", "python", "filename = request.args['f']\nopen(filename)", [2]),
    ("PSEC-PT-PY-001", "python", "open(secure_filename(filename))", []),
    ("PSEC-DESER-PY-001", "python", "pickle.loads(data)", [1]),
    ("PSEC-DESER-PY-001", "python", "yaml.load(s, Loader=yaml.SafeLoader)", []),
    ("PSEC-NOSQL-JS-001", "javascript", "db.u.find({'$where': 'this.n == ' + req.body.n})", [1]),
    ("PSEC-CRYPTO-PY-001", "python", "hashlib.md5(x)\nrandom.random()", [1, 2]),
    ("PSEC-AUTH-PY-001", "python", "jwt.decode(t, k, verify=False, a=1)\nif password == p:", [1, 2]),
    ("PSEC-CONFIG-PY-001", "python", "DEBUG = True", [1]),
    ("PSEC-CSRF-PY-001", "python", "@csrf_exempt", [1]),
    ("PSEC-XXE-PY-001", "python", "lxml.etree.parse(f)", [1]),
    ("PSEC-XXE-PY-001", "python", "lxml.etree.parse(f, p(resolve_entities=False))", []),
    ("IAC-DKR-001", "dockerfile", "FROM node\nFROM ubuntu:latest\nFROM a:1\nFROM b@sha256:1", [1, 2]),
    ("IAC-DKR-002", "dockerfile", "FROM a:1\nUSER root", [2]),
    ("IAC-DKR-002", "dockerfile", "FROM a:1\nRUN x", [2]),
    ("IAC-DKR-002", "dockerfile", "FROM a:1\nUSER root\nUSER node", []),
    ("IAC-DKR-003", "dockerfile", "FROM a:1\nENV API_KEY=abc\nENV PORT=80", [2]),
    ("IAC-TF-001", "terraform", 'a {\n  b {\n    from_port = 22\n    to_port = 22\n    x = 1\n    cidr_blocks = ["0.0.0.0/0"]\n', [6]),
    ("IAC-TF-001", "terraform", 'from_port = 80\ncidr_blocks = ["0.0.0.0/0"]', []),
    ("IAC-TF-002", "terraform", 'a\nb\nacl = "public-read"\nacl = "private"', [3]),
    ("SECRET-001", "python", "password = 'super_secret_password_123'\nx = 1", [1]),
]


@pytest.fixture(scope="module")
def found(spark):
    files = spark.createDataFrame([(str(k), lang, code) for k, (_, lang, code, _) in enumerate(CASES)], "file_path string, language string, code string")
    rows = scan(files.withColumn("lines", split_lines(F.col("code")))).collect()
    return {(r.file_path, r.rule_id, r.line_number): r for r in rows}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_case(found, k):
    rule, _, _, lines = CASES[k]
    assert sorted(n for path, r, n in found if path == str(k) and r == rule) == lines


def test_details(found):
    by = {(r, n): v for (path, r, n), v in found.items()}
    assert by["PSEC-CRYPTO-PY-001", 2].cwe_id == "CWE-338" and by["PSEC-CRYPTO-PY-001", 1].cwe_id == "CWE-327"
    assert "SSH" in by["IAC-TF-001", 6].sink and by["PSEC-AUTH-PY-001", 1].cwe_id == "CWE-347"
    assert found["0", "PY-SQLI-001", 2].source == "uid" and found["0", "PY-SQLI-001", 2].sink == "cursor.execute(q)"


def python_score(rule, line, window):
    total = 0.0
    for weight, cond in rule.signals:
        match cond:
            case Match():
                hit = re.search(cond.regex, {"line": line, "w": window}[cond.scope])
            case Some():
                hit = any(x.strip()[:1] not in "\"'" or not x.strip() for x in re.findall(cond.regex, window))
            case Distinct():
                hit = len({m[0].upper() for m in re.finditer("(?i)" + cond.pattern, window)}) >= cond.least
            case _:
                hit = any(re.search(p.regex, window) for p in cond.parts)
        total += weight if hit else 0.0
    return max(0.0, min(1.0, total))


def test_scores_match_python(spark):
    rule, r = BY_ID["PY-SQLI-001"], random.Random(3)
    bits = ['"SELECT "', " + user_id", "f'{name}'", '"%s" % x', '"{}".format(y)', "execute(q, (a,))", "FROM t WHERE", "UPDATE", "\n", "request", "f'{\"a\"}'", "z", '"a" + "b"']
    rows = [(line := "cursor.execute(q)", "".join(r.choices(bits, k=r.randint(1, 8))) + "\n" + line) for _ in range(400)]
    got = spark.createDataFrame(rows, "line string, w string").selectExpr("*", "lower(line) AS line_low", "lower(w) AS w_low").select("line", "w", evidence(rule).alias("s")).collect()
    assert all(x.s == python_score(rule, x.line, x.w) for x in got)
    assert len({x.s for x in got}) > 8


def test_weights():
    weights = [w for w, _ in BY_ID["PY-SQLI-001"].signals]
    assert weights == [0.35, 0.05, 0.35, 0.15, 0.15, 0.10, 0.10, -0.55] and len(SQLI_SAFE) == 4
    assert len(RULES) == 46 and len(BY_ID) == 46


def test_lines_and_windows(spark):
    r = random.Random(1)
    texts = ["".join(r.choices(["a", "b", "\n", "\r\n", "\r", "\x0b", "\x0c", "\x1c", "\x85", " ", " "], k=r.randint(0, 12))) for _ in range(500)] + [""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", split_lines(F.col("t")).alias("lines"), line_count(F.col("t")).alias("n")).collect()
    for x in rows:
        assert x.lines == x.t.splitlines() and x.n == x.t.count("\n") + (x.t != "" and not x.t.endswith("\n"))
    lines = [str(k) for k in range(9)]
    got = spark.createDataFrame([(lines, k + 1) for k in range(9)], "lines array<string>, i int").select("i", context_window(F.col("lines"), F.col("i"), 3, 2).alias("w")).collect()
    assert all(x.w == "\n".join(lines[max(0, x.i - 4) : x.i + 1]) for x in got)


def test_first_hit_and_partitions(spark):
    files = spark.createDataFrame([(f"f{k}", "python", ["hashlib.md5(x)", "hashlib.md5(y)"]) for k in range(20)], "file_path string, language string, lines array<string>")
    rules = ["PSEC-CRYPTO-PY-001"]
    assert {(r.file_path, r.line_number) for r in scan(files.repartition(7), rules, first_hit=True).collect()} == {(f"f{k}", 1) for k in range(20)}
    assert scan(files.repartition(7), rules).count() == scan(files.coalesce(1), rules).count() == 40
    assert scan(files.limit(0)).count() == 0
