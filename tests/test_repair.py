"""Files are patched as long as that helps."""

from tracewell.operators.patch import BROKEN
from tracewell.operators.repair import NO_FORM, NOT_FEWER, patched_to_rest
from tracewell.operators.scan import scan


def test_patches_to_rest(spark):
    rules = ["PY-SQLI-001", "SECRET-001", "PSEC-SSRF-PY-001", "PSEC-DESER-PY-001"]
    files = {
        "sql.py": ["def f(cursor, user_id):", "    q = f\"SELECT * FROM users WHERE id = {user_id}\"", "    cursor.execute(q)"],
        "many.py": ["import pickle", "def f(request):", "    a = pickle.loads(request.data); b = pickle.loads(request.data)"],
        "joined.py": ["def f(cursor, user_id):", '    q = "SELECT a FROM t WHERE id = " + user_id', "    cursor.execute(q)"],
        "clean.py": ["x = 1"],
        "inside.py": ["def f(request):", "    url = request.args['u']", "    return (", "requests.get(url)", "    )"],
    }
    table = spark.createDataFrame([(k, "python", v) for k, v in files.items()], "file_path string, language string, lines array<string>")
    got = {r.file_path: r for r in patched_to_rest(table, rules).collect()}
    assert set(got) == set(files)
    assert (got["clean.py"].rounds, got["clean.py"].findings, got["clean.py"].reason, got["clean.py"].lines) == (0, 0, None, ["x = 1"])
    assert (got["sql.py"].rounds, got["sql.py"].findings, got["sql.py"].reason) == (1, 0, None) and got["sql.py"].lines[2].endswith("execute(q, (user_id,))")
    assert got["joined.py"].rounds == 0 and got["joined.py"].findings == 1 and got["joined.py"].reason == NO_FORM and got["joined.py"].lines == files["joined.py"]
    assert got["inside.py"].findings == 0 or got["inside.py"].reason in (BROKEN, NOT_FEWER) and got["inside.py"].lines == files["inside.py"]
    assert got["many.py"].findings == 0 or got["many.py"].reason
    left = scan(spark.createDataFrame([(r.file_path, r.language, r.lines) for r in got.values()], "file_path string, language string, lines array<string>"), rules)
    assert left.count() == sum(r.findings for r in got.values())
    assert patched_to_rest(table.limit(0), rules).count() == 0
