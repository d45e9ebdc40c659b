"""How the work of taint is dealt out, and that what saves work gives the same."""

import ast

from tracewell.operators import taint
from tracewell.operators.pyast import plainly_written, scopes_of, walked
from tracewell.operators.taint import functions_of, sink_parameters, taint_findings


def modules(spark, n):
    code = "def low(q):\n    cur.execute('a' + q)\ndef give(a):\n    return a\ndef h():\n    v = give(request.args)\n    low(v)\nother(params)"
    return spark.createDataFrame([(f"m{k}.py", "python", code.split("\n")) for k in range(n)], "file_path string, language string, lines array<string>")


def test_a_file_is_parsed_once(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(taint, "cut", lambda df, name, real=taint.cut: (plans.append(df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]), real(df, name))[1])
    found = taint_findings(modules(spark, 3))
    assert {(r.file_path, r.line_number, r.source) for r in found.collect()} == {(f"m{k}.py", 7, "request.args") for k in range(3)}
    assert sum(p.count("MapInArrow") for p in [*plans, found._jdf.queryExecution().toString().split("== Physical Plan ==")[1]]) == 1


def test_calls_of_one_callee_are_dealt_out(spark):
    calls = spark.createDataFrame([(f"m{k}", k, "low" if k < 900 else f"f{k}", 0) for k in range(1000)], "file_path string, line_number int, callee string, arg int")
    sinks = spark.createDataFrame([("low", 0, "SQL Injection"), ("low", 0, "Command Injection"), ("low", 1, "SQL Injection"), ("f950", 0, "SQL Injection")], "callee string, arg int, type string")
    plan = taint._joined(calls, sinks)
    assert sorted(map(tuple, plan.select("file_path", "type").collect())) == sorted(map(tuple, calls.join(sinks, ["callee", "arg"]).select("file_path", "type").collect()))
    assert "place" in plan._jdf.queryExecution().optimizedPlan().toString() and taint._joined(calls.limit(0), sinks).count() == 0


def test_texts_are_what_unparse_gives():
    code = "a = b.c(d, 'x\"y', 1)\nf(g(request.args['a']), *z, k=1)\nx, y = a\nw: int = f(1.5)\nq += u(None)\nf\nf(-1, (a, b)).c[0](1j)\n'doc'\na = b = c().d\n" + "f(" * 30 + ")" * 30
    made = [(plainly_written(n), ast.unparse(n)) for n in walked(ast.parse(code))]
    assert all(own in (None, text) for own, text in made) and sum(own is not None for own, _ in made) > 20
    kinds = lambda nodes: [type(n) for n in nodes if not isinstance(n, (ast.expr_context, ast.operator, ast.unaryop, ast.alias))]
    assert kinds(walked(ast.parse(code))) == kinds(ast.walk(ast.parse(code)))


def test_scopes_are_those_of_walk():
    inner = "def {0}(x):\n    class C:\n        def m(self):\n            return lambda: [y for y in x]\n    x = 1"
    blocks = ["if a:\n    {0}\nelse:\n    {1}", "try:\n    {0}\nexcept E:\n    {1}\nelse:\n    pass\nfinally:\n    pass", "for i in a:\n    {0}\nelse:\n    {1}", "match a:\n    case 1:\n        {0}\n    case _:\n        {1}", "with a:\n    async {0}", "while a:\n    {0}"]
    code = "\n".join(b.replace("{0}", inner.format(f"f{k}").replace("\n", "\n" + " " * 8)).replace("{1}", inner.format(f"g{k}").replace("\n", "\n" + " " * 8)) for k, b in enumerate(blocks))
    tree = ast.parse(code)
    want = [n for n in ast.walk(tree) if isinstance(n, (ast.Module, ast.FunctionDef, ast.AsyncFunctionDef))]
    assert len(want) == 21 and [id(n) for n in scopes_of(tree)] == [id(n) for n in want]


def test_facts_of_a_function_are_told_apart_without_a_shuffle(spark, monkeypatch):
    functions = taint.cut(functions_of(modules(spark, 2)), "functions")
    plans = {}
    monkeypatch.setattr(taint, "cut", lambda df, name, real=taint.cut: (plans.setdefault(name, df._jdf.queryExecution().toString().split("== Physical Plan ==")[1]), real(df, name))[1])
    assert [tuple(r) for r in sink_parameters(functions).collect()] == [("low", 0, "SQL Injection")]
    assert sum(p.count("Exchange hashpartitioning") for name, p in plans.items() if name not in ("links", "jumps", "branches", "frontier")) <= 2
