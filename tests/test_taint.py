"""Taint through returned values and long or branching chains of calls, against a plain search."""

import random

import pytest

from tests.test_findings import trace
from tracewell.operators import taint
from tracewell.operators.taint import functions_of, return_parameters, sink_parameters


def modules(spark, *codes):
    return spark.createDataFrame([(f"m{k}.py", "python", c.split("\n")) for k, c in enumerate(codes)], "file_path string, language string, lines array<string>")


def test_a_returned_argument_is_the_source(spark):
    low = "def low(q):\n    cur.execute('a' + q)\ndef give(a, b):\n    c = a\n    return c\ndef two(x):\n    return give(x, 1)\ndef none(x):\n    return 1"
    use = "def h():\n    v = {}\n    low(v)"
    cases = {
        "give(request.args, 1)": "request.args", "give(1, request.args)": "give(1, request.args)", "none(request.args)": "none(request.args)", "two(request.form)": "request.form",
        "give(none(request.args), 2)": "none(request.args)", "two(give(request.args, 3))": "request.args", "unknown(request.args)": "unknown(request.args)", "request.args": "request.args",
    }
    _, found = trace(spark, low=low, **{f"use{k}": use.format(value) for k, value in enumerate(cases)})
    assert found == {(f"use{k}", 3, "SQL Injection", source) for k, source in enumerate(cases.values())}


def test_sources_pass_through_several_names(spark):
    lib = "def low(q):\n    cur.execute('a' + q)\ndef give(a):\n    return a\ndef none(a):\n    return 1"
    _, found = trace(spark, lib=lib, use="y = give(request.args)\nz = none(y)\nw = z\nlow(w)\ny: str = give(params)\nlow(y)\ny += none(request.form)\nlow(y)")
    assert found == {("use", 4, "SQL Injection", "request.args"), ("use", 6, "SQL Injection", "params"), ("use", 8, "SQL Injection", "none(request.form)")}


def test_parameters_that_return(spark):
    files = modules(spark, "def a(p, q):\n    x = p\n    return x\ndef b(p, q):\n    y = a(q, p)\n    return y\ndef c(p):\n    return 1\ndef d(self, p):\n    return self, p")
    assert {tuple(r) for r in return_parameters(functions_of(files)).collect()} == {("a", 0), ("b", 0), ("b", 1), ("d", 1)}


def test_long_chains_take_few_rounds(spark, monkeypatch):
    lines = [line for k in range(300) for line in (f"def f{k}(a, b):", "    log(a)", f"    f{k + 1}(1, a)" if k % 2 else f"    f{k + 1}(a, b)")]
    lines += ["def f300(a, b):", "    cursor.execute('x' + b)", "    os.system(a)", "def log(x):", "    print(x)"]
    jobs = []
    monkeypatch.setattr(taint, "cut", lambda df, name, real=taint.cut: (jobs.append(name), real(df, name))[1])
    got = {tuple(r) for r in sink_parameters(functions_of(modules(spark, "\n".join(lines)))).collect()}
    assert got == brute("\n".join(lines))
    assert jobs.count("jumps") + jobs.count("frontier") <= 12 + 3


def brute(code):
    """Parameters that reach a sink, by a search from each."""
    import ast

    from tracewell.operators.pyast import function_facts

    facts = [(f.name, *x) for f in ast.walk(ast.parse(code)) if isinstance(f, ast.FunctionDef) for x in function_facts(f)]
    reached = {(n, p, w) for n, k, p, w, _ in facts if k == "sink"}
    while True:
        more = {(n, p, t) for n, k, p, w, a in facts if k == "call" for m, q, t in reached if (w, a) == (m, q)} - reached
        if not more:
            return reached
        reached |= more


@pytest.mark.parametrize("seed", range(3))
def test_random_graphs_with_cycles(spark, seed):
    rng, n = random.Random(seed), 25
    lines = []
    for k in range(n):
        lines.append(f"def f{k}(a, b):")
        lines += [f"    f{rng.randrange(n)}({rng.choice(['a, b', 'b, a', '1, a', 'b'])})" for _ in range(rng.choice([0, 1, 1, 1, 2]))]
        if rng.random() < 0.12:
            lines.append(rng.choice(["    os.system(a)", "    cur.execute('x' + b)", "    open('y' + a)"]))
        lines.append("    pass")
    got = {tuple(r) for r in sink_parameters(functions_of(modules(spark, "\n".join(lines)))).collect()}
    assert got == brute("\n".join(lines))
    assert sink_parameters(functions_of(modules(spark, "x = 1"))).count() == 0
