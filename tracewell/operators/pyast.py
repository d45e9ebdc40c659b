"""Python syntax-tree checks: per-file helpers that Spark runs over the rows of Python files."""

from __future__ import annotations

import ast
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracewell.operators.rulespec import SEVERITIES

# Names that decide what is a source, a sink or a sanitiser.
INPUT_NAMES = {"request", "req", "params", "param", "args", "arg", "query", "user_input", "username", "user_id", "userid", "data", "payload", "body", "form", "input", "argv", "environ", "env", "config"}
INPUT_PARTS = ("request", "input", "param", "user", "query", "data")
INPUT_ATTRIBUTES = {"get", "post", "args", "form", "data", "json", "cookies", "headers", "environ", "params"}
SANITISERS = {"secure_filename", "escape", "sanitize", "urlparse"}
SQL_CALLS = {"execute", "executemany", "executescript", "raw", "query", "rawQuery", "execute_sql", "run_query"}
COMMAND_CALLS = {"system", "popen", "run", "call", "check_call", "check_output", "Popen", "spawn", "spawnl", "spawnle", "execl", "execle", "execlp", "execlpe", "execv", "execve", "execvp", "execvpe", "getoutput", "getstatusoutput", "startfile"}
CODE_CALLS = {"eval", "exec", "compile", "__import__"}
LOAD_CALLS = {"loads", "load", "Unpickler"}
LOAD_MODULES = {"pickle", "cPickle", "marshal", "shelve"}
YAML_LOADERS = {"SafeLoader", "FullLoader", "CSafeLoader"}
PATH_CALLS = {"open", "read_text", "read_bytes", "write_text", "write_bytes", "send_file"}
DEEPEST = 8
#: rule id -> type, severity, confidence, CWE; a command through a shell is CRITICAL with 0.90.
EMITTED = {
    "AST-PY-SQLI-001": ("SQL Injection", "CRITICAL", 0.95, "CWE-89"),
    "AST-PY-CMDI-001": ("Command Injection", "HIGH", 0.80, "CWE-78"),
    "AST-PY-CODEI-001": ("Code Injection", "CRITICAL", 0.95, "CWE-95"),
    "AST-PY-CODEI-002": ("Code Injection", "MEDIUM", 0.60, "CWE-95"),
    "AST-PY-DESER-001": ("Insecure Deserialization", "HIGH", 0.85, "CWE-502"),
    "AST-PY-DESER-002": ("Insecure Deserialization", "HIGH", 0.70, "CWE-502"),
    "AST-PY-PATH-001": ("Path Traversal", "HIGH", 0.75, "CWE-22"),
}


def preorder(node: ast.AST) -> Iterator[ast.AST]:
    """All nodes, each before its children; however deep the tree is."""
    waiting = [node]
    while waiting:
        node = waiting.pop()
        yield node
        waiting += reversed(list(ast.iter_child_nodes(node)))


def plainly_written(node: ast.AST, deepest: int = 8) -> str | None:
    """What ``ast.unparse`` gives of names, attributes and calls of them, without its cost; None of anything else."""
    kind = type(node)
    if kind is ast.Name:
        return node.id
    if kind is ast.Constant:
        return repr(node.value) if type(node.value) in (str, int) and node.kind is None else None
    if not deepest:
        return None
    if kind is ast.Expr:
        return plainly_written(node.value, deepest - 1)
    if kind is ast.Assign:
        parts = [*node.targets, node.value]
        texts = [plainly_written(n, deepest - 1) for n in parts] if node.type_comment is None else [None]
        return None if None in texts else " = ".join(texts)
    if kind not in (ast.Attribute, ast.Call) or type(on := node.value if kind is ast.Attribute else node.func) not in (ast.Name, ast.Attribute, ast.Call):
        return None
    if (base := plainly_written(on, deepest - 1)) is None:
        return None
    if kind is ast.Attribute:
        return f"{base}.{node.attr}"
    texts = [plainly_written(n, deepest - 1) for n in node.args] if not node.keywords else [None]
    return None if None in texts else f"{base}({', '.join(texts)})"


def written(node: ast.AST) -> str:
    """The node as code; its line where it is nested too deeply to be written out."""
    if (text := plainly_written(node)) is not None:
        return text
    try:
        return ast.unparse(node)
    except RecursionError:
        return f"expression of line {getattr(node, 'lineno', 0)}"


def taint_of(node: ast.AST, known: dict[str, str | None], depth: int = 0) -> str | None:
    """The expression that brings outside data into ``node``, or None. ``known`` holds what assigned names carry."""
    if depth > DEEPEST:
        return None

    def deeper(n: ast.AST) -> str | None:
        return taint_of(n, known, depth + 1)

    match node:
        case ast.JoinedStr(values=parts) if not all(isinstance(p, ast.Constant) for p in parts):
            return written(node)
        case ast.BinOp(left=left, op=op, right=right):
            mixes = isinstance(op, (ast.Add, ast.Mod)) and not (isinstance(left, ast.Constant) and isinstance(right, ast.Constant))
            return deeper(left) or deeper(right) or (written(node) if mixes else None)
        case ast.Name(id=name) if name in known:
            return known[name]
        case ast.Name(id=name) if name.lower() in INPUT_NAMES or any(p in name.lower() for p in INPUT_PARTS):
            return name
        case ast.Attribute(value=value, attr=attr):
            outside = attr.lower() in INPUT_ATTRIBUTES or isinstance(value, ast.Name) and value.id.lower() in INPUT_NAMES
            return deeper(value) or (written(node) if outside else None)
        case ast.Subscript(value=value):
            return deeper(value)
        case ast.Call(func=ast.Name(id="input" | "raw_input")):
            return "input()"
        case ast.Call(func=func, args=args):
            if getattr(func, "id", getattr(func, "attr", "")) in SANITISERS:
                return None
            if isinstance(func, ast.Attribute) and deeper(func.value):
                return written(node)
            return next((t for t in map(deeper, args) if t), None)
        case ast.IfExp(body=body, orelse=other):
            return deeper(body) or deeper(other)
    return None


def assigned_taint(tree: ast.AST) -> dict[str, str | None]:
    """What the file's names carry, one table for the whole file; the last write counts."""
    known: dict[str, str | None] = {}
    for node in preorder(tree):
        match node:
            case ast.Assign(targets=targets, value=value):
                taint = taint_of(value, known)
                known |= {t.id: taint for t in targets if isinstance(t, ast.Name)}
            case ast.AnnAssign(target=ast.Name(id=name), value=value) if value is not None:
                known[name] = taint_of(value, known)
            case ast.AugAssign(target=ast.Name(id=name), value=value):
                if taint := taint_of(value, known) or known.get(name):
                    known[name] = taint
            case ast.For(target=ast.Name(id=name), iter=source):
                known[name] = taint_of(source, known)
    return known


def call_findings(call: ast.Call, known: dict[str, str | None]) -> Iterator[tuple[str, str, str]]:
    """(rule id, severity, source) of one call."""
    func = call.func
    name = getattr(func, "id", getattr(func, "attr", ""))
    taint = taint_of(call.args[0], known) if call.args else None
    keyword = {k.arg: k.value for k in call.keywords}
    severity = {r: s for r, (_, s, _, _) in EMITTED.items()}
    if taint and name in SQL_CALLS and len(call.args) < 2 and not isinstance(keyword.get("params"), (ast.List, ast.Tuple, ast.Dict)):
        yield "AST-PY-SQLI-001", severity["AST-PY-SQLI-001"], taint
    if taint and name in COMMAND_CALLS:
        shell = isinstance(keyword.get("shell"), ast.Constant) and keyword["shell"].value is True
        yield "AST-PY-CMDI-001", "CRITICAL" if shell else "HIGH", taint
    if name in CODE_CALLS and call.args:
        if taint:
            yield "AST-PY-CODEI-001", "CRITICAL", taint
        elif name in ("eval", "exec"):
            yield "AST-PY-CODEI-002", "MEDIUM", written(call.args[0])
    if name in LOAD_CALLS and isinstance(func, ast.Attribute) and isinstance(func.value, ast.Name):
        loader = keyword.get("Loader")
        if func.value.id in LOAD_MODULES:
            yield "AST-PY-DESER-001", "HIGH", f"{func.value.id}.{name}"
        elif func.value.id == "yaml" and name == "load" and not (isinstance(loader, ast.Attribute) and loader.attr in YAML_LOADERS):
            yield "AST-PY-DESER-002", "HIGH", "yaml.load()"
    if taint and name in PATH_CALLS:
        yield "AST-PY-PATH-001", "HIGH", taint


FAMILY = ("SQLI", "CMDI", "CODEI", "DESER", "PATH")


def file_findings(lines: list[str]) -> list[tuple]:
    """(line, rule id, type, severity, severity value, confidence, CWE, source, sink, snippet), first per rule and line, the
    most severe and confident first; none for blank code or code that doesn't parse."""
    code = "\n".join(lines)
    if not code.strip():
        return []
    try:
        tree = ast.parse(code)
    except (SyntaxError, ValueError, RecursionError):
        return []
    known = assigned_taint(tree)
    found: dict[tuple[str, int], tuple] = {}
    hits = [(call, hit) for call in preorder(tree) if isinstance(call, ast.Call) for hit in call_findings(call, known)]
    for call, (rule, severity, source) in sorted(hits, key=lambda h: next(k for k, f in enumerate(FAMILY) if f in h[1][0])):
        kind, _, confidence, cwe = EMITTED[rule]
        confidence = 0.90 if rule == "AST-PY-CMDI-001" and severity == "CRITICAL" else confidence
        snippet = lines[call.lineno - 1].strip() if call.lineno <= len(lines) else ""
        found.setdefault((rule, call.lineno), (call.lineno, rule, kind, severity, SEVERITIES[severity], confidence, cwe, source, written(call), snippet))
    return sorted(found.values(), key=lambda f: (-f[4], -f[5]))


_COLUMNS = ["line_number", "rule_id", "vulnerability_type", "severity", "severity_value", "confidence_score", "cwe_id", "source", "sink", "code_snippet"]
_KINDS = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.float64(), pa.string(), pa.string(), pa.string(), pa.string()]
FINDING_SCHEMA = "file_path string, line_number int, rule_id string, vulnerability_type string, severity string, severity_value int, confidence_score double, cwe_id string, source string, sink string, code_snippet string"


def ast_findings(files: DataFrame) -> DataFrame:
    """Findings of the syntax-tree checks over Python files (file_path, language, lines), each file on its own."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(path, *f) for path, lines in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for f in file_findings(lines or [])]
            columns = list(zip(*rows, strict=True)) or [()] * (len(_COLUMNS) + 1)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.string(), *_KINDS], strict=True)], names=["file_path", *_COLUMNS])

    return files.where("language = 'python'").select("file_path", "lines").mapInArrow(run, FINDING_SCHEMA)


# Facts for the call-graph analysis

# Calls that are sinks of a parameter, by type; the second says whether the argument must be built up.
PARAM_SINKS = {
    "execute": ("SQL Injection", True), "query": ("SQL Injection", True), "Exec": ("SQL Injection", True),
    "system": ("Command Injection", False), "run": ("Command Injection", False), "Popen": ("Command Injection", False), "Command": ("Command Injection", False),
    "open": ("Path Traversal", True), "join": ("Path Traversal", True), "Path": ("Path Traversal", True),
}
DIRECT = {"request", "req", "GET", "POST", "args", "input", "params"}
_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)
_FUNCS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SIMPLE = (ast.Expr, ast.Assign, ast.Return, ast.Import, ast.ImportFrom, ast.AugAssign, ast.AnnAssign, ast.Pass, ast.Raise, ast.Assert, ast.Delete)


#: Fields without expressions or statements in them.
_BARE = {"ctx", "op", "ops", "id", "attr", "kind", "type_comment", "conversion", "is_async", "simple", "level", "module", "names"}


class _Fields(dict):
    """The fields of a kind of node that can hold nodes."""

    def __missing__(self, kind: type) -> tuple[str, ...]:
        self[kind] = found = () if kind is ast.Constant else tuple(f for f in kind._fields if f not in _BARE)
        return found


_fields = _Fields()


def _children(node: ast.AST) -> list[ast.AST]:
    out = []
    for name in _fields[type(node)]:
        value = getattr(node, name, None)
        if type(value) is list:
            out += [v for v in value if isinstance(v, ast.AST)]
        elif isinstance(value, ast.AST):
            out.append(value)
    return out


def walked(node: ast.AST) -> list[ast.AST]:
    """The nodes of ``ast.walk`` in its order, without contexts, operators and aliases, which nothing here asks for."""
    out = [node]
    for n in out:
        if _fields[type(n)]:
            out += _children(n)
    return out


def scopes_of(tree: ast.Module) -> list[ast.AST]:
    """The module and its functions in the order of ``ast.walk``; they stand in statements alone, so expressions are passed over."""
    out: list[ast.AST] = [tree]
    for n in out:
        for name in ("body", "handlers", "orelse", "finalbody", "cases"):
            if type(inner := getattr(n, name, None)) is list:
                out += [c for c in inner if not isinstance(c, _SIMPLE)]
    return [n for n in out if isinstance(n, (ast.Module, *_FUNCS))]


def names_read(node: ast.AST) -> set[str]:
    if not _fields[type(node)]:
        return {node.id} if type(node) is ast.Name and type(node.ctx) is ast.Load else set()
    return {n.id for n in walked(node) if type(n) is ast.Name and type(n.ctx) is ast.Load}


def called(call: ast.Call) -> str | None:
    return getattr(call.func, "id", getattr(call.func, "attr", None))


def built_up(node: ast.AST) -> bool:
    """Formatted or joined from parts."""
    return any(isinstance(n, ast.JoinedStr) or isinstance(n, ast.BinOp) and isinstance(n.op, (ast.Mod, ast.Add)) or isinstance(n, ast.Call) and isinstance(n.func, ast.Attribute) and n.func.attr == "format" for n in walked(node))


def is_direct_source(node: ast.AST) -> bool:
    return any(getattr(n, "id", getattr(n, "attr", None)) in DIRECT for n in walked(node) if isinstance(n, (ast.Name, ast.Attribute)))


def local_nodes(func: ast.AST) -> list[ast.AST]:
    """All nodes of a body level by level; nested definitions themselves, but nothing inside them."""
    out = list(func.body)
    for n in out:
        if _fields[type(n)] and not isinstance(n, _DEFS):
            out += _children(n)
    return out


def targets_of(node: ast.AST) -> list[str]:
    match node:
        case ast.Assign(targets=targets):
            flat = [e for t in targets for e in (t.elts if isinstance(t, (ast.Tuple, ast.List)) else [t])]
            return [e.id for e in flat if isinstance(e, ast.Name)]
        case ast.AnnAssign(target=ast.Name(id=name), value=value) | ast.AugAssign(target=ast.Name(id=name), value=value) if value is not None:
            return [name]
    return []


_ASSIGNS = (ast.Assign, ast.AnnAssign, ast.AugAssign)


def _steps(func: ast.AST) -> Iterator[tuple[str, str | list[str] | None, int, set[str]]]:
    """What a function does with names, in level order: (kind, type, callee or targets, argument, names read)."""
    for node in local_nodes(func):
        if isinstance(node, ast.Call) and called(node) in PARAM_SINKS:
            kind, must_build = PARAM_SINKS[called(node)]
            yield "sink", kind, -1, set().union(*(names_read(v) for v in [*node.args, *(k.value for k in node.keywords)] if not must_build or built_up(v)))
        if isinstance(node, _ASSIGNS) and (targets := targets_of(node)):
            yield "assign", targets, -1, names_read(node.value)
        for call in walked(node) if isinstance(node, _DEFS) else [node]:
            if isinstance(call, ast.Call) and called(call) and called(call) != func.name:
                for k, arg in enumerate(call.args):
                    yield "call", called(call), k, names_read(arg)
        if isinstance(node, ast.Return) and node.value is not None:
            yield "return", None, -1, names_read(node.value)


def function_facts(func: ast.AST) -> Iterator[tuple[str, int, int, str, str, int]]:
    """Facts on one function: (kind, parameter, ...) with what each parameter reaches.

    ``sink``: type in the fifth place; ``return``; ``call``: callee and argument in the fifth and sixth. A name is tainted
    from the assignment on that takes it from the parameter, in level order.
    """
    params = [(k, a.arg) for k, a in enumerate(func.args.args) if a.arg not in ("self", "cls")]
    steps = list(_steps(func)) if params else []
    for index, param in params:
        tainted = {param}
        for kind, what, arg, read in steps:
            if kind == "sink":
                if param in read:
                    yield "sink", index, what, -1
            elif read.isdisjoint(tainted):
                continue
            elif kind == "assign":
                tainted.update(what)
            else:
                yield kind, index, what, arg


#: A text that holds where every (callee, argument) of its conditions is returned by the callee.
Source = tuple[tuple[tuple[str, int], ...], str]


def traced_calls(tree: ast.Module, scopes: list[ast.AST] | None = None) -> Iterator[tuple[int, str, int, list[Source], str, str]]:
    """Calls that get outside data: (line, callee, argument, sources, argument text, statement text).

    Each module or function body is followed by itself; only its top-level statements taint names, calls count anywhere below. A
    name that gets a call's value has the source of the argument that the callee returns, which other files tell: of ``sources`` the
    last one counts whose conditions hold; the first has none. ``scopes`` are those of the tree, where they are known.
    """
    for scope in scopes or scopes_of(tree):
        tainted: dict[str, list[Source]] = {}
        for stmt in scope.body:
            if isinstance(stmt, _FUNCS):
                continue
            named: list[str] = []
            if isinstance(stmt, _ASSIGNS) and (targets := targets_of(stmt)):
                read = sorted(names_read(stmt.value) & tainted.keys()) if tainted else []
                found = [((), written(stmt.value))] if is_direct_source(stmt.value) else tainted[read[0]] if read else None
                if found is not None:
                    tainted |= dict.fromkeys(targets, found)
                named = [t.id for t in (stmt.targets if isinstance(stmt, ast.Assign) else [stmt.target]) if isinstance(t, ast.Name)]
            text = None
            for call in walked(stmt):
                if type(call) is ast.Call and called(call):
                    for k, arg in enumerate(call.args):
                        if type(arg) is ast.Constant:
                            continue
                        read = sorted(names_read(arg) & tainted.keys()) if tainted else []
                        found = tainted[read[0]] if read else [((), written(arg))] if is_direct_source(arg) else None
                        if found is None:
                            continue
                        text = written(stmt).strip() if text is None else text
                        yield getattr(stmt, "lineno", 1), called(call), k, found, written(arg), text
                        for name in named:
                            if tainted.get(name) != found:
                                returned = [((*conditions, (called(call), k)), text_) for conditions, text_ in found]
                                tainted[name] = list(dict.fromkeys([*tainted.get(name, found), *returned]))
