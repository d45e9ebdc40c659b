"""The catalogue of detection rules."""

from __future__ import annotations

from tracewell.operators.rulespec import All, Always, AnyOf, Distinct, Guarded, Match, Not, Rule, Some

# Patterns, weights, window sizes, severities and CWE numbers that decide which findings a scan returns.
# Look-aheads that don't change what is found are left out, so that one pattern serves Java's and RE2's dialects.

SQL_KEYWORD = r"\b(SELECT|INSERT|UPDATE|DELETE|FROM|WHERE|JOIN|UNION|DROP|CREATE|ALTER|TRUNCATE|EXEC|EXECUTE|INTO|VALUES|SET|HAVING|ORDER\s+BY|GROUP\s+BY)\b"
USER_INPUT = r"(?:\b|_)(?:request|req|params?|args?|query|user(?:_?input|name|id)?|data|payload|body|form|input|argv|getParam|getParameter|HttpServletRequest|getAttribute|getQueryString)(?:\b|_)"
PLUS = r"""(?:["'][^"']*["'])\s*\+\s*(\w[\w.\[\]'"()]*)|(\w[\w.\[\]'"()]*)\s*\+\s*["'][^"']*["']"""
PLUS_LINE = r"""(?:["'][^"\r\n]*["'])\s*\+\s*(\w[\w.\[\]'"()]*)|(\w[\w.\[\]'"()]*)\s*\+\s*["'][^"\r\n]*["']"""
FSTRING = r"""f["'][^"']*\{([^}]+)\}[^"']*["']"""
FSTRING_LINE = r"""f["'][^"\r\n]*\{([^}]+)\}[^"\r\n]*["']"""
PERCENT = r"""["'][^"']*["']\s*%\s*[A-Za-z_(]"""
FORMAT = r"""["'][^"']*\{[^}]*\}[^"']*["']\s*\.\s*format\s*\(\s*\w"""
PHP_DOT = r"""["'][^"']*["']\s*\.\s*\$[a-zA-Z_]\w*|\$[a-zA-Z_]\w*\s*\.\s*["'][^"']*["']"""
PHP_QUOTED = r'"[^"]*\$[a-zA-Z_]\w*[^"]*"'
PHP_DOT_LINE = r"""(?:["'][^"\r\n]*["'])\s*\.\s*(\$?\w[\w.\[\]'"()$]*)|(\$?\w[\w.\[\]'"()$]*)\s*\.\s*["'][^"\r\n]*["']"""
PHP_QUOTED_LINE = r'"[^"\r\n]*(?:\$[a-zA-Z_]\w*|\{\$[a-zA-Z_]\w*\})[^"\r\n]*"'
SHELL_WORD = r"\b(?:sh|bash|cmd(?:\.exe)?|powershell|powershell\.exe|zsh|csh|tcsh|bin/sh|bin/bash)\b"
SANITISER = r"\b(?:shlex\s*\.\s*quote|quote|escapeShell|escape|sanitize|strip|replace|replaceAll|escapeshellarg|escapeshellcmd)\b"
GO_SPRINTF = r"\bfmt\s*\.\s*Sprintf\s*\(\s*[^,]+,\s*[A-Za-z_]\w*"
GO_MULTI = r"\bexec\s*\.\s*Command(?:Context)?\s*\(\s*[^,)]+\s*,\s*[^)]+\s*\)"
TEMPLATE = r"`[^`]*\$\{[^}]+\}[^`]*`"
JOINED = r"\+\s*[a-zA-Z_]|[a-zA-Z_]\s*\+"
CONCAT = r"""\+\s*[a-zA-Z_]|[a-zA-Z_]\s*\+|\bf['"]|%s|\.format\("""
NAME = r"\b[a-zA-Z_][a-zA-Z0-9_]{2,}\b"
PY, JS, JAVA = ("python",), ("javascript", "typescript"), ("java",)

SQLI_SINKS = {
    "PY": (PY, r"\b(?:cursor\s*\.\s*)?execute(?:many)?\s*\(", True, r"(?i)\bexecute(?:many)?\s*\(\s*([a-zA-Z_]\w*)"),
    "JAVA": (JAVA, r"\b(?:executeQuery|executeUpdate|executeLargeUpdate|execute)\s*\(", False, r"(?i)\b(?:executeQuery|executeUpdate|executeLargeUpdate|execute)\s*\(\s*([a-zA-Z_]\w*)"),
    "GO": (("go",), r"\b(?:db\s*\.\s*)?(?:Query|QueryRow|Exec|Select|Get)(?:Context)?\s*\(", False, r"(?i)\b(?:Query|QueryRow|Exec|Select|Get)(?:Context)?\s*\(\s*(?:[^,)]+,\s*)?([a-zA-Z_]\w*)"),
    "PHP": (("php",), r"\b(?:mysqli_query|pg_query|mysqli_real_query)\s*\(|\b(?:db|pdo|conn)\s*->\s*(?:query|exec)\s*\(", False, r"(?i)\b(?:query|exec|prepare)\s*\(\s*([a-zA-Z_]\w*)"),
}
SQLI_SAFE = {
    "PY": [(-0.55, r"\b(?:cursor\s*\.\s*)?execute(?:many)?\s*\([^,)]+,\s*[\[\(]", True)],
    "JAVA": [(-0.55, r"\b(?:PreparedStatement|prepareStatement)\b", False), (-0.35, r"""["'][^"']*\?[^"']*["']""", False)],
    "GO": [(-0.55, r"\b(?:Prepare|PrepareContext)\b", False), (-0.35, r"\?|\$\d+", False)],
    "PHP": [(-0.55, r"\b(?:prepare)\s*\(|\bexecute\s*\(", False), (-0.35, r"\?|:\w+", False)],
}
CMD_SINKS = {
    "PY": (PY, r"\b(?:os\s*\.\s*system|subprocess\s*\.\s*(?:run|call|Popen|check_call|check_output|getoutput|getstatusoutput))\s*\(", True),
    "JAVA": (JAVA, r"\b(?:Runtime\s*\.\s*getRuntime\s*\(\s*\)\s*\.\s*exec|new\s+ProcessBuilder|ProcessBuilder)\b", False),
    "JS": (JS, r"\b(?:exec|spawn|execSync|execFile|spawnSync|execFileSync)\s*\(", True),
    "GO": (("go",), r"\bexec\s*\.\s*Command(?:Context)?\s*\(", False),
    "PHP": (("php",), r"\b(?:system|exec|shell_exec|passthru|proc_open|popen)\s*\(|`[^`]*`", False),
}
REQUEST = {
    "XSS": {
        "PY": r"\b(request\.(args|form|data|values|get_json|json|cookies|headers|files|params)|flask\.request|request\.POST|request\.GET|request\.body|self\.request)\s*[\[\.({]",
        "JS": r"\b(req\.(body|query|params|headers|cookies)|request\.(body|query|params)|location\.search|location\.hash|location\.href|document\.cookie|document\.URL|window\.location|URLSearchParams|decodeURIComponent\s*\()\b",
    },
    "SSRF": {
        "PY": r"\b(request\.(args|form|data|values|json|get_json|cookies|headers|params)|request\.GET|request\.POST)\s*[\[\.({]",
        "JS": r"\b(req\.(body|query|params|headers)|request\.(body|query|params))\b",
        "JAVA": r"\b(request\.getParameter\s*\(|request\.getAttribute\s*\(|getQueryString\s*\()\s*",
    },
    "PT": {
        "PY": r"\b(request\.(args|form|data|values|json|get_json|cookies|headers|params)|request\.POST|request\.GET)\s*[\[\.({]",
        "JS": r"\b(req\.(body|query|params|headers|cookies)|request\.(body|query|params)|process\.argv)\b",
        "JAVA": r"\b(request\.getParameter\s*\(|request\.getAttribute\s*\(|getQueryString\s*\(|getPathInfo\s*\()\s*",
    },
    "DESER": {
        "PY": r"\b(request\.(args|form|data|values|json|get_json|cookies|body)|request\.GET|request\.POST|sys\.stdin)\s*[\[\.({]",
        "JS": r"\breq\.(body|query|params|headers)\b",
        "JAVA": r"\b(request\.getParameter\s*\(|getInputStream\s*\(|request\.getReader\s*\()\s*",
    },
    "OTHER": {
        "PY": r"\b(request\.(args|form|values|json|cookies|headers)|request\.POST|request\.GET)\b",
        "JS": r"\b(req\.(query|body|params|headers)|request\.(query|body|params))\b",
        "JAVA": r"\b(request\.getParameter|request\.getAttribute)\b",
    },
}
XSS_SINKS = {
    "PY": (PY, r"\b(mark_safe\s*\(|Markup\s*\(|render_template_string\s*\(|format_html\s*\()\s*(.{0,120})"),
    "JS": (("javascript",), r"\b(innerHTML\s*=|outerHTML\s*=|document\.write\s*\(|document\.writeln\s*\(|insertAdjacentHTML\s*\(|eval\s*\(|setTimeout\s*\(|setInterval\s*\(|Function\s*\(|\$\([^)]*\)\.html\s*\(|dangerouslySetInnerHTML\s*=)\s*(.{0,120})"),
}
XSS_NAME = r"\b(user_?input|user_?data|user_?content|param|query|form_?data|search_?term|message|comment|body|payload|username|name|title|description|content|text|value|raw|unsafe)\b"
XSS_ESCAPE = r"\b(html\.escape|escape|cgi\.escape|bleach\.clean|DOMPurify\.sanitize|sanitize|encodeURIComponent|encodeHTML|htmlspecialchars|strip_tags)\s*\("
XSS_FILTER = r"\{\{[^}]*\|\s*safe\s*\}\}"
SSRF_SINKS = {
    "PY": (PY, r"\b(requests\.(get|post|put|patch|delete|head|request|session)\s*\(|urllib\.request\.(urlopen|Request)\s*\(|httpx\.(get|post|put|patch|delete|head|request|AsyncClient)\s*\(|aiohttp\.ClientSession\s*\(\s*\)\s*\.(get|post|put|delete)|http\.client\.HTTPConnection\s*\()"),
    "JS": (JS, r"""\b(fetch\s*\(|axios\.(get|post|put|patch|delete|head|request)\s*\(|https?\.(get|request)\s*\(|request\s*\(\s*['"]?https?|got\.(get|post|put|patch|delete)\s*\(|got\s*\(|needle\.(get|post)\s*\(|superagent\.(get|post)\s*\()"""),
    "JAVA": (JAVA, r"\b(new\s+URL\s*\(|openConnection\s*\(|HttpURLConnection|RestTemplate\s*\(\s*\)\s*\.(get|post|put|delete|exchange)|WebClient\.create\s*\(|OkHttpClient|CloseableHttpClient|HttpClients\.)"),
}
SSRF_NAME = r"\b(url|target_?url|endpoint|host|base_?url|target|redirect|callback|webhook|feed|link|href|uri|remote|proxy_?url)\b"
SSRF_ALLOW = r"\b(allowlist|whitelist|allowed_?hosts|ALLOWED_HOSTS|startswith\s*\(|urlparse\s*\(|re\.match\s*\(|validate_?url)\b"
SSRF_LOCAL = r"""['"]https?://(localhost|127\.0\.0\.1|0\.0\.0\.0)"""
SSRF_GUARDS = (r"if\s+.*\bVAR\.startswith\s*\(", r"if\s+.*\bVAR\b.*\bin\s+", r"if\s+.*\burlparse\s*\(\s*VAR\s*\)")
PT_SINKS = {
    "PY": (PY, r"\b(open\s*\(|Path\s*\(|send_file\s*\(|shutil\.(copy|copy2|move|copyfile)\s*\(|os\.path\.join\s*\()\s*"),
    "JS": (("javascript",), r"\b(fs\.(readFile|readFileSync|createReadStream|writeFile|writeFileSync|appendFile|unlink|stat|lstat|access|open)\s*\(|res\.(sendFile|download)\s*\(|path\.(join|resolve)\s*\(|require\s*\()\s*"),
    "JAVA": (JAVA, r"\b(new\s+File\s*\(|new\s+FileInputStream\s*\(|new\s+FileReader\s*\(|new\s+FileOutputStream\s*\(|Paths\.get\s*\(|Files\.(read|write|copy|move|newInputStream|newOutputStream)\s*\()\s*"),
}
PT_DOTS = r"\.\./|\.\.\\\\"
PT_NAME = r"\b(file_?name|file_?path|path|dir_?name|folder|filepath|filename|upload|download|attachment|document|resource|target)\b"
PT_JOIN = r"\b(os\.path\.join|path\.join)\s*\([^,)]+,[^)]+\)"
PT_SAFE = r"\b(os\.path\.abspath\s*\(|os\.path\.realpath\s*\(|Path\.resolve\s*\(|canonicalPath\s*\(|secure_filename\s*\(|startswith\s*\(base|os\.path\.commonprefix)\s*"
PT_CANONICAL = r"\b(secure_filename|abspath|realpath|resolve)\s*\("
DESER_SINKS = {
    "PY": (PY, r"\b(pickle\.(loads?|Unpickler)\s*\(|yaml\.(load|unsafe_load)\s*\(|marshal\.loads?\s*\(|shelve\.open\s*\(|jsonpickle\.decode\s*\(|dill\.loads?\s*\(|cPickle\.(loads?|Unpickler)\s*\()"),
    "JS": (JS, r"""\b(unserialize\s*\(|deserialize\s*\(|node-serialize|require\s*\(\s*['"]serialize|fromJSON\s*\()\s*"""),
    "JAVA": (JAVA, r"\b(ObjectInputStream\s*\(|\.readObject\s*\(|XMLDecoder\s*\(|XStream\s*\(\s*\)\s*\.fromXML\s*\(|XStream\.fromXML\s*\(|Yaml\s*\(\s*\)\s*\.load\s*\(|new\s+Yaml\s*\()"),
}
DESER_NAME = r"\b(data|payload|body|user_?data|serialized|pickled|raw|blob|input|content|message|request_?data)\b"
YAML_SAFE_LOADER = r"yaml\.load\s*\([^,)]+,\s*Loader\s*=\s*(yaml\.)?(SafeLoader|BaseLoader)\s*\)"
JAVA_SAFE_DESER = r"\b(SafeConstructor|deserializationFilter|ObjectInputFilter)\b"
REDIR_SINKS = {"PY": (PY, r"\bredirect\s*\("), "JS": (JS, r"\b(?:res\.redirect|location\.replace)\s*\(|\blocation\.href\s*="), "JAVA": (JAVA, r"\bsendRedirect\s*\(")}
REDIR_NAME = r"\b(url|redirect|next|target|dest|to|link|href|goto|location)\b"
REDIR_SAFE = r"""\b(allowlist|whitelist|allowed_?hosts|startswith\s*\(\s*['"]/['"]|is_safe_url|validate_?url)\b"""
LDAP_SINKS = {"PY": (PY, r"\bldap\.search(?:_s)?\s*\("), "JS": (JS, r"\bclient\.search\s*\("), "JAVA": (JAVA, r"\b(?:DirContext|InitialDirContext|LdapContext)\.search\s*\(")}
LDAP_ESCAPE = r"\b(escape|sanitize|ldap\.filter\.escape_filter_chars|escape_filter_chars|ldapjs\.filters|FilterBuilder)\b"
XPATH_SINKS = {"PY": (PY, r"\b(?:xpath|find)\s*\("), "JS": (JS, r"\bxpath\.(?:select|evaluate)\s*\("), "JAVA": (JAVA, r"\bXPath\.evaluate\s*\(")}
XPATH_ESCAPE = r"\b(escape|sanitize|xpath_escape|escape_xpath|variables=)\b"
NOSQL_SINKS = {"PY": (PY, r"\.(?:find|find_one)\s*\("), "JS": (JS, r"\.(?:find|findOne|where)\s*\(")}
NOSQL_OPERATOR = r"""['"]\$(?:where|regex)['"]"""
CRYPTO_SINKS = {
    "PY": (PY, r"\b(?:hashlib\.md5|hashlib\.sha1|DES\.new|ARC4\.new|random\.random|random\.randint|random\.choice)\s*\("),
    "JS": (JS, r"""createHash\s*\(\s*['"](?:md5|sha1)['"]\s*\)|\bMath\.random\s*\("""),
    "JAVA": (JAVA, r"""MessageDigest\.getInstance\s*\(\s*['"](?:MD5|SHA-?1)['"]\s*\)|Cipher\.getInstance\s*\(\s*['"](?:DES|RC4)['"]\s*\)"""),
}
JWT_BYPASS = r"jwt\.decode\s*\(.*?(?:verify\s*=\s*False|verify_signature\s*:\s*False).+?\)|jwt\.verify\s*\(.*?(?:ignoreExpiration\s*:\s*true|ignoreSignature\s*:\s*true).+?\)"
SECRET_EQUALS = r"\b(?:password|passwd|token|apikey|secret)\s*==\s*([a-zA-Z0-9_]+)|([a-zA-Z0-9_]+)\s*==\s*\b(?:password|passwd|token|apikey|secret)\b"
DEBUG_ON = r"""\bDEBUG\s*=\s*True\b|\bapp\.run\s*\(.*?(?:debug\s*=\s*True|host\s*=\s*['"]0\.0\.0\.0['"]).*?\)"""
CORS_ANY = r"""allow_origins\s*=\s*\[\s*['"]\*(?:['"]\])?.*?(?:allow_credentials\s*=\s*True)|origin\s*:\s*['"]\*(?:['"]).*?(?:credentials\s*:\s*true)"""
LISTEN_ANY = r"""\.listen\s*\([^,)]+,\s*['"]0\.0\.0\.0['"]\s*\)"""
CSRF_OFF = r"""(?:\bWTF_CSRF_ENABLED['"]\s*\]?\s*=\s*False|@csrf_exempt\b|\bcsrf\.exempt\s*\()"""
XXE_PY = r"\b(?:xml\.etree\.ElementTree\.(?:parse|fromstring)|ET\.(?:parse|fromstring)|lxml\.etree\.(?:parse|fromstring))\s*\("
XXE_JAVA = r"\b(?:DocumentBuilderFactory\.newInstance\s*\(\)|XMLReaderFactory\.createXMLReader\s*\(\))"
XXE_JAVA_SAFE = r'setFeature\s*\(\s*(?:"http://apache.org/xml/features/disallow-doctype-decl"|XMLConstants\.FEATURE_SECURE_PROCESSING)\s*,\s*true\s*\)'
DOCKER_FROM = r"^\s*FROM\s+([^\s#]+)(?:\s+AS\s+\w+)?"
DOCKER_ENV = r"^\s*ENV\s+(\w*(?:password|passwd|api[_-]?key|secret|token)\w*)\s*=\s*(.+)|^\s*ENV\s+(\w*(?:password|passwd|api[_-]?key|secret|token)\w*)\s+(.+)"
OPEN_PORT = r"\b(from_port|to_port)\s*=\s*(22|3389|0)\b"
PUBLIC_ACL = r"""acl\s*=\s*["'](public-read|public-read-write)["']"""
# The secrets family is reconstructed: literals under a secret's name, and the shapes of well-known keys.
SECRET = r"""(?:password|passwd|secret|api_?key|token|secret_?key)\w*["']?\s*[:=]\s*["'][^"'\s]{8,}["']|\bAKIA[0-9A-Z]{16}\b|\bsk_(?:test|live)_[0-9A-Za-z]{10,}|\bsk-proj-[0-9A-Za-z_-]{10,}|\bjwt_token_\w{8,}|token\s*=\s*"[0-9a-f]{40}\""""


def _sqli(key: str) -> Rule:
    languages, sink, ignore_case, variable = SQLI_SINKS[key]
    fstring = Some(FSTRING, True)
    signals = (
        (0.35, Match("w", SQL_KEYWORD, True)),
        (0.05, Distinct(SQL_KEYWORD, 3)),
        (0.35, AnyOf((Match("w", PLUS), Match("w", PHP_DOT), Match("w", PHP_QUOTED)))),
        (0.15, fstring),
        (0.15, Match("w", PERCENT)),
        (0.10, Match("w", FORMAT)),
        (0.10, Match("w", USER_INPUT, True)),
        *((weight, Match("w", p, ci)) for weight, p, ci in SQLI_SAFE[key]),
    )
    snippets = ((PLUS, False), (FSTRING, True), (PHP_DOT, False), (PHP_QUOTED, False))
    return Rule(f"{key}-SQLI-001", languages, sink, "SQL Injection", "CRITICAL", "CWE-89", "", signals, ignore_case, 12, 4, skip_comments=True, backtrack=variable, snippets=snippets, sink_text="line")


def _cmd(key: str) -> Rule:
    languages, sink, ignore_case = CMD_SINKS[key]
    never = Not(Always())
    shell_true = implicit = concat = interp = percent = formatted = single = listed = multi = shell_off = never
    plus = Match("w", PLUS_LINE)
    snippets = ((PLUS_LINE, False),)
    if key != "PHP":
        concat = plus
    if key == "PY":
        shell_true, shell_off = Match("w", r"\bshell\s*=\s*True\b"), Match("w", r"\bshell\s*=\s*False\b")
        implicit = Match("w", r"\b(?:os\s*\.\s*system|subprocess\s*\.\s*(?:getoutput|getstatusoutput))\b")
        listed = Match("w", r"\b(?:subprocess\s*\.\s*(?:run|call|Popen|check_call|check_output))\s*\(\s*[\[\(]", True)
        interp, percent, formatted = Some(FSTRING_LINE, True), Match("w", PERCENT), Match("w", FORMAT)
        snippets += ((FSTRING_LINE, True),)
    elif key == "JAVA":
        multi = AnyOf((Match("w", r"\b(?:ProcessBuilder|exec)\s*\(\s*[^,)]+\s*,\s*[^)]+\s*\)"), Match("w", r"\bexec\s*\(\s*(?:new\s+String\s*\[\s*\]\s*\{|cmdArray|cmdarray)\b")))
        single = Not(multi)
    elif key == "JS":
        implicit = Match("w", r"\bexec(?:Sync|FileSync)?\b")
        multi = AnyOf((Match("w", r"(?s)\bspawn(?:Sync)?\b.*?,.*?\["), Match("w", "shell: false")))
        single, interp = Not(multi), Match("w", TEMPLATE)
        snippets += ((TEMPLATE, False),)
    elif key == "GO":
        several, in_shell = Match("w", GO_MULTI), All((Match("w", SHELL_WORD, True), AnyOf((plus, Match("w", GO_SPRINTF)))))
        shell_true, multi, single = All((several, in_shell)), All((several, Not(in_shell))), Not(several)
        formatted = Match("w", GO_SPRINTF)
        snippets += ((GO_SPRINTF, False),)
    else:
        implicit, concat, interp = Always(), Match("w", PHP_DOT_LINE), Match("w", PHP_QUOTED_LINE)
        snippets = ((PHP_DOT_LINE, False), (PHP_QUOTED_LINE, False))
    user = Match("w", USER_INPUT, True)
    signals = (
        (0.45, shell_true),
        (0.45, implicit),
        (0.35, concat),
        (0.35, interp),
        (0.30, percent),
        (0.30, formatted),
        (0.25, single),
        (0.10, user),
        (0.10, Match("w", SHELL_WORD, True)),
        (-0.60, listed),
        (-0.60, multi),
        (-0.50, Match("w", SANITISER, True)),
        (-0.25, shell_off),
        (-0.25, Not(AnyOf((concat, interp, percent, formatted, user)))),
    )
    return Rule(f"{key}-CMD-001", languages, sink, "Command Injection", "CRITICAL", "CWE-78", "", signals, ignore_case, 10, 4, skip_comments=True, snippets=snippets, sink_text="line")


def _xss(key: str) -> Rule:
    languages, sink = XSS_SINKS[key]
    signals = (
        (0.50, Always()),
        (0.35, Match("w", REQUEST["XSS"][key], True)),
        (0.20, Match("w", XSS_NAME, True)),
        (0.20, Match("line", r"f['\"]|\.format\s*\(|%\s*\(")),
        (0.15, Match("line", JOINED)),
        (0.15, Match("line", XSS_FILTER, True)),
        (-0.60, Match("w", XSS_ESCAPE, True)),
        (-0.40, Not(Match("line", r"\b[a-z_][a-z0-9_]{2,}\b", True))),
    )
    source = {"PY": "request parameter", "JS": "user-controlled input (req.body / req.query / location.*)"}[key]
    return Rule(f"PSEC-XSS-{key}-001", languages, sink, "Cross-Site Scripting (XSS)", "HIGH", "CWE-79", source, signals, before=10, after=3, also=XSS_FILTER if key == "PY" else None, source_when=(Match("w", XSS_NAME, True), "user-controlled input") if key == "PY" else None)


def _ssrf(key: str) -> Rule:
    languages, sink = SSRF_SINKS[key]
    source = Match("w", REQUEST["SSRF"][key], True)
    signals = (
        (0.55, Always()),
        (0.40, source),
        (0.25, Match("w", SSRF_NAME, True)),
        (0.20, Match("line", JOINED)),
        (0.15, Match("line", r"f['\"]|\.format\s*\(")),
        (-0.55, Match("w", SSRF_ALLOW, True)),
        (-0.35, All((Match("w", SSRF_LOCAL, True), Not(source)))),
        (-1.0, Guarded(SSRF_GUARDS)),
    )
    return Rule(f"PSEC-SSRF-{key}-001", languages, sink, "Server-Side Request Forgery (SSRF)", "HIGH", "CWE-918", "user-controlled URL parameter", signals, before=12, after=3)


def _path(key: str) -> Rule:
    languages, sink = PT_SINKS[key]
    signals = (
        (0.50, Always()),
        (0.40, Match("w", REQUEST["PT"][key], True)),
        (0.30, Match("w", PT_DOTS)),
        (0.25, Match("w", PT_NAME, True)),
        (0.15, Match("line", PT_JOIN)),
        (-0.55, Match("w", PT_SAFE, True)),
        (-1.00, Match("line", PT_CANONICAL, True)),
        (-0.30, Not(Match("w", r"\b[a-z_][a-z0-9_]{2,}\b", True))),
    )
    return Rule(f"PSEC-PT-{key}-001", languages, sink, "Path Traversal", "HIGH", "CWE-22", "user-controlled path input", signals, before=12, after=3)


def _deser(key: str) -> Rule:
    languages, sink = DESER_SINKS[key]
    checks: tuple = ()
    if key == "PY":
        yaml = All((Match("line", r"\byaml\.load\b", True), AnyOf((Match("line", YAML_SAFE_LOADER, True), Match("w", r"\byaml\.safe_load\s*\(", True)))))
        checks = ((-0.60, yaml), (-0.70, Match("line", r"\byaml\.safe_load\b", True)))
    elif key == "JAVA":
        checks = ((-0.50, Match("w", JAVA_SAFE_DESER, True)),)
    signals = ((0.60, Always()), *checks, (0.40, Match("w", REQUEST["DESER"][key], True)), (0.25, Match("w", DESER_NAME, True)))
    return Rule(f"PSEC-DESER-{key}-001", languages, sink, "Insecure Deserialization", "CRITICAL", "CWE-502", "untrusted serialized data", signals, before=10, after=3)


def _small(family: str, key: str, sinks: dict, kind: str, cwe: str, source: str, middle: tuple) -> Rule:
    languages, sink = sinks[key]
    signals = ((0.50, Always()), (0.35, Match("w", REQUEST["OTHER"][key], True)), *middle, (-0.30, Not(Match("line", NAME))))
    return Rule(f"PSEC-{family}-{key}-001", languages, sink, kind, "HIGH", cwe, source, signals, before=8, after=3)


def _constant(rule_id: str, languages: tuple, sink: str, kind: str, severity: str, cwe: str, source: str, score: float, **more) -> Rule:
    return Rule(rule_id, languages, sink, kind, severity, cwe, source, ((score, Always()),), **more)


_CONCAT = (0.20, Match("line", CONCAT, True))
_QUERY = "user-controlled query input"
RULES: tuple[Rule, ...] = (
    *(_sqli(k) for k in SQLI_SINKS),
    *(_cmd(k) for k in CMD_SINKS),
    *(_xss(k) for k in XSS_SINKS),
    *(_ssrf(k) for k in SSRF_SINKS),
    *(_path(k) for k in PT_SINKS),
    *(_deser(k) for k in DESER_SINKS),
    *(_small("REDIR", k, REDIR_SINKS, "Open Redirect", "CWE-601", "user-controlled redirect URL", ((0.20, Match("w", REDIR_NAME, True)), (-0.55, Match("w", REDIR_SAFE, True)))) for k in REDIR_SINKS),
    *(_small("LDAP", k, LDAP_SINKS, "LDAP Injection", "CWE-90", _QUERY, (_CONCAT, (-0.55, Match("w", LDAP_ESCAPE, True)))) for k in LDAP_SINKS),
    *(_small("XPATH", k, XPATH_SINKS, "XPath Injection", "CWE-643", _QUERY, (_CONCAT, (-0.55, Match("w", XPATH_ESCAPE, True)))) for k in XPATH_SINKS),
    *(_small("NOSQL", k, NOSQL_SINKS, "NOSQL Injection", "CWE-943", _QUERY, (_CONCAT, (0.30, Match("w", NOSQL_OPERATOR, True)))) for k in NOSQL_SINKS),
    *(_constant(f"PSEC-CRYPTO-{k}-001", *CRYPTO_SINKS[k], "Weak Cryptography", "MEDIUM", "CWE-327", "cryptographic/random operation", 0.85, cwe_when=(Match("sink", "random", True), "CWE-338")) for k in CRYPTO_SINKS),
    *(_constant(f"PSEC-AUTH-{k}-001", v, JWT_BYPASS, "Broken Authentication", "HIGH", "CWE-208", "authentication operation", 0.80, also=SECRET_EQUALS, cwe_when=(Match("line", "jwt", True), "CWE-347")) for k, v in (("PY", PY), ("JS", JS))),
    *(_constant(f"PSEC-CONFIG-{k}-001", v, p, "Security Misconfiguration", "HIGH", "CWE-2", "application configuration setting", 0.85, also=CORS_ANY, cwe_when=(Match("line", "cors|origin", True), "CWE-942")) for k, v, p in (("PY", PY, DEBUG_ON), ("JS", JS, LISTEN_ANY))),
    _constant("PSEC-CSRF-PY-001", PY, CSRF_OFF, "Cross-Site Request Forgery (CSRF)", "HIGH", "CWE-352", "disabled CSRF token validation", 1.0),
    Rule("PSEC-XXE-PY-001", PY, XXE_PY, "XML External Entity (XXE)", "HIGH", "CWE-611", "untrusted XML document", ((1.0, Always()), (-1.0, Match("w", r"\bdefusedxml\b", True)), (-1.0, All((Match("sink", "lxml", True), Match("w", r"resolve_entities\s*=\s*False", True))))), before=10, after=10),
    Rule("PSEC-XXE-JAVA-001", JAVA, XXE_JAVA, "XML External Entity (XXE)", "HIGH", "CWE-611", "untrusted XML document", ((1.0, Always()), (-1.0, Match("w", XXE_JAVA_SAFE, True))), before=2, after=10),
    Rule("IAC-DKR-001", ("dockerfile",), DOCKER_FROM, "Security Misconfiguration", "MEDIUM", "CWE-1104", "", ((0.90, Always()), (-0.90, Not(Match("line", r"^\s*FROM\s+(?:[^\s#:@]+|[^\s#:@]+:latest(?::[^\s#@]*)?)(?:[\s#]|$)", True)))), sink_text="Unpinned base image reference"),
    _constant("IAC-DKR-003", ("dockerfile",), DOCKER_ENV, "Hardcoded Secret", "HIGH", "CWE-798", "", 0.80, sink_text="Cleartext secret assignment in container ENV metadata"),
    Rule("IAC-TF-001", ("terraform",), r"0\.0\.0\.0/0", "Security Misconfiguration", "HIGH", "CWE-732", "", ((0.85, All((Match("line", "cidr_blocks"), Match("w", OPEN_PORT)))),), before=5, after=6, sink_text="port"),
    _constant("IAC-TF-002", ("terraform",), PUBLIC_ACL, "Security Misconfiguration", "HIGH", "CWE-732", "", 0.90, sink_text="acl"),
    _constant("SECRET-001", ("*",), SECRET, "Hardcoded Secret", "CRITICAL", "CWE-798", "", 0.85),
)
BY_ID = {r.rule_id: r for r in RULES}
#: Rules that read the whole file: the last USER decides.
LAST_USER = r"(?i)^\s*USER\s+(\w+)"
DKR_002 = ("IAC-DKR-002", "Security Misconfiguration", "HIGH", "CWE-250", 0.85)
