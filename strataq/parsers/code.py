"""Parsers of source code: Python by its own grammar, brace languages and shell by a scanner of declarations."""

from __future__ import annotations

import ast
import re

from .tree import Element, parser


def _lines(source: str) -> list[str]:
    return source.splitlines()


_DEFS = (ast.FunctionDef, ast.AsyncFunctionDef)
_SCOPES = (*_DEFS, ast.ClassDef)
_IMPORTS = (ast.Import, ast.ImportFrom)


def _unparsed(n: ast.AST) -> str:
    """`ast.unparse`, which takes long to begin with, of names, dotted names and plain constants at once."""
    kind = n.__class__
    if kind is ast.Name:
        return n.id
    if kind is ast.Attribute and n.value.__class__ in (ast.Name, ast.Attribute):
        return f"{_unparsed(n.value)}.{n.attr}"
    if kind is ast.Constant and n.kind is None and n.value.__class__ in (int, str, bool, type(None)):
        return repr(n.value)
    return ast.unparse(n)


@parser("python")
def python(source: str) -> list[Element]:
    lines = _lines(source)

    def body(n) -> str:
        return "\n".join(lines[n.lineno - 1 : n.end_lineno])

    def function(n) -> Element:
        args = [{"name": a.arg, "type": _unparsed(a.annotation) if a.annotation else None} for a in n.args.args]
        attributes = {"parameters": args, "return_type": _unparsed(n.returns) if n.returns else None, "decorators": [_unparsed(d) for d in n.decorator_list], "docstring": ast.get_docstring(n), "is_async": isinstance(n, ast.AsyncFunctionDef)}
        return Element("function", n.name, body(n), n.lineno, n.end_lineno, attributes)

    out = []
    for n in ast.parse(source).body:
        if isinstance(n, _DEFS):
            out.append(function(n))
        elif isinstance(n, ast.ClassDef):
            attributes = {"bases": [_unparsed(b) for b in n.bases], "decorators": [_unparsed(d) for d in n.decorator_list], "docstring": ast.get_docstring(n)}
            out.append(Element("class", n.name, body(n), n.lineno, n.end_lineno, attributes, [function(m) for m in n.body if isinstance(m, _DEFS)]))
        elif isinstance(n, _IMPORTS):
            module = getattr(n, "module", None)
            out += [Element("import", a.name, body(n), n.lineno, n.end_lineno, {"module": module or a.name, "name": a.name, "alias": a.asname, "level": getattr(n, "level", 0)}) for a in n.names]
        elif isinstance(n, (ast.Assign, ast.AnnAssign)) and n.value is not None:
            targets = n.targets if isinstance(n, ast.Assign) else [n.target]
            kind = _unparsed(n.annotation) if isinstance(n, ast.AnnAssign) else None
            out += [Element("variable", t.id, body(n), n.lineno, n.end_lineno, {"value": _unparsed(n.value), "type": kind}) for t in targets if isinstance(t, ast.Name)]
    return out


def python_usages(source: str, content: bool = True) -> list[Element]:
    """Calls, attribute calls, name reads and assignments with the function they stand in."""
    out = []

    def visit(n, scope: str) -> None:
        kind = n.__class__
        found = None
        if kind is ast.Name:
            found = ("assignment" if n.ctx.__class__ is ast.Store else "variable_reference", n.id)
        elif kind is ast.Call:
            of = n.func.__class__
            found = ("method_call", n.func.attr) if of is ast.Attribute else ("function_call", n.func.id) if of is ast.Name else None
        elif kind in _SCOPES:
            scope = f"{scope}::{n.name}" if scope else n.name
        elif kind in _IMPORTS:
            found = ("import_usage", n.names[0].name)
        if found:
            out.append(Element(found[0], found[1], _unparsed(n) if content else "", n.lineno, n.end_lineno or n.lineno, {"symbol_name": found[1], "usage_type": found[0], "context": scope or None, "scope": scope or "module"}))
        if kind in _LEAVES:
            return
        for field in n._fields:
            value = getattr(n, field, None)
            if value.__class__ is list:
                for c in value:
                    if isinstance(c, ast.AST):
                        visit(c, scope)
            elif field != "ctx" and isinstance(value, ast.AST):
                visit(value, scope)

    visit(ast.parse(source), "")
    return out


_LEAVES = {ast.Name, ast.Constant, ast.alias}


_MARKS = re.compile(r'//[^\n]*|/\*.*?\*/|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])\'|`[^`]*`', re.S)
_HASH_MARKS = re.compile(r"(?m:^\s*#[^\n]*|(?<=\s)#[^\n]*)|\"(?:\\.|[^\"\\])*\"|'[^']*'", re.S)
_NO_FEED, _BRACE = re.compile(r"[^\n]"), re.compile("[{}]")


def _blank(source: str, hash_comments: bool = False) -> str:
    """`source` with comments and strings blanked, so that braces can be counted; line feeds stay."""
    return (_HASH_MARKS if hash_comments else _MARKS).sub(lambda m: _NO_FEED.sub(" ", m.group()), source)


def _close(clean: str, at: int) -> int:
    """Where the block that opens at the first brace from `at` ends; the end of the text if it doesn't."""
    depth = 0
    for m in _BRACE.finditer(clean, at):
        depth += 1 if m.group() == "{" else -1
        if depth == 0:
            return m.end()
    return len(clean)


def _line(source: str, at: int) -> int:
    return source.count("\n", 0, at) + 1


def _comment_before(lines: list[str], first: int, marks: tuple[str, ...]) -> str | None:
    out, i = [], first - 2
    while i >= 0 and lines[i].strip().startswith(marks):
        out.append(re.sub(r"^\s*(?:///?!?|#)\s?", "", lines[i]).rstrip())
        i -= 1
    return "\n".join(reversed(out)) or None


def _scan(source: str, clean: str, rules: list[tuple[str, re.Pattern, bool]], inner: dict[str, list] | None = None, base: int = 0, end: int | None = None) -> list[tuple[int, int, str, re.Match]]:
    """(start, end, type, match) of declarations that stand at no deeper level than the region's own."""
    end = len(clean) if end is None else end
    found, at = [], base
    ahead: list[tuple[str, re.Pattern, bool, re.Match | None]] = [(kind, rx, block, rx.search(clean, at, end)) for kind, rx, block in rules]
    while at < end:
        # a rule's next match stays its next one until the scan has passed where it begins
        ahead = [(kind, rx, block, rx.search(clean, at, end) if m and m.start() < at else m) for kind, rx, block, m in ahead]
        best = None
        for kind, _, block, m in ahead:
            if m and (best is None or m.start() < best[1].start()):
                best = (kind, m, block)
        brace = clean.find("{", at, end)
        if best is None or (0 <= brace < best[1].start()):
            if brace < 0:
                break
            at = _close(clean, brace)
            continue
        kind, m, block = best
        stop = m.end()
        if block:
            opening, semi = clean.find("{", m.end() - 1, end), clean.find(";", m.end() - 1, end)
            stop = semi + 1 if 0 <= semi and (opening < 0 or semi < opening) else _close(clean, opening) if opening >= 0 else m.end()
        found.append((m.start(), stop, kind, m))
        at = max(stop, m.end())
    return found


def _element(source: str, start: int, stop: int, kind: str, name: str | None, attributes: dict | None = None, children: list[Element] | None = None) -> Element:
    while start < stop and source[start].isspace():
        start += 1
    return Element(kind, name, source[start:stop], _line(source, start), _line(source, max(start, stop - 1)), {k: v for k, v in (attributes or {}).items() if v is not None}, children or [])


_RUST = [
    ("import", re.compile(r"^[ \t]*(?:pub\s+)?use\s+([^;]+);", re.M), False), ("function", re.compile(r"^[ \t]*(pub(?:\([^)]*\))?\s+)?(?:const\s+|async\s+|unsafe\s+|extern\s+\S*\s*)*fn\s+(\w+)", re.M), True),
    ("struct", re.compile(r"^[ \t]*(pub(?:\([^)]*\))?\s+)?struct\s+(\w+)", re.M), True), ("implementation", re.compile(r"^[ \t]*(?:unsafe\s+)?impl\b(?:<[^{]*?>)?\s*([^{;]+?)\s*(?=\{)", re.M), True),
    ("module", re.compile(r"^[ \t]*(pub(?:\([^)]*\))?\s+)?mod\s+(\w+)", re.M), True),
]


@parser("rust")
def rust(source: str) -> list[Element]:
    clean, lines = _blank(source), _lines(source)

    def region(a: int, b: int) -> list[Element]:
        out = []
        for start, stop, kind, m in _scan(source, clean, _RUST, base=a, end=b):
            first = _line(source, start + len(m.group()) - len(m.group().lstrip()))
            note = _comment_before(lines, first, ("//", "#["))
            if kind == "import":
                out.append(_element(source, start, stop, kind, m[1].strip()))
                continue
            children = []
            opening = clean.find("{", m.end() - 1, stop)
            if kind in ("implementation", "module") and opening >= 0:
                children = region(opening + 1, stop - 1)
            if kind == "implementation":
                out.append(_element(source, start, stop, kind, f"impl {' '.join(m[1].split())}", {"docstring": note}, children))
                continue
            head = source[start : opening if opening >= 0 else stop].strip()
            attributes = {"visibility": "pub" if m[1] else "private", "docstring": None if kind == "struct" else note}
            out.append(_element(source, start, stop, kind, m[2], attributes | ({"signature": head} if kind == "function" else {}), children))
        return out

    return region(0, len(clean))


_TYPE = r"(?:[A-Za-z_][\w:]*(?:<[^;{}()]*>)?[\s*&]+)+"
_FUNCTION = re.compile(rf"^[ \t]*(?:template\s*<[^{{}};]*>\s*)?({_TYPE})((?:[A-Za-z_~][\w:~]*|operator\S+))\s*\(([^;{{}}]*)\)\s*(?:const|noexcept|override|final|\s)*(?=\{{)", re.M)
_C = [
    ("import", re.compile(r"^[ \t]*#\s*include\s*([<\"])([^>\"]+)[>\"]", re.M), False), ("macro", re.compile(r"^[ \t]*#\s*define\s+(\w+)[^\n]*", re.M), False),
    ("namespace", re.compile(r"^[ \t]*namespace\s+([\w:]*)\s*(?=\{)", re.M), True), ("struct", re.compile(r"^[ \t]*(?:typedef\s+)?(struct|union|enum|class)\s+(?:class\s+)?(\w*)[^;{}()=]*(?=\{)", re.M), True),
    ("function", _FUNCTION, True), ("variable", re.compile(rf"^({_TYPE})(\w+)\s*(?:\[[^\]]*\])?\s*(?:=[^;{{}}]*)?;", re.M), False),
]


def _c_like(source: str, kind: str) -> list[Element]:
    clean = _blank(source)
    clean = re.sub(r'(?m)^([ \t]*#\s*include\s*)\s+$', lambda m: m.group(), clean)
    for m in re.finditer(r'(?m)^[ \t]*#\s*include\s*"[^"\n]+"', source):
        clean = clean[: m.start()] + m.group() + clean[m.end() :]

    def region(a: int, b: int) -> list[Element]:
        out = []
        for start, stop, what, m in _scan(source, clean, _C if kind != "c" else [r for r in _C if r[0] != "namespace"], base=a, end=b):
            opening = clean.find("{", m.end() - 1, stop)
            if what == "import":
                attributes = {"is_system": m[1] == "<"}
                if kind == "cuda":
                    attributes["is_cuda"] = "cuda" in m[2] or m[2].endswith(".cuh")
                out.append(_element(source, start, stop, what, m[2], attributes))
            elif what == "macro":
                if kind == "c":
                    out.append(_element(source, start, stop, what, m[1]))
            elif what == "namespace":
                out.append(_element(source, start, stop, what, m[1] or None, {}, region(opening + 1, stop - 1)))
            elif what == "struct":
                name = m[2] or None
                if source[start:stop].lstrip().startswith("typedef"):
                    tail = re.match(r"\s*(\w+)\s*;", clean[stop:])
                    name = tail[1] if tail else name
                label = {"class": "class", "struct": "class" if kind in ("cpp",) else "struct"}.get(m[1], m[1])
                inside = clean[opening + 1 : stop - 1]
                if m[1] == "enum":
                    children = []
                elif kind == "c":
                    children = [_element(source, opening + 1 + f.start(), opening + 1 + f.end(), "field", f[2], {"type": f[1].strip()}) for f in re.finditer(rf"({_TYPE})(\w+)\s*(?:\[[^\]]*\])?\s*;", inside)]
                else:
                    children = [x for x in region(opening + 1, stop - 1) if x.type != "variable"]
                out.append(_element(source, start, stop, label, name, {}, children))
            elif what == "function":
                words = source[start : m.end()]
                label, attributes = "function", {"return_type": " ".join(m[1].split()), "parameters": [" ".join(p.split()) for p in m[3].split(",") if p.strip()]}
                if kind == "cuda":
                    flags = {"is_global": "__global__" in words, "is_device": "__device__" in words, "is_host": "__host__" in words}
                    label = "kernel" if flags["is_global"] else "device_function" if flags["is_device"] else "function"
                    attributes |= flags
                out.append(_element(source, start, stop, label, m[2], attributes))
            elif m[1].split()[0] not in ("return", "using", "typedef", "goto", "else", "delete", "throw"):
                out.append(_element(source, start, stop, what, m[2], {"type": " ".join(m[1].split())}))
        return out

    return region(0, len(clean))


@parser("c")
def c(source: str) -> list[Element]:
    return _c_like(source, "c")


@parser("cpp")
def cpp(source: str) -> list[Element]:
    return _c_like(source, "cpp")


@parser("cuda")
def cuda(source: str) -> list[Element]:
    return _c_like(source, "cuda")


_GO = [
    ("package", re.compile(r"^package\s+(\w+)", re.M), False), ("function", re.compile(r"^func\s+(\([^)]*\)\s*)?(\w+)", re.M), True), ("type", re.compile(r"^type\s+(\w+)\s+(struct|interface)\b", re.M), True),
    ("import", re.compile(r"^import\b[ \t]*(\([^)]*\)|[^\n]*)", re.M), False),
]


@parser("go")
def go(source: str) -> list[Element]:
    clean = _blank(source)
    out = []
    for start, stop, kind, m in _scan(source, clean, _GO):
        if kind == "import":
            for x in re.finditer(r'(?:(\S+)\s+)?"([^"]+)"', source[start:stop].removeprefix("import")):
                out.append(_element(source, start, stop, "import", x[2], {"module": x[2], "alias": x[1] if x[1] and x[1] != "(" else None, "import_type": "grouped" if "(" in m[1] else "single"}))
        elif kind == "type":
            out.append(_element(source, start, stop, m[2], m[1], {"type_kind": m[2]}))
        elif kind == "function":
            out.append(_element(source, start, stop, kind, m[2], {"receiver": m[1].strip() if m[1] else None}))
        else:
            out.append(_element(source, start, stop, kind, m[1]))
    return out


_BASH = [("function", re.compile(r"^[ \t]*(?:function\s+([\w:-]+)\s*(?:\(\s*\))?|([\w:-]+)\s*\(\s*\))\s*(?=\{)", re.M), True), ("variable", re.compile(r"^(?:export\s+|readonly\s+|declare\s+(?:-\w+\s+)*)?([A-Za-z_]\w*)=([^\n]*)", re.M), False)]


@parser("bash")
def bash(source: str) -> list[Element]:
    clean = _blank(source, hash_comments=True)
    out = []
    for start, stop, kind, m in _scan(source, clean, _BASH):
        out.append(_element(source, start, stop, kind, m[1] or m[2] if kind == "function" else m[1], {"value": source[m.start(2) : m.end(2)].strip()} if kind == "variable" else {}))
    return out
