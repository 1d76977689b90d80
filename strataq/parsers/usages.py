"""Usages of symbols: calls, references, assignments and imports, with the function that they stand in."""

from __future__ import annotations

import re
from collections.abc import Iterator

from . import code
from .code import _blank, _line, python_usages
from .tree import Element

_TOKEN = re.compile(
    r"(?P<name>[A-Za-z_]\w*)(?P<path>(?:::[A-Za-z_]\w*)*)(?P<macro>!(?!=))?(?=(?P<after>\s*(?:::<[^>]*>)?\s*(?:\(|:?=(?!=)|[+\-*/%|&^]=)?))"
)
_WORDS = {
    "rust": set("as async await break const continue crate dyn else enum extern false fn for if impl in let loop match mod move mut pub ref return self Self static struct super trait true type unsafe use where while".split()),
    "go": set("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var nil true false iota".split()),
}
_TYPES = {
    "rust": set("i8 i16 i32 i64 i128 u8 u16 u32 u64 u128 usize isize f32 f64 bool char str String Vec Option Result Box".split()),
    "go": set("int int8 int16 int32 int64 uint uint8 uint16 uint32 uint64 byte rune string bool float32 float64 error any uintptr".split()),
}
_IMPORT = {"rust": re.compile(r"\buse\s+([^;]+);"), "go": re.compile(r'^import\s+(\([^)]*\)|[^\n]+)', re.M)}
_HEAD = {"rust": re.compile(r"\b(fn|struct|enum|trait|mod|type|const|static|impl)\s+(?:<[^>]*>\s*)?([A-Za-z_]\w*)"), "go": re.compile(r"\b(func|type|var|const)\s+(?:\([^)]*\)\s*)?([A-Za-z_]\w*)")}


def _scopes(source: str, kind: str) -> list[tuple[int, int, str]]:
    """First line, last line and name of each function, inner ones last."""
    out = []

    def visit(elements: list[Element], trail: tuple[str, ...]) -> None:
        for e in elements:
            if e.type == "function":
                out.append((e.line_start, e.line_end, "::".join((*trail, e.name or ""))))
            visit(e.children, (*trail, e.name or e.type))

    visit({"rust": code.rust, "go": code.go}[kind](source), ())
    return out


def scanned_usages(source: str, kind: str) -> Iterator[Element]:
    """Usages in Rust or Go by a scan of names: what stands before and after a name tells its use."""
    clean, scopes = _blank(source), _scopes(source, kind)
    declared = {m.start(2) for m in _HEAD[kind].finditer(clean)}
    skipped: list[tuple[int, int]] = []

    def usage(at: int, end: int, name: str, what: str) -> Element:
        line = _line(source, at)
        inside = [s for a, b, s in scopes if a <= line <= b]
        context = inside[-1] if inside else None
        return Element(what, name, source[at:end], line, line, {"symbol_name": name, "usage_type": what, "context": context, "scope": context or "module"})

    for m in _IMPORT[kind].finditer(source if kind == "go" else clean):
        skipped.append(m.span())
        for x in re.finditer(r'"([^"]+)"', m[1]) if kind == "go" else re.finditer(r"([\w:]+(?:::\*)?)\s*(?=[,}]|$)", m[1]):
            yield usage(m.start(), m.end(), x[1].split("/" if kind == "go" else "::")[-1], "import_usage")
    for m in _TOKEN.finditer(clean):
        name, at = m["name"], m.start()
        last = m["path"].split("::")[-1] if m["path"] else name
        if name in _WORDS[kind] and not m["path"] or at in declared or any(a <= at < b for a, b in skipped):
            continue
        before = clean[max(0, at - 24) : at].rstrip()
        after = m["after"].strip()
        if kind == "go" and re.search(r"\bpackage$", before):
            continue
        called = after.endswith("(") or m["macro"]
        if called:
            what = "method_call" if before.endswith(".") else "function_call"
        elif before.endswith(".") and not before.endswith(".."):
            continue  # a field
        elif name in _TYPES[kind] or kind == "rust" and (before.endswith(":") and not before.endswith("::") or before.endswith("->") or name[:1].isupper() and not m["path"]):
            what = "type_reference"
        elif after and not after.endswith("(") or re.search(r"\blet(\s+mut)?$", before) or kind == "go" and re.search(r"\bvar$", before):
            what = "assignment"
        else:
            what = "variable_reference"
        yield usage(at, m.end(), last, what)


def usages_of(source: str, kind: str, content: bool = True) -> list[Element]:
    """Usages in a source; none for other languages or where it can't be read.  Without `content`, those in Python have none."""
    try:
        if kind == "python":
            return python_usages(source, content)
        return list(scanned_usages(source, kind)) if kind in ("rust", "go") else []
    except (SyntaxError, ValueError, RecursionError):
        return []
