"""Parsers of text, JSON, TOML, HTML and Markdown."""

from __future__ import annotations

import json
import re
import tomllib
from collections import Counter
from html.parser import HTMLParser

from .tree import Element, parser

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


@parser("text")
def text(source: str) -> list[Element]:
    return [Element("block", None, source, 1, max(1, len(source.splitlines())))] if source else []


def _value(key: str, v) -> Element:
    if isinstance(v, dict):
        return Element("block", key, json.dumps(v, default=str), 1, 1, {}, [_value(k, v[k]) for k in v])
    if isinstance(v, list):
        return Element("block", key, json.dumps(v, default=str), 1, 1, {}, [_value(f"[{i}]", x) for i, x in enumerate(v)])
    return Element("variable", key, json.dumps(v, default=str), 1, 1, {"value": v})


@parser("json")
def json_(source: str) -> list[Element]:
    v = json.loads(_without_comments(source))
    return _value("", v).children if isinstance(v, dict | list) else [_value("value", v)]


def _without_comments(source: str) -> str:
    """JSON with comments and trailing commas as plain JSON; strings stay as they are."""
    token = re.compile(r'"(?:\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/|,(?=\s*(?://[^\n]*\s*|/\*.*?\*/\s*)*[}\]])', re.S)
    return token.sub(lambda m: m.group() if m.group()[0] == '"' else "", source)


@parser("toml")
def toml(source: str) -> list[Element]:
    lines = source.splitlines()

    def line_of(pattern: str) -> int:
        return next((i for i, x in enumerate(lines, 1) if re.match(pattern, x)), 1)

    out = []
    for key, v in tomllib.loads(source).items():
        if isinstance(v, dict):
            e = _value(key, v)
            e.line_start = line_of(rf"\s*\[\s*{re.escape(key)}\b")
            e.line_end = next((i - 1 for i in range(e.line_start + 1, len(lines) + 1) if lines[i - 1].lstrip().startswith("[")), len(lines))
            out.append(e)
        elif isinstance(v, list) and v and all(isinstance(x, dict) for x in v):
            out += [_value(f"{key}[{i}]", x) for i, x in enumerate(v)]
        else:
            e = _value(key, v)
            e.type, e.children = "variable", []
            e.line_start = e.line_end = line_of(rf"\s*{re.escape(key)}\s*=")
            e.attributes = {"value": v if isinstance(v, str | int | float | bool) else str(v)}
            out.append(e)
    return out


class _Tag(Element):
    """An element that cuts its content from the source when it is asked for it: tags that are never closed nest as deep as the
    page is long, and a copy a level would be the square of it."""

    @property
    def content(self) -> str:
        return self.source[self.begin : self.end]

    @content.setter
    def content(self, x: str) -> None:
        self.source, self.begin, self.end = x, 0, len(x)


class _Html(HTMLParser):
    def __init__(self, source: str):
        super().__init__(convert_charrefs=True)
        self.source, self.top, self.stack, self.open = source, [], [], Counter()
        self.starts = [0]
        for m in re.finditer("\n", source):
            self.starts.append(m.end())
        self.feed(source)
        self.close()
        while self.stack:
            self._end(len(source), len(self.starts))

    def _at(self) -> tuple[int, int]:
        line, col = self.getpos()
        return self.starts[line - 1] + col, line

    def handle_starttag(self, tag, attrs):
        at, line = self._at()
        e = _Tag("element", tag, "", line, line, {k: v or "" for k, v in attrs})
        (self.stack[-1][0].children if self.stack else self.top).append(e)
        if tag not in VOID:
            self.stack.append((e, at + len(self.get_starttag_text() or "")))
            self.open[tag] += 1

    def handle_startendtag(self, tag, attrs):
        """Self-closing tags aren't emitted."""

    def _end(self, at: int, line: int) -> None:
        e, begin = self.stack.pop()
        self.open[e.name] -= 1
        e.source, e.begin, e.end, e.line_end = self.source, begin, at, line

    def handle_endtag(self, tag):
        if self.open[tag]:
            at, line = self._at()
            while self.stack:
                name = self.stack[-1][0].name
                self._end(at, line)
                if name == tag:
                    return


@parser("html")
def html(source: str) -> list[Element]:
    return _Html(source).top


_INLINE = [
    ("image", re.compile(r"!\[([^\]]*)\]\(([^)\s]+)[^)]*\)")), ("link", re.compile(r"(?<!!)\[([^\]]+)\]\(([^)\s]+)(?:\s+\"([^\"]*)\")?\)")), ("strong", re.compile(r"\*\*(.+?)\*\*|__(.+?)__")),
    ("emphasis", re.compile(r"(?<![*\w])\*([^*\s][^*]*)\*(?!\*)|(?<![_\w])_([^_\s][^_]*)_(?![_\w])")), ("strikethrough", re.compile(r"~~(.+?)~~")),
]


def _inline(text_: str, line: int) -> list[Element]:
    out = []
    plain = re.sub(r"`[^`]*`", lambda m: " " * len(m.group()), text_)
    for kind, rx in _INLINE:
        for m in rx.finditer(plain):
            words = next(g for g in m.groups() if g is not None)
            at = line + plain.count("\n", 0, m.start())
            if kind in ("link", "image"):
                out.append(Element(kind, words, m.group(2), at, at, {"title": m.group(3)} if kind == "link" and m.group(3) else {}))
            else:
                out.append(Element(kind, None, words, at, at))
    return out


@parser("markdown")
def markdown(source: str) -> list[Element]:
    """Blocks and the inline elements within, in a flat list, inner before outer."""
    out: list[Element] = []
    lines = source.split("\n")
    i = 0
    while i < len(lines):
        line = lines[i]
        n = i + 1
        if m := re.match(r"^ {0,3}(```+|~~~+)\s*(\S*)", line):
            j = i + 1
            while j < len(lines) and not re.match(rf"^ {{0,3}}{re.escape(m[1])}", lines[j]):
                j += 1
            out.append(Element("code_block", m[2] or None, "\n".join(lines[i + 1 : j]), n, min(j + 1, len(lines)), {"language": m[2]} if m[2] else {}))
            i = j + 1
        elif m := re.match(r"^ {0,3}(#{1,6})\s+(.*?)\s*#*\s*$", line):
            out += [*_inline(m[2], n), Element("header", m[2], m[2], n, n, {"level": len(m[1])})]
            i += 1
        elif re.match(r"^ {0,3}([-*_])(?:\s*\1){2,}\s*$", line):
            out.append(Element("horizontal_rule", None, line, n, n))
            i += 1
        elif m := re.match(r"^\[\^([^\]]+)\]:\s*(.*)", line):
            out.append(Element("footnote_definition", m[1], m[2], n, n))
            i += 1
        elif line.lstrip().startswith(">"):
            j = i
            while j < len(lines) and lines[j].lstrip().startswith(">"):
                j += 1
            body = "\n".join(re.sub(r"^\s*> ?", "", x) for x in lines[i:j])
            out += [*_inline(body, n), Element("blockquote", None, body, n, j)]
            i = j
        elif re.match(r"^\s*(?:[-*+]|\d+[.)])\s+", line):
            j, items = i, []
            while j < len(lines) and (lines[j].strip() and (re.match(r"^\s*(?:[-*+]|\d+[.)])\s+", lines[j]) or lines[j][:1] in " \t")):
                if m := re.match(r"^\s*(?:[-*+]|\d+[.)])\s+(?:\[([ xX])\]\s+)?(.*)", lines[j]):
                    attributes = {"task": True, "checked": m[1] != " "} if m[1] else {}
                    items += [*_inline(m[2], j + 1), Element("list_item", None, m[2], j + 1, j + 1, attributes)]
                j += 1
            out += [*items, Element("list", None, "\n".join(lines[i:j]), n, j, {"ordered": bool(re.match(r"^\s*\d", line))})]
            i = j
        elif "|" in line and i + 1 < len(lines) and re.match(r"^\s*\|?\s*:?-+:?\s*(\|\s*:?-+:?\s*)*\|?\s*$", lines[i + 1]):
            j = i
            while j < len(lines) and "|" in lines[j]:
                j += 1
            out.append(Element("table", None, "\n".join(lines[i:j]), n, j))
            i = j
        elif line.startswith("    ") and line.strip():
            j = i
            while j < len(lines) and (lines[j].startswith("    ") or not lines[j].strip()):
                j += 1
            out.append(Element("code_block", None, "\n".join(x[4:] for x in lines[i:j]).rstrip(), n, j, {"language": "indented"}))
            i = j
        elif line.strip():
            j = i
            while j < len(lines) and lines[j].strip() and not re.match(r"^ {0,3}(?:#{1,6}\s|```|~~~|>)", lines[j]):
                j += 1
            j = max(j, i + 1)
            body = "\n".join(lines[i:j])
            out += [*_inline(body, n), Element("paragraph", None, body, n, j)]
            i = j
        else:
            i += 1
    return out
