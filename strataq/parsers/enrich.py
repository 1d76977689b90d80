"""Markdown within HTML elements, as children of them."""

from __future__ import annotations

import re

from .markup import markdown
from .tree import Element

MOST_DEPTH, HEAD = 10, 2048
_SIGNS = [re.compile(x, re.M) for x in (r"^#{1,6} \S", r"^\s*[-*+] \S", r"^```", r"\[[^\]]+\]\([^)]+\)", r"^\s*\d+\. \S", r"\*\*[^*]+\*\*", r"^> \S")]


def is_markdown(e: Element, least: int = 2) -> bool:
    """By class, lang, language or type; else by at least `least` kinds of signs among the first bytes and no tag."""
    for k in ("class", "lang", "language", "type"):
        if {"markdown", "md", "text/markdown"} & set(str(e.attributes.get(k) or "").lower().replace("language-", "").split()):
            return True
    head = e.content.encode()[:HEAD].decode("utf-8", "ignore")
    return not re.search(r"</?[a-zA-Z][^>]*>", head) and sum(bool(x.search(head)) for x in _SIGNS) >= least


def enrich(elements: list[Element], depth: int = 0) -> list[Element]:
    """`elements` with the Markdown elements of those that hold Markdown, at the lines of the document."""
    if depth >= MOST_DEPTH:
        return elements
    for e in elements:
        if e.type != "element":
            continue
        if not e.children and is_markdown(e):
            for x in markdown(e.content):
                x.line_start, x.line_end = x.line_start + e.line_start - 1, x.line_end + e.line_start - 1
                e.children.append(x)
        else:
            enrich(e.children, depth + 1)
    return elements
