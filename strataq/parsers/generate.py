"""Element trees back to source: JSON, TOML of one level, and languages whose elements hold their text."""

from __future__ import annotations

import json

from .tree import Element


def _value(e: Element):
    if e.type == "variable":
        return json.loads(e.content)
    if e.children and all((c.name or "").startswith("[") for c in e.children):
        return [_value(c) for c in e.children]
    return {c.name or "": _value(c) for c in e.children} if e.children else json.loads(e.content or "null")


def to_json(elements: list[Element], indent: int | None = 2) -> str:
    """The value that was parsed; a root that is no object is the element `value`."""
    if elements and all((e.name or "").startswith("[") for e in elements):
        return json.dumps([_value(e) for e in elements], ensure_ascii=False, indent=indent)
    if len(elements) == 1 and elements[0].name == "value" and elements[0].type == "variable":
        return json.dumps(_value(elements[0]), ensure_ascii=False, indent=indent)
    return json.dumps({e.name or "": _value(e) for e in elements}, ensure_ascii=False, indent=indent)


def _toml(v) -> str:
    if isinstance(v, dict):
        return "{ " + ", ".join(f"{_key(k)} = {_toml(x)}" for k, x in v.items()) + " }"
    if isinstance(v, list):
        return "[" + ", ".join(map(_toml, v)) + "]"
    return json.dumps(v, ensure_ascii=False)


def _key(k: str) -> str:
    return k if k and all(c.isalnum() or c in "-_" for c in k) else json.dumps(k)


def to_toml(elements: list[Element]) -> str:
    """Entries of the root, then a table per block; what lies deeper stands inline."""
    top, tables = [], []
    for e in elements:
        value = _value(e)
        if e.type == "block" and isinstance(value, dict):
            name = (e.name or "").split("[")[0]
            head = f"[[{_key(name)}]]" if (e.name or "").endswith("]") else f"[{_key(name)}]"
            tables.append("\n".join([head, *(f"{_key(k)} = {_toml(x)}" for k, x in value.items())]))
        else:
            top.append(f"{_key(e.name or '')} = {_toml(value)}")
    return "\n\n".join(x for x in ("\n".join(top), *tables) if x) + "\n"


def to_source(elements: list[Element]) -> str:
    """The contents of the elements, one after another."""
    return "\n\n".join(e.content for e in elements) + ("\n" if elements else "")


GENERATORS = {"json": to_json, "toml": to_toml, "rust": to_source}


def generate(elements: list[Element], file_type: str) -> str:
    if file_type not in GENERATORS:
        raise ValueError(f"sources are made for {sorted(GENERATORS)}")
    return GENERATORS[file_type](elements)
