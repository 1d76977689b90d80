"""How results are shown: JSON, grep lines and a table for people."""

from __future__ import annotations

import json
import os
import sys

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FORMATS = ("json", "grep", "human")


def grep_line(path: Column, line: Column, content: Column) -> Column:
    """`path:line:first line of the content`."""
    return F.concat_ws(":", F.coalesce(path, F.lit("unknown")), F.coalesce(line, F.lit(1)).cast("string"), F.split(F.coalesce(content, F.lit("")), "\n", 2)[0])


def json_line(df: DataFrame) -> Column:
    """A row as compact JSON text, nulls shown."""
    return F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"})


def format_results(values: list, how: str = "json", compact: bool = False, raw: bool = False, path: str = "", template: str | None = None) -> str:
    """jq outputs as text.  json: one value a block, with `raw` texts as they are; grep: a line per element, or `template` with
    {path}, {line}, {name} and {content}; human: a table of the first level."""
    if how not in FORMATS:
        raise ValueError(f"a format is one of {FORMATS}")
    if how == "json":
        return "\n".join(v if raw and isinstance(v, str) else json.dumps(v, ensure_ascii=False, **({"separators": (",", ":")} if compact else {"indent": 2})) for v in values)
    rows = [x for v in values for x in (v if isinstance(v, list) else [v])]
    if how == "grep":
        out = []
        for x in rows:
            e = x if isinstance(x, dict) else {"content": x if isinstance(x, str) else json.dumps(x, ensure_ascii=False)}
            first = str(e.get("content") or e.get("name") or "").split("\n")[0]
            at = (e.get("attributes") or {}).get("file_path") or path or "unknown"
            line = e.get("line_start") or 1
            out.append(template.format(path=at, line=line, name=e.get("name") or "", content=first) if template else f"{at}:{line}:{first}")
        return "\n".join(out)
    if not all(isinstance(x, dict) for x in rows):
        return "\n".join(x if isinstance(x, str) else json.dumps(x, ensure_ascii=False) for x in rows)
    names = list(dict.fromkeys(k for x in rows for k, v in x.items() if not isinstance(v, list | dict)))
    cells = [[_cell(x.get(k)) for k in names] for x in rows]
    width = [max(map(len, (n, *(c[i] for c in cells)))) for i, n in enumerate(names)]
    line = lambda c: "  ".join(x.ljust(w) for x, w in zip(c, width)).rstrip()
    return "\n".join([line(names), line(["-" * w for w in width]), *map(line, cells)]) if names else ""


def _cell(v, most: int = 60) -> str:
    text = "" if v is None else v if isinstance(v, str) else json.dumps(v, ensure_ascii=False)
    text = text.split("\n")[0]
    return text if len(text) <= most else text[: most - 1] + "…"


def chosen_format(asked: str | None = None, stream=None) -> str:
    """The format asked for; else that of STRATAQ_FORMAT; else a table for a terminal and JSON for anything else."""
    found = asked or os.environ.get("STRATAQ_FORMAT")
    if found:
        if found not in FORMATS:
            raise ValueError(f"a format is one of {FORMATS}")
        return found
    out = stream or sys.stdout
    return "human" if getattr(out, "isatty", lambda: False)() and not os.environ.get("CI") else "json"


def with_file_path(value, path: str):
    """`value` with attributes.file_path on every object that has a type, kind or element_type."""
    if isinstance(value, list):
        return [with_file_path(x, path) for x in value]
    if not isinstance(value, dict):
        return value
    out = {k: with_file_path(v, path) for k, v in value.items() if k != "attributes"}
    if {"type", "kind", "element_type"} & value.keys():
        own = value.get("attributes")
        out["attributes"] = {**(own if isinstance(own, dict) else {}), "file_path": path}
    elif "attributes" in value:
        out["attributes"] = value["attributes"]
    return out
