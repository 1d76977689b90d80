"""Functions that every jq query may use: normalisers to canonical records, and renderers of those.

Each takes a JSON value (and argument values) and returns its outputs.
"""

from __future__ import annotations

import re
import time
from collections.abc import Callable
from datetime import UTC, datetime

FUNCTIONS: dict[str, Callable[..., list]] = {}


def jq(f: Callable[..., list]) -> Callable[..., list]:
    arity = f.__code__.co_argcount - 1
    FUNCTIONS[f"{f.__name__.lstrip('_')}/{arity}"] = f
    return f


def _or(v, other):
    """`v // other`: only null and false give way, 0 and empty texts stay."""
    return other if v is None or v is False else v


def _iso(at: float) -> str:
    return datetime.fromtimestamp(at, UTC).strftime("%Y-%m-%dT%H:%M:%SZ")


def _each(v, one: Callable) -> str:
    return "\n".join(map(one, v)) if isinstance(v, list) else one(v)


# ---- normalisers ----------------------------------------------------------------------------------------------------

ACCESS_LINE = re.compile(
    r'^(?P<addr>\S+) \S+ (?P<user>\S+) \[(?P<time>.*?)\] "(?P<method>\S+) (?P<uri>\S+) (?P<protocol>\S+)" (?P<status>\d+) (?P<bytes>\d+)(?: "(?P<referer>[^"]*)" "(?P<agent>[^"]*)")?'
)


@jq
def nginx_to_log(v) -> list:
    """A log record of an access line; its time's offset is ignored.  Any other line has no output."""
    m = ACCESS_LINE.search(v) if isinstance(v, str) else None
    if not m:
        return []
    try:
        at = datetime.strptime(m["time"].split(" ")[0], "%d/%b/%Y:%H:%M:%S").replace(tzinfo=UTC).timestamp()
    except ValueError:
        at = time.time()
    status = int(m["status"])
    level = "ERROR" if status >= 500 else "WARN" if status >= 400 else "INFO"
    data = {"remote_addr": m["addr"], "remote_user": m["user"], "body_bytes": int(m["bytes"]), "referer": m["referer"], "user_agent": m["agent"], "raw_time": m["time"]}
    return [{"timestamp": _iso(at), "level": level, "message": f"{m['method']} {m['uri']} {m['status']}", "source": "nginx", "data": data}]


@jq
def journald_to_log(v) -> list:
    return [v]


@jq
def github_to_task(v) -> list:
    return [v]


@jq
def task_format(v) -> list:
    return [v]


@jq
def todo_to_task(v) -> list:
    m = re.search(r"TODO:\s*(.*?)\s*(?:priority:(\w+))?$", v) if isinstance(v, str) else None
    if not m:
        return []
    now = time.time()
    return [{"element_type": "task", "id": f"task_{now}", "title": m[1], "status": "open", "priority": m[2] or "medium", "assignee": None, "tags": ["todo"], "metadata": {"source": "todo_comment", "created": _iso(now)}}]


_MARK = re.compile(r"(?P<symbol>//|#|--|/\*|^\s*\*)\s*(?P<tag>TODO|FIXME|OPTIMIZE|XXX):?\s*(?P<message>.*)$")
_URGENT = re.compile("bug|leak|crash|urgent", re.I)


def comment_tasks(text: str) -> list[dict]:
    out = []
    for line in text.split("\n"):
        if not (m := _MARK.search(line)):
            continue
        tag, message = m["tag"], m["message"]
        priority = "high" if tag == "FIXME" or _URGENT.search(message) else "low" if tag == "OPTIMIZE" else "medium"
        out.append(
            {
                "element_type": "task", "id": f"task_{sum(map(ord, message))}", "title": re.sub(r"\s*\*/$", "", message), "status": "open", "priority": priority,
                "tags": ["todo", tag.lower()], "metadata": {"source": "source_code", "comment_style": m["symbol"], "created": _iso(time.time())},
            }
        )
    return out


@jq
def src_to_task(v) -> list:
    return comment_tasks(v) if isinstance(v, str) else []


_ENTITIES = (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#x27;", "'"), ("&#x60;", "`"))


def decode_html(text: str) -> str:
    """`&amp;` first, so a doubly encoded mark decodes twice."""
    for a, b in _ENTITIES:
        text = text.replace(a, b)
    return text


def _conversation(v: dict) -> dict:
    def message(m: dict) -> dict:
        content = m.get("content")
        return {"role": _or(m.get("role"), "unknown"), "content": decode_html("".join(content) if isinstance(content, list) else content or ""), "timestamp": _or(m.get("timestamp"), None), "name": _or(m.get("name"), None), "x-source": "openwebui"}

    return {"meta": {"schema_version": "v1", "normalizer": "openwebui_chat", "original_id": _or(v.get("id"), None), "title": _or(v.get("title"), None)}, "messages": [message(m) for m in v["chat"]["messages"]]}


@jq
def openwebui_conversation_to_chat(v) -> list:
    return [_conversation(v)]


@jq
def openwebui_to_chat(v) -> list:
    return [[_conversation(x) for x in v] if isinstance(v, list) else _conversation(v)]


@jq
def cargo_to_artifact(v) -> list:
    if v.get("reason") != "compiler-message":
        return []
    m = _or(v.get("message"), {})
    level = m.get("level")
    at = next(iter(_or(m.get("spans"), [])), None) or {}
    place = {"file": at.get("file_name"), "line": at.get("line_start"), "column": at.get("column_start"), "end_line": at.get("line_end"), "end_column": at.get("column_end")}
    kinds = {"error": "BUILD_ERROR", "warning": "COMPILATION_WARNING"}
    return [{"type": kinds.get(level, "INFO"), "source": "cargo", "status": "FAILURE" if level == "error" else "WARNING", "summary": m.get("message"), "details": m.get("rendered"), "location": place, "check_name": (_or(m.get("code"), {})).get("code")}]


_CHANGES = {"M": "MODIFIED", "A": "ADDED", "D": "DELETED", "R": "RENAMED"}


@jq
def git_status_to_diff(v) -> list:
    return [{"file": v.get("file"), "change_type": _CHANGES.get(v.get("status"), "UNKNOWN"), "additions": 0, "deletions": 0}]


@jq
def auto_normalize(v) -> list:
    """Known shapes normalised, anything else as it is."""
    if isinstance(v, list):
        return [[y for x in v for y in auto_normalize(x)]]
    if not isinstance(v, dict):
        return [v]
    if {"remote_addr", "request"} <= v.keys():
        return nginx_to_log(v)
    if {"number", "title", "state"} <= v.keys() or "__REALTIME_TIMESTAMP" in v:
        return [v]
    if v.get("reason") == "compiler-message":
        return cargo_to_artifact(v)
    return openwebui_to_chat(v) if v.get("x-source") == "openwebui" else [v]


# ---- graphs ---------------------------------------------------------------------------------------------------------

_FIELDS = {"functions": "function", "structs": "structure", "classes": "class", "interfaces": "interface", "enums": "enumeration", "traits": "trait", "modules": "module", "module": "module", "impls": "implementation", "implementations": "implementation"}
BONES = {"file", "module", "class", "structure", "interface"}


def _graph(doc: dict) -> dict:
    path = (_or(doc.get("metadata"), {})).get("path") or "unknown"
    found = [(kind, e) for field, kind in _FIELDS.items() for e in doc.get(field) or []]
    nodes = {path: {"label": path, "metadata": {"type": "file"}}}
    edges = []
    for kind, e in found:
        key = f"{path}::{_or(e.get('name'), 'anon')}"
        nodes[key] = {"label": _or(e.get("name"), kind), "metadata": {"type": kind, "path": path, "line_start": e.get("line_start"), "line_end": e.get("line_end"), "visibility": (_or(e.get("attributes"), {})).get("visibility") or "private"}}
        edges.append({"source": key, "target": path, "relation": "child-of"})
    edges += [{"source": path, "target": _or(e.get("name"), "unknown"), "relation": "imports"} for e in _or(doc.get("imports"), [])]
    return {"id": path, "nodes": nodes, "edges": edges}


@jq
def src_to_graph(v) -> list:
    """Nodes and edges of one parsed file, or of all files of an array as one graph."""
    if not isinstance(v, list):
        return [{"graphs": [_graph(v)]}]
    nodes, edges = {}, []
    for g in map(_graph, v):
        nodes |= g["nodes"]
        edges += g["edges"]
    return [{"graphs": [{"id": "project-graph", "label": "Project Architecture Map", "directed": True, "nodes": nodes, "edges": edges}]}]


@jq
def graph_to_architecture(v) -> list:
    out = []
    for g in v["graphs"]:
        nodes = {k: n for k, n in g["nodes"].items() if n["metadata"]["type"] in BONES}
        out.append({"id": g.get("id"), "label": g.get("label"), "directed": g.get("directed"), "nodes": nodes, "edges": [e for e in g["edges"] if e["source"] in nodes and e["target"] in nodes]})
    return [{"graphs": out}]


@jq
def src_to_architecture(v) -> list:
    return graph_to_architecture(src_to_graph(v)[0])


# ---- renderers ------------------------------------------------------------------------------------------------------


def _safe(name: str) -> str:
    return re.sub("[^a-zA-Z0-9]", "_", name)


@jq
def graph_format(v) -> list:
    out = []
    for g in v["graphs"]:
        nodes = "\n".join(f"- **{k}** ({_or(n['metadata'].get('type'), 'node')})" for k, n in sorted(g["nodes"].items()))
        edges = "\n".join(f"- {e['source']} --[{e['relation']}]--> {e['target']}" for e in g["edges"])
        out.append(f"# Graph: {_or(g.get('label'), g.get('id'))}\n\n## Nodes\n{nodes}\n\n## Relationships\n{edges}\n")
    return out


@jq
def graph_format_mermaid(v) -> list:
    out = []
    for g in v["graphs"]:
        lines = ["graph TD", *(f'  {_safe(k)}["{_or(n.get("label"), k)}"]' for k, n in sorted(g["nodes"].items()))]
        lines += [f"  {_safe(e['source'])} -- {_or(e.get('relation'), 'related')} --> {_safe(e['target'])}" for e in g["edges"]]
        out.append("\n".join(lines) + "\n")
    return out


@jq
def architecture_format(v) -> list:
    return [f"# Architecture: {_or(g.get('label'), 'System')}\n\n" + "\n".join(f"- {n['label']}" for _, n in sorted(g["nodes"].items())) for g in v["graphs"]]


@jq
def architecture_format_mermaid(v) -> list:
    """Nodes in one subgraph per first segment of their path."""
    out = []
    for g in v["graphs"]:
        groups: dict[str, list[str]] = {}
        for k, n in sorted(g["nodes"].items()):
            top = re.sub(r"^\./", "", n["metadata"].get("path") or _or(n.get("label"), "root")).split("/")[0]
            label = n["label"].replace('"', "'")
            kind = n["metadata"]["type"]
            style = {"file": ":::file", "module": ":::module", "class": ":::object", "structure": ":::object"}.get(kind, "")
            groups.setdefault(top, []).append(f'    {_safe(k)}["{label}"]{style}')
        parts = [f"  subgraph {_safe(top)} [{top}]\n" + "\n".join(lines) + "\n  end" for top, lines in sorted(groups.items())]
        edges = "\n".join(f"  {_safe(e['source'])} -.-> {_safe(e['target'])}" for e in g["edges"])
        out.append("graph TD\n" + "\n\n".join(parts) + "\n" + edges)
    return out


def _log(v: dict) -> str:
    return f"[{_or(v.get('timestamp'), 'timestamp?')}] **{_or(v.get('level'), 'INFO')}** ({_or(v.get('source'), 'source?')}): {_or(v.get('message'), 'no message')}"


def _artifact(v: dict) -> str:
    sign = {"FAILURE": "❌", "WARNING": "⚠️"}.get(v.get("status"), "ℹ️")
    at = _or(v.get("location"), {})
    details = f"  Details: {v['details']}" if v.get("details") else ""
    return f"{sign} **{_or(v.get('type'), 'Artifact')}**: {_or(v.get('summary'), 'No summary')}\n  Location: {_or(at.get('file'), '?')}:{_or(at.get('line'), '?')}\n{details}"


def _diff(v: dict) -> str:
    head = f"### {_or(v.get('file'), 'unknown')} ({_or(v.get('change_type'), 'UNKNOWN')})\n```diff\n"
    return "\n".join(head + x + "\n```" for x in [h["content"] for h in _or(v.get("hunks"), []) if h.get("content")] or [""])


@jq
def log_format(v) -> list:
    return [_each(v, _log)]


@jq
def artifact_format(v) -> list:
    return [_each(v, _artifact)]


@jq
def diff_format(v) -> list:
    return [_each(v, _diff)]


def _message(m: dict) -> str:
    name = f" ({m['name']})" if m.get("name") else ""
    at = f" - {m['timestamp']}" if m.get("timestamp") else ""
    return f"### {_or(m.get('role'), 'unknown')}{name}{at}\n{_or(m.get('content'), '')}\n\n---\n"


@jq
def chat_format(v) -> list:
    if isinstance(v, dict) and v.get("messages"):
        meta = v.get("meta")
        head = f"> **Schema**: {_or(meta.get('schema_version'), '?')} | **Normalizer**: {_or(meta.get('normalizer'), '?')}\n\n" if meta else ""
        return [head + "\n".join(map(_message, v["messages"]))]
    return ["\n".join(map(_message, v))]


@jq
def chat_filter_role(v, role) -> list:
    return [[m for m in v if m.get("role") == role]]


@jq
def chat_search(v, pattern) -> list:
    return [[m for m in v if pattern in m["content"]]]


@jq
def chat_tail(v, n) -> list:
    return [v[-n:] if n else v]


@jq
def chat_head(v, n) -> list:
    return [v[:n]]


_SECTIONS = ["modules", "module", "imports", "structs", "enums", "traits", "classes", "interfaces", "implementations", "functions"]


@jq
def markdown(v) -> list:
    """Documentation of a parsed file: a heading per kind, its elements with signature and comment, children below them."""

    def element(e: dict, depth: int) -> list[str]:
        a = _or(e.get("attributes"), {})
        out = [f"{'#' * min(6, depth)} {e.get('name') or _or(e.get('type'), 'element')}", ""]
        if a.get("signature"):
            out += ["```", a["signature"], "```", ""]
        if a.get("docstring"):
            out += [a["docstring"], ""]
        for child in _or(e.get("children"), []):
            out += element(child, depth + 1)
        return out

    lines = [f"# {(v.get('metadata') or {}).get('path') or 'unknown'}", ""]
    rank = {k: i for i, k in enumerate(_SECTIONS)}
    for field in sorted((k for k, x in v.items() if isinstance(x, list) and k not in ("elements", "file_type")), key=lambda k: (rank.get(k, 99), k)):
        own = [e for e in v[field] if isinstance(e, dict) and not (_or(e.get("attributes"), {})).get("crumbtrail")]
        if own:
            lines += [f"## {field.replace('_', ' ').title()}", ""]
            for e in own:
                lines += element(e, 3)
    return ["\n".join(lines)]
