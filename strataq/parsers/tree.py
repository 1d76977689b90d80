"""Element trees, their unified JSON and their flat table."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

URL_NAMESPACE = uuid.NAMESPACE_URL


@dataclass
class Element:
    type: str
    name: str | None
    content: str
    line_start: int
    line_end: int
    attributes: dict = field(default_factory=dict)
    children: list[Element] = field(default_factory=list)

    def walk(self) -> Iterator[tuple[Element, int, tuple[str, ...]]]:
        """The element and all below it in reading order, with their depth and trail; trees may be of any depth."""
        todo: list[tuple[Element, int, tuple[str, ...]]] = [(self, 0, ())]
        while todo:
            e, depth, trail = todo.pop()
            yield e, depth, trail
            if e.children:
                inner = (*trail, e.name or e.type)
                todo += [(c, depth + 1, inner) for c in reversed(e.children)]


#: Field of the unified JSON per element type; * in REQUIRED: present even when empty.
FIELDS: dict[str, dict[str, str]] = {
    "rust": {"function": "functions", "struct": "structs", "enum": "enums", "trait": "traits", "implementation": "implementations", "import": "imports"},
    "python": {"class": "classes", "function": "functions", "import": "imports", "decorator": "decorators"},
    "markdown": {"header": "headers", "code_block": "code_blocks", "link": "links", "table": "tables", "list": "lists", "list_item": "list_items", "emphasis": "emphasis", "strong": "strong", "strikethrough": "strikethrough", "footnote_definition": "footnotes"},
    "c": {"function": "functions", "struct": "structs", "import": "imports", "macro": "macros"},
    "cpp": {"function": "functions", "class": "classes", "namespace": "namespaces", "import": "imports"},
    "cuda": {"kernel": "kernels", "device_function": "device_functions", "function": "host_functions", "import": "imports"},
    "go": {"function": "functions", "struct": "structs", "interface": "interfaces", "package": "package", "import": "imports"},
    "bash": {"function": "functions", "variable": "variables"}, "text": {"block": "blocks"}, "toml": {"block": "tables", "variable": "entries"}, "html": {"element": "elements"}, "json": {},
}
REQUIRED: dict[str, list[str]] = {
    "rust": ["functions", "structs", "enums"], "python": ["classes", "functions", "imports"], "markdown": ["headers", "code_blocks", "links"], "c": ["functions", "structs"], "cpp": ["functions", "classes", "namespaces"],
    "cuda": ["kernels", "device_functions", "host_functions"], "go": ["functions", "structs", "interfaces"], "bash": ["functions", "variables"], "text": ["blocks"], "toml": ["tables", "entries"], "html": ["elements"], "json": [],
}
_PARSERS: dict[str, Callable[[str], list[Element]]] = {}


def parser(*kinds: str):
    def add(f: Callable[[str], list[Element]]):
        for k in kinds:
            _PARSERS[k] = f
        return f

    return add


def parse(text: str, file_type: str) -> list[Element]:
    """The elements of a text; an unknown type or a text its parser can't read is one block."""
    from . import code, markup  # noqa: F401  they register themselves

    try:
        return _PARSERS[file_type](text)
    except (KeyError, ValueError, SyntaxError, RecursionError):
        return _PARSERS["text"](text)


def _shown(e: Element, trail: tuple[str, ...], deep: bool) -> dict:
    out = {"type": e.type, "name": e.name, "content": e.content, "line_start": e.line_start, "line_end": e.line_end}
    attributes = dict(e.attributes) | ({"crumbtrail": "::".join(trail)} if trail else {})
    if attributes:
        out["attributes"] = attributes
    if deep and e.children:
        out["children"] = [_shown(c, (), False) for c in e.children]
    return out


def convert(elements: list[Element], file_type: str, path: str = "", text: str = "") -> dict:
    """Unified JSON: elements grouped by field; children also stand in the top lists, before their parent, with a trail."""
    fields = FIELDS.get(file_type, {})
    out: dict = {"metadata": {"path": path, "file_type": file_type, "size": len(text.encode()), "line_count": len(text.splitlines())}}
    out |= {k: [] for k in (*REQUIRED.get(file_type, []), "elements", "file_type")}

    todo: list[tuple[Element, tuple[str, ...], bool]] = [(e, (), False) for e in reversed(elements)]
    while todo:
        e, trail, over = todo.pop()
        if e.children and not over:
            inner = (*trail, e.name or e.type)
            todo += [(e, trail, True), *((c, inner, False) for c in reversed(e.children))]
        else:
            out.setdefault(fields.get(e.type, e.type), []).append(_shown(e, trail, True))
    return out


def chunks_of(elements: list[Element], doc: str, least_cover: float | None = 0.9, by_line: bool = False, ids: bool = True) -> list[dict]:
    """Rows to embed: content with its trail and visibility, `intent` from the comment, id by content, or with `by_line` by the
    first line and trail; without `ids` the id is None.

    Without `least_cover` all elements stay.  Containers that their children cover by more than `least_cover` go, unless they are documented or a function, class,
    struct, interface or trait.
    """
    out = []
    for top in elements:
        for e, _, trail in top.walk():
            spared = e.type in ("function", "method", "class", "struct", "interface", "trait") or e.attributes.get("docstring")
            if least_cover is not None and e.children and not spared and sum(len(c.content.encode()) for c in e.children) > least_cover * len(e.content.encode()):
                continue
            where = "::".join((*trail, e.name or e.type))
            key = f"{doc}::{e.line_start}::{where}" if by_line or not ids else f"{doc}::{where}::{hashlib.sha256(e.content.encode()).hexdigest()}"
            out.append({"id": str(uuid.uuid5(URL_NAMESPACE, key)) if ids else None, "content": e.content, "crumbtrail": where, "type": e.type, "line_start": e.line_start, "line_end": e.line_end, "intent": e.attributes.get("docstring"), "visibility": e.attributes.get("visibility")})
    return out


ELEMENTS = "elem_id int, parent_id int, depth int, ordinal int, path array<string>, type string, name string, content string, line_start int, line_end int, attributes string"
#: A column's Arrow type and its value for (element, number, parent's number, depth, ordinal, trail).
_COLUMNS: dict[str, tuple[pa.DataType, Callable]] = {
    "elem_id": (pa.int32(), lambda x: x[1]), "parent_id": (pa.int32(), lambda x: x[2]), "depth": (pa.int32(), lambda x: x[3]), "ordinal": (pa.int32(), lambda x: x[4]), "path": (pa.list_(pa.string()), lambda x: [*x[5], x[0].name or x[0].type]),
    "type": (pa.string(), lambda x: x[0].type), "name": (pa.string(), lambda x: x[0].name), "content": (pa.string(), lambda x: x[0].content), "line_start": (pa.int32(), lambda x: x[0].line_start), "line_end": (pa.int32(), lambda x: x[0].line_end),
    "attributes": (pa.string(), lambda x: json.dumps(x[0].attributes, sort_keys=True)),
}
BATCH_ROWS, BATCH_CHARS = 20_000, 4 << 20


def _numbered(elements: list[Element], trails: bool) -> Iterator[tuple]:
    """(element, number, parent's number, depth, ordinal, trail) in reading order."""
    n, todo = 0, [(e, None, 0, i, ()) for i, e in reversed(list(enumerate(elements)))]
    while todo:
        e, parent, depth, ordinal, trail = todo.pop()
        yield e, n, parent, depth, ordinal, trail
        if e.children:
            inner = (*trail, e.name or e.type) if trails else ()
            todo += [(c, n, depth + 1, i, inner) for i, c in reversed(list(enumerate(e.children)))]
        n += 1


def element_table(docs: DataFrame, id_col: str, text_col: str, type_col: str, columns: list[str] | None = None) -> DataFrame:
    """The elements of every document as rows, numbered in reading order; attributes as JSON text.  Of the columns beside doc
    only those of `columns` are made, all of them without it."""
    wanted = [c for c in _COLUMNS if columns is None or c in columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds, makers = [_COLUMNS[c][0] for c in wanted], [_COLUMNS[c][1] for c in wanted]
        sized = [i for i, c in enumerate(wanted) if c in ("content", "path")]
        for batch in batches:
            key = batch.schema.field(0).type
            doc, made, chars = [], [[] for _ in wanted], 0
            for k, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                for x in _numbered(parse(text or "", kind or "text"), "path" in wanted):
                    doc.append(k)
                    for out, maker in zip(made, makers):
                        out.append(maker(x))
                    for i in sized:
                        chars += len(made[i][-1])
                    if len(doc) == BATCH_ROWS or chars > BATCH_CHARS:
                        yield pa.RecordBatch.from_arrays([pa.array(doc, key), *map(pa.array, made, kinds)], names=["doc", *wanted])
                        doc, made, chars = [], [[] for _ in wanted], 0
            yield pa.RecordBatch.from_arrays([pa.array(doc, key), *map(pa.array, made, kinds)], names=["doc", *wanted])

    kept = [x for x in ELEMENTS.split(", ") if x.split()[0] in wanted]
    return docs.select(id_col, text_col, type_col).mapInArrow(run, ", ".join([f"doc {dict(docs.dtypes)[id_col]}", *kept]))


def unified_table(docs: DataFrame, id_col: str, text_col: str, type_col: str, path_col: str | None = None) -> DataFrame:
    """id, json: the unified JSON of every document, which jq queries take; a null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            paths = pdf[path_col] if path_col else [""] * len(pdf)
            made = (json.dumps(convert(parse(t or "", k or "text"), k or "text", p or "", t or ""), ensure_ascii=False, default=str) for t, k, p in zip(pdf[text_col], pdf[type_col], paths))
            yield pd.DataFrame({id_col: pdf[id_col], "json": list(made)})

    cols = dict.fromkeys([id_col, text_col, type_col, *([path_col] if path_col else [])])
    return docs.select(*cols).mapInPandas(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, json string")


CHUNKS = "id string, content string, crumbtrail string, type string, line_start int, line_end int, intent string, visibility string"


def chunk_table(docs: DataFrame, id_col: str, text_col: str, type_col: str, least_cover: float | None = 0.9, by_line: bool = False, columns: list[str] | None = None) -> DataFrame:
    """doc and the rows of `chunks_of` of every document.  Of the columns beside doc only those of `columns` are made, all of
    them without it."""
    kept = [x for x in CHUNKS.split(", ") if columns is None or x.split()[0] in columns]
    wanted = [x.split()[0] for x in kept]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.schema.field(0).type
            doc, made, chars = [], [[] for _ in wanted], 0
            for k, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                found = chunks_of(parse(text or "", kind or "text"), str(k), least_cover, by_line, "id" in wanted)
                doc += [k] * len(found)
                for out, name in zip(made, wanted):
                    out += [c[name] for c in found]
                chars += sum(len(c["content"]) for c in found) if "content" in wanted else 0
                if len(doc) >= BATCH_ROWS or chars > BATCH_CHARS:
                    yield pa.RecordBatch.from_arrays([pa.array(doc, key), *map(pa.array, made, kinds)], names=["doc", *wanted])
                    doc, made, chars = [], [[] for _ in wanted], 0
            yield pa.RecordBatch.from_arrays([pa.array(doc, key), *map(pa.array, made, kinds)], names=["doc", *wanted])

    return docs.select(id_col, text_col, type_col).mapInArrow(run, ", ".join([f"doc {dict(docs.dtypes)[id_col]}", *kept]))


def with_context(elements: DataFrame, docs: DataFrame, id_col: str, text_col: str, lines: int) -> DataFrame:
    """`elements` (doc, line_start, line_end, …) with context_start, context_end and the text of those lines: `lines` more before
    and after, as far as there are."""
    all_ = F.split(F.col("__text"), "\n", -1)
    total = F.size(all_) - F.when(F.endswith("__text", F.lit("\n")), 1).otherwise(0)
    # texts may be larger than a plan thinks that makes them: they are never sent whole to every task
    joined = elements.join(docs.select(F.col(id_col).alias("doc"), F.coalesce(text_col, F.lit("")).alias("__text")).hint("merge"), "doc")
    first, last = F.greatest(F.lit(1), F.col("line_start") - lines), F.least(total, F.col("line_end") + lines)
    joined = joined.withColumn("context_start", first.cast("int")).withColumn("context_end", last.cast("int"))
    shown = F.array_join(F.slice(all_, F.col("context_start"), F.greatest(F.lit(0), F.col("context_end") - F.col("context_start") + 1)), "\n")
    return joined.withColumn("context", shown).drop("__text")


USAGES = "symbol_name string, usage_type string, context string, scope string, content string, line_start int, line_end int"
#: What the filters of usages keep.
USAGE_FILTERS = {"all": None, "calls": ("function_call", "method_call"), "references": ("variable_reference", "type_reference"), "assignments": ("assignment",), "methods": ("method_call",)}


def usage_table(docs: DataFrame, id_col: str, text_col: str, type_col: str, keep: str = "all", columns: list[str] | None = None) -> DataFrame:
    """doc and each usage of a symbol in sources of Python, Rust and Go, as the filter `keep` admits; other types and sources
    that can't be read have none.  Of the columns beside doc only those of `columns` are made, all of them without it."""
    from .usages import usages_of

    admitted = USAGE_FILTERS[keep]
    makers = {
        "symbol_name": lambda u: u.attributes["symbol_name"], "usage_type": lambda u: u.attributes["usage_type"], "context": lambda u: u.attributes["context"], "scope": lambda u: u.attributes["scope"],
        "content": lambda u: u.content, "line_start": lambda u: u.line_start, "line_end": lambda u: u.line_end,
    }
    kept = [x for x in USAGES.split(", ") if columns is None or x.split()[0] in columns]
    wanted = [x.split()[0] for x in kept]
    kinds = [pa.int32() if x.endswith(" int") else pa.string() for x in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            key = batch.schema.field(0).type
            doc, made = [], [[] for _ in wanted]
            for k, text, kind in zip(*(c.to_pylist() for c in batch.columns)):
                found = usages_of(text or "", kind or "", "content" in wanted)
                if admitted is not None:
                    found = [u for u in found if u.attributes["usage_type"] in admitted]
                doc += [k] * len(found)
                for out, name in zip(made, wanted):
                    out += map(makers[name], found)
                if len(doc) >= BATCH_ROWS:
                    yield pa.RecordBatch.from_arrays([pa.array(doc, key), *map(pa.array, made, kinds)], names=["doc", *wanted])
                    doc, made = [], [[] for _ in wanted]
            yield pa.RecordBatch.from_arrays([pa.array(doc, key), *map(pa.array, made, kinds)], names=["doc", *wanted])

    return docs.select(id_col, text_col, type_col).mapInArrow(run, ", ".join([f"doc {dict(docs.dtypes)[id_col]}", *kept]))


def usage_counts(usages: DataFrame) -> DataFrame:
    """usage_type, n, symbols: usages and distinct symbols of each type."""
    return usages.groupBy("usage_type").agg(F.count("*").alias("n"), F.countDistinct("symbol_name").alias("symbols"))
