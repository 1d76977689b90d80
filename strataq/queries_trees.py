"""Registered queries of parsers: sources made of every row of `part`, their elements, trees and chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.spread import spread
from .parsers import element_table
from .parsers import tree
from .plans import jq
from .registry import query, table

# {k}: the row's key; a line that begins with ~ stands as often as p_size % 4 says
_SOURCES = {
    "rust": "use std::io;\n\n/// Doc {k}\npub fn f{k}(a: i32) -> i32 {\n~    let b = a;\n    a\n}\n\nstruct S{k} {\n    x: i32,\n}\n\nimpl S{k} {\n    fn m(&self) {}\n}\n",
    "python": 'import os\nfrom a.b import c as d\n\nclass C{k}(Base):\n    """Doc."""\n\n    def m(self, x: int) -> int:\n        return x\n\nasync def f{k}():\n~    await g()\n    pass\n\nV = {k}\n',
    "go": 'package p{k}\n\nimport (\n\t"fmt"\n\talias "os"\n)\n\ntype T{k} struct {\n\tA int\n}\n\nfunc (t *T{k}) M() {\n~\tx()\n}\n',
    "c": "#include <stdio.h>\n#define MAX{k} 10\n\nstruct S{k} {\n    int a;\n};\n\nint f{k}(int a, char b) {\n~    a++;\n    return a;\n}\n",
    "cpp": "#include <vector>\n\nnamespace n{k} {\nclass C{k} {\n    void m() {\n    }\n};\nint f{k}(int a) {\n~    a++;\n    return a;\n}\n}\n",
    "cuda": "#include <cuda.h>\n\n__global__ void k{k}(float* a) {\n~    a[0] = 1;\n}\n\n__device__ int d{k}(int a) {\n    return a;\n}\n\nint h{k}(int a) {\n    return a;\n}\n",
    "bash": "#!/bin/bash\nV{k}=1\nf{k}() {\n~  echo hi\n  echo\n}\n",
    "toml": 'title = "t{k}"\n\n[owner]\nname = "n"\nage = {k}\n',
    "json": '{"a": {k}, "b": [1, {"c": "x"}]}',
    "text": "one\n~two\nthree",
    "markdown": "# H{k}\n\npara with [l](u) and **s**\n\n- i1\n- i2\n\n```py\n~x\ny\n```\n",
}
# depth, type, name, first line and last line, each with + where the repeated lines come before
_EXPECTED = {
    "rust": "0 import std::io 1 1|0 function f{k} 4 6+|0 struct S{k} 8+ 10+|0 implementation impl_S{k} 12+ 14+|1 function m 13+ 13+",
    "python": "0 import os 1 1|0 import c 2 2|0 class C{k} 4 8|1 function m 7 8|0 function f{k} 10 11+|0 variable V 13+ 13+",
    "go": "0 package p{k} 1 1|0 import fmt 3 6|0 import os 3 6|0 struct T{k} 8 10|0 function M 12 13+",
    "c": "0 import stdio.h 1 1|0 macro MAX{k} 2 2|0 struct S{k} 4 6|1 field a 5 5|0 function f{k} 8 10+",
    "cpp": "0 import vector 1 1|0 namespace n{k} 3 11+|1 class C{k} 4 7|2 function m 5 6|1 function f{k} 8 10+",
    "cuda": "0 import cuda.h 1 1|0 kernel k{k} 3 4+|0 device_function d{k} 6+ 8+|0 function h{k} 10+ 12+",
    "bash": "0 variable V{k} 2 2|0 function f{k} 3 5+",
    "toml": "0 variable title 1 1|0 block owner 3 5|1 variable name 1 1|1 variable age 1 1",
    "json": "0 variable a 1 1|0 block b 1 1|1 variable [0] 1 1|1 block [1] 1 1|2 variable c 1 1",
    "text": "0 block - 1 2+",
    "markdown": "0 link l 3 3|0 strong - 3 3|0 paragraph - 3 3|0 header H{k} 1 1|0 list_item - 5 5|0 list_item - 6 6|0 list - 5 6|0 code_block py 8 10+",
}


def sources(spark, d, kind: str) -> DataFrame:
    """doc, text, kind: a source per row of `part`."""
    out = F.lit("")
    for line in _SOURCES[kind].splitlines(keepends=True):
        own = F.replace(F.lit(line.removeprefix("~")), F.lit("{k}"), F.col("p_partkey").cast("string"))
        out = F.concat(out, F.repeat(own, F.col("p_size") % 4) if line.startswith("~") else own)
    return spread(table(spark, d, "part").select("p_partkey", "p_size")).select(F.col("p_partkey").alias("doc"), out.alias("text"), F.lit(kind).alias("kind"))


def _line(x: str) -> str:
    return f"{x.rstrip('+')}{' + p_size % 4' if x.endswith('+') else ''}"


def _rows(kind: str) -> str:
    out = []
    for e in _EXPECTED[kind].split("|"):
        depth, type_, name, first, last = e.split(" ")
        name = "NULL" if name == "-" else "'" + name.replace("_S", " S").replace("{k}", "' || p_partkey || '") + "'"
        out.append(f"SELECT p_partkey AS doc, {depth}::INT AS depth, '{type_}' AS type, {name} AS name, ({_line(first)})::INT AS line_start, ({_line(last)})::INT AS line_end FROM part")
    return " UNION ALL ".join(out)


def _register(kind: str) -> None:
    @query(_rows(kind), f"parse_{kind}")
    def run(spark, d):
        out = element_table(sources(spark, d, kind), "doc", "text", "kind", ["depth", "type", "name", "line_start", "line_end"])
        return out.select("doc", "depth", "type", F.nullif("name", F.lit("")).alias("name"), "line_start", "line_end")


for _kind in _SOURCES:
    _register(_kind)

_TAG = "<([a-z][a-z0-9]*)(?:[ >])"


@query(f"""SELECT page_id AS doc, name, count(*) AS n FROM (SELECT page_id, unnest(regexp_extract_all(regexp_replace(regexp_replace(html, '<!--.*?-->', '', 'gs'), '<(script|style)>.*?</(script|style)>', '<\\1>', 'gs'), '{_TAG}', 1)) AS name FROM pages) GROUP BY ALL""")
def html_elements(spark, d):
    """Elements by name of every page."""
    p = table(spark, d, "pages").select("page_id", "html", F.lit("html").alias("kind"))
    return element_table(p, "page_id", "html", "kind", ["name"]).groupBy("doc", "name").agg(F.count("*").alias("n"))


@query("SELECT page_id AS doc, unnest(regexp_extract_all(html, '<a href=\"([^\"]*)\"', 1)) AS href FROM pages")
def link_extract(spark, d):
    p = table(spark, d, "pages").select("page_id", "html", F.lit("html").alias("kind"))
    return element_table(p, "page_id", "html", "kind", ["name", "attributes"]).where("name = 'a'").select("doc", F.get_json_object("attributes", "$.href").alias("href"))


@query("""SELECT doc_id AS doc, '1' AS level, 1::BIGINT AS n FROM documents WHERE text IS NOT NULL
 UNION ALL SELECT doc_id, '2', length(text) - length(replace(text, chr(10), '')) FROM documents WHERE contains(text, chr(10))""")
def markdown_elements(spark, d):
    """Every line of every text as a header, the first of level 1."""
    text = F.concat(F.lit("# "), F.replace("text", F.lit("\n"), F.lit("\n## ")))
    p = table(spark, d, "documents").where("text is not null").select("doc_id", text.alias("text"), F.lit("markdown").alias("kind"))
    e = element_table(p, "doc_id", "text", "kind", ["type", "attributes"]).where("type = 'header'")
    return e.groupBy("doc", F.get_json_object("attributes", "$.level").alias("level")).agg(F.count("*").alias("n"))


@query("""SELECT p_partkey AS doc, '["C' || p_partkey || '",["m"],["m","f' || p_partkey || '"],["os","c"],"C' || p_partkey || '",' || (13 + p_size % 4) || ']' AS output FROM part""")
def structural_query(spark, d):
    """Source to unified JSON to jq: classes with their methods, hoisted functions with their trail, counts of lines."""
    j = tree.unified_table(sources(spark, d, "python"), "doc", "text", "kind")
    return jq.query_table(j, "[.classes[0].name, [.classes[0].children[].name], [.functions[].name], [.imports[].name], .functions[0].attributes.crumbtrail, .metadata.line_count]", "doc", "json").select("doc", "output")


@query("""SELECT p_partkey AS doc, 'C' || p_partkey || '::m' AS crumbtrail, 'method of ' || p_partkey AS name FROM part WHERE false
 UNION ALL SELECT p_partkey, 'C' || p_partkey, 'class' FROM part UNION ALL SELECT p_partkey, 'C' || p_partkey || '::m', 'function' FROM part
 UNION ALL SELECT p_partkey, 'f' || p_partkey, 'function' FROM part UNION ALL SELECT p_partkey, 'V', 'variable' FROM part UNION ALL SELECT p_partkey, unnest(['os', 'c']), 'import' FROM part""")
def element_chunks(spark, d):
    """Chunks of elements with their trails."""
    return tree.chunk_table(sources(spark, d, "python"), "doc", "text", "kind", columns=["crumbtrail", "type"]).select("doc", "crumbtrail", F.col("type").alias("name"))


@query("""SELECT p_partkey AS doc, 10 AS line_start, 9::INT AS first, (12 + p_size % 4)::INT AS last, 1 AS before FROM part""")
def element_context(spark, d):
    """A function with one line of context."""
    e = element_table(sources(spark, d, "python"), "doc", "text", "kind", ["type", "name", "line_start", "line_end"]).where(F.startswith("name", F.lit("f")) & (F.col("type") == "function"))
    out = tree.with_context(e, sources(spark, d, "python"), "doc", "text", 1)
    return out.select("doc", "line_start", F.col("context_start").alias("first"), F.col("context_end").alias("last"), (F.col("line_start") - F.col("context_start")).alias("before"))


@query("""SELECT p_partkey AS doc, symbol, usage FROM part, (VALUES ('g', 'function_call'), ('g', 'variable_reference'), ('Base', 'variable_reference'), ('int', 'variable_reference'), ('int', 'variable_reference'), ('x', 'variable_reference'), ('V', 'assignment'), ('os', 'import_usage'), ('c', 'import_usage')) t(symbol, usage), range(CASE WHEN symbol = 'g' THEN p_size % 4 ELSE 1 END)""")
def usages(spark, d):
    """Symbols that Python sources use."""
    return tree.usage_table(sources(spark, d, "python"), "doc", "text", "kind", columns=["symbol_name", "usage_type"]).select("doc", F.col("symbol_name").alias("symbol"), F.col("usage_type").alias("usage"))
