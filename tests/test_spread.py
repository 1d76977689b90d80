"""Queries whose rows take far longer to work on than to read use all cores, however few files and groups of rows there are."""

from __future__ import annotations

import ast
import os

import pytest

from strataq.functions.spread import LEAST_PARTS, MOST_PARTS, spread
from strataq.operators import chunking
from strataq.parsers import code
from strataq.parsers.tree import usage_table
from strataq.queries import QUERIES

D = "/root/testdata/sf0.001"
SPREAD = [
    "usages", "usage_calls", "schema_validation", "element_context", "yaml_flatten", "parse_python", "jq_architecture_formats", "jq_aggregates", "jq_entries", "parse_c", "parse_rust", "element_chunks", "parse_cuda", "parse_cpp", "elements_at_line", "parse_markdown", "structural_query", "grep_output", "json_output",
]


@pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
@pytest.mark.parametrize("name", SPREAD)
def test_rows_are_spread_before_python(spark, name):
    plan = QUERIES[name](spark, D)._jdf.queryExecution().toString()
    step = max(plan.find(x) for x in ("MapInArrow", "MapInPandas", "ArrowEvalPython"))
    assert step >= 0 and f"RoundRobinPartitioning({LEAST_PARTS})" in plan[step:]


def test_expressions_are_shown_as_ever():
    shown = "a, a.b.c, f().x.y, (a + b).c, 1 .real, 'x', \"it's\", u'x', b'x', 1.5, 1e999, 2j, ..., True, None, -1, (1, 2), f(a, *b), [x for x in y], lambda: 1, 'a\\n', f'{a}'"
    for n in ast.parse(f"[{shown}]", mode="eval").body.elts:
        assert code._unparsed(n) == ast.unparse(n)


def test_usages_by_columns(spark):
    docs = spark.createDataFrame([(1, "import a.b as c\ndef f(x):\n    y = g(x).h(1)\n    return y.z\n", "python"), (None, "fn f() { g(); }", "rust"), (3, "def", "python"), (4, None, None)], "id long, text string, kind string")
    every = usage_table(docs, "id", "text", "kind")
    assert {(r.doc, r.symbol_name, r.usage_type, r.content, r.scope) for r in every.collect()} >= {(1, "a.b", "import_usage", "import a.b as c", "module"), (1, "h", "method_call", "g(x).h(1)", "f"), (1, "y", "assignment", "y", "f"), (None, "g", "function_call", "g", "f")}
    for columns in (["symbol_name", "usage_type"], ["content", "line_end"]):
        some = usage_table(docs, "id", "text", "kind", columns=columns)
        assert set(some.columns) == {"doc", *columns} and sorted(map(str, some.collect())) == sorted(map(str, every.select(*some.columns).collect()))


def test_recursive_chunks_measure_a_text_a_few_times():
    measured = []

    def sizer(text: str) -> int:
        measured.append(len(text))
        return chunking.tokens_of(text)

    text = "".join(f"word{i} and, some more. " + ("\n" if i % 7 == 0 else "") + ("\n\n" if i % 50 == 0 else "") for i in range(2000))
    plain = list(chunking.recursive(text, 64, sizer))
    every = sum(measured)  # any other sizer is given each piece again with every part
    measured.clear()
    try:
        chunking.ADDITIVE.add(sizer)
        assert list(chunking.recursive(text, 64, sizer)) == plain == list(chunking.recursive(text, 64, chunking.tokens_of))
    finally:
        chunking.ADDITIVE.discard(sizer)
    assert sum(measured) <= 4 * len(text) < every
    assert [chunking.tokens_of(x) for x in ("", "a", "abcd", "abcde", "é_9x1 !?", "\x85 a.b")] == [0, 1, 1, 2, 4, 3]


def test_parts_follow_the_size(spark):
    rows = spark.sparkContext.parallelize([(1,), (2,)], 1).toDF(["a"])
    assert spread(rows).rdd.getNumPartitions() == LEAST_PARTS  # of unknown size
    some = spark.range(0, 1_000_000, 1, 1)
    assert spread(some).rdd.getNumPartitions() == LEAST_PARTS
    assert spread(some, 80_000).rdd.getNumPartitions() == 100
    assert spread(some, 1).where("id < 0")._jdf.queryExecution().toString().count(f"RoundRobinPartitioning({MOST_PARTS})")
