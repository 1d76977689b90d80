"""jq queries with one output as column expressions on VARIANT values.

Compiled are paths, literals, arithmetic, comparisons, `and`, `or`, `not`, `//`, `if`, pipes, `select`, arrays and objects, `length`,
`type`, `tostring`, `startswith`, `endswith` and the cases of ASCII.  A value is followed as null, boolean, whole number, text or
anything else.  Rows that need more than that, such as fractions or an order of arrays, are *hard*: the caller gives those to the
evaluator, so results are those of the evaluator for every row.  Each step is a column of its own that later steps refer to, so a
plan grows with the query and not with the ways through it.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Value:
    """kind: null, boolean, number, string or other; whole, text, truth: its value by kind; json: as text; there: whether there is an
    output; hard: whether columns can't tell.  variant: the value itself, where it comes from the input."""

    kind: Column
    whole: Column
    text: Column
    truth: Column
    json: Column
    there: Column
    hard: Column
    variant: Column | None = None


class Unsupported(Exception):
    pass


@dataclass
class Steps:
    """Values held as columns of `df`."""

    df: DataFrame
    n: int = 0

    def held(self, v: Value) -> Value:
        name, self.n = f"__step{self.n}", self.n + 1
        fields = [f for f in _FIELDS if getattr(v, f) is not None]
        self.df = self.df.withColumn(name, F.struct(*(getattr(v, f).alias(f) for f in fields)))
        return Value(**{f: F.col(f"{name}.{f}") for f in fields})


_FIELDS = ("kind", "whole", "text", "truth", "json", "there", "hard", "variant")


def _no() -> Column:
    return F.lit(False)


def _quoted(text: Column) -> Column:
    j = F.to_json(F.struct(text.alias("x")))
    return F.substr(j, F.lit(6), F.length(j) - 6)


def _shown(kind: Column, whole: Column, text: Column, truth: Column, other: Column) -> Column:
    return F.when(kind == "null", "null").when(kind == "boolean", truth.cast("string")).when(kind == "number", whole.cast("string")).when(kind == "string", _quoted(text)).otherwise(other)


def _made(kind: str | Column, whole=None, text=None, truth=None, json=None, there=None, hard=None) -> Value:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    whole, text, truth = F.lit(whole).cast("long") if not isinstance(whole, Column) else whole, F.lit(text).cast("string") if not isinstance(text, Column) else text, F.lit(truth).cast("boolean") if not isinstance(truth, Column) else truth
    return Value(kind, whole, text, truth, json if json is not None else _shown(kind, whole, text, truth, F.lit(None).cast("string")), F.lit(True) if there is None else there, _no() if hard is None else hard)


def of_variant(v: Column, there: Column, hard: Column) -> Value:
    schema = F.coalesce(F.schema_of_variant(v), F.lit("VOID"))
    kind = F.when(schema == "VOID", "null").when(schema == "BOOLEAN", "boolean").when(schema == "BIGINT", "number").when(schema == "STRING", "string").otherwise("other")
    text = F.try_variant_get(v, "$", "string")
    other = F.to_json(v)
    # control characters are written otherwise, fractions may be
    odd = F.when(kind == "string", F.regexp_like(text, F.lit(r"[\x00-\x07\x0B\x0E-\x1F]"))).when(kind == "other", F.regexp_like(other, F.lit(r"[0-9][.eE]|\\u00"))).otherwise(False)
    whole, truth = F.try_variant_get(v, "$", "long"), F.try_variant_get(v, "$", "boolean")
    return Value(kind, whole, text, truth, _shown(kind, whole, text, truth, other), there, hard | F.coalesce(odd, _no()), v)


def _index(of: Value, key) -> Value:
    if of.variant is None:  # a value that was made here: null gives null, texts and numbers are errors
        return _made("null", there=of.there & (of.kind == "null"), hard=of.hard | (of.kind == "other"))
    if isinstance(key, bool) or not isinstance(key, str | int) or isinstance(key, int) and key < 0 or isinstance(key, str) and ("'" in key or "\\" in key or "]" in key):
        raise Unsupported
    path = f"$['{key}']" if isinstance(key, str) else f"$[{key}]"
    start = F.substring(F.to_json(of.variant), 1, 1)
    fits = (of.kind == "null") | (of.kind == "other") & (start == ("{" if isinstance(key, str) else "["))
    return of_variant(F.try_variant_get(of.variant, path, "variant"), of.there & fits, of.hard)


def _true(v: Value) -> Column:
    return ~((v.kind == "null") | (v.kind == "boolean") & ~F.coalesce(v.truth, _no()))


def _rank(v: Value) -> Column:
    return F.when(v.kind == "null", 0).when((v.kind == "boolean") & ~v.truth, 1).when(v.kind == "boolean", 2).when(v.kind == "number", 3).otherwise(4)


def _compare(op: str, a: Value, b: Value) -> Value:
    x, y = _rank(a), _rank(b)
    same = x == y
    less = (x < y) | same & F.coalesce(F.when(a.kind == "number", a.whole < b.whole).when(a.kind == "string", a.text < b.text), _no())
    equal = same & F.coalesce(F.when(a.kind == "number", a.whole == b.whole).when(a.kind == "string", a.text == b.text), F.lit(True))
    out = {"==": equal, "!=": ~equal, "<": less, "<=": less | equal, ">": ~(less | equal), ">=": ~less}[op]
    return _made("boolean", truth=out, there=a.there & b.there, hard=a.hard | b.hard | (a.kind == "other") | (b.kind == "other"))


def _arithmetic(op: str, a: Value, b: Value) -> Value:
    numbers, there = (a.kind == "number") & (b.kind == "number"), a.there & b.there
    hard = a.hard | b.hard | (a.kind == "other") | (b.kind == "other")
    if op == "+":
        total = F.try_add(a.whole, b.whole)
        texts = (a.kind == "string") & (b.kind == "string")
        kind = F.when(a.kind == "null", b.kind).when(b.kind == "null", a.kind).otherwise(a.kind)
        whole = F.when(a.kind == "null", b.whole).when(b.kind == "null", a.whole).otherwise(total)
        text = F.when(a.kind == "null", b.text).when(b.kind == "null", a.text).otherwise(F.concat(a.text, b.text))
        fits = numbers | texts | (a.kind == "null") | (b.kind == "null")
        return _made(kind, whole, text, F.coalesce(F.when(a.kind == "null", b.truth), a.truth), there=there & fits, hard=hard | numbers & total.isNull())
    if op in ("-", "*"):
        out = F.try_subtract(a.whole, b.whole) if op == "-" else F.try_multiply(a.whole, b.whole)
        odd = (a.kind == "string") | (b.kind == "string") if op == "*" else _no()
        return _made("number", out, there=there & numbers, hard=hard | odd | numbers & out.isNull())
    zero = b.whole == 0
    if op == "%":
        # signs and large divisors have rules of their own
        return _made("number", F.try_mod(a.whole, b.whole), there=there & numbers & ~F.coalesce(zero, _no()), hard=hard | F.coalesce(numbers & ((a.whole < 0) | (b.whole < 0) | (a.whole > (1 << 52)) | (b.whole > (1 << 52))), _no()))
    rest = F.try_mod(a.whole, b.whole)
    return _made("number", F.floor(F.try_divide(a.whole, b.whole)).cast("long"), there=there & numbers & ~F.coalesce(zero, _no()), hard=hard | (a.kind == "string") | F.coalesce(numbers & ((rest != 0) | (a.whole > (1 << 52)) | (a.whole < -(1 << 52))), _no()))


def _either(cond: Column, a: Value, b: Value) -> Value:
    pick = lambda x, y: F.when(cond, x).otherwise(y)
    return Value(pick(a.kind, b.kind), pick(a.whole, b.whole), pick(a.text, b.text), pick(a.truth, b.truth), pick(a.json, b.json), pick(a.there, b.there), pick(a.hard, b.hard), pick(a.variant, b.variant) if a.variant is not None and b.variant is not None else None)


_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _call(name: str, args: list, dot: Value, steps: Steps) -> Value:
    if name == "select" and len(args) == 1:
        f = compiled(args[0], dot, steps)
        return Value(dot.kind, dot.whole, dot.text, dot.truth, dot.json, dot.there & f.there & F.coalesce(_true(f), _no()), dot.hard | f.hard, dot.variant)
    if name == "not" and not args:
        return _made("boolean", truth=~_true(dot), there=dot.there, hard=dot.hard)
    if name == "length" and not args:
        size = F.when(dot.kind == "null", 0).when(dot.kind == "number", F.greatest(dot.whole, F.try_subtract(F.lit(0).cast("long"), dot.whole))).when(dot.kind == "string", F.length(dot.text))
        other = F.coalesce(F.json_array_length(dot.json), F.size(F.json_object_keys(dot.json))) if dot.variant is not None else F.lit(None)
        return _made("number", F.coalesce(size, F.when(dot.kind == "other", other)).cast("long"), there=dot.there & (dot.kind != "boolean"), hard=dot.hard if dot.variant is not None else dot.hard | (dot.kind == "other"))
    if name == "type" and not args:
        return _made("string", text=dot.kind, there=dot.there, hard=dot.hard | (dot.kind == "other"))
    if name == "tostring" and not args:
        text = F.when(dot.kind == "string", dot.text).otherwise(dot.json)
        return _made("string", text=text, there=dot.there, hard=dot.hard | (dot.kind == "other"))
    if name in ("ascii_downcase", "ascii_upcase") and not args:
        return _made("string", text=F.translate(dot.text, *((_A, _Z) if name == "ascii_downcase" else (_Z, _A))), there=dot.there & (dot.kind == "string"), hard=dot.hard)
    if name in ("startswith", "endswith") and len(args) == 1:
        x = compiled(args[0], dot, steps)
        hit = (F.startswith if name == "startswith" else F.endswith)(dot.text, x.text)
        return _made("boolean", truth=hit, there=dot.there & x.there & (dot.kind == "string") & (x.kind == "string"), hard=dot.hard | x.hard)
    raise Unsupported


def _parts(node) -> list:
    return [*_parts(node[1]), node[2]] if node[0] == "comma" else [node]


def compiled(node, dot: Value, steps: Steps) -> Value:
    """The value of a tree for the input `dot`; Unsupported if columns can't hold it."""
    out = _compiled(node, dot, steps)
    return out if node[0] in ("dot", "lit", "pipe") else steps.held(out)


def _compiled(node, dot: Value, steps: Steps) -> Value:
    what = node[0]
    if what == "dot":
        return dot
    if what == "lit":
        x = node[1]
        if x is None or isinstance(x, bool):
            return _made("null" if x is None else "boolean", truth=x, there=dot.there, hard=dot.hard)
        if isinstance(x, int) and abs(x) < 1 << 62:
            return _made("number", x, there=dot.there, hard=dot.hard)
        if isinstance(x, str) and x.isprintable():
            return _made("string", text=x, there=dot.there, hard=dot.hard)
        if x == []:
            return _made("other", json=F.lit("[]"), there=dot.there, hard=dot.hard)
        raise Unsupported
    if what == "index" and node[2][0] == "lit":
        return _index(compiled(node[1], dot, steps), node[2][1])
    if what == "pipe":
        return compiled(node[2], compiled(node[1], dot, steps), steps)
    if what == "bin":
        a, b = compiled(node[2], dot, steps), compiled(node[3], dot, steps)
        return _compare(node[1], a, b) if node[1] in ("==", "!=", "<", "<=", ">", ">=") else _arithmetic(node[1], a, b)
    if what in ("and", "or"):
        a, b = compiled(node[1], dot, steps), compiled(node[2], dot, steps)
        x, y = F.coalesce(_true(a), _no()), F.coalesce(_true(b), _no())
        settled = ~x if what == "and" else x
        return _made("boolean", truth=x & y if what == "and" else x | y, there=a.there & (settled | b.there), hard=a.hard | ~settled & b.hard)
    if what == "alt":
        a, b = compiled(node[1], dot, steps), compiled(node[2], dot, steps)
        out = _either(F.coalesce(a.there & _true(a), _no()), a, b)
        return Value(out.kind, out.whole, out.text, out.truth, out.json, out.there, a.hard | out.hard, out.variant)
    if what == "if":
        c, a, b = (compiled(x, dot, steps) for x in node[1:4])
        out = _either(F.coalesce(_true(c), _no()), a, b)
        return Value(out.kind, out.whole, out.text, out.truth, out.json, out.there & c.there, out.hard | c.hard, out.variant)
    if what == "collect":
        # a part that is left out is no error; one that may be either can't be told here
        nodes = _parts(node[1])
        if any(_has(x, "select") and _fails(x) for x in nodes):
            raise Unsupported
        parts = [compiled(x, dot, steps) for x in nodes]
        shown = [F.when(F.coalesce(p.there, _no()), p.json) for p in parts]
        there = reduce(lambda x, y: x & y, [p.there for x, p in zip(nodes, parts) if not _has(x, "select")], dot.there)
        return _made("other", json=F.concat(F.lit("["), F.concat_ws(",", *shown), F.lit("]")), there=there, hard=reduce(lambda x, y: x | y, [p.hard for p in parts]))
    if what == "object":
        return _object(node, dot, steps)
    if what == "call":
        return _call(node[1], node[2], dot, steps)
    raise Unsupported


def _fails(node) -> bool:
    """Whether a tree may end in an error, other than by leaving its input out."""
    if not isinstance(node, tuple):
        return isinstance(node, list) and any(map(_fails, node))
    if node and node[0] in ("bin", "index") and not (node[0] == "bin" and node[1] in ("==", "!=", "<", "<=", ">", ">=")):
        return True
    if node and node[0] == "call" and node[1] != "select":
        return True
    return any(map(_fails, node[1:]))


def _has(node, name: str) -> bool:
    if isinstance(node, tuple) and node[:2] == ("call", name):
        return True
    return isinstance(node, tuple | list) and any(_has(x, name) for x in node)


def _object(node, dot: Value, steps: Steps) -> Value:
    pairs = {}
    for key, value in node[1]:
        if key[0] != "lit" or not isinstance(key[1], str) or not key[1].isprintable():
            raise Unsupported
        pairs[key[1]] = compiled(value, dot, steps)
    names = sorted(pairs)
    shown = [x for i, k in enumerate(names) for x in (F.lit(("," if i else "") + json.dumps(k, ensure_ascii=False) + ":"), pairs[k].json)]
    there, hard = (reduce(f, [getattr(pairs[k], at) for k in names], first) for at, f, first in (("there", lambda x, y: x & y, dot.there), ("hard", lambda x, y: x | y, dot.hard)))
    return _made("other", json=F.concat(F.lit("{"), *shown, F.lit("}")), there=there, hard=hard)


def columns(docs: DataFrame, tree, variant_col: str) -> DataFrame | None:
    """`docs` with __out (JSON text), __there (whether there is an output) and __hard; None if the query needs the evaluator."""
    steps = Steps(docs)
    try:
        v = compiled(tree, steps.held(of_variant(F.col(variant_col), F.lit(True), _no())), steps)
    except Unsupported:
        return None
    there = F.coalesce(v.there, _no())
    hard = F.coalesce(v.hard, F.lit(True)) | there & v.json.isNull()
    # a generator keeps filters on the result from being pushed, and copied, through the steps
    found = F.explode(F.array(F.struct(v.json.alias("out"), there.alias("there"), hard.alias("hard"))))
    return steps.df.select(*docs.columns, found.alias("__found")).select(*docs.columns, F.col("__found.out").alias("__out"), F.col("__found.there").alias("__there"), F.col("__found.hard").alias("__hard"))
