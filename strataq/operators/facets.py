"""Facets: distinct values of metadata columns, and routing a query's words to equality filters."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vector


def values(points: DataFrame, key: str) -> DataFrame:
    """value, n: the distinct values of a string or integer column, as strings."""
    return points.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("value")).agg(F.count("*").alias("n"))


def matches(query: Column, value: Column) -> Column:
    """Whether `value` stands in `query` as a word, whatever the case; its ends may be marks (`c++`)."""
    escaped = F.regexp_replace(F.lower(value), r"([\\.\[\]{}()*+\-?^$|])", r"\\$1")
    return F.regexp_like(F.lower(query), F.concat(F.lit(r"(?<![\p{L}\p{N}_])"), escaped, F.lit(r"(?![\p{L}\p{N}_])")))


def route(query: str, points: DataFrame, keys: list[str], limit: int = 10_000) -> dict[str, str]:
    """For each key the longest value found in `query`, ties by order.  Values are matched on the executors; `limit` bounds
    what one key may bring to the driver, and more is an error."""
    out = {}
    for key in keys:
        hits = values(points, key).where(matches(F.lit(query), F.col("value"))).select("value").limit(limit + 1).collect()
        if len(hits) > limit:
            raise ValueError(f"{key}: more than {limit} values match")
        if hits:
            out[key] = min((r.value for r in hits), key=lambda v: (-len(v), v))
    return out


def route_table(queries: DataFrame, points: DataFrame, key: str, most_bytes: int = 4 << 20) -> DataFrame:
    """query_id, value: `route` for many queries (query_id, query); words of the query are joined with the values, so a
    value of several words is found by its first word, and one without any word is held against every query.

    Values of at most `most_bytes` together are sent to the tasks, which then drop words as they cut them.  More values meet the
    words in a shuffle, to which the queries' texts don't go along; they come back to the pairs that are left.
    """
    word = r"[^\p{L}\p{N}_]+"
    v = values(points, key).select("value", F.coalesce(F.get(F.filter(F.split(F.lower("value"), word), lambda x: x != ""), 0), F.lit("")).alias("first"))
    words = F.explode(F.array_union(F.split(F.lower("query"), word), F.array(F.lit(""))))
    if (v.agg(F.sum(F.octet_length("value") + 64)).first()[0] or 0) <= most_bytes:
        hit = queries.select("query_id", "query", words.alias("first")).join(F.broadcast(v), "first")
    else:
        pair = queries.select("query_id", words.alias("first")).hint("merge").join(v, "first").select("query_id", "value").distinct()
        pair = pair.withColumnRenamed("query_id", "__id")
        hit = queries.select("query_id", "query").hint("merge").join(pair, F.col("query_id").eqNullSafe(F.col("__id")))
    hit = hit.where(matches(F.col("query"), F.col("value")))
    return hit.groupBy("query_id").agg(F.min(F.struct((-F.length("value")).alias("n"), "value")).alias("b")).select("query_id", F.col("b.value").alias("value"))


def search_smart(points: DataFrame, query: str, embedded: list[float], keys: list[str], k: int = 10, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """Vector search among the points that `query`'s facets select."""
    found = route(query, points, keys)
    where = F.lit(True)
    for key, value in found.items():
        where = where & (F.col(key).cast("string") == value)
    return vector.search(points.where(where), embedded, k, None, id_col, vector_col)


def path_metadata(path: Column, rules: list[str]) -> Column:
    """Named groups of the rules that match a path, as a map; later rules win.  Groups are written (?P<name>…)."""
    out = F.create_map().cast("map<string,string>")
    for rule in rules:
        names = re.findall(r"\(\?P<(\w+)>", rule)
        java = re.sub(r"\(\?P<\w+>", "(", rule)
        groups, at = {}, 0
        for m in re.finditer(r"\\.|\((?!\?)|\(\?P<(\w+)>", rule):
            if m.group(0)[0] == "(":
                at += 1
                if m.group(1):
                    groups[m.group(1)] = at
        found = F.create_map(*[x for n in names for x in (F.lit(n), F.regexp_extract(path, java, groups[n]))]) if names else F.create_map().cast("map<string,string>")
        known = F.array(*[F.lit(n) for n in names]) if names else F.array().cast("array<string>")
        keep = F.map_filter(out, lambda k, v: ~F.array_contains(known, k))  # noqa: B023
        out = F.when(F.regexp_like(path, F.lit(java)), F.map_concat(keep, found)).otherwise(out)
    return out
