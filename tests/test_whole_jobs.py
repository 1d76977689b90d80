"""Jobs that once did less than the whole."""

from __future__ import annotations

import os

import duckdb
import pytest
from pyspark.sql import functions as F

from strataq.operators import assembly, catalog, facets
from strataq.queries import QUERIES

D = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@tables
@pytest.mark.parametrize("name", ["stream_sort"])
def test_no_single_task_sorts(spark, name):
    plan = QUERIES[name](spark, D)._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan


@tables
def test_every_event_has_a_position(spark):
    got = [r.pos for r in QUERIES["stream_sort"](spark, D).collect()]
    n = duckdb.sql(f"SELECT count(*) FROM '{D}/events.parquet'").fetchall()[0][0]
    assert sorted(got) == list(range(1, n + 1))


@pytest.mark.parametrize("parts", [1, 3, 50])
def test_positions_with_ties_and_nulls(spark, parts):
    rows = [(i, None if i % 5 == 0 else f"2024-01-01 00:00:{i % 3:02d}") for i in range(200)] + [(None, "2024-01-01 00:00:01"), (None, None)]
    df = spark.createDataFrame(rows, "id long, t string")
    got = {(r.t, r.id): r.pos for r in assembly.positions(df, F.try_to_timestamp("t"), "id", parts).collect()}
    want = sorted(rows, key=lambda r: (r[1] is not None, r[1] or "", r[0] is not None, r[0] or 0))
    assert got == {(t, i): k + 1 for k, (i, t) in enumerate(want)}
    assert assembly.positions(df.limit(0), F.try_to_timestamp("t"), "id", parts).count() == 0


@tables
def test_every_query_vector_is_searched(spark):
    n = {r.query_id: r["count"] for r in QUERIES["knn_batch"](spark, D).groupBy("query_id").count().collect()}
    ids = duckdb.sql(f"SELECT vec_id FROM '{D}/embeddings.parquet' WHERE vec_id % 50 = 0").fetchall()
    assert n == {i: 5 for (i,) in ids}


@tables
def test_stored_points_are_a_whole_table(spark):
    got = sorted(r.id for r in QUERIES["points_exists"](spark, D).collect())
    both = duckdb.sql(f"SELECT doc_id FROM '{D}/labels.parquet' INTERSECT SELECT doc_id FROM '{D}/documents.parquet' ORDER BY 1").fetchall()
    assert got == [i for (i,) in both] and 0 < len(got) < spark.read.parquet(f"{D}/documents.parquet").count()


@tables
def test_upsert_merges_all_events_and_keeps_old_rows(spark, monkeypatch):
    calls, merge = [], catalog.upsert_latest
    monkeypatch.setattr(catalog, "upsert_latest", lambda old, new, *a: (calls.append((old, new)), merge(old, new, *a))[1])
    got = {r.user_id: r.event_id for r in QUERIES["upsert_latest"](spark, D).collect()}
    old, new = calls[-1]
    kept = {r.user_id: r.event_id for r in old.join(new, "user_id", "left_anti").collect()}
    assert kept and all(got[u] == e for u, e in kept.items())


@tables
def test_texts_of_routed_queries_stay_where_they_are(spark):
    def sent(df) -> list[str]:
        """What the plan moves between tasks or to the driver, a row as its columns' types."""
        out, todo = [], [df._jdf.queryExecution().executedPlan().executedPlan()]
        while todo:
            p = todo.pop()
            out += [p.schema().simpleString()] if "Exchange" in p.nodeName() else []
            todo += [p.children().apply(i) for i in range(p.children().size())]
        return out

    plan = QUERIES["facet_route_table"](spark, D)
    assert not any("query:" in x for x in sent(plan)), sent(plan)
    c = spark.read.parquet(f"{D}/conversations.parquet")
    q = c.select(F.struct("conv_id", "turn").alias("query_id"), F.concat("text", F.lit(" "), "role").alias("query"))
    got = {(r.query_id, r.value) for r in facets.route_table(q, c, "role", most_bytes=0).collect()}
    assert got == {((r.conv_id, r.turn), r.value) for r in plan.collect()}


@pytest.mark.parametrize("most_bytes", [4 << 20, 0])
def test_routing_many_queries_is_routing_each(spark, most_bytes):
    p = spark.createDataFrame([(x,) for x in ("c", "c++", "Visual C++", "++", "windows", "win", None)], "lang string")
    asked = ["How do I build C++ on Windows", "visual c++", "c", "x ++ y", "win++", "cat", "", None]
    q = spark.createDataFrame([(i if i else None, x) for i, x in enumerate(asked)], "query_id long, query string")
    got = {r.query_id or 0: r.value for r in facets.route_table(q, p, "lang", most_bytes).collect()}
    want = {i: facets.route(x, p, ["lang"]).get("lang") for i, x in enumerate(asked) if x is not None}
    assert got == {i: v for i, v in want.items() if v}
