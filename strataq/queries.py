"""Registered queries of the library's own operators, each with an equivalent SQL text where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .operators import assembly, catalog, chunking, facets, vector
from .plans import jq
from .registry import ORACLES, QUERIES, query, table

def _first_vector(points: DataFrame) -> list[float]:
    return points.where("vec_id = 0").select("embedding").first()[0]


_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn_topk(spark, d):
    p = table(spark, d, "embeddings")
    return vector.search(p, _first_vector(p), 10, None, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 3 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def knn_filtered(spark, d):
    p = table(spark, d, "embeddings")
    return vector.search(p, _first_vector(p), 10, {"label": 3}, "vec_id", "embedding").select("vec_id", "label", F.round("score", 6).alias("score"))


@query("SELECT vec_id, round(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 4) AS norm FROM embeddings")
def l2_norm(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.round(vector.norm(F.col("embedding")), 4).alias("norm"))


@query("""SELECT e.vec_id, list_sum(list_transform(range(1, 65), lambda i: ((e.embedding[i] > 0) <> (q.embedding[i] > 0))::INT))::INT AS distance
 FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY 2, 1 LIMIT 20""")
def quantize_binary_hamming(spark, d):
    p = table(spark, d, "embeddings")
    q = vector.quantize_binary(vector.literal(_first_vector(p)))
    return p.select("vec_id", vector.hamming(vector.quantize_binary(F.col("embedding")), q).alias("distance")).orderBy("distance", "vec_id").limit(20)


@query("SELECT 'lang' AS key, lang AS value, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents WHERE source IS NOT NULL GROUP BY source")
def facet_values(spark, d):
    p = table(spark, d, "documents")
    return facets.values(p, "lang").select(F.lit("lang").alias("key"), "value", "n").union(facets.values(p, "source").select(F.lit("source").alias("key"), "value", "n"))


@query(f"SELECT e.vec_id, e.label, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.label = 7 ORDER BY {_COS} DESC, e.vec_id LIMIT 10")
def facet_route_search(spark, d):
    p = table(spark, d, "embeddings")
    out = facets.search_smart(p, "points with label 7, please", _first_vector(p), ["label"], 10, "vec_id", "embedding")
    return out.select("vec_id", "label", F.round("score", 6).alias("score"))


@query("""WITH v AS (SELECT DISTINCT source AS value FROM documents WHERE source IS NOT NULL),
 h AS (SELECT conv_id, turn, value FROM conversations, (SELECT DISTINCT role AS value FROM conversations) WHERE regexp_matches(text || ' ' || role, '(^|[^A-Za-z0-9_])' || value || '($|[^A-Za-z0-9_])'))
 SELECT conv_id, turn, arg_min(value, (-length(value), value)) AS value FROM h GROUP BY ALL""")
def facet_route_table(spark, d):
    c = table(spark, d, "conversations")
    q = c.select(F.struct("conv_id", "turn").alias("query_id"), F.concat("text", F.lit(" "), "role").alias("query"))
    return facets.route_table(q, c, "role").select("query_id.conv_id", "query_id.turn", "value")


@query("SELECT count(*) AS n, max(len(embedding))::INT AS dim, floor(count(*) * max(len(embedding)) * 4 * 1.2)::BIGINT AS plain, floor(count(*) * max(len(embedding)) * 1.2)::BIGINT AS scalar, floor(count(*) * max(len(embedding)) * 0.125 * 1.2)::BIGINT AS bits FROM embeddings")
def collection_info(spark, d):
    p = table(spark, d, "embeddings").agg(F.count("*").alias("n"), F.max(F.size("embedding")).alias("dim"))
    n, k = F.col("n"), F.col("dim")
    return p.select("n", "dim", vector.memory_bytes(n, k).alias("plain"), vector.memory_bytes(n, k, "scalar").alias("scalar"), vector.memory_bytes(n, k, "binary").alias("bits"))


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, props ORDER BY event_id) AS n FROM events) WHERE n = 1")
def dedupe_exact(spark, d):
    e = table(spark, d, "events")
    return assembly.dedupe_exact(e, ["user_id", "event_type", "props"], "event_id").select("event_id")


def _positions(events: DataFrame) -> DataFrame:
    at = assembly.instant(F.col("ts").cast("string"), F.lit(None).cast("string"))
    return assembly.positions(events, at, "event_id").select("event_id", "pos")


@query("SELECT conv_id, turn, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before_text, md5(text) AS digest FROM conversations")
def version_pairs(spark, d):
    c = table(spark, d, "conversations")
    return assembly.pairs(c, "conv_id", "turn", "text").select("conv_id", "turn", F.col("before").alias("before_text"), F.md5(F.col("text").cast("binary")).alias("digest"))


@query("""WITH n AS (SELECT user_id, event_type, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1)
 SELECT user_id, event_type, event_id FROM n""")
def upsert_latest(spark, d):
    """The last day's events over all before it; users without an event on that day keep their old row."""
    old, new = _batches(table(spark, d, "events"))
    return catalog.upsert_latest(catalog.upsert_latest(None, old, "user_id", "event_id"), new, "user_id", "event_id")


def _batches(events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All events in two batches, cut where the last day begins."""
    cols = ["user_id", "event_type", "event_id"]
    last = events.agg(F.date_trunc("day", F.max("ts")).alias("day"))
    e = events.crossJoin(F.broadcast(last)).withColumn("late", F.coalesce(F.col("ts") >= F.col("day"), F.lit(False)))
    return e.where(~F.col("late")).select(*cols), e.where("late").select(*cols)


@query("""SELECT doc_id, g AS chunk_index, md5(substring(text, g * 450 + 1, 512)) AS digest FROM (SELECT doc_id, text, unnest(range(CASE WHEN length(text) <= 512 THEN 1 ELSE ((length(text) - 512 + 449) // 450) + 1 END)) AS g FROM documents WHERE length(text) > 0)""")
def chunk_char_windows(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", F.posexplode(chunking.char_windows(F.col("text"), 512, 62)).alias("pos", "c")).select("doc_id", F.col("pos").cast("long").alias("chunk_index"), F.md5(F.col("c").cast("binary")).alias("digest"))


@query("SELECT page_id, regexp_extract(url, '^([a-z]+)://([^/]+)', 1) AS scheme, regexp_extract(url, '^([a-z]+)://([^/]+)', 2) AS host FROM pages")
def regex_capture(spark, d):
    found = facets.path_metadata(F.col("url"), [r"^(?P<scheme>[a-z]+)://(?P<host>[^/]+)"])
    return table(spark, d, "pages").select("page_id", found["scheme"].alias("scheme"), found["host"].alias("host"))


@query("SELECT source, lang, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def unique_by(spark, d):
    return assembly.first_by(table(spark, d, "documents"), ["source", "lang"], ["doc_id"]).select("source", "lang", "doc_id")


@query("SELECT event_id, 0 AS pos, props->'$.k' AS output FROM events")
def jq_path(spark, d):
    return jq.query_table(table(spark, d, "events"), ".k", "event_id", "props").withColumn("pos", F.col("pos").cast("int"))


@query("""SELECT event_id, 0 AS pos, '{"big":' || ((props->>'$.k')::BIGINT > 50) || ',"k":' || ((props->>'$.k')::BIGINT + 1) || '}' AS output FROM events""")
def jq_object(spark, d):
    return jq.query_table(table(spark, d, "events"), "{k: (.k + 1), big: (.k > 50)}", "event_id", "props")


@query("SELECT event_id, ((props->>'$.k')::BIGINT)::VARCHAR AS output FROM events WHERE (props->>'$.k')::BIGINT % 10 = 3")
def jq_select(spark, d):
    return jq.query_table(table(spark, d, "events"), "select(.k % 10 == 3) | .k", "event_id", "props").select("event_id", "output")


from . import queries_files, queries_jq, queries_texts, queries_trees  # noqa: E402, F401  they register themselves

__all__ = ["ORACLES", "QUERIES"]
