"""Registered queries of search, chunks, versions and element trees, over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .operators import assembly, catalog, chunking, vector
from .registry import query, table
from .sources import detection

_COS = "list_cosine_similarity(e.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@query(f"""WITH s AS (SELECT q.vec_id AS query_id, e.vec_id, {_COS} AS score FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0),
 r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank FROM s)
 SELECT query_id, rank, vec_id, round(score, 6) AS score FROM r WHERE rank <= 5""")
def knn_batch(spark, d):
    """The query set of a search: every row whose id is divisible by 50."""
    p = table(spark, d, "embeddings")
    q = p.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("query"))
    return vector.search_batch(p, q, 5, "vec_id", "embedding").withColumn("score", F.round("score", 6))


_QUANTISED = "list_transform(v, lambda x: floor(x * 127 / top + 0.5)::BIGINT)"


@query(f"""WITH m AS (SELECT vec_id, embedding::DOUBLE[] AS v, list_max(list_transform(embedding::DOUBLE[], lambda x: abs(x))) AS top FROM embeddings)
 SELECT vec_id, array_to_string({_QUANTISED}, ',') AS numbers FROM m""")
def quantize_int8(spark, d):
    return table(spark, d, "embeddings").select("vec_id", F.array_join(vector.quantize_int8(F.col("embedding")).cast("array<string>"), ",").alias("numbers"))


@query("""WITH t AS (SELECT vec_id, list_slice(embedding::DOUBLE[], 1, 16) AS v FROM embeddings), u AS (SELECT vec_id, v, unnest(range(1, 17)) AS i FROM t)
 SELECT vec_id, i::INT AS i, round(v[i] / sqrt(list_inner_product(v, v)), 6) AS x FROM u""")
def matryoshka_truncate(spark, d):
    p = table(spark, d, "embeddings").select("vec_id", F.posexplode(vector.truncate(F.col("embedding"), 16)).alias("pos", "x"))
    return p.select("vec_id", (F.col("pos") + 1).alias("i"), F.round("x", 6).alias("x"))


@query("SELECT event_id, row_number() OVER (ORDER BY ts, event_id) AS pos FROM events")
def stream_sort(spark, d):
    at = assembly.instant(F.col("ts").cast("string"), F.lit(None).cast("string"))
    return assembly.positions(table(spark, d, "events"), at, "event_id").select("event_id", "pos")


@query("SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def points_exists(spark, d):
    """Which documents are labelled."""
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return catalog.points_exist(stored, table(spark, d, "documents").select(F.col("doc_id").alias("id")))


@query("SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def anti_join_new(spark, d):
    """Which documents are not labelled yet."""
    stored = table(spark, d, "labels").select(F.col("doc_id").alias("id"))
    return catalog.not_stored(stored, table(spark, d, "documents").select(F.col("doc_id").alias("id")))


_KINDS = " ".join(f"WHEN e = '{e}' THEN '{k}'" for e, k in detection.EXTENSIONS.items())


@query(f"""WITH p AS (SELECT page_id, x, lower(x) AS e FROM (SELECT page_id, unnest(['{"', '".join(detection.EXTENSIONS)}', 'bin', 'RS']) AS x FROM pages))
 SELECT page_id, x, CASE {_KINDS} ELSE 'unknown' END AS kind, CASE {_KINDS} ELSE 'unknown' END AS resolved FROM p""")
def file_types(spark, d):
    """Every known extension, an unknown one and one in capitals, on every page's path; `.resolved.N` doesn't count."""
    p = table(spark, d, "pages").select("page_id", "url", F.explode(F.array(*[F.lit(x) for x in (*detection.EXTENSIONS, "bin", "RS")])).alias("x"))
    path = F.concat(F.regexp_replace("url", "[?#].*$", ""), F.lit("."), "x")
    return p.select("page_id", "x", detection.from_path(path).alias("kind"), detection.from_path(F.concat(path, F.lit(".resolved.3"))).alias("resolved"))


@query("SELECT doc_id, sha256(text) AS digest, (length(text) // 4)::BIGINT AS tokens FROM documents WHERE text IS NOT NULL")
def content_hash(spark, d):
    return table(spark, d, "documents").where("text is not null").select("doc_id", chunking.content_hash(F.col("text")).alias("digest"), chunking.token_estimate(F.col("text")).alias("tokens"))


_LINES = "(length(text) - length(replace(text, chr(10), '')))"


def _joined(c: DataFrame) -> Column:
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("chunk_index", "content"))), lambda x: x["content"]), "")


@query(f"""SELECT doc_id, md5(text) AS digest, true AS within, true AS gapless, true AS on_lines, (1 + {_LINES} - ends_with(text, chr(10))::INT)::INT AS last_line FROM documents WHERE length(text) > 0""")
def chunk_simple(spark, d):
    """The chunks of a text, one after another, are the text; none is above its size, each begins where the one before ended,
    and ends with a line feed if one is in reach; lines are counted over them."""
    c = chunking.chunks(table(spark, d, "documents"), "simple", most=512)
    w = Window.partitionBy("doc_id").orderBy("chunk_index")
    end = F.col("offset_bytes") + F.octet_length("content")
    c = c.withColumn("ok", F.col("offset_bytes") == F.coalesce(F.lag(end).over(w), F.lit(0))).withColumn("last", F.lead("chunk_index").over(w).isNull())
    c = c.withColumn("cut", F.col("last") | F.endswith("content", F.lit("\n")) | ~F.contains("content", F.lit("\n")))
    return c.groupBy("doc_id").agg(F.md5(_joined(c).cast("binary")).alias("digest"), (F.max(F.octet_length("content")) <= 512).alias("within"), F.bool_and("ok").alias("gapless"), F.bool_and("cut").alias("on_lines"), F.max("line_end").alias("last_line"))


_SPACE = r"[\s\x0B\x1C-\x1F\x85\p{Z}]"


def _squeezed(c: DataFrame, most: int) -> DataFrame:
    return c.groupBy("doc_id").agg(F.md5(F.regexp_replace(_joined(c), _SPACE, "").cast("binary")).alias("digest"), (F.max(F.octet_length("content")) <= most).alias("within"))


_SQUEEZED = rf"SELECT doc_id, md5(regexp_replace(text, '{_SPACE.replace(chr(92) + 'x85', chr(92) + 'x{85}')}', '', 'g')) AS digest, true AS within FROM documents WHERE regexp_matches(text, '\S')"


@query(_SQUEEZED)
def chunk_code_aware(spark, d):
    """All but white space of a text is in its chunks, in order."""
    return _squeezed(chunking.chunks(table(spark, d, "documents"), "code_aware", size=400, most=900), 900)


@query(_SQUEEZED)
def chunk_recursive(spark, d):
    """Of pieces of at most 64 tokens by the estimate, of four characters at most each."""
    return _squeezed(chunking.chunks(table(spark, d, "documents"), "recursive", size=64, sizer=chunking.tokens_of), 4 * 4 * 64 + 64)


@query("SELECT doc_id, md5(text) AS digest, true AS within, (strlen(text) > 2048) AS split FROM documents WHERE length(text) > 0")
def chunk_late_split(spark, d):
    """Whole texts as one chunk each, those above 2,048 bytes split late."""
    c = chunking.chunks(table(spark, d, "documents"), "simple", most=1 << 40)
    c = chunking.late_split(c, 2048).withColumn("chunk_index", F.coalesce("split_part", F.lit(0)))
    return c.groupBy("doc_id").agg(F.md5(_joined(c).cast("binary")).alias("digest"), (F.max(F.octet_length("content")) <= 2048).alias("within"), F.bool_and(F.col("original_chunk_id").isNotNull()).alias("split"))


@query("""WITH h AS (SELECT doc_id, sha1(unhex('6f1d4c1a52a75d0e9a532a1f0c9d7b11') || encode(source || '::' || doc_id)) AS h FROM documents WHERE source IS NOT NULL)
 SELECT doc_id, h[1:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || substr('89ab', ('0x' || h[17:17])::INT % 4 + 1, 1) || h[18:20] || '-' || h[21:32] AS id FROM h""")
def chunk_ids(spark, d):
    """UUID version 5 of a name in the chunks' namespace."""
    t = table(spark, d, "documents").where("source is not null")
    return t.select("doc_id", chunking.uuid5(chunking.NAMESPACE, F.concat_ws("::", "source", F.col("doc_id").cast("string"))).alias("id"))


@query(r"""WITH c AS (SELECT conv_id, turn, 'turn ' || turn || chr(10) || replace(rtrim(text, chr(10)), chr(10), ' ') AS text FROM conversations),
 p AS (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM c)
 SELECT 'c' || conv_id AS artifact, turn::INT AS version, CASE WHEN b IS NULL THEN 'creation' ELSE 'evolution' END AS event,
  CASE WHEN b IS NULL THEN '' ELSE '- ' || replace(b, chr(10), chr(10) || '- ') || chr(10) || '+ ' || replace(text, chr(10), chr(10) || '+ ') END AS diff,
  CASE WHEN b IS NULL THEN 0.0 ELSE 1.0 END::DOUBLE AS deletion, CASE WHEN b IS NULL THEN 'main' ELSE 'branch_v' || turn END AS timeline
 FROM p WHERE b IS NOT NULL OR turn = 0""")
def version_events(spark, d):
    """Turns as versions of one artifact, two lines each: as neighbours share no line, all lines go and come."""
    c = table(spark, d, "conversations")
    text = F.concat(F.lit("turn "), F.col("turn").cast("string"), F.lit("\n"), F.translate(F.rtrim(F.col("text"), F.lit("\n")), "\n", " "))
    snaps = c.select(F.concat(F.lit("c"), "conv_id", F.lit(".resolved."), F.col("turn").cast("string")).alias("path"), text.alias("content"), F.col("turn").alias("in_pos"))
    return assembly.events(assembly.versions(snaps)).select("artifact", "version", "event", "diff", "deletion", "timeline")


@query("""SELECT 'd' || user_id AS artifact, 1 AS version, '- ' || event_type || chr(10) || '+ ' || event_id AS diff, round(1 / 3, 6) AS deletion, round(2 / 3, 6) AS overlap, 'main' AS timeline
 FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) = 1""")
def version_diffs(spark, d):
    """Versions of three lines of which the middle one changes: two of three lines are kept."""
    e = table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_type", "event_id").alias("t"), F.max("event_id").alias("n"))
    text = lambda x: F.concat_ws("\n", F.lit("first"), x, F.lit("last"))
    path = F.concat(F.lit("d"), "user_id", F.lit(".resolved."))
    snaps = e.select(F.concat(path, F.lit("0")).alias("path"), text(F.col("t")).alias("content"), F.lit(0).alias("in_pos")).unionByName(e.select(F.concat(path, F.lit("1")).alias("path"), text(F.col("n").cast("string")).alias("content"), F.lit(1).alias("in_pos")))
    return assembly.events(assembly.versions(snaps)).where("event = 'evolution'").select("artifact", "version", "diff", F.round("deletion", 6).alias("deletion"), F.round("overlap", 6).alias("overlap"), "timeline")


@query("""WITH p AS (SELECT conv_id, turn, text || ' and more of turn ' || turn AS text FROM conversations WHERE length(text) >= 200)
 SELECT conv_id, md5(string_agg(text, '|' ORDER BY turn)) AS digest, count(*) AS n FROM p GROUP BY conv_id""")
def stitch_pairs(spark, d):
    """Each long turn and a record that repeats its end are stitched to one."""
    c = table(spark, d, "conversations").where(F.length("text") >= 200)
    tail = F.concat(F.expr("right(text, 20 + int(turn) * 3)"), F.lit(" and more of turn "), F.col("turn").cast("string"))
    both = c.select("conv_id", "turn", F.lit(0).alias("n"), "text").unionByName(c.select("conv_id", "turn", F.lit(1).alias("n"), tail.alias("text")))
    out = assembly.stitch(both, ["conv_id", "turn"], ["n"], "text").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("x"))
    return out.select("conv_id", F.md5(F.array_join(F.transform("x", lambda x: x["text"]), "|").cast("binary")).alias("digest"), F.size("x").cast("long").alias("n"))


_TOP = f"SELECT e.vec_id, round({_COS}, 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 ORDER BY {_COS} DESC, e.vec_id LIMIT 10"


@query(_TOP)
def knn_rescored(spark, d):
    """By int8 vectors, rescored by the vectors themselves: with four times as many candidates, the exact result."""
    p = table(spark, d, "embeddings")
    first = p.where("vec_id = 0").select("embedding").first()[0]
    return vector.search_quantized(p, first, 10, "scalar", 4, None, "vec_id", "embedding").select("vec_id", F.round("score", 6).alias("score"))


def _store(spark) -> catalog.Store:
    """A store in the shared folder; one of the machine's own where that is unset and the master is local."""
    import tempfile
    import uuid

    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return catalog.Store(spark, f"{folder or 'file://' + tempfile.mkdtemp(prefix='strataq-')}/store-{uuid.uuid4().hex}")


@query("""WITH l AS (SELECT user_id AS id, event_id, event_type, ts::DATE AS day FROM events), c AS (SELECT count(DISTINCT id) AS n FROM l)
 SELECT id, event_type, event_id FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY event_id DESC) = 1""")
def catalog_upserts(spark, d):
    """All events, user by user, in three upserts by time and a compaction."""
    s = _store(spark)
    s.create("events", 2)
    e = table(spark, d, "events").select(F.col("user_id").alias("id"), "event_type", "event_id", F.array(F.lit(1.0), F.lit(0.0)).alias("vector"))
    n = e.agg(F.max("event_id")).first()[0] or 0
    for i in range(3):
        s.upsert("events", e.where((F.col("event_id") * 3 >= n * i) & ((F.col("event_id") * 3 < n * (i + 1)) | F.lit(i == 2))), order="event_id")
    s.compact("events")
    return s.points("events").select("id", "event_type", "event_id")


@query("""SELECT 'points' AS name, count(*) AS count, max(len(embedding))::INT AS dim, 'scalar' AS quantization, floor(count(*) * max(len(embedding)) * 1.2)::BIGINT AS bytes, true AS is_compatible FROM embeddings
 UNION ALL SELECT 'empty', 0, 3, 'none', 0, false""")
def catalog_status(spark, d):
    """Collections with their figures; one is quantised and restored from a snapshot."""
    p = table(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    s = _store(spark)
    s.create("points", p.select(F.max(F.size("vector"))).first()[0])
    s.create("empty", 3)
    s.upsert("points", p)
    label = s.snapshot("points")
    s.set_quantization("points", "scalar")
    s.optimize("points")
    s.upsert("points", p.limit(5).withColumn("id", -F.col("id") - 1))
    s.restore("points", label)
    return s.status(p.select(F.max(F.size("vector"))).first()[0])
