"""The registered queries of the operators, one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import exact_dedup as _exact
from . import line_dedup as _lines
from . import hamming, language, minhash, mixing, packing, quality, token_io, warc
from .common import Scratch, checkpoint, crc_bucket, documents
from .tokens import BYTE_BPE, WORD_BPE


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of remainder 1 calibrate, those of 2 to 4 fit, those of 0 are held out."""
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    with Scratch(spark) as s:
        x = s.table(quality.features(docs, "doc_id", "text"), "x")
        fold = crc_bucket("id", 5)
        labelled = labels.where("quality is not null").select(F.col("doc_id").alias("id"), F.col("quality").cast("double").alias("y")).where(fold != 0)
        share = min(1.0, quality.MAX_ROWS / max(1, labelled.count()))
        labelled = labelled.where(F.pmod(F.xxhash64("id", F.lit(9)), F.lit(1_000_000)) < int(share * 1_000_000)).withColumn("calibrate", fold == 1)
        rows = s.table(labelled.join(x, "id").select("x", "y", "calibrate"), "labelled")
        model = quality.fit(rows)
        out = quality.score(x, model).select(F.col("id").alias("doc_id"), (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
        return checkpoint(out)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    fold = crc_bucket("doc_id", 3)
    model = language.learn(docs.where(fold != 1))
    out = language.identify(docs, model)
    return out.select("doc_id", (fold == 1).alias("held_out"), "lang_pred", "score")


def op2_hamming_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest rows of each row whose id is divisible by 50, by Hamming distance of sign codes."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("id"), hamming.sign_code(F.col("embedding")).alias("code"))
    return hamming.top_k(rows, rows.where("id % 50 = 0"))


def captures(pages: DataFrame) -> DataFrame:
    """A capture log made of `pages`: every page is a response at 100 s * its id, and is revisited 50 s later under another
    form of its URL.  Of 7 revisits one carries another ETag, one only a date and one no validator; every 11th page also
    has a revisit before its response."""
    url, t = F.col("url"), F.col("page_id") * 100
    etag = F.concat(F.lit('"'), F.md5(F.col("html").cast("binary")), F.lit('"'))
    day = F.concat(F.lit("day "), F.col("page_id").cast("string"))
    response = pages.select(
        F.concat(F.lit("r"), F.col("page_id").cast("string")).alias("record_id"), F.lit("response").alias("type"), url, t.alias("ts"), F.lit(200).alias("status"),
        F.create_map(F.lit("ETag"), etag, F.lit("Last-Modified"), day, F.lit("Content-Length"), F.octet_length("html").cast("string"), F.lit("Cache-Control"), F.lit("max-age=60")).alias("headers"),
    )
    kind = F.pmod("page_id", F.lit(7))
    own = F.when(kind == 1, F.create_map(F.lit("ETag"), F.lit('"other"'))).when(kind == 2, F.create_map(F.lit("Last-Modified"), day)).when(kind == 3, F.create_map(F.lit("Vary"), F.lit("*")))
    own = own.otherwise(F.create_map(F.lit("etag"), F.concat(F.lit("W/"), etag)))
    headers = F.map_concat(own, F.create_map(F.lit("Cache-Control"), F.lit("max-age=99"), F.lit("Content-Length"), F.lit("0"), F.lit("Age"), F.col("page_id").cast("string")))
    again = lambda name, at: pages.select(F.concat(F.lit(name), F.col("page_id").cast("string")).alias("record_id"), F.lit("revisit").alias("type"), F.concat(url, F.lit("#seen")).alias("url"), (t + at).alias("ts"), F.lit(304).alias("status"), headers.alias("headers"))
    return response.unionByName(again("v", 50)).unionByName(again("e", -50).where(F.pmod(F.substring("record_id", 2, 20).cast("long"), F.lit(11)) == 0))


def op3_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over a capture log made of `pages`, since no table holds WARC bytes; `warc.read_warc` is tested apart."""
    out = warc.resolve(captures(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries("headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return out.select("record_id", "ts", "outcome", "response_id", shown.alias("headers"))


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken", "times")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines_gone, lines_gone (their numbers from 0, as text) and the digest of the text that is left."""
    out = _lines.line_dedup(documents(spark, sf_dir), gone_col="gone")
    return out.select("doc_id", F.size("gone").cast("long").alias("n_gone"), F.array_join("gone", ",").alias("lines_gone"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("text_sha256"))


def op8_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir))


def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exact.exact_dedup(documents(spark, sf_dir))


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        tokens = s.table(token_io.tokenised(documents(spark, sf_dir), WORD_BPE), "tokens")
        freq, width = token_io.shared_table(tokens, WORD_BPE)
        manifest = s.table(token_io.write_files(tokens, s.path("files"), freq, width), "manifest")
        s.drop("tokens")
        read = token_io.read_files(manifest, freq, digest=True)
        return checkpoint(read.withColumnRenamed("id", "doc_id"))


def op10_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    with Scratch(spark) as s:
        tokens = s.table(packing.keyed(documents(spark, sf_dir), BYTE_BPE), "tokens")
        pieces = packing.pack(tokens)
        return checkpoint(pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_quality, op2_hamming_top_k, op3_warc_revisits, op4_mix_sources, op5_language, op6_line_dedup, op7_exact_dedup, op8_near_duplicates, op9_token_files, op10_pack)}

_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

_WORD = r"[^\x20\x09-\x0D]+"

ORACLES: dict[str, str] = {
    "op2_hamming_top_k": """
        WITH d AS (SELECT q.vec_id AS query_id, b.vec_id AS neighbor_id,
                          list_sum(list_transform(range(1, 65), lambda i: ((q.embedding[i] > 0) <> (b.embedding[i] > 0))::INT))::INT AS distance
                   FROM embeddings q JOIN embeddings b ON q.vec_id <> b.vec_id WHERE q.vec_id % 50 = 0),
        r AS (SELECT *, (row_number() OVER (PARTITION BY query_id ORDER BY distance, neighbor_id))::INT AS rank FROM d)
        SELECT query_id, rank, neighbor_id, distance FROM r WHERE rank <= 10""",
    "op3_warc_revisits": r"""
        WITH p AS (SELECT page_id, md5(html) AS tag, strlen(html) AS size,
                     regexp_replace(regexp_replace(lower(regexp_extract(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^([^/?]*)', 1)), ':(80|443)$', ''), '^www\.', '') AS host,
                     regexp_replace(regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', ''), '^[^/?]*', '') AS rest FROM pages),
        u AS (SELECT page_id, tag, size, host || regexp_replace(regexp_replace(regexp_replace(regexp_replace(rest,
                '([?&])(?:TRACK)=[^&]*(&|$)', '\1', 'g'), '([?&])(?:TRACK)=[^&]*(&|$)', '\1', 'g'), '[?&]+$', ''), '/+(\?|$)', '\1', 'g') AS canonical FROM p),
        v AS (SELECT 'v' || page_id AS record_id, page_id * 100 + 50 AS ts, * FROM u
              UNION ALL SELECT 'e' || page_id, page_id * 100 - 50, * FROM u WHERE page_id % 11 = 0),
        r AS (SELECT page_id AS rid, page_id * 100 AS rts, tag AS rtag, size AS rsize, canonical FROM u),
        j AS (SELECT * FROM v ASOF LEFT JOIN r ON v.canonical = r.canonical AND v.ts >= r.rts),
        o AS (SELECT *, CASE WHEN rid IS NULL THEN 'no_response' WHEN page_id % 7 = 1 THEN 'mismatch' WHEN page_id % 7 = 3 THEN 'no_validator'
                        WHEN page_id % 7 = 2 THEN CASE WHEN rid = page_id THEN 'resolved' ELSE 'mismatch' END
                        WHEN tag = rtag THEN 'resolved' ELSE 'mismatch' END AS outcome FROM j)
        SELECT record_id, ts, outcome, 'r' || rid AS response_id,
               CASE WHEN outcome = 'resolved' THEN 'age=' || page_id || ';cache-control=max-age=99;content-length=' || rsize || ';etag=' ||
                 CASE WHEN page_id % 7 = 2 THEN '"' || rtag || '"' ELSE 'W/"' || tag || '"' END || ';last-modified=day ' || rid END AS headers
        FROM o""".replace("TRACK", warc.TRACKING),
    "op6_line_dedup": f"""
        WITH raw AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
        l AS (SELECT doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS ln FROM raw),
        c AS (SELECT doc_id, ln, line, len(regexp_extract_all(line, '{_WORD}')) AS w FROM l),
        p AS (SELECT *, row_number() OVER d AS pos, sum(w) OVER d AS cum FROM c WHERE w > 0 WINDOW d AS (PARTITION BY doc_id ORDER BY ln)),
        e AS (SELECT a.doc_id, a.pos, min(b.pos) AS last FROM p a JOIN p b ON a.doc_id = b.doc_id AND b.pos BETWEEN a.pos AND a.pos + 24
              WHERE b.cum - a.cum + a.w >= 25 GROUP BY ALL),
        s AS (SELECT e.doc_id, e.pos, e.last, string_agg(b.line, chr(10) ORDER BY b.pos) AS run
              FROM e JOIN p b ON e.doc_id = b.doc_id AND b.pos BETWEEN e.pos AND e.last GROUP BY ALL),
        r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS nth FROM s),
        g AS (SELECT DISTINCT p.doc_id, p.ln FROM r JOIN p ON r.doc_id = p.doc_id AND p.pos BETWEEN r.pos AND r.last WHERE nth > 1),
        t AS (SELECT l.doc_id, count(g.ln) AS n_gone, coalesce(string_agg(g.ln, ',' ORDER BY g.ln), '') AS lines_gone,
                     coalesce(string_agg(l.line, chr(10) ORDER BY l.ln) FILTER (WHERE g.ln IS NULL), '') AS kept
              FROM l LEFT JOIN g ON l.doc_id = g.doc_id AND l.ln = g.ln GROUP BY 1)
        SELECT doc_id, n_gone, lines_gone, sha256(kept) AS text_sha256 FROM t""",
    "op7_exact_dedup": f"""
        WITH n AS (SELECT doc_id, {_NORM} AS t FROM documents)
        SELECT doc_id, min(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
               doc_id = min(doc_id) OVER w AS kept, sha256(t) AS text_sha256
        FROM n WINDOW w AS (PARTITION BY t)""",
}
