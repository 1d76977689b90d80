"""Registered queries of sources, detection, ingest, outputs and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions import normalize, output
from .functions.embed import Constant, Hashed, embed
from .functions.spread import spread
from .operators import assembly, chunking, vector
from .parsers import element_table, schema, tree
from .parsers.tree import FIELDS, REQUIRED
from .plans import ingest, jq
from .queries_texts import _store
from .queries_trees import sources
from .registry import query, table
from .sources import detection, files
from .streaming import streams


def _page_files(spark, d) -> DataFrame:
    """Pages as files: their URL's path as the path, the page as content."""
    p = table(spark, d, "pages")
    path = F.concat(F.regexp_replace(F.regexp_replace("url", "[?#].*$", ""), "^[a-z]+://", ""), F.when(F.col("page_id") % 3 == 0, ".html").when(F.col("page_id") % 3 == 1, ".py").otherwise(".bin"))
    return p.select("page_id", path.alias("path"), path.alias("rel_path"), detection.extension(path).alias("extension"), F.octet_length("html").cast("long").alias("length"), F.timestamp_seconds(F.col("page_id") * 60).alias("modified"), F.col("html").cast("binary").alias("content"))


_PATH = "(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', '') || CASE page_id % 3 WHEN 0 THEN '.html' WHEN 1 THEN '.py' ELSE '.bin' END)"


@query(f"SELECT page_id FROM pages WHERE page_id % 3 < 2 AND NOT regexp_matches({_PATH}, '^[^/]*/en/') AND NOT regexp_matches(string_split({_PATH}, '/')[-1], '^[^/]*7[^/]*$')")
def files_selected(spark, d):
    """Files by extension, whatever its case, without those of a folder and those with a 7 in their name."""
    return files.select_files(_page_files(spark, d), ["HTML", ".py"], ["*/en/**", "*7*"]).select("page_id")


@query(f"SELECT page_id, {_PATH} AS path, 'file' AS source_type, CASE page_id % 3 WHEN 0 THEN 'html' WHEN 1 THEN 'python' ELSE 'unknown' END AS language, strlen(html)::VARCHAR AS size_bytes, nullif(regexp_extract({_PATH}, '^([a-z0-9.]+)/(en|de|fr|es)/', 2), '') AS lang, 'team' AS owner FROM pages")
def files_metadata(spark, d):
    """Base metadata, groups of a path rule and constants, later ones over earlier ones."""
    out = files.with_metadata(_page_files(spark, d), [r"^(?P<owner>[a-z0-9.]+)/(?P<lang>en|de|fr|es)/"], {"owner": "team"})
    return out.select("page_id", *(F.try_element_at("metadata", F.lit(k)).alias(k) for k in ("path", "source_type", "language", "size_bytes", "lang", "owner")))


@query("SELECT page_id FROM pages WHERE page_id % 5 = 0 OR page_id % 7 = 0")
def files_changed(spark, d):
    """Against a state in which every fifth file had another length and every seventh is missing."""
    f = _page_files(spark, d)
    state = f.where("page_id % 7 <> 0").withColumn("length", F.when(F.col("page_id") % 5 == 0, F.col("length") + 1).otherwise(F.col("length")))
    state = state.select("rel_path", files.meta_hash(F.col("rel_path"), F.col("length"), F.col("modified")).alias("meta_hash"))
    return files.changed(f, state).select("page_id")


@query(f"SELECT page_id, sha256({_PATH} || '|' || strlen(html) || '|' || page_id * 60) AS meta_hash FROM pages")
def files_meta_hash(spark, d):
    return _page_files(spark, d).select("page_id", files.meta_hash(F.col("rel_path"), F.col("length"), F.col("modified")).alias("meta_hash"))


@query("SELECT unnest(['html', 'py', 'bin']) AS extension, unnest([count(*) FILTER (page_id % 3 = 0), count(*) FILTER (page_id % 3 = 1), count(*) FILTER (page_id % 3 = 2)]) AS n FROM pages")
def files_by_extension(spark, d):
    return files.extension_counts(_page_files(spark, d))


@query("SELECT 'html' AS language, count(*) FILTER (page_id % 3 = 0) AS n FROM pages")
def files_dominant_language(spark, d):
    """Of as many HTML as Python files, or one more, HTML comes first."""
    return files.dominant_language(_page_files(spark, d))


@query("SELECT doc_id, (CASE WHEN strlen(text) > 3000 THEN ceil((strlen(text) - 200) / 800)::BIGINT ELSE 1 END) AS n, md5(text) AS digest FROM documents WHERE text IS NOT NULL")
def file_segments(spark, d):
    """Texts above 3,000 bytes in segments of 1,000 that overlap by 200: without the overlaps they are the text."""
    t = table(spark, d, "documents").where("text is not null").select("doc_id", F.col("text").cast("binary").alias("content"))
    parts = files.segments(t, 3000, 1000, 200)
    own = F.when(F.col("segment") <= 0, F.col("content")).otherwise(F.substr("content", F.lit(201), F.lit(1 << 30)))
    parts = parts.withColumn("own", F.hex(own)).groupBy("doc_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("segment", "own"))).alias("x"))
    return parts.select("doc_id", "n", F.md5(F.unhex(F.array_join(F.transform("x", lambda x: x["own"]), ""))).alias("digest"))


@query("SELECT doc_id, doc_id % 2 = 0 AS binary, doc_id % 3 <> 0 AND doc_id % 2 = 1 AS is_text FROM documents")
def file_sniffing(spark, d):
    """A zero byte is put after even texts' first byte, and many control characters before every third."""
    t = F.coalesce("text", F.lit(""))
    raw = F.concat(F.when(F.col("doc_id") % 3 == 0, F.repeat(F.lit("\x01"), 2000)).otherwise(F.lit("a")), F.when(F.col("doc_id") % 2 == 0, F.lit("\x00")).otherwise(F.lit("")), t).cast("binary")
    return table(spark, d, "documents").select("doc_id", detection.is_binary(raw).alias("binary"), detection.is_likely_text(raw).alias("is_text"))


_DETECTED = "['python', 'rust', 'unknown', 'html', 'zig', 'c', 'markdown']"


@query(f"SELECT p_partkey, {_DETECTED}[p_partkey % 7 + 1] AS file_type, [0.8, 0.6, 0.0, 0.7, 1.0, 0.9, 0.54][p_partkey % 7 + 1]::DOUBLE AS confidence FROM part")
def file_detection(spark, d):
    """By shebang, content, nothing, media type, a table of one's own, extension, and content again."""
    n = F.col("p_partkey") % 7
    case = lambda *xs: F.element_at(F.array(*[F.lit(x) for x in xs]), (n + 1).cast("int"))
    path = F.concat(F.lit("dir/f"), F.col("p_partkey").cast("string"), case("", "", "", "", ".zz", ".c", ""))
    text = case("#!/usr/bin/env python3\nx", "pub fn x() { let a = 1; } impl A { use b; struct C }", "words", "words", "words", "fn ", "# a\n## b\n```c\n```")
    kind = detection.detect(path, text, case(None, None, None, "text/html; charset=utf-8", None, None, None), {"zz": "zig"})
    return table(spark, d, "part").select("p_partkey", kind["file_type"].alias("file_type"), F.round(kind["confidence"], 6).alias("confidence"))


@query("SELECT conv_id, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1)::INT AS stream_index, turn, CASE WHEN turn % 2 = 0 THEN 't' || turn ELSE 'c' || turn END AS timestamp FROM conversations")
def json_array_items(spark, d):
    """Conversations as arrays, item by item; the time is the first of three fields that is there."""
    item = F.struct("turn", F.when(F.col("turn") % 2 == 0, F.concat(F.lit("t"), F.col("turn").cast("string"))).alias("time"), F.concat(F.lit("c"), F.col("turn").cast("string")).alias("created_at"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.to_json(F.array_sort(F.collect_list(item))).alias("j"))
    return files.json_items(c, "conv_id", "j").select("conv_id", "stream_index", F.get_json_object("item", "$.turn").cast("long").alias("turn"), "timestamp")


@query("""SELECT event_id, pos::INT AS pos, CASE pos WHEN 0 THEN 'a.b[0]: ' || user_id WHEN 1 THEN 'a.b[1]: ' || event_type WHEN 2 THEN 'k: ' || (props->>'$.k') ELSE 'n: null' END AS line FROM events, range(4) t(pos)""")
def json_flatten(spark, d):
    """Values with comments, bare keys and trailing commas as lines."""
    j = F.concat(F.lit("{ // note\n k: "), F.get_json_object("props", "$.k"), F.lit(", a: {b: ["), F.col("user_id").cast("string"), F.lit(", '"), F.col("event_type"), F.lit("',],}, n: null}"))
    return files.flat_table(spread(table(spark, d, "events").select("event_id", "user_id", "event_type", "props")).select("event_id", j.alias("j")), "event_id", "j").select("event_id", "pos", "line")


@query("""SELECT p_partkey, pos::INT AS pos, CASE pos WHEN 0 THEN 'doc[0].name: p' || p_partkey WHEN 1 THEN 'doc[0].sizes[0]: ' || p_size ELSE 'doc[1].z: true' END AS line FROM part, range(3) t(pos)""")
def yaml_flatten(spark, d):
    y = F.concat(F.lit("name: p"), F.col("p_partkey").cast("string"), F.lit("\nsizes:\n  - "), F.col("p_size").cast("string"), F.lit("\n---\nz: true\n"))
    return files.flat_table(spread(table(spark, d, "part").select("p_partkey", "p_size")).select("p_partkey", y.alias("y")), "p_partkey", "y", "yaml")


@query("SELECT user_id, count(*) AS n, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY user_id")
def ndjson_values(spark, d):
    """Events written a value a line, with bad lines between, and read again."""
    folder = f"{_store(spark).root}/events"
    e = table(spark, d, "events")
    e.select(F.to_json(F.struct("user_id", F.get_json_object("props", "$.k").cast("long").alias("k"))).alias("value")).unionByName(e.select(F.lit("{bad").alias("value"))).write.text(folder)
    v = files.values(spark, folder).select(F.from_json("value", "user_id long, k long").alias("v"))
    return v.groupBy("v.user_id").agg(F.count("*").alias("n"), F.sum("v.k").alias("k"))


@query("SELECT '[' || count(*) || ',' || sum(n_nationkey) || ',' || (SELECT count(*) FROM region) || ']' AS output FROM nation")
def jq_slurp(spark, d):
    """All nations as one array; the regions too."""
    n = table(spark, d, "nation").select("n_nationkey", F.to_json(F.struct("n_nationkey", "n_regionkey")).alias("j"))
    return jq.query_table(jq.slurp(n, "j", "n_nationkey").withColumn("id", F.lit(0)), "[length, (map(.n_nationkey)|add), (map(.n_regionkey)|unique|length)]", "id", "value").select("output")


@query("SELECT 'c' || conv_id || '.' || turn AS path, CASE WHEN turn % 3 = 0 THEN '' ELSE md5(text) END AS digest FROM conversations")
def snapshot_loader(spark, d):
    """Texts by path; every third file is missing."""
    c = table(spark, d, "conversations").select(F.concat(F.lit("c"), "conv_id", F.lit("."), F.col("turn").cast("string")).alias("path"), F.col("text").cast("binary").alias("content"), "turn")
    out = assembly.load_snapshots(c.select("path", F.col("turn").alias("in_pos")), c.where("turn % 3 <> 0"))
    return out.select("path", F.when(F.col("content") == "", "").otherwise(F.md5(F.col("content").cast("binary"))).alias("digest"))


# ingest and search

_NATION_PY = "def f{k}(x):\n    return x + {k}\n\n\nclass C{k}:\n    def m(self):\n        pass\n"


def _library(spark, d) -> ingest.Library:
    """The nations' files, ingested."""
    store = _store(spark)
    folder = f"{store.root}/src"
    rows = table(spark, d, "nation").select("n_nationkey", "n_regionkey").collect()  # 25 rows at any scale
    for r in rows:
        store._create(f"src/r{r.n_regionkey}/n{r.n_nationkey}.py", _NATION_PY.replace("{k}", str(r.n_nationkey)))
        store._create(f"src/r{r.n_regionkey}/skip{r.n_nationkey}.py", "x = 1\n")
        store._create(f"src/r{r.n_regionkey}/n{r.n_nationkey}.rs", "fn a() {}\n")
    store._create("src/.gitignore", "skip*\n")
    lib = ingest.Library(spark, f"{store.root}/db", Hashed(64))
    lib.folder = folder.removeprefix("file://").replace("file:", "")
    lib.found = lib.ingest(lib.folder, "nations", ingest.Options(extensions=["py"], path_rules=[r"^r(?P<region>\d+)/"], metadata={"owner": "t"}))
    return lib


_NATION_ROWS = """SELECT 'r' || n_regionkey || '/n' || n_nationkey || '.py' AS path, n_regionkey::VARCHAR AS region, 'python' AS language, crumb || CASE WHEN crumb = 'm' THEN '' ELSE n_nationkey::VARCHAR END AS name, a::INT AS line_start, b::INT AS line_end
 FROM nation, (VALUES ('f', 1, 2), ('C', 5, 7), ('m', 6, 7)) t(crumb, a, b)"""


@query(_NATION_ROWS)
def ingest_files(spark, d):
    """A folder of sources with ignore rules, by extension, as embedded chunks with metadata."""
    p = _library(spark, d).store.points("nations")
    of = lambda k: F.try_element_at("metadata", F.lit(k)).alias(k)
    return p.select(of("path"), of("region"), of("language"), F.element_at(F.split("crumbtrail", "::"), -1).alias("name"), "line_start", "line_end")


@query("SELECT unnest([1, 2]) AS run, unnest([count(*), count(*)]) AS seen, unnest([count(*), 0]) AS processed, unnest([3 * count(*), 0]) AS chunks FROM nation")
def ingest_summary(spark, d):
    """What two runs over the same files saw, processed and stored."""
    lib = _library(spark, d)
    runs = [lib.found, lib.ingest(lib.folder, "nations", ingest.Options(extensions=["py"], path_rules=[r"^r(?P<region>\d+)/"], metadata={"owner": "t"}))]
    return spark.createDataFrame([(i, r["seen"], r["processed"], r["chunks"]) for i, r in enumerate(runs, 1)], "run int, seen long, processed long, chunks long")


@query("SELECT 'f' || max(n_nationkey) AS name, 'r' || arg_max(n_regionkey, n_nationkey) || '/n' || max(n_nationkey) || '.py' AS path FROM nation")
def ingest_search(spark, d):
    """The chunk that is nearest to the last nation's function."""
    lib = _library(spark, d)
    k = table(spark, d, "nation").agg(F.max("n_nationkey")).first()[0]
    out = lib.search(f"def f{k}(x): return x + {k}", "nations", 1)
    return out.select(F.col("crumbtrail").alias("name"), F.try_element_at("metadata", F.lit("path")).alias("path"))


@query("SELECT conv_id, turn, 16 AS n, round(0.25, 6) AS first, 'constant' AS model FROM conversations WHERE text IS NOT NULL")
def embed_constant(spark, d):
    """Every text at 0.1 in 64 dimensions, cut to 16 at unit length."""
    e = embed(table(spark, d, "conversations").where("text is not null"), Constant(64), "text", dim=16)
    return e.select("conv_id", "turn", F.size("vector").alias("n"), F.round(e.vector[0].cast("double"), 6).alias("first"), F.col("_model_name").alias("model"))


@query("SELECT count(*) AS n, 0 AS other FROM embeddings")
def dimension_guard(spark, d):
    """Vectors of the collection's length pass; the guard raises for others."""
    p = table(spark, d, "embeddings")
    dim = p.select(F.max(F.size("embedding"))).first()[0]
    vector.check_dimension(p, dim, "embedding")
    try:
        vector.check_dimension(p, dim + 1, "embedding")
        raise AssertionError("the guard is silent")
    except ValueError:
        return p.agg(F.count("*").alias("n"), F.count(F.when(F.size("embedding") != dim, 1)).cast("int").alias("other"))


# trees and outputs

@query("SELECT p_partkey AS doc, 'src/' || p_partkey || '.py:' || line || ':' || first AS shown FROM part, (VALUES (10, 'async def f')) t(line, x), LATERAL (SELECT x || p_partkey || '():' AS first)")
def grep_output(spark, d):
    e = element_table(sources(spark, d, "python"), "doc", "text", "kind", ["type", "name", "line_start", "content"]).where((F.col("type") == "function") & F.startswith("name", F.lit("f")))
    return e.select("doc", output.grep_line(F.concat(F.lit("src/"), F.col("doc").cast("string"), F.lit(".py")), F.col("line_start"), F.col("content")).alias("shown"))


@query("SELECT p_partkey AS doc, '{\"doc\":' || p_partkey || ',\"name\":\"C' || p_partkey || '\",\"parent_id\":null}' AS shown FROM part")
def json_output(spark, d):
    e = element_table(sources(spark, d, "python"), "doc", "text", "kind", ["type", "name", "parent_id"]).where("type = 'class'").select("doc", "name", "parent_id")
    return e.select("doc", output.json_line(e).alias("shown"))


@query("SELECT p_partkey AS doc, unnest(['class', 'function']) AS type, unnest(['C' || p_partkey, 'm']) AS name FROM part")
def elements_at_line(spark, d):
    """Elements that line 7 of every source lies in."""
    e = element_table(sources(spark, d, "python"), "doc", "text", "kind", ["type", "name", "line_start", "line_end"])
    return e.where("7 between line_start and line_end").select("doc", "type", "name")


@query("SELECT p_partkey AS doc, 2::BIGINT AS n, true AS distinct FROM part")
def server_chunks(spark, d):
    """Chunks without the filter of covered containers, named by line and trail."""
    t = spread(table(spark, d, "part").select("p_partkey")).select("p_partkey", F.concat(F.lit("impl S"), F.col("p_partkey").cast("string"), F.lit(" {\n    fn m(&self) {}\n}\n")).alias("text"), F.lit("rust").alias("kind"))
    return tree.chunk_table(t, "p_partkey", "text", "kind", None, True, ["id"]).groupBy("doc").agg(F.count("*").alias("n"), (F.countDistinct("id") == F.count("*")).alias("distinct"))


@query("SELECT p_partkey AS doc, CASE WHEN p_partkey % 2 = 0 THEN '' ELSE 'enums' END AS missing FROM part")
def schema_validation(spark, d):
    """Trees of Rust, from every second of which a required field is taken."""
    u = tree.unified_table(sources(spark, d, "rust"), "doc", "text", "kind")
    j = F.when(F.col("doc") % 2 == 0, F.col("json")).otherwise(F.replace("json", F.lit('"enums":'), F.lit('"others":')))
    return u.select("doc", F.array_join(schema.missing_fields(j, F.lit("rust")), ",").alias("missing"))


_FIELD_ROWS = ", ".join(f"('{k}', '{f}', '{e}', {f in REQUIRED[k]})" for k, fields in FIELDS.items() for e, f in fields.items())


@query(f"SELECT * FROM (VALUES {_FIELD_ROWS}) t(file_type, field, element_type, required)")
def schema_fields(spark, d):
    return schema.field_table(spark)


@query("SELECT 'function_call' AS usage_type, sum(p_size % 4)::BIGINT AS n, (max(p_size % 4) > 0)::BIGINT AS symbols FROM part HAVING sum(p_size % 4) > 0")
def usage_calls(spark, d):
    """Calls that Python sources make, counted."""
    return tree.usage_counts(tree.usage_table(sources(spark, d, "python"), "doc", "text", "kind", "calls", ["symbol_name", "usage_type"]))


@query("SELECT event_id, CASE WHEN k >= 90 THEN 'ERROR' WHEN k >= 50 THEN 'WARN' ELSE 'INFO' END AS level, 'GET /' || event_type || ' ' || s AS message, k AS bytes FROM (SELECT *, (props->>'$.k')::BIGINT AS k, CASE WHEN (props->>'$.k')::BIGINT >= 90 THEN 500 WHEN (props->>'$.k')::BIGINT >= 50 THEN 404 ELSE 200 END AS s FROM events)")
def access_logs(spark, d):
    """Access lines as records, in columns alone."""
    k = F.get_json_object("props", "$.k").cast("long")
    status = F.when(k >= 90, "500").when(k >= 50, "404").otherwise("200")
    line = F.concat(F.lit('1.2.3.4 - bob [13/Jan/2026:21:29:00 +0000] "GET /'), "event_type", F.lit(' HTTP/1.1" '), status, F.lit(" "), k.cast("string"), F.lit(' "-" "x"'))
    e = table(spark, d, "events").select("event_id", normalize.access_log(line).alias("r"))
    return e.select("event_id", "r.level", "r.message", F.col("r.data.body_bytes").alias("bytes"))


# streams

def _stream(spark, d, name: str) -> DataFrame:
    s = spark.readStream.schema(table(spark, d, name).schema).option("pathGlobFilter", f"{name}.parquet").parquet(d)
    return s.withColumn("ts", F.col("ts").cast("timestamp"))


def _drained(spark, stream: DataFrame, mode: str) -> DataFrame:
    """What a stream gives until its input ends, as a table in the shared folder."""
    folder = f"{_store(spark).root}/stream"

    def keep(batch: DataFrame, n: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(f"{folder}/out")

    stream.writeStream.outputMode(mode).option("checkpointLocation", f"{folder}/state-{uuid.uuid4().hex}").trigger(availableNow=True).foreachBatch(keep).start().awaitTermination()
    return spark.read.parquet(f"{folder}/out")


@query("SELECT event_id, event_type FROM events")
def stream_dedupe(spark, d):
    """Every event twice in one stream; each comes out once."""
    s = _stream(spark, d, "events")
    return _drained(spark, streams.dedupe(s.unionByName(_stream(spark, d, "events")), ["event_id", "event_type", "props"], "ts", "30 days").select("event_id", "event_type"), "append")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def stream_window_counts(spark, d):
    out = streams.windowed_counts(_stream(spark, d, "events"), "ts", "event_type", "1 hour", "10 minutes")
    return _drained(spark, out, "complete").select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n")
