from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from strataq.functions import normalize
from strataq.functions.embed import Constant, Hashed, embed
from strataq.operators import assembly, chunking, facets, vector
from strataq.plans import ingest
from strataq.streaming import streams


def test_ingest_is_incremental(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "2024").mkdir()
    (src / "a.py").write_text("def add(a, b):\n    return a + b\n\ndef windows():\n    pass\n")
    (src / "2024" / "b.md").write_text("# Hello world\n\nsome text about cats\n")
    lib = ingest.Library(spark, root, Hashed(64))
    o = ingest.Options(path_rules=[r"(?P<year>\d{4})/.*"])
    first = lib.ingest(str(src), "c", o)
    assert first["seen"] == first["processed"] == 2 and first["chunks"] >= 4
    assert lib.store.snapshot("c", "first") == "first" == lib.store.snapshots("c")[0]
    assert lib.ingest(str(src), "c", o) == {"seen": 2, "processed": 0, "chunks": 0}
    time.sleep(1.1)
    (src / "a.py").write_text("def add(a, b):\n    return a + b\n\ndef linux():\n    pass\n")
    third = lib.ingest(str(src), "c", o)
    assert third["processed"] == 1 and third["chunks"] == 1
    top = lib.search("text about cats", "c", 3).collect()
    assert "cats" in top[0].content and top[0].metadata["year"] == "2024"
    assert {r.language for r in lib.search("python add", "c", 9, smart=True).collect()} == {"python"}
    assert lib.store.names() == ["c"] and lib.store.info("c").first()["dim"] == 64
    lib.store.set_quantization("c", "binary")
    lib.store.optimize("c")
    assert len(lib.store.points("c").first().quantized) == 64
    assert "# Question" in ingest.assemble_context(lib.search("cats", "c"), "why?")
    with pytest.raises(PermissionError):
        lib.store.delete("c", "c")
    lib.store.restore("c", "first")
    assert lib.store.points("c").count() == first["chunks"]
    lib.store.delete("c", "c-DELETE")
    assert not lib.store.exists("c")


def test_embed_and_dimension(spark):
    df = spark.createDataFrame([("a",), (None,)], "content string")
    got = embed(df, Constant(8), dim=4).collect()
    assert [len(r.vector) if r.vector else None for r in got] == [4, None]
    points = spark.createDataFrame([([1.0, 2.0],)], "vector array<float>")
    with pytest.raises(ValueError):
        vector.check_dimension(points, 3)
    with pytest.raises(TypeError):
        vector.equals({"a": 1.5})


def test_chunkers():
    text = "Line 1\n" * 100
    parts = [p for p, _, _ in chunking.simple(text, 50)]
    assert "".join(parts) == text and all(p.endswith("\n") and len(p) <= 50 for p in parts)
    assert len(list(chunking.simple("a" * 10_000, 1000))) == 10
    odd = "é" * 100 + "日" * 50
    assert "".join(p for p, _, _ in chunking.simple(odd, 7)) == odd and all(len(p.encode()) <= 7 for p, _, _ in chunking.simple(odd, 7))
    assert [p for p, _, _ in chunking.windows("abcdef", 4, 2)] == ["abcd", "cdef"]
    assert all(len(p) <= 20 for p in chunking.recursive("One two. Three four five. " * 9, 20))
    assert [p for p, _, _ in chunking.code("def a():\n  x\ndef b():\n  y\n", 10)] == ["def a():\n  x", "def b():\n  y"]


def test_late_split_and_uuid(spark):
    import uuid

    df = spark.createDataFrame([("k1", "x" * 10), ("k2", "short")], "chunk_id string, content string")
    got = sorted((r.original_chunk_id or "", r.split_part or 0, r.content) for r in chunking.late_split(df, 6).collect())
    assert got == [("", 0, "short"), ("k1", 0, "xxxxxx"), ("k1", 1, "xxxx")]
    name = spark.createDataFrame([("héllo",)], "n string").select(chunking.uuid5(chunking.NAMESPACE, F.col("n"))).first()[0]
    assert name == str(uuid.uuid5(chunking.NAMESPACE, "héllo"))


def test_assembly(spark):
    assert assembly.stitch_text("Hello world, this is a test", "is is a test of stitching.") == "Hello world, this is a test of stitching."
    assert assembly.stitch_text("Hello world", "Goodbye world") == "Hello worldGoodbye world"
    snaps = [("a.md.resolved.0", "- [ ] Item 1", 0), ("a.md.resolved.1", "- [x] Item 1", 1), ("b.resolved.0", "\n".join(f"l{i}" for i in range(10)), 2), ("b.resolved.1", "l0\n" + "\n".join("abcde"), 3), ("a.md.resolved.2", "- [x] Item 1", 4)]
    got = {(r.artifact, r.version): r for r in assembly.events(assembly.versions(spark.createDataFrame(snaps, "path string, content string, in_pos int"))).collect()}
    assert {k: (r.event, r.timeline) for k, r in got.items()} == {("a.md", 0): ("creation", "main"), ("a.md", 1): ("evolution", "branch_v1"), ("b", 0): ("creation", "main"), ("b", 1): ("evolution", "branch_v1")}
    assert got["a.md", 1].diff == "- - [ ] Item 1\n+ - [x] Item 1" and got["b", 1].deletion > 0.8 and got["b", 1].overlap < 0.2
    rows = spark.createDataFrame([(1, 0, "Hello world, this is"), (1, 1, "world, this is it"), (1, 2, "other"), (2, 0, None)], "k int, n int, content string")
    assert sorted((r.k, r.content) for r in assembly.stitch(rows, ["k"], ["n"]).collect() if r.content) == [(1, "Hello world, this is it"), (1, "other")]


def test_facets(spark):
    p = spark.createDataFrame([("c++", 1), ("c", 2), ("windows", 3), (None, 4)], "lang string, id int")
    assert facets.route("How do I build C++ on Windows", p, ["lang"]) == {"lang": "windows"}
    assert facets.route("in c++", p, ["lang"]) == {"lang": "c++"} and facets.route("cat", p, ["lang"]) == {}


def test_normalize(spark):
    df = spark.createDataFrame([('1.2.3.4 - bob [13/Jan/2026:21:29:00 +0000] "GET /x HTTP/1.1" 404 12 "-" "curl"', "M"), ("no", "?")], "line string, s string")
    a, b = df.select(normalize.access_log(F.col("line")).alias("r"), normalize.git_status(F.col("s")).alias("g")).collect()
    assert (a.r.level, a.r.message, a.g) == ("WARN", "GET /x 404", "MODIFIED") and b.r is None
    tasks = spark.createDataFrame([("x // TODO: fix crash\ny\n# XXX z",)], "t string").select(normalize.comment_tasks(F.col("t"))).first()[0]
    assert [(t.title, t.priority) for t in tasks] == [("fix crash", "high"), ("z", "medium")]


def test_streams(spark, tmp_path):
    rows = [(1, 1, "Hello world, this is", "2024-01-01 00:00:00"), (1, 2, "world, this is it", "2024-01-01 00:00:01"), (1, 3, "other words", "2024-01-01 00:00:02"), (1, 3, "other words", "2024-01-01 00:00:02")]
    df = spark.createDataFrame(rows, "k int, n int, content string, at string").withColumn("at", F.to_timestamp("at"))
    df.write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.noDataMicroBatches.enabled", "false")  # else the idle timeout keeps a query going
    source = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for name, out in (("deduped", streams.dedupe(source(), ["n", "content"], "at")), ("stitched", streams.stitch(source(), "k", "n"))):
        q = out.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60), name
        q.stop()
    assert spark.table("deduped").count() == 3
    assert "Hello world, this is it" in [r.text for r in spark.table("stitched").collect()]
