"""Ingest of large files, JSON and YAML, memory, streams and revisions; jobs, profiles and outputs."""

from __future__ import annotations

import io
import json
import subprocess

import pytest

from strataq.functions.embed import Hashed
from strataq.operators import catalog
from strataq.plans import ingest
from strataq.sources import files


def test_json5_flattens():
    text = "{ // note\n a: 1, 'b': 'it\\'s', c: [0x1F, +2, .5,], /* x */ \"d\": {e: null,}, }"
    assert files.lenient_json(text) == {"a": 1, "b": "it's", "c": [31, 2, 0.5], "d": {"e": None}}
    assert files.flatten_json({"a": {"b": [1, "x"]}}) == ["a.b[0]: 1", "a.b[1]: x"]
    assert len(files.flatten_json(list(range(200)), most=None)) == 200 and files.flatten_json(list(range(200)), most=3)[-1] == "... (truncated)"
    with pytest.raises(ValueError):
        files.lenient_json("{a: }")


def test_large_files_are_read_in_segments(spark, tmp_path):
    functions = [f"def f{i}(x):\n    return x + {i}\n\n" for i in range(400)]
    (tmp_path / "big.py").write_text("".join(functions))
    (tmp_path / "small.py").write_text("def g():\n    pass\n")
    found = files.scan(spark, str(tmp_path))
    o = ingest.Options(large_bytes=2000, segment_bytes=1500, overlap_bytes=300)
    parts = files.segments(found.where("rel_path = 'big.py'"), 2000, 1500, 300).orderBy("segment").collect()
    raw = (tmp_path / "big.py").read_bytes()
    assert all(bytes(p.content) == raw[p.segment * 1200 : p.segment * 1200 + 1500] for p in parts) and parts[-1].segment * 1200 + 1500 >= len(raw)
    rows = ingest.chunk_files(files.with_metadata(found), o).collect()
    got = [r.content for r in rows if r.metadata["path"] == "big.py"]
    assert all(any(f.strip() in g for g in got) for f in functions) and len(set(got)) == len(got)
    assert [r.content for r in rows if r.metadata["path"] == "small.py"] == ["def g():\n    pass"]


def test_flatten_strategy_push_stream_and_revision(spark, tmp_path):
    src, root = tmp_path / "src", str(tmp_path / "store")
    src.mkdir()
    (src / "a.json").write_text('{"name": "cats", // note\n "tags": ["x", "y"],}')
    (src / "b.yaml").write_text("k: v\n---\nz: [1, 2]\n")
    (src / "c.py").write_text("def a():\n    return 1\n\n\ndef b():\n    return 2\n")
    lib = ingest.Library(spark, root, Hashed(32))
    lib.ingest(str(src), "flat", ingest.Options(flatten=True, structural=False, strategy="code_aware", chunk_size=10))
    got = {r.metadata["path"]: r.content for r in lib.store.points("flat").collect()}
    assert got["a.json"] == "name: cats\ntags[0]: x\ntags[1]: y" and "doc[1].z[0]: 1" in got["b.yaml"]
    n = lib.push("some text in memory\n" * 200, "flat", {"topic": "t"})
    assert n == 2 and lib.push("some text in memory\n" * 200, "flat", {"topic": "t"}) == 0
    assert lib.push_stream(io.StringIO("from a stream"), "flat") == 1
    assert {r.metadata.get("source") for r in lib.store.points("flat").collect()} == {None, "memory", "stdin"}
    git = lambda *a: subprocess.run(["git", "-C", str(src), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True, text=True).stdout.strip()
    git("init", "-q")
    git("add", ".")
    git("commit", "-qm", "one")
    sha = git("rev-parse", "HEAD")
    (src / "c.py").write_text("changed = 1\n")
    lib.ingest_revision(str(src), "HEAD", "old", str(tmp_path / "unpacked"))
    rows = lib.store.points("old").collect()
    assert {r.metadata["commit_sha"] for r in rows} == {sha} and any("return 2" in r.content for r in rows)
    lib.ingest(str(src), "new")
    assert {r.metadata["commit_sha"] for r in lib.store.points("new").collect()} == {sha}
    lib.store.delete("new", "new-DELETE")
    assert lib.ingest(str(src), "new")["processed"] == 3
    lib.store.set_collection_id("new", "another")
    assert lib.ingest(str(src), "new")["processed"] == 3
    masked = spark.createDataFrame([("c.py",)], "rel_path string")
    prompt = ingest.assemble_context(lib.search("return", "old"), "why?", files=files.scan(spark, str(src)), masked=masked)
    assert "PRIVATE_KNOWLEDGE_SOURCE_1" in prompt and "## c.py" not in prompt and '"name": "cats", // note' in prompt
    assert ingest.project_tree(["b.txt", "a/x/y/z.py", "a/w.py"]) == "a/\n  x/\n    y/\n  w.py\nb.txt"


def test_writers_never_lose_an_update(spark, tmp_path):
    s = catalog.Store(spark, str(tmp_path))
    s.create("c", 1)
    point = lambda i: spark.createDataFrame([(i, [1.0])], "id long, vector array<float>")
    for i in range(3):
        s.upsert("c", point(i))
    path = tmp_path / "c" / "_log" / "00000099.json"
    path.write_text('{"name": "c", "par')  # a writer that was lost
    assert sorted(r.id for r in s.points("c").collect()) == [0, 1, 2]
    calls = []

    def change(e):
        if not calls:
            calls.append(1)
            s.upsert("c", point(7))  # another writer is faster
        return e | {"quantization": "scalar"}

    s._change("c", change)
    assert s.entry("c")["quantization"] == "scalar" and sorted(r.id for r in s.points("c").collect()) == [0, 1, 2, 7]
    s.snapshot("c", "kept")
    for i in range(catalog.MOST_DELTAS + 1):
        s.upsert("c", point(i))
    assert len(s.entry("c")["parts"]) < catalog.MOST_DELTAS and s.points("c").count() == catalog.MOST_DELTAS + 1
    gone = s.vacuum("c", keep=1)
    assert gone and s.points("c").count() == catalog.MOST_DELTAS + 1
    s.download("c", "kept", str(tmp_path / "copy"))
    assert sorted(r.id for r in spark.read.parquet(str(tmp_path / "copy")).collect()) == [0, 1, 2, 7]
    assert json.loads((tmp_path / "c" / "_log" / "00000001.json").read_text())["dim"] == 1
