"""Schemas, generators, Markdown in HTML, outputs, profiles, jobs, embedders over HTTP, usages."""

from __future__ import annotations

import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer

import pytest

from strataq.functions import embed, output
from strataq.parsers import convert, parse, schema
from strataq.parsers.enrich import enrich
from strataq.parsers.generate import generate
from strataq.parsers.tree import chunks_of
from strataq.parsers.usages import usages_of
from strataq.plans import service


def test_round_trips_of_generators():
    value = {"a": 1, "b": [1, {"c": "x"}, []], "d": {}, "e": None}
    assert json.loads(generate(parse(json.dumps(value), "json"), "json")) == value
    for v in ([1, {"a": [2]}], "text", 5):
        assert json.loads(generate(parse(json.dumps(v), "json"), "json")) == v
    import tomllib

    text = 'title = "t"\nn = [1, 2]\n\n[owner]\nname = "n"\ndeep = { x = 1 }\n\n[[many]]\nk = 1\n\n[[many]]\nk = 2\n'
    assert tomllib.loads(generate(parse(text, "toml"), "toml")) == tomllib.loads(text)
    rust = "fn a() {\n}\n\nstruct S {\n    x: i32,\n}\n"
    assert generate(parse(rust, "rust"), "rust") == rust
    with pytest.raises(ValueError):
        generate([], "go")


def test_schemas(spark):
    good = convert(parse("def f(): pass", "python"), "python")
    assert schema.missing(good, "python") == [] and schema.missing({"functions": []}, "python") == ["metadata", "classes", "imports"]
    d = spark.createDataFrame([(json.dumps(good), "python"), ('{"functions": []}', "rust"), ("bad", "rust")], "j string, k string")
    assert [r.m for r in d.select(schema.missing_fields(d.j, d.k).alias("m")).collect()] == [[], ["metadata", "structs", "enums"], None]
    assert schema.fields_of("go") == ["functions", "imports", "interfaces", "package", "structs"] and "attributes.receiver" in schema.fields_of("go", "functions")
    assert schema.suggest("functon", "rust")[0] == "functions"
    with pytest.raises(KeyError):
        schema.fields_of("pyton")
    assert schema.field_table(spark).where("file_type = 'c' and required").count() == 2


def test_markdown_in_html():
    page = '<html>\n<body>\n<div class="markdown">\n# Head\n\n- item\n</div>\n<p>- a **b** [c](d)</p><p>plain</p></body></html>'
    out = enrich(parse(page, "html"))
    found = [(e.type, e.name, e.line_start) for top in out for e, _, _ in top.walk()]
    assert ("header", "Head", 4) in found and ("list_item", None, 6) in found and ("link", "c", 8) in found
    assert sum(t == "paragraph" for t, _, _ in found) == 0


def test_outputs():
    e = [{"type": "function", "name": "f", "content": "def f():\n  pass", "line_start": 3, "attributes": {"x": 1}}]
    assert output.format_results(e, "grep", path="a.py") == "a.py:3:def f():"
    assert output.format_results(e, "grep", path="a.py", template="{name}@{line}") == "f@3"
    assert output.format_results(["a", {"b": 1}], "json", compact=True, raw=True) == 'a\n{"b":1}'
    assert output.format_results([e], "human").splitlines()[0].split() == ["type", "name", "content", "line_start"]
    assert output.with_file_path({"k": e}, "p")["k"][0]["attributes"] == {"x": 1, "file_path": "p"}
    assert output.chosen_format("grep") == "grep" and output.chosen_format(stream=object()) == "json"
    with pytest.raises(ValueError):
        output.chosen_format("xml")


def test_server_ids_keep_covered_elements():
    tree = parse("impl S {\n    fn m(&self) {}\n}\n", "rust")
    assert len(chunks_of(tree, "d", None, by_line=True)) == 2
    assert chunks_of(tree, "d", None, by_line=True)[0]["id"] != chunks_of(tree, "d", None)[0]["id"]


def test_usages_of_rust_and_go():
    rust = "use std::fs::File;\nfn f(x: u32) -> Option<u32> {\n    let y = g(x);\n    y.map(h);\n    println!(\"g\");\n    Some(y)\n}\n"
    got = {(u.attributes["symbol_name"], u.attributes["usage_type"], u.attributes["context"]) for u in usages_of(rust, "rust")}
    assert {("File", "import_usage", None), ("g", "function_call", "f"), ("map", "method_call", "f"), ("y", "assignment", "f"), ("h", "variable_reference", "f"), ("u32", "type_reference", "f"), ("println", "function_call", "f")} <= got
    go = 'package p\n\nimport "net/http"\n\nfunc F(a int) error {\n\tx := g(a)\n\tx = 2\n\treturn c.Do(x)\n}\n'
    got = {(u.attributes["symbol_name"], u.attributes["usage_type"], u.attributes["context"]) for u in usages_of(go, "go")}
    assert {("http", "import_usage", None), ("g", "function_call", "F"), ("x", "assignment", "F"), ("Do", "method_call", "F"), ("x", "variable_reference", "F"), ("int", "type_reference", "F")} <= got
    assert usages_of("def (", "python") == [] and usages_of("x", "text") == []


def test_profiles_jobs_and_service(spark, tmp_path):
    (tmp_path / "c.toml").write_text('default_profile = "p"\n[profiles.p]\nembedder = "constant"\ndimension = 4\n[profiles.q]\ndimension = 8\nchunk_size = 100\n[collections.x]\nname = "real"\nprofile = "q"\nchunk_size = 50\n')
    c = service.Config.load(str(tmp_path / "c.toml"))
    assert c.resolve() == ("default", service.Profile("constant", 4)) and c.resolve()[1].max_chunk_bytes == 2048
    name, p = c.resolve("x")
    assert (name, p.dimension, p.max_chunk_bytes) == ("real", 8, 200) == (c.resolve("real")[0], c.resolve("real")[1].dimension, 200)
    assert c.resolve("x", "p")[1].dimension == 4
    with pytest.raises(KeyError):
        c.resolve("x", "none")
    src = tmp_path / "src"
    src.mkdir()
    (src / "a.md").write_text("# cats\n\nabout cats\n")
    s = service.Service(spark, str(tmp_path / "root"), c)
    out = s.ingest_path(str(src), "x")
    assert out["processed"] == 1 and s.get_job_status(out["job"])["status"] == "done"
    assert s.search_vectors("cats", "x", 1).count() == 1 and s.library("x")[1] is s.library("real")[1]
    assert [tuple(r) for r in s.list_collections("x").select("name", "is_compatible").collect()] == [("real", True)]
    job = s.jobs.start("ingest", "x")
    s.jobs.update(job, pid=2**22 + 1)
    assert s.jobs.running() == [] and s.status()["collections"] == ["real"] and len(s.embed(["a", "b"], "x")) == 2
    s.delete_collection("real", "real-DELETE")
    assert s.status()["collections"] == []


def test_embedder_over_http():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            texts = json.loads(self.rfile.read(int(self.headers["Content-Length"])))["input"]
            refused = len(texts) > 1 and "odd" in texts
            self.send_response(500 if refused else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"embeddings": [[float(len(t)), 1.0] for t in texts]}).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    e = embed.Http(f"http://127.0.0.1:{server.server_port}/", "m", 2, batch=2)
    assert e.embed_batch(["a", "bb", "odd", "dddd", "e"]) == [[1.0, 1.0], [2.0, 1.0], [3.0, 1.0], [4.0, 1.0], [1.0, 1.0]]
    embed.probe(e)
    e.dimension = 3
    with pytest.raises(ValueError):
        embed.probe(e)
    server.shutdown()
