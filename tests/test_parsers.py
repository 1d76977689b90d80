from __future__ import annotations

from pyspark.sql import functions as F

from strataq.parsers import code, convert, element_table, markup, parse
from strataq.parsers.tree import chunks_of
from strataq.sources import detection, files


def names(elements, kind):
    return [e.name for e in elements if e.type == kind]


def test_rust():
    src = '// top\nuse std::io;\n\n/// Adds.\npub fn add(a: i32) -> i32 {\n  let s = "}";\n  a\n}\nfn hidden() {}\npub struct P { x: i32 }\nimpl Show for P {\n  fn show(&self) { if true {} }\n}\nmod inner {\n  fn deep() {}\n}\n'
    got = parse(src, "rust")
    assert names(got, "function") == ["add", "hidden"] and names(got, "struct") == ["P"] and names(got, "import") == ["std::io"]
    add = got[1]
    assert add.attributes["visibility"] == "pub" and add.attributes["docstring"] == "Adds." and (add.line_start, add.line_end) == (5, 8)
    assert names(got, "implementation") == ["impl Show for P"] and [c.name for c in got[4].children] == ["show"] and [c.name for c in got[5].children] == ["deep"]
    doc = convert(got, "rust", "a.rs", src)
    assert [f["name"] for f in doc["functions"]] == ["add", "hidden", "show", "deep"] and doc["functions"][2]["attributes"]["crumbtrail"] == "impl Show for P"


def test_python():
    src = '"""m"""\nimport os as o\nfrom a import b\nX: int = 1\nclass A(B):\n    """doc"""\n    def m(self, x: int) -> str:\n        return foo(x).bar\nasync def f():\n    pass\n'
    got = parse(src, "python")
    assert names(got, "class") == ["A"] and [c.name for c in got[3].children] == ["m"] and names(got, "function") == ["f"] and names(got, "variable") == ["X"]
    assert got[0].attributes == {"module": "os", "name": "os", "alias": "o", "level": 0} and got[-1].attributes["is_async"]
    assert ("function_call", "foo") in [(u.type, u.name) for u in code.python_usages(src)]
    assert [c["crumbtrail"] for c in chunks_of(got, "d")][-2:] == ["A::m", "f"]


def test_brace_languages():
    c = parse('#include <stdio.h>\n#define N 3\ntypedef struct { int a; char *b; } pair;\nint main(int argc, char **argv) {\n  return 0;\n}\nstatic int g = 1;\n', "c")
    assert names(c, "import") == ["stdio.h"] and names(c, "struct") == ["pair"] and names(c, "function") == ["main"] and [f.name for f in c[2].children] == ["a", "b"]
    cpp = parse("namespace n {\nclass K {\n public:\n  int get() const { return 1; }\n};\n}\nvoid K2::run(int x) { }\n", "cpp")
    assert names(cpp, "namespace") == ["n"] and cpp[0].children[0].type == "class" and names(cpp, "function") == ["K2::run"]
    cu = parse("__global__ void kern(float* a) { }\n__device__ float d(float x) { return x; }\nint host() { return 1; }\n", "cuda")
    assert [e.type for e in cu] == ["kernel", "device_function", "function"]
    go = parse('package main\nimport (\n  "fmt"\n  x "os"\n)\ntype S struct { a int }\ntype I interface { F() }\nfunc (s *S) Do() { }\nfunc main() { }\n', "go")
    assert names(go, "import") == ["fmt", "os"] and names(go, "struct") == ["S"] and names(go, "interface") == ["I"] and names(go, "function") == ["Do", "main"]
    sh = parse("#!/bin/bash\nA=1\nf() {\n  B=2\n}\nfunction g {\n :\n}\n", "bash")
    assert names(sh, "function") == ["f", "g"] and names(sh, "variable") == ["A"]


def test_markup():
    md = parse("# T *x*\n\npara **b** [l](u \"t\")\n\n- [x] done\n- two\n\n```py\ncode\n```\n\n> q\n\n| a | b |\n|---|---|\n| 1 | 2 |\n\n---\n[^1]: note\n", "markdown")
    kinds = [e.type for e in md]
    assert kinds[:2] == ["emphasis", "header"] and {"paragraph", "strong", "link", "list", "list_item", "code_block", "blockquote", "table", "horizontal_rule", "footnote_definition"} <= set(kinds)
    html = parse("<div class=a><p>x<br>y<img/></p><ul><li>1</ul></div><p>open", "html")
    assert [e.name for e in html] == ["div", "p"] and html[0].children[0].content == "x<br>y<img/>" and [c.name for c in html[0].children[0].children] == ["br"]
    assert names(parse('{"a": 1, // c\n "b": [1, 2,]}', "json"), "block") == ["b"]
    toml = parse('x = 1\n[package]\nname = "n"\n[[bin]]\np = 1\n', "toml")
    assert [(e.type, e.name, e.line_start) for e in toml] == [("variable", "x", 1), ("block", "package", 2), ("block", "bin[0]", 1)]
    assert parse("", "text") == [] and parse("not [toml", "toml")[0].type == "block"
    assert markup.text("a\nb")[0].line_end == 2


def test_element_table(spark):
    docs = spark.createDataFrame([(1, "class A:\n    def m(self):\n        pass\n", "python"), (2, None, "text"), (3, "x", None)], "id long, text string, kind string")
    rows = sorted((r.doc, r.elem_id, r.parent_id, r.depth, tuple(r.path)) for r in element_table(docs, "id", "text", "kind").collect())
    assert rows == [(1, 0, None, 0, ("A",)), (1, 1, 0, 1, ("A", "m")), (3, 0, None, 0, ("block",))]


def test_detection(spark):
    df = spark.createDataFrame([("a/b.RS", ""), ("x.resolved.3", "#!/usr/bin/env python3\n"), ("y.py.resolved.2", ""), ("z", "hello"), ("n.h", "#include")], "path string, text string")
    got = {r.path: r.t for r in df.select("path", detection.detect(F.col("path"), F.col("text"))["file_type"].alias("t")).collect()}
    assert got == {"a/b.RS": "rust", "x.resolved.3": "python", "y.py.resolved.2": "python", "z": "unknown", "n.h": "c"}
    assert detection.likely_text(b"") and not detection.likely_text(b"a\0b")


def test_files(spark, tmp_path):
    for name, text in {"a/x.py": "1", "a/y.txt": "2", "b/z.py": "3", "skip/w.py": "4", ".gitignore": "skip/\n*.txt\n!keep.txt\n", "keep.txt": "5"}.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    found = files.scan(spark, str(tmp_path))
    assert sorted(r.rel_path for r in found.collect()) == [".gitignore", "a/x.py", "b/z.py", "keep.txt"]
    py = files.select_files(found, ["PY"], ["b/**"])
    assert [r.rel_path for r in py.collect()] == ["a/x.py"]
    state = files.changed(found, None).select("rel_path", "meta_hash")
    assert files.changed(found, state).count() == 0
    meta = files.with_metadata(py, [r"(?P<dir>\w+)/.*"], {"language": "own"}).first().metadata
    assert meta["dir"] == "a" and meta["language"] == "own" and meta["source_type"] == "file"
    (tmp_path / "r.ndjson").write_text('{"a": 1}\nbad\n{"a": 2}\n')
    assert [r.value for r in files.records(spark, str(tmp_path / "r.ndjson")).orderBy("in_pos").collect()] == ['{"a": 1}', '{"a": 2}']
    assert files.flatten_json({"b": [1, {"c": "x"}]}) == ["b[0]: 1", "b[1].c: x"]
    assert files.pack_lines(["aa", "b", "c"], 4) == ["aa\nb", "c"]


def test_history_yaml_and_items(spark, tmp_path):
    import subprocess

    from strataq.sources import history

    repo = tmp_path / "repo"
    repo.mkdir()
    git = lambda *a: subprocess.run(["git", "-C", str(repo), "-c", "user.name=t", "-c", "user.email=t@t", *a], check=True, capture_output=True)
    git("init", "-q")
    (repo / "a.txt").write_text("one")
    git("add", ".")
    git("commit", "-qm", "first")
    (repo / "a.txt").write_text("two")
    git("commit", "-qam", "second")
    row = history.scan(spark, str(repo), "HEAD~1", str(tmp_path / "out")).first()
    assert bytes(row.content) == b"one" and row.git_ref == "HEAD~1" and len(row.commit_sha) == 40 and history.head(str(repo)) != row.commit_sha
    assert files.flatten_yaml("a: [1, x]\n---\nb: 2\n") == ["doc[0].a[0]: 1", "doc[0].a[1]: x", "doc[1].b: 2"]
    df = spark.createDataFrame([(1, '[{"id": 1, "time": "t"}, {"id": 2}]'), (2, '{"a": 1}')], "id long, j string")
    assert [(r.id, r.stream_index, r.timestamp) for r in files.json_items(df, "id", "j").collect()] == [(1, 0, "t"), (1, 1, None)]


def test_tags_that_are_never_closed(spark, tmp_path):
    from strataq.queries import QUERIES

    deep = "<p>" + "<b>x<i>" * 1500 + '<a href="/end">' + "</p><u>"
    wide = "<p>x</p>" * 100_010
    spark.createDataFrame([(1, deep), (2, wide), (3, None)], "page_id long, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = {(r.doc, r.name): r.n for r in QUERIES["html_elements"](spark, str(tmp_path)).collect()}
    assert got == {(1, "p"): 1, (1, "b"): 1500, (1, "i"): 1500, (1, "a"): 1, (1, "u"): 1, (2, "p"): 100_010}
    assert [tuple(r) for r in QUERIES["link_extract"](spark, str(tmp_path)).collect()] == [(1, "/end")]
    top = parse(deep, "html")
    assert [e.name for e in top] == ["p", "u"] and [e.line_start for e, depth, _ in top[0].walk() if depth == 3001] == [1]
    assert [e["name"] for e in convert(top, "html")["elements"]][:2] == ["a", "i"] and top[0].children[0].content.startswith("x<i><b>x")


def test_element_table_by_columns(spark):
    docs = spark.createDataFrame([(1, "<p>a<b>c</b></p><p>d</p>", "html"), (None, "x = 1", "python"), (3, None, None)], "id long, text string, kind string")
    every = element_table(docs, "id", "text", "kind")
    for columns in (["name"], ["parent_id", "path"], ["content", "line_end"]):
        some = element_table(docs, "id", "text", "kind", columns)
        assert set(some.columns) == {"doc", *columns} and sorted(map(str, some.collect())) == sorted(map(str, every.select(*some.columns).collect()))
