"""Directories of files as DataFrames, with ignore rules, filters and the state of earlier runs."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.facets import path_metadata
from . import detection


def _rules(lines: list[str]) -> list[tuple[bool, str]]:
    """(ignored, regular expression) per line of an ignore file; later rules win."""
    out = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keep = line.startswith("!")
        line = line.removeprefix("!")
        anchored = "/" in line.rstrip("/")
        body = detection.glob_regex(line.strip("/"))[1:-1]
        out.append((not keep, ("^" if anchored else "^(?:.*/)?") + body + "(?:/.*)?$"))
    return out


def ignored(path: Column, lines: list[str]) -> Column:
    """Whether a relative path is ignored by the rules of `lines`."""
    out = F.lit(False)
    for drop, pattern in _rules(lines):
        out = F.when(F.regexp_like(path, F.lit(pattern)), F.lit(drop)).otherwise(out)
    return out


def _read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for path in pdf["path"]:
            with open(path, "rb") as f:
                rows.append((path, pd.Timestamp(int(os.path.getmtime(path) * 1000), unit="ms"), os.path.getsize(path), f.read()))
        yield pd.DataFrame(rows, columns=["path", "modificationTime", "length", "content"])


def scan(spark: SparkSession, root: str, gitignore: bool = True, extra: tuple[str, ...] = (".ignore", ".vectorignore")) -> DataFrame:
    """path, rel_path, extension, length, modified, content of the files under a local or mounted `root`.

    Hidden files count; `.strataq` and `.git` directories don't.  Rules are those of the root's ignore files.
    """
    lines = [".strataq/", ".git/"]
    for name in (*((".gitignore",) if gitignore else ()), *extra):
        if os.path.exists(f"{root}/{name}"):
            with open(f"{root}/{name}") as f:
                lines += f.read().splitlines()
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    # Spark's own listing passes over names that begin with a dot or an underscore
    hidden = [os.path.join(d, f) for d, dirs, names in os.walk(root) for f in names if any(x[:1] in "._" for x in os.path.relpath(os.path.join(d, f), root).split(os.sep)) and not {".git", ".strataq"} & set(os.path.relpath(d, root).split(os.sep))]
    if hidden:
        files = files.unionByName(spark.createDataFrame([(h,) for h in hidden], "path string").mapInPandas(_read, files.schema))
    at = F.length(F.lit(os.path.abspath(root))) + 2
    plain = F.regexp_replace("path", "^file:/*", "/")
    df = files.select(plain.alias("path"), F.substr(plain, at).alias("rel_path"), F.col("length"), F.col("modificationTime").alias("modified"), "content")
    return df.where(~ignored(F.col("rel_path"), lines)).withColumn("extension", detection.extension(F.col("path")))


def select_files(files: DataFrame, extensions: list[str] | None = None, excludes: list[str] | None = None) -> DataFrame:
    """Files of some extensions (whatever the case) whose path and name match none of the globs of `excludes`."""
    if extensions:
        files = files.where(F.lower("extension").isin([x.lower().lstrip(".") for x in extensions]))
    for pattern in excludes or []:
        rx = F.lit(detection.glob_regex(pattern))
        files = files.where(~F.regexp_like("rel_path", rx) & ~F.regexp_like(F.element_at(F.split("rel_path", "/"), -1), rx))
    return files


def meta_hash(path: Column, length: Column, modified: Column) -> Column:
    """SHA-256 of path, length and time of change in seconds: tells whether a file changed without reading it."""
    return F.sha2(F.concat_ws("|", path, length.cast("string"), F.unix_timestamp(modified).cast("string")), 256)


def changed(files: DataFrame, state: DataFrame | None) -> DataFrame:
    """Files that `state` (rel_path, meta_hash) doesn't hold as they are."""
    files = files.withColumn("meta_hash", meta_hash(F.col("rel_path"), F.col("length"), F.col("modified")))
    return files if state is None else files.join(state.select("rel_path", "meta_hash"), ["rel_path", "meta_hash"], "left_anti")


def with_metadata(files: DataFrame, rules: list[str] | None = None, constants: dict[str, str] | None = None) -> DataFrame:
    """A `metadata` map: path, source_type, language, size_bytes, then named groups of path rules, then constants."""
    base = F.create_map(
        F.lit("path"), F.col("rel_path"), F.lit("source_type"), F.lit("file"), F.lit("full_path"), F.col("path"),
        F.lit("language"), detection.from_path(F.col("path")), F.lit("size_bytes"), F.col("length").cast("string"),
    )
    for more in (path_metadata(F.col("rel_path"), rules or []), F.create_map(*[F.lit(x) for kv in (constants or {}).items() for x in kv]).cast("map<string,string>")):
        base = F.map_concat(_without(base, more), more)
    return files.withColumn("metadata", base)


def _without(base: Column, more: Column) -> Column:
    return F.map_filter(base, lambda k, v: ~F.array_contains(F.map_keys(more), k))


def records(spark: SparkSession, path: str) -> DataFrame:
    """in_pos, value (JSON text) of a file that is a JSON array or one value per line; bad lines are left out."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for raw in pdf["content"]:
                text = bytes(raw).decode("utf-8", "replace")
                try:
                    whole = json.loads(text)
                    items = whole if isinstance(whole, list) else [whole]
                except ValueError:
                    items = []
                    for line in text.splitlines():
                        try:
                            items.append(json.loads(line))
                        except ValueError:
                            continue
                yield pd.DataFrame({"in_pos": range(len(items)), "value": [json.dumps(x, ensure_ascii=False, sort_keys=True) for x in items]})

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(run, "in_pos long, value string")


def segments(files: DataFrame, large: int = 50 << 20, size: int = 5 << 20, overlap: int = 512 << 10) -> DataFrame:
    """`files` (…, content) with segment: -1 for a file of at most `large` bytes, else a row per `size` bytes, which begin `overlap`
    bytes before the end of those before them."""
    n = F.octet_length("content")
    at = F.when(n > large, F.sequence(F.lit(0), F.greatest(F.lit(0), n - overlap - 1), F.lit(size - overlap))).otherwise(F.array(F.lit(-1)))
    out = files.select("*", F.explode(at).alias("__at"))
    out = out.withColumn("content", F.when(F.col("__at") < 0, F.col("content")).otherwise(F.substr("content", F.col("__at") + 1, F.lit(size))))
    return out.withColumn("segment", F.when(F.col("__at") < 0, -1).otherwise((F.col("__at") / (size - overlap)).cast("int"))).drop("__at")


def within_depth(files: DataFrame, depth: int | None) -> DataFrame:
    """Files at most `depth` folders below the root: 0 is the root alone, None no bound."""
    return files if depth is None else files.where(F.size(F.split("rel_path", "/")) <= depth + 1)


def extension_counts(files: DataFrame, path_col: str = "path") -> DataFrame:
    """extension, n of files by path; those without an extension don't count."""
    return files.select(detection.extension(F.col(path_col)).alias("extension")).where("extension is not null").groupBy("extension").agg(F.count("*").alias("n"))


def dominant_language(files: DataFrame, path_col: str = "path") -> DataFrame:
    """language, n: the type of most files, ties by name; no row where no type is known."""
    found = files.select(detection.from_path(F.col(path_col)).alias("language")).where("language <> 'unknown'")
    return found.groupBy("language").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "language").limit(1)


def lenient_json(text: str):
    """A JSON value; failing that, one of JSON5: comments, trailing commas, bare keys, single quotes, signs, hexadecimals."""
    try:
        return json.loads(text)
    except ValueError:
        pass
    out, at = [], 0
    for m in _JSON5.finditer(text):
        out.append(text[at : m.start()])
        at = m.end()
        if m["comment"] or m["comma"]:
            continue
        if m["single"]:
            out.append(json.dumps(re.sub(r"\\(['\n])", lambda x: "" if x[1] == "\n" else x[1], m["single"][1:-1])))
        elif m["hex"]:
            out.append(str(int(m["hex"], 16)))
        elif m["key"]:
            out.append(json.dumps(m["key"]) + m["colon"])
        elif m["point"]:
            out.append(f"{m['sign'] or ''}0{m['point']}".replace("+", ""))
        elif m["plus"]:
            out.append(m["plus"][1:])
        else:
            out.append(m["double"])
    return json.loads("".join([*out, text[at:]]))


_JSON5 = re.compile(
    r"""(?P<double>"(?:\\.|[^"\\])*")|(?P<single>'(?:\\.|[^'\\])*')|(?P<comment>//[^\n]*|/\*.*?\*/)|(?P<comma>,(?=(?:\s|//[^\n]*|/\*.*?\*/)*[}\]]))"""
    r"""|(?P<key>[A-Za-z_$][\w$]*)(?P<colon>\s*:)|(?P<hex>0[xX][0-9a-fA-F]+)|(?P<sign>[+-])?(?<![\d.])(?P<point>\.\d+)|(?P<plus>\+\d)""",
    re.S,
)


def flatten_json(value, prefix: str = "", most: int | None = 100_000) -> list[str]:
    """`path: value` lines of a JSON value; after `most` of them, if that is given, a mark that it was cut."""
    out: list[str] = []

    def go(v, at: str) -> bool:
        if most is not None and len(out) >= most:
            return False
        if isinstance(v, dict):
            return all(go(v[k], f"{at}.{k}" if at else k) for k in sorted(v))
        if isinstance(v, list):
            return all(go(x, f"{at}[{i}]") for i, x in enumerate(v))
        out.append(f"{at}: {v if isinstance(v, str) else json.dumps(v)}")
        return True

    if not go(value, prefix):
        out.append("... (truncated)")
    return out


def pack_lines(lines: list[str], size: int) -> list[str]:
    """Lines joined to blocks of at least `size` characters, but for the last."""
    out, held, n = [], [], 0
    for line in lines:
        held.append(line)
        n += len(line) + 1
        if n >= size:
            out.append("\n".join(held))
            held, n = [], 0
    return [*out, "\n".join(held)] if held else out


def flatten_yaml(text: str, most: int | None = 100_000) -> list[str]:
    """`path: value` lines of a YAML text; of several documents each has the prefix `doc[i]`."""
    try:
        import yaml
    except ImportError as e:
        raise RuntimeError("YAML needs PyYAML") from e
    docs = [d for d in yaml.safe_load_all(text) if d is not None]
    plain = json.loads(json.dumps(docs, default=str))
    if len(plain) == 1:
        return flatten_json(plain[0], "", most)
    return [line for i, d in enumerate(plain) for line in flatten_json(d, f"doc[{i}]", most)]


def json_items(docs: DataFrame, id_col: str, json_col: str) -> DataFrame:
    """id, stream_index, item (JSON text), timestamp of the items of JSON arrays; anything but an array has none.

    timestamp: the first of `timestamp`, `time`, `created_at` that is a string.
    """
    items = F.from_json(F.col(json_col), "array<string>")
    out = docs.where(F.regexp_like(F.col(json_col), F.lit(r"^\s*\["))).select(id_col, F.posexplode(items).alias("stream_index", "item"))
    return out.withColumn("timestamp", F.coalesce(*[F.get_json_object("item", f"$.{k}") for k in ("timestamp", "time", "created_at")]))


def values(spark: SparkSession, path: str) -> DataFrame:
    """in_pos, value (JSON text) of files with one value a line, which are split among tasks; bad lines are left out."""
    lines = spark.read.text(path).where(F.try_parse_json("value").isNotNull())
    return lines.select(F.monotonically_increasing_id().alias("in_pos"), "value")


def flat_table(docs: DataFrame, id_col: str, text_col: str, kind: str = "json", size: int | None = None, most: int | None = None) -> DataFrame:
    """id, pos, line of the `path: value` lines of JSON or YAML texts, or with `size` their blocks; bad texts have none."""
    lines = {"json": lambda t: flatten_json(lenient_json(t), "", most), "yaml": lambda t: flatten_yaml(t, most)}[kind]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                try:
                    found = lines(text) if isinstance(text, str) else []
                except ValueError:
                    continue
                rows += [(key, i, x) for i, x in enumerate(pack_lines(found, size) if size else found)]
            yield pd.DataFrame(rows, columns=[id_col, "pos", "line"])

    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {dict(docs.dtypes)[id_col]}, pos int, line string")
