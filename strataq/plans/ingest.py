"""Ingest: files to chunks to vectors to a collection, skipping what is stored already.

The plan is one DataFrame: unchanged files leave by an anti-join on their metadata, stored chunks by an anti-join on their
ids, both ahead of the embedder.  Ids come from content, so a second run stores nothing twice.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.embed import Embedder, embed
from ..operators import catalog, chunking, facets, vector
from ..parsers import parse
from ..parsers.tree import chunks_of
from ..sources import detection, files, history

CHUNK = "id string, document_id string, content string, chunk_index int, line_start int, line_end int, crumbtrail string, element string"


@dataclass
class Options:
    extensions: list[str] | None = None
    excludes: list[str] | None = None
    gitignore: bool = True
    path_rules: list[str] = field(default_factory=list)
    metadata: dict[str, str] = field(default_factory=dict)
    max_chunk_bytes: int = 2048
    #: Whether known types are cut into their elements; without it, by `strategy`.
    structural: bool = True
    strategy: str = "recursive"
    chunk_size: int = 512
    #: Whether JSON and YAML become `path: value` lines instead of elements.
    flatten: bool = False
    large_bytes: int = 50 << 20
    segment_bytes: int = 5 << 20
    overlap_bytes: int = 512 << 10


def _pieces(rel: str, path: str, kind: str, text: str, o: Options) -> Iterator[dict]:
    """Chunks of one text before they are cut to size: content, crumbtrail, type, line_start."""
    suffix = path.rsplit(".", 1)[-1].lower()
    if o.flatten and suffix in ("json", "yaml", "yml"):
        try:
            lines = files.flatten_json(files.lenient_json(text)) if suffix == "json" else files.flatten_yaml(text)
            size = max(1000, len(text) // 500) if suffix == "json" else 1000
            yield from ({"content": x, "crumbtrail": None, "type": "lines", "line_start": 1} for x in files.pack_lines(lines, size))
            return
        except ValueError:
            pass
    if kind != "unknown" and o.structural:
        yield from chunks_of(parse(text, kind), rel)
        return
    cut = chunking.strategy_of(kind, o.strategy)
    options = {"most": o.max_chunk_bytes} if cut == "simple" else {"size": o.chunk_size, "sizer": chunking.tokens_of} if cut in ("recursive", "semantic") else {"size": o.chunk_size}
    for content, _, line in chunking.STRATEGIES[cut](text, **options):
        yield {"content": content, "crumbtrail": None, "type": "block", "line_start": line}


def chunk_files(found: DataFrame, o: Options | int = 2048) -> DataFrame:
    """Chunks of files (rel_path, path, content, metadata): elements of structural types, windows of all else, none of
    binary files; each at most `max_chunk_bytes` long.

    Files above `large_bytes` are read in segments that overlap, each a row of its own; of chunks with equal content in a file the
    first stays, and lines count from the segment's start.
    """
    o = o if isinstance(o, Options) else Options(max_chunk_bytes=o)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [x.split()[0] for x in CHUNK.split(", ")] + ["segment"]
        for pdf in batches:
            rows = []
            for rel, path, kind, raw, segment in zip(pdf["rel_path"], pdf["path"], pdf["kind"], pdf["content"], pdf["segment"]):
                raw = bytes(raw)
                if not detection.likely_text(raw[:8192]):
                    continue
                text = raw.decode("utf-8", "ignore" if segment >= 0 else "replace")
                doc = str(uuid.uuid5(chunking.NAMESPACE, rel))
                n = 0
                for c in _pieces(rel, path, kind, text, o):
                    for part, _, line in chunking.simple(c["content"], o.max_chunk_bytes):
                        first = c["line_start"] + line - 1
                        place = n if segment < 0 else hashlib.sha256(part.encode()).hexdigest()  # a segment's chunks are named by content
                        rows.append((str(uuid.uuid5(chunking.NAMESPACE, f"{rel}::{c['crumbtrail']}::{place}::{part}")), doc, part, n, first, first + part.count("\n"), c["crumbtrail"], c["type"], segment))
                        n += 1
            yield pd.DataFrame(rows, columns=names)

    typed = found.withColumn("kind", detection.from_path(F.col("path"))).withColumn("document_id", chunking.uuid5(chunking.NAMESPACE, F.col("rel_path")))
    parts = files.segments(typed.select("rel_path", "path", "kind", "content"), o.large_bytes, o.segment_bytes, o.overlap_bytes)
    made = parts.mapInPandas(run, f"{CHUNK}, segment int")
    small = made.where("segment < 0")
    digest = F.when(F.col("segment") >= 0, chunking.content_hash(F.col("content")))
    first = made.where("segment >= 0").withColumn("nth", F.row_number().over(Window.partitionBy("document_id", digest).orderBy("segment", "chunk_index"))).where("nth = 1").drop("nth")
    return small.unionByName(first).drop("segment").join(typed.select("document_id", "metadata"), "document_id")


@dataclass
class Library:
    """Collections with an embedder: ingest, search, and what the catalog knows."""

    spark: SparkSession
    root: str
    embedder: Embedder

    @property
    def store(self) -> catalog.Store:
        return catalog.Store(self.spark, self.root)

    def _state(self, name: str) -> DataFrame | None:
        """The files that runs have processed, as far as they belong to the collection as it is: one that was made anew has none."""
        path = f"{self.root}/{name}/state"
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        if not p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p):
            return None
        return self.spark.read.parquet(path).where(F.col("collection_id") == self.store.collection_id(name))

    def ingest(self, path: str, name: str, options: Options | None = None) -> dict[str, int]:
        """Store the chunks of the changed files under `path`; counts of files seen, processed and of new chunks.

        The list of files is written before any content is read, and is what the state holds afterwards: a file that changes
        in between is read again by the next run.  In a git working tree each chunk gets the commit it is at.
        """
        sha = history.head(path)
        return self._ingest(files.scan(self.spark, path, (options or Options()).gitignore), name, options, {"commit_sha": sha} if sha else {})

    def ingest_revision(self, repo: str, ref: str, name: str, into: str, options: Options | None = None) -> dict[str, int]:
        """Store the chunks of a git revision, unpacked to `into`, with its name and commit; no state is kept."""
        found = history.scan(self.spark, repo, ref, into)
        sha = found.select("commit_sha").head(1)
        return self._ingest(found.drop("git_ref", "commit_sha"), name, options, {"git_ref": ref, "commit_sha": sha[0][0]} if sha else {}, state=False)

    def _ingest(self, found: DataFrame, name: str, options: Options | None, more: dict[str, str], state: bool = True) -> dict[str, int]:
        o = options or Options()
        self.store.create(name, self.embedder.dimension)
        found = files.select_files(found, o.extensions, o.excludes)
        listed = f"{self.root}/{name}/runs/{uuid.uuid4().hex}"
        seen = found.withColumn("meta_hash", files.meta_hash(F.col("rel_path"), F.col("length"), F.col("modified")))
        before = self._state(name) if state else None
        seen.select("rel_path", "meta_hash", F.lit(self.store.collection_id(name)).alias("collection_id")).write.parquet(listed)
        rows = self.spark.read.parquet(listed)
        new = rows if before is None else rows.join(before.select("rel_path", "meta_hash"), ["rel_path", "meta_hash"], "left_anti")
        new = new.select("rel_path", "meta_hash", "collection_id")
        processed = new.count()
        wanted = files.with_metadata(found.join(new.select("rel_path"), "rel_path", "left_semi"), o.path_rules, o.metadata | more)
        chunks = self._store_chunks(chunk_files(wanted, o), name)
        if state:
            new.write.mode("append").parquet(f"{self.root}/{name}/state")
        return {"seen": rows.count(), "processed": processed, "chunks": chunks}

    def _store_chunks(self, chunked: DataFrame, name: str) -> int:
        """Embed and store the chunks that aren't stored; their number."""
        chunked, stored = chunked.dropDuplicates(["id"]), self.store.points(name)
        if stored is not None:
            chunked = catalog.not_stored(stored, chunked)
        facet = lambda k: F.try_element_at("metadata", F.lit(k))
        points = embed(chunked, self.embedder).withColumn("language", facet("language")).withColumn("source_type", facet("source_type"))
        before = 0 if stored is None else stored.count()
        self.store.upsert(name, points)
        return self.store.points(name).count() - before

    def push(self, content: str, name: str, metadata: dict[str, str] | None = None, options: Options | None = None) -> int:
        """Store the chunks of a text that is in memory, always as plain text; no state is kept."""
        o = options or Options()
        self.store.create(name, self.embedder.dimension)
        own = {"source": "memory"} | (metadata or {})
        key = own.get("path") or hashlib.sha256(content.encode()).hexdigest()
        d = self.spark.createDataFrame([(f"memory/{key}", f"{key}.txt", bytearray(content.encode()), own)], "rel_path string, path string, content binary, metadata map<string,string>")
        return self._store_chunks(chunk_files(d, replace(o, structural=False)), name)

    def push_stream(self, stream, name: str, metadata: dict[str, str] | None = None) -> int:
        """`push` of all that an open text stream holds, such as stdin."""
        return self.push(stream.read(), name, {"source": "stdin"} | (metadata or {}))

    def search(self, query: str, name: str, k: int = 10, filters: dict | None = None, smart: bool = False, keys: tuple[str, ...] = ("source_type", "language")) -> DataFrame:
        points = self.store.points(name)
        if points is None:
            raise KeyError(f"{name} is empty")
        dim = self.store.entry(name)["dim"]
        v = self.embedder.embed_batch([query])[0]
        if len(v) > dim:
            n = sum(x * x for x in v[:dim]) ** 0.5 or 1.0
            v = [x / n for x in v[:dim]]
        if smart:
            return facets.search_smart(points, query, v, list(keys), k)
        return vector.search(points, v, k, filters)


def project_tree(paths: list[str], depth: int = 3, most: int = 4096) -> str:
    """Relative paths as an indented tree: folders first, then names; at most `depth` levels and `most` characters."""
    root: dict = {}
    for p in paths:
        at = root
        for part in p.split("/")[:depth]:
            at = at.setdefault(part, {})
    folders = {"/".join(p.split("/")[:k]) for p in paths for k in range(1, p.count("/") + 1)}
    lines: list[str] = []

    def show(node: dict, at: str, indent: int) -> None:
        for name in sorted(node, key=lambda x: (f"{at}{x}" not in folders, x)):
            lines.append("  " * indent + name + ("/" if f"{at}{name}" in folders else ""))
            show(node[name], f"{at}{name}/", indent + 1)

    show(root, "", 0)
    return "\n".join(lines)[:most]


def assemble_context(hits: DataFrame, question: str, readme: str = "", tree: str = "", most: int = 20, files: DataFrame | None = None, masked: DataFrame | None = None) -> str:
    """A prompt: tree (4096 characters), README (2048 bytes) and the best hit of each path, by score.

    With `files` (rel_path, content) a path's whole body takes the place of its best hit.  Paths of `masked` (rel_path), such as
    ignored ones, are shown as PRIVATE_KNOWLEDGE_SOURCE_n, with their best hit only.
    """
    best = hits.withColumn("path", F.try_element_at("metadata", F.lit("path")))
    best = best.groupBy("path").agg(F.max_by("content", "score").alias("content"), F.max("score").alias("score")).orderBy(F.desc("score"), "path").limit(most)
    hidden = best.join(masked.select(F.col("rel_path").alias("path")).distinct(), "path", "left_semi") if masked is not None else None
    private = {r.path: f"PRIVATE_KNOWLEDGE_SOURCE_{i}" for i, r in enumerate(hidden.orderBy("path").select("path").collect(), 1)} if hidden is not None else {}
    if files is not None:
        body = files.select(F.col("rel_path").alias("path"), F.col("content").cast("string").alias("body"))
        best = best.join(body, "path", "left")
    rows = best.orderBy(F.desc("score"), "path").collect()  # `most` rows
    parts = ["# Files", tree[:4096], "# README", readme.encode()[:2048].decode("utf-8", "ignore"), "# Context"]
    for r in rows:
        text = r.content if r.path in private or files is None or r.body is None else r.body
        parts.append(f"## {private.get(r.path, r.path)} ({r.score:.4f})\n{text}")
    return "\n\n".join([*parts, "# Question", question])
