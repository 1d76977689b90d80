"""Token ids in compressed files: static range asymmetric numeral system (rANS).

A file holds the documents of one range of ids.  Layout, little-endian throughout:

    magic 8 | lanes u32, precision u32, table crc32 u32, reserved u32
    blocks: tokens u32, words u32, crc32 of states and words u32, crc32 of the ids u32 | lane states u64 | words u32
    index (zlib): ids i64, null flags u8, lengths i64, then per block its byte offset and first token (the checkpoints)
    tail: index offset u64, index bytes u32, index crc32 u32, documents u64, blocks u64, tokens u64 | magic 8

Blocks are independent: `lanes` interleaved coders start from the states in the block's head, so any block can be decoded
on its own.  Frequencies come from all tokens of the corpus, are scaled to 2**precision and shared by all files, in a table
beside them whose crc32 each file repeats.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .tokens import END_ID, WORD_BPE, encoded, encoder

MAGIC = b"SQRANS01"
LANES, PRECISION, BLOCK = 1024, 20, 1 << 18
_LOW = np.uint64(1 << 31)
_HEAD, _BLOCK, _TAIL = struct.Struct("<8sIIII"), struct.Struct("<IIII"), struct.Struct("<QIIQQQ8s")


class Damaged(ValueError):
    """A checksum or a length in a file is wrong."""


def scaled(counts: np.ndarray, precision: int = PRECISION) -> np.ndarray:
    """Integer frequencies that sum to 2**precision, at least 1 where a count is above 0."""
    total, full = int(counts.sum()), 1 << precision
    if not total:
        return np.zeros(len(counts), np.uint32)
    seen = counts > 0
    if int(seen.sum()) > full:
        raise ValueError("more symbols than the precision can tell apart")
    freq = np.where(seen, np.maximum(1, np.floor(counts.astype(float) * full / total)), 0).astype(np.int64)
    over = int(freq.sum()) - full
    for i in np.argsort(-freq, kind="stable"):
        if not over:
            break
        change = min(over, int(freq[i]) - 1) if over > 0 else over
        freq[i] -= change
        over -= change
    return freq.astype(np.uint32)


class Table:
    def __init__(self, freq: np.ndarray, precision: int = PRECISION):
        self.precision = precision
        self.freq = freq.astype(np.uint64)
        self.cum = np.concatenate([[0], np.cumsum(self.freq)[:-1]]).astype(np.uint64) if len(freq) else self.freq
        self.slots = np.repeat(np.arange(len(freq), dtype=np.uint32), freq.astype(np.int64))
        self.crc = zlib.crc32(freq.astype("<u4").tobytes())


def encode_block(ids: np.ndarray, t: Table, lanes: int = LANES) -> bytes:
    n, r, half = len(ids), np.uint64(t.precision), np.uint64(32)
    x = np.full(min(lanes, n), _LOW, np.uint64)
    limit = t.freq << (np.uint64(63) - r)
    out = []
    for k in range((n - 1) // lanes, -1, -1):
        s = ids[k * lanes : (k + 1) * lanes]
        y, f = x[: len(s)], t.freq[s]
        spill = y >= limit[s]
        if spill.any():
            out.append(y[spill].astype(np.uint32))
            y = np.where(spill, y >> half, y)
        q, rest = np.divmod(y, f)
        x[: len(s)] = (q << r) + rest + t.cum[s]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, np.uint32)
    body = x.astype("<u8").tobytes() + words.astype("<u4").tobytes()
    return _BLOCK.pack(n, len(words), zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode_block(raw: bytes, at: int, t: Table, lanes: int = LANES) -> tuple[np.ndarray, int]:
    """The ids of the block at `at`, and where the next one begins."""
    n, m, crc, ids_crc = _BLOCK.unpack_from(raw, at)
    at += _BLOCK.size
    k = min(lanes, n)
    end = at + 8 * k + 4 * m
    if len(raw) < end or zlib.crc32(raw[at:end]) != crc:
        raise Damaged("a block's payload does not match its checksum")
    x = np.frombuffer(raw, "<u8", k, at).astype(np.uint64)
    words, used = np.frombuffer(raw, "<u4", m, at + 8 * k).astype(np.uint64), 0
    out, r, mask, half = np.empty(n, np.uint32), np.uint64(t.precision), np.uint64((1 << t.precision) - 1), np.uint64(32)
    for i in range(0, n, lanes):
        y = x[: min(lanes, n - i)]
        slot = y & mask
        s = t.slots[slot]
        out[i : i + len(y)] = s
        y = t.freq[s] * (y >> r) + slot - t.cum[s]
        low = y < _LOW
        if (c := int(low.sum())) :
            y[low] = (y[low] << half) | words[used : used + c]
            used += c
        x[: len(y)] = y
    if zlib.crc32(out.astype("<u4").tobytes()) != ids_crc:
        raise Damaged("a block's ids do not match their checksum")
    return out, end


class Writer:
    """Documents one after another into a binary stream; at most one block of ids is held."""

    def __init__(self, stream, table: Table, block: int = BLOCK):
        self.stream, self.table, self.block = stream, table, block
        self.held: list[np.ndarray] = []
        self.n_held = self.tokens = 0
        self.ids: list[int | None] = []
        self.lengths: list[int] = []
        self.blocks: list[tuple[int, int]] = []
        self.at = 0
        self._put(_HEAD.pack(MAGIC, LANES, table.precision, table.crc, 0))

    def _put(self, raw: bytes) -> None:
        self.stream.write(raw)
        self.at += len(raw)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.ids.append(doc_id)
        self.lengths.append(len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block:
            self._flush(False)

    def _flush(self, all_: bool) -> None:
        ids = np.concatenate(self.held) if self.held else np.zeros(0, np.uint32)
        i = 0
        while len(ids) - i >= self.block or (all_ and i < len(ids)):
            self.blocks.append((self.at, self.tokens))
            part = ids[i : i + self.block]
            self._put(encode_block(part, self.table))
            self.tokens += len(part)
            i += len(part)
        self.held, self.n_held = [ids[i:]], len(ids) - i

    def close(self) -> None:
        self._flush(True)
        index = zlib.compress(
            np.array([x or 0 for x in self.ids], "<i8").tobytes() + np.array([x is None for x in self.ids], "u1").tobytes()
            + np.array(self.lengths, "<i8").tobytes() + np.array(self.blocks, "<i8").reshape(-1, 2).tobytes(), 1
        )
        at = self.at
        self._put(index)
        self._put(_TAIL.pack(at, len(index), zlib.crc32(index), len(self.ids), len(self.blocks), self.tokens, MAGIC))


def read_index(raw: bytes, table: Table, index_at: int | None = None) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """ids, lengths and checkpoints (byte offset, first token) of a file; `index_at`: where `raw` holds the index, if not
    where the file does."""
    if len(raw) < _HEAD.size + _TAIL.size:
        raise Damaged("the file is cut off")
    magic, lanes, precision, crc, _ = _HEAD.unpack_from(raw, 0)
    at, size, index_crc, docs, blocks, _, magic2 = _TAIL.unpack_from(raw, len(raw) - _TAIL.size)
    if magic != MAGIC or magic2 != MAGIC or (lanes, precision) != (LANES, table.precision):
        raise Damaged("not a file of this format")
    if crc != table.crc:
        raise Damaged("the file was written with another frequency table")
    at = at if index_at is None else index_at
    packed = raw[at : at + size]
    if zlib.crc32(packed) != index_crc:
        raise Damaged("the index does not match its checksum")
    index = zlib.decompress(packed)
    ids, null = np.frombuffer(index, "<i8", docs), np.frombuffer(index, "u1", docs, 8 * docs)
    lengths = np.frombuffer(index, "<i8", docs, 9 * docs)
    marks = np.frombuffer(index, "<i8", 2 * blocks, 17 * docs).reshape(-1, 2)
    return [None if z else int(x) for x, z in zip(ids, null)], lengths, marks


def index_of(file, table: Table) -> tuple[list[int | None], np.ndarray, np.ndarray, int]:
    """`read_index` of an open file that can seek, which reads its head, tail and index only; and where the index begins."""
    size = file.size()
    head = file.read_at(_HEAD.size, 0)
    tail = file.read_at(min(size, _TAIL.size), max(0, size - _TAIL.size))
    if len(head) < _HEAD.size or len(tail) < _TAIL.size:
        raise Damaged("the file is cut off")
    at, packed, *_ = _TAIL.unpack(tail)
    if at + packed + _TAIL.size != size:
        raise Damaged("the file is cut off")
    return *read_index(head + file.read_at(packed, at) + tail, table, _HEAD.size), at


def read_documents(file, table: Table, first: int = 0, last: int | None = None) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """id, first token in the file and ids of the documents that begin in the blocks from `first` up to `last` (all without
    it).  Only those blocks are read, and the ones into which their last document runs on."""
    ids, lengths, marks, end = index_of(file, table)
    starts = np.cumsum(lengths) - lengths
    offsets = np.append(marks[:, 0], end)
    begin = marks[first:, 1][:1]
    stop = marks[last, 1] if last is not None and last < len(marks) else None
    own = np.arange(int(np.searchsorted(starts, begin[0], "left")) if len(begin) else len(ids), int(np.searchsorted(starts, stop, "left")) if stop is not None else len(ids))
    if not len(own):
        return
    k = int(np.searchsorted(marks[:, 1], starts[own[0]], "right")) - 1
    held, at = np.zeros(0, np.uint32), int(marks[k, 1])
    for i in own.tolist():
        start, n = int(starts[i]), int(lengths[i])
        parts, have = [held], at + len(held)
        while have < start + n:
            part, _ = decode_block(file.read_at(int(offsets[k + 1] - offsets[k]), int(offsets[k])), 0, table)
            parts.append(part)
            have += len(part)
            k += 1
        held = np.concatenate(parts) if len(parts) > 1 else held
        held, at = held[start - at :], start
        yield ids[i], start, held[:n]


def tokenised(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_tokens, ids (binary, little-endian, 16 or 32 bit by vocabulary), with the end id last; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        width = encoder(vocabulary).dtype.itemsize
        for b in batches:
            for at, ids in encoded(b.column(1), vocabulary):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(ids)), pa.array([len(x) // width for x in ids], pa.int64()), pa.array(ids, pa.binary())], ["id", "n_tokens", "ids"])

    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("the files hold integer ids")
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, n_tokens long, ids binary")


def frequencies(tokens: DataFrame, size: int, width: str) -> np.ndarray:
    """Counts of each id over all rows; the driver gets one row per id of the vocabulary at most."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size, np.int64)
        for b in batches:
            raw = b"".join(b.column(0).to_pylist())
            total += np.bincount(np.frombuffer(raw, width), minlength=size)
        seen = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(total[seen], pa.int64())], ["s", "n"])

    got = tokens.select("ids").mapInArrow(count, "s int, n long").groupBy("s").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(size, np.int64)
    for s, n in got:
        counts[s] = n
    return counts


#: Hadoop's names of stores that Arrow knows under another one.
SCHEMES = {"s3a": "s3", "s3n": "s3", "wasb": "abfs", "wasbs": "abfss", "oss": "s3"}


def file_system(folder: str):
    """The file system of a Hadoop folder in Arrow, and the path in it.

    file, hdfs, viewfs, s3, gs and abfs come with Arrow; any other scheme needs an installed fsspec driver.
    """
    from pyarrow import fs

    scheme, colon, rest = folder.partition(":")
    if not colon or "/" in scheme:
        return fs.LocalFileSystem(), folder
    folder = f"{SCHEMES.get(scheme, scheme)}:{rest}"
    try:
        return fs.FileSystem.from_uri("file:///" + rest.lstrip("/") if scheme == "file" else folder)
    except (pa.ArrowInvalid, pa.ArrowNotImplementedError) as error:
        try:
            import fsspec
        except ImportError:
            raise ValueError(f"no driver for {scheme}: in Arrow, and fsspec is not installed") from error
        found, path = fsspec.core.url_to_fs(folder)
        return fs.PyFileSystem(fs.FSSpecHandler(found)), path


def write_files(tokens: DataFrame, folder: str, freq: np.ndarray, width: str, per_file: int = 8_000_000, total: int | None = None) -> DataFrame:
    """Write `tokens` (id, n_tokens, ids) in ascending id order; returns part, file, docs, tokens, blocks, one row per file.

    Rows of one id, such as a null one, may lie in several files that follow each other, ordered by a hash of their ids.  A task writes to a name of its own and renames it when complete, so a lost or repeated task does no harm.
    """
    total = total if total is not None else tokens.agg(F.sum("n_tokens")).first()[0] or 0
    files = max(1, -(-total // per_file))
    spark_freq = tokens.sparkSession.sparkContext.broadcast(freq)  # one number per id of the vocabulary

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        w = None
        for b in batches:
            for doc_id, raw in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if w is None:
                    where, base = file_system(folder)
                    where.create_dir(base, recursive=True)
                    name, mine = f"{base}/part-{part:06d}.rans", f"{base}/.part-{part:06d}-{attempt}"
                    stream = where.open_output_stream(mine)
                    w = Writer(stream, Table(spark_freq.value))
                w.add(doc_id, np.frombuffer(raw, width))
        if w is not None:
            w.close()
            stream.close()
            where.move(mine, name)
            yield pa.RecordBatch.from_pydict({"part": [part], "file": [f"{folder}/part-{part:06d}.rans"], "docs": [len(w.ids)], "tokens": [w.tokens], "blocks": [len(w.blocks)]})

    # the last key tells equal rows apart: a row of the stored tokens has the same number in every task that reads it
    keys = [F.col("id").asc_nulls_first(), F.xxhash64("ids"), F.monotonically_increasing_id()]
    ordered = tokens.select("id", "ids", *(k.alias(n) for k, n in zip(keys[1:], ("h", "row")))).repartitionByRange(files, keys[0], "h", "row").sortWithinPartitions(keys[0], "h", "row")
    return ordered.select("id", "ids").mapInArrow(write, "part long, file string, docs long, tokens long, blocks long")


def read_files(manifest: DataFrame, freq: np.ndarray, digest: bool = False, blocks: int = 16) -> DataFrame:
    """id, start, n_tokens and, of each document, ids (binary, 32 bit) or with `digest` ids_crc32.

    Every `blocks` blocks are a piece of work of their own, which seeks to its blocks by the file's checkpoints.
    """
    spark: SparkSession = manifest.sparkSession
    table = spark.sparkContext.broadcast(freq)
    w = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one narrow row per file of 8 million ids
    starts = manifest.withColumn("before", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    work = starts.where("blocks > 0").select("file", "before", F.explode(F.expr(f"sequence(0L, blocks - 1, {blocks}L)")).alias("first"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = Table(table.value)
        for b in batches:
            for file, before, first in zip(*(c.to_pylist() for c in b.columns)):
                where, path = file_system(file)
                rows: tuple[list, list, list, list] = ([], [], [], [])
                held = 0
                with where.open_input_file(path) as f:
                    for doc_id, at, ids in read_documents(f, t, first, first + blocks):
                        own = ids.astype("<u4").tobytes()
                        for to, x in zip(rows, (doc_id, before + at, len(ids), zlib.crc32(own) if digest else own)):
                            to.append(x)
                        held += len(ids)
                        if held > 4_000_000 or len(rows[0]) >= 20_000:
                            yield _batch(rows, digest)
                            rows, held = ([], [], [], []), 0
                if rows[0]:
                    yield _batch(rows, digest)

    last = "ids_crc32 long" if digest else "ids binary"
    n = manifest.agg(F.sum(F.ceil(F.col("blocks") / blocks))).first()[0] or 1
    return work.repartitionByRange(int(n), "before", "first").mapInArrow(read, f"id long, start long, n_tokens long, {last}")


def _batch(rows: tuple[list, list, list, list], digest: bool) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64() if digest else pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(rows, kinds)], ["id", "start", "n_tokens", "ids_crc32" if digest else "ids"])


def shared_table(tokens: DataFrame, vocabulary: str = WORD_BPE) -> tuple[np.ndarray, str]:
    """The scaled frequencies of all ids in `tokens`, and the width of an id."""
    e = encoder(vocabulary)
    size = max(e.size, END_ID + 1)
    return scaled(frequencies(tokens, size, e.dtype.str)), e.dtype.str
