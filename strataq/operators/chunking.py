"""Cutting texts into chunks, by bytes, by lines of code or by a sizer; identifiers of chunks."""

from __future__ import annotations

import bisect
import re
import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_BYTES = 6000
NAMESPACE = uuid.UUID("6f1d4c1a-52a7-5d0e-9a53-2a1f0c9d7b11")
Piece = tuple[str, int, int]  # text, offset in bytes, first line


def _boundary(raw: bytes, at: int) -> int:
    while at < len(raw) and raw[at] & 0xC0 == 0x80:
        at -= 1
    return at


def simple(text: str, most: int = MAX_BYTES) -> Iterator[Piece]:
    """Windows of at most `most` bytes, cut after the last line feed in them if there is one."""
    raw, at, line = text.encode(), 0, 1
    while at < len(raw):
        end = len(raw) if at + most >= len(raw) else max(_boundary(raw, at + most), at + 1)
        while end < len(raw) and raw[end] & 0xC0 == 0x80:
            end += 1  # a character wider than the window
        if end < len(raw) and (cut := raw.rfind(b"\n", at, end)) >= at:
            end = cut + 1
        part = raw[at:end]
        yield part.decode(), at, line
        line += part.count(b"\n")
        at = end


def windows(text: str, size: int, overlap: int = 0) -> Iterator[Piece]:
    """Windows of `size` bytes that share `overlap`; without a step forward, the whole text."""
    raw = text.encode()
    step = size - overlap
    if step <= 0:
        if raw:
            yield text, 0, 1
        return
    breaks = [i for i, b in enumerate(raw) if b == 10]
    at = 0
    while at < len(raw):
        a, b = _boundary(raw, at), _boundary(raw, min(len(raw), at + size)) if at + size < len(raw) else len(raw)
        if b > a:
            yield raw[a:b].decode(), a, bisect.bisect_left(breaks, a) + 1
        if at + size >= len(raw):
            return
        at += step


_LEVELS = [re.compile(x) for x in (r"\n{2,}", r"\n", r"(?<=[.!?])\s+", r"\s+")]


def recursive(text: str, size: int, sizer: Callable[[str], int] = len, level: int = 0, known: int | None = None) -> Iterator[str]:
    """Pieces of at most `size` by `sizer`, cut at the coarsest of paragraphs, lines, sentences, words, characters; trimmed.

    By a sizer of `ADDITIVE` a piece grows by the sizes of its parts, which end in white space; by any other one it is measured
    with each part that is added.  `known`: the text's size.
    """
    if (sizer(text) if known is None else known) <= size:
        if text.strip():
            yield text.strip()
        return
    if level == len(_LEVELS):
        half = max(1, len(text) // 2)
        for part in (text[:half], text[half:]) if len(text) > 1 else ():
            yield from recursive(part, size, sizer, level)
        return
    cuts = [*(m.end() for m in _LEVELS[level].finditer(text)), len(text)]
    additive = sizer in ADDITIVE
    first = at = held = 0
    for end in cuts:
        grown = held + sizer(text[at:end]) if additive else sizer(text[first:end])
        if at > first and grown > size:
            yield from recursive(text[first:at], size, sizer, level + 1, held)
            first, grown = at, grown - held if additive else sizer(text[at:end])
        at, held = end, grown
    if at > first:
        yield from recursive(text[first:at], size, sizer, level + 1, held)


def code(text: str, size: int, most: int | None = None) -> Iterator[Piece]:
    """Chunks that begin at a line without indent once `size` bytes are reached; longer ones than `most` are cut again."""
    most = most or 2 * size
    held, first, start, at = [], 1, 0, 0
    n = 0

    def out(lines: list[str], first: int, start: int) -> Iterator[Piece]:
        chunk = "".join(lines).rstrip()
        if len(chunk.encode()) <= most:
            if chunk:
                yield chunk, start, first
        else:
            for part, o, line in windows(chunk, size):
                yield part, start + o, first + line - 1

    for k, line in enumerate(text.splitlines(keepends=True), 1):
        if held and n >= size and line[:1] not in (" ", "\t", "\n", "\r", ""):
            yield from out(held, first, start)
            held, first, start, n = [], k, at, 0
        held.append(line)
        n += len(line.encode())
        at += len(line.encode())
    if held:
        yield from out(held, first, start)


def tokens_of(text: str) -> int:
    """An estimate of a text's tokens: a word's every four characters, and each mark."""
    return len(_PIECE.findall(text))


_PIECE = re.compile(r"\w{1,4}|[^\w\s]")
#: Sizers by which a text is as large as its parts together, if these end in white space.
ADDITIVE = {len, tokens_of}


def placed(pieces: Iterator[str], text: str) -> Iterator[Piece]:
    """Pieces of a text, in order, with their offsets and first lines."""
    at, offset, line = 0, 0, 1
    for p in pieces:
        found = text.index(p, at)
        gap = text[at:found]
        offset, line = offset + len(gap.encode()), line + gap.count("\n")
        yield p, offset, line
        offset, line, at = offset + len(p.encode()), line + p.count("\n"), found + len(p)


def by_size(text: str, size: int, sizer: Callable[[str], int] = len) -> Iterator[Piece]:
    return placed(recursive(text, size, sizer), text)


STRATEGIES: dict[str, Callable[..., Iterator[Piece]]] = {"simple": simple, "char": windows, "code_aware": code, "recursive": by_size, "semantic": by_size}


def strategy_of(file_type: str, wanted: str = "recursive") -> str:
    """The strategy for a file type: recursive and semantic cuts are for known structure; texts and unknown types get `simple`."""
    if wanted not in STRATEGIES:
        raise ValueError(f"a strategy is one of {sorted(STRATEGIES)}")
    return "simple" if wanted in ("recursive", "semantic") and file_type in ("text", "unknown") else wanted


def content_hash(text: Column) -> Column:
    """SHA-256 of a text in UTF-8."""
    return F.sha2(text.cast("binary"), 256)


def token_estimate(text: Column) -> Column:
    """A quarter of a text's characters."""
    return F.floor(F.length(text) / 4).cast("long")


def chunks(docs: DataFrame, strategy: str = "simple", id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, chunk_index, content, offset_bytes, line_start, line_end, chunk_id of each chunk; null text has none."""
    cut = STRATEGIES[strategy]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [id_col, "chunk_index", "content", "offset_bytes", "line_start", "line_end", "chunk_id"]
        for pdf in batches:
            rows = []
            for key, text in zip(pdf[id_col], pdf[text_col]):
                for i, (part, at, line) in enumerate(cut(text or "", **options)):
                    rows.append((key, i, part, at, line, line + part.count("\n") - part.endswith("\n"), str(uuid.uuid5(NAMESPACE, f"{key}::{i}::{part}"))))
                    if len(rows) == 5000:
                        yield pd.DataFrame(rows, columns=names)
                        rows = []
            yield pd.DataFrame(rows, columns=names)

    kind = dict(docs.dtypes)[id_col]
    return docs.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {kind}, chunk_index int, content string, offset_bytes long, line_start int, line_end int, chunk_id string")


def char_windows(text: Column, size: int, overlap: int = 0) -> Column:
    """Windows of characters as an array, without Python; equal to `windows` on ASCII text."""
    step = size - overlap
    n = F.length(text)
    starts = F.when(n > size, F.sequence(F.lit(0), F.ceil((n - size) / step).cast("int") * step, F.lit(step))).otherwise(F.array(F.lit(0)))
    return F.when(n > 0, F.transform(starts, lambda s: F.substring(text, s + 1, F.lit(size)))).otherwise(F.array().cast("array<string>"))


def uuid5(namespace: uuid.UUID, name: Column) -> Column:
    """UUID version 5 from SHA-1, in column expressions."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.hex)), name.cast("binary")))
    variant = F.lower(F.hex(F.conv(F.substring(h, 17, 2), 16, 10).cast("long").bitwiseAND(F.lit(0x3F)).bitwiseOR(F.lit(0x80))))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 19, 2)), F.substring(h, 21, 12))


def late_split(chunked: DataFrame, most: int = MAX_BYTES) -> DataFrame:
    """Chunks (chunk_id, content, …) above `most` bytes as parts with split_part and original_chunk_id."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [p for p, _, _ in simple(t or "", most)])

    big = F.octet_length("content") > most
    small = chunked.where(~F.coalesce(big, F.lit(False))).withColumn("split_part", F.lit(None).cast("int")).withColumn("original_chunk_id", F.lit(None).cast("string"))
    parts = chunked.where(big).select("*", F.posexplode(cut("content")).alias("split_part", "part")).withColumn("original_chunk_id", F.col("chunk_id"))
    parts = parts.withColumn("content", F.col("part")).withColumn("chunk_id", uuid5(NAMESPACE, F.concat("chunk_id", F.lit("-part-"), F.col("split_part").cast("string")))).drop("part")
    return small.unionByName(parts)
