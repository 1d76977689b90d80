"""Packing documents into fixed-length sequences along a Hilbert curve.

A document's vector is the mean of one signed random vector per token id (hashed features, projected): `DIMS` numbers,
squashed to [0, 1) and cut to `BITS` bits each.  Documents are ordered by the Hilbert key of that cell, so neighbours on
the curve, hence in a sequence, have like content.

The curve is split into ranges of about `per_part` tokens by a histogram of the keys: cells above that are split again by
more bits of the key, until they are small or hold one key only.  Only documents of one key, such as copies of a text, are
split by hash of the document.  A pass gives the driver `CELLS` rows at most.  Each range is one task: documents are laid end
to end in (key, id) order and cut every `length` tokens; what is left at a range's end is cut at powers of two, so no
sequence needs padding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .tokens import BYTE_BPE, encoded, encoder

DIMS, BITS = 4, 15
LENGTH = 2048
#: Rows of one pass of the histogram, and ranges in all: what the driver may hold.
CELLS, MOST_PARTS = 1 << 18, 50_000


def projection(size: int, seed: int = 7, dims: int = DIMS) -> np.ndarray:
    """One random vector per token id, the same on every machine: ids are hashed to 4096 buckets, buckets projected."""
    buckets = np.random.RandomState(seed).standard_normal((4096, dims)).astype(np.float32)
    ids = np.arange(size, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return buckets[(ids >> np.uint64(52)).astype(np.int64)]


def hilbert_keys(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Hilbert indices of integer points (n, dims), by the transpose method."""
    x = [cells[:, i].astype(np.int64).copy() for i in range(cells.shape[1])]
    n, m = len(x), 1 << (bits - 1)
    q = m
    while q > 1:
        p = q - 1
        for i in range(n):
            on = (x[i] & q) != 0
            t = np.where(on, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(on, x[0] ^ p, x[0] ^ t)
            if i:
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), m
    while q > 1:
        t = np.where(x[n - 1] & q, t ^ (q - 1), t)
        q >>= 1
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            key = (key << 1) | (((x[i] ^ t) >> b) & 1)
    return key


def document_keys(ids: list[np.ndarray], table: np.ndarray) -> np.ndarray:
    """The Hilbert key of each document."""
    out = np.zeros((len(ids), table.shape[1]))
    for k, x in enumerate(ids):
        if len(x):
            n = np.bincount(x, minlength=len(table)) if len(x) > 1 << 20 else None
            out[k] = (n @ table if n is not None else table[x].sum(0, dtype=np.float64)) / len(x)
    cells = np.clip((0.5 + 0.5 * np.tanh(4 * out)) * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
    return hilbert_keys(cells)


def keyed(docs: DataFrame, vocabulary: str = BYTE_BPE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, key, n_tokens, ids (with the end id) of each document; null text is empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary)
        table = projection(e.size)
        for b in batches:
            for at, raw in encoded(b.column(1), vocabulary):
                ids = [np.frombuffer(x, e.dtype) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(raw)), pa.array(document_keys([x[:-1] for x in ids], table), pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array(raw, pa.binary())], ["id", "key", "n_tokens", "ids"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, key long, n_tokens long, ids binary")


def _cut(rest: int) -> list[int]:
    """Where a last, incomplete sequence of `rest` tokens is cut: at falling powers of two."""
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def lay_out(lengths: Iterator[tuple[object, int]], length: int) -> Iterator[tuple[object, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece, for documents laid end to end."""
    held: list[tuple[object, int, int]] = []
    filled = seq = 0
    for doc, n in lengths:
        start = 0
        while start < n:
            take = min(n - start, length - filled)
            held.append((doc, start, take))
            filled += take
            start += take
            if filled == length:
                at = 0
                for d, s, k in held:
                    yield d, s, k, seq, at
                    at += k
                held, filled, seq = [], 0, seq + 1
    for size in _cut(filled):
        at = 0
        while at < size:
            d, s, k = held.pop(0)
            take = min(k, size - at)
            yield d, s, take, seq, at
            if take < k:
                held.insert(0, (d, s + take, k - take))
            at += take
        seq += 1


def ranges(tokens: DataFrame, per_part: int, cells: int = CELLS) -> list[tuple[int, int, int, int]]:
    """(bits, prefix, first, many): keys whose first `bits` bits are `prefix` lie in part `first`, or for one hot key in one of
    `many` parts from it.  Parts follow each other along the curve; keys that no document has belong to none."""
    full, per_key = DIMS * BITS, tokens.select("key", "n_tokens")
    open_: list[int] | None = None  # prefixes of `depth` bits to be split
    depth, leaves = 0, []
    while open_ is None or open_:
        more = min(full - depth, max(1, (cells // max(1, len(open_ or [0]))).bit_length() - 1), 12)
        rows = per_key
        if open_ is not None:
            hot = F.broadcast(tokens.sparkSession.createDataFrame([(x,) for x in open_], "hot long"))  # as many as cells of the last pass at most
            rows = rows.join(hot, F.shiftright("key", full - depth) == F.col("hot"), "left_semi")
        depth += more
        sums = rows.groupBy(F.shiftright("key", full - depth).alias("cell")).agg(F.sum("n_tokens").alias("n")).collect()  # cells, or twice as many
        open_ = sorted(c for c, n in sums if n > per_part and depth < full)
        again = set(open_)
        leaves += [(c << (full - depth), depth, c, n) for c, n in sums if c not in again]
    out, part, room = [], 0, per_part
    for _, bits, cell, n in sorted(leaves):
        many = -(-n // per_part)
        if many > 1 or n > room:
            part, room = part + (room < per_part), per_part
        out.append((bits, cell, part, many))
        part, room = (part + many, per_part) if many > 1 else (part, room - n)
    return out


def placed(tokens: DataFrame, cells: list[tuple[int, int, int, int]]) -> DataFrame:
    """`tokens` with the part of each row; a hot key's documents go by hash of id and ids."""
    full = DIMS * BITS
    found = None
    for bits in sorted({x[0] for x in cells}):
        own = tokens.sparkSession.createDataFrame([x[1:] for x in cells if x[0] == bits], f"cell{bits} long, first{bits} int, many{bits} int")
        tokens = tokens.join(F.broadcast(own), F.shiftright("key", full - bits) == F.col(f"cell{bits}"), "left")
        spread = F.when(F.col(f"many{bits}") > 1, F.pmod(F.xxhash64("id", "ids"), F.col(f"many{bits}")).cast("int")).otherwise(0)
        at = F.col(f"first{bits}") + spread
        found = at if found is None else F.coalesce(found, at)
    return tokens.withColumn("part", F.coalesce(found, F.lit(0)) if found is not None else F.lit(0))


def pack(tokens: DataFrame, length: int = LENGTH, per_part: int = 8_000_000, width: str = "<u2", out: str = "<u4") -> DataFrame:
    """doc_id, start, length, doc_tokens, sequence_id, offset, ids (binary, as `out`) of each piece.

    `tokens`: id, key, n_tokens, ids, to be read a few times.  Ties in key go by id, then ids; a null id comes first.  Repeated
    rows are documents each.  No documents: no pieces.  Ranges hold more than `per_part` tokens where there would be more than
    `MOST_PARTS` of them.
    """
    total = tokens.agg(F.sum("n_tokens")).first()[0] or 0
    cells = ranges(tokens, max(per_part, -(-total // MOST_PARTS)))
    parts = max([1, *(first + many for _, _, first, many in cells)])
    kind = dict(tokens.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def docs():
            for b in batches:
                for i in range(0, b.num_rows, 4096):
                    own = b.slice(i, 4096)
                    yield from zip(own.column(0).to_pylist(), own.column(1).to_pylist(), (np.frombuffer(x, width) for x in own.column(2).to_pylist()))

        pieces: list[tuple] = []
        held = 0
        source, ahead = docs(), []

        def one(part: int):
            while True:
                d = ahead.pop() if ahead else next(source, None)
                if d is None:
                    return
                if d[0] != part:
                    ahead.append(d)
                    return
                yield d, len(d[2])

        while True:
            first = ahead.pop() if ahead else next(source, None)
            if first is None:
                break
            ahead.append(first)
            for (p, doc_id, ids), start, n, seq, at in lay_out(one(first[0]), length):
                pieces.append((doc_id, start, n, len(ids), (p << 32) + seq, at, ids[start : start + n].astype(out).tobytes()))
                held += n
                if held > 2_000_000:
                    yield _rows(pieces, arrow_kind)
                    pieces, held = [], 0
        if pieces:
            yield _rows(pieces, arrow_kind)

    arrow_kind = to_arrow_type(tokens.schema["id"].dataType)
    schema = f"doc_id {kind}, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"
    own = placed(tokens.select("id", "key", "ids"), cells).select("part", "key", "id", "ids").repartitionById(parts, "part")
    return own.sortWithinPartitions("part", "key", "id", "ids").select("part", "id", "ids").mapInArrow(run, schema)


def _rows(pieces: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    kinds = [kind, *[pa.int64()] * 5, pa.binary()]
    names = ["doc_id", "start", "length", "doc_tokens", "sequence_id", "offset", "ids"]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*pieces), kinds)], names)
