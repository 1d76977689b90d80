"""Vectors as array<float> columns: exact search, normalising, truncating, quantising.

Everything is a column expression, so filters and pruning reach the scan and a search is one pass with a top-k at the end.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a.cast("array<double>"), b.cast("array<double>"), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; null where a vector is null or has no length."""
    n = norm(a) * norm(b)
    return F.when(n > 0, dot(a, b) / n)


def l2_normalize(a: Column) -> Column:
    """Unit length; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n > 0, F.transform(a.cast("array<double>"), lambda x: x / n)).otherwise(a.cast("array<double>"))


def truncate(a: Column, dim: int) -> Column:
    """The first `dim` numbers at unit length; a vector of at most `dim` numbers stays as it is."""
    return F.when(F.size(a) > dim, l2_normalize(F.slice(a, 1, dim))).otherwise(a.cast("array<double>"))


def quantize_int8(a: Column) -> Column:
    """Numbers scaled by the largest magnitude to -127..127; a zero vector gives zeros."""
    a = a.cast("array<double>")
    # the magnitude is bound as a variable, so it is found once per vector
    scaled = lambda top: F.transform(a, lambda x: F.when(top > 0, F.floor(x * 127 / top + 0.5)).otherwise(0).cast("tinyint"))
    return F.element_at(F.transform(F.array(F.array_max(F.transform(a, lambda x: F.abs(x)))), scaled), 1)


def quantize_binary(a: Column) -> Column:
    """One bit per number, 1 where it is above 0."""
    return F.transform(a, lambda x: F.when(x > 0, 1).otherwise(0).cast("tinyint"))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.when(x != y, 1).otherwise(0)), F.lit(0), lambda s, x: s + x)


def equals(filters: dict[str, object] | None, strict: bool = True) -> Column:
    """AND of equalities.  With `strict`, a value that is neither string, integer nor bool is an error instead of being
    left out, which would widen the result."""
    out = F.lit(True)
    for k, v in (filters or {}).items():
        if isinstance(v, str | int | bool):
            out = out & (F.col(k) == F.lit(v))
        elif strict:
            raise TypeError(f"filter on {k}: strings, integers and booleans only")
    return out


def literal(vector: list[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in vector])


def search(points: DataFrame, query: list[float], k: int = 10, filters: dict[str, object] | None = None, id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The k points most like `query`, score descending, ties by id."""
    scored = points.where(equals(filters)).withColumn("score", cosine(F.col(vector_col), literal(query)))
    return scored.where("score is not null").orderBy(F.desc("score"), id_col).limit(k)


def search_quantized(points: DataFrame, query: list[float], k: int = 10, kind: str = "scalar", oversample: int = 4, filters: dict[str, object] | None = None, id_col: str = "id", vector_col: str = "vector", quantized_col: str = "quantized") -> DataFrame:
    """Like `search`: `oversample` * k points by their quantised vectors, of which the k best by the vectors themselves.

    Points without a quantised vector, such as those upserted since it was written, are quantised here.
    """
    make = {"scalar": quantize_int8, "binary": quantize_binary}[kind]
    own = make(F.col(vector_col))
    stored = F.coalesce(quantized_col, own) if quantized_col in points.columns else own
    top = max((abs(x) for x in query), default=0.0) or 1.0
    asked = literal([math.floor(x * 127 / top + 0.5) if kind == "scalar" else float(x > 0) for x in query])
    # the direction of the query is fixed, so its length doesn't matter
    rough = (lambda v: F.when(norm(v) > 0, dot(v, asked) / norm(v)))(F.col("__q")) if kind == "scalar" else -hamming(F.col("__q"), asked.cast("array<tinyint>"))
    near = points.where(equals(filters)).withColumn("__q", stored).withColumn("__rough", rough).drop("__q").where("__rough is not null").orderBy(F.desc("__rough"), id_col).limit(oversample * k).drop("__rough")
    return search(near, query, k, None, id_col, vector_col)


#: Queries that are broadcast in one pass over the points, as numbers of 8 bytes; more are searched in several passes.
QUERY_BYTES = 32 << 20
_STEP = 512  # queries that are scored at once


def search_batch(points: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "id", vector_col: str = "vector", query_bytes: int = QUERY_BYTES) -> DataFrame:
    """query_id, rank, id, score of the k points most like each of `queries` (query_id, query).

    Scores are products of matrices, a batch of points with all queries of a pass, rounded to 12 digits, so that equal vectors
    tie; of a batch only what may be among the k best of a query goes on.  Vectors of other lengths than the query's, without
    length or with a null have no score.  A pass brings `query_bytes` of queries to the driver at most.
    """
    size = queries.where("query is not null").agg(F.count("*"), F.max(F.size("query"))).first()
    blocks = max(1, -(-(size[0] * (size[1] or 0) * 8) // query_bytes))
    id_type, q_type = points.schema[id_col].dataType.simpleString(), queries.schema["query_id"].dataType.simpleString()
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), id_col)
    out = None
    for i in range(blocks):
        own = queries if blocks == 1 else queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == i)
        held = own.where("query is not null").select("query_id", F.col("query").cast("array<double>").alias("query")).toArrow()
        shared = points.sparkSession.sparkContext.broadcast(_by_length(held.column("query"), held.column("query_id")))
        found = points.select(id_col, F.col(vector_col).cast("array<double>")).mapInArrow(_scores(shared, k), f"query_id {q_type}, `{id_col}` {id_type}, score double")
        top = found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)
        out = top if out is None else out.unionByName(top)
    return out.select("query_id", "rank", id_col, "score")


def _by_length(vectors: pa.ChunkedArray, ids: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, pa.Array]]:
    """Unit vectors and their ids, by length; vectors that are null, hold a null or have no length are left out."""
    vectors, ids = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (vectors, ids))
    lengths = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths[lengths > 0]).tolist():
        at = np.flatnonzero(lengths == n)
        own = vectors.take(pa.array(at))
        m = pc.fill_null(own.flatten(), float("nan")).to_numpy(zero_copy_only=False).reshape(-1, n)
        norm = np.sqrt((m * m).sum(1))
        ok = norm > 0
        out[n] = (m[ok] / norm[ok, None], ids.take(pa.array(at[ok])))
    return out


def _scores(shared, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            points = _by_length(b.column(1), b.column(0))
            for n, (queries, query_ids) in shared.value.items():
                if n not in points or not len(points[n][0]):
                    continue
                vectors, ids = points[n]
                most = min(k, len(vectors))
                for i in range(0, len(queries), _STEP):
                    s = np.round(queries[i : i + _STEP] @ vectors.T, 12)
                    least = np.partition(s, -most, axis=1)[:, -most]
                    row, col = np.nonzero(s >= least[:, None])
                    yield pa.RecordBatch.from_arrays([query_ids.take(pa.array(row + i)), ids.take(pa.array(col)), pa.array(s[row, col])], ["query_id", b.schema.names[0], "score"])

    return run


def check_dimension(points: DataFrame, dim: int, vector_col: str = "vector") -> None:
    """Raise if `points` hold vectors of another length."""
    found = points.where(F.size(vector_col) != dim).select(F.size(vector_col).alias("n")).head(1)
    if found:
        raise ValueError(f"the collection has vectors of {found[0].n} numbers, not {dim}")


def memory_bytes(count: Column, dim: Column, kind: str = "none") -> Column:
    """Estimated size of `count` vectors: 4 bytes, 1 byte or 1 bit a number, and a fifth for the rest."""
    width = {"none": 4.0, "scalar": 1.0, "binary": 0.125}[kind]
    return F.floor(count * dim * F.lit(width) * F.lit(1.2)).cast("long")
