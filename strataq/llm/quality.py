"""Quality classifier: random Fourier features, ridge regression and isotonic calibration.

Document statistics (of whole texts; no label, language, source or id among them) are standardised; `FEATURES` random
Fourier features approximate a Gaussian kernel over them.  Each partition sums its part of the normal equations, the sums
are combined by cell, and the driver solves one system of fixed size.  Scores of rows kept apart for it are counted in
`BINS` bins, and pool-adjacent-violators turns those counts into a rising map from raw score to probability.

`max_rows` bounds the labelled rows that are fitted on (a share of them by hash of the id); scoring covers all rows.  Rows that
repeat an id are rows each, scored and, where labelled, learned from as often; a null id is scored like any other.  Other columns
of the documents are ignored, whatever their names.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FEATURES, BINS, MAX_ROWS = 256, 2000, 200_000
STATS = 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(195, 256)]] = True
_LINE = 10


def statistics(text: bytes) -> list[float]:
    """Numbers that describe a text in UTF-8; all 0 but for the first few when it is empty."""
    n = len(text)
    if not n:
        return [0.0] * STATS
    b = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    words, lines = text.split(), [x for x in text.split(b"\n") if x]
    w = max(1, len(words))
    upper, lower = int(b[65:91].sum()), int(b[97:123].sum())
    marks = int(b[33:48].sum() + b[58:65].sum() + b[91:97].sum() + b[123:127].sum())
    p = b[b > 0] / n
    common = int(b[44] + b[46] + b[45] + b[39])
    return [
        math.log1p(n), math.log1p(len(words)), n / w, len(set(words)) / w, math.log1p(len(set(words))) / math.log1p(w) if w > 1 else 1.0,
        len(set(lines)) / max(1, len(lines)), math.log1p(n / max(1, len(lines))), upper / max(1, upper + lower), int(b[48:58].sum()) / n, marks / n,
        (marks - common) / n, int(b[128:].sum()) / n, int(b[33] + b[63]) / w, int(b[46]) / w, float(-(p * np.log2(p)).sum()), int(b[124]) / w,
    ]


def features(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """id, x: the statistics of each text; null counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 1024):
                part = b.slice(i, 1024)
                x = [statistics(t or b"") for t in part.column(1).cast(pa.binary()).to_pylist()]
                flat = pa.array(np.array(x, np.float64).ravel())
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(range(0, len(x) * STATS + 1, STATS), pa.int32()), flat)], ["id", "x"])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"id {dict(docs.dtypes)[id_col]}, x array<double>")


@dataclass(frozen=True)
class Model:
    mean: np.ndarray
    scale: np.ndarray
    w: np.ndarray
    b: np.ndarray
    beta: np.ndarray
    at: np.ndarray
    value: np.ndarray

    def project(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate([math.sqrt(2 / len(self.b)) * np.cos(z @ self.w + self.b), np.ones((len(x), 1))], 1)

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.project(x) @ self.beta

    def score(self, x: np.ndarray) -> np.ndarray:
        return np.clip(np.interp(self.raw(x), self.at, self.value), 0, 1)


def isotonic(at: np.ndarray, positives: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Centres and values of the blocks of the rising fit (pool adjacent violators)."""
    blocks: list[list[float]] = []
    for a, p, n in zip(at, positives, counts):
        blocks.append([float(a) * n, float(p), float(n)])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [x + y for x, y in zip(blocks[-1], last)]
    return np.array([s / n for s, _, n in blocks]), np.array([p / n for _, p, n in blocks])


def _matrix(batch: pa.RecordBatch, name: str = "x") -> np.ndarray:
    return batch.column(batch.schema.names.index(name)).flatten().to_numpy().reshape(batch.num_rows, STATS)


def fit(labelled: DataFrame, kernel_width: float = 3.0, ridge: float = 1e-3, seed: int = 3) -> Model:
    """A model of `labelled` (x, y, calibrate); without rows, or with one label only, scores are that constant."""
    spark = labelled.sparkSession
    rng = np.random.RandomState(seed)
    w, b = rng.standard_normal((STATS, FEATURES)) / kernel_width, rng.uniform(0, 2 * math.pi, FEATURES)
    aggs = [g(F.col("x")[i]).alias(f"{k}{i}") for i in range(STATS) for k, g in (("m", F.avg), ("s", F.stddev_pop))]
    got = labelled.agg(F.count("*").alias("n"), F.avg("y").alias("y"), *aggs).first()
    if not got["n"]:
        return Model(np.zeros(STATS), np.ones(STATS), w, b, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    mean, scale = (np.array([got[f"{k}{i}"] for i in range(STATS)], float) for k in "ms")
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), w, b, np.zeros(FEATURES + 1), np.array([0.0]), np.array([0.5]))
    size = FEATURES + 2
    shared = spark.sparkContext.broadcast(model)

    def normal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for part in batches:
            z = np.concatenate([shared.value.project(_matrix(part)), part.column(1).to_numpy()[:, None]], 1)
            total += z.T @ z
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(size * size), pa.int32()), pa.array(total.ravel())], ["cell", "v"])

    cells = labelled.where(~F.col("calibrate")).select("x", F.col("y").cast("double").alias("y")).mapInArrow(normal, "cell int, v double")
    total = np.zeros(size * size)
    for cell, v in cells.groupBy("cell").agg(F.sum("v").alias("v")).collect():  # size * size rows
        total[cell] = v
    total = total.reshape(size, size)
    a, y = total[:-1, :-1], total[:-1, -1]
    n = max(1.0, total[-2, -2])
    beta = np.linalg.solve(a + ridge * n / FEATURES * np.eye(size - 1), y)
    model = Model(model.mean, model.scale, w, b, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    raw = spark.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, positive = np.zeros(BINS, np.int64), np.zeros(BINS)
        for part in batches:
            k = np.clip((raw.value.raw(_matrix(part)) + 0.5) * BINS / 2, 0, BINS - 1).astype(int)
            count += np.bincount(k, minlength=BINS)
            positive += np.bincount(k, weights=part.column(1).to_numpy(), minlength=BINS)
        seen = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(seen, pa.int32()), pa.array(count[seen]), pa.array(positive[seen])], ["bin", "n", "p"])

    held = labelled.where("calibrate").select("x", F.col("y").cast("double").alias("y"))
    rows = sorted(map(tuple, held.mapInArrow(bins, "bin int, n long, p double").groupBy("bin").agg(F.sum("n").alias("n"), F.sum("p").alias("p")).collect()))  # BINS rows at most
    if not rows:
        return Model(model.mean, model.scale, w, b, beta, np.array([0.0, 1.0]), np.array([0.0, 1.0]))
    k, counts, positives = (np.array(x, float) for x in zip(*rows))
    at, value = isotonic((k + 0.5) * 2 / BINS - 0.5, positives, counts)
    return Model(model.mean, model.scale, w, b, beta, at, value)


def score(x: DataFrame, model: Model, keep: tuple[str | Column, ...] = ()) -> DataFrame:
    """`x` (id, x and the columns of `keep`) with score in place of x."""
    shared = x.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = [n for n in b.schema.names if n != "x"]
            s = shared.value.score(_matrix(b)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.names.index(n)) for n in names), pa.array(s, pa.float64())], [*names, "score"])

    own = x.select("id", *keep, "x")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields if f.name != "x"), "score double"])
    return own.mapInArrow(run, schema)
