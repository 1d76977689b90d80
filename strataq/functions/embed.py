"""Embedders: anything with `dimension`, `model_name` and `embed_batch(texts) -> list of vectors`."""

from __future__ import annotations

import hashlib
import json
import math
import re
import urllib.error
import urllib.request
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import vector


class Embedder(Protocol):
    dimension: int
    model_name: str

    def embed_batch(self, texts: list[str]) -> list[list[float]]: ...


class Constant:
    """Every text at 0.1 in each dimension: for tests of everything but the vectors."""

    def __init__(self, dimension: int = 384):
        self.dimension, self.model_name = dimension, "constant"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        return [[0.1] * self.dimension for _ in texts]


class Hashed:
    """Signed hashed words at unit length: a model-free embedder that puts texts of like words near each other."""

    def __init__(self, dimension: int = 384):
        self.dimension, self.model_name = dimension, "hashed-words"

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out = []
        for t in texts:
            v = [0.0] * self.dimension
            for w in re.findall(r"\w+", t.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % self.dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out


class Http:
    """Vectors of a server that takes {model, input: [texts]} and gives {embeddings: [...]} or {data: [{embedding}]}.

    A text that is refused alone is an error; a batch that is refused is sent text by text.
    """

    def __init__(self, url: str, model: str, dimension: int, batch: int = 8, timeout: float = 60.0, key: str | None = None):
        self.url, self.model_name, self.dimension, self.batch, self.timeout, self.key = url, model, dimension, batch, timeout, key

    def _ask(self, texts: list[str]) -> list[list[float]]:
        head = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.key}"} if self.key else {})
        request = urllib.request.Request(self.url, json.dumps({"model": self.model_name, "input": texts}).encode(), head)
        with urllib.request.urlopen(request, timeout=self.timeout) as r:
            got = json.load(r)
        out = got["embeddings"] if "embeddings" in got else [x["embedding"] for x in got["data"]]
        if len(out) != len(texts):
            raise ValueError(f"{len(out)} vectors for {len(texts)} texts")
        return out

    def embed_batch(self, texts: list[str]) -> list[list[float]]:
        out: list[list[float]] = []
        for i in range(0, len(texts), self.batch):
            part = texts[i : i + self.batch]
            try:
                out += self._ask(part)
            except urllib.error.HTTPError:
                if len(part) == 1:
                    raise
                for t in part:
                    out += self._ask([t])
        return out


def probe(embedder: Embedder) -> None:
    """Embed one text, and raise if the vector is not as long as the embedder says."""
    (v,) = embedder.embed_batch(["probe"])
    if len(v) != embedder.dimension:
        raise ValueError(f"{embedder.model_name} gives {len(v)} numbers, not {embedder.dimension}")


def embed(df: DataFrame, embedder: Embedder, text_col: str = "content", vector_col: str = "vector", dim: int | None = None, batch: int = 64) -> DataFrame:
    """`df` with a vector per text (null text: null), truncated to `dim`; the embedder is made once per Python worker."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out: list = []
            for i in range(0, len(s), batch):
                own = s.iloc[i : i + batch]
                known = [t for t in own if isinstance(t, str)]
                vectors = iter(embedder.embed_batch(known) if known else [])
                out += [next(vectors) if isinstance(t, str) else None for t in own]
            yield pd.Series(out)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    made: Column = F.pandas_udf(run, "array<float>")(F.col(text_col))
    df = df.withColumn(vector_col, made).withColumn("_model_name", F.lit(embedder.model_name))
    return df.withColumn(vector_col, vector.truncate(F.col(vector_col), dim).cast("array<float>")) if dim and dim < embedder.dimension else df
