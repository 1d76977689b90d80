"""Collections of points as Parquet tables under one root, with a log of catalog entries each.

An entry names the folders that hold the points: a base and the upserts since, oldest first.  Entry n + 1 is a file of its own
that is created only if there is none, so of two writers one starts anew with what the other wrote, and readers see the old
or the new entry, never half of one: a file that doesn't parse belongs to a writer that was lost, and is passed over.

An upsert writes its own rows only.  A read lets later rows replace earlier ones by id; every `MOST_DELTAS` upserts the
collection is written as one base again.  `vacuum` deletes folders that no kept entry and no snapshot names.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import vector

QUANTIZATIONS = ("none", "scalar", "binary")
MOST_DELTAS = 8


@dataclass
class Store:
    spark: SparkSession
    root: str

    def _path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}")

    def _fs(self, path):
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _list(self, name: str) -> list[str]:
        path = self._path(name)
        fs = self._fs(path)
        return sorted(s.getPath().getName() for s in (fs.listStatus(path) if fs.exists(path) else []))

    def _text(self, name: str) -> str:
        path = self._path(name)
        stream = self._fs(path).open(path)
        try:
            return bytes(self.spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _create(self, name: str, text: str) -> bool:
        """Write a new file; False if there is one."""
        path = self._path(name)
        try:
            out = self._fs(path).create(path, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception):
                return False
            raise
        out.write(bytearray(text.encode()))
        out.close()
        return True

    def _entries(self, name: str) -> list[tuple[int, dict]]:
        """Numbers and entries, newest first; those of lost writers are left out."""
        out = []
        for n in sorted((int(x.split(".")[0]) for x in self._list(f"{name}/_log") if x.split(".")[0].isdigit()), reverse=True):
            try:
                out.append((n, json.loads(self._text(f"{name}/_log/{n:08d}.json"))))
            except ValueError:
                continue
        return out

    def _read(self, name: str) -> dict | None:
        return next((e for _, e in self._entries(name) if not e.get("deleted")), None) if self._list(f"{name}/_log") else None

    def _change(self, name: str, change: Callable[[dict | None], dict | None], tries: int = 20) -> dict | None:
        """Append what `change` makes of the newest entry (None: nothing to do), anew if another writer was faster."""
        for _ in range(tries):
            numbers = [int(x.split(".")[0]) for x in self._list(f"{name}/_log") if x.split(".")[0].isdigit()]
            entry = change(self._read(name))
            if entry is None or self._create(f"{name}/_log/{max(numbers, default=0) + 1:08d}.json", json.dumps(entry)):
                return entry
        raise RuntimeError(f"{name}: too many writers")

    def create(self, name: str, dim: int, quantization: str = "none") -> None:
        """No effect if the collection is there."""
        if quantization not in QUANTIZATIONS:
            raise ValueError(f"quantization is one of {QUANTIZATIONS}")
        new = {"name": name, "dim": dim, "quantization": quantization, "id": str(uuid.uuid4()), "parts": [], "snapshots": {}}
        self._change(name, lambda e: new if e is None else None)

    def exists(self, name: str) -> bool:
        return self._read(name) is not None

    def delete(self, name: str, confirm: str) -> None:
        if confirm != f"{name}-DELETE":
            raise PermissionError(f"confirm with {name}-DELETE")
        path = self._path(name)
        self._fs(path).delete(path, True)

    def entry(self, name: str) -> dict:
        if (e := self._read(name)) is None:
            raise KeyError(name)
        return e

    def collection_id(self, name: str) -> str:
        return self.entry(name)["id"]

    def set_collection_id(self, name: str, value: str) -> None:
        self.entry(name)
        self._change(name, lambda e: e | {"id": value})

    def names(self) -> list[str]:
        return [n for n in self._list("") if self.exists(n)]

    def _points(self, name: str, parts: list[str], id_col: str = "id") -> DataFrame | None:
        out = None
        for part in parts:
            new = self.spark.read.parquet(f"{self.root}/{name}/{part}")
            out = new if out is None else out.join(new.select(id_col), id_col, "left_anti").unionByName(new, allowMissingColumns=True)
        return out

    def points(self, name: str, id_col: str = "id") -> DataFrame | None:
        """The current points; None before the first upsert."""
        return self._points(name, self.entry(name)["parts"], id_col)

    def _written(self, name: str, df: DataFrame) -> str:
        part = f"v-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}/{part}")
        return part

    def upsert(self, name: str, new: DataFrame, id_col: str = "id", vector_col: str = "vector", order: str | None = None) -> None:
        """Add points; of one id the new row replaces the old, and of new rows the last by `order` counts."""
        vector.check_dimension(new, self.entry(name)["dim"], vector_col)
        part = self._written(name, upsert_latest(None, new, id_col, order))
        e = self._change(name, lambda e: e | {"parts": [*e["parts"], part]})
        if len(e["parts"]) > MOST_DELTAS:
            self.compact(name, id_col)

    def compact(self, name: str, id_col: str = "id", make: Callable[[DataFrame], DataFrame] = lambda df: df) -> None:
        """Write the points as one base; upserts of others in the meantime stay after it."""
        parts = self.entry(name)["parts"]
        if not parts:
            return
        base = self._written(name, make(self._points(name, parts, id_col)))
        self._change(name, lambda e: e | {"parts": [base, *e["parts"][len(parts) :]]} if e["parts"][: len(parts)] == parts else None)

    def vacuum(self, name: str, keep: int = 10) -> list[str]:
        """Delete the folders that the newest `keep` entries and the snapshots don't name; returns them."""
        entries = [e for _, e in self._entries(name)]
        used = {p for e in entries[:keep] for p in e["parts"]} | {p for x in entries[:1] for parts in x["snapshots"].values() for p in parts}
        gone = [x for x in self._list(name) if x.startswith("v-") and x not in used]
        for x in gone:
            path = self._path(f"{name}/{x}")
            self._fs(path).delete(path, True)
        return gone

    def set_quantization(self, name: str, kind: str) -> None:
        if kind not in QUANTIZATIONS:
            raise ValueError(f"quantization is one of {QUANTIZATIONS}")
        if kind != "none":
            self.entry(name)
            self._change(name, lambda e: e | {"quantization": kind})

    def optimize(self, name: str, vector_col: str = "vector", id_col: str = "id") -> None:
        """Write the quantised column that the catalog asks for."""
        make = {"scalar": vector.quantize_int8, "binary": vector.quantize_binary}.get(self.entry(name)["quantization"])
        if make:
            self.compact(name, id_col, lambda df: df.withColumn("quantized", make(F.col(vector_col))))

    def info(self, name: str, vector_col: str = "vector") -> DataFrame:
        e, df = self.entry(name), self.points(name)
        kind = F.lit(e["quantization"])
        if df is None:
            return self.spark.range(1).select(F.lit(name).alias("name"), F.lit(0).cast("long").alias("count"), F.lit(e["dim"]).alias("dim"), kind.alias("quantization"), F.lit(0).cast("long").alias("bytes"))
        out = df.agg(F.count("*").alias("count"), F.max(F.size(vector_col)).alias("dim"))
        return out.select(F.lit(name).alias("name"), "count", "dim", kind.alias("quantization"), vector.memory_bytes(F.col("count"), F.col("dim"), e["quantization"]).alias("bytes"))

    def status(self, dim: int | None = None) -> DataFrame:
        """name, count, dim, quantization, bytes and, with `dim`, is_compatible of every collection."""
        out = None
        for n in self.names():
            own = self.info(n).withColumn("is_compatible", F.lit(dim is None) | (F.col("dim") == F.lit(dim)))
            out = own if out is None else out.unionByName(own)
        return out if out is not None else self.spark.createDataFrame([], "name string, count long, dim int, quantization string, bytes long, is_compatible boolean")

    def snapshot(self, name: str, label: str | None = None) -> str:
        """Keep the current points under a label; nothing is copied."""
        label = label or f"{name}-{uuid.uuid4().hex[:12]}"
        self.entry(name)
        self._change(name, lambda e: e | {"snapshots": e["snapshots"] | {label: e["parts"]}})
        return label

    def snapshots(self, name: str) -> list[str]:
        return sorted(self.entry(name)["snapshots"])

    def download(self, name: str, label: str, folder: str) -> None:
        """Write a snapshot's points to a folder of their own."""
        parts = self.entry(name)["snapshots"]
        if label not in parts:
            raise KeyError(label)
        points = self._points(name, parts[label])
        if points is not None:
            points.write.mode("overwrite").parquet(folder)

    def restore(self, name: str, label: str) -> None:
        if label not in self.entry(name)["snapshots"]:
            raise KeyError(label)
        self._change(name, lambda e: e | {"parts": e["snapshots"][label]})

    def tasks(self) -> DataFrame:
        return self.spark.createDataFrame([], "id string, kind string, status string, progress double")


def upsert_latest(old: DataFrame | None, new: DataFrame, id_col: str, order: str | None = None) -> DataFrame:
    """`old` with the rows of `new`; of one id the last of `new` by `order` counts, any one without it."""
    if order:
        w = Window.partitionBy(id_col).orderBy(F.desc(order))
        new = new.withColumn("__nth", F.row_number().over(w)).where("__nth = 1").drop("__nth")
    else:
        new = new.dropDuplicates([id_col])
    return new if old is None else old.join(new.select(id_col), id_col, "left_anti").unionByName(new)


def points_exist(points: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    return ids.join(points.select(id_col), id_col, "left_semi")


def not_stored(points: DataFrame, new: DataFrame, id_col: str = "id") -> DataFrame:
    """Rows of `new` whose id isn't stored: to be placed before a costly embedding."""
    return new.join(points.select(id_col), id_col, "left_anti")
