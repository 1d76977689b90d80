"""Profiles, jobs and the operations of a service, as methods."""

from __future__ import annotations

import json
import os
import tomllib
import uuid
from dataclasses import dataclass, field
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession

from ..functions.embed import Constant, Embedder, Hashed, Http, probe
from . import ingest

CHUNK_SIZE, OVERLAP, FACETS = 512, 50, ("source_type", "language")


@dataclass
class Profile:
    """Settings of one profile; `max_chunk_bytes` is four times the chunk size where it is not given."""

    embedder: str = "hashed"
    dimension: int = 384
    url: str = ""
    model: str = ""
    chunk_size: int = CHUNK_SIZE
    chunk_overlap: int = OVERLAP
    max_chunk_bytes: int = 0
    quantization: str = "none"
    batch: int = 8
    facets: tuple[str, ...] = FACETS
    strategy: str = "recursive"

    def __post_init__(self):
        self.max_chunk_bytes = self.max_chunk_bytes or 4 * self.chunk_size
        self.facets = tuple(self.facets)

    def make_embedder(self) -> Embedder:
        if self.embedder == "http":
            return Http(self.url, self.model, self.dimension, self.batch)
        return {"hashed": Hashed, "constant": Constant}[self.embedder](self.dimension)


@dataclass
class Config:
    """Profiles and collections of a TOML file: [profiles.x] with settings, [collections.y] with name, profile and overrides of
    them, default_profile, default_collection."""

    profiles: dict[str, dict] = field(default_factory=dict)
    collections: dict[str, dict] = field(default_factory=dict)
    default_profile: str = "default"
    default_collection: str = "default"

    @classmethod
    def load(cls, path: str) -> Config:
        if not os.path.exists(path):
            return cls()
        with open(path, "rb") as f:
            d = tomllib.load(f)
        return cls(**{k: d[k] for k in ("profiles", "collections", "default_profile", "default_collection") if k in d})

    def resolve(self, collection: str | None = None, profile: str | None = None) -> tuple[str, Profile]:
        """Name and settings of a collection by alias or name.  The profile: the one asked for, the collection's, the default."""
        key = collection or self.default_collection
        own = self.collections.get(key) or next((c for c in self.collections.values() if c.get("name") == key), {})
        chosen = profile or own.get("profile") or self.default_profile
        if chosen not in self.profiles and chosen != "default":
            raise KeyError(f"profile {chosen}")
        over = {k: v for k, v in own.items() if k not in ("name", "profile")}
        return own.get("name", key), Profile(**(self.profiles.get(chosen, {}) | over))


@dataclass
class Jobs:
    """A file of jobs; those that run under a process which is gone are not shown as running."""

    path: str

    def _read(self) -> list[dict]:
        try:
            with open(self.path) as f:
                return json.load(f)
        except (OSError, ValueError):
            return []

    def _write(self, jobs: list[dict]) -> None:
        os.makedirs(os.path.dirname(os.path.abspath(self.path)), exist_ok=True)
        new = f"{self.path}.{uuid.uuid4().hex}"
        with open(new, "w") as f:
            json.dump(jobs, f)
        os.replace(new, self.path)

    def start(self, kind: str, collection: str) -> str:
        job = {"id": uuid.uuid4().hex, "kind": kind, "collection": collection, "status": "running", "progress": 0.0, "pid": os.getpid(), "started": datetime.now(UTC).isoformat(), "error": None}
        self._write([*self._read(), job])
        return job["id"]

    def update(self, job_id: str, **changes) -> None:
        jobs = self._read()
        if all(j["id"] != job_id for j in jobs):
            raise KeyError(job_id)
        self._write([j | changes if j["id"] == job_id else j for j in jobs])

    def get(self, job_id: str) -> dict:
        return next(j for j in self._read() if j["id"] == job_id)

    def running(self) -> list[dict]:
        return [j for j in self._read() if j["status"] == "running" and _alive(j["pid"])]

    def all(self) -> list[dict]:
        return self._read()


def _alive(pid: int) -> bool:
    try:
        os.kill(pid, 0)
    except ProcessLookupError:
        return False
    except PermissionError:
        return True
    return True


@dataclass
class Service:
    """What the front ends offer: ingest, search, list, embed, delete, jobs and status, by collection."""

    spark: SparkSession
    root: str
    config: Config = field(default_factory=Config)
    _libraries: dict[str, ingest.Library] = field(default_factory=dict)

    @property
    def jobs(self) -> Jobs:
        return Jobs(f"{self.root.removeprefix('file://')}/jobs.json")

    def library(self, collection: str | None = None, profile: str | None = None) -> tuple[str, ingest.Library, Profile]:
        """One library per collection and profile, its embedder probed when it is made."""
        name, p = self.config.resolve(collection, profile)
        key = f"{name}|{p}"
        if key not in self._libraries:
            e = p.make_embedder()
            probe(e)
            self._libraries[key] = ingest.Library(self.spark, self.root, e)
        return name, self._libraries[key], p

    def ingest_path(self, path: str, collection: str | None = None, profile: str | None = None, **options) -> dict:
        name, lib, p = self.library(collection, profile)
        job = self.jobs.start("ingest", name)
        try:
            lib.store.create(name, lib.embedder.dimension, p.quantization)
            out = lib.ingest(path, name, ingest.Options(**({"max_chunk_bytes": p.max_chunk_bytes, "chunk_size": p.chunk_size, "strategy": p.strategy} | options)))
        except Exception as e:
            self.jobs.update(job, status="failed", error=str(e))
            raise
        self.jobs.update(job, status="done", progress=1.0)
        return out | {"job": job}

    def ingest_history(self, repo: str, ref: str, into: str, collection: str | None = None) -> dict:
        name, lib, _ = self.library(collection)
        return lib.ingest_revision(repo, ref, name, into)

    def search_vectors(self, text: str, collection: str | None = None, k: int = 10, filters: dict | None = None, smart: bool = False) -> DataFrame:
        name, lib, p = self.library(collection)
        return lib.search(text, name, k, filters, smart, p.facets)

    def embed(self, texts: list[str], collection: str | None = None) -> list[list[float]]:
        return self.library(collection)[1].embedder.embed_batch(texts)

    def list_collections(self, collection: str | None = None) -> DataFrame:
        """Collections and whether the embedder of `collection` fits them."""
        _, lib, _ = self.library(collection)
        return lib.store.status(lib.embedder.dimension)

    def delete_collection(self, name: str, confirm: str) -> None:
        self.library(name)[1].store.delete(name, confirm)

    def get_job_status(self, job_id: str) -> dict:
        return self.jobs.get(job_id)

    def status(self) -> dict:
        store = self.library()[1].store
        return {"root": self.root, "collections": store.names(), "tasks": store.tasks().count(), "jobs": self.jobs.running()}
