"""The registered queries and the pipeline over whole test tables, against their SQL or what their contract says."""

from __future__ import annotations

import hashlib
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from strataq.llm import queries
from strataq.llm.tokens import BYTE_BPE, WORD_BPE, Encoder

D, E = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")


@pytest.fixture(scope="module")
def texts(spark):
    return {r.doc_id: r.text or "" for r in spark.read.parquet(f"{D}/documents.parquet").select("doc_id", "text").collect()}


def _fold(i, n):
    return zlib.crc32(str(i).encode()) % n


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        db.sql(f"CREATE VIEW {t} AS SELECT * FROM '{D}/{t}.parquet'")
    shown = lambda df: sorted(tuple(f"{x:.6f}" if isinstance(x, float) else str(x) for x in r) for r in df[sorted(df.columns)].itertuples(index=False, name=None))
    got, want = queries.QUERIES[name](spark, D).toPandas(), db.sql(queries.ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and shown(got) == shown(want) and len(got)


def test_quality_ranks_held_out_documents(spark):
    got = queries.op1_quality(spark, E).join(spark.read.parquet(f"{E}/labels.parquet"), "doc_id").where("held_out and quality is not null").collect()
    assert all(_fold(r.doc_id, 5) == 0 and r.predicted == (r.score >= 0.3) for r in got)
    order = np.argsort([r.score for r in got])
    rank = np.empty(len(got))
    rank[order] = np.arange(len(got))
    y = np.array([r.quality for r in got])
    auc = (rank[y == 1].sum() - (y == 1).sum() * ((y == 1).sum() - 1) / 2) / ((y == 1).sum() * (y == 0).sum())
    assert auc > 0.97


def test_language_is_right_on_held_out_documents(spark):
    got = queries.op5_language(spark, E).join(spark.read.parquet(f"{E}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (_fold(r.doc_id, 3) == 1) for r in got)
    held = [r for r in got if r.held_out and r.lang]
    assert sum(r.lang == r.lang_pred for r in held) >= 0.98 * len(held) > 0


def test_mix_meets_its_targets(spark):
    got = queries.op4_mix_sources(spark, D).collect()
    by: dict = {}
    for r in got:
        assert 0 <= r.taken <= 3 * r["size"]
        k = by.setdefault((r.source_size, r.target), [0])
        k[0] += r.taken
    assert all(abs(taken[0] - target) <= max(300, 0.02 * target) for (_, target), taken in by.items())


def test_near_duplicates_are_those_of_the_full_sets(spark, texts):
    low = {i: t.encode().lower().split() for i, t in texts.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) > 4 else {tuple(w)} if w else set() for i, w in low.items()}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = queries.op8_near_duplicates(spark, D).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in got} == {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def test_token_files_hold_the_ids_of_the_library(spark, texts):
    e = Encoder(WORD_BPE)
    at = 0
    got = {r.doc_id: r for r in queries.op9_token_files(spark, D).collect()}
    assert set(got) == set(texts)
    for i in sorted(texts):
        ids = np.array(e.tokenizer.encode(texts[i], add_special_tokens=False).ids + [1], "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_packs_hold_each_id_once(spark, texts):
    e = Encoder(BYTE_BPE)
    ids = {i: np.array(e.tokenizer.encode(t, add_special_tokens=False).ids + [1], "<u4") for i, t in texts.items()}
    seen, by = dict.fromkeys(texts, 0), {}
    for r in queries.op10_pack(spark, D).orderBy("doc_id", "start").collect():
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids[r.doc_id]) and r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes())
        seen[r.doc_id] += r.length
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert seen == {i: len(x) for i, x in ids.items()}
    for pieces in by.values():
        total = sum(n for _, n in pieces)
        assert total <= 2048 and [o for o, _ in sorted(pieces)] == list(np.cumsum([0] + [n for _, n in sorted(pieces)])[:-1])


def test_pipeline_runs_from_end_to_end(spark, texts):
    out = corpus_pipeline.run(spark, D).collect()
    assert out and {r.doc_id for r in out} <= set(texts)
    by: dict = {}
    for r in out:
        by.setdefault(r.sequence_id, []).append(r.length)
    assert all(sum(x) <= 2048 for x in by.values())
    gone = {i for i, t in texts.items() if not any(c.isalpha() for c in t)}
    assert not gone & {r.doc_id for r in out}
    docs = spark.read.parquet(f"{D}/documents.parquet")
    again = corpus_pipeline.without_near_copies(spark, docs.unionByName(docs.withColumn("doc_id", F.col("doc_id") + 10**6)), D)
    assert again.where("doc_id >= 1000000 and text rlike '\\\\S'").count() == 0
    assert len({hashlib.sha256(t.encode()).hexdigest() for t in texts.values()}) >= again.where("text rlike '\\\\S'").count()
