"""Operators on small tables with nulls, empty and long texts, ties, repeated rows, clashing columns and no rows."""

from __future__ import annotations

import random
import re
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from strataq.llm import exact_dedup, hamming, language, line_dedup, minhash, mixing, packing, quality, token_io, tokens, warc
from strataq.llm.common import Scratch
from strataq.llm.tokens import BYTE_BPE, WORD_BPE, Encoder

DOCS = "doc_id long, text string, lang string, source string, n_chars long, content string, digest string, key long"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, "en", s, len(t or ""), "x", "x", 1) for i, t, s in rows], DOCS)


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(400)]
    base = [" ".join(rng.choices(vocab, k=rng.randint(20, 120))) for _ in range(30)]
    out = list(base)
    for b in base[:10]:
        for _ in range(4):
            w = b.split()
            w[rng.randrange(len(w))] = "zz"
            out.append(" ".join(w))
    out += [base[0], base[0].replace(" ", "  \n"), base[1].upper(), "", None, "one two", "One  two", "one", "long " * 30_000]
    return out


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_equals_the_library(name):
    e = Encoder(name)
    odd = ["", " ", "a  b", " a b ", "a\n b", "a\n \tb", "a \tb", "it's don't 'S x", "Ünï ÅB ΣΑΣ áb é", "x <|endoftext|> y", "a\t b", "12 3a a3 a_b ½²", "İstanbul Ǆ ŉ", "foo\x1cbar \x1c b", "ɏ ẞ ſ K", "word.### and", "日本 語", "a b 　c", "é Éx", "THE!! OF.!!"]
    rng = random.Random(1)
    odd += ["".join(rng.choices("ab .,!\n\t'é1 ", k=60)) for _ in range(200)]
    for text, got in zip(odd, e.encode(odd)):
        assert np.frombuffer(got, e.dtype).tolist() == e.tokenizer.encode(text, add_special_tokens=False).ids, repr(text)
    assert list(e.encode([None, ""])) == [b"", b""] and list(e.encode([])) == []


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_in_small_steps_equals_the_library(name, texts, monkeypatch):
    monkeypatch.setattr(tokens, "STEP_WORDS", 7)
    monkeypatch.setattr(tokens, "CALL_TEXTS", 3)
    e = Encoder(name)
    some = [*texts[:-1], "a  b\tc " * 20, "naïve-Äö ... №5 <eos>, 語 語x " * 9, "one", ""]
    got = [np.frombuffer(x, e.dtype).tolist() for x in e.encode(some)]
    assert got == [e.tokenizer.encode(t or "", add_special_tokens=False).ids for t in some]


@pytest.mark.parametrize("name", [BYTE_BPE, WORD_BPE])
def test_encoder_holds_a_few_times_a_group(name):
    e = Encoder(name)
    text = "of it 12 be, " * 500 + "or"
    column = pa.array([text] * 2400)
    assert 15 << 20 > column.nbytes > 14 << 20  # one group
    tracemalloc.start()  # counts arrays and bytes, not what Arrow and the library hold
    n = sum(len(x) for x in e.encode(column))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert n == 2400 * e.dtype.itemsize * len(e.tokenizer.encode(text, add_special_tokens=False).ids)
    assert peak < 8 * column.nbytes


def test_exact_dedup_with_collisions(spark, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)] + [(None, "lost", "s"), (3, texts[3], "s")]
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for i, t, _ in rows:
        groups.setdefault(norm(t), []).append(i)
    for digest in (exact_dedup.sha256, lambda c: F.substring(F.sha2(c.cast("binary"), 256), 1, 1)):
        got = exact_dedup.exact_dedup(docs(spark, rows), digest=digest).collect()
        assert len(got) == len(rows)
        want = Counter((i, min([x for x in groups[norm(t)] if x is not None], default=None), len(groups[norm(t)])) for i, t, _ in rows)
        assert Counter((r.doc_id, r.keep_id, r.group_size) for r in got) == want
        assert all(r.kept == (r.doc_id == r.keep_id) for r in got)
    assert exact_dedup.exact_dedup(docs(spark, [])).count() == 0


def test_exact_dedup_of_a_hot_group(spark):
    rows = [(i, "hot" if i % 3 else f"t{i}", "s") for i in range(3000)]
    got = exact_dedup.exact_dedup(docs(spark, rows)).collect()
    assert {r.group_size for r in got if r.doc_id % 3} == {2000}
    assert sum(r.kept for r in got) == 1001


def _sets(rows):
    out = {}
    for i, t, _ in rows:
        w = (t or "").encode().lower().split()
        n = min(5, len(w))
        out[i] = frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1)) if w else frozenset()
    return out


def test_near_duplicates_equal_brute_force(spark, texts):
    rows = [(i + 10, t, "s") for i, t in enumerate(texts)]
    s = _sets(rows)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and s[a] and s[b] and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    got = {r.doc_id: r for r in minhash.near_duplicates(docs(spark, rows + [(None, "no id", "s"), (10, texts[0], "s")])).collect()}
    for i in s:
        assert (got[i].n_shingles, got[i].component_id, got[i].kept) == (len(s[i]), find(i), find(i) == i)
    assert got[None].kept and got[None].component_id is None
    assert minhash.near_duplicates(docs(spark, [])).count() == 0


def test_blocks_find_what_the_star_misses():
    sets = [minhash.shingles(" ".join(f"a{i}" for i in range(k, k + 300)).encode()) for k in (0, 10, 200)] * 2
    sig = minhash.packed(np.stack([minhash.minima(x) for x in sets])).view(np.uint64)
    rep = np.array([1, 2, 3] * 2)
    sides = np.arange(3), np.arange(3, 6)
    assert minhash._links(*sides, rep, rep, np.full(6, 296), sig, sets, 0.7, 85) == [(1, 2)]
    assert minhash._links(*sides, rep, np.array([1, 1, 3] * 2), np.full(6, 296), sig, sets, 0.7, 85) == []
    assert minhash._common(*sides, sets).tolist() == [[len(np.intersect1d(a, b)) for b in sets[:3]] for a in sets[:3]]


def test_near_duplicates_of_one_template(spark):
    """Many texts near each other in one bucket, of which some link only through others."""
    rng = random.Random(8)
    base = [f"t{i}" for i in range(90)]
    rows, w = [], list(base)
    for i in range(60):
        w = list(w)
        w[rng.randrange(90)] = f"z{i}"
        rows.append((i, " ".join(w if i % 2 else base[: 45 + i % 40] + w[45 + i % 40 :]), "s"))
    s = _sets(rows)
    root = {i: i for i in s}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in s:
        for b in s:
            if a < b and 100 * len(s[a] & s[b]) >= 85 * len(s[a] | s[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    for small, block in ((48, 1024), (1, 1024), (1, 7)):
        got = {r.doc_id: r.component_id for r in minhash.near_duplicates(docs(spark, rows), small=small, block=block).collect()}
        assert got == {i: find(i) for i in s}


def test_line_dedup_equals_brute_force(spark):
    rng = random.Random(2)
    line = lambda: " ".join(rng.choices(["a", "b", "c", "d"], k=rng.randint(0, 14)))
    pool = [line() for _ in range(12)]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(1, 12))), "s") for i in range(40)] + [(90, None, "s"), (91, "", "s"), (92, "\n\n", "s"), (None, "\n".join(pool), "s")]
    seen, want = set(), {}
    for i, t, _ in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        ls = (t or "").split("\n")
        at = [k for k, x in enumerate(ls) if x.split()]
        gone, new = set(), []
        for a in range(len(at)):
            words = 0
            for b in range(a, len(at)):
                words += len(ls[at[b]].split())
                if words >= 25:
                    run = tuple(ls[k] for k in at[a : b + 1])
                    if run in seen:
                        gone |= set(at[a : b + 1])
                    seen.add(run)
                    break
        want[i] = None if t is None else "\n".join(x for k, x in enumerate(ls) if k not in gone)
    got = {r.doc_id: r.text for r in line_dedup.line_dedup(docs(spark, rows)).collect()}
    assert got == want
    assert sum(len(t or "") for t in want.values()) < sum(len(t or "") for _, t, _ in rows)
    twice = line_dedup.line_dedup(docs(spark, [(1, "x " * 30, "s")] * 2)).collect()
    assert [r.text for r in twice] == ["x " * 30] * 2
    assert line_dedup.line_dedup(docs(spark, [])).count() == 0


def test_mixing_meets_targets(spark):
    rng = random.Random(3)
    rows = [(i, "w " * rng.randint(0, 400), rng.choice(["a", "b", "b", "b", "c", None])) for i in range(3000)] + [(1, "w " * 9, "a"), (None, None, "z")]
    got = mixing.mix_sources(docs(spark, rows), bucket=256)
    again = sorted(map(tuple, got.collect()), key=str)
    assert again == sorted(map(tuple, mixing.mix_sources(docs(spark, rows).repartition(7), bucket=256).collect()), key=str)
    assert len(again) == len(rows)
    total = sum(len((t or "").split()) for _, t, _ in rows)
    by: dict = {}
    for _, size, source_size, target, taken, times, _ in again:
        assert taken == times * size and 0 <= taken <= 3 * size
        k = by.setdefault(source_size, [target, 0])
        k[1] += taken
    assert abs(sum(t for t, _ in by.values()) - total) < 1e-6 * total
    assert all(abs(t - k) <= max(2, 0.001 * t) for t, k in by.values())
    assert mixing.mix_sources(docs(spark, [])).count() == 0


def test_targets_are_filled_like_water(spark):
    sizes = spark.createDataFrame([("a", 10), ("b", 100), ("c", 1000), ("d", 5), (None, 50)], "src string, size long")
    got = {r.src: r.target for r in mixing.source_targets(sizes).collect()}
    size, weight = {"a": 10, "b": 100, "c": 1000, "d": 5, None: 50}, {"a": 1, "b": 2, "c": 3, "d": 1, None: 2}
    target = {k: 0.0 for k in size}
    free, rest = set(size), float(sum(size.values()))
    while True:
        share = {k: rest * weight[k] / sum(weight[x] for x in free) for k in free}
        over = {k for k in free if share[k] > 3 * size[k]}
        if not over:
            target |= share
            break
        for k in over:
            target[k] = 3.0 * size[k]
            rest -= target[k]
        free -= over
    assert got == pytest.approx(target)


def test_rans_round_trip_and_damage():
    rng = np.random.RandomState(0)
    ids = rng.zipf(1.3, 200_000).clip(0, 49_000).astype(np.uint32)
    t = token_io.Table(token_io.scaled(np.bincount(ids, minlength=49_408)))
    for n in (1, 5, 1023, 1024, 1025, 200_000):
        raw = token_io.encode_block(ids[:n], t)
        out, end = token_io.decode_block(raw, 0, t)
        assert (out == ids[:n]).all() and end == len(raw)
    assert len(raw) < 0.8 * 2 * len(ids)
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 1
    with pytest.raises(token_io.Damaged):
        token_io.decode_block(bytes(broken), 0, t)
    with pytest.raises(token_io.Damaged):
        token_io.decode_block(raw[:-4], 0, t)


def test_token_files_round_trip(spark, texts):
    rows = [(i * 7 % 101, t, "s") for i, t in enumerate(texts)] + [(None, "no id", "s"), (0, texts[0], "s")]
    e = Encoder(WORD_BPE)
    with Scratch(spark) as s:
        tokens = s.table(token_io.tokenised(docs(spark, rows), WORD_BPE), "t")
        freq, width = token_io.shared_table(tokens)
        manifest = s.table(token_io.write_files(tokens, s.path("f"), freq, width, per_file=5_000), "m")
        assert manifest.count() > 1
        got = token_io.read_files(manifest, freq).collect()
        assert sorted(map(str, got)) == sorted(map(str, token_io.read_files(manifest, freq, blocks=1).collect()))
        with pytest.raises(TypeError):
            token_io.tokenised(docs(spark, rows).withColumn("doc_id", F.lit("a")), WORD_BPE)
    at = 0
    want = sorted((-1 if i is None else i, e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1]) for i, t, _ in rows)
    got.sort(key=lambda r: r.start)
    assert [-1 if r.id is None else r.id for r in got] == [i for i, _ in want]
    for r in got:
        assert r.start == at and r.n_tokens == len(r.ids) // 4
        at += r.n_tokens
    assert Counter(bytes(r.ids) for r in got) == Counter(np.array(x, "<u4").tobytes() for _, x in want)
    with Scratch(spark) as s:
        tokens = s.table(token_io.tokenised(docs(spark, []), WORD_BPE), "t")
        freq, width = token_io.shared_table(tokens)
        assert token_io.read_files(s.table(token_io.write_files(tokens, s.path("f"), freq, width), "m"), freq).count() == 0


def test_packing_covers_each_id_once(spark, texts):
    rows = [(i, t, "s") for i, t in enumerate(texts)]
    e = Encoder(BYTE_BPE)
    want = {i: np.array(e.tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t, _ in rows}
    with Scratch(spark) as s:
        tokens = s.table(packing.keyed(docs(spark, rows)), "t")
        got = packing.pack(tokens, per_part=9_000).collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, packing.pack(tokens.repartition(5), per_part=9_000).collect()))
        assert packing.pack(s.table(packing.keyed(docs(spark, [])), "none")).count() == 0
    by: dict = {}
    for r in got:
        assert bytes(r.ids) == want[r.doc_id][r.start : r.start + r.length].tobytes() and r.doc_tokens == len(want[r.doc_id])
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sum(r.length for r in got) == sum(map(len, want.values()))
    for pieces in by.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 2048 and at & (at - 1) == 0


def test_hilbert_keys_are_a_walk():
    n = 8
    grid = np.array([(a, b) for a in range(n) for b in range(n)])
    order = grid[np.argsort(packing.hilbert_keys(grid, 3))]
    assert sorted(packing.hilbert_keys(grid, 3)) == list(range(n * n))
    assert (np.abs(np.diff(order, axis=0)).sum(1) == 1).all()


def test_cross_parsing_counts(spark):
    p = language.Parser(language.Model(("x", "y"), ("abcabd", "zzzyzz")))
    n, size = p.phrases(["abcab", "zz abd", "", "q"])
    assert n[0].tolist() == [1, 6] and n[2].tolist() == [0, 0] and size.tolist() == [5, 6, 0, 1]
    s, text = "abcabdabc", "abdabcxbcabd"
    auto = language.suffix_automaton([ord(c) for c in s])
    for i in range(len(text)):
        for j in range(i + 1, len(text) + 1):
            state, ok = 0, True
            for c in text[i:j]:
                ok = ok and ord(c) in auto[state]
                state = auto[state].get(ord(c), 0) if ok else 0
            assert ok == (text[i:j] in s)


def test_language_identification(spark):
    en, de = "the cat sat on the mat and the dog ran ", "der hund und die katze sind nicht hier gewesen "
    train = spark.createDataFrame([(1, en * 20, "en", 0), (2, de * 20, "de", 0), (3, None, "fr", 0), (4, "x", None, 0)], "doc_id long, text string, lang string, score int")
    model = language.learn(train)
    assert model.langs == ("de", "en")
    rows = spark.createDataFrame([(1, "the dog sat", 1), (2, "die katze ist", 1), (3, None, 1), (4, "12 !!", 1), (5, "", 1), (6, "und " * 50_000, 1), (6, "und", 1)], "doc_id long, text string, score int")
    got = sorted((r.doc_id, r.lang_pred) for r in language.identify(rows, model).collect())
    assert got == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (6, "de"), (6, "de")]
    none = language.learn(train.limit(0))
    assert {r.lang_pred for r in language.identify(rows, none).collect()} == {"und"}


def test_isotonic_is_rising():
    at, value = quality.isotonic(np.arange(6.0), np.array([0, 3, 1, 2, 5, 5.0]), np.full(6, 5.0))
    assert (np.diff(value) >= 0).all() and (np.diff(at) > 0).all() and value[0] == 0 and value[-1] == 1


def test_quality_learns_and_survives_empty_input(spark, texts):
    good, bad = [f"Plain words number {i} follow each other. Then more." for i in range(80)], [f"### {i} $$$ %%% && !!! SHOUT !!!" for i in range(80)]
    rows = [(i, t, "s") for i, t in enumerate(good + bad + texts)]
    x = quality.features(docs(spark, rows), "doc_id", "text")
    y = x.where("id < 160").select("x", (F.col("id") < 80).cast("double").alias("y"), (F.col("id") % 4 == 0).alias("calibrate"))
    got = {r.id: r.score for r in quality.score(x, quality.fit(y)).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(80)) > max(got[i] for i in range(80, 160))
    assert {r.score for r in quality.score(x, quality.fit(y.limit(0))).collect()} == {0.5}


def test_hamming_top_k_equals_brute_force(spark):
    rng = random.Random(4)
    codes = [rng.getrandbits(64) - (1 << 63) for _ in range(150)]
    rows = [(i, rng.choice(codes) ^ (1 << rng.randrange(63)) if i % 3 else codes[0]) for i in range(400)] + [(400, None), (0, codes[0])]
    rows[0] = (0, codes[0])
    base = spark.createDataFrame(rows, "id long, code long")
    got: dict = {}
    for r in hamming.top_k(base, base.where("id % 50 = 0"), k=5).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    known = {i: c for i, c in rows if c is not None}
    for q in (i for i in known if i % 50 == 0):
        best = sorted((bin((known[q] ^ c) & (1 << 64) - 1).count("1"), i) for i, c in known.items() if i != q)[:5]
        assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(best)]
    assert hamming.top_k(base.limit(0), base.limit(0)).count() == 0
    assert hamming.top_k(base.where("id < 3"), base.where("id = 0"), k=5).count() == 2


def test_warc_round_trip_and_resolution(spark, tmp_path):
    rec = lambda i, kind, url, date, status, headers, body=b"": {"record_id": f"<{i}>", "type": kind, "url": url, "date": date, "status": status, "headers": headers, "body": body}
    all_ = [
        rec("a", "response", "http://www.x.org:80/p/?utm_source=f&q=1#t", "2024-01-01T00:00:00Z", 200, {"ETag": '"1"', "X": "old", "Content-Length": "4"}, b"body"),
        rec("b", "revisit", "https://X.org/p?q=1", "2024-01-03T00:00:00Z", 304, {"etag": 'W/"1"', "x": "new", "Content-Length": "0"}),
        rec("c", "response", "http://x.org/p?q=1", "2024-01-04T00:00:00Z", 200, {"ETag": '"2"'}, b""),
        rec("d", "revisit", "http://x.org/p?q=1", "2024-01-04T00:00:00Z", 304, {"ETag": '"1"'}),
        rec("e", "revisit", "http://x.org/p?q=1", "2023-12-31T00:00:00Z", 304, {"ETag": '"1"'}),
        rec("f", "revisit", "http://x.org/p?q=1", "2024-01-05T00:00:00Z", 304, {}),
    ]
    (tmp_path / "a.warc.gz").write_bytes(b"".join(map(warc.write_record, all_)))
    (tmp_path / "b.warc").write_bytes(b"".join(warc.write_record(x, compress=False) for x in all_) + b"WARC/1.1\r\nContent-Length: 99\r\n\r\ncut")
    read = warc.read_warc(spark.read.format("binaryFile").load(str(tmp_path / "*")))
    rows = read.collect()
    assert len(rows) == 12 and {bytes(r.body) for r in rows} == {b"body", b""}
    c = read.withColumn("ts", F.unix_timestamp(F.try_to_timestamp("date"))).withColumn("canonical", F.lit(0))
    lost = spark.createDataFrame([("g", "revisit", None, None, 304, None)], "record_id string, type string, url string, ts long, status int, headers map<string,string>")
    got = {r.record_id: r for r in warc.resolve(c.unionByName(lost, allowMissingColumns=True)).collect()}
    assert {k: (r.outcome, r.response_id) for k, r in got.items()} == {"<b>": ("resolved", "<a>"), "<d>": ("mismatch", "<c>"), "<e>": ("no_response", None), "<f>": ("no_validator", "<c>"), "g": ("no_response", None)}
    assert got["<b>"].headers == {"etag": 'W/"1"', "x": "new", "content-length": "4"}
    assert warc.resolve(c.limit(0)).count() == 0


def test_pipeline_stages(spark, texts):
    """Every stage keeps the columns, also those whose names clash with its own."""
    import corpus_pipeline

    more = {c: F.lit(1) for c in ("score", "lang_pred", "nth", "times", "kept", "id", "rep", "gone", "size")}
    rows = [(i, t, f"s{i % 3}") for i, t in enumerate(texts)] + [(None, "no id but words", None)]
    d = docs(spark, rows).select("doc_id", "text", "lang", "source", "n_chars").withColumns(more)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        with Scratch(spark) as s:
            out = stage(spark, d, "")
            assert out.columns == d.columns
            d = spark.createDataFrame([tuple(r) for r in out.collect()], d.schema)
    kept = d.collect()
    assert {r.doc_id for r in kept} and all(r.text for r in kept) and all(r.score == r.nth == r.size == 1 for r in kept)
    pieces = corpus_pipeline.STAGES[-1][1](spark, d, "").collect()
    assert sum(r.length for r in pieces) == sum(len(x) // 2 + 1 for x in Encoder(BYTE_BPE).encode([r.text for r in kept]))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, d.limit(0), "").count() == 0, name
