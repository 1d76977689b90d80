"""Operators against brute force where SQL can't express them."""

from __future__ import annotations

import io
import math
import random


import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F



from strataq.llm import hamming, language, line_dedup, minhash, mixing, packing, quality, token_io, warc
from strataq.llm.common import Scratch

SENTENCES = {
    "cs": "příliš žluťoučký kůň úpěl ďábelské ódy", "el": "η γρήγορη αλεπού πηδά πάνω από το σκυλί", "en": "the quick brown fox jumps over the lazy dog", "he": "דג סקרן שט בים מאוכזב ולפתע מצא חברה",
    "hy": "արագ շագանակագույն աղվեսը ցատկում է ծույլ շան վրայով", "ka": "სწრაფი ყავისფერი მელა ახტება ზარმაც ძაღლს", "pl": "zażółć gęślą jaźń pchnąć w tę łódź jeża", "ru": "съешь ещё этих мягких французских булок да выпей чаю",
    "th": "สุนัขจิ้งจอกสีน้ำตาลกระโดดข้ามสุนัขขี้เกียจ", "zh": "敏捷的棕色狐狸跳过了懒狗然后回家睡觉去了", "got": "𐌰𐌽𐌸𐌰𐍂 𐌳𐌰𐌲𐍃 𐌵𐌰𐌼",
}



def _squeezed(text):
    out = ""
    for c in text.lower():
        c = c if c.isalpha() else " "
        if c != " " or out[-1:] != " ":
            out += c
    return out


def _parse(sample, text):
    """Phrases of a greedy longest-match parse of `text`, anew every SEGMENT symbols."""
    total = 0
    for i in range(0, len(text), language.SEGMENT):
        n, held = 1, ""
        for c in text[i : i + language.SEGMENT]:
            if held + c in sample:
                held += c
            else:
                n, held = n + 1, c if c in sample else ""
        total += n
    return total


def test_language_equals_a_longest_match_parse_in_eleven_scripts(spark):
    rng = random.Random(3)
    rows = [(k, " ".join([t] * rng.randint(3, 9)) + "\n" + " ".join(rng.sample(t.split(), len(t.split()))), lang) for k, (lang, t) in enumerate(SENTENCES.items())]
    train = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(train)
    assert model.langs == tuple(sorted(SENTENCES))
    texts = [t[rng.randint(0, 8) : rng.randint(20, 60)] for t in SENTENCES.values()] * 2 + [" ".join(SENTENCES.values()), "no such letters: ლ ሀ", "x" * 700, "ru и en " * 90]
    samples = {lang: _squeezed(t) for lang, t in zip(model.langs, model.texts)}
    got = {r.doc_id: r.lang_pred for r in language.identify(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string"), model).collect()}
    n, size = language.Parser(model).phrases(texts)
    for i, t in enumerate(texts):
        s = _squeezed(t)
        want = [_parse(samples[lang], s) for lang in model.langs]
        assert n[i].tolist() == want and size[i] == len(s)
        cost = [w * math.log2(max(2, len(samples[lang]))) for w, lang in zip(want, model.langs)]
        assert got[i] == model.langs[min(range(len(cost)), key=lambda k: cost[k])]
    assert [got[i] for i in range(2 * len(SENTENCES))] == list(SENTENCES) * 2


def test_language_samples_hold_whole_texts_and_copies_once(spark):
    rows = [(i, "abc def " * 4, "x") for i in range(50)] + [(60 + i, f"word{i} other text", "x") for i in range(50)] + [(200, "lang " * 500, "x"), (201, "nur lange " * 300, "y"), (202, "nur lange texte " * 300, "y"), (203, "123", "z")]
    model = language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_rows=20, max_chars=200)
    texts = dict(zip(model.langs, model.texts))
    assert set(texts) == {"x", "y"} and texts["y"] == "nur lange " * 300
    assert set(texts["x"].split("\n")) <= {t for _, t, _ in rows} and "lang lang" not in texts["x"] and len(texts["x"]) < 240


def test_language_columns_may_have_any_name(spark):
    d = spark.createDataFrame([(1, "the cat", "en", 5, 6, 7)], "__lang long, text string, lang string, __text int, c0 int, t int")
    model = language.learn(d, id_col="__lang")
    out = language.identify(d, model, id_col="__lang", keep=("__text", "c0", "t"))
    assert out.columns == ["__lang", "__text", "c0", "t", "lang_pred", "score"] and tuple(out.first())[:5] == (1, 5, 6, 7, "en")


def test_sparse_automata_are_the_dense_ones():
    rng = random.Random(9)
    s = [rng.randrange(3, 40) for _ in range(3000)]
    nxt = language.suffix_automaton(s)
    d = language.displaced(nxt, 45)
    assert sum(d.owner >= 0) == sum(map(len, nxt))
    text = [rng.randrange(3, 40) if rng.random() < 0.5 else s[i] for i in range(900)] + [0, 44, 3]
    block = np.array(text, np.int32)[:, None]
    state, n = 0, 1
    for c in text:
        if c in nxt[state]:
            state = nxt[state][c]
        else:
            state, n = nxt[0].get(c, 0), n + 1
    assert d.parse(block, np.full(len(text), 1)).tolist() == [n]


def test_packing_splits_a_hot_cell_by_the_curve(spark):
    """Keys that share their first bits: parts are ranges of keys, and only one hot key is split among parts."""
    rng = random.Random(6)
    base, hot = 5 << 40, (5 << 40) + 77_000
    keys = [base + rng.randrange(100_000) for _ in range(300)] + [hot] * 150 + [rng.randrange(1 << 60) for _ in range(50)]
    rows = [(i, k, 40, np.full(40, i, "<u2").tobytes()) for i, k in enumerate(keys)] + [(None, hot, 40, bytes(80))] * 3
    with Scratch(spark) as s:
        tokens = s.table(spark.createDataFrame(rows, "id long, key long, n_tokens long, ids binary"), "t")
        cells = packing.ranges(tokens, 1000, cells=64)
        parts: dict = {}
        for r in packing.placed(tokens, cells).collect():
            parts.setdefault(r.part, []).append(r.key)
        assert max(len(x) for x in parts.values()) * 40 < 3000
        last = -1
        for part in sorted(parts):
            assert min(parts[part]) > last or set(parts[part]) == {hot}
            last = max(parts[part])
        shared = [p for p, x in parts.items() if hot in x]
        assert len(shared) > 3 and all(set(parts[p]) == {hot} for p in shared)
        got = packing.pack(tokens, length=64, per_part=1000).collect()
    assert sum(r.length for r in got) == 40 * len(rows)
    by: dict = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert all(sum(n for _, n in x) & (sum(n for _, n in x) - 1) == 0 and sum(n for _, n in x) <= 64 for x in by.values())
    assert all([o for o, _ in sorted(x)] == list(np.cumsum([0] + [n for _, n in sorted(x)])[:-1]) for x in by.values())


def test_packing_takes_ids_of_any_kind(spark):
    d = spark.createDataFrame([("a", "some words"), (None, None), ("a", "more words here"), ("a", "more words here")], "doc_id string, text string")
    with Scratch(spark) as s:
        got = packing.pack(s.table(packing.keyed(d), "t")).collect()
    assert {r.doc_id for r in got} == {"a", None} and sum(r.length for r in got) == 3 + 1 + 2 * 4


def test_any_range_of_blocks_is_read_alone():
    rng = np.random.RandomState(2)
    table = token_io.Table(token_io.scaled(np.bincount(rng.randint(0, 500, 5000), minlength=500)))
    docs = [(i if i % 5 else None, rng.randint(0, 500, n).astype(np.uint32)) for i, n in enumerate([1, 3, 250, 40, 99, 1000, 1, 1, 64, 128, 7])]
    out = io.BytesIO()
    w = token_io.Writer(out, table, block=100)
    for i, ids in docs:
        w.add(i, ids)
    w.close()
    file = pa.BufferReader(out.getvalue())
    n = len(w.blocks)
    for step in (1, 2, 5, n):
        got = [x for k in range(0, n, step) for x in token_io.read_documents(file, table, k, k + step)]
        assert [(i, ids.tolist()) for i, _, ids in got] == [(i, ids.tolist()) for i, ids in docs]
        assert [s for _, s, _ in got] == np.cumsum([0, *(len(x) for _, x in docs)])[:-1].tolist()
    with pytest.raises(token_io.Damaged):
        list(token_io.read_documents(pa.BufferReader(out.getvalue()[:-9]), table))


def test_stores_that_hadoop_names_otherwise():
    assert token_io.file_system("file:/tmp/x")[1] == token_io.file_system("/tmp/x")[1] == token_io.file_system("file:///tmp/x")[1] == "/tmp/x"
    with pytest.raises((ValueError, OSError)):
        token_io.file_system("nostore://bucket/x")


def test_token_files_split_a_hot_id(spark):
    rows = [(None, f"text {i}") for i in range(3000)] + [(i, "copy of one text") for i in [7] * 3000] + [(9, "last")]
    with Scratch(spark) as s:
        tokens = s.table(token_io.tokenised(spark.createDataFrame(rows, "doc_id long, text string"), "word_bpe_49k.json").repartition(4), "t")
        freq, width = token_io.shared_table(tokens)
        manifest = s.table(token_io.write_files(tokens, s.path("f"), freq, width, per_file=3000), "m")
        assert max(r.docs for r in manifest.collect()) < 3000
        got = sorted(token_io.read_files(manifest, freq).collect(), key=lambda r: r.start)
    assert [r.id for r in got] == [None] * 3000 + [7] * 3000 + [9]
    assert [r.start for r in got] == np.cumsum([0, *(r.n_tokens for r in got)])[:-1].tolist()


CAPTURE = "record_id string, type string, url string, ts long, status int, headers map<string,string>"


def _resolved(rows):
    """Outcome and response per revisit, by a loop over all captures."""
    low = lambda h: {k: ", ".join(v for n, v in (h or {}).items() if n.lower() == k) for k in {n.lower() for n in h or {}}}
    out = []
    rows = sorted({(u, t, k != "response", i or "", i is None, tuple(sorted(low(h).items()))): (i, k, u, t, low(h)) for i, k, u, t, _, h in rows}.items())
    for key, (i, kind, url, ts, new) in rows:
        if kind == "response":
            continue
        before = [(k, r) for k, r in rows if r[1] == "response" and r[2] == url and k[:3] < (url, ts, True)]
        hit = max(before, key=lambda x: (x[0][1], x[0][3], x[0][5]))[1] if before else None
        old = hit[4] if hit else {}
        same = None
        for name in ("etag", "last-modified"):
            if same is None and name in new and name in old:
                same = new[name].removeprefix("W/") == old[name].removeprefix("W/")
        outcome = "no_response" if hit is None else "no_validator" if same is None else "resolved" if same else "mismatch"
        merged = tuple(sorted((old | {k: v for k, v in new.items() if k not in warc.FIXED}).items())) if outcome == "resolved" else None
        out.append((i, url, ts, outcome, hit[0] if hit else None, merged))
    return sorted(out, key=str)


@pytest.mark.parametrize("parts", [1, 7])
def test_revisits_equal_a_loop(spark, parts):
    """A hot URL within one day, repeated record ids with other headers, null ids, repeated rows, names that differ in case."""
    rng = random.Random(parts)
    rows = []
    for n in range(900):
        url = "hot.org" if n % 3 else f"u{n % 40}.org/a"
        kind = rng.choice(["response", "revisit", "revisit"])
        headers = rng.choice([{"ETag": f'"{rng.randrange(3)}"'}, {"etag": f'W/"{rng.randrange(3)}"', "X": str(n % 5)}, {"ETag": '"1"', "etag": '"1"'}, {"Last-Modified": "d1", "Content-Length": str(n % 9)}, {}, {"last-modified": "d1", "Vary": "*"}])
        rows.append((rng.choice([None, f"r{rng.randrange(300)}"]), kind, url, rng.randrange(200), 200 if kind == "response" else 304, headers))
    rows += rng.sample(rows, 60)
    got = warc.resolve(spark.createDataFrame(rows, CAPTURE), parts=parts).collect()
    assert sorted([(r.record_id, r.canonical, r.ts, r.outcome, r.response_id, None if r.headers is None else tuple(sorted(r.headers.items()))) for r in got], key=str) == _resolved(rows)


def test_revisits_without_url_time_or_headers(spark):
    rows = [("a", "response", None, 1, 200, None), ("b", "revisit", None, 2, 304, None), ("c", "revisit", "x.org", None, 304, {"etag": "1"}), ("d", "response", "x.org", None, 200, {"etag": "1"}), (None, None, None, None, None, None)]
    got = {r.record_id: (r.outcome, r.response_id) for r in warc.resolve(spark.createDataFrame(rows, CAPTURE).withColumn("part", F.lit(1)).withColumn("full", F.lit(2))).collect()}
    assert got == {"b": ("no_response", None), "c": ("no_response", None)}


def test_flipped_values_are_all_of_a_radius(spark):
    from itertools import combinations

    for width, s in ((1, 0), (1, 1), (6, 3), (16, 2), (33, 1), (5, 5)):
        got = spark.range(1).select(hamming._flipped(F.lit(5 % (1 << width)).cast("long"), width, s).alias("x")).first().x
        want = sorted((5 % (1 << width)) ^ sum(1 << b for b in c) for c in combinations(range(width), s))
        assert sorted(got) == want


@pytest.mark.parametrize("lookup,hot", [(0, 1000), (0, 3), (1e9, 1000), (2, 20)])
def test_top_k_by_lookups_by_scan_and_around_hot_values(spark, lookup, hot):
    """Codes with far neighbours, a template that thousands share in one segment, clashing columns, text ids."""
    rng = random.Random(int(hot))
    rows = [(f"i{i:04d}", rng.getrandbits(64) - (1 << 63)) for i in range(500)] + [(f"t{i:04d}", (rng.getrandbits(12) << 40) + 12345) for i in range(700)] + [("i0001", 7), ("n", None), ("z", 12345)]
    rows += rows[:20]
    base = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], "id string, code long, q int, seg int, key int")
    queries = base.where("id in ('i0000', 'i0001', 't0000', 't0333', 'z', 'n')")
    got: dict = {}
    for r in hamming.top_k(base, queries, k=6, lookup=lookup, hot=hot).collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.distance, r.neighbor_id))
    known = set(rows) - {("n", None)}
    for q in ("i0000", "t0000", "t0333", "z"):
        code = dict(known)[q]
        best = sorted((bin((code ^ c) & (1 << 64) - 1).count("1"), i) for i, c in known if i != q)[:6]
        assert sorted(got[q]) == [(k + 1, *x) for k, x in enumerate(best)]
    assert set(got) == {"i0000", "i0001", "t0000", "t0333", "z"}


def _nearest(ids, codes, k):
    """The k nearest other rows of each row, as (distance, id)."""
    d = np.bitwise_count(codes[:, None] ^ codes[None, :]).astype(np.int64) * 10**9 + ids
    np.fill_diagonal(d, 1 << 62)
    return {int(q): [divmod(int(x), 10**9) for x in row] for q, row in zip(ids, np.sort(np.partition(d, k, axis=1)[:, :k], axis=1))}


@pytest.mark.parametrize("lookup", [0, 1e9])
def test_top_k_of_many_queries_takes_the_passes_of_few(spark, monkeypatch, lookup):
    """Nothing that the driver plans, lists or holds a table of grows with the queries."""
    rng = np.random.default_rng(8)
    codes = rng.integers(0, 1 << 64, 9000, np.uint64)
    codes[3000:6000] = codes[:3000] ^ np.uint64(1) << rng.integers(0, 64, 3000).astype(np.uint64)
    base = spark.createDataFrame(pa.table({"id": np.arange(9000), "code": codes.view(np.int64)}))
    tables, write = [], Scratch.table
    monkeypatch.setattr(Scratch, "table", lambda self, df, name: tables.append(name) or write(self, df, name))
    assert hamming.top_k(base, base.where("id % 100 = 0"), k=3, lookup=lookup).count() == 270
    few = len(tables)
    got: dict = {}
    for r in hamming.top_k(base, base, k=3, lookup=lookup).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    assert len(tables) == 2 * few
    assert got == _nearest(np.arange(9000), codes, 3)


@pytest.mark.parametrize("same", [0, 40])
def test_top_k_in_blocks_of_queries(spark, monkeypatch, same):
    """Blocks of queries, codes that share some or most of their bits, steps of less than a value's codes."""
    monkeypatch.setattr(hamming, "BLOCK", 150)
    monkeypatch.setattr(hamming, "TILE", 64, raising=False)
    rng = np.random.default_rng(same)
    codes = rng.integers(0, 1 << 64, 300, np.uint64) << np.uint64(same)
    base = spark.createDataFrame(pa.table({"id": np.arange(300), "code": codes.view(np.int64)}))
    got: dict = {}
    for r in hamming.top_k(base, base, k=5, lookup=0).orderBy("rank").collect():
        got.setdefault(r.query_id, []).append((r.distance, r.neighbor_id))
    assert got == _nearest(np.arange(300), codes, 5)
    assert hamming.top_k(base.limit(0), base, k=5).count() == 0


def test_masks_are_all_of_a_radius():
    for width, s in ((1, 0), (1, 1), (6, 3), (16, 2), (33, 1), (5, 5), (5, 6)):
        got = hamming._masks(width, s).tolist()
        assert len(got) == len(set(got)) == math.comb(width, s) and all(x.bit_count() == s and x < 1 << width for x in got)


def test_mixing_splits_hot_ids_and_counts_their_rows(spark, monkeypatch):
    """A third of the rows share one id, a third have none; no group that a task gets is above its size."""
    rows = [(7, "w " * (i % 9), "a") for i in range(900)] + [(None, "w " * 5, "b")] * 900 + [(i, "w " * (i % 50), "c") for i in range(900)]
    d = spark.createDataFrame(rows, "doc_id long, text string, source string")
    sizes = []
    mover = mixing._mover

    def counted(level, landing):
        move = mover(level, landing)

        def run(pdf):
            assert len(pdf) < 400
            return move(pdf)

        return run

    monkeypatch.setattr(mixing, "_mover", counted)
    got = mixing.mix_sources(d, bucket=256).collect()
    sizes = sorted((r.doc_id is None, r.doc_id or 0, r.source, r["size"]) for r in got)
    assert sizes == sorted((i is None, i or 0, s, len(t.split())) for i, t, s in rows)
    for source in "abc":
        own = [r for r in got if r.source == source]
        assert abs(sum(r.taken for r in own) - own[0].target) < 0.005 * own[0].target + 3


def test_targets_over_many_sources_in_many_ranges(spark):
    rng = random.Random(1)
    sources = [f"h{i:03d}" for i in range(90)] + ["é", "zz", "\U0001F600", "\uffee", None]
    sizes = [(s, rng.randrange(0, 1000) ** 2) for s in sources]
    got = {r.src: r.target for r in mixing.source_targets(spark.createDataFrame(sizes, "src string, size long"), parts=7).collect()}
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {s: 1 + k % 3 for k, (s, _) in enumerate(order)}
    low, high = 0.0, 1e9
    total = sum(n for _, n in sizes)
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(3 * n, level * weight[s]) for s, n in sizes) < total else (low, level)
    assert got == pytest.approx({s: min(3.0 * n, high * weight[s]) for s, n in sizes}, rel=1e-6, abs=1e-3)


def test_suffix_array_and_its_intervals(spark):
    """Ranks order the suffixes of all runs; an interval holds exactly the suffixes that share their reach."""
    rng = random.Random(12)
    pool = [" ".join(f"w{i}" for _ in range(n)) for i, n in enumerate([1, 2, 3, 7, 9, 26])]
    rows = [(i, "\n".join(rng.choices(pool, k=rng.randint(20, 60)))) for i in range(25)]
    src = spark.createDataFrame([(i, 0, t) for i, t in rows], "id long, fp long, text string")
    with Scratch(spark) as s:
        runs = line_dedup._suffixes(s, src, 25).collect()
        by = {(r.id, r.at): r for r in runs}
        suffix = {}
        for r in runs:
            out = []
            while (x := by.get((r.id, r.at + len(out)))) and x.seg == r.seg:
                out.append(x.r)
            suffix[r.id, r.at] = out
    order = {k: i for i, k in enumerate(sorted(suffix, key=lambda k: suffix[k][:64]))}
    captured = {}
    inner = line_dedup._intervals

    def spy(s, suffixes):
        captured["ranks"] = {(r.id, r.at): r["rank"] for r in suffixes.collect()}
        out = inner(s, suffixes)
        captured["first"] = {r["rank"]: (r.first.id, r.first.at) for r in out.collect()}
        return out

    line_dedup._intervals = spy
    try:
        line_dedup.repeated_lines(src)
    finally:
        line_dedup._intervals = inner
    ranks = captured["ranks"]
    assert set(ranks) == set(suffix)
    keys = sorted(ranks)
    for _ in range(4000):
        a, b = rng.choice(keys), rng.choice(keys)
        assert (ranks[a] < ranks[b]) == (suffix[a][:64] < suffix[b][:64])
    groups: dict = {}
    for k in keys:
        if by[k].need is not None:
            groups.setdefault(tuple(suffix[k][: by[k].need]), []).append(k)
    for members in groups.values():
        want = {min(members)} if len(members) > 1 else {None}
        assert {captured["first"].get(ranks[k]) for k in members} == want
    assert len(order) == len(ranks)


def test_a_template_bucket_emits_true_links_only(spark):
    """20,000 texts of one template, about 0.7 alike, in one bucket: a forest of the few true links comes out."""
    rng = random.Random(4)
    base = [f"t{i}" for i in range(120)]
    rows = []
    for i in range(20_000):
        w = list(base)
        for k in rng.sample(range(20, 100), 4):
            w[k] = f"x{i}_{k}"
        rows.append((i, " ".join(w)))
    for i in range(0, 400, 2):  # true links among them
        w = rows[i][1].split()
        w[0] = "first"
        rows[i + 1] = (i + 1, " ".join(w))
    d = spark.createDataFrame(rows, "id long, text string").repartition(8)
    with Scratch(spark) as s:
        f = s.table(minhash.features(d).select(F.lit(1).alias("key"), F.col("id").alias("rep"), F.col("id").alias("comp"), "n", "sig"), "f")
        sets = s.table(d.mapInArrow(minhash._sets, "id long, digest binary, shingles array<long>").select(F.col("id").alias("rep"), "shingles"), "sets")
        own = f.join(sets, "rep").withColumn("block", F.pmod(F.xxhash64("rep"), F.lit(20)).cast("int"))
        cols = ["key", "i", "j", "side", "rep", "comp", "n", "sig", "shingles"]
        a = own.withColumn("j", F.explode(F.expr("sequence(block, 19)"))).withColumn("i", F.col("block")).withColumn("side", F.lit(0)).select(cols)
        b = own.withColumn("i", F.explode(F.expr("sequence(0, block)"))).withColumn("j", F.col("block")).withColumn("side", F.lit(1)).select(cols)
        sided = a.union(b).repartition(16, "key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
        got = {(r.u, r.v) for r in sided.mapInArrow(minhash._block_links(0.67, 85), "u long, v long").collect()}
    planted, text = {(i, i + 1) for i in range(0, 400, 2)}, dict(rows)
    assert planted <= got and len(got) < len(planted) + 20
    for i, j in got:
        x, y = (set(minhash.shingles(text[k].encode()).tolist()) for k in (i, j))
        assert 100 * len(x & y) >= 85 * len(x | y)


def test_quality_equals_a_dense_fit(spark):
    """Ridge on all rows at once, and the rising fit by its min-max formula, in place of sums by partition and pooling."""
    rng = np.random.RandomState(5)
    x = rng.normal(size=(600, quality.STATS)) * rng.uniform(0.1, 9, quality.STATS) + rng.uniform(-3, 3, quality.STATS)
    y = (x[:, 0] / 4 + np.sin(x[:, 1]) + rng.normal(size=600) > 0).astype(float)
    calibrate = np.arange(600) % 3 == 0
    rows = [(i, [float(v) for v in x[i]], float(y[i]), bool(calibrate[i])) for i in range(600)]
    d = spark.createDataFrame(rows, "id long, x array<double>, y double, calibrate boolean").repartition(5)
    model = quality.fit(d.select("x", "y", "calibrate"))
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    phi = np.concatenate([np.sqrt(2 / quality.FEATURES) * np.cos(z @ model.w + model.b), np.ones((600, 1))], 1)
    own = phi[~calibrate]
    beta = np.linalg.solve(own.T @ own + 1e-3 * len(own) / quality.FEATURES * np.eye(own.shape[1]), own.T @ y[~calibrate])
    assert np.allclose(model.beta, beta, atol=1e-6)
    raw, kernel = phi @ beta, np.exp(-((z[:, None] - z[None]) ** 2).sum(2) / (2 * 3.0**2))
    assert np.abs(phi[:, :-1] @ phi[:, :-1].T - kernel).mean() < 0.07
    bins = np.clip((raw + 0.5) * quality.BINS / 2, 0, quality.BINS - 1).astype(int)
    ks = np.unique(bins[calibrate])
    n = np.array([(bins[calibrate] == k).sum() for k in ks], float)
    p = np.array([y[calibrate][bins[calibrate] == k].sum() for k in ks])
    cn, cp = np.concatenate([[0], np.cumsum(n)]), np.concatenate([[0], np.cumsum(p)])
    rising = np.array([max(min((cp[b + 1] - cp[a]) / (cn[b + 1] - cn[a]) for b in range(i, len(ks))) for a in range(i + 1)) for i in range(len(ks))])
    at = (ks + 0.5) * 2 / quality.BINS - 0.5
    levels = np.unique(rising)
    centre = [np.average(at[rising == v], weights=n[rising == v]) for v in levels]
    want = np.clip(np.interp(raw, centre, levels), 0, 1)
    got = {r.id: r.score for r in quality.score(d.select("id", "x"), model).collect()}
    assert np.allclose([got[i] for i in range(600)], want, atol=1e-6)


CAPTURES = "record_id string, type string, url string, ts long, status int, headers map<string,string>"


def test_revisits_and_responses_without_a_record_id(spark):
    rows = [
        (None, "response", "http://a/x", 10, 200, {"ETag": "1"}), (None, "revisit", "http://a/x", 20, 304, {"ETag": "1", "Age": "5"}), (None, "revisit", "http://a/x", 20, 304, {"ETag": "1", "Age": "5"}),
        (None, "revisit", "http://a/x", 20, 304, {"ETag": "2"}), ("v", "revisit", "http://a/x", 30, 304, {"ETag": "1"}), (None, "revisit", "http://b/", 40, 304, None), (None, "revisit", None, None, 304, None),
    ]
    got = warc.resolve(spark.createDataFrame(rows, CAPTURES)).collect()
    assert sorted((r.record_id or "", r.canonical or "", r.ts or 0, r.outcome, r.response_id) for r in got) == [
        ("", "", 0, "no_response", None), ("", "a/x", 20, "mismatch", None), ("", "a/x", 20, "resolved", None), ("", "b", 40, "no_response", None), ("v", "a/x", 30, "resolved", None),
    ]
    assert {r.ts: r.headers for r in got if r.outcome == "resolved"} == {20: {"etag": "1", "age": "5"}, 30: {"etag": "1"}}


def test_revisit_without_http_block(spark):
    at = "http://netpreserve.org/warc/1.1/revisit/"
    rows = [("r", "response", "http://a/x", 10, 200, {"ETag": "1"}, None), ("v", "revisit", "http://a/x", 20, None, {}, at + "server-not-modified"), ("i", "revisit", "http://a/x", 20, None, {}, at + "identical-payload-digest")]
    got = warc.resolve(spark.createDataFrame(rows, CAPTURES + ", profile string")).collect()
    assert [(r.record_id, r.outcome, r.response_id) for r in got] == [("v", "no_validator", "r")]
