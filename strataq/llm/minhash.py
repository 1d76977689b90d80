"""Near-duplicates by b-bit MinHash.

1. One pass turns each text into its set of 5-word shingles (64-bit hashes), `HASHES` minima, the low `BITS` bits of each
   packed into longs, and one key per band of `ROWS` minima.  At a similarity of 0.85 the chance that two documents share
   no band is (1 - 0.85**5)**32, below 1e-8.
2. Documents of equal word sequences collapse to their smallest id before any candidates are made.
3. Each band bucket names its smallest member the hub; every member is held against the hub only (a star, not all pairs).
   Pairs whose collision-corrected b-bit estimate is far below the threshold go; the rest is decided on full sets.
4. Components of the links so far.  Buckets that still span several components are compared again across components; of
   buckets with the same members (by a 128-bit digest of them) one is.  Buckets of up to `SMALL` members give the pairs that
   the estimate admits, at most `SMALL` - 1 a member, which are decided as in 3.
5. Components again.  Larger buckets that still span several are cut into blocks by hash of the member, and each two blocks
   are decided in one place, on full sets: a pair whose components have been linked there is passed over, and what comes out
   is a forest of true links, fewer than there are members.  So a bucket of n texts that are all unlike each other costs
   n * n / 2 comparisons, but emits nothing.  No link between different texts is lost to the star.

Nothing is capped: a bucket's size only sets how many blocks it is cut into.  A hub or bucket that holds more than a
ten-thousandth of all pairs or rows is *hot*; there are at most 10,000 of those, which are broadcast, and a hot hub's set is
copied to salted parts of its pairs.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, checkpoint
from .graph import components

HASHES, BITS, ROWS, SHINGLE = 160, 4, 5, 5
BANDS, LANES = HASHES // ROWS, 64 // BITS
LONGS = HASHES // LANES
#: Ids that may be broadcast to pick texts for verification; more are joined by a shuffle.
BROADCAST_IDS = 200_000
SMALL, HOT_SHARE = 48, 1e-4
#: Members and shingles of one side of a comparison of blocks.
BLOCK, BLOCK_SHINGLES = 1024, 1 << 20

_ODD = (np.random.RandomState(11).randint(1, 1 << 31, HASHES, dtype=np.int64) * 2 + 1).astype(np.uint32)[:, None]
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _finish(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(29))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(32))


def shingles(text: bytes) -> np.ndarray:
    """Sorted distinct 64-bit shingle hashes of a text; a text of 1 to 4 words is one shingle, an empty one has none."""
    import xxhash

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(SHINGLE, len(words))
    total = np.full(len(words) - n + 1, np.uint64(n), np.uint64)
    for i in range(n):
        total = (total ^ h[i : len(words) - n + 1 + i]) * _MIX[i]
        total ^= total >> np.uint64(31)
    return np.unique(_finish(total))


def minima(s: np.ndarray) -> np.ndarray:
    x = (s >> np.uint64(32)).astype(np.uint32) ^ s.astype(np.uint32)
    out = np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(x), 2048):
        np.minimum(out, (_ODD * x[None, i : i + 2048]).min(1), out=out)
    return out


def packed(m: np.ndarray) -> np.ndarray:
    """Low bits of minima (rows of HASHES) as LONGS longs per row."""
    low = (m & np.uint32((1 << BITS) - 1)).astype(np.uint64).reshape(-1, LONGS, LANES)
    return (low << (np.arange(LANES, dtype=np.uint64) * np.uint64(BITS))).sum(2, dtype=np.uint64).view(np.int64)


def band_keys(m: np.ndarray) -> np.ndarray:
    parts = m.reshape(-1, BANDS, ROWS).astype(np.uint64)
    key = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * _MIX[4], parts.shape[:2]).copy()
    for i in range(ROWS):
        key = (key ^ parts[:, :, i]) * _MIX[i]
        key ^= key >> np.uint64(29)
    return _finish(key).view(np.int64)


def _digest(text: bytes) -> bytes:
    return hashlib.sha256(b" ".join(text.lower().split())).digest()


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            n, m, digests = [], np.zeros((len(texts), HASHES), np.uint32), []
            for k, text in enumerate(texts):
                s = shingles(text)
                n.append(len(s))
                m[k] = minima(s)
                digests.append(_digest(text))
            longs = pa.ListArray.from_arrays(pa.array(range(0, len(texts) * LONGS + 1, LONGS), pa.int32()), pa.array(packed(m).ravel()))
            keys = pa.ListArray.from_arrays(pa.array(range(0, len(texts) * BANDS + 1, BANDS), pa.int32()), pa.array(band_keys(m).ravel()))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), longs, keys], ["id", "n", "digest", "sig", "bands"])


def features(src: DataFrame) -> DataFrame:
    """id, n (set size), digest of the word sequence, sig (packed low bits), bands, of `src` (id, text)."""
    return src.mapInArrow(_features, "id long, n long, digest binary, sig array<long>, bands array<long>")


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, 256):
            part = b.slice(i, 256)
            texts = [x or b"" for x in part.column(1).cast(pa.binary()).to_pylist()]
            sets = [shingles(x).view(np.int64) for x in texts]
            ends = np.concatenate([[0], np.cumsum([len(x) for x in sets])])
            flat = pa.array(np.concatenate([np.zeros(0, np.int64), *sets]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([_digest(x) for x in texts], pa.binary()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)], ["id", "digest", "shingles"])


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed low bits, corrected for the 2**-BITS of lanes that agree by chance."""
    ones = F.lit(0x1111111111111111)
    differ = None
    for i in range(LONGS):
        x = a[i].bitwiseXOR(b[i])
        x = x.bitwiseOR(F.shiftrightunsigned(x, 1))
        x = x.bitwiseOR(F.shiftrightunsigned(x, 2))
        c = F.bit_count(x.bitwiseAND(ones))
        differ = c if differ is None else differ + c
    chance = 2.0**-BITS
    return ((1 - differ / HASHES) - chance) / (1 - chance)


def _admitted(left: np.ndarray, right: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, least: float, percent: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Pairs (rows of `left`, rows of `right`) of different components whose sizes and estimate (third) admit a link."""
    step = max(1, (1 << 20) // max(1, len(right)))
    for i in range(0, len(left), step):
        a, b = (x.ravel() for x in np.meshgrid(left[i : i + step], right, indexing="ij"))
        ok = (comp[a] != comp[b]) & (100 * np.minimum(n[a], n[b]) >= percent * np.maximum(n[a], n[b]))
        a, b = a[ok], b[ok]
        differ = np.zeros(len(a), np.uint16)
        for k in range(LONGS):
            x = sig[a, k] ^ sig[b, k]
            x |= x >> np.uint64(1)
            x |= x >> np.uint64(2)
            differ += np.bitwise_count(x & np.uint64(0x1111111111111111))
        chance = 2.0**-BITS
        like = ((1 - differ / HASHES) - chance) / (1 - chance)
        ok = like >= least
        yield a[ok], b[ok], like[ok]


def _common(rows: np.ndarray, others: np.ndarray, sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets of `rows` with those of `others`, by products of 0/1 matrices."""
    mine, theirs = (np.concatenate([sets[i] for i in x]) for x in (rows, others))
    shared = np.intersect1d(mine, theirs)
    out = np.zeros((len(rows), len(others)), np.float32)
    for at in range(0, len(shared), 8192):
        words = shared[at : at + 8192]

        def incidence(which: np.ndarray) -> np.ndarray:
            m = np.zeros((len(which), len(words)), np.float32)
            for k, i in enumerate(which):
                own = sets[i][np.searchsorted(sets[i], words[0]) : np.searchsorted(sets[i], words[-1], "right")]
                place = np.searchsorted(words, own)
                m[k, place[words[np.minimum(place, len(words) - 1)] == own]] = 1
            return m

        out += incidence(rows) @ incidence(others).T
    return out.astype(np.int64)


def _links(left: np.ndarray, right: np.ndarray, rep: np.ndarray, comp: np.ndarray, n: np.ndarray, sig: np.ndarray, sets: list[np.ndarray], least: float, percent: int) -> list[tuple[int, int]]:
    """True links (smaller rep first) that join components of the rows of `left` and `right`: a forest, nothing else."""
    label, size = comp.copy(), np.array([len(x) for x in sets])
    out = []
    for a, b, like in _admitted(left, right, comp, n, sig, least, percent):
        order = np.argsort(-like, kind="stable")
        a, b = a[order], b[order]
        for i in range(0, len(a), 1 << 16):
            x, y = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            apart = label[x] != label[y]  # pairs whose components met in the meantime need no look at their sets
            x, y = x[apart], y[apart]
            if not len(x):
                continue
            rows, others = np.unique(x), np.unique(y)
            if 8 * len(x) > len(rows) * len(others):  # most of the pairs of these rows
                same = _common(rows, others, sets)[np.searchsorted(rows, x), np.searchsorted(others, y)]
            else:
                same = np.array([len(np.intersect1d(sets[u], sets[v], assume_unique=True)) for u, v in zip(x, y)])
            linked = 100 * same >= percent * (size[x] + size[y] - same)
            for u, v in zip(x[linked], y[linked]):
                if label[u] != label[v]:
                    out.append((min(int(rep[u]), int(rep[v])), max(int(rep[u]), int(rep[v]))))
                    label[label == max(label[u], label[v])] = min(label[u], label[v])
    return out


def _groups(batches: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """Tables of the rows of whole groups, of rows sorted by `keys`."""
    held: pa.Table | None = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b])
        t = t if held is None else pa.concat_tables([held, t])
        cols = [t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in keys]
        other = np.zeros(len(t), bool)
        for c in cols:
            other |= c != c[-1]
        last = np.flatnonzero(other)
        cut = int(last[-1]) + 1 if len(last) else 0
        held = t.slice(cut)
        if cut:
            yield t.slice(0, cut)
    if held is not None:
        yield held


def _edges_of(t: pa.Table, keys: tuple[str, ...]) -> np.ndarray:
    """First row of each group, and the number of rows."""
    new = np.zeros(len(t), bool)
    new[:1] = True
    for c in keys:
        x = t.column(c).combine_chunks().to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.append(np.flatnonzero(new), len(t))


def _columns(t: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    rep, comp, n = (t.column(c).combine_chunks().to_numpy(zero_copy_only=False) for c in ("rep", "comp", "n"))
    return rep, comp, n, t.column("sig").combine_chunks().flatten().to_numpy().reshape(-1, LONGS).view(np.uint64)


def _small_pairs(least: float, percent: int):
    """Over rows sorted by key: hub, rep of the pairs within each key that the estimate admits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, ("key",)):
            rep, comp, n, sig = _columns(t)
            edges = _edges_of(t, ("key",))
            hub, other = [], []
            for i, j in zip(edges, edges[1:]):
                own = np.arange(i, j)
                for a, b, _ in _admitted(own, own, comp, n, sig, least, percent):
                    ok = rep[a] < rep[b]
                    hub.append(rep[a[ok]])
                    other.append(rep[b[ok]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *x])) for x in (hub, other)], ["hub", "rep"])

    return run


def _block_links(least: float, percent: int):
    """Over rows (with shingles) sorted by (key, i, j, side): u, v of the links between the two sides of each (key, i, j)."""
    keys = ("key", "i", "j")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _groups(batches, keys):
            edges = _edges_of(t, keys)
            found = []
            for i, j in zip(edges, edges[1:]):
                g = t.slice(i, j - i)
                rep, comp, n, sig = _columns(g)
                side = g.column("side").combine_chunks().to_numpy()
                lists = g.column("shingles").combine_chunks()
                flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
                sets = [flat[a:b] for a, b in zip(at, at[1:])]
                found += _links(np.flatnonzero(side == 0), np.flatnonzero(side == 1), rep, comp, n, sig, sets, least, percent)
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)], ["u", "v"])

    return run


def _hot(counts: DataFrame, total: int, least: int = 1024) -> DataFrame:
    """Of `counts` (…, c) those above `HOT_SHARE` of `total`: at most 1 / HOT_SHARE rows, so they may be broadcast."""
    return counts.where(F.col("c") > max(least, int(total * HOT_SHARE)))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85, slack: float = 6.0, small: int = SMALL, block: int = BLOCK) -> DataFrame:
    """One row per row of `docs`: id, n_shingles, component_id, kept.

    Two documents are linked when 100 * |intersection| >= `percent` * |union| of their shingle sets.  Null or empty text
    links with nothing.  A null id links with nothing and has no component.  Ids are integers.  Rows that repeat an id are one
    document; where their texts differ, the one of the smallest digest is compared for all.
    """
    spark = docs.sparkSession
    if dict(docs.dtypes)[id_col] not in ("tinyint", "smallint", "int", "bigint"):
        raise TypeError("ids are integers, of which the smallest names a component")
    src = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    j = percent / 100
    least = j - slack * (j * (1 - j) / HASHES) ** 0.5 / (1 - 2.0**-BITS)
    with Scratch(spark) as s:
        f = s.table(features(src), "features")
        usable = f.where("n > 0 and id is not null")
        classes = s.table(usable.groupBy("digest").agg(F.min("id").alias("rep")), "classes")
        reps = usable.select("id", "n", "sig", "bands", "digest").join(classes, (usable["id"] == classes["rep"]) & (usable["digest"] == classes["digest"])).select("rep", F.struct(usable["digest"], "n", "sig", "bands").alias("x"))
        reps = s.table(reps.groupBy("rep").agg(F.min("x").alias("x")).select("rep", "x.n", "x.sig", "x.bands"), "reps")
        rows = reps.select("rep", F.explode("bands").alias("key"))
        hubs = s.table(rows.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("c")).where("c > 1"), "hubs")
        hot = s.table(_hot(hubs, BANDS * reps.count()), "hot-keys")
        own = rows.join(F.broadcast(hot.select("key", "hub")), "key") if not hot.isEmpty() else None
        buckets = rows.join(hubs.join(F.broadcast(hot.select("key")), "key", "left_anti").select("key", "hub"), "key")
        buckets = s.table(buckets if own is None else buckets.unionByName(own), "buckets")  # members of buckets that hold more than one
        info = reps.select("rep", "n", "sig")

        def sets_of(ids: DataFrame, name: str) -> DataFrame:
            """id, shingles of documents, written to a table."""
            ids = s.table(ids, f"{name}-ids")
            few = ids.count() <= BROADCAST_IDS
            texts = src.join(F.broadcast(ids) if few else ids, "id", "left_semi")
            made = texts.mapInArrow(_sets, "id long, digest binary, shingles array<long>").groupBy("id").agg(F.min(F.struct("digest", "shingles")).alias("x"))
            return s.table(made.select("id", "x.shingles"), f"{name}-sets")

        def verify(pairs: DataFrame, name: str) -> DataFrame:
            """The pairs (hub, rep) that are linked, as edges u, v."""
            a, b = (info.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sig").alias(f"sig_{x}")) for x in ("hub", "rep"))
            p = pairs.distinct().join(a, "hub").join(b, "rep")
            p = p.where((100 * F.least("n_hub", "n_rep") >= percent * F.greatest("n_hub", "n_rep")) & (estimate(F.col("sig_hub"), F.col("sig_rep")) >= least))
            p = s.table(p.select("hub", "rep"), f"{name}-pairs")
            sets = sets_of(p.select(F.col("hub").alias("id")).union(p.select(F.col("rep").alias("id"))).distinct(), name)
            a, b = (sets.select(F.col("id").alias(x), F.col("shingles").alias(f"s_{x}")) for x in ("hub", "rep"))
            hot = s.table(_hot(p.groupBy("hub").agg(F.count("*").alias("c")), p.count()).select("hub", F.ceil(F.col("c") / 1024).cast("int").alias("salts")), f"{name}-hot")
            p = p.join(F.broadcast(hot), "hub", "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("rep"), F.col("salts")), F.lit(0))).drop("salts")
            a = a.join(F.broadcast(hot), "hub", "left").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col("salts"), F.lit(1)).cast("long") - 1))).drop("salts")
            both = F.size(F.array_intersect("s_hub", "s_rep"))
            union = F.size("s_hub") + F.size("s_rep") - both
            linked = p.join(b, "rep").join(a, ["hub", "salt"]).where(100 * both >= percent * union).select(F.col("hub").alias("u"), F.col("rep").alias("v"))
            linked = checkpoint(linked)
            s.drop(f"{name}-sets")
            return linked

        def open_buckets(comp: DataFrame, of: DataFrame) -> DataFrame:
            """key, rep, comp, c, n_all of buckets that span several components; of those with the same members one."""
            named = of.select("key", "rep").join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("component", "rep").alias("comp"))
            h = lambda seed: F.bit_xor(F.xxhash64("rep", F.lit(seed)))
            per = named.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c"), h(1).alias("h1"), h(2).alias("h2")).where("lo < hi")
            return named.join(per.groupBy("c", "h1", "h2").agg(F.min("key").alias("key")).select("key", "c"), "key")

        edges = verify(buckets.where("hub <> rep").select("hub", "rep"), "star")
        comp = checkpoint(components(edges))
        across = s.table(open_buckets(comp, buckets), "across")
        sided = across.where(F.col("c") <= small).join(info, "rep").select("key", "rep", "comp", "n", "sig").repartition("key").sortWithinPartitions("key")
        new = verify(sided.mapInArrow(_small_pairs(least, percent), "hub long, rep long").distinct(), "small")
        edges = edges.union(new)
        if not new.isEmpty():
            comp = checkpoint(components(edges))

        large = s.table(open_buckets(comp, across.where(F.col("c") > small)), "large")
        if not large.isEmpty():
            sets = sets_of(large.select(F.col("rep").alias("id")).distinct(), "large").withColumnRenamed("id", "rep")
            own = large.join(info, "rep")
            parts = own.groupBy("key").agg(F.greatest(F.ceil(F.count("*") / block), F.ceil(F.sum("n") / BLOCK_SHINGLES)).cast("int").alias("parts"))
            own = own.join(parts, "key").withColumn("block", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int")).drop("c")
            as_a = own.withColumn("j", F.explode(F.expr("sequence(block, parts - 1)"))).withColumn("i", F.col("block")).withColumn("side", F.lit(0))
            as_b = own.withColumn("i", F.explode(F.expr("sequence(0, block)"))).withColumn("j", F.col("block")).withColumn("side", F.lit(1))
            sided = as_a.unionByName(as_b).join(sets, "rep").select("key", "i", "j", "side", "rep", "comp", "n", "sig", "shingles")
            sided = sided.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j", "side")
            new = checkpoint(sided.mapInArrow(_block_links(least, percent), "u long, v long").distinct())
            edges = edges.union(new)
            if not new.isEmpty():
                comp = checkpoint(components(edges))

        of_class = classes.join(comp.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
        shown = f.select("id", "n", F.when(F.col("n") > 0, F.col("digest")).alias("digest")).join(of_class, "digest", "left")
        own_id = F.coalesce("component_id", "id")
        out = shown.select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), own_id).alias("component_id"), F.coalesce(F.col("id") == own_id, F.lit(True)).alias("kept"))
        return checkpoint(out)
