"""Mixing sources to target weights by balanced (cube) sampling.

A document of a source with ratio r = target / source_size is taken floor(r) times, and once more with probability
p = r - floor(r).  The cube method picks those: the vector of inclusion probabilities moves, by random steps whose mean is
zero, within the null space of two constraints per source, the number of documents and the number of words, until each
entry is 0 or 1 but for a few, the landing problem.

Flights run in buckets of about `bucket` documents of one source, by hash of id, size and a number among rows equal in these,
so that a hot source and a hot id are many tasks; each bucket keeps `_SPARE` documents of all sizes back and leaves at most 3
others fractional; these fly again in fewer buckets until one per source remains.  The landing there chooses, over all 0/1
choices for at most `landing` documents, the one with the least error in words (then documents).  Everything is seeded by
source and bucket, so reruns agree.
"""

from __future__ import annotations

import random

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, checkpoint, ranged

_EPS = 1e-9
_SPARE = 4  # documents that a bucket passes on as they are, so that few buckets leave enough to land with
_SCHEMA = "id {0}, src string, size long, nth long, source_size long, target double, base long, p double"


def _flight(p: np.ndarray, size: np.ndarray, order: list[int], rng: random.Random) -> None:
    """Move p in place; at most 3 entries of `order` stay fractional."""
    hand: list[int] = []
    for i in order:
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = round(p[i])
            continue
        hand.append(i)
        while len(hand) >= 3:
            a, b, c = hand[:3]
            u = [size[c] - size[b], size[a] - size[c], size[b] - size[a]]
            if not any(u):
                u = [1.0, -1.0, 0.0]
            up = min((1 - p[k]) / x if x > 0 else p[k] / -x for k, x in zip((a, b, c), u) if x)
            down = min(p[k] / x if x > 0 else (1 - p[k]) / -x for k, x in zip((a, b, c), u) if x)
            step = up if rng.random() * (up + down) < down else -down
            for k, x in zip((a, b, c), u):
                p[k] += step * x
            gone = [k for k in (a, b, c) if not _EPS < p[k] < 1 - _EPS]
            for k in gone:
                p[k] = float(round(p[k]))
            hand = [k for k in hand if k not in gone]
            if not gone:  # only rounding can bring this about
                k = min((a, b, c), key=lambda k: min(p[k], 1 - p[k]))
                p[k] = float(round(p[k]))
                hand.remove(k)


def _land(p: np.ndarray, size: np.ndarray, open_: list[int], words: float, docs: float) -> None:
    """The 0/1 choice for `open_` whose sums come nearest to `words` and `docs`."""
    m = len(open_)
    picks = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float)
    cost = np.abs(picks @ size[open_].astype(float) - words) + 1e-6 * np.abs(picks.sum(1) - docs)
    p[open_] = picks[int(np.argmin(cost))]


def _mover(level: int, landing: int):
    def move(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "id", "nth"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        p, size = pdf["p"].to_numpy(float).copy(), pdf["size"].to_numpy(float)
        rng = random.Random(f"{pdf['src'].iloc[0]}|{pdf['bucket'].iloc[0]}|{level}")
        order = list(range(len(p)))
        alone = bool(pdf["alone"].iloc[0])
        words, docs = float(p @ size), float(p.sum())
        spread = {int(x) for x in np.linspace(0, len(p) - 1, min(len(p), landing - 3 if alone else _SPARE)).round()} if len(p) else set()
        _flight(p, size, [i for i in order if i not in spread], rng)
        if alone:
            open_ = [i for i in order if _EPS < p[i] < 1 - _EPS]
            closed = [i for i in order if not _EPS < p[i] < 1 - _EPS]
            if open_:
                _land(p, size, open_, words - float(p[closed] @ size[closed]), docs - float(p[closed].sum()))
        pdf["p"] = p
        return pdf.drop(columns=["bucket", "alone"])

    return move


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, parts: int | None = None) -> DataFrame:
    """src, source_size, n, target: all words shared by weight, no target above `most` times its source.

    Sources are numbered by code point, null last, in ranges, so that their number has no bound.  The level to which the
    sources are filled rises as sources reach their cap: each pass caps those below it and shares what remains.
    """
    spark = sizes.sparkSession
    n = F.sum("n") if "n" in sizes.columns else F.count("*")
    size = F.col("size") * F.col("n") if "n" in sizes.columns else F.col("size")
    per = sizes.groupBy("src").agg(F.sum(size).alias("source_size"), n.alias("n"))
    # Spark compares strings as UTF-8, that is by code point
    per = checkpoint(ranged(per, [F.col("src").asc_nulls_last()], "part", parts))
    before, total = {}, 0
    for part, k in sorted(map(tuple, per.groupBy("part").count().collect())):  # one row per range
        before[part], total = total, total + k
    offset = spark.createDataFrame(sorted(before.items()) or [(0, 0)], "part int, before long")
    nth = F.row_number().over(Window.partitionBy("part").orderBy(F.col("src").asc_nulls_last())) - 1 + F.col("before")
    per = per.join(F.broadcast(offset), "part").withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (nth % len(weights) + 1).cast("int")))
    per = checkpoint(per.select("src", "source_size", "n", "weight", (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    words = float(per.agg(F.sum("source_size")).first()[0] or 0)
    level, capped = 0.0, F.lit(False)
    while True:
        cap, weight, k = per.agg(F.sum(F.when(capped, F.col("cap"))), F.sum(F.when(~capped, F.col("weight"))), F.count(F.when(capped, 1))).first()
        if not weight:  # all are at their cap
            break
        level = (words - (cap or 0.0)) / weight
        capped = F.col("cap") < F.lit(level) * F.col("weight")
        if per.where(capped).count() == k:
            break
    return per.select("src", "source_size", "n", F.when(capped, F.col("cap")).otherwise(F.lit(level) * F.col("weight")).alias("target"))


def mix_sources(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[float, ...] = (1, 2, 3), most: float = 3.0, bucket: int = 2048, landing: int = 16) -> DataFrame:
    """One row per row of `docs`: id, size, source_size, target, taken (words the mix takes, repeats counted), times, source.

    Null text has size 0; a null source is a source of its own, last in order.  Rows that repeat an id, or have none, are
    documents each; of those equal in id, source and size it does not matter which is which.  Empty table: no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    sizes = docs.select(F.col(id_col).alias("id"), F.col(source_col).cast("string").alias("src"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    # rows that are equal in all that counts are one row until they are numbered
    alike = checkpoint(sizes.groupBy("id", "src", "size").agg(F.count("*").alias("n")))
    targets = checkpoint(source_targets(alike, weights, most).withColumnRenamed("src", "s"))
    step = 1 << 16
    sizes = alike.withColumn("from", F.explode(F.expr(f"sequence(0L, n - 1, {step}L)"))).select("id", "src", "size", F.explode(F.expr(f"sequence(from, least(n, from + {step}) - 1)")).alias("nth"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    all_ = sizes.join(targets, sizes["src"].eqNullSafe(targets["s"])).drop("s").withColumn("base", F.floor(ratio + F.lit(1e-12)).cast("long"))
    all_ = all_.withColumn("p", F.greatest(F.lit(0.0), ratio - F.col("base")))
    schema = _SCHEMA.format(kind)
    most_n = targets.agg(F.max("n")).first()[0] or 0
    done: list[DataFrame] = []
    level = 0
    moving = all_
    while True:
        last = most_n <= bucket
        parts = F.greatest(F.lit(1), F.ceil(F.col("n") / F.lit(bucket)))
        moving = moving.withColumn("bucket", F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit("")), "size", "nth", F.lit(level)), parts).cast("int"))
        moved = moving.select("id", "src", "size", "nth", "source_size", "target", "base", "p", "bucket", (parts == 1).alias("alone")).groupBy("src", "bucket").applyInPandas(_mover(level, landing), schema)
        moved = checkpoint(moved)
        if last:
            done.append(moved)
            break
        fractional = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        done.append(moved.where(~fractional))
        left = moved.where(fractional)
        counts = checkpoint(left.groupBy(F.col("src").alias("s")).agg(F.count("*").alias("n")))
        most_n = counts.agg(F.max("n")).first()[0] or 0
        moving = left.join(counts, left["src"].eqNullSafe(counts["s"])).drop("s")
        level += 1
    out = done[0]
    for x in done[1:]:
        out = out.unionByName(x)
    return out.select(F.col("id").alias(id_col), "size", "source_size", "target", ((F.col("base") + F.round("p").cast("long")) * F.col("size")).alias("taken"), (F.col("base") + F.round("p").cast("long")).alias("times"), F.col("src").alias("source"))
