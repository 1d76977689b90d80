"""Exact de-duplication by skew-safe combining.

1. Every row gets the SHA-256 of its normalised text.  Counts per digest are combined locally, per salt and then
   globally.  At most 1 / `heavy_share` digests can hold `heavy_share` of all rows: those are *heavy*, and their table may
   be broadcast because of that bound.
2. Rows are combined per (digest, salt, full content): locally by Spark's partial aggregation, then in the shuffle; only
   heavy digests are salted.  The salt winners of heavy digests are combined again by (digest, full content).
3. Winners go back to the rows by digest; a digest with several contents (a collision) is joined by content as well.

Null text counts as empty.  Ties: equal ids are equal rows, all kept.  A null id never wins against another id.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint

#: Runs of ASCII white space, other than a lone blank, which normalising leaves as it is.
_RUNS = r"[\x09-\x0D][\x20\x09-\x0D]*|\x20[\x20\x09-\x0D]+"


def normalised(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text, F.lit("")), _RUNS, " ")


def sha256(content: Column) -> Column:
    return F.sha2(content.cast("binary"), 256)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = 32, heavy_share: float = 1e-3, digest: Callable[[Column], Column] = sha256) -> DataFrame:
    """One row per row of `docs`: id, keep_id, group_size, kept, digest.

    Empty table: no rows.  Other columns of `docs` are ignored, whatever their names.
    """
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    content = src.select("id", normalised(F.col("text")).alias("content")).withColumn("digest", digest(F.col("content")))
    salt = F.pmod(F.xxhash64(F.coalesce(F.col("id").cast("string"), F.lit(""))), F.lit(salts))
    rows = checkpoint(content.select("id", "digest"))
    n = rows.count()

    counts = rows.groupBy("digest", salt.alias("salt")).agg(F.count("*").alias("n")).groupBy("digest").agg(F.sum("n").alias("n"))
    least = max(1000, int(n * heavy_share))
    heavy = checkpoint(counts.where(F.col("n") >= least).select("digest", F.lit(True).alias("heavy")))  # at most 1 / heavy_share rows

    salted = content.join(F.broadcast(heavy), "digest", "left").withColumn("salt", F.when(F.col("heavy"), salt).otherwise(F.lit(-1)))
    first = salted.groupBy("digest", "salt", "content").agg(F.min("id").alias("keep_id"), F.count("*").alias("group_size"))
    # what the light digests need next is narrow: content only leaves the shuffle where a digest is heavy or shared
    won = first.withColumn("content", F.when(F.col("salt") >= 0, F.col("content")))
    light = won.where("salt = -1").select("digest", "keep_id", "group_size")
    heavies = won.where("salt >= 0").groupBy("digest", "content").agg(F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")).select("digest", "keep_id", "group_size")
    per_digest = light.unionByName(heavies).groupBy("digest").agg(F.count("*").alias("contents"), F.min("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    winners = checkpoint(per_digest.where("group_size > 1"))

    flagged = rows.join(F.broadcast(heavy), "digest", "left")
    is_heavy = F.coalesce(F.col("heavy"), F.lit(False))
    of_heavy = winners.join(F.broadcast(heavy), "digest", "left_semi")  # as few rows as heavy
    plain = flagged.where(~is_heavy).drop("heavy").join(winners, "digest", "left")
    hot = flagged.where(is_heavy).drop("heavy").join(F.broadcast(of_heavy), "digest", "left")
    out = plain.unionByName(hot)

    collided = winners.where("contents > 1").select("digest")
    if not collided.isEmpty():
        wide = content.join(collided, "digest", "left_semi")
        groups = wide.groupBy("digest", salt.alias("salt"), "content").agg(F.min("id").alias("k"), F.count("*").alias("c"))
        groups = groups.groupBy("digest", "content").agg(F.min("k").alias("keep_id"), F.sum("c").alias("group_size"))
        back = wide.join(groups, ["digest", "content"]).select("id", "digest", "keep_id", "group_size")
        out = out.join(collided, "digest", "left_anti").select("id", "digest", "keep_id", "group_size").unionByName(back)

    keep = F.when(F.col("group_size").isNull(), F.col("id")).otherwise(F.col("keep_id"))
    return out.select(
        F.col("id").alias(id_col), keep.alias("keep_id"), F.coalesce(F.col("group_size"), F.lit(1).cast("long")).alias("group_size"),
        F.col("id").eqNullSafe(keep).alias("kept"), F.col("digest").alias("text_sha256"),
    )
