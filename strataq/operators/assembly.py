"""Temporal assembly: streams of records (de-duplicate, order, stitch) and versions of artifacts (events, timelines)."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEAST_OVERLAP, MOST_OVERLAP = 10, 5000


def first_by(df: DataFrame, key: list[str | Column], order: list[str | Column]) -> DataFrame:
    """The first row of each key."""
    return df.withColumn("__nth", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__nth = 1").drop("__nth")


def dedupe_exact(records: DataFrame, content: list[str], order: str = "in_pos") -> DataFrame:
    """Records without later copies, equal by SHA-256 of the JSON of the `content` columns."""
    return first_by(records, [F.sha2(F.to_json(F.struct(*content)), 256)], [order])


def instant(timestamp: Column, modified: Column) -> Column:
    """`timestamp` where there is one, even one that can't be read (null), else `modified`."""
    return F.when(timestamp.isNotNull(), F.try_to_timestamp(timestamp)).otherwise(F.try_to_timestamp(modified))


def order_by_instant(records: DataFrame, at: Column, order: str = "in_pos") -> DataFrame:
    return records.orderBy(at.asc_nulls_first(), order)


def positions(records: DataFrame, at: Column, order: str = "in_pos", parts: int | None = None) -> DataFrame:
    """`records` with `pos`, from 1: the place by instant (null first), then `order`.

    No task sees all rows: bounds from a sample by hash cut the order into `parts` ranges (shuffle partitions without it),
    rows are numbered within their range, and the ranges before it add their counts.  A row's range depends on the row and
    the bounds alone, so both scans of `records` agree on it.
    """
    spark = records.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = records.schema[order].dataType
    place = lambda t, x: F.struct(t.alias("t"), x.alias("x"))
    own = records.withColumn("__at", F.unix_micros(at))
    sample = own.select("__at", F.col(order).alias("x")).orderBy(F.xxhash64("__at", "x"), "__at", "x").limit(20 * parts)
    rows = sample.distinct().orderBy(F.asc_nulls_first("__at"), F.asc_nulls_first("x")).collect()
    bounds = [rows[i * len(rows) // parts] for i in range(1, min(parts, len(rows)))] if rows else []

    def find(lo: int, hi: int) -> Column:
        """Bounds that a row isn't before, known to be from `lo` to `hi`."""
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        bound = place(F.lit(bounds[mid][0]).cast("long"), F.lit(bounds[mid][1]).cast(kind))
        return F.when(place(F.col("__at"), F.col(order)) < bound, find(lo, mid)).otherwise(find(mid + 1, hi))

    own = own.withColumn("__part", find(0, len(bounds)))
    before, total = {}, 0
    for part, n in sorted(map(tuple, own.groupBy("__part").count().collect())):
        before[part], total = total, total + n
    if not before:
        return records.withColumn("pos", F.lit(None).cast("long"))
    offset = F.element_at(F.array(*[F.lit(before.get(k, 0)).cast("long") for k in range(len(bounds) + 1)]), F.col("__part") + 1)
    w = Window.partitionBy("__part").orderBy(F.asc_nulls_first("__at"), F.asc_nulls_first(order))
    return own.withColumn("pos", offset + F.row_number().over(w)).drop("__at", "__part")


def stitch_text(base: str, more: str, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> str:
    """`base` and `more` joined over the longest suffix of one that begins the other, of `least` to `most` bytes."""
    a, b = base.encode(), more.encode()
    for n in range(min(len(a), len(b), most), least - 1, -1):
        if a.endswith(b[:n]) and (n == len(b) or b[n] & 0xC0 != 0x80):
            return base + b[n:].decode()
    return base + more


def stitch(records: DataFrame, key: list[str], order: list[str], text_col: str = "content") -> DataFrame:
    """Neighbouring records of a key whose texts overlap, merged into one; columns are those of its first record.

    The fold is sequential within a key, so the key (a conversation, a stream) sets the parallelism.  Rows are sorted by
    Spark and read in batches: of a key, only the record at hand is held.
    """
    cols = records.columns

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict | None = None
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                if held is not None and all(held[k] == row[k] for k in key):
                    merged = stitch_text(held[text_col] or "", row[text_col] or "")
                    if len(merged.encode()) < len((held[text_col] or "").encode()) + len((row[text_col] or "").encode()):
                        held[text_col] = merged
                        continue
                if held is not None:
                    out.append(held)
                held = row
            if out:
                yield pd.DataFrame(out, columns=cols)
        if held is not None:
            yield pd.DataFrame([held], columns=cols)

    return records.repartition(*key).sortWithinPartitions(*key, *order).mapInPandas(fold, records.schema)


def line_diff(before: str, after: str) -> tuple[str, float, float]:
    """`- ` and `+ ` lines, the share of deleted lines and of kept ones."""
    a, b = before.splitlines(), after.splitlines()
    text, kept = [], 0
    for op, i, j, m, n in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        kept += j - i if op == "equal" else 0
        if op != "equal":
            text += [f"- {x}" for x in a[i:j]] + [f"+ {x}" for x in b[m:n]]
    n = max(1, len(a))
    return "\n".join(text), 1 - kept / n if a else 0.0, kept / n


def load_snapshots(records: DataFrame, files: DataFrame) -> DataFrame:
    """path, content, in_pos of `records` (path, in_pos) with the text of `files` (path, content); a missing file is empty."""
    return records.join(files.select("path", F.col("content").cast("string").alias("__text")), "path", "left").select("path", F.coalesce("__text", F.lit("")).alias("content"), "in_pos")


def versions(snapshots: DataFrame) -> DataFrame:
    """artifact, version, content of `snapshots` (path, content, in_pos): `name.resolved.N` is version N of `name`, any
    other path version 0; of one version the last row counts."""
    pattern = r"^(.*)\.resolved(?:\.(\d+))?$"
    number = F.try_to_number(F.nullif(F.regexp_extract("path", pattern, 2), F.lit("")), F.lit("999999999"))
    named = F.regexp_like("path", F.lit(pattern))
    own = snapshots.select(
        F.when(named, F.regexp_extract("path", pattern, 1)).otherwise(F.col("path")).alias("artifact"),
        F.when(named, F.coalesce(number.cast("int"), F.lit(0))).otherwise(F.lit(0)).alias("version"), F.coalesce("content", F.lit("")).alias("content"), "in_pos",
    )
    return own.groupBy("artifact", "version").agg(F.max_by("content", "in_pos").alias("content"))


def pairs(versioned: DataFrame, by: str = "artifact", order: str = "version", content: str = "content") -> DataFrame:
    """Each version with the content of the one before it."""
    return versioned.withColumn("before", F.lag(content).over(Window.partitionBy(by).orderBy(order)))


def events(versioned: DataFrame, split_below: float = 0.3) -> DataFrame:
    """artifact, version, event, diff, deletion, overlap, timeline.

    The first version is a `creation` if its number is 0; later ones that differ are an `evolution`.  A version that keeps
    less than `split_below` of the lines before it starts the timeline `branch_v<version>`; `main` comes before.
    """

    @F.pandas_udf("diff string, deletion double, overlap double")
    def compare(before: pd.Series, after: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([line_diff(a, b) if isinstance(a, str) else ("", 0.0, 1.0) for a, b in zip(before, after)], columns=["diff", "deletion", "overlap"])

    p = pairs(versioned).withColumn("d", compare("before", "content"))
    branch = F.when((F.length("before") > 0) & (F.col("d.overlap") < split_below), F.concat(F.lit("branch_v"), F.col("version").cast("string")))
    run = Window.partitionBy("artifact").orderBy("version").rowsBetween(Window.unboundedPreceding, 0)
    p = p.withColumn("timeline", F.coalesce(F.last(branch, ignorenulls=True).over(run), F.lit("main")))
    event = F.when(F.col("before").isNull(), F.when(F.col("version") == 0, "creation")).when(F.col("before") != F.col("content"), "evolution")
    return p.withColumn("event", event).where("event is not null").select("artifact", "version", "event", "d.diff", "d.deletion", "d.overlap", "timeline")
