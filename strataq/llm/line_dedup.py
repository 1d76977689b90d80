"""Removing repeated runs of lines with a suffix array over line ids, built by distributed prefix doubling.

Texts are cut at line feeds; lines without a word are passed over (and never deleted).  Lines are equal by 128 bits of SHA-256.
Those that occur once in the corpus end a run and leave at once; the others get ids, in the order of their hashes.  A suffix
is what follows a line of a run, up to the run's end.

1. *Prefix doubling*, two steps a pass: the rank of a suffix by its first 4n lines is the order of the ranks by n lines at its
   start and n, 2n and 3n lines on.  Distinct tuples are ranked, sorted by range, so a hot line is one row there.
2. A suffix' *reach* is the least number of its lines that hold `min_words` words, hence at most `min_words` lines, which bounds
   the passes.  Suffixes that are shorter have none and begin nothing.
3. In the order of the ranks, the longest common prefix of neighbours is compared with the reach: where it is shorter, an
   interval of the suffix array begins.  Within an interval all suffixes share their reach, and no other suffix has these lines.
   The neighbours at the edges of two ranges, and intervals that cross them, go through one row per range.
4. The first position of an interval, by (id, line), stays; of its later positions the lines within reach are deleted.

So a line goes exactly if it lies in a run of `min_words` words or more that occurs earlier.  A maximal repeated run is the
union of the reaches within it, hence goes as a whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, Scratch, checkpoint, fresh, ranged

MIN_WORDS = 25


def _ranked(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """A number per row of distinct `keys`, in their order: ids of range-sorted rows ascend over partitions."""
    n = max(1, int(pairs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return pairs.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("r", F.monotonically_increasing_id())


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _suffixes(s: Scratch, src: DataFrame, min_words: int) -> DataFrame:
    """id, fp, seg (run), at (place among lines with words), ln, r (line id), need (reach) of the lines of runs."""
    digest = F.substring(F.unhex(F.sha2(F.col("line").cast("binary"), 256)), 1, 16)
    lines = src.select("id", "fp", F.posexplode(_lines(F.col("text"))).alias("ln", "line")).withColumn("w", F.regexp_count("line", F.lit(WORD))).where("w > 0")
    lines = lines.select("id", "fp", "ln", digest.alias("h"), F.least("w", F.lit(min_words)).alias("w"))
    doc = Window.partitionBy("id", "fp").orderBy("ln")
    lines = s.table(lines.withColumn("at", F.row_number().over(doc)), "lines")
    twice = lines.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h")
    ids = s.table(_ranked(twice, ["h"]), "ids")
    known = lines.join(ids, "h").select("id", "fp", "at", "ln", "w", "r").withColumn("seg", F.col("at") - F.row_number().over(doc))
    run = Window.partitionBy("id", "fp", "seg")
    known = known.withColumn("all", F.sum("w").over(run)).where(F.col("all") >= min_words)
    sums = F.collect_list("w").over(run.orderBy("at").rowsBetween(0, min_words - 1))
    upto = F.aggregate(sums, F.struct(F.lit(0).alias("n"), F.lit(0).alias("w")), lambda a, w: F.when(a["w"] >= min_words, a).otherwise(F.struct((a["n"] + 1).alias("n"), (a["w"] + w).alias("w"))))
    known = known.withColumn("upto", upto).withColumn("need", F.when(F.col("upto.w") >= min_words, F.col("upto.n")))
    return s.table(known.select("id", "fp", "seg", "at", "ln", "r", "need"), "runs")


def _intervals(s: Scratch, suffixes: DataFrame) -> DataFrame:
    """rank, first: of each rank that begins in several places within reach, the first place of its interval."""
    places = suffixes.where("need is not null").groupBy("rank").agg(F.min(F.struct("id", "fp", "at", "need", "prefix")).alias("p"), F.count("*").alias("c"))
    order = s.table(ranged(places.select("rank", "c", F.struct("p.id", "p.fp", "p.at").alias("first"), "p.need", "p.prefix"), [F.col("rank")], "part"), "order")
    own = Window.partitionBy("part").orderBy("rank")
    edges = order.groupBy("part").agg(F.max_by("prefix", "rank").alias("end"))  # one row per range
    edges = edges.select((F.lag("end").over(Window.orderBy("part"))).alias("edge"), F.col("part").alias("p"))
    ranks = order.join(F.broadcast(edges), F.col("part") == F.col("p")).drop("p").withColumn("before", F.coalesce(F.lag("prefix").over(own), "edge"))
    differ = F.array_position(F.zip_with("prefix", "before", lambda x, y: x.eqNullSafe(y)), F.lit(False))  # the shorter one is filled up with nulls
    common = F.when(F.col("before").isNull(), 0).when(differ == 0, F.size("prefix")).otherwise(differ - 1)
    ranks = s.table(ranks.withColumn("mark", F.when(common < F.col("need"), F.col("rank"))).drop("prefix", "before", "edge"), "marks")
    ends = ranks.groupBy("part").agg(F.max("mark").alias("end"))  # one row per range
    ends = ends.select(F.max("end").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)).alias("carried"), F.col("part").alias("p"))
    ranks = ranks.join(F.broadcast(ends), F.col("part") == F.col("p")).withColumn("interval", F.coalesce(F.max("mark").over(own.rowsBetween(Window.unboundedPreceding, 0)), "carried"))
    found = s.table(ranks.select("rank", "interval", "first", "c"), "intervals")
    shared = found.groupBy("interval").agg(F.min("first").alias("first"), F.sum("c").alias("c")).where("c > 1").drop("c")
    return found.select("rank", "interval").join(shared, "interval").select("rank", "first")


def repeated_lines(src: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """id, fp, gone: the numbers (from 0) of the lines to delete of each text of `src` (id, fp, text) that loses any."""
    with Scratch(src.sparkSession) as s:
        runs = _suffixes(s, src, min_words)
        longest = runs.agg(F.max("need")).first()[0] or 0
        run = Window.partitionBy("id", "fp", "seg").orderBy("at")
        level, n, k = runs.withColumn("rank", F.col("r")), 1, 0
        while n < longest:
            keys = [f"k{i}" for i in range(4)]
            ahead = level.withColumns({key: F.coalesce(F.lead("rank", i * n).over(run), F.lit(-1)) if i else F.col("rank") for i, key in enumerate(keys)}).drop("rank")
            names = _ranked(ahead.select(*keys).distinct(), keys).withColumnRenamed("r", "rank")
            k += 1
            level = s.table(ahead.join(s.table(names, f"names{k}"), keys).drop(*keys), f"level{k}")
            n *= 4
        suffixes = level.withColumn("prefix", F.collect_list("r").over(run.rowsBetween(0, min_words - 1)))
        first = s.table(_intervals(s, suffixes), "first")
        place = F.struct("id", "fp", "at")
        flagged = level.select("id", "fp", "at", "ln", "need", "rank").join(first, "rank", "left")
        later = F.coalesce(F.col("need").isNotNull() & (place > F.col("first")), F.lit(False))
        upto = F.max(F.when(later, F.col("at") + F.col("need"))).over(Window.partitionBy("id", "fp").orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
        gone = flagged.withColumn("upto", upto).where("at < upto")
        return checkpoint(gone.groupBy("id", "fp").agg(F.array_sort(F.collect_set("ln")).alias("gone")))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, gone_col: str | None = None) -> DataFrame:
    """`docs` with repeated runs of lines deleted from `text_col`; with `gone_col`, the numbers of the deleted lines.

    Null text stays null; a text that loses all its lines becomes empty.  Rows equal in id and text are one document.
    A null id sorts before all others.  Other columns pass through under any name.
    """
    cols = docs.columns
    own, line_id, line_fp, line_gone = fresh(cols, "__line_own", "__line_id", "__line_fp", "__line_gone")
    fp = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    src = docs.select(F.col(id_col).alias("id"), fp.alias("fp"), F.col(text_col).alias("text")).where("text is not null")
    src = src.dropDuplicates(["id", "fp"]) if _repeats(docs, id_col) else src
    some, kind = "some", dict(docs.dtypes)[id_col]
    known = F.struct(F.col("id").isNotNull().alias(some), F.coalesce(F.col("id"), (F.lit("") if kind == "string" else F.lit(0)).cast(kind)).alias("v"))
    gone = repeated_lines(src.withColumn("id", known), min_words)
    gone = gone.select(F.when(F.col(f"id.{some}"), F.col("id.v")).alias(line_id), F.col("fp").alias(line_fp), F.col("gone").alias(line_gone))
    joined = docs.withColumn(own, fp).join(gone, F.col(id_col).eqNullSafe(F.col(line_id)) & (F.col(own) == F.col(line_fp)), "left")
    kept = F.array_join(F.filter(F.split(F.col(text_col), "\n", -1), lambda x, i: ~F.array_contains(line_gone, i)), "\n")
    text = F.when(F.col(line_gone).isNull(), F.col(text_col)).otherwise(kept)
    out = [text.alias(c) if c == text_col else F.col(c) for c in cols]
    if gone_col:
        out.append(F.coalesce(line_gone, F.array().cast("array<int>")).alias(gone_col))
    return joined.select(*out)


def _repeats(docs: DataFrame, id_col: str) -> bool:
    """Whether any id occurs twice, from counts of ids alone."""
    return not docs.groupBy(id_col).agg(F.count("*").alias("c")).where("c > 1").isEmpty()
