"""A corpus pipeline of five stages over `documents`, each by one operator of strataq.llm.

Stages take (spark, docs, sf_dir) and return a DataFrame; all but the last return the columns of documents.  The runner
writes each result as Parquet and reads it again as the next stage's input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strataq.llm import language, line_dedup, minhash, mixing, packing
from strataq.llm.common import WORD, Scratch, checkpoint, documents, fresh

#: The stages hold learned models, hashes of shingles and seeded sampling, which SQL can't express.
ORACLE_SQL = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in no language (`und`: null, empty or without a letter) go; `lang` becomes the prediction where null."""
    keep = tuple(c for c in docs.columns if c != "doc_id")
    pred, score = fresh(docs.columns, "lang_pred", "lang_score")
    found = language.identify(docs, language.learn(docs), keep=keep, out=(pred, score))
    lang = F.coalesce("lang", pred).alias("lang")
    return found.where(F.col(pred) != "und").select(*(lang if c == "lang" else F.col(c) for c in docs.columns))


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines go; a document of which nothing is left goes, n_chars follows the text."""
    (gone,) = fresh(docs.columns, "gone")
    out = line_dedup.line_dedup(docs, gone_col=gone)
    out = out.where((F.size(gone) == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    return out.withColumn("n_chars", F.when(F.size(gone) == 0, F.col("n_chars")).otherwise(F.length("text").cast("long"))).select(*docs.columns)


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are linked at a similarity of 0.85, directly or through others, the one of the smallest id stays."""
    gone = minhash.near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; of rows that repeat an id, the n-th by source and text gets the n-th
    row of the mix for it."""
    times = checkpoint(mixing.mix_sources(docs).select("doc_id", "source", "size", "times"))
    repeated = checkpoint(times.groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select(F.col("doc_id").alias("r")))
    some = not repeated.isEmpty()
    key, nth, other, n = fresh(docs.columns, "key", "nth", "nth_of_mix", "n_times")
    # rows are numbered where ids repeat only, without their texts; all others are told apart by their id
    taken, own = times.where("times > 0"), docs
    on = F.col("doc_id").eqNullSafe(F.col(key))
    if some:
        order = [F.col("source").asc_nulls_last(), "size"]
        number = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
        among = lambda df: df.join(repeated.withColumnRenamed("r", key), on, "left_semi")
        size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
        own = among(docs).withColumn(nth, F.row_number().over(Window.partitionBy("doc_id").orderBy(order[0], size, F.xxhash64("text"))))
        own = own.unionByName(docs.join(repeated.withColumnRenamed("r", key), on, "left_anti").withColumn(nth, F.lit(1)))
        taken = among(times).withColumn(nth, number).unionByName(times.join(repeated.withColumnRenamed("r", key), on, "left_anti").withColumn(nth, F.lit(1))).where("times > 0")
        right = taken.select(F.col("doc_id").alias(key), F.col(nth).alias(other), F.col("times").alias(n))
        on = on & (F.col(nth) == F.col(other))
    else:
        right = taken.select(F.col("doc_id").alias(key), F.col("times").alias(n))
    out = own.join(right, on).withColumn(n, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return out.select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences: doc_id, start, length, doc_tokens, sequence_id, offset, ids (16 bit, little-endian)."""
    with Scratch(spark) as s:
        tokens = s.table(packing.keyed(docs), "tokens")
        return checkpoint(packing.pack(tokens, out="<u2"))


STAGES = [("language_id", language_id), ("line_dedup", without_repeated_lines), ("near_dedup", without_near_copies), ("mixing", mixed), ("packing", packed)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all `documents`."""
    docs = documents(spark, sf_dir)
    with Scratch(spark) as s:
        for k, (name, stage) in enumerate(STAGES):
            out = stage(spark, docs, sf_dir)
            docs = out if k == len(STAGES) - 1 else s.table(out, name)
    return docs
