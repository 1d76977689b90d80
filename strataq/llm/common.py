"""What the operators share: the cluster's scratch folder, checkpoints and the word rule."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word, wherever a contract counts or shingles words: ASCII white space separates.
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    Only where the setting is absent, as in tests on one machine, a temporary folder takes its place.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="strataq-")
    if not sc.getCheckpointDir():
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint; Spark deletes the files when no DataFrame needs them."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def fresh(columns: list[str], *names: str) -> list[str]:
    """`names`, each with marks added until it is none of `columns`, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def ranged(df: DataFrame, keys: list[Column], part: str, parts: int | None = None) -> DataFrame:
    """`df` in ranges of `keys`, sorted within them; `part`: the number of a row's range.

    Ranges follow each other as their numbers do, equal keys share one, and rows are spread by a sample of the keys, so with
    keys that tell rows apart no value is too frequent for one task.  The number is that of the task: write the result to a
    table before using it twice.
    """
    n = parts or max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn(part, F.spark_partition_id())


class Scratch:
    """Tables written to the shared folder and deleted on exit; what leaves the block must not read them."""

    def __init__(self, spark: SparkSession):
        self.spark, self.folder = spark, f"{shared_folder(spark)}/scratch-{uuid.uuid4().hex}"

    def __enter__(self) -> Scratch:
        return self

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}"

    def table(self, df: DataFrame, name: str) -> DataFrame:
        df.write.option("compression", "zstd").parquet(self.path(name))
        return self.spark.read.parquet(self.path(name))

    def drop(self, name: str = "") -> None:
        jvm = self.spark._jvm
        path = jvm.org.apache.hadoop.fs.Path(self.path(name) if name else self.folder)
        path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)

    def __exit__(self, *_) -> None:
        self.drop()


def crc_bucket(id_col: str | Column, parts: int) -> Column:
    """crc32 of the id as text, modulo `parts`: the folds of the learned operators."""
    c = F.col(id_col) if isinstance(id_col, str) else id_col
    return F.pmod(F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
