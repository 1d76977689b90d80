"""Rows spread over all cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

LEAST_PARTS, MOST_PARTS, PART_BYTES = 48, 20_000, 512 << 10


def spread(df: DataFrame, part_bytes: int = PART_BYTES) -> DataFrame:
    """`df` in four partitions a core or one for every `part_bytes` by the plan's estimate, whichever is more.

    For rows that take far longer to work on than to read: files are cut by bytes and by groups of rows, so a small file of a
    million rows is otherwise the work of one task.  A size that the plan doesn't know, as of local rows, counts as none.
    """
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    wanted = size // part_bytes if size < 1 << 62 else 0
    return df.repartition(max(LEAST_PARTS, 4 * df.sparkSession.sparkContext.defaultParallelism, min(wanted, MOST_PARTS)))
