"""Assembly of unbounded streams: de-duplication within a watermark and stateful stitching."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.assembly import stitch_text


def dedupe(stream: DataFrame, content: list[str], at: str, late: str = "1 hour") -> DataFrame:
    """Records without copies that come within `late` of each other."""
    keyed = stream.withColumn("_digest", F.sha2(F.to_json(F.struct(*content)), 256)).withWatermark(at, late)
    return keyed.dropDuplicatesWithinWatermark(["_digest"]).drop("_digest")


def windowed_counts(stream: DataFrame, at: str, key: str, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    return stream.withWatermark(at, late).groupBy(F.window(at, width), key).agg(F.count("*").alias("n"))


def stitch(stream: DataFrame, key: str, order: str, text_col: str = "content", idle_ms: int = 60_000) -> DataFrame:
    """key, text: records of a key joined where they overlap; a text is emitted once the next doesn't continue it, or
    after `idle_ms` without records."""
    kind = dict(stream.dtypes)[key]

    def step(k, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        held = state.get[0] if state.exists else None
        out = []
        if state.hasTimedOut:
            state.remove()
            yield pd.DataFrame({key: [k[0]], "text": [held]})
            return
        for pdf in frames:
            for t in pdf.sort_values(order)[text_col].fillna(""):
                if held is None:
                    held = t
                    continue
                merged = stitch_text(held, t)
                if len(merged.encode()) < len(held.encode()) + len(t.encode()):
                    held = merged
                else:
                    out.append(held)
                    held = t
        if held is not None:
            state.update((held,))
            state.setTimeoutDuration(idle_ms)
        yield pd.DataFrame({key: [k[0]] * len(out), "text": out})

    return stream.groupBy(key).applyInPandasWithState(step, f"`{key}` {kind}, text string", "held string", "append", "ProcessingTimeTimeout")
