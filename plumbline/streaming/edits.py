"""Editing sessions as streams. Event time, watermarks and windows are additions of this engine; the batch operators know only the order of events."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from plumbline.sources.files import HOOK_SCHEMA, normalise_hooks


def hook_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """Edit events that arrive as JSON files in a folder."""
    return normalise_hooks(spark.readStream.schema(HOOK_SCHEMA).option("maxFilesPerTrigger", files_per_trigger).json(path))


EDITS = "session string, path string, edit long, checkpoint boolean, first boolean"


def _count(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    (n,) = state.get if state.exists else (0,)
    for b in batches:
        rows = []
        for _ in range(len(b)):
            n += 1
            rows.append((key[0], key[1], n, n % 2 == 0 if n <= 2 else n % 5 == 0, n == 1))
        yield pd.DataFrame(rows, columns=["session", "path", "edit", "checkpoint", "first"])
    state.update((n,))


def edit_counts(events: DataFrame) -> DataFrame:
    """Numbers the edits of each session and path as they arrive: one counter of state for each."""
    return events.select("session", "path").groupBy("session", "path").applyInPandasWithState(_count, EDITS, "n long", "append", GroupStateTimeout.NoTimeout)


REGRESSIONS = "session string, path string, smell string, n long, base long"


def _ratchet(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """The first count of a session, path and smell is the baseline; later ones above it are told."""
    base = state.get[0] if state.exists else None
    for b in batches:
        rows = []
        for n in b["n"]:
            if base is None:
                base = int(n)
            elif n > base:
                rows.append((*key, int(n), base))
        yield pd.DataFrame(rows, columns=["session", "path", "smell", "n", "base"])
    if base is not None:
        state.update((base,))


def regressions(counts: DataFrame) -> DataFrame:
    """(session, path, smell, n, base) from a stream of (session, path, smell, n)."""
    return counts.select("session", "path", "smell", "n").groupBy("session", "path", "smell").applyInPandasWithState(_ratchet, REGRESSIONS, "base long", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, size: str, late: str, keys: list[str]) -> DataFrame:
    """Counts of events a window of event time, closed when the watermark passes it; later events are left out."""
    out = events.withWatermark(time, late).groupBy(F.window(time, size), *keys).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), *keys, "events")


def sessions(events: DataFrame, time: str, gap: str, late: str, keys: list[str]) -> DataFrame:
    """Counts of events a session, which ends after a gap without events."""
    out = events.withWatermark(time, late).groupBy(F.session_window(time, gap), *keys).agg(F.count(F.lit(1)).alias("events"))
    return out.select(F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), *keys, "events")


def start(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """A query that writes Parquet; its progress is in the checkpoint folder, which all executors must share."""
    return df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).start(path)
