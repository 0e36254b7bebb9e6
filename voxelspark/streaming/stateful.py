"""Streams with state of their own per key: one record a region, one timer an entity.

State lives in the session's keyed state store (RocksDB), so an epoch reads and writes the keys
it meets and nothing else; old versions are compacted by the store. A replayed epoch starts from
the state before it and gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from ..functions.grid import REGION_CHUNKS
from ..operators.changes import REGION

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """Streams started inside keep their state in RocksDB; others of the session are left alone
    (a query copies the settings as it starts, and a restart takes those of its checkpoint)."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKSDB)
    try:
        yield
    finally:
        spark.conf.unset(_PROVIDER) if before is None else spark.conf.set(_PROVIDER, before)


class _Regions(StatefulProcessor):
    """The last header of a region: its file time and the stamps of its chunks."""

    def init(self, handle) -> None:
        self.last = handle.getValueState("header", "mtime bigint, slots array<int>, stamps array<bigint>")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        polled = pd.concat([r[["slot", "stamp", "mtime"]] for r in rows])
        state = self.last.get() if self.last.exists() else None
        seen, known, time = state is not None, {}, None
        if seen:
            time, known = state[0], dict(zip(state[1], state[2]))
        found = []
        # Several polls of a region may come in one epoch; each is compared with the one before.
        for mtime, header in [(None, polled)] if polled["mtime"].isna().all() else polled.groupby("mtime"):
            if seen and mtime is not None and time is not None and mtime <= time:
                continue
            held = header.dropna(subset=["slot"]).groupby("slot")["stamp"].max()
            now = {int(s): int(t) for s, t in held.items()}
            if seen:
                found += [(s, t) for s, t in now.items() if s not in known or t > known[s]]
            seen, known, time = True, now, None if mtime is None else int(mtime)
        slots = sorted(known)
        self.last.update((time, slots, [known[s] for s in slots]))
        if found:
            slot, stamp = np.array(found, np.int64).T
            n = REGION_CHUNKS
            yield pd.DataFrame(
                {"dimension": key[0], "chunk_x": (key[1] * n + slot % n).astype(np.int32), "chunk_z": (key[2] * n + slot // n).astype(np.int32), "stamp": stamp}
            )

    def close(self) -> None:
        pass


def changed_chunks(slots: DataFrame) -> DataFrame:
    """Chunks of a stream of region headers that are new or carry a later stamp.

    A poll of a region is its whole header: ``dimension, region_x, region_z, slot, stamp``, or one
    row whose ``slot`` is null where it holds no chunk. A region's first poll is its baseline and
    reports nothing. With ``mtime``, a poll whose file is not newer than the last is skipped, and
    several polls of one epoch are taken in that order; without, an epoch holds one poll a region.
    """
    time = F.col("mtime").cast("long") if "mtime" in slots.columns else F.lit(None).cast("long")
    rows = slots.select(*REGION, F.col("slot").cast("int").alias("slot"), F.col("stamp").cast("long").alias("stamp"), time.alias("mtime"))
    out = "dimension string, chunk_x int, chunk_z int, stamp bigint"
    return rows.groupBy(*REGION).transformWithStateInPandas(_Regions(), out, "Append", "None")


class _Presence(StatefulProcessor):
    """Spans of an entity's updates that no gap of more than ``stale`` breaks.

    Spans that may still grow, or meet, wait in the state; a timer at the end of the first one
    brings it out once the watermark has passed.
    """

    def __init__(self, stale_ms: int, name: str):
        self.stale, self.name = stale_ms, name

    def init(self, handle) -> None:
        self.handle = handle
        self.open = handle.getValueState("spans", "first array<bigint>, last array<bigint>")

    def _turn(self, key, spans: list, watermark: int) -> Iterator[pd.DataFrame]:
        """Writes back what stays open, with its timer, and gives what is over."""
        over = [s for s in spans if s[1] // 1000 + self.stale <= watermark]
        spans = [s for s in spans if s[1] // 1000 + self.stale > watermark]
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if spans:
            self.open.update(([s[0] for s in spans], [s[1] for s in spans]))
            self.handle.registerTimer(min(s[1] for s in spans) // 1000 + self.stale)
        else:
            self.open.clear()
        if over:
            first, last = np.array(over, np.int64).T
            yield pd.DataFrame({self.name: key[0], "first_seen": first, "last_seen": last})

    def _spans(self) -> list:
        return list(zip(*self.open.get())) if self.open.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        at = np.concatenate([r["at"].to_numpy(np.int64) for r in rows])
        merged: list[list] = []
        for first, last in sorted([*self._spans(), *((t, t) for t in np.unique(at).tolist())]):
            if merged and first - merged[-1][1] <= self.stale * 1000:
                merged[-1][1] = max(merged[-1][1], last)
            else:
                merged.append([first, last])
        yield from self._turn(key, merged, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._turn(key, self._spans(), timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def expired_entities(updates: DataFrame, key: str, stale_ms: int = 30_000, late: str = "0 seconds") -> DataFrame:
    """Each stay of an entity, once it is over: ``key, first_seen, last_seen``.

    ``updates`` is a stream with the event time ``ts``. A stay ends where no update follows within
    ``stale_ms``, and is given when the watermark, ``late`` behind the latest update, says that
    none can. The order of updates inside that delay does not matter, nor where epochs end.
    """
    kind = updates.schema[key].dataType.simpleString()
    rows = updates.select(key, "ts", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("ts is not null")
    rows = rows.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    out = f"{key} {kind}, first_seen bigint, last_seen bigint"
    spans = rows.groupBy(key).transformWithStateInPandas(_Presence(stale_ms, key), out, "Append", "EventTime")
    return spans.withColumns({c: F.timestamp_micros(c) for c in ("first_seen", "last_seen")})


def to_table(stream: DataFrame, path: str, checkpoint: str, **options) -> StreamingQuery:
    """Append a stateful stream's rows to Parquet files, each epoch's exactly once."""
    with keyed_state(stream.sparkSession):
        return (
            stream.writeStream.format("parquet")
            .option("path", path)
            .option("checkpointLocation", checkpoint)
            .outputMode("append")
            .trigger(**(options or {"availableNow": True}))
            .start()
        )


def watch_world(slots: DataFrame, out_path: str, checkpoint: str, **options) -> StreamingQuery:
    """Changed chunks of polled region headers (:func:`changed_chunks`) as a table."""
    return to_table(changed_chunks(slots), out_path, checkpoint, **options)
