"""Exact deduplication through a cuckoo filter over digests, with verified hits.

A shard of the index is a cuckoo filter (16-bit fingerprints, buckets of four) whose slots
point at the stored 32-byte digests. The filter answers "new" for nearly every unseen digest;
a hit counts only after the stored digest in that bucket compares equal. Slots of deleted
digests are freed; a key that finds no slot makes the filter twice as large, refilled from
the stored keys. Shards follow a hash of the digest, so their size falls with their number.

Nulls and ties: a null text counts as the empty text; a null id never wins over another id;
rows that repeat one id with an equal text are one document and share one result.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import SPACE, written

SLOTS = 4
MAX_KICKS = 200
NO_ID = np.iinfo(np.int64).max


class CuckooShard:
    """A cuckoo filter with the keys behind its slots. Keys are rows of 32 bytes."""

    def __init__(self, buckets: int = 64):
        self.keys = np.zeros((0, 32), np.uint8)
        self.live = np.zeros(0, bool)
        self.used = 0
        self._reset(buckets)

    def _reset(self, buckets: int) -> None:
        self.mask = np.int64(buckets - 1)
        self.prints = np.zeros((buckets, SLOTS), np.uint16)
        self.rows = np.full((buckets, SLOTS), -1, np.int64)
        self.rng = np.random.default_rng(buckets)

    def _places(self, keys: np.ndarray):
        words = np.ascontiguousarray(keys).view("<u8").reshape(len(keys), 4)
        prints = (words[:, 1] & np.uint64(0xFFFF)).astype(np.uint16)
        prints[prints == 0] = 1
        one = (words[:, 0] & np.uint64(self.mask)).astype(np.int64)
        return prints, one, self._other(one, prints)

    def _other(self, bucket: np.ndarray, prints: np.ndarray) -> np.ndarray:
        return bucket ^ ((prints.astype(np.int64) * 0x5BD1E995) & self.mask)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The row of each key, or -1: filter hits verified against the stored digests."""
        found = np.full(len(keys), -1, np.int64)
        prints, one, two = self._places(keys)
        for bucket in (one, two):
            for slot in range(SLOTS):
                hit = np.flatnonzero((self.prints[bucket, slot] == prints) & (found < 0))
                rows = self.rows[bucket[hit], slot]
                same = (self.keys[rows] == keys[hit]).all(axis=1)
                found[hit[same]] = rows[same]
        return found

    def insert(self, keys: np.ndarray) -> np.ndarray:
        """Store distinct keys that ``find`` does not know; returns their rows."""
        rows = np.arange(self.used, self.used + len(keys))
        if self.used + len(keys) > len(self.keys):
            size = max(1024, 2 * (self.used + len(keys)))
            self.keys = np.concatenate([self.keys[: self.used], np.zeros((size - self.used, 32), np.uint8)])
            self.live = np.concatenate([self.live[: self.used], np.zeros(size - self.used, bool)])
        self.keys[rows], self.live[rows] = keys, True
        self.used += len(keys)
        if not self._place(rows):
            self._grow()
        return rows

    def _grow(self) -> None:
        live = np.flatnonzero(self.live[: self.used])
        buckets = len(self.prints)
        while True:
            buckets *= 2
            self._reset(buckets)
            if len(live) <= 0.9 * buckets * SLOTS and self._place(live):
                return

    def _place(self, rows: np.ndarray) -> bool:
        """Give every row a slot; False when some keys still have none after MAX_KICKS rounds."""
        prints, one, two = self._places(self.keys[rows])
        bucket = one
        for turn in range(MAX_KICKS):
            for first in (True, False):
                at = bucket if first else self._other(bucket, prints)
                while len(rows):
                    free = self.prints[at] == 0
                    _, lead = np.unique(at, return_index=True)  # one key a bucket and round
                    lead = lead[free[lead].any(axis=1)]
                    if not len(lead):
                        break
                    slot = free[lead].argmax(axis=1)
                    self.prints[at[lead], slot], self.rows[at[lead], slot] = prints[lead], rows[lead]
                    rest = np.ones(len(rows), bool)
                    rest[lead] = False
                    rows, prints, bucket, at = rows[rest], prints[rest], bucket[rest], at[rest]
            if not len(rows):
                return True
            _, lead = np.unique(bucket, return_index=True)
            at, slot = bucket[lead], self.rng.integers(0, SLOTS, len(lead))
            out = self.prints[at, slot].copy(), self.rows[at, slot].copy()
            self.prints[at, slot], self.rows[at, slot] = prints[lead], rows[lead]
            prints[lead], rows[lead] = out
            bucket = bucket.copy()
            bucket[lead] = self._other(at, prints[lead])
        return False

    def delete(self, keys: np.ndarray) -> np.ndarray:
        """Remove keys; True for those that were live. A later insertion stores them anew."""
        found = self.find(keys)
        rows = np.unique(found[found >= 0])
        for bucket in self._places(self.keys[rows])[1:]:
            for slot in range(SLOTS):
                own = self.rows[bucket, slot] == rows
                self.prints[bucket[own], slot], self.rows[bucket[own], slot] = 0, -1
        self.live[rows] = False
        return found >= 0


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id`` and the SHA-256 of the text with each white-space run as one space."""
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    return docs.select("doc_id", F.unhex(F.sha2(text, 256)).alias("digest"))


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, 32)


def _summed(keys: np.ndarray, ids: np.ndarray, sizes: np.ndarray):
    """Distinct keys with their smallest id and summed size."""
    names, where = np.unique(np.ascontiguousarray(keys).view("V32").ravel(), return_inverse=True)
    least = np.full(len(names), NO_ID, np.int64)
    np.minimum.at(least, where, ids)
    return names.view(np.uint8).reshape(-1, 32), least, np.bincount(where, sizes, len(names)).astype(np.int64)


def _batch(keys, ids, sizes) -> pa.RecordBatch:
    names = pa.array([bytes(k) for k in keys], pa.binary())
    return pa.RecordBatch.from_arrays(
        [names, pa.array(ids, pa.int64(), mask=ids == NO_ID), pa.array(sizes, pa.int64())], ["digest", "keep_id", "group_size"]
    )


def _local_groups(batches):
    """Within a batch, one row a digest: a group of any size leaves a task as few rows."""
    for b in batches:
        if b.num_rows:
            ids = b["doc_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False)
            yield _batch(*_summed(_matrix(b["digest"]), ids, np.ones(len(ids))))


def _shard_groups(batches):
    """The groups of one shard: unseen digests go into the filter, verified hits join a group."""
    shard, least, sizes = CuckooShard(), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for b in batches:
        if not b.num_rows:
            continue
        keys, ids, counts = _summed(
            _matrix(b["digest"]), b["keep_id"].fill_null(NO_ID).to_numpy(zero_copy_only=False), b["group_size"].to_numpy()
        )
        rows = shard.find(keys)
        new = rows < 0
        rows[new] = shard.insert(keys[new])
        if shard.used > len(least):
            more = len(shard.keys) - len(least)
            least, sizes = np.concatenate([least, np.full(more, NO_ID)]), np.concatenate([sizes, np.zeros(more, np.int64)])
        least[rows] = np.minimum(least[rows], ids)
        sizes[rows] += counts
    for at in range(0, shard.used, 50_000):
        part = slice(at, min(at + 50_000, shard.used))
        yield _batch(shard.keys[part], least[part], sizes[part])


def groups(found: DataFrame) -> DataFrame:
    """One row a distinct digest: ``digest``, ``keep_id`` (smallest id), ``group_size`` (rows)."""
    schema = "digest binary, keep_id long, group_size long"
    local = found.select(F.col("doc_id").cast("long").alias("doc_id"), "digest").mapInArrow(_local_groups, schema)
    return local.repartition("digest").mapInArrow(_shard_groups, schema)


def exact_groups(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256."""
    found = written(digests(docs))
    group = groups(found)
    return found.join(group, "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def deduplicated(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one for each distinct text. The
    join and the removal of repeated rows share one shuffle, by digest and id, which no group of
    copies can make uneven."""
    missing = F.lit(-(2**63))
    group = groups(written(digests(docs)))
    stays = group.select(F.col("digest").alias("__text_digest"), F.coalesce("keep_id", missing).alias("__row_id"))
    text = F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), SPACE, " ")
    keyed = docs.withColumns({"__text_digest": F.unhex(F.sha2(text, 256)), "__row_id": F.coalesce(F.col("doc_id").cast("long"), missing)})
    keys = ["__text_digest", "__row_id"]
    return keyed.join(stays, keys, "left_semi").dropDuplicates(keys).drop(*keys)


# ---------------------------------------------------------------- the index as a table

INDEX = "shard int, digest binary, bucket int, slot int, buckets int"


def _stored(shard: CuckooShard, number: int) -> pd.DataFrame:
    bucket, slot = np.nonzero(shard.prints)
    rows = shard.rows[bucket, slot]
    return pd.DataFrame(
        {"shard": np.int32(number), "digest": [bytes(k) for k in shard.keys[rows]], "bucket": bucket.astype(np.int32), "slot": slot.astype(np.int32), "buckets": np.int32(len(shard.prints))}
    )


def _loaded(stored: pd.DataFrame) -> CuckooShard:
    if not len(stored):
        return CuckooShard()
    shard = CuckooShard(int(stored.buckets.iloc[0]))
    shard.keys = np.frombuffer(b"".join(stored.digest), np.uint8).reshape(-1, 32).copy()
    shard.live, shard.used = np.ones(len(stored), bool), len(stored)
    bucket, slot = stored.bucket.to_numpy(), stored.slot.to_numpy()
    shard.rows[bucket, slot] = np.arange(len(stored))
    shard.prints[bucket, slot] = shard._places(shard.keys)[0]
    return shard


def _in_shards(df: DataFrame, shards: int) -> DataFrame:
    return df.withColumn("shard", F.pmod(F.xxhash64("digest"), F.lit(shards)).cast("int"))


def apply_changes(index: DataFrame | None, changes: DataFrame, shards: int) -> DataFrame:
    """The index table after ``changes`` (digest, live boolean, seq): the last change of a digest
    counts, ``live`` inserts it, else it is deleted. Choose ``shards`` so that one shard's keys
    (32 bytes each) fit a task."""
    spark = changes.sparkSession
    last = changes.groupBy("digest").agg(F.max_by("live", "seq").alias("live"))
    index = spark.createDataFrame([], INDEX) if index is None else index

    def change(key: tuple, stored: pd.DataFrame, news: pd.DataFrame) -> pd.DataFrame:
        shard = _loaded(stored)
        if len(news):
            keys, live = np.frombuffer(b"".join(news.digest), np.uint8).reshape(-1, 32), news.live.to_numpy(bool)
            shard.delete(keys[~live])
            add = keys[live]
            shard.insert(add[shard.find(add) < 0])
        return _stored(shard, key[0])

    return index.groupBy("shard").cogroup(_in_shards(last, shards).groupBy("shard")).applyInPandas(change, INDEX)


def probe(index: DataFrame, found: DataFrame, shards: int) -> DataFrame:
    """``digest`` and ``known`` for each distinct digest: in the filter, and verified there."""

    def look(key: tuple, stored: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(asked):
            return pd.DataFrame({"digest": [], "known": []})
        keys = np.frombuffer(b"".join(asked.digest), np.uint8).reshape(-1, 32)
        return pd.DataFrame({"digest": asked.digest, "known": _loaded(stored).find(keys) >= 0})

    asked = _in_shards(found.select("digest").distinct(), shards)
    return index.groupBy("shard").cogroup(asked.groupBy("shard")).applyInPandas(look, "digest binary, known boolean")
