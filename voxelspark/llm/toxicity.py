"""Toxicity by FTRL-proximal logistic regression over hashed words, n-grams and skip-grams.

Features of a text, each counted once: its words (A-Z lower-cased, ASCII punctuation as gaps),
the words' beginnings of 4 to 10 bytes (inflected forms share them), pairs of neighbouring words, and
pairs with one or two words between. All are hashed to 2**``BITS`` coordinates. Every
coordinate has its own learning rate; the L1 term keeps at zero what carries no evidence, so the
model is a short list of (coordinate, weight) that is broadcast.

The classifier is fitted on at most ``SAMPLE`` labelled rows (those with the smallest hashes of
the id; a documented bound), in one task and ``EPOCHS`` passes. All documents are scored whole.

Nulls: a null text is empty; an empty text has the score of the bias. Rows whose label is null
teach nothing; of several labels of an id the largest counts. Without any labelled row every score
is the same, below 0.01.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm import common
from voxelspark.llm.common import PUNCTUATION, WHITE, chunks, encoded, fold, mix

BITS = 20
SAMPLE = 24_000
EPOCHS = 5
ALPHA, BETA, L1, L2 = 0.3, 1.0, 8.0, 0.0
POSITIVE = 3.0  # weight of a toxic row: these are about one in ten
GAPS = WHITE | PUNCTUATION
STEMS = range(4, 11)


def features(texts: list[bytes]):
    """Coordinates (int32) of all features of the texts, in order of the texts, and the text of each."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = GAPS[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.int32), np.zeros(0, np.int64)
    length = ends - starts
    doc = np.searchsorted(np.cumsum([len(t) + 1 for t in texts]), starts, "right")
    place = np.zeros(len(raw), np.int64)
    place[~gap] = np.arange(len(raw))[~gap] - np.repeat(starts, length)
    powers = np.cumprod(np.full(int(length.max()), common._POWER, np.uint64))
    values = common._BYTE[common.LOWER[raw]] * powers[place]
    values[gap] = 0
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(values)))
    word = mix(total[ends] - total[starts])
    out, docs = [word], [doc]
    for n in STEMS:
        long = length > n
        out.append(mix(total[starts[long] + n] - total[starts[long]] + np.uint64(n)))
        docs.append(doc[long])
    for apart in (1, 2, 3):
        both = doc[apart:] == doc[:-apart]
        pair = mix(word[:-apart] * np.uint64(2 * apart + 1) + word[apart:])
        out.append(pair[both])
        docs.append(doc[apart:][both])
    return (np.concatenate(out) >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(docs)


class FTRL:
    """FTRL-proximal: z and n per coordinate, weights only where |z| exceeds the L1 term."""

    def __init__(self, size: int = 1 << BITS):
        self.z, self.n, self.bias_z, self.bias_n = np.zeros(size), np.zeros(size), 0.0, 0.0

    def _weights(self, z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, at: np.ndarray, label: int) -> None:
        z, n = self.z[at], self.n[at]
        w, bias = self._weights(z, n, L1), float(self._weights(self.bias_z, self.bias_n, 0.0))
        p = 1 / (1 + np.exp(-np.clip(w.sum() + bias, -35, 35)))
        g = (p - label) * (POSITIVE if label else 1.0)
        sigma = (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA
        self.z[at], self.n[at] = z + g - sigma * w, n + g * g
        sigma = (np.sqrt(self.bias_n + g * g) - np.sqrt(self.bias_n)) / ALPHA
        self.bias_z, self.bias_n = self.bias_z + g - sigma * bias, self.bias_n + g * g

    def model(self) -> tuple[np.ndarray, np.ndarray, float]:
        w = self._weights(self.z, self.n, L1)
        at = np.flatnonzero(w)
        return at.astype(np.int32), w[at].astype(np.float32), float(self._weights(self.bias_z, self.bias_n, 0.0))


def learn(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample: int = SAMPLE):
    """(coordinates, weights, bias) from the labelled rows outside the held-out fold."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & (fold("doc_id", held_out) != 0))
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    known = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)  # bounded, so it may be broadcast
    rows = docs.select("doc_id", "text").join(F.broadcast(known), "doc_id")

    def run(batches):
        seen: list[tuple[np.ndarray, int, int]] = []
        for b in batches:
            texts, toxic, ids = encoded(b["text"].to_pylist()), b["toxic"].to_pylist(), b["doc_id"].to_pylist()
            for part in chunks(texts, map(len, texts), 1 << 20):
                at, doc = features(texts[part])
                order = np.argsort(doc, kind="stable")
                cuts = np.searchsorted(doc[order], np.arange(part.stop - part.start + 1))
                for i in range(part.stop - part.start):
                    own = np.unique(at[order[cuts[i] : cuts[i + 1]]])
                    seen.append((own, toxic[part.start + i], int(mix(np.array([ids[part.start + i]], np.int64).view(np.uint64))[0])))
        seen.sort(key=lambda row: row[2])  # the same order whatever the order of arrival
        model = FTRL()
        for _ in range(EPOCHS):
            for own, label, _ in seen:
                model.step(own, label)
        at, w, bias = model.model()
        bias = bias if seen else -5.0
        yield pa.RecordBatch.from_arrays([pa.array([at.tolist()], pa.list_(pa.int32())), pa.array([w.tolist()], pa.list_(pa.float32())), pa.array([bias])], ["at", "w", "bias"])

    found = rows.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "toxic").repartition(1)
    row = found.mapInArrow(run, "at array<int>, w array<float>, bias double").collect()
    if not row:
        return np.zeros(0, np.int32), np.zeros(0, np.float32), -5.0
    return np.array(row[0]["at"], np.int32), np.array(row[0]["w"], np.float32), row[0]["bias"]


def score_texts(texts: list[bytes], model) -> np.ndarray:
    at, w, bias = model
    weights = np.zeros(1 << BITS, np.float32)
    weights[at] = w
    out = np.full(len(texts), bias)
    for part in chunks(texts, map(len, texts), 1 << 20):
        found, doc = features(texts[part])
        hit = weights[found] != 0
        pairs = np.unique(doc[hit] * (1 << BITS) + found[hit])  # each feature once a text
        out[part] += np.bincount(pairs >> BITS, weights[pairs & ((1 << BITS) - 1)], part.stop - part.start)
    return 1 / (1 + np.exp(-np.clip(out, -35, 35)))


def score(docs: DataFrame, labels: DataFrame, held_out: int = 5, sample: int = SAMPLE) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, score, predicted."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs, labels, held_out, sample))

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(score_texts(encoded(b["text"].to_pylist()), shared.value))], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")
    return rows.select("doc_id", (fold("doc_id", held_out) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
