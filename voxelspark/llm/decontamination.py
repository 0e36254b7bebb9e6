"""Benchmark decontamination: CGK random walks, bit-sampling LSH, exact edit verification.

Edits are counted in words (A-Z lower-cased, ASCII punctuation as gaps). The CGK embedding
walks over a window: at each step it writes the word it stands on and moves on if a random bit
of that word and step says so, so that windows a few edits apart fall into step again and their
walks differ in few places: edit distance becomes Hamming distance. A repetition samples some
of the written places as one signature. Windows start at every word of a document; an item is
embedded from every one of its words, so an edit spoils only the walks that meet it. Walks that
agree align an item with an item-sized window, give or take the allowed edits, whose
edit distance to the item is then computed exactly.

``REPETITIONS`` walks of ``STEPS`` steps with ``SAMPLES`` samples each: with at most 20 % of
the words edited at random places, more than 95 % of the items of 14 words or more are found (see
the tests). Shorter items use shorter walks; items without a word match nothing.

Benchmark items come in blocks of at most ``BLOCK_BYTES`` of text, each compared with all
documents, so that what a task holds is bounded whatever the size of the benchmark.

Nulls: null texts match nothing; null ids are carried. Repeated items and documents each keep
their rows: one row per document row and item, that of the smallest distance, then the first place.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import PUNCTUATION, WHITE, encoded, hashed_batches, hashed_words, mix

REPETITIONS = 4
STEPS = 12
SAMPLES = 5
TOLERANCE = 0.2
BLOCK_BYTES = 8 << 20
GAPS = WHITE | PUNCTUATION
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def walk(words: np.ndarray, repetition: int, steps: int, samples: int) -> tuple[np.ndarray, np.ndarray]:
    """Signature of the walk from every word, and the last place it wrote."""
    rng = np.random.default_rng([repetition, steps])
    # The first step is always sampled: it pins the window to its first word.
    sampled = {0, *rng.choice(np.arange(1, steps), samples - 1, replace=False).tolist()} if steps > samples else set(range(steps))
    bits = mix(words ^ np.uint64(rng.integers(1, 2**63)))
    here = np.arange(len(words), dtype=np.int32)
    at, last, signature = here, here, np.zeros(len(words), np.uint64)
    for step in range(steps):
        if step in sampled:
            signature = (signature ^ words[at]) * _TIMES
            signature ^= signature >> np.uint64(29)
            last = at
        forward = here + ((bits >> np.uint64(step)) & np.uint64(1)).astype(np.int32)
        forward[-1:] = len(words) - 1
        at = forward[at]
    return signature, last


class Index:
    """Signatures of the items' walks from every word, by length of walk."""

    def __init__(self, ids: list, texts: list[str | None], repetitions: int = REPETITIONS, tolerance: float = TOLERANCE):
        raw = encoded(texts)
        words, first = hashed_words(raw, GAPS)
        self.ids, self.tolerance, self.repetitions = ids, tolerance, repetitions
        self.items = [words[a:b] for a, b in zip(first, first[1:])]
        self.walks = {}
        for steps, samples in ((STEPS, SAMPLES), (4, 3), (1, 1)):
            shorter = {4: STEPS, 1: 4}.get(steps)
            own = [i for i, w in enumerate(self.items) if len(w) >= steps and (shorter is None or len(w) < shorter)]
            if own:
                self.walks[steps, samples] = [self._table(own, r, steps, samples) for r in range(repetitions if steps > 1 else 1)]

    def _table(self, own: list[int], repetition: int, steps: int, samples: int):
        """Sorted signatures with (item, place), and a bit map of their leading bits."""
        rows = []
        for i in own:
            # Walks that would leave the item are no part of it: the window after it differs.
            padded = np.concatenate([self.items[i], np.zeros(1, np.uint64)])
            signature, last = walk(padded, repetition, steps, samples)
            # Nor do walks count that stand on a few words all the time.
            length = last[:-1] - np.arange(len(self.items[i]))
            good = np.flatnonzero((last[:-1] < len(self.items[i])) & (length >= min(steps // 3, 4)))
            rows.append((signature[good], np.full(len(good), i), good))
        signature, item, place = (np.concatenate(c) for c in zip(*rows))
        order = np.argsort(signature, kind="stable")
        signature = signature[order]
        bits = np.zeros(1 << 20, bool)
        bits[(signature >> np.uint64(44)).astype(np.int64)] = True
        return signature, item[order], place[order], bits

    def candidates(self, words: np.ndarray) -> np.ndarray:
        """Distinct (item, start) of item-sized windows whose walks agree; starts may be off by the
        allowed edits, and are cut to multiples of them."""
        found = []
        for (steps, samples), tables in self.walks.items():
            for r, (signature, item, place, bits) in enumerate(tables):
                own, _ = walk(words, r, steps, samples)
                at = np.flatnonzero(bits[(own >> np.uint64(44)).astype(np.int64)])
                low, high = np.searchsorted(signature, own[at], "left"), np.searchsorted(signature, own[at], "right")
                at, low, n = at[high > low], low[high > low], (high - low)[high > low]
                if len(at):
                    rows = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    found.append(np.stack([item[rows], np.repeat(at, n) - place[rows]], axis=1))
        return np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 2), np.int64)


def edit_distance(item: np.ndarray, window: np.ndarray) -> tuple[int, int, int]:
    """Least word edits from ``item`` to a part of ``window``, with the part's bounds."""

    def ends(a: np.ndarray, b: np.ndarray, free_start: bool) -> np.ndarray:
        place = np.arange(len(b) + 1)
        row = np.zeros(len(b) + 1, np.int64) if free_start else place.copy()
        for i, w in enumerate(a, 1):
            step = np.concatenate(([i], np.minimum(row[:-1] + (b != w), row[1:] + 1)))
            row = np.minimum.accumulate(step - place) + place
        return row

    row = ends(item, window, True)
    end = int(row.argmin())
    back = ends(item[::-1], window[:end][::-1], False)
    return int(row[end]), end - int(np.flatnonzero(back == row[end])[0]), end


def matches(index: Index, words: np.ndarray, first: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """(document, item, distance, first word, words) of verified windows, one a document and item."""
    if not len(words):
        return []
    best: dict[tuple[int, int], tuple[int, int, int]] = {}
    seen: set[tuple[int, int, int]] = set()
    found = index.candidates(words)
    for i, start in found.tolist():
        item = index.items[i]
        allowed = int(index.tolerance * len(item))
        # Every document that the window meets: a trimmed item may fill one between its ends.
        ends = [min(max(p, 0), len(words) - 1) for p in (start, start + len(item) - 1)]
        low, high = (int(np.searchsorted(first, p, "right")) - 1 for p in ends)
        for doc in range(low, high + 1):
            lo, hi = int(first[doc]), int(first[doc + 1])
            if hi - lo < len(item) - allowed:
                continue
            if (doc, i) in best and best[doc, i][0] == 0:
                continue
            if lo <= start and start + len(item) <= hi and np.array_equal(words[start : start + len(item)], item):
                best[doc, i] = (0, start - lo, len(item))
                continue
            if (doc, i, start // max(1, allowed)) in seen:
                continue
            seen.add((doc, i, start // max(1, allowed)))
            a, b = max(lo, start - 2 * allowed), min(hi, start + len(item) + 2 * allowed)
            if b - a < len(item) - allowed or np.isin(item, words[a:b]).sum() < len(item) - allowed:
                continue
            distance, left, right = edit_distance(item, words[a:b])
            if distance <= allowed:
                row = (distance, a + left - lo, right - left)
                best[doc, i] = min(best.get((doc, i), row), row)
    return [(doc, i, *row) for (doc, i), row in sorted(best.items())]


def item_blocks(benchmark: DataFrame):
    """The items in broadcast blocks of about ``BLOCK_BYTES``, as (ids, texts)."""
    items = benchmark.select("item_id", "text").where(F.col("text").isNotNull())
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = 1 + size // BLOCK_BYTES
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        yield benchmark.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))


def clean(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, repetitions: int = REPETITIONS) -> DataFrame:
    """The rows of ``docs`` that hold no benchmark item; a filter on the text, without a join."""
    for shared in item_blocks(benchmark):
        docs = docs.where(~_holds(shared, tolerance, repetitions)("text"))
    return docs


def _holds(shared, tolerance: float, repetitions: int):
    @F.pandas_udf("boolean")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        index = Index(*shared.value, repetitions, tolerance)
        for texts in batches:
            out = np.zeros(len(texts), bool)
            for part, (words, first) in hashed_batches(encoded(texts.tolist()), GAPS):
                out[[part.start + doc for doc, *_ in matches(index, words, first)]] = True
            yield pd.Series(out)

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = TOLERANCE, repetitions: int = REPETITIONS) -> DataFrame:
    """Rows (doc_id, item_id, distance, first_word, n_words, item_words) of every document and
    item whose best window is within ``tolerance`` of the item's words."""
    kinds = {c: d.schema[c].dataType.simpleString() for c, d in (("doc_id", docs), ("item_id", benchmark))}
    schema = f"doc_id {kinds['doc_id']}, item_id {kinds['item_id']}, distance int, first_word long, n_words int, item_words int"
    out = None
    for shared in item_blocks(benchmark):
        part = docs.select("doc_id", "text").mapInArrow(_search(shared, tolerance, repetitions, kinds), schema)
        out = part if out is None else out.unionByName(part)
    return out


def _search(shared, tolerance: float, repetitions: int, kinds: dict[str, str]):
    def run(batches):
        index = Index(*shared.value, repetitions, tolerance)
        for b in batches:
            ids = b["doc_id"].to_pylist()
            for part, (words, first) in hashed_batches(encoded(b["text"].to_pylist()), GAPS):
                rows = [
                    (ids[part.start + doc], index.ids[i], distance, start, n, len(index.items[i]))
                    for doc, i, distance, start, n in matches(index, words, first)
                ]
                if rows:
                    types = [b.schema.field("doc_id").type, None, pa.int32(), pa.int64(), pa.int32(), pa.int32()]
                    arrays = [pa.array(c, t) for c, t in zip(zip(*rows), types)]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "item_id", "distance", "first_word", "n_words", "item_words"])

    return run
