"""Language identification with hyperdimensional profiles.

Every letter has a random vector of +1 and -1. A trigram is bound from its letters' vectors,
permuted by place and multiplied; a document is the bundle (sum) of its trigrams, and a
language's prototype the sum of its documents' bundles, each brought to the same length first, so
that short and very long documents weigh the same. The language of
the nearest prototype by cosine is predicted; the score is that cosine, at least 0.

Letters outside a-z share 37 vectors by a hash of the code point, so the trigrams' codes are
bounded whatever the scripts; runs of other characters count as one blank.

Nulls and edge cases: a null text, and one without a letter, is ``und`` with score 0; so is every
text when nothing could be learned. Of languages with equal cosines the alphabetically first wins.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import chunks, fold

DIMENSIONS = 512
SYMBOLS = 64
CHUNK = 1 << 19
WEIGHT = 1 << 20
UNKNOWN = "und"


@cache
def _symbols() -> np.ndarray:
    """The symbol of every code point: 0 for a blank, 1-26 for a-z, a hashed one for other letters."""
    out = np.zeros(0x110000, np.uint8)
    letters = np.array([i for i in range(0x110000) if chr(i).isalpha()], np.int64)
    out[letters] = 27 + ((letters * 2654435761) >> 7) % (SYMBOLS - 27)
    out[ord("a") : ord("z") + 1] = np.arange(1, 27)
    return out


@cache
def _letters(dimensions: int) -> np.ndarray:
    return np.random.default_rng(7).choice(np.array([-1, 1], np.int8), (SYMBOLS, dimensions))


def trigram_vectors(codes: np.ndarray, dimensions: int) -> np.ndarray:
    one, two, three = codes // SYMBOLS**2, codes // SYMBOLS % SYMBOLS, codes % SYMBOLS
    v = _letters(dimensions)
    return np.roll(v, 2, axis=1)[one] * np.roll(v, 1, axis=1)[two] * v[three]


def trigrams(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of all trigrams of the texts, and the bounds of each text's codes."""
    spaced = [f" {t.lower()} " for t in texts]
    points = np.frombuffer("".join(spaced).encode("utf-32-le", "surrogatepass"), np.uint32)
    sym = _symbols()[points]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in spaced])
    keep = np.ones(len(sym), bool)
    keep[1:] = (sym[1:] > 0) | (sym[:-1] > 0) | (doc[1:] != doc[:-1])
    sym, doc = sym[keep].astype(np.int32), doc[keep]
    if len(sym) < 3:
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    inside = doc[2:] == doc[:-2]
    codes = (sym[:-2] * SYMBOLS + sym[1:-1]) * SYMBOLS + sym[2:]
    codes, doc = codes[inside], doc[2:][inside]
    return codes, np.searchsorted(doc, np.arange(len(texts) + 1))


def _columns(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct codes, and each code's place among them."""
    used = np.flatnonzero(np.bincount(codes, minlength=SYMBOLS**3))
    place = np.zeros(SYMBOLS**3, np.int32)
    place[used] = np.arange(len(used))
    return used, place[codes]


def learn(docs: DataFrame, dimensions: int = DIMENSIONS, held_out: int = 5) -> dict[str, np.ndarray]:
    """Prototypes from all rows with a language whose fold is not 0. Weights are whole numbers,
    so the sums do not depend on their order. One row a language and task leaves a task."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold("doc_id", held_out) != 0)).select("text", "lang")

    def run(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            texts, langs = b["text"].to_pylist(), np.array(b["lang"].to_pylist(), object)
            for part in chunks(texts, map(len, texts), CHUNK):
                codes, first = trigrams(texts[part])
                if not len(codes):
                    continue
                used, place = _columns(codes)
                names, which = np.unique(langs[part].astype(str), return_inverse=True)
                vectors = trigram_vectors(used, dimensions).astype(np.float64)
                for at in range(0, len(first) - 1, 256):
                    bounds = first[at : at + 257]
                    counts = np.array([np.bincount(place[x:y], minlength=len(used)) for x, y in zip(bounds, bounds[1:])], float)
                    # Whole numbers below 2**53 have exact products and sums, in any order.
                    bundle = counts @ vectors
                    unit = bundle / np.maximum(np.sqrt((bundle * bundle).sum(axis=1, keepdims=True)), 1e-9)
                    for k, v in zip(which[at : at + 256].tolist(), np.rint(WEIGHT * unit)):
                        sums[names[k]] = sums.get(names[k], 0) + v
        if sums:
            rows = [list(sums), [v.astype(np.int64).tolist() for v in sums.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(rows[0]), pa.array(rows[1], pa.list_(pa.int64()))], ["lang", "v"])

    parts = known.mapInArrow(run, "lang string, v array<long>").select("lang", F.posexplode("v").alias("place", "x"))
    out: dict[str, np.ndarray] = {}
    for row in parts.groupBy("lang", "place").agg(F.sum("x").alias("x")).collect():
        out.setdefault(row["lang"], np.zeros(dimensions))[row["place"]] = row["x"]
    return {k: out[k] / (np.linalg.norm(out[k]) or 1) for k in sorted(out)}


def predict(texts: list[str | None], prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> tuple[list[str], np.ndarray]:
    names = list(prototypes)
    texts = [t or "" for t in texts]
    langs, scores = [UNKNOWN] * len(texts), np.zeros(len(texts))
    if not names:
        return langs, scores
    against = np.array([prototypes[n] for n in names], np.float32)
    for part in chunks(texts, map(len, texts), CHUNK):
        codes, first = trigrams(texts[part])
        if not len(codes):
            continue
        used, place = _columns(codes)
        vectors = trigram_vectors(used, dimensions).astype(np.float32)
        for at in range(0, len(first) - 1, 256):
            bounds = first[at : at + 257]
            counts = np.array([np.bincount(place[a:b], minlength=len(used)) for a, b in zip(bounds, bounds[1:])], np.float32)
            bundle = counts @ vectors
            cosine = bundle @ against.T / np.maximum(np.linalg.norm(bundle, axis=1, keepdims=True), 1e-9)
            best = cosine.argmax(axis=1)
            for i in np.flatnonzero(np.diff(bounds)):
                n = part.start + at + i
                langs[n], scores[n] = names[best[i]], min(1.0, max(0.0, float(cosine[i, best[i]])))
    return langs, scores


def predicted(text: Column | str, prototypes: dict[str, np.ndarray], dimensions: int = DIMENSIONS) -> Column:
    """A struct of ``lang_pred`` and ``score`` for a text column."""

    @F.pandas_udf("lang_pred string, score double")
    def run(texts: pd.Series) -> pd.DataFrame:
        langs, scores = predict(texts.tolist(), prototypes, dimensions)
        return pd.DataFrame({"lang_pred": langs, "score": scores})

    return run(text)


def identify(docs: DataFrame, dimensions: int = DIMENSIONS, held_out: int = 5) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score."""
    found = predicted("text", learn(docs, dimensions, held_out), dimensions)
    rows = docs.select("doc_id", (fold("doc_id", held_out) == 0).alias("held_out"), found.alias("found"))
    return rows.select("doc_id", "held_out", "found.lang_pred", "found.score")
