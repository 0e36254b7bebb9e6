"""Phrase collocations by stripes: a prefix keys a counter of the words that follow it.

Texts are split once, into blocks of one language: the block's distinct words with their counts,
and its words as places in that list, 0 between pieces. Each length then takes one pass over the
blocks. A stripe (language, prefix) holds next words and how often they follow; a task adds its
blocks' stripes up before they travel, in bundles of prefixes whose number follows the size of the
corpus; the stripes of a bundle are merged elementwise, and entries below the least count go. From
what stays come the extensions (an entry is the phrase of prefix and next word), the totals of
prefixes and of the rests (both are entries of the length before, joined by key), and the
subsumption maxima (the greatest entry of a stripe for extensions to the right, the greatest entry
that ends alike for those to the left: a longer candidate as frequent as the phrase has one that is
a single word longer).

A part of a frequent phrase is as frequent, so a word sequence is only counted if its first and
its last words, one fewer, are frequent. That is looked up in a bit table of 2**26 bits built by
Spark; its errors let something be counted that then falls short, never the reverse.

Words are known by 64-bit hashes until phrases are spelled again by joins; two of ten million
words share one with a chance of about 10**-6. Stripes of prefixes that hold over a thousandth of
all words (at most a thousand prefixes) are cut by next word, up to ``PARTS`` ways by their share;
the empty prefix, whose counter is the vocabulary, is one row a word.

Nulls: a null text counts as empty, a null language as ``und``; ids play no part. Repeated rows
count as often as they stand. An empty table gives no row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.llm.common import LOWER, chunks, mix, written

LEAST = 100
LONGEST = 5
TOP = 2000
BLOCK = 1 << 20  # bytes of text in a block, or one longer document
HELD = 3 << 17  # stripe entries a task adds up before it passes them on
PARTS = 64
BUNDLE = 1 << 18  # words of the corpus per bundle of stripes: a bundle holds fewer distinct entries
BITS = 26
HOT = 1000
UNKNOWN = "und"
_STEP = np.uint64(0x9E3779B97F4A7C15)
# What ends a piece, and what separates words within one.
PIECE = np.zeros(256, bool)
PIECE[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
GAP = PIECE.copy()
GAP[[0x20, 0x09]] = True
_BYTES = np.random.default_rng(11).integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)


# ---------------------------------------------------------------------- blocks


def cut(texts: list[bytes]):
    """Distinct words (bytes), their hashes and counts, and the words in order as places from 1
    in that list, with 0 wherever a piece ends."""
    raw = LOWER[np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)]
    gap = GAP[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return [], np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.uint32)
    length = ends - starts
    inner = np.concatenate(([0], np.cumsum(length)[:-1]))
    place = np.arange(int(length.sum())) - np.repeat(inner, length)
    powers = np.cumprod(np.full(int(length.max()), _STEP, np.uint64))
    h = mix(np.add.reduceat(_BYTES[raw[~gap]] * powers[place], inner))
    distinct, first, code, count = np.unique(h, return_index=True, return_inverse=True, return_counts=True)
    flat = raw.tobytes()
    words = [flat[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
    piece = np.cumsum(PIECE[raw])[starts]
    breaks = np.flatnonzero(np.diff(piece, prepend=-1))
    return words, distinct, count, np.insert(code.astype(np.uint32) + 1, breaks, 0)


_BLOCKS = pa.schema([("lang", pa.string()), ("words", pa.list_(pa.string())), ("hashes", pa.list_(pa.int64())), ("counts", pa.list_(pa.int64())), ("places", pa.binary())])


def _blocks(batches):
    for batch in batches:
        langs = np.array(batch["lang"].to_pylist(), object)
        texts = [(t or "").encode("utf-8", "surrogatepass") for t in batch["text"].to_pylist()]
        for lang in sorted(set(langs)):
            own = [texts[i] for i in np.flatnonzero(langs == lang)]
            for part in chunks(own, map(len, own), BLOCK):
                words, hashes, counts, places = cut(own[part])
                if words:
                    row = ([lang], [[w.decode("utf-8", "replace") for w in words]], [hashes.view(np.int64)], [counts], [places.tobytes()])
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(row, _BLOCKS)], schema=_BLOCKS)


def blocks(docs: DataFrame) -> DataFrame:
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")
    return docs.select(lang, "text").mapInArrow(_blocks, "lang string, words array<string>, hashes array<long>, counts array<long>, places binary")


# ---------------------------------------------------------------------- stripes


def _lang(lang: str) -> np.uint64:
    return np.uint64(xxhash.xxh64_intdigest(lang.encode("utf-8", "surrogatepass")))


def _slots(lang: str, h: np.ndarray) -> np.ndarray:
    return (mix(h ^ _lang(lang)) >> np.uint64(64 - BITS)).astype(np.int64)


def _rolled(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n``; a run's hash follows from its beginning's and its last word's."""
    out = h[: len(h) - n + 1].copy()
    for i in range(1, n):
        out = mix(out * _STEP + h[i : len(h) - n + 1 + i])
    return out


_STRIPES = pa.schema([("lang", pa.string()), ("bundle", pa.int32()), *[(c, pa.list_(pa.int64())) for c in ("prefix", "rest", "next")], ("count", pa.list_(pa.int32()))])


def _stripes(n: int, bits, hot, bundles: int):
    """Stripes of prefixes of ``n`` words, each with the hash of the prefix without its first word,
    bundled by prefix (hot ones by prefix and part). ``bits`` tells which runs of ``n`` may be
    frequent; ``hot`` holds prefixes and their parts."""

    def packed(lang, prefix, rest, follow, count):
        hashes, parts = hot.value
        part = np.zeros(len(prefix), np.uint64)
        if len(hashes):
            at = np.minimum(np.searchsorted(hashes, prefix), len(hashes) - 1)
            part = mix(follow) % np.where(hashes[at] == prefix, parts[at], 1).astype(np.uint64)
        bundle = (mix(prefix + part * _STEP) % np.uint64(bundles)).astype(np.int32)
        by = np.argsort(bundle, kind="stable")  # prefixes stay in order inside
        bundle = bundle[by]
        new = np.flatnonzero(np.diff(bundle, prepend=-1))
        offsets = pa.array(np.append(new, len(bundle)).astype(np.int32))
        lists = [pa.ListArray.from_arrays(offsets, pa.array(c)) for c in (prefix[by].view(np.int64), rest[by].view(np.int64), follow[by].view(np.int64), count[by].astype(np.int32))]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(new)), pa.array(bundle[new]), *lists], schema=_STRIPES)

    def entries_of(lang, hashes, places):
        h = np.concatenate(([np.uint64(0)], hashes))[places]
        if len(h) <= n:
            return None
        piece = np.cumsum(places == 0)
        inside = (piece[n:] == piece[:-n]) & (places[:-n] > 0)
        runs = _rolled(h, n)
        known = np.frombuffer(bits.value, np.uint8)
        slot = _slots(lang, runs)
        frequent = (known[slot >> 3] >> (slot & 7).astype(np.uint8)) & 1
        at = np.flatnonzero(inside & (frequent[:-1] & frequent[1:]).astype(bool))
        return runs[at], _rolled(h, n - 1)[at + 1] if n > 1 else np.zeros(len(at), np.uint64), h[at + n]

    def run(batches):
        held: dict[str, list] = {}
        size = 0
        for batch in batches:
            for lang, hashes, places in zip(batch["lang"].to_pylist(), batch["hashes"], batch["places"].to_pylist()):
                found = entries_of(lang, hashes.values.to_numpy().view(np.uint64), np.frombuffer(places, np.uint32))
                if found is None or not len(found[0]):
                    continue
                entry = _unify(*found, np.ones(len(found[0]), np.int64))
                held.setdefault(lang, []).append(entry)
                size += len(entry[0])
                if size >= HELD:
                    for key, kept in held.items():
                        held[key] = [_unify(*map(np.concatenate, zip(*kept)))]
                    size = sum(len(k[0][0]) for k in held.values())
                    if size >= HELD // 2:
                        for key, (kept,) in held.items():
                            yield from packed(key, *kept)
                        held, size = {}, 0
        for key, kept in held.items():
            yield from packed(key, *_unify(*map(np.concatenate, zip(*kept))))

    return run


def _unify(prefix, rest, follow, count):
    """Equal (prefix, next word) entries as one, in the order of prefixes."""
    by = np.lexsort((follow, prefix))
    prefix, follow = prefix[by], follow[by]
    new = np.flatnonzero(np.concatenate(([True], (prefix[1:] != prefix[:-1]) | (follow[1:] != follow[:-1]))))
    return prefix[new], rest[by][new], follow[new], np.add.reduceat(count[by], new)


_PHRASES = pa.schema([("lang", pa.string()), ("h", pa.int64()), ("prefix", pa.int64()), ("suffix", pa.int64()), ("a", pa.int64())])


def _merged(n: int, least: int):
    """Bundles in order, their stripes merged elementwise: entries of at least ``least``."""

    def finish(lang, *entries):
        prefix, rest, follow, count = _unify(*entries)
        stay = count >= least
        if stay.any():
            prefix, rest, follow, count = prefix[stay], rest[stay], follow[stay], count[stay]
            suffix = mix(rest * _STEP + follow) if n > 1 else follow
            columns = [c.view(np.int64) for c in (mix(prefix * _STEP + follow), prefix, suffix, count)]
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(prefix)), *map(pa.array, columns)], schema=_PHRASES)

    def run(batches):
        last, held, size, most = None, [], 0, 2 * HELD
        for batch in batches:
            for lang, bundle, *columns in zip(batch["lang"].to_pylist(), batch["bundle"].to_pylist(), *[batch[c] for c in ("prefix", "rest", "next", "count")]):
                if (lang, bundle) != last and held:
                    yield from finish(last[0], *map(np.concatenate, zip(*held)))
                    held, size, most = [], 0, 2 * HELD
                last = (lang, bundle)
                prefix, rest, follow, count = (c.values.to_numpy() for c in columns)
                held.append((prefix.view(np.uint64), rest.view(np.uint64), follow.view(np.uint64), count.astype(np.int64)))
                size += len(prefix)
                if size > most:  # elementwise so far, so that a bundle is held once, not once a task
                    held = [_unify(*map(np.concatenate, zip(*held)))]
                    size = len(held[0][0])
                    most = max(2 * HELD, 2 * size)
        if held:
            yield from finish(last[0], *map(np.concatenate, zip(*held)))

    return run


# ---------------------------------------------------------------------- lengths


def _bits(spark: SparkSession, phrases: DataFrame):
    """The bit table of the frequent phrases (lang, h), 8 MB whatever their number."""

    def slots(batches):
        for batch in batches:
            langs, h = np.array(batch["lang"].to_pylist(), object), batch["h"].to_numpy().view(np.uint64)
            slot = np.zeros(len(h), np.int64)
            for lang in set(langs):
                own = langs == lang
                slot[own] = _slots(lang, h[own])
            yield pa.RecordBatch.from_arrays([pa.array(slot)], names=["slot"])

    slot = phrases.select("lang", "h").mapInArrow(slots, "slot long")
    word = F.shiftright("slot", 5).cast("int").alias("word")
    table = slot.groupBy(word).agg(F.bit_or(F.expr("shiftleft(1L, cast(slot % 32 as int))")).alias("bits")).toArrow()
    out = np.zeros(1 << (BITS - 5), np.uint32)
    out[table["word"].to_numpy()] = table["bits"].to_numpy().astype(np.uint32)
    return spark.sparkContext.broadcast(out.tobytes())


def _hot(spark: SparkSession, phrases: DataFrame, n: int):
    """Prefixes with over a ``HOT``-th of all words (fewer than ``HOT`` of them a length, by their
    counts alone) and the parts of their stripes, which follow that share."""
    found = phrases.where(F.col("a") * HOT > n).groupBy("h").agg(F.sum("a").alias("a")).orderBy("h").toArrow()
    h = found["h"].to_numpy().view(np.uint64)
    by = np.argsort(h)
    parts = np.minimum(PARTS, found["a"].to_numpy() * HOT // max(1, n) + 1)
    return spark.sparkContext.broadcast((h[by], parts[by]))


def phrases(cut_texts: DataFrame, least: int = LEAST, longest: int = LONGEST) -> tuple[DataFrame, list[DataFrame]]:
    """``(words, by_length)``: counts n of all words per language, and the frequent phrases of each
    length from 1: lang, h, prefix, suffix, a, words, heads, tails. ``heads[k]`` and ``tails[k]``
    are the counts of the first and last k + 1 words."""
    spark = cut_texts.sparkSession
    pairs = F.explode(F.arrays_zip("hashes", "words", "counts")).alias("w")
    words = cut_texts.select("lang", pairs).select("lang", F.col("w.hashes").alias("h"), F.col("w.words").alias("word"), F.col("w.counts").alias("a"))
    words = written(words.groupBy("lang", "h", "word").agg(F.sum("a").alias("a")))
    if words.groupBy("lang", "h").agg(F.count("*").alias("words")).where("words > 1").limit(1).count():
        raise ValueError("two words share a hash")
    n = words.groupBy("lang").agg(F.sum("a").alias("n"))
    total = words.agg(F.sum("a").alias("n")).first()["n"] or 0
    nothing = F.lit(None).cast("long")
    first = words.where(F.col("a") >= least).select("lang", "h", nothing.alias("prefix"), nothing.alias("suffix"), "a", F.array("word").alias("words"), F.array("a").alias("heads"), F.array("a").alias("tails"))
    out = [written(first)]
    stripe = "lang string, bundle int, prefix array<long>, rest array<long>, next array<long>, count array<int>"
    bundles = max(PARTS, total // BUNDLE)
    for size in range(1, longest):
        known = out[-1]
        stripes = cut_texts.select("lang", "hashes", "places").mapInArrow(_stripes(size, _bits(spark, known), _hot(spark, known, total), bundles), stripe)
        ordered = stripes.repartition("lang", "bundle").sortWithinPartitions("lang", "bundle")
        found = ordered.mapInArrow(_merged(size, least), "lang string, h long, prefix long, suffix long, a long")
        head = known.select("lang", F.col("h").alias("prefix"), "words", "heads")
        tail = known.select("lang", F.col("h").alias("suffix"), F.element_at("words", -1).alias("word"), "tails")
        joined = found.join(head, ["lang", "prefix"]).join(tail, ["lang", "suffix"])
        grown = joined.select("lang", "h", "prefix", "suffix", "a", F.concat("words", F.array("word")).alias("words"), F.concat("heads", F.array("a")).alias("heads"), F.concat("tails", F.array("a")).alias("tails"))
        out.append(written(grown))
    return n, out


def _scored(rows: DataFrame, size: int) -> DataFrame:
    """``rows`` of ``size`` words with the cut of the lowest score, the first of several."""
    cut = (
        "struct((1000BD * CAST(a AS DECIMAL(19,0)) * CAST(n AS DECIMAL(19,0))) div (CAST({l} AS DECIMAL(19,0)) * CAST({r} AS DECIMAL(19,0))) AS score,"
        " {k} AS k, {l} AS l, {r} AS r)"
    )
    cuts = ", ".join(cut.format(k=k, l=f"heads[{k - 1}]", r=f"tails[{size - k - 1}]") for k in range(1, size))
    rows = rows.withColumn("cut", F.expr(f"array_min(array({cuts}))"))
    return rows.select("lang", F.array_join("words", " ").alias("phrase"), "a", "cut.l", "cut.r", "n", "cut.score")


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's first ``top`` phrases."""
    n, found = phrases(written(blocks(docs)), least, longest)
    kept = []
    for size in range(2, longest + 1):
        rows = found[size - 1]
        if size < longest:
            longer = found[size]
            most = longer.select("lang", F.col("prefix").alias("h"), F.col("a").alias("most")).union(longer.select("lang", F.col("suffix").alias("h"), F.col("a").alias("most")))
            most = most.groupBy("lang", "h").agg(F.max("most").alias("most"))
            rows = rows.join(most, ["lang", "h"], "left").where(F.col("most").isNull() | (F.col("most") < F.col("a"))).drop("most")
        kept.append(_scored(rows.join(n, "lang"), size))
    every = kept[0]
    for rows in kept[1:]:
        every = every.union(rows)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # Each of 64 parts of a language passes on its own first ones, then the language is ranked.
    part = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(64))).orderBy(*order)
    some = every.withColumn("_at", F.row_number().over(part)).where(F.col("_at") <= top).drop("_at")
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long"))
    return ranked.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
