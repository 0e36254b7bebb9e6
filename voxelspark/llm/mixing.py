"""Mixing sources to target weights by hash thresholds, without sorting documents.

Every document has a 60-bit key, the beginning of the MD5 of its id and text. Words are summed
by source and by the first 12 bits of the key; in each source's histogram the budget falls into
one bucket, and only the documents of that boundary bucket are summed again by the next 12 bits,
until the boundary is a single key. A document is then taken by comparing its key with the
threshold of its source. Thresholds are nested: a source that is to give 1.3 times its words
gives every document once and those below the threshold for 0.3 a second time.

Shuffled are histograms (at most 4,096 sums a source and task), never documents; the documents
are read twice, for the sizes (written as one narrow table) and for nothing else.

Targets are exact: whole numbers until one last division. The document at the threshold is taken
where that brings the source nearer to its target, so a source misses its target by at most half
of one document (of all rows that share the key: rows equal in id and text).

Nulls: a null text has size 0; null sources are one source, the last; a null id counts as the
empty text in the key. Documents of size 0 are taken 0 words. An empty table gives no row.
"""

from __future__ import annotations

from fractions import Fraction

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.llm.common import written
from voxelspark.operators.numbering import numbered

WEIGHTS = (5, 2, 1)
BITS = 12
LEVELS = 5  # 60 bits
WORD = r"[^\x20\x09-\x0D]+"
#: Sources up to here are broadcast: at most about 200 bytes each beside their name.
SMALL = 50_000


def sizes(docs: DataFrame) -> DataFrame:
    """doc_id, source, size (words) and key of every document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    named = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    key = F.conv(F.substring(F.md5(named.cast("binary")), 1, BITS * LEVELS // 4), 16, 10).cast("long")
    return docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col("source").cast("string").alias("source"),
        F.regexp_count(text, F.lit(WORD)).cast("long").alias("size"),
        key.alias("key"),
    )


def targets(sources: DataFrame, budget: Fraction = Fraction(3, 2), repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """``sources`` (source, source_size) with the words each is to give.

    Shares of ``budget`` times all words by weight, the weights repeating in the order of the
    sources' names; none above ``repeats`` times its words, the excess going to the others.
    A round of the loop is one aggregate; the driver sees sums only.
    """
    if budget > repeats:
        raise ValueError("the budget exceeds what all sources may give")
    order = [F.col("source").isNull(), F.col("source")]
    rows = numbered(sources, order, "place")
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("place") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight)
    up, down = budget.numerator, budget.denominator
    limits, last = None, None
    while True:
        capped = _within(limits)
        got = rows.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(capped, F.col("source_size"))).alias("capped"),
            F.sum(F.when(~capped, F.col("weight"))).alias("weight"),
        ).first()
        left, shared = up * (got["all"] or 0) - down * repeats * (got["capped"] or 0), down * (got["weight"] or 0)
        if not shared or (left, shared) == last:
            break
        last = (left, shared)
        limits = {w: w * left // (shared * repeats) for w in set(weights)}
    target = F.col("source_size") * F.lit(float(repeats))
    if last:
        share = F.element_at(F.create_map(*[x for w in sorted(set(weights)) for x in (F.lit(w), F.lit(float(w * last[0]) / float(last[1])))]), F.col("weight"))
        target = F.when(_within(limits), target).otherwise(share)
    return rows.withColumn("target", target)


def _within(limits: dict[int, int] | None) -> Column:
    """Whether a source's share would be more than it may give, by the last level found."""
    found = F.lit(False)
    for w, most in (limits or {}).items():
        found = F.when(F.col("weight") == w, F.col("source_size") <= most).otherwise(found)
    return found


def thresholds(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    """``sources`` with ``whole`` (copies of every document), ``edge`` (the key up to which one
    more copy is taken) and ``ends`` (whether the key itself is)."""
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    sources = sources.withColumn("whole", whole.cast("long"))
    sources = sources.withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    state = sources.where("rest > 0").select("place", "rest", F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("prefix"))
    rows = rows.where("size > 0")
    for level in range(LEVELS):
        shift = BITS * (LEVELS - 1 - level)
        inside = _joined(rows, state.select("place", "prefix"), few).where(F.shiftright("key", shift + BITS) == F.col("prefix")).drop("prefix")
        if level == 1:
            inside = written(inside)  # the boundary buckets, about one row in 4,096
        rows = inside
        hist = rows.groupBy("place", F.shiftright("key", shift).alias("prefix")).agg(F.sum("size").alias("words"))
        hist = hist.join(state.select("place", "rest", F.col("before").alias("start")), "place")
        by_key = Window.partitionBy("place").orderBy("prefix").rowsBetween(Window.unboundedPreceding, 0)
        hist = hist.withColumn("through", F.col("start") + F.sum("words").over(by_key)).withColumn("before", F.col("through") - F.col("words"))
        state = written(hist.where("before <= rest and rest < through").select("place", "rest", "before", "prefix", "words"))
    ends = (F.col("rest") - F.col("before")) * 2 >= F.col("words")
    edges = state.select("place", F.col("prefix").alias("edge"), ends.alias("ends"))
    return sources.join(edges, "place", "left")


def _joined(rows: DataFrame, sources: DataFrame, few: bool) -> DataFrame:
    return rows.join(F.broadcast(sources) if few else sources, "place")


def mix(docs: DataFrame, budget: Fraction = Fraction(3, 2), repeats: int = 2, weights: tuple[int, ...] = WEIGHTS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target and taken (0 or more times
    its size, ``repeats`` times at most)."""
    rows = written(sizes(docs))
    sources = rows.groupBy("source").agg(F.sum("size").alias("source_size"))
    sources = written(targets(sources, budget, repeats, weights))
    few = sources.count() <= SMALL
    named = sources.select(F.col("source").alias("name"), "place")
    rows = rows.join(F.broadcast(named) if few else named, F.col("source").eqNullSafe(F.col("name"))).drop("name")
    found = thresholds(rows, sources.drop("source"), few).select("place", "source_size", "target", "whole", "edge", "ends")
    out = _joined(rows, found, few)
    more = (F.col("key") < F.col("edge")) | ((F.col("key") == F.col("edge")) & F.col("ends"))
    taken = F.col("size") * (F.col("whole") + F.coalesce(more, F.lit(False)).cast("long"))
    return out.select("doc_id", "source", "size", "source_size", "target", taken.alias("taken"))
