"""Smooth movement between position updates.

When an update arrives, a marker starts gliding from where it is drawn at that
moment to the new position, easing out over a fixed transition. Where updates are
at least a transition apart, the drawn position is simply the previous target, so a
player's history falls into independent chains; only inside a chain does the drawn
position depend on the one before. Headings are compared and reported modulo 360.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import col, shortest_turn
from ..shared import written

AXES = ("x", "y", "z")


def ease_out(t) -> Column:
    left = 1 - F.greatest(F.lit(0.0), F.least(F.lit(1.0), col(t)))
    return 1 - left * left * left


def _turn(start: float, end: float) -> float:
    d = (end - start + 180.0) % 360.0 - 180.0
    return 180.0 if d == -180.0 else d


def _glide(batches: Iterator[pd.DataFrame], transition: float) -> Iterator[pd.DataFrame]:
    """Fill in drawn positions; rows arrive sorted by chain and time."""
    chain, drawn, target, began = None, None, None, 0.0
    for pdf in batches:
        out = {f"from_{n}": [] for n in (*AXES, "rotation")}
        for row in pdf.itertuples(index=False):
            goal = (row.x, row.y, row.z, row.rotation)
            if (row.player, row.chain) != chain:
                chain = (row.player, row.chain)
                now = (row.prev_x, row.prev_y, row.prev_z, row.prev_rotation)
            else:
                k = min(1.0, max(0.0, (row.at - began) / transition))
                left = 1.0 - k
                k = 1.0 - left * left * left
                now = tuple(a + (b - a) * k for a, b in zip(drawn[:3], target[:3]))
                now += ((drawn[3] + _turn(drawn[3], target[3]) * k) % 360.0,)
            drawn, target, began = now, goal, row.at
            for name, value in zip((*AXES, "rotation"), now):
                out[f"from_{name}"].append(value)
        yield pdf.drop(columns=[f"prev_{n}" for n in (*AXES, "rotation")]).assign(**out)


#: History is cut at multiples of both; a task orders one bucket, one coarse bucket's buckets, or
#: one player's coarse buckets, never one player's updates.
FINE_MS, COARSE_MS = 600_000, 86_400_000
_TARGET = (*AXES, "rotation")


def _buckets(rows: DataFrame) -> DataFrame:
    return rows.withColumns({"_fine": F.floor(F.col("at") / FINE_MS), "_coarse": F.floor(F.col("at") / COARSE_MS)})


def _carried(summary: DataFrame, value: str, forward: bool = True) -> DataFrame:
    """``summary`` (a row per player and bucket) with ``_carry``: the nearest value of a bucket
    before it, or after it, that has one."""
    order = (lambda c: F.asc(c)) if forward else (lambda c: F.desc(c))
    found = lambda w: F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    near = found(Window.partitionBy("player", "_coarse").orderBy(order("_fine")))
    pick = F.max_by if forward else F.min_by
    top = summary.groupBy("player", "_coarse").agg(pick(value, F.when(F.col(value).isNotNull(), F.col("_fine"))).alias(value))
    far = top.select("player", "_coarse", found(Window.partitionBy("player").orderBy(order("_coarse"))).alias("_far"))
    rows = summary.withColumn("_near", near).join(far, ["player", "_coarse"])
    return rows.select("player", "_fine", F.coalesce("_near", "_far").alias("_carry"))


def segments(updates: DataFrame, transition_ms: int = 900, stale_ms: int = 30_000, repeats: bool = False) -> DataFrame:
    """One gliding segment per changed update: drawn start, target and start time.

    ``updates`` has ``player, event_id, ts, x, y, z, rotation``. A player unseen for
    longer than ``stale_ms`` starts afresh at the new position. An update that repeats the
    position before it changes nothing; with ``repeats`` it is a segment of its own.

    The update before is found inside a bucket of time, or carried into it from the last bucket
    that has one, and so is the start of the chain. A chain of one update starts from where the
    player was; only chains whose glides overlap go through Python, one chain in order.
    """
    at = F.unix_micros(F.col("ts").cast("timestamp")) / F.lit(1000.0)
    rows = _buckets(updates.select("player", "event_id", at.alias("at"), *[F.col(a).cast("double") for a in AXES], F.col("rotation").cast("double").alias("rotation")))
    inside = Window.partitionBy("player", "_fine").orderBy("at", "event_id")
    update = F.struct("at", *_TARGET)
    last = rows.groupBy("player", "_coarse", "_fine").agg(F.max_by(update, F.struct("at", "event_id")).alias("_last"))
    rows = rows.withColumn("_before", F.lag(update).over(inside)).join(_carried(last, "_last"), ["player", "_fine"])
    rows = rows.withColumn("_before", F.coalesce("_before", "_carry")).drop("_carry")
    gap = F.col("at") - F.col("_before.at")
    fresh = gap.isNull() | (gap > stale_ms)
    same = F.lit(True)
    for n in _TARGET:
        same = same & F.col(n).eqNullSafe(F.col(f"_before.{n}"))
    starts = F.when(fresh | (gap >= transition_ms), F.col("at"))
    rows = rows.withColumns(
        {"_start": starts, "_moved": F.lit(True) if repeats else fresh | ~same, **{f"prev_{n}": F.when(fresh, F.col(n)).otherwise(F.col(f"_before.{n}")) for n in _TARGET}}
    ).drop("_before")
    # A player's chains are known by the time they start at; no two start at once.
    begun = rows.groupBy("player", "_coarse", "_fine").agg(F.max("_start").alias("_start"))
    so_far = F.last("_start", ignorenulls=True).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("_so_far", so_far).join(_carried(begun, "_start"), ["player", "_fine"])
    rows = rows.withColumn("chain", F.coalesce("_so_far", "_carry"))
    # A repeated position changes nothing and must not restart the glide.
    prev = [f"prev_{n}" for n in _TARGET]
    rows = rows.filter("_moved").select("player", "event_id", "at", *_TARGET, "chain", *prev)
    rows = written(rows.withColumn("_links", F.count("*").over(Window.partitionBy("player", "chain"))), "tracks")
    alone = rows.filter("_links = 1").select("player", "event_id", "at", *_TARGET, "chain", *[F.col(f"prev_{n}").alias(f"from_{n}") for n in _TARGET])
    kind = rows.schema["player"].dataType.simpleString()
    names = [f"{n} double" for n in ("at", *_TARGET)]
    schema = f"player {kind}, event_id bigint, " + ", ".join(names) + ", chain double, " + ", ".join(f"from_{n} double" for n in _TARGET)
    linked = rows.filter("_links > 1").drop("_links").repartition("player", "chain").sortWithinPartitions("player", "chain", "at", "event_id")
    return alone.unionByName(linked.mapInPandas(lambda it: _glide(it, float(transition_ms)), schema))


def sample(track: DataFrame, step_ms: int, transition_ms: int = 900, stale_ms: int = 30_000) -> DataFrame:
    """Drawn position at every multiple of ``step_ms`` while a segment is current."""
    rows = _buckets(track)
    inside = Window.partitionBy("player", "_fine").orderBy("at", "event_id")
    first_at = rows.groupBy("player", "_coarse", "_fine").agg(F.min("at").alias("_first"))
    rows = rows.withColumn("_next", F.lead("at").over(inside)).join(_carried(first_at, "_first", forward=False), ["player", "_fine"])
    until = F.least(F.coalesce("_next", "_carry", F.col("at") + stale_ms), F.col("at") + stale_ms)
    first = F.ceil(F.col("at") / step_ms).cast("long")
    last = F.ceil(F.col("_until") / step_ms).cast("long") - 1
    ticks = F.when(last >= first, F.sequence(first, last))
    rows = rows.withColumn("_until", until).withColumn("tick", F.explode(ticks))
    k = ease_out((F.col("tick") * step_ms - F.col("at")) / float(transition_ms))
    glide = lambda n: F.col(f"from_{n}") + (F.col(n) - F.col(f"from_{n}")) * k
    turn = F.pmod(F.col("from_rotation") + shortest_turn("from_rotation", "rotation") * k, F.lit(360.0))
    return rows.select("player", "tick", *[glide(a).alias(a) for a in AXES], turn.alias("rotation"))
