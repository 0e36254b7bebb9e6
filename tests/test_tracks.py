"""Tracks of a hot player, across buckets, against a walk through each history."""

import random

from pyspark.sql import functions as F

from voxelspark.operators import tracks


def walk(updates, transition, stale):
    """event_id -> drawn start, by one pass in order."""
    out, drawn, target, began = {}, None, None, None
    last_at = None
    for at, event, goal in sorted(updates):
        fresh = last_at is None or at - last_at > stale
        last_at = at
        if not fresh and goal == target:
            continue
        if fresh:
            now = goal
        else:
            k = min(1.0, max(0.0, (at - began) / transition))
            k = 1 - (1 - k) ** 3
            now = tuple(a + (b - a) * k for a, b in zip(drawn[:3], target[:3]))
            now += ((drawn[3] + tracks._turn(drawn[3], target[3]) * k) % 360.0 if k < 1 else target[3],)
        drawn, target, began = now, goal, at
        out[event] = now
    return out


def test_segments_and_samples_of_a_hot_player(spark, monkeypatch):
    monkeypatch.setattr(tracks, "FINE_MS", 5_000)
    monkeypatch.setattr(tracks, "COARSE_MS", 60_000)
    rng = random.Random(8)
    rows, event = [], 0
    for player, n in ((1, 1500), (2, 300), (3, 1)):
        at, goal = 0, None
        for _ in range(n):
            at += rng.choice([0, 150, 400, 900, 1000, 4_000, 31_000, 200_000] if rng.random() < 0.3 else [300, 500])
            goal = goal if goal and rng.random() < 0.2 else (float(rng.randrange(50)), 64.0, float(rng.randrange(50)), float(rng.randrange(360)))
            event += 1
            rows.append((player, event, at, *goal))
    df = spark.createDataFrame(rows, "player long, event_id long, ms long, x double, y double, z double, rotation double")
    df = df.withColumn("ts", F.timestamp_millis("ms")).drop("ms").repartition(6)
    got = tracks.segments(df)
    want = {}
    for player in (1, 2, 3):
        want |= walk([(float(at), e, goal) for p, e, at, *g in rows if p == player for goal in [tuple(g)]], 900, 30_000)
    found = {r["event_id"]: (r["from_x"], r["from_y"], r["from_z"], r["from_rotation"]) for r in got.collect()}
    assert set(found) == set(want)
    for e, drawn in want.items():
        assert all(abs((a - b + 180) % 360 - 180) < 1e-6 for a, b in zip(found[e], drawn)), e
    # Samples end where the next segment begins, in whatever bucket that is.
    ticks = {(r["player"], r["tick"]) for r in tracks.sample(got, 250).collect()}
    expected = set()
    for player in (1, 2, 3):
        starts = sorted(at for p, e, at, *_ in rows if p == player and e in want)
        for a, b in zip(starts, [*starts[1:], None]):
            end = min(a + 30_000, b if b is not None else a + 30_000)
            expected |= {(player, t) for t in range(-(-a // 250), -(-end // 250))}
    assert ticks == expected
