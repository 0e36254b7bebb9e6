"""Keyed state: results do not depend on where epochs end or in what order updates come."""

import random

import pytest
from pyspark.sql import functions as F

from voxelspark.streaming import stateful


def run(spark, tmp_path, name, files, schema, job, out_schema, **options):
    src, out, ck = [str(tmp_path / f"{name}-{n}") for n in ("src", "out", "ck")]
    for rows in files:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    stateful.to_table(job(stream), out, ck, **options).awaitTermination()
    return sorted(tuple(r) for r in spark.read.schema(out_schema).parquet(out).collect())


def spans(times, stale, watermark):
    out, start, last = [], None, None
    for t in sorted(times):
        if last is None or t - last > stale:
            out.append([t, t])
        out[-1][1] = last = t
    return [(a, b) for a, b in out if b + stale <= watermark]


def test_stays_whatever_the_epochs(spark, tmp_path):
    rng = random.Random(3)
    seconds = {p: [rng.randrange(0, 2000) for _ in range(30)] for p in "ab"} | {"end": [5000]}
    rows = [(p, t) for p, ts in seconds.items() for t in ts if p != "end"]
    rows.sort(key=lambda r: r[1])
    schema = "player string, at long"
    job = lambda s: stateful.expired_entities(s.select("player", F.timestamp_seconds("at").alias("ts")), "player", 50_000, "600 seconds").select(
        "player", F.unix_seconds("first_seen").alias("f"), F.unix_seconds("last_seen").alias("l")
    )
    shuffled = [rows[i : i + 15] for i in range(0, 60, 15)]
    for part in shuffled:
        rng.shuffle(part)
    want = sorted((p, a, b) for p, ts in seconds.items() for a, b in spans(ts, 50, 5000 - 600))
    assert want
    for name, files in (("one", [rows + [("end", 5000)]]), ("many", [*shuffled, [("end", 5000)]])):
        assert run(spark, tmp_path, name, files, schema, job, "player string, f long, l long") == want


def test_polls_of_one_epoch_in_file_time(spark, tmp_path):
    schema = "dimension string, region_x int, region_z int, slot int, stamp long, mtime long"
    files = [
        [("d", 0, 0, 1, 10, 1), ("d", 0, 0, 2, 10, 1), ("d", 0, 0, 1, 20, 3), ("d", 0, 0, 1, 15, 2), ("d", 0, 0, 5, 1, 2), ("d", 1, -1, None, None, 1)],
        [("d", 0, 0, 5, 1, 4), ("d", 1, -1, 33, 7, 2), ("d", 2, 0, 1, 1, 1)],
        [("d", 0, 0, 1, 99, 4)],
    ]
    got = run(spark, tmp_path, "polls", files, schema, stateful.changed_chunks, "dimension string, chunk_x int, chunk_z int, stamp long")
    # slot 1: 15, then 20; slot 5 comes at time 2, is gone at 3 and comes again at 4
    assert got == sorted([("d", 1, 0, 15), ("d", 1, 0, 20), ("d", 5, 0, 1), ("d", 5, 0, 1), ("d", 33, -31, 7)])


def test_the_session_keeps_its_store(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with pytest.raises(RuntimeError), stateful.keyed_state(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
        raise RuntimeError
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before
