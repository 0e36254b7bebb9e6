"""Stateful streams over the given tables, epoch by epoch (ids T3, T10)."""

from __future__ import annotations


from pyspark.sql import functions as F

from voxelspark.shared import new_path
from voxelspark.streaming import stateful

from . import views as fx
from .views import define, oracle

POLLS = ("1995-06-01", "1997-01-01", "1998-12-31")
STALE_HOURS, LATE_HOURS = 6, 24


def polled(spark, sf, folder: str):
    """Three polls of region headers, one file each: of every poll some regions are left out, and
    some files keep their time although chunks changed."""
    for n, date in enumerate(POLLS):
        rx = F.col("region_x")
        time = F.when((rx % 7 == 3) & (n == 1), 0).otherwise(n).cast("long")
        poll = fx.slots(spark, sf, date).filter(rx % 5 != n).withColumn("mtime", time)
        poll.coalesce(1).write.mode("append").parquet(folder)
    return poll.schema


def q_watch(spark, sf):
    out = new_path(spark, "watch")
    schema = polled(spark, sf, f"{out}/polls")
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/polls")
    stateful.watch_world(stream, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema("dimension string, chunk_x int, chunk_z int, stamp bigint").parquet(f"{out}/rows")


def q_expiry(spark, sf):
    """Stays of players in the event stream, read in daily files so that state outlives epochs."""
    out = new_path(spark, "expiry")
    rows = fx.positions(spark, sf).select("player", F.col("ts").cast("timestamp").alias("ts"))
    for day in range(0, 30, 10):
        part = rows.filter((F.dayofmonth("ts") > day) & ((F.dayofmonth("ts") <= day + 10) | F.lit(day == 20)))
        part.coalesce(1).write.mode("append").parquet(f"{out}/updates")
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{out}/updates")
    spans = stateful.expired_entities(stream, "player", STALE_HOURS * 3_600_000, f"{LATE_HOURS} hours")
    stateful.to_table(spans, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    done = spark.read.schema("player bigint, first_seen timestamp, last_seen timestamp").parquet(f"{out}/rows")
    return done.select("player", *[F.col(c).cast("timestamp_ntz").alias(c) for c in ("first_seen", "last_seen")])


for _n, _date in enumerate(POLLS):
    define(
        f"o_poll{_n}",
        (),
        f"SELECT '{fx.DIM}' AS dimension,CAST(floor(o_custkey/64.0) AS INTEGER) AS region_x,0 AS region_z,CAST(o_custkey%64 AS INTEGER) AS slot,CAST(epoch(max(o_orderdate)) AS BIGINT) AS stamp "
        f"FROM orders WHERE o_orderdate<TIMESTAMP '{_date}' AND CAST(floor(o_custkey/64.0) AS INTEGER)%5<>{_n} GROUP BY 1,2,3,4",
    )

QUERIES = {"t3_world_watch": q_watch, "t10_expiry_stream": q_expiry}

ORACLE = {
    # A poll counts unless its file time is that of a poll before; it is compared with the last that counted.
    "t3_world_watch": oracle(
        "o_poll0 o_poll1 o_poll2",
        ", a AS (SELECT 0 AS n,* FROM o_poll0 UNION ALL SELECT 1,* FROM o_poll1 WHERE region_x%7<>3 OR region_x NOT IN (SELECT region_x FROM o_poll0) UNION ALL SELECT 2,* FROM o_poll2), "
        "k AS (SELECT n,region_x,lag(n) OVER (PARTITION BY region_x ORDER BY n) AS before FROM (SELECT DISTINCT n,region_x FROM a)) "
        "SELECT a.dimension,CAST(a.region_x*32+a.slot%32 AS INTEGER) AS chunk_x,CAST(floor(a.slot/32.0) AS INTEGER) AS chunk_z,a.stamp FROM a JOIN k ON k.n=a.n AND k.region_x=a.region_x AND k.before IS NOT NULL "
        "LEFT JOIN a p ON p.n=k.before AND p.region_x=a.region_x AND p.slot=a.slot WHERE p.stamp IS NULL OR a.stamp>p.stamp",
    ),
    "t10_expiry_stream": oracle(
        "fx_positions",
        f", g AS (SELECT player,ts,coalesce(ts-lag(ts) OVER (PARTITION BY player ORDER BY ts)>INTERVAL {STALE_HOURS} HOUR,true) AS fresh FROM fx_positions), "
        "s AS (SELECT player,ts,count(*) FILTER (fresh) OVER (PARTITION BY player ORDER BY ts) AS n FROM g), "
        "w AS (SELECT player,min(ts) AS first_seen,max(ts) AS last_seen FROM s GROUP BY player,n) "
        f"SELECT * FROM w WHERE epoch_ms(last_seen)+{STALE_HOURS * 3_600_000}<=(SELECT max(epoch_ms(ts)) FROM fx_positions)-{LATE_HOURS * 3_600_000}",
    ),
}
