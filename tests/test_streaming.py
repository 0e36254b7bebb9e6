"""Streams give what the batch operators give, and replays change nothing."""

import pytest
from pyspark.sql import functions as F
from voxelspark.operators import changes
from voxelspark.plans import pyramid
from voxelspark.sources import tiles, versioned
from voxelspark.streaming import jobs, stateful

FILL = (20, 22, 26, 255)


def table(spark, path, rows, schema, mode="append"):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode(mode).parquet(str(path))


def test_stale_and_fresh_marks(spark):
    rows = "('d', 0, 0, TIMESTAMP'2024-01-01 00:00:00'), ('d', 0, 0, TIMESTAMP'2024-01-01 00:00:02'), ('d', 1, 0, TIMESTAMP'2024-01-01 00:00:09')"
    marks = spark.sql(f"SELECT * FROM VALUES {rows} AS t(dimension, chunk_x, chunk_z, ts)")
    done = changes.drain(marks, F.lit("2024-01-01 00:00:10").cast("timestamp"), "3 seconds").collect()
    assert [(r.chunk_x, r.last_mark.second) for r in done] == [(0, 2)]
    assert changes.settled_chunks(marks).count() == 2


def test_affected_tiles_known_cases(spark):
    square = spark.range(64).select(F.lit("d").alias("dimension"), (F.col("id") % 8).cast("int").alias("chunk_x"), F.floor(F.col("id") / 8).cast("int").alias("chunk_z"))
    n = {r.zoom: r["count"] for r in changes.affected_tiles(square, 6, 10, modes=("top",)).groupBy("zoom").count().collect()}
    assert n[6] == 1 and n[10] == 16
    corner = spark.sql("SELECT 'd' AS dimension, -1 AS chunk_x, -1 AS chunk_z")
    t = changes.affected_tiles(corner, 10, 10, modes=("top",)).first()
    assert (t.tile_x, t.tile_y) == (-1, -1)
    zooms = [r.zoom for r in changes.deepest_first(changes.affected_tiles(square, 4, 8)).collect()]
    assert zooms == sorted(zooms, reverse=True)


def test_isometric_tiles_cover_every_projected_column(spark):
    from voxelspark.functions import iso

    chunk = spark.sql("SELECT 'd' AS dimension, 3 AS chunk_x, -5 AS chunk_z")
    hit = changes.affected_tiles(chunk, 8, 8, modes=("iso",), min_y=0, max_y=60)
    cells = spark.range(256).select((F.col("id") % 16 + 48).alias("x"), (F.floor(F.col("id") / 16) - 80).alias("z")).withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(60), F.lit(6))))
    u, v = iso.project_block_top("x", "y", "z")
    tx, ty = iso.tile_at(u, v, F.lit(8))
    assert cells.select(tx.alias("tile_x"), ty.alias("tile_y")).distinct().join(hit, ["tile_x", "tile_y"], "left_anti").count() == 0


def test_slice_levels_kept_by_last_touch(spark):
    def kept(levels):
        rows = [("f", level, n) for n, level in enumerate(levels)]
        df = spark.createDataFrame(rows, "family string, level int, ts int")
        return {r.level for r in changes.slice_retention(df, 2).filter("kept").collect()}

    assert kept([60, 80, 100]) == {80, 100}
    assert kept([60, 80, 60, 100]) == {60, 100}


def test_settled_stream_equals_batch(spark, sf, tmp_path):
    from workload.change_queries import q_stream, settled

    streamed = q_stream(spark, sf)
    last = spark.read.parquet(f"{sf}/events.parquet").agg((F.max("ts") - F.expr("INTERVAL 1 DAY")).alias("m"))
    batch = settled(spark, sf).crossJoin(last).filter("settled_at <= m").drop("m").withColumn("settled_at", F.col("settled_at").cast("timestamp_ntz"))
    assert streamed.exceptAll(batch).count() == 0 and batch.exceptAll(streamed).count() == 0


def test_world_watch_reports_only_later_stamps(spark, tmp_path):
    schema = "dimension string, region_x int, region_z int, slot int, stamp bigint"
    src, out, ck = [str(tmp_path / n) for n in ("src", "out", "ck")]
    table(spark, src, [("d", 0, 0, 1, 10), ("d", 0, 0, 2, 10)], schema)

    def run():
        stateful.watch_world(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
        return {(r.chunk_x, r.chunk_z, r.stamp) for r in spark.read.schema("dimension string, chunk_x int, chunk_z int, stamp bigint, epoch bigint").parquet(out).collect()}

    assert run() == set()  # a first sighting is the baseline
    table(spark, src, [("d", 0, 0, 1, 11), ("d", 0, 0, 2, 10), ("d", 0, 0, 35, 5), ("d", 4, 0, 0, 9)], schema)
    assert run() == {(1, 0, 11), (3, 1, 5)}


def test_ingest_rejects_whole_batches(spark, tmp_path):
    schema = "batch_id bigint, id string, dimension string"
    src, good, bad, ck = [str(tmp_path / n) for n in ("src", "good", "bad", "ck")]
    table(spark, src, [(1, "a", "d"), (1, "b", "d"), (2, "c", "d"), (2, "", "d"), (3, "e", "nowhere")], schema)
    dims = spark.sql("SELECT 'd' AS dimension")
    jobs.ingest(spark.readStream.schema(schema).parquet(src), dims, good, bad, ck).awaitTermination()
    assert {r.batch_id for r in spark.read.parquet(good).collect()} == {1}
    assert {r.batch_id for r in spark.read.parquet(bad).collect()} == {2, 3}


def test_incremental_pyramid_equals_full_rebuild(spark, tmp_path):
    cols = spark.range(0, 4096).select((F.col("id") % 64 * 16 - 512).cast("int").alias("x"), (F.floor(F.col("id") / 64) * 16 - 512).cast("int").alias("z"))

    def pixels(bright):
        c = cols.select(F.lit("d").alias("dimension"), "x", "z", F.pmod(F.col("x") + bright, F.lit(256)).cast("int").alias("r"), F.lit(7).alias("g"), F.lit(9).alias("b"), F.lit(255).alias("a"))
        return pyramid.base_pixels(c)

    def base_of(bright):
        def of(dirty):
            p = pixels(bright).withColumns({"tile_x": F.shiftright("gx", 9), "tile_y": F.shiftright("gy", 9)})
            return p.join(dirty, ["dimension", "zoom", "tile_x", "tile_y"], "left_semi").drop("tile_x", "tile_y")

        return of

    schema = "dimension string, chunk_x int, chunk_z int"
    src, out, ck = [str(tmp_path / n) for n in ("src", "out", "ck")]
    stream = lambda: spark.readStream.schema(schema).parquet(src)
    table(spark, src, [("d", x, z) for x in (-1, 0) for z in (-1, 0)], schema)
    jobs.rebuild_tiles(stream(), base_of(0), out, ck, 4, fill=FILL).awaitTermination()
    shape = ["dimension", "zoom", "gx", "gy", *pyramid.CHANNELS]
    full = pyramid.build_pyramid(pixels(0), FILL, 2).select(shape)
    got = spark.read.parquet(out).select(shape)
    assert got.exceptAll(full).count() == 0 and full.exceptAll(got).count() == 0
    # One chunk changes: its tile and that tile's ancestors follow, the rest stays.
    table(spark, src, [("d", 3, 3)], schema)
    jobs.rebuild_tiles(stream(), base_of(50), out, ck, 4, fill=FILL).awaitTermination()
    now = spark.read.parquet(out)
    mixed = pixels(0).filter("gx < 0 or gy < 0").unionByName(pixels(50).filter("gx >= 0 and gy >= 0"))
    want = pyramid.build_pyramid(mixed, FILL, 2).select(shape)
    assert now.select(shape).exceptAll(want).count() == 0 and want.exceptAll(now.select(shape)).count() == 0


def test_tile_store_replaces_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = lambda tx, r: pyramid.with_tiles(spark.sql(f"SELECT 'a:b' AS dimension, 6 AS zoom, {tx} * 512 AS gx, 0 AS gy, {r} AS r, 1 AS g, 2 AS b, 255 AS a"))
    for tx, r in ((0, 5), (-1, 6), (0, 7)):
        tiles.write_tiles(tiles.pack_tiles(rows(tx, r), FILL), path)
    got = {(r.tile_x, r.x_shard, r.variant, bytes(r.rgba[:4])) for r in spark.read.parquet(path).collect()}
    assert got == {(0, 0, "default", bytes([7, 1, 2, 255])), (-1, -1, "default", bytes([6, 1, 2, 255]))}


def test_latest_snapshot_replaces_players(spark, tmp_path):
    schema = "batch_id bigint, player bigint"
    src, out, ck = [str(tmp_path / n) for n in ("src", "out", "ck")]
    for rows in ([(1, 10), (1, 11)], [(2, 11), (2, 12)]):
        table(spark, src, rows, schema)
        versioned.stream_snapshots(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
    kept = versioned.VersionedTable(spark, out, "player")
    assert {r.player for r in kept.read().collect()} == {11, 12} and {r.player for r in kept.read(0).collect()} == {10, 11}


@pytest.mark.parametrize("edge", [1, 2, 5])
def test_parent_level_is_a_reaggregation(spark, edge):
    """Each level equals the rounded mean of its four children, fill included."""
    p = spark.range(edge * edge).select(
        F.lit("d").alias("dimension"), F.lit(6).alias("zoom"), (F.col("id") % edge - 2).cast("int").alias("gx"), (F.floor(F.col("id") / edge) - 1).cast("int").alias("gy"),
        *[(F.col("id") * m % 256).cast("int").alias(c) for m, c in zip((40, 77, 13), "rgb")], F.lit(255).alias("a"),
    )
    src = {(r.gx, r.gy): (r.r, r.g, r.b) for r in p.collect()}
    for r in pyramid.composite(p, FILL).collect():
        kids = [src.get((r.gx * 2 + dx, r.gy * 2 + dy), FILL[:3]) for dx in (0, 1) for dy in (0, 1)]
        assert (r.r, r.g, r.b) == tuple((sum(k[i] for k in kids) + 2) // 4 for i in range(3))
