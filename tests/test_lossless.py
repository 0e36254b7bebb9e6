"""Nothing is lost: tiles of a shard, voxels without a known id, batches that arrive in parts."""

import pytest
from pyspark.sql import functions as F
from voxelspark.functions import iso
from voxelspark.operators import changes, overlay, surface
from voxelspark.plans import isometric, pyramid
from voxelspark.sources import overlays, regions, tiles, versioned, worlds
from voxelspark.streaming import jobs, stateful
from workload import views as fx

FILL = (20, 22, 26, 255)


def test_tiles_of_one_shard_stay(spark, tmp_path):
    path = str(tmp_path / "tiles")
    rows = lambda xs, r: pyramid.with_tiles(
        spark.createDataFrame([("a:b", 6, x * 512, 0, r, 1, 2, 255) for x in xs], "dimension string, zoom int, gx int, gy int, r int, g int, b int, a int")
    )
    tiles.write_tiles(tiles.pack_tiles(rows([0, 1], 5), FILL), path)
    tiles.write_tiles(tiles.pack_tiles(rows([1, 2], 7), FILL), path)
    got = {r.tile_x: r.rgba[0] for r in spark.read.parquet(path).collect()}
    assert got == {0: 5, 1: 7, 2: 7}
    assert [p.name for p in tmp_path.iterdir()] == ["tiles"]  # nothing staged is left


def test_vanished_tile_and_its_ancestors(spark, tmp_path):
    schema = "dimension string, chunk_x int, chunk_z int"
    src, out, ck = [str(tmp_path / n) for n in ("src", "out", "ck")]
    shape = "dimension string, zoom int, gx int, gy int, r int, g int, b int, a int"

    def base_of(xs):
        p = spark.createDataFrame([("d", 6, x, 0, 9, 9, 9, 255) for x in xs], shape)
        keys = ["dimension", "zoom", "tile_x", "tile_y"]
        return lambda dirty: p.withColumns({"tile_x": F.shiftright("gx", 9), "tile_y": F.shiftright("gy", 9)}).join(dirty, keys, "left_semi").drop("tile_x", "tile_y")

    for marks, xs in (([(0, 0), (40, 0)], [0, 640]), ([(40, 0)], [0])):
        spark.createDataFrame([("d", *m) for m in marks], schema).coalesce(1).write.mode("append").parquet(src)
        jobs.rebuild_tiles(spark.readStream.schema(schema).parquet(src), base_of(xs), out, ck, 5, fill=FILL).awaitTermination()
    got = {(r.zoom, r.gx, r.gy) for r in jobs.read_levels(spark, out).collect()}
    assert got == {(6, 0, 0), (5, 0, 0)}


def test_surface_scan_rejects_what_it_cannot_hold(spark):
    v = fx.voxels(spark, "/root/testdata/sf0.001")
    for change in ({"block_id": F.lit(70_000)}, {"y": F.lit(5000)}):
        scan = surface.surface_scan(v.withColumns(change), fx.palette(spark), fx.sections(spark, "/root/testdata/sf0.001"))
        with pytest.raises(Exception, match="outside 0"):
            scan.collect()


def test_split_batch_is_rejected_as_a_whole(spark, tmp_path):
    schema = "batch_id bigint, id string, dimension string"
    src, good, bad, ck = [str(tmp_path / n) for n in ("src", "good", "bad", "ck")]
    dims = spark.sql("SELECT 'd' AS dimension")
    for rows in ([(1, "a", "d"), (2, "b", "d")], [(1, "", "d"), (3, "c", "d")], [(1, "e", "d")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        jobs.ingest(spark.readStream.schema(schema).parquet(src), dims, good, bad, ck).awaitTermination()
    assert {(r.batch_id, r.id) for r in spark.read.parquet(good).collect()} == {(2, "b"), (3, "c")}
    assert {(r.batch_id, r.id) for r in spark.read.parquet(bad).collect()} == {(1, "a"), (1, ""), (1, "e")}


def test_removals_count_and_dimensions_are_resolved(spark):
    rows = [(1, "a", "", "upsert"), (1, "b", None, "delete"), (2, "c", "The:World", "upsert"), (3, "d", "elsewhere", "upsert"), (4, "e", "the_world", "upsert"), (4, "f", None, "delete")]
    items = spark.createDataFrame(rows, "batch_id bigint, id string, dimension string, op string")
    dims = spark.sql("SELECT 'the:world' AS dimension")
    got = {r.batch_id: (r["items"], r.accepted) for r in overlays.batch_verdicts(items, dims, most=2, default="the:world").collect()}
    assert got == {1: (2, True), 2: (1, True), 3: (1, False), 4: (2, True)}
    assert not {r.batch_id: r.accepted for r in overlays.batch_verdicts(items, dims, most=1, default="the:world").collect()}[1]


def test_removal_touches_the_dimension_of_its_time(spark):
    current = spark.createDataFrame([("a", "old")], "id string, dimension string")
    ops = [(1, 1, "a", "new", "upsert"), (2, 1, "a", None, "delete"), (3, 1, "a", None, "delete"), (4, 1, "b", "x", "upsert"), (4, 2, "b", None, "delete")]
    batches = spark.createDataFrame(ops, "batch_id bigint, seq bigint, id string, dimension string, op string")
    got = {(r.batch_id, r.dimension) for r in changes.touched_dimensions(current, batches).collect()}
    assert got == {(1, "new"), (2, "new"), (4, "x")}


def test_empty_snapshot_clears_the_table(spark, tmp_path):
    schema = "batch_id bigint, player bigint"
    src, out, ck = [str(tmp_path / n) for n in ("src", "out", "ck")]
    for rows in ([(1, 10)], [(2, None)]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        versioned.stream_snapshots(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
    assert versioned.VersionedTable(spark, out, "player").read().count() == 0
    assert [r.player for r in versioned.VersionedTable(spark, out, "player").read(0).collect()] == [10]


def test_numbers_follow_the_order(spark):
    rows = [("g", z, x, y) for z in (1, 2) for x in (5, -3, 0) for y in (2, -9)]
    df = spark.createDataFrame(rows, "g string, zoom int, tile_x int, tile_y int").repartition(5)
    got = changes.number_in_order(df, "g", ["zoom", "tile_x", "tile_y"], 100).collect()
    assert [tuple(r[:4]) for r in sorted(got, key=lambda r: r.revision)] == sorted(rows)
    assert sorted(r.revision for r in got) == list(range(101, 113))


def test_short_region_file_is_an_error_row(spark):
    rows = [("d", 2, -1, "r.2.-1.mca", bytearray(100), 100), ("d", 0, 0, "r.0.0.mca", bytearray(0), 0)]
    files = spark.createDataFrame(rows, "dimension string, region_x int, region_z int, path string, content binary, size long")
    got = regions.error_rows(regions.decode_chunks(regions.chunk_payloads(files))).collect()
    assert [tuple(r) for r in got] == [("d", 64, -32, "file too short for a header")]


def test_blank_search_finds_nothing(spark):
    markers = spark.createDataFrame([("1", "Home", "warp", 0, 0, "d")], "id string, name string, kind string, x int, z int, dimension string")
    assert overlay.search("  ", markers=markers).count() == 0
    assert overlay.search("home", markers=markers, limit=0).count() == 1


def test_world_paths_are_no_patterns(spark):
    root = "/srv/my (world)+"
    rows = [(f"{root}/region", 1, 5), (f"{root}/dimensions/mod/deep/region", 1, 5), (f"{root}_nether/DIM-1/region", 1, 5), ("/x/end", 1, 5)]
    dirs = spark.createDataFrame(rows, "directory string, regions int, bytes int")
    got = {r.dimension: (r["name"], r.min_y, r.max_y, r.has_ceiling) for r in worlds.discover(dirs, root, {worlds.THE_END: "/x/end"}, "Home").collect()}
    assert got == {
        worlds.OVERWORLD: ("Home", -64, 320, False), "mod:deep": ("Deep", -64, 320, False), worlds.NETHER: ("Nether", 0, 128, True),
        worlds.THE_END: ("The End", -64, 320, False),
    }


def test_columns_without_slab_are_drawn(spark):
    sf = "/root/testdata/sf0.001"
    from workload.surface_queries import columns, slabs

    cols, own = columns(spark, sf).filter("x between 0 and 20 and z between 0 and 20"), slabs(spark, sf).filter("x between 0 and 20 and z between 0 and 20")
    tables = fx.palette(spark), fx.biomes(spark), fx.dimensions(spark)
    none = isometric.voxel_view(own.limit(0), cols, *tables)
    flat = isometric.height_field_view(cols, *tables)
    assert none.exceptAll(flat).count() == 0 and flat.exceptAll(none).count() == 0
    half = isometric.voxel_view(own.filter("x < 10"), cols, *tables)
    assert half.count() > isometric.voxel_view(own.filter("x < 10"), cols.filter("x < 10"), *tables).count()
    assert iso.DEFAULT_CAMERA


def test_world_watch_with_file_times_and_empty_regions(spark, tmp_path):
    schema = "dimension string, region_x int, region_z int, slot int, stamp bigint, mtime bigint"
    src, out, ck = [str(tmp_path / n) for n in ("src", "out", "ck")]
    seen = []
    for rows in (
        [("d", 0, 0, 1, 10, 100), ("d", 1, 0, None, None, 100)],  # the baseline, one region without chunks
        [("d", 0, 0, 1, 11, 100), ("d", 1, 0, 0, 5, 101)],  # an old file is skipped; a first chunk counts
        [("d", 0, 0, 1, 12, 102)],
    ):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        stateful.watch_world(spark.readStream.schema(schema).parquet(src), out, ck).awaitTermination()
        got = spark.read.schema("dimension string, chunk_x int, chunk_z int, stamp bigint, epoch bigint").parquet(out)
        seen.append({(r.chunk_x, r.chunk_z, r.stamp) for r in got.collect()})
    assert seen == [set(), {(32, 0, 5)}, {(32, 0, 5), (1, 0, 12)}]
