"""World metadata: level documents, probed heights, borders, order."""

import gzip

import pytest

from voxelspark.sources import metadata, worlds
from workload import metadata_queries, region_writer


def levels(spark, rows):
    return metadata.level_data(spark.createDataFrame([(f"/w{i}/level.dat", b) for i, b in enumerate(rows)], "path string, content binary"))


def test_level_documents(spark):
    data = {"LevelName": "Home", "SpawnX": -5, "BorderSize": 29_000_000}
    plain = region_writer.document({"Data": data})
    got = sorted(levels(spark, [plain, gzip.compress(plain), region_writer.document(data), b"", None, plain[:9], gzip.compress(plain)[:12]]).collect())
    for r in got[:3]:
        assert (r.level_name, r.spawn_x, r.spawn_y, r.spawn_z, r.border, r.error) == ("Home", -5, 64, 0, 0, None)
    assert all(r.error and r.level_name == "" and r.border == 0 for r in got[3:]) and len(got) == 7


def test_other_types_and_defaults(spark):
    (row,) = levels(spark, [region_writer.document({"Data": {"LevelName": 3, "SpawnX": "east", "BorderSize": 28_999_999}})]).collect()
    assert (row.level_name, row.spawn_x, row.border, row.error) == ("", 0, 28_999_999, None)


def test_probe_takes_the_nearest_regions_and_first_chunk(spark):
    regions = spark.createDataFrame([("d", x, z) for x in (-3, 0, 1, 5) for z in (0, 2)], "dimension string, region_x int, region_z int")
    probes = metadata.probe_regions(regions)
    assert sorted((r.probe, r.region_x, r.region_z) for r in probes.collect()) == [(1, 0, 0), (2, 1, 0), (3, 0, 2)]
    # Region (0, 0) has a chunk outside its corner only, so the next region's first chunk counts.
    sections = spark.createDataFrame([("d", 20, 20, 9), ("d", 33, 1, 7), ("d", 34, 0, -2), ("d", 34, 0, 3), ("d", 160, 0, 0)], "dimension string, chunk_x int, chunk_z int, section_y int")
    assert [tuple(r) for r in metadata.height_ranges(sections, probes).collect()] == [("d", -32, 64)]


@pytest.mark.parametrize("overrides, name", [({}, "Home"), ({"minecraft:overworld": "/w0"}, "Overworld")])
def test_described(spark, overrides, name):
    found = spark.createDataFrame([("/w0/region", 1, 10), ("/w0/DIM-1/region", 1, 10), ("/w0/dimensions/a/b/region", 1, 10)], "directory string, regions long, bytes long")
    dims = worlds.discover(found, "/w0", overrides)
    data = levels(spark, [region_writer.document({"Data": {"LevelName": "Home", "SpawnX": 8, "BorderSize": 500}})])
    ranges = spark.createDataFrame([("a:b", -32, 64)], "dimension string, low int, high int")
    borders = spark.createDataFrame([(d, 1024) for d in ("minecraft:overworld", "minecraft:the_nether", "a:b")], "dimension string, border int")
    rows = metadata.described(dims, "/w0/", data, ranges, borders, overrides).orderBy("place", "dimension").collect()
    assert [r.dimension for r in rows] == ["minecraft:overworld", "minecraft:the_nether", "a:b"]
    assert [(r.min_y, r.max_y) for r in rows] == [(-64, 320), (0, 128), (-32, 64)]
    assert [r.border for r in rows] == [500, 1024, 1024] and [r.spawn_x for r in rows] == [8, 0, 0]
    assert rows[0].name == name


def test_a_world_is_encoded_once(spark, sf, monkeypatch):
    made = spark.sparkContext.accumulator(0)
    table = region_writer.region_table

    def counted(*args):
        files = table(*args)

        def run(batches):
            for b in batches:
                made.add(b.num_rows)
                yield b

        return files.mapInArrow(run, files.schema)

    expected = sorted(map(str, metadata_queries.q_described(spark, sf).collect()))
    monkeypatch.setattr(region_writer, "region_table", counted)
    voxels = metadata_queries.fx.voxels(spark, sf)
    overworld = voxels.where("dimension = 'overworld'").selectExpr("'o' AS d", "x >> 9 AS x", "z >> 9 AS z")
    moved = voxels.selectExpr("'v' AS d", "(x + 640) >> 9 AS x", "z >> 9 AS z")
    own = voxels.where("dimension = 'view'").selectExpr("'v' AS d", "x >> 9 AS x", "z >> 9 AS z")
    assert sorted(map(str, metadata_queries.q_described(spark, sf).collect())) == expected
    assert made.value == overworld.union(moved).union(own).distinct().count()
