"""The region data source: planning, pruning, reading by range, and faulty files."""

import os

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThanOrEqual, In, LessThan

from voxelspark.sources import region_source
from workload import region_writer


def voxels(cx, cz):
    return pd.DataFrame({"x": [cx * 16 + 1, cx * 16 + 2], "y": [3, 20], "z": [cz * 16, cz * 16 + 5], "name": ["minecraft:stone", "minecraft:dirt"]})


@pytest.fixture(scope="module")
def world(tmp_path_factory):
    root = tmp_path_factory.mktemp("world")
    for folder, regions in (("region", [(0, 0), (-1, 2)]), ("DIM-1/region", [(0, 0)])):
        os.makedirs(root / folder)
        for rx, rz in regions:
            spots = [(rx * 32 + i, rz * 32 + j) for i in (0, 7) for j in (0, 9, 31)]
            docs = {s: region_writer.lit_document(voxels(*s)) for s in spots}
            (root / folder / f"r.{rx}.{rz}.mca").write_bytes(region_writer.region_file(docs))
    # One chunk in a file of its own, one whose file is missing.
    far = {(64, 0): b"", (65, 0): b"", (66, 0): region_writer.lit_document(voxels(66, 0))}
    (root / "region/r.2.0.mca").write_bytes(region_writer.region_file(far, {(64, 0): 0x82, (65, 0): 0x82}))
    import zlib

    (root / "region/c.64.0.mcc").write_bytes(zlib.compress(region_writer.lit_document(voxels(64, 0))))
    (root / "region/r.3.0.mca").write_bytes(b"")
    return str(root)


def reader(world, content="chunks", **options):
    return region_source.RegionReader({"path": world, **{k: str(v) for k, v in options.items()}}, content)


def test_folders_become_dimensions(spark, world):
    rows = region_source.read_world(spark, world, "files").collect()
    assert {(r["dimension"], r["region_x"], r["region_z"]) for r in rows} == {("region", 0, 0), ("region", -1, 2), ("region", 2, 0), ("region", 3, 0), ("DIM-1/region", 0, 0)}
    assert {r["size"] == 0 for r in rows if r["region_x"] == 3} == {True}
    assert region_source.read_world(spark, world + "/nowhere", "files").count() == 0
    assert region_source.read_world(spark, world + "/nowhere").count() == 0


def test_filters_prune_before_files_are_opened(world):
    r = reader(world, split=4096)
    every = len(r.partitions())
    assert list(r.pushFilters([EqualTo(("dimension",), "region"), In(("region_x",), (0, 1)), GreaterThanOrEqual(("chunk_z",), 8), LessThan(("chunk_z",), 10)]))
    parts = r.partitions()
    assert 0 < len(parts) < every
    assert {p.path.endswith("/region/r.0.0.mca") and "DIM" not in p.path for p in parts} == {True}
    assert all(p.first // 32 < 10 and p.last // 32 > 8 for p in parts)
    nothing = reader(world)
    list(nothing.pushFilters([EqualTo(("region_x",), 77)]))
    assert nothing.partitions() == [region_source.FileList([])]


def test_split_files_give_the_same_rows(spark, world):
    one = region_source.read_world(spark, world)
    many = region_source.read_world(spark, world, split=2048)
    assert many.rdd.getNumPartitions() > one.rdd.getNumPartitions()
    assert sorted(map(str, one.collect())) == sorted(map(str, many.collect()))


def test_external_chunks_and_pushed_rows(spark, world):
    rows = region_source.read_world(spark, world, directories={"region": "d"}).filter("region_x = 2")
    assert {(r["chunk_x"], r["kind"]) for r in rows.collect()} == {(64, "voxel"), (64, "section"), (65, "error"), (66, "voxel"), (66, "section")}
    assert rows.filter("kind = 'error'").first()["error"] == "external file missing"
    assert rows.filter("chunk_x = 66 and kind = 'voxel'").select("x", "y", "z", "block").orderBy("y").collect() == [(1057, 3, 0, "minecraft:stone"), (1058, 20, 5, "minecraft:dirt")]


def test_a_file_that_goes_is_an_error_row(world):
    r = reader(world)
    part = next(p for p in r.partitions() if isinstance(p, region_source.SlotRange))
    part.path += ".gone"
    rows = [row for batch in r.read(part) for row in batch.to_pylist()]
    assert [row["kind"] for row in rows] == ["error"] and rows[0]["error"].startswith("cannot open")


def test_slots_equal_the_header_expressions(spark, world):
    from voxelspark.sources import regions

    files = regions.read_regions(spark, world).withColumn("dimension", F.lit("x"))
    key = ["region_x", "region_z", "chunk_x", "chunk_z", "slot", "sector", "sectors", "stamp"]
    want = sorted(map(str, regions.header_slots(files).select(*key).collect()))
    assert sorted(map(str, region_source.read_world(spark, world, "slots").select(*key).collect())) == want
