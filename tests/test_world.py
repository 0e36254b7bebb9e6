"""A small world written byte by byte: decoding, surfaces, slabs, rays."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from voxelspark.operators import lookups, rays, surface
from voxelspark.sources import palettes, regions
from workload import region_writer as writer

BLOCKS = """{"minecraft:air":{"color":"#000","transparent":true},"stone":{"color":"#7d7d7d"},"dirt":{"color":"#866043"},
"grass_block":{"color":"#a0a0a0","tint":"grass"},"water":{"color":"#3f76e4","water":true},"oak_leaves":{"color":"#969696"},
"short_grass":{"color":"#8cbe5a","transparent":true,"decoration":true},"cobble":{"alias":"stone"}}"""


def terrain(cx, cz):
    """Stone to 59, dirt to 62, grass at 63, and water to 66 in the western half."""
    x, z, y = [a.ravel() for a in np.meshgrid(np.arange(16), np.arange(16), np.arange(48, 67), indexing="ij")]
    name = np.select([y <= 59, y <= 62, y == 63, x < 8], ["minecraft:stone", "minecraft:dirt", "minecraft:grass_block", "minecraft:water"], "")
    keep = name != ""
    return pd.DataFrame({"x": x[keep] + cx * 16, "y": y[keep], "z": z[keep] + cz * 16, "name": name[keep], "biome": "minecraft:plains"})


@pytest.fixture(scope="module")
def palette(spark):
    return palettes.parse_blocks(spark.createDataFrame([(0, BLOCKS)], "layer int, value string")).cache()


@pytest.fixture(scope="module")
def world(spark, tmp_path_factory):
    """Region files with four good chunks, a broken one and an unfinished one."""
    folder = tmp_path_factory.mktemp("world") / "region"
    folder.mkdir()
    spots = [(0, 0), (1, 0), (-1, -1), (-2, 3)]
    docs = {s: writer.chunk_document(terrain(*s)) for s in spots}
    docs[(2, 0)] = b"\x0a\x00\x00\x0b"
    docs[(3, 0)] = writer.document({"DataVersion": 3465, "Status": "minecraft:noise", "sections": []})
    for rx, rz in {(x >> 5, z >> 5) for x, z in docs}:
        inside = {s: d for s, d in docs.items() if (s[0] >> 5, s[1] >> 5) == (rx, rz)}
        (folder / f"r.{rx}.{rz}.mca").write_bytes(writer.region_file(inside, {(1, 0): 1, (0, 0): 3}))
    (folder / "r.9.9.mca").write_bytes(b"")
    (folder / "notes.txt").write_text("not a region")
    files = regions.read_regions(spark, str(folder)).withColumn("dimension", F.lit("d"))
    return files, regions.decode_chunks(regions.chunk_payloads(files)).cache()


def test_catalogue_and_header(world):
    files, _ = world
    assert files.count() == 3  # the file source leaves out empty files, which hold no chunks
    slots = regions.header_slots(files)
    assert slots.count() == 6 and slots.filter("error is not null").count() == 0


def test_bad_chunks_are_recorded_not_fatal(world):
    _, decoded = world
    errors = regions.error_rows(decoded).collect()
    assert [(e.chunk_x, e.chunk_z) for e in errors] == [(2, 0)]
    assert regions.voxel_rows(decoded).select(F.floor(F.col("x") / 16), F.floor(F.col("z") / 16)).distinct().count() == 4


def test_surface_of_known_terrain(spark, world, palette):
    _, decoded = world
    v = lookups.encode_names(regions.voxel_rows(decoded), palette, "block", "block_id").withColumn("biome_id", F.lit(0))
    cols = surface.surface_scan(v, palette, regions.section_rows(decoded))
    wet, dry = cols.filter(F.pmod("x", F.lit(16)) < 8), cols.filter(F.pmod("x", F.lit(16)) >= 8)
    assert wet.count() == dry.count() == 512
    assert wet.filter("height <> 63 or water_y <> 66 or not water").count() == 0
    assert dry.filter("height <> 63 or water or water_y is not null").count() == 0
    span = surface.dimension_y_range(regions.section_rows(decoded)).first()
    assert (span.min_y, span.max_y) == (48, 80)


def test_external_chunk_is_read_from_its_own_file(spark, tmp_path):
    doc = writer.chunk_document(terrain(0, 0))
    (tmp_path / "r.0.0.mca").write_bytes(writer.region_file({(0, 0): b""}, {(0, 0): 2 | 0x80}))
    import zlib

    (tmp_path / "c.0.0.mcc").write_bytes(zlib.compress(doc))
    files = regions.read_regions(spark, str(tmp_path)).withColumn("dimension", F.lit("d"))
    far = regions.read_external(spark, str(tmp_path))
    got = regions.decode_chunks(regions.chunk_payloads(files, far))
    assert regions.voxel_rows(got).count() == len(terrain(0, 0))
    alone = regions.decode_chunks(regions.chunk_payloads(files))
    assert regions.error_rows(alone).first().error == "external file missing"


def test_legacy_layout(spark):
    """Entries across longs, the old nesting, and chunk-wide numeric biomes."""
    index = np.arange(4096) % 5
    names = ["air", "stone", "dirt", "water", "grass_block"]
    section = {"Y": 2, "Palette": [{"Name": f"minecraft:{n}"} for n in names], "BlockStates": writer.pack(index, 5, 1, crossing=True)}
    root = {"DataVersion": 1976, "Level": {"Status": "full", "Sections": [section], "Biomes": np.full(256, 2, np.int32)}}
    parts = regions.decode_document(regions.tagged.parse(writer.document(root)))
    voxels = [p for p in parts if p["kind"] == "voxel"][0]
    assert len(voxels["y"]) == np.count_nonzero(index)
    assert set(voxels["biome"]) == {"minecraft:desert"}
    spot = (voxels["y"] - 32) * 256 + voxels["z"] * 16 + voxels["x"]
    assert (voxels["block"] == np.array([f"minecraft:{n}" for n in names], dtype=object)[index[spot]]).all()


def canopy(spark, palette, leaf=True):
    """Flat ground at 13 and one leaf block at height 28."""
    base = spark.range(256).select((F.col("id") % 16).cast("int").alias("x"), F.floor(F.col("id") / 16).cast("int").alias("z"))
    ground = base.withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(13)))).withColumn(
        "block", F.when(F.col("y") <= 9, "minecraft:stone").when(F.col("y") <= 12, "minecraft:dirt").otherwise("minecraft:grass_block")
    )
    if leaf:
        ground = ground.unionByName(spark.sql("SELECT 0 AS x, 0 AS z, 28 AS y, 'minecraft:oak_leaves' AS block"))
    v = lookups.encode_names(ground.withColumn("dimension", F.lit("d")), palette, "block", "block_id")
    return v.withColumns({n: F.lit(15) for n in ("light", "light_above", "block_light_above")}).withColumn("biome_id", F.lit(0))


def test_slab_depth_follows_the_canopy(spark, palette):
    spans = surface.canopy_spans(canopy(spark, palette), palette).cache()
    tree = spans.filter("x = 0 and z = 0").first()
    assert (tree.top_y, tree.span) == (28, 15)
    depth = lambda lo, hi: surface.slab_depths(spans, 2, lo, hi).first().depth
    assert (depth(4, 100), depth(40, 100), depth(4, 10)) == (17, 40, 10)
    slabs = surface.extract_slabs(canopy(spark, palette), spans, surface.slab_depths(spans, 2, 4, 100))
    levels = {r.y for r in slabs.filter("x = 0 and z = 0").collect()}
    assert 20 not in levels and 13 in levels and 28 in levels
    flat = surface.canopy_spans(canopy(spark, palette, False), palette)
    assert surface.slab_depths(flat, 5, 8, 100).first().depth == 8


def test_rays_honour_gaps(spark, palette):
    """Ground at 60, a plant at 61 and a canopy at 70 in column (5, 5)."""
    v = spark.sql(
        "SELECT 'd' AS dimension, 5 AS x, 5 AS z, y, block, 15 AS light FROM VALUES (60, 'minecraft:stone'), "
        "(61, 'minecraft:short_grass'), (70, 'minecraft:oak_leaves') AS t(y, block)"
    )
    v = lookups.encode_names(v, palette, "block", "block_id")
    dims = spark.sql("SELECT 'd' AS dimension, 0 AS min_y, 127 AS max_y")
    q = spark.sql("SELECT id AS qid, 'd' AS dimension, 0.0D AS u, 5.5D - (id + 0.5D) AS v FROM VALUES (70L), (60L), (65L), (61L) AS t(id)")
    hits = {r.qid: r.y for r in rays.pick_voxels(q, v, palette, dims).collect()}
    assert hits == {70: 70, 60: 60}


def march(u, v, lo, hi, heights):
    """Step-by-step walk along one ray, as an independent check."""
    import math

    du, a, b = u / 2, math.floor(v + hi + 1 + u / 2), math.floor(v + hi + 1 - u / 2)
    for _ in range(4 * (hi - lo) + 16):
        s = max(a - du, b + du)
        if (a, b) in heights and heights[a, b] + 1 >= max(s - v, lo):
            return a, b
        if s <= v + lo:
            return None
        a, b = (a - 1 if a - du >= b + du else a), (b - 1 if b + du >= a - du else b)


def test_column_rays_equal_a_walk(spark):
    rng = np.random.default_rng(3)
    spots = [(int(x), int(z)) for x in range(-12, 13) for z in range(-12, 13) if rng.random() < 0.7]
    heights = {s: int(rng.integers(0, 20)) for s in spots}
    cols = spark.createDataFrame([("d", x, z, h) for (x, z), h in heights.items()], "dimension string, x int, z int, height int")
    cols = cols.withColumns({"water": F.lit(False), "water_y": F.lit(None).cast("int"), "present": F.lit(True)})
    points = [(i, float(rng.integers(-80, 80)) / 4, float(rng.integers(-160, 80)) / 4) for i in range(400)]
    q = spark.createDataFrame([(i, "d", u, v) for i, u, v in points], "qid int, dimension string, u double, v double")
    dims = spark.sql("SELECT 'd' AS dimension, 0 AS min_y, 24 AS max_y")
    got = {r.qid: (r.x, r.z) for r in rays.pick_columns(q, cols, dims).collect()}
    want = {i: march(u, v, 0, 24, heights) for i, u, v in points}
    assert got == {i: h for i, h in want.items() if h is not None} and len(got) > 50
