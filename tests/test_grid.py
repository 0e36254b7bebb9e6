"""Known cases and small exhaustive properties of the grid and the projection."""

from pyspark.sql import functions as F
from voxelspark.functions import grid, iso, names


def rows(spark, text):
    return spark.sql(f"SELECT * FROM VALUES {text}")


def test_floor_cases(spark):
    cases = [(-1, 16, -1), (-16, 16, -1), (-17, 16, -2), (-33, 16, -3), (15, 16, 0), (-5, 2, -3)]
    for a, n, want in cases:
        got = rows(spark, f"({a}) AS t(a)").select(grid.floor_div("a", n), grid.floor_mod("a", n)).first()
        assert got[0] == want and got[0] * n + got[1] == a


def test_division_identity_over_a_range(spark):
    df = spark.range(-80, 81).select(F.col("id").cast("int").alias("a"))
    for n in (2, 7, 16):
        bad = df.filter((grid.floor_div("a", n) * n + grid.floor_mod("a", n) != F.col("a")) | (grid.floor_mod("a", n) < 0))
        assert bad.count() == 0


def test_tile_cases(spark):
    got = rows(spark, "(-1, 10), (-32, 10), (-33, 10), (-513, 6), (512, 6) AS t(b, z)").select(
        grid.block_to_tile("b", F.col("z"))
    )
    assert [r[0] for r in got.collect()] == [-1, -1, -2, -2, 1]
    spans = spark.range(0, 11).select(grid.tile_span("id")).collect()
    assert [r[0] for r in spans] == [32768 >> z for z in range(11)]


def test_children_contain_each_other(spark):
    df = spark.sql("SELECT x, y FROM VALUES (-3, 4), (0, 0), (5, -6) AS t(x, y)")
    kids = df.select("x", "y", F.explode(grid.children_of("x", "y", F.lit(4))).alias("c"))
    wrong = kids.filter((grid.parent_tile("c.tile_x") != F.col("x")) | (grid.parent_tile("c.tile_y") != F.col("y")))
    assert kids.count() == 12 and wrong.count() == 0


def test_wide_view_needs_few_tiles(spark):
    df = spark.sql("SELECT -10000 AS min_x, -10000 AS min_z, 10000 AS max_x, 10000 AS max_z")
    b = ("min_x", "min_z", "max_x", "max_z")
    got = df.select(grid.cover_count(b, F.lit(2)), grid.cover_count(b, F.lit(0)), F.size(grid.tiles_covering(b, 2))).first()
    assert got[0] <= 16 and got[1] == 4 and got[2] == got[0]


def test_empty_bounds_cover_nothing(spark):
    df = spark.sql("SELECT 5 AS min_x, 5 AS min_z, 5 AS max_x, 9 AS max_z")
    got = df.select(
        F.size(grid.tiles_covering(("min_x", "min_z", "max_x", "max_z"), 6)),
        grid.in_bounds(F.lit(5), F.lit(5), "min_x", "min_z", "max_x", "max_z"),
    ).first()
    assert got[0] == 0 and not got[1]


def test_projection_round_trip_for_all_cameras(spark):
    df = spark.range(-6, 7).crossJoin(spark.range(-6, 7).withColumnRenamed("id", "z")).withColumn("y", F.col("id") * 3)
    for cam in iso.CAMERAS:
        u, v = iso.project("id", "y", "z", cam)
        x, z = iso.unproject(u, v, "y", cam)
        assert df.filter((x != F.col("id")) | (z != F.col("z"))).count() == 0


def test_footprint_holds_every_contributor(spark):
    """A column whose top vertex lies in the rectangle is inside its footprint."""
    df = spark.range(-40, 40).crossJoin(spark.range(-40, 40).withColumnRenamed("id", "z")).withColumn("y", F.pmod(F.col("id") * 7 + F.col("z"), F.lit(30)).cast("int"))
    for cam in iso.CAMERAS:
        u, v = iso.project_block_top("id", "y", "z", cam)
        box = iso.world_footprint((F.lit(-16.0), F.lit(-16.0), F.lit(16.0), F.lit(16.0)), F.lit(0), F.lit(30), cam)
        seen = df.filter((u >= -16) & (u < 16) & (v >= -16) & (v < 16))
        assert seen.count() > 0
        assert seen.filter(~grid.in_bounds("id", "z", *box)).count() == 0


def test_ore_names(spark):
    cases = {
        "minecraft:diamond_ore": 9, "minecraft:deepslate_diamond_ore": 9, "minecraft:ancient_debris": 10, "minecraft:coal_ore": 2,
        "mod:tin_ore": 1, "mod:ore_vein": 0, "minecraft:diamond_block": 0, "MOD:RAW_ORE_BLOCK": 1, "minecraft:stone": 0,
    }
    for name, kind in cases.items():
        assert spark.range(1).select(names.classify_ore(F.lit(name))).first()[0] == kind, name


def test_heights_by_name(spark):
    cases = {"oak_slab": 0.5, "a:spruce_stairs": 0.5, "red_carpet": 0.0625, "oak_trapdoor": 0.1875, "stone": None, "mud": 0.875}
    for name, height in cases.items():
        assert spark.range(1).select(names.infer_height(F.lit(name))).first()[0] == height, name


def test_names(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(names.normalize(F.lit("  Stone[axis=y] "))) == "minecraft:stone"
    assert one(names.normalize(F.lit(""))) == "minecraft:air"
    assert one(names.pretty_name(F.lit("a:deep_dark"))) == "Deep Dark"
    assert one(names.safe_id(F.lit("../Ä b:c"))) == "___b_c"
    assert one(names.safe_id(F.lit("..."))) == "unknown"
