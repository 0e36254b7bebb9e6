"""Spatial joins, claims, assets and images against brute force and known answers."""

import random
import struct
import zlib

from pyspark.sql import functions as F
from voxelspark.operators import overlay, spatial
from voxelspark.sources import assets, overlays


def test_rectangle_join_equals_brute_force(spark):
    rng = random.Random(5)

    def rects(n, seed_level):
        out = []
        for i in range(n):
            w, h = 2 ** rng.randint(0, seed_level), 2 ** rng.randint(0, seed_level)
            x, z = rng.randint(-3000, 3000), rng.randint(-3000, 3000)
            out.append((i, "d", x, z, x + w + rng.randint(-1, 5), z + h + rng.randint(-1, 5)))
        return out

    schema = "id int, dimension string, min_x int, min_z int, max_x int, max_z int"
    a, b = rects(150, 13), rects(150, 16)
    got = spatial.rectangle_join(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema))
    pairs = sorted((r.id, r.r_id) for r in got.select("id", "r_id").collect())
    full = lambda r: r[4] > r[2] and r[5] > r[3]
    want = sorted((p[0], q[0]) for p in a for q in b if full(p) and full(q) and p[2] < q[4] and q[2] < p[4] and p[3] < q[5] and q[3] < p[5])
    assert pairs == want and len(want) > 500


def test_owner_legend_of_a_document(spark):
    chunks = lambda n: "[" + ",".join(f'{{"x":{i},"z":0}}' for i in range(n)) + "]"
    area = lambda i, owner, n: f'{{"id":"{i}","kind":"claim","owner":"{owner}","dimension":"d","shape":"chunks","chunks":{chunks(n)}}}'
    doc = f'{{"areas":[{area(1, "Daniel", 9)},{area(2, "Notch", 4)},{area(3, "jeb_", 4)}]}}'
    areas = overlays.parse_areas(spark.createDataFrame([(doc,)], "value string"))
    assert areas.first().max_x == 9 * 16
    members = areas.select(F.col("id").alias("area_id"), "dimension", F.explode("chunks").alias("c")).select("area_id", "dimension", F.col("c.x").alias("chunk_x"), F.col("c.z").alias("chunk_z"))
    legend = [(r.owner, r.chunks) for r in overlay.owner_legend(areas, members).collect()]
    assert legend == [("Daniel", 9), ("Notch", 4), ("jeb_", 4)]


def test_coordinate_literals(spark):
    cases = {"1250 -8220": (1250, -8220), "1250,-8220": (1250, -8220), "1 72 -9": (1, -9), "home 12": None, "5": None, "1 2 3 4": None}
    for text, want in cases.items():
        got = spark.range(1).select(overlay.parse_coordinates(F.lit(text)).alias("p")).first().p
        assert (got and (got.x, got.z)) == want, text


def test_search_prefers_exact_then_early_matches(spark):
    m = spark.sql("SELECT * FROM VALUES (1, 'poi', 'Ring', 'd', 1, 1), (2, 'poi', 'a ring', 'd', 1, 1), (3, 'poi', 'ringed', 'd', 1, 1), (4, 'poi', 'x', 'd', 1, 1) AS t(id, kind, name, dimension, x, z)")
    assert [r.id for r in overlay.search(" RING ", markers=m).collect()] == ["1", "3", "2"]


def png(width, height, pixel):
    raw = b"".join(b"\0" + b"".join(bytes(pixel(x, y)) for x in range(width)) for y in range(height))
    chunk = lambda t, d: struct.pack(">I", len(d)) + t + d + struct.pack(">I", zlib.crc32(t + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_image_pixels_take_the_first_frame(spark, tmp_path):
    """A 4 x 8 sprite sheet gives its top square; mips end in one colour."""
    (tmp_path / "t.png").write_bytes(png(4, 8, lambda x, y: (x * 10, y * 10, 7, 255 if y < 4 else 0)))
    pixels = assets.image_pixels(spark.read.format("image").load(str(tmp_path)))
    got = {(r.x, r.y): (r.r, r.g, r.b, r.a) for r in pixels.collect()}
    assert got == {(x, y): (x * 10, y * 10, 7, 255) for x in range(4) for y in range(4)}
    mips = assets.mip_levels(pixels, 2)
    assert tuple(assets.representative_color(mips).drop("texture").first()) == (15, 15, 7, 255)
    assert {r.size for r in assets.level_at_most(mips, 3).collect()} == {2}
    assert not assets.has_alpha(pixels).first().has_alpha


def test_packs_layer_and_missing_ones_are_skipped(spark, tmp_path):
    for pack, files in (("a", {"m/x.json": "1", "m/y.json": "1"}), ("b", {"m/x.json": "2"})):
        for name, text in files.items():
            path = tmp_path / pack / name
            path.parent.mkdir(parents=True, exist_ok=True)
            path.write_text(text)
    files = assets.read_packs(spark, [str(tmp_path / n) for n in ("a", "gone", "b")])
    got = {r.asset: bytes(r.content) for r in assets.effective_assets(files).collect()}
    assert got == {"m/x.json": b"2", "m/y.json": b"1"}


def test_bounded_reads_its_rows_once(spark):
    """Keys below, at and beyond the limit; one exchange, so the rows are evaluated once."""
    rows = spark.createDataFrame([(k, i) for k, n in (("a", 2), ("b", 3), ("c", 9)) for i in range(n)], "k string, i int")
    got = overlay.bounded(rows.repartition(4), ["k"], ["i"], 3)
    flags = {(r["k"], r["truncated"]): r["n"] for r in got.groupBy("k", "truncated").agg(F.count("*").alias("n")).collect()}
    assert flags == {("a", False): 2, ("b", False): 3, ("c", True): 3}
    plan = overlay.bounded(rows, ["k"], ["i"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "WindowGroupLimit" in plan and "Join" not in plan
    assert overlay.bounded(rows, ["k"], ["i"], 0).count() == 0
