"""Grid arithmetic, projection, colour and name functions over whole tables (ids F1-F33, P1-P12, X3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.functions import color as C
from voxelspark.functions import grid, iso, names, sql
from voxelspark.operators import requests, surface

from . import sqlcolor as q
from . import views as fx
from .surface_queries import columns
from .views import define, oracle

B4 = ("min_x", "min_z", "max_x", "max_z")


def _int(e: str) -> str:
    return f"CAST({e} AS INTEGER)"


def fl(e: str) -> str:
    return f"CAST(floor({e}) AS INTEGER)"


def blocks(spark, sf):
    return fx.blocks_xz(spark, sf)


def rgb_rows(spark, sf):
    """Two colours and a weight per order."""
    k = F.col("id")
    c = lambda *m: F.struct(*[(k * a % 256).cast("int").alias(n) for a, n in zip(m, "rgba")])
    return blocks(spark, sf).select(
        "id", c(7, 13, 29, 31).alias("p"), c(17, 5, 3, 11).alias("s"), ((k % 140) / 100.0 - 0.2).alias("t"),
        (k % 16).cast("int").alias("light"), (k % 40).cast("int").alias("depth"), (k % 11).cast("int").alias("kind"),
        (k % 25).cast("int").alias("score"),
    )


define(
    "o_rgb",
    ("fx_blocks",),
    "SELECT id, "
    + ", ".join(f"{_int(f'id*{m}%256')} AS p_{n}" for m, n in zip((7, 13, 29, 31), "rgba"))
    + ", "
    + ", ".join(f"{_int(f'id*{m}%256')} AS s_{n}" for m, n in zip((17, 5, 3, 11), "rgba"))
    + ", (id%140)/100.0e0-0.2e0 AS t, CAST(id%16 AS INTEGER) AS light, CAST(id%40 AS INTEGER) AS depth, "
    "CAST(id%11 AS INTEGER) AS kind, CAST(id%25 AS INTEGER) AS score FROM fx_blocks",
)


def P():
    return C.load("p")


def S():
    return C.load("s")


def q_bounds(spark, sf):
    a = fx.viewports(spark, sf)
    b = fx.areas(spark, sf)
    pair = a.select("view_id", *B4).join(
        b.select((F.col("id") % 100).alias("view_id"), "id", *[F.col(c).alias("o_" + c) for c in B4]), "view_id"
    )
    o = tuple("o_" + c for c in B4)
    meet = grid.intersection(B4, o)
    wide = grid.expand(B4, 16)
    return pair.select(
        "view_id", "id", grid.bounds_intersect(B4, o).alias("meets"), *[c.alias(n) for n, c in zip(("ix0", "iz0", "ix1", "iz1"), meet)],
        grid.is_empty(*meet).alias("meet_empty"), *[c.alias(n) for n, c in zip(("ex0", "ez0", "ex1", "ez1"), wide)],
        (F.col("max_x") - F.col("min_x")).alias("width"), (F.col("max_z") - F.col("min_z")).alias("height"),
    )


def q_guard(spark, sf):
    k = F.col("id")
    rows = blocks(spark, sf).select(
        "id", "zoom", (k * 40_503 % 3_000_001 - 1_500_000).cast("int").alias("tile_x"), (k % 77 - 30).cast("int").alias("tile_y"),
        F.col("x").alias("min_x"), F.col("z").alias("min_z"), (F.col("x") + k % 5 * 700_000 - 10).cast("int").alias("max_x"),
        (F.col("z") + 500).alias("max_z"), (k % 160).cast("int").alias("chunks"), (k % 1100).cast("int").alias("heights"),
        (k % 30000).cast("int").alias("limit"),
    )
    return requests.request_guard(rows).select("id", "valid", "reason", "effective_limit")


def names_norm(spark, sf):
    return fx.raw_names(spark, sf).withColumn("key", names.normalize("name"))


define(
    "o_keys",
    ("fx_names",),
    "SELECT id, name, CASE WHEN k='' THEN 'minecraft:air' WHEN contains(k,':') THEN k ELSE 'minecraft:'||k END AS key FROM "
    "(SELECT id,name,regexp_replace(lower(trim(name)),'\\[.*$','') AS k FROM fx_names)",
)


def q_cam(spark, sf):
    df = blocks(spark, sf)
    out = ["id"]
    for cam in ("se", "sw", "nw", "ne"):
        a, b = iso.rotate("x", "z", cam)
        x, z = iso.unrotate(a, b, cam)
        out += [a.alias(f"{cam}_a"), b.alias(f"{cam}_b"), (x == F.col("x")).alias(f"{cam}_ok"), iso.depth_key("x", "z", cam).alias(f"{cam}_depth"), z.alias(f"{cam}_z")]
    return df.select(*out)


def q_project(spark, sf):
    df = blocks(spark, sf)
    u, v = iso.project_block_top("x", "y", "z", "sw")
    df = df.select("*", u.alias("u"), v.alias("v"))
    x, z = iso.unproject_flat("u", "v", "y", "sw")
    tx, ty = iso.tile_at("u", "v", "zoom")
    b = iso.tile_bounds(tx, ty, "zoom")
    return df.select(
        "id", "u", "v", x.alias("flat_x"), z.alias("flat_z"), tx.alias("tile_x"), ty.alias("tile_y"),
        b[0].alias("u0"), b[3].alias("v1"), iso.sprite_height("y", F.lit(20)).alias("sprite"),
    )


def q_footprint(spark, sf):
    df = blocks(spark, sf).select("id", "zoom", F.floor(F.col("x") / 512).cast("int").alias("tx"), F.floor(F.col("z") / 512).cast("int").alias("ty"))
    w = iso.world_footprint(iso.tile_bounds("tx", "ty", "zoom"), F.lit(0), F.lit(63), "nw")
    i = iso.footprint_of_blocks((F.col("tx") * 16, F.col("ty") * 16, F.col("tx") * 16 + 16, F.col("ty") * 16 + 16), F.lit(-64), F.lit(320), "ne")
    return df.select(
        "id", *[c.alias(n) for n, c in zip(("wx0", "wz0", "wx1", "wz1"), w)], *[c.alias(n) for n, c in zip(("u0", "v0", "u1", "v1"), i)]
    )


def q_tiles(spark, sf):
    df = blocks(spark, sf).select(
        "id", "zoom", grid.block_to_tile("x", F.col("zoom")).alias("tile_x"), grid.block_to_tile("z", F.col("zoom")).alias("tile_y")
    )
    up = grid.ancestors_of("tile_x", "tile_y", "zoom", 0)
    last = F.try_element_at(up, F.lit(-1))
    kids = grid.children_of("tile_x", "tile_y", "zoom")
    return df.select(
        "id", "zoom", "tile_x", "tile_y", grid.parent_tile("tile_x").alias("parent_x"), grid.child_quadrant("tile_y").alias("quad_y"),
        F.size(up).alias("ancestors"), last["tile_x"].alias("root_x"), last["zoom"].alias("root_zoom"), kids[3]["tile_x"].alias("se_x"),
        kids[1]["tile_y"].alias("ne_y"), kids[0]["zoom"].alias("child_zoom"),
    )


def q_covering(spark, sf):
    v = fx.viewports(spark, sf).withColumn("z", F.col("zoom") + 2)
    return v.select("view_id", "z", F.explode(grid.tiles_covering(B4, F.col("z"))).alias("t")).select(
        "view_id", F.col("z").alias("zoom"), "t.*"
    )


def q_sql_covering(spark, sf):
    """The same cover through the SQL table function."""
    sql.register(spark)
    v = fx.viewports(spark, sf).withColumn("z", F.col("zoom") + 2)
    return spark.sql(
        "SELECT v.view_id, v.z AS zoom, t.tile_x, t.tile_y FROM {v} v, LATERAL tiles_covering(v.min_x, v.min_z, v.max_x, v.max_z, v.z) t", v=v
    )


def q_biome_tints(spark, sf):
    g, f, w = names.biome_tints("key")
    return names_norm(spark, sf).select("id", *g.columns("g_"), *f.columns("f_"), *w.columns("w_"))


def q_hex(spark, sf):
    df = rgb_rows(spark, sf).withColumn("hex", C.format_hex(P()))
    short = F.concat(F.lit(" #"), F.substring("hex", 2, 1), F.substring("hex", 4, 1), F.substring("hex", 6, 1))
    eight = F.concat(F.upper(F.substring("hex", 2, 6)), F.lpad(F.hex(F.col("p.a")), 2, "0"))
    df = df.withColumns({"three": C.parse_hex(short), "six": C.parse_hex("hex"), "eight": C.parse_hex(eight), "bad": C.parse_hex(F.concat("hex", F.lit("x")))})
    return df.select(
        "id", "hex", F.col("three.g").alias("g3"), F.col("six.r").alias("r6"), F.col("six.a").alias("a6"), F.col("eight.b").alias("b8"),
        F.col("eight.a").alias("a8"), F.col("bad").isNull().alias("bad"),
    )


def _c(df, *cols):
    return df.select("id", *cols)


QUERIES = {
    "f1_floor_arithmetic": lambda s, sf: blocks(s, sf).select(
        "id", grid.floor_div("x", 16).alias("d16"), grid.floor_mod("x", 16).alias("m16"), grid.floor_div("x", 7).alias("d7"),
        grid.floor_mod("x", 7).alias("m7"), grid.floor_div("z", 512).alias("d512"),
    ),
    "f2_block_chunk_region": lambda s, sf: blocks(s, sf).select(
        "id", grid.block_to_chunk("x").alias("chunk_x"), grid.block_in_chunk("x").alias("in_chunk"), grid.block_to_region("z").alias("region_z"),
        grid.chunk_in_region(grid.block_to_chunk("z")).alias("slot_z"), grid.chunk_to_block(grid.block_to_chunk("x")).alias("chunk_min"),
        grid.chunk_to_region(grid.block_to_chunk("x")).alias("region_x"),
    ),
    "f3_zoom_scale": lambda s, sf: blocks(s, sf).select(
        "id", grid.blocks_per_pixel("zoom").alias("bpp"), grid.pixels_per_block("zoom").alias("ppb"), grid.tile_span("zoom").alias("span"),
        grid.tile_span_chunks("zoom").alias("span_chunks"), grid.tile_span_exact("zoom").alias("exact"),
    ),
    "f4_tile_addressing": q_tiles,
    "f4_tiles_covering": q_covering,
    "x3_sql_tiles_covering": q_sql_covering,
    "f5_map_axes": lambda s, sf: blocks(s, sf).select("id", *[c.alias(n) for c, n in zip(grid.map_xy("x", "z"), ("map_x", "map_y"))]),
    "f6_normalize_name": lambda s, sf: names_norm(s, sf).select("id", "key"),
    "f7_safe_id": lambda s, sf: fx.raw_names(s, sf).select("id", names.safe_id(F.concat(F.lit(".-"), "name")).alias("token")),
    "f8_pretty_name": lambda s, sf: names_norm(s, sf).select("id", names.pretty_name("key").alias("title")),
    "f9_hex_color": q_hex,
    "f10_name_color": lambda s, sf: names_norm(s, sf).select("key").distinct().withColumn("h", C.name_hash("key"))
    .select("key", *C.name_color("h").columns()),
    "f11_color_mix": lambda s, sf: _c(rgb_rows(s, sf), *C.multiply(P(), S()).columns("m_"), *C.lerp(P(), S(), "t").columns("l_"), *C.scale(P(), F.col("t") * 2).columns("s_")),
    "f12_alpha_over": lambda s, sf: _c(rgb_rows(s, sf), *C.alpha_over(P(), S()).columns()),
    "f13_ore_style": lambda s, sf: _c(rgb_rows(s, sf), *C.ore_style(P(), "kind", "score").columns(), *C.desaturate(S(), 0.88).columns("d_")),
    "f14_light_style": lambda s, sf: _c(rgb_rows(s, sf), *C.light_style("light").columns()),
    "f15_light_factor": lambda s, sf: _c(rgb_rows(s, sf), C.light_factor("light").alias("factor")),
    "f16_height_gradient": lambda s, sf: _c(rgb_rows(s, sf), *C.gradient(C.HEIGHT_RAMP, "t").columns()),
    "f17_water_color": lambda s, sf: _c(rgb_rows(s, sf), *C.water_over(P(), S(), "depth").columns()[:3]),
    "f18_classify_ore": lambda s, sf: names_norm(s, sf).select("id", names.classify_ore("key").alias("kind"), names.ore_points(names.classify_ore("name")).alias("points")),
    "f19_infer_height": lambda s, sf: names_norm(s, sf).select("id", names.infer_height("key").alias("height")),
    "f20_biome_tints": q_biome_tints,
    "f21_legacy_biome": lambda s, sf: blocks(s, sf).select("id", names.legacy_biome(F.pmod("x", F.lit(200))).alias("biome")),
    "f22_water_depth": lambda s, sf: _depths(s, sf),
    "f23_camera_axes": q_cam,
    "f24_projection": q_project,
    "f25_footprints": q_footprint,
    "f26_height_percent": lambda s, sf: blocks(s, sf).select("id", C.height_percent("y", F.lit(-64), F.lit(320)).alias("t"), C.height_percent("y", F.lit(5), F.lit(5)).alias("flat")),
    "f29_owner_color": lambda s, sf: fx.markers(s, sf).select("name").distinct().select("name", C.owner_hash("name").alias("h"), C.owner_color("name").alias("color")),
    "f30_nice_scale": lambda s, sf: blocks(s, sf).select("id", grid.nice_scale(F.col("x") / 7).alias("step")),
    "f31_shortest_turn": lambda s, sf: blocks(s, sf).select("id", grid.shortest_turn(F.col("x") / 8.0, F.col("z") / 8.0).alias("turn")),
    "f32_enum_parsers": lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").select(
        F.col("o_orderkey").alias("id"),
        names.parse_style(F.element_at(F.array(*[F.lit(x) for x in STYLE_WORDS]), (F.col("o_orderkey") % 8 + 1).cast("int"))).alias("style"),
        names.parse_mode(F.element_at(F.array(*[F.lit(x) for x in MODE_WORDS]), (F.col("o_orderkey") % 4 + 1).cast("int"))).alias("mode"),
        names.parse_camera(F.element_at(F.array(*[F.lit(x) for x in CAMERA_WORDS]), (F.col("o_orderkey") % 6 + 1).cast("int"))).alias("camera"),
        names.parse_tint(F.element_at(F.array(*[F.lit(x) for x in TINT_WORDS]), (F.col("o_orderkey") % 5 + 1).cast("int"))).alias("tint"),
    ),
    "f33_position_label": lambda s, sf: fx.positions(s, sf).select("event_id", grid.position_label("x", "z", "rotation").alias("with_y"), grid.position_label("x", "z").alias("flat")),
    "p1_bounds_filter": lambda s, sf: columns(s, sf).filter(grid.in_bounds("x", "z", F.lit(-20), F.lit(-33), F.lit(15), F.lit(40))).select("dimension", "x", "z", "height"),
    "p2_bounds_algebra": q_bounds,
    "p7_slice_level": lambda s, sf: blocks(s, sf).withColumn("text", F.when(F.col("id") % 9 == 0, "top").otherwise(F.col("y").cast("string")))
    .select("id", requests.parse_slice("text", F.lit(-40), F.lit(200)).alias("slice_y")),
    "p9_generation_status": lambda s, sf: s.read.parquet(f"{sf}/orders.parquet").withColumn(
        "status", F.element_at(F.array(*[F.lit(x) for x in STATUS_WORDS]), (F.col("o_orderkey") % len(STATUS_WORDS) + 1).cast("int")))
    .filter(names.is_usable_status("status")).groupBy("status").agg(F.count("*").alias("n")),
    "p11_request_guards": q_guard,
    "p12_world_border": lambda s, sf: requests.world_border(fx.positions(s, sf), fx.dimensions(s)).select("event_id", "dimension", "x", "z"),
    "a25_cover_count": lambda s, sf: fx.areas(s, sf).select(
        "id", F.explode(F.sequence(F.lit(0), F.lit(10))).alias("zoom"), *B4).select("id", "zoom", grid.cover_count(B4, F.col("zoom")).alias("tiles")),
}


def _depths(spark, sf):
    return columns(spark, sf).select("dimension", "x", "z", surface.water_depth().alias("depth"), surface.render_y().alias("render_y"))


STYLE_WORDS = ("terrain", "biome", "height", "light", "ore", "contour", "", "Terrain2")
MODE_WORDS = ("top", "ISO", "", "side")
CAMERA_WORDS = ("", "SW", "north_west", "ne", "Se", "south_east")
TINT_WORDS = ("Grass", "leaves", "WATER", "dry_foliage", "stone")
STATUS_WORDS = ("full", "minecraft:full", "minecraft:noise", "", "heightmaps", "spawn", "minecraft:light", "carvers", "postprocessed", "empty")


def _pick(words, k, n) -> str:
    return f"({fx._arr(words)})[CAST({k}%{n}+1 AS INTEGER)]"


def _ch(prefix, make):
    return ", ".join(f"{make(i, c)} AS {prefix}{c}" for i, c in enumerate("rgb"))


_N = "regexp_replace(lower(key),'^[^:]*:','')"
_NR = "regexp_replace(lower(name),'^[^:]*:','')"


def _ore(n: str) -> str:
    cases = " ".join(f"WHEN contains({n},'{frag}') THEN {kind}" for frag, kind in names.ORE_FRAGMENTS)
    return f"(CASE {cases} WHEN {n} LIKE '%\\_ore' ESCAPE '\\' OR contains({n},'_ore_') THEN 1 ELSE 0 END)"


def _height(n: str) -> str:
    cases = " ".join(f"WHEN ends_with({n},'{e}') THEN {h!r}e0" for e, h in names.HEIGHT_ENDINGS)
    whole = " ".join(f"WHEN {n}='{w}' THEN {h!r}e0" for w, h in names.HEIGHT_NAMES.items())
    return f"(CASE {cases} {whole} END)"


def _tint_hex(slot: int) -> str:
    cases = " ".join(
        f"WHEN regexp_matches(key,'{fam[0]}') THEN '{fam[slot] or names.BIOME_DEFAULT[slot - 1]}'" for fam in names.BIOME_FAMILIES
    )
    return f"(CASE {cases} ELSE '{names.BIOME_DEFAULT[slot - 1]}' END)"


def _hexch(e: str, at: int) -> str:
    return f"CAST(('0x'||substr({e},{at},2)) AS INTEGER)"


_SPAN = "(1<<CAST(greatest(15-zoom,0) AS INTEGER))"
_SPANF = "(512.0e0*pow(2.0e0,6-zoom))"
_TZ, _TY = fl(f"x/CAST({_SPAN} AS DOUBLE)"), fl(f"z/CAST({_SPAN} AS DOUBLE)")
_LEG = "CASE ((x%200)+200)%200 " + " ".join(f"WHEN {k} THEN 'minecraft:{v}'" for k, v in names.LEGACY_BIOMES.items()) + " ELSE 'minecraft:plains' END"
_D = "(CASE WHEN d=-180 THEN 180.0e0 ELSE d END)"

ORACLE = {
    "f1_floor_arithmetic": oracle("fx_blocks", f"SELECT id,{fl('x/16.0')} AS d16,((x%16)+16)%16 AS m16,{fl('x/7.0e0')} AS d7,((x%7)+7)%7 AS m7,{fl('z/512.0')} AS d512 FROM fx_blocks"),
    "f2_block_chunk_region": oracle(
        "fx_blocks",
        f"SELECT id,{fl('x/16.0')} AS chunk_x,((x%16)+16)%16 AS in_chunk,{fl('z/512.0')} AS region_z,(({fl('z/16.0')}%32)+32)%32 AS slot_z,{fl('x/16.0')}*16 AS chunk_min,{fl('x/512.0')} AS region_x FROM fx_blocks",
    ),
    "f3_zoom_scale": oracle("fx_blocks", f"SELECT id,pow(2.0e0,6-zoom) AS bpp,pow(2.0e0,zoom-6) AS ppb,CAST({_SPAN} AS INTEGER) AS span,{fl(f'{_SPAN}/16.0')} AS span_chunks,{_SPANF} AS exact FROM fx_blocks"),
    "f4_tile_addressing": oracle(
        "fx_blocks",
        f", t AS (SELECT id,zoom,{_TZ} AS tile_x,{_TY} AS tile_y,x,z FROM fx_blocks) "
        f"SELECT id,zoom,tile_x,tile_y,{fl('tile_x/2.0')} AS parent_x,((tile_y%2)+2)%2 AS quad_y,zoom AS ancestors,"
        f"CASE WHEN zoom>0 THEN {fl('x/32768.0')} END AS root_x,CASE WHEN zoom>0 THEN 0 END AS root_zoom,tile_x*2+1 AS se_x,tile_y*2 AS ne_y,zoom+1 AS child_zoom FROM t",
    ),
    "f4_tiles_covering": oracle(
        "fx_viewports",
        ", v AS (SELECT view_id,zoom+2 AS zoom,min_x,min_z,max_x,max_z,CAST(1<<CAST(13-zoom AS INTEGER) AS DOUBLE) AS sp FROM fx_viewports), "
        f"w AS (SELECT *, {fl('min_x/sp')} AS x0,{fl('(max_x-1)/sp')} AS x1,{fl('min_z/sp')} AS y0,{fl('(max_z-1)/sp')} AS y1 FROM v) "
        "SELECT view_id,zoom,tile_x,CAST(unnest(range(y0,y1+1)) AS INTEGER) AS tile_y FROM (SELECT *, CAST(unnest(range(x0,x1+1)) AS INTEGER) AS tile_x FROM w)",
    ),
    "f5_map_axes": oracle("fx_blocks", "SELECT id,x AS map_x,-z AS map_y FROM fx_blocks"),
    "f6_normalize_name": oracle("o_keys", "SELECT id,key FROM o_keys"),
    "f7_safe_id": oracle("fx_names", "SELECT id,substr(regexp_replace(regexp_replace(lower(trim('.-'||name)),'[^a-z0-9_.-]','_','g'),'^[.-]+',''),1,128) AS token FROM fx_names"),
    "f8_pretty_name": oracle(
        "o_keys",
        "SELECT id,list_aggregate(list_transform(list_filter(string_split(regexp_replace(key,'^[^:]*:',''),'_'),lambda w: w<>''),lambda w: upper(w[1])||w[2:]),'string_agg',' ') AS title FROM o_keys",
    ),
    "f9_hex_color": oracle(
        "o_rgb",
        f", h AS (SELECT *,{q.hex_of('p_r', 'p_g', 'p_b')} AS hex FROM o_rgb) SELECT id,hex,CAST(floor(p_g/16.0) AS INTEGER)*17 AS g3,p_r AS r6,255 AS a6,p_b AS b8,p_a AS a8,true AS bad FROM h",
    ),
    "f10_name_color": oracle(
        "o_keys",
        f", h AS (SELECT DISTINCT key FROM o_keys), f AS (SELECT key,{q.fnv('key')} AS fnv FROM h) SELECT key,{q.name_color('fnv', 0)} AS r,{q.name_color('fnv', 1)} AS g,{q.name_color('fnv', 2)} AS b,255 AS a FROM f",
    ),
    "f11_color_mix": oracle(
        "o_rgb",
        f"SELECT id,{_ch('m_', lambda i, c: q.multiply(f'p_{c}', f's_{c}'))},p_a AS m_a,{_ch('l_', lambda i, c: q.lerp(f'p_{c}', f's_{c}', 't'))},{q.lerp('p_a', 's_a', 't')} AS l_a,"
        f"{_ch('s_', lambda i, c: q.clamp8(f'p_{c}*(t*2)'))},p_a AS s_a FROM o_rgb",
    ),
    "f12_alpha_over": oracle("o_rgb", f"SELECT id,{_ch('', lambda i, c: q.over(f'p_{c}', f's_{c}', 'p_a'))},{q.over_alpha('p_a', 's_a')} AS a FROM o_rgb"),
    "f13_ore_style": oracle(
        "o_rgb",
        f", d AS (SELECT *,{_ch('b_', lambda i, c: q.desaturate(f'p_{c}', 'p_r', 'p_g', 'p_b'))} FROM o_rgb) SELECT id,{_ch('', lambda i, c: q.ore_style(f'b_{c}', 'kind', 'score', i))},"
        f"{q.lerp('p_a', '255', 'least(1.0e0,score/16.0e0)')} AS a,{_ch('d_', lambda i, c: q.desaturate(f's_{c}', 's_r', 's_g', 's_b'))},s_a AS d_a FROM d",
    ),
    "f14_light_style": oracle("o_rgb", f"SELECT id,{_ch('', lambda i, c: q.light_style('light', i))},255 AS a FROM o_rgb"),
    "f15_light_factor": oracle("o_rgb", "SELECT id,CASE WHEN light>=15 THEN 1.0e0 ELSE light*0.45e0/15+0.55e0 END AS factor FROM o_rgb"),
    "f16_height_gradient": oracle("o_rgb", f"SELECT id,{_ch('', lambda i, c: q.gradient('t', i))},255 AS a FROM o_rgb"),
    "f17_water_color": oracle("o_rgb", f"SELECT id,{_ch('', lambda i, c: q.water(f'p_{c}', f's_{c}', 'depth'))} FROM o_rgb"),
    "f18_classify_ore": oracle("o_keys", f", k AS (SELECT id,{_ore(_N)} AS kind,{_ore(_NR)} AS raw FROM o_keys) SELECT id,kind,(ARRAY{list(names.ORE_POINTS)})[raw+1] AS points FROM k"),
    "f19_infer_height": oracle("o_keys", f"SELECT id,{_height(_N)} AS height FROM o_keys"),
    "f20_biome_tints": oracle(
        "o_keys",
        f", t AS (SELECT id,{_tint_hex(1)} AS g,{_tint_hex(2)} AS f,{_tint_hex(3)} AS w FROM o_keys) SELECT id,"
        + ",".join(f"{_hexch(p, at)} AS {p}_{c}" for p in "gfw" for c, at in zip("rgb", (2, 4, 6)))
        + ",255 AS g_a,255 AS f_a,255 AS w_a FROM t",
    ),
    "f21_legacy_biome": oracle("fx_blocks", f"SELECT id,{_LEG} AS biome FROM fx_blocks"),
    "f22_water_depth": oracle("o_render", "SELECT dimension,x,z,CASE WHEN water THEN greatest(0,water_y-height) ELSE 0 END AS depth,ry AS render_y FROM o_render"),
    "f23_camera_axes": oracle(
        "fx_blocks",
        "SELECT id,"
        + ",".join(
            f"{a} AS {c}_a,{b} AS {c}_b,true AS {c}_ok,({a})+({b}) AS {c}_depth,z AS {c}_z"
            for c, a, b in (("se", "x", "z"), ("sw", "z", "-x"), ("nw", "-x", "-z"), ("ne", "-z", "x"))
        )
        + " FROM fx_blocks",
    ),
    "f24_projection": oracle(
        "fx_blocks",
        f", p AS (SELECT id,x,y,z,zoom,CAST(z+x AS DOUBLE) AS u,(z-x)*0.5e0-(y+1) AS v,{_SPANF} AS sp FROM fx_blocks) "
        f"SELECT id,u,v,x AS flat_x,z AS flat_z,{fl('u/sp')} AS tile_x,{fl('v/sp')} AS tile_y,floor(u/sp)*sp AS u0,floor(v/sp)*sp+sp AS v1,1.0e0+greatest(y-20,0) AS sprite FROM p",
    ),
    "f25_footprints": oracle(
        "fx_blocks",
        f", t AS (SELECT id,zoom,{fl('x/512.0')} AS tx,{fl('z/512.0')} AS ty,CAST({_SPAN} AS DOUBLE) AS sp FROM fx_blocks), "
        "b AS (SELECT *,tx*sp AS u0,ty*sp AS v0,tx*sp+sp AS u1,ty*sp+sp AS v1 FROM t), "
        "r AS (SELECT *,u0*0.5e0+v0+0-1 AS a0,u1*0.5e0+v1+64+1 AS a1,-u1*0.5e0+v0+0-1 AS b0,-u0*0.5e0+v1+64+1 AS b1 FROM b) "
        f"SELECT id,{fl('-a1')} AS wx0,{fl('-b1')} AS wz0,{_int('ceil(-a0)')}+1 AS wx1,{_int('ceil(-b0)')}+1 AS wz1,"
        # north-east camera: a=-z, b=x, so u=-z-x and v=(x-z)/2-y over the chunk's corners
        "CAST(-(ty*16+16)-(tx*16+16)-1 AS DOUBLE) AS u0,((tx*16)-(ty*16+16))*0.5e0-321-1 AS v0,CAST(-ty*16-tx*16+1 AS DOUBLE) AS u1,((tx*16+16)-ty*16)*0.5e0+64+1 AS v1 FROM r",
    ),
    "f26_height_percent": oracle("fx_blocks", "SELECT id,(y+64)/384.0e0 AS t,CAST(y-5 AS DOUBLE) AS flat FROM fx_blocks"),
    "f29_owner_color": oracle(
        "fx_markers",
        ", n AS (SELECT DISTINCT name FROM fx_markers), h AS (SELECT name,list_reduce(list_prepend(CAST(0 AS BIGINT),list_transform(string_split(name,''),lambda c: CAST(ascii(c) AS BIGINT))),lambda a,b: (a*31+b)%4294967296) AS h FROM n) "
        f"SELECT name,h,({fx._arr(C.OWNER_COLORS)})[CAST(h%10+1 AS INTEGER)] AS color FROM h",
    ),
    "f30_nice_scale": oracle(
        "fx_blocks",
        ", b AS (SELECT id,x/7.0e0 AS v FROM fx_blocks), s AS (SELECT id,v,CASE WHEN v>0 THEN pow(10.0e0,floor(log10(v))) END AS base FROM b) "
        "SELECT id,CASE WHEN v<=0 THEN 1.0e0 ELSE (CASE WHEN v/base<1.5e0 THEN 1.0e0 WHEN v/base<3.5e0 THEN 2.0e0 WHEN v/base<7.5e0 THEN 5.0e0 ELSE 10.0e0 END)*base END AS step FROM s",
    ),
    "f31_shortest_turn": oracle(
        "fx_blocks",
        f", t AS (SELECT id,(z-x)/8.0e0+180 AS e FROM fx_blocks), m AS (SELECT id,e-360*floor(e/360)-180 AS d FROM t) SELECT id,{_D} AS turn FROM m",
    ),
    "f32_enum_parsers": "SELECT o_orderkey AS id,"
    f"CASE WHEN {_pick(STYLE_WORDS, 'o_orderkey', 8)} IN ('terrain','biome','height','light','ore','contour') THEN {_pick(STYLE_WORDS, 'o_orderkey', 8)} ELSE 'terrain' END AS style,"
    f"CASE WHEN lower({_pick(MODE_WORDS, 'o_orderkey', 4)})='iso' THEN 'iso' ELSE 'top' END AS mode,"
    f"CASE {_pick(CAMERA_WORDS, 'o_orderkey', 6)} WHEN 'SW' THEN 'sw' WHEN 'north_west' THEN 'nw' WHEN 'ne' THEN 'ne' ELSE 'se' END AS camera,"
    f"({fx._arr(('grass', 'foliage', 'water', 'dry', 'none'))})[CAST(o_orderkey%5+1 AS INTEGER)] AS tint FROM orders",
    "f33_position_label": oracle(
        "fx_positions",
        "SELECT event_id,'X: '||CAST(floor(x) AS BIGINT)||'   Y: '||CAST(floor(rotation) AS BIGINT)||'   Z: '||CAST(floor(z) AS BIGINT) AS with_y,"
        "'X: '||CAST(floor(x) AS BIGINT)||'   Z: '||CAST(floor(z) AS BIGINT) AS flat FROM fx_positions",
    ),
    "p1_bounds_filter": oracle("o_columns", "SELECT dimension,x,z,height FROM o_columns WHERE x>=-20 AND x<15 AND z>=-33 AND z<40"),
    "p2_bounds_algebra": oracle(
        "fx_viewports fx_areas",
        ", p AS (SELECT v.*,a.id,a.min_x AS ax0,a.min_z AS az0,a.max_x AS ax1,a.max_z AS az1 FROM fx_viewports v JOIN fx_areas a ON a.id%100=v.view_id) "
        "SELECT view_id,id,min_x<ax1 AND ax0<max_x AND min_z<az1 AND az0<max_z AS meets,greatest(min_x,ax0) AS ix0,greatest(min_z,az0) AS iz0,least(max_x,ax1) AS ix1,least(max_z,az1) AS iz1,"
        "(least(max_x,ax1)<=greatest(min_x,ax0) OR least(max_z,az1)<=greatest(min_z,az0)) AS meet_empty,min_x-16 AS ex0,min_z-16 AS ez0,max_x+16 AS ex1,max_z+16 AS ez1,max_x-min_x AS width,max_z-min_z AS height FROM p",
    ),
    "p7_slice_level": oracle("fx_blocks", "SELECT id,CASE WHEN id%9=0 OR y>=200 THEN NULL ELSE greatest(y,-40) END AS slice_y FROM fx_blocks"),
    "p9_generation_status": f"SELECT status,count(*) AS n FROM (SELECT {_pick(STATUS_WORDS, 'o_orderkey', len(STATUS_WORDS))} AS status FROM orders) WHERE status NOT IN ('minecraft:noise','carvers','empty') GROUP BY 1",
    "p11_request_guards": oracle(
        "fx_blocks",
        f", r AS (SELECT id,zoom,id*40503%3000001-1500000 AS tx,id%77-30 AS ty,id%5*700000-10 AS w,id%160 AS chunks,id%1100 AS heights,id%30000 AS lim,{_SPAN} AS sp FROM fx_blocks), "
        "g AS (SELECT id,lim,CASE WHEN abs(tx)>floor(40000000.0/sp)+2 OR abs(ty)>floor(40000000.0/sp)+2 THEN 'tile index' WHEN w<0 THEN 'inverted bounds' WHEN w>2000000 THEN 'span' WHEN chunks>144 THEN 'selection' WHEN heights>1024 THEN 'heights' END AS reason FROM r) "
        "SELECT id,reason IS NULL AS valid,reason,CAST(least(lim,20000) AS INTEGER) AS effective_limit FROM g",
    ),
    "p12_world_border": oracle(
        "fx_positions fx_dims",
        "SELECT p.event_id,p.dimension,p.x,p.z FROM fx_positions p JOIN (SELECT *,CASE WHEN border>0 THEN border ELSE 4000 END/2.0 AS half FROM fx_dims) d USING (dimension) "
        "WHERE p.x>=center_x-half AND p.x<center_x+half AND p.z>=center_z-half AND p.z<center_z+half",
    ),
    "a25_cover_count": oracle(
        "fx_areas",
        ", z AS (SELECT unnest(range(0,11)) AS zoom), s AS (SELECT id,CAST(zoom AS INTEGER) AS zoom,CAST(1<<CAST(15-zoom AS INTEGER) AS DOUBLE) AS sp,min_x,min_z,max_x,max_z FROM fx_areas,z) "
        "SELECT id,zoom,CAST((floor((max_x-1)/sp)-floor(min_x/sp)+1)*(floor((max_z-1)/sp)-floor(min_z/sp)+1) AS BIGINT) AS tiles FROM s",
    ),
}

ORACLE["x3_sql_tiles_covering"] = ORACLE["f4_tiles_covering"]
