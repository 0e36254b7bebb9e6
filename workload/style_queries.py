"""Column colours, plan tiles and pyramids (R1-R3, W1, W2, A10, A11, A20, A21, A24, P10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.functions import color as C
from voxelspark.functions import grid
from voxelspark.plans import pyramid, style

from . import sqlcolor as q
from . import views as fx
from .surface_queries import columns
from .views import define, oracle

CONTOUR = style.StyleOptions(contour=True, contour_interval=8)
UNEXPLORED = C.UNEXPLORED


def colors(spark, sf, name="terrain", options=style.StyleOptions()):
    return style.column_colors(
        columns(spark, sf), fx.palette(spark), fx.biomes(spark), fx.dimensions(spark), name, options
    )


define(
    "o_near",
    ("o_render", "fx_palette", "fx_biomes", "fx_dims"),
    "SELECT c.*, d.min_y, d.max_y, n.ry AS north, w.ry AS west, b.r AS b_r, b.g AS b_g, b.b AS b_b, b.a AS b_a, b.tint AS b_tint, "
    "p.r AS p_r, p.g AS p_g, p.b AS p_b, p.a AS p_a, p.tint AS p_tint, o.*, "
    "CASE WHEN c.water THEN greatest(0,c.water_y-c.height) ELSE 0 END AS depth FROM o_render c "
    "LEFT JOIN o_render n ON n.dimension=c.dimension AND n.x=c.x AND n.z=c.z-1 "
    "LEFT JOIN o_render w ON w.dimension=c.dimension AND w.x=c.x-1 AND w.z=c.z "
    "JOIN fx_palette b ON b.id=c.block_id LEFT JOIN fx_palette p ON p.id=c.decoration_id "
    "JOIN (SELECT id AS bid, * EXCLUDE (id,name) FROM fx_biomes) o ON o.bid=c.biome_id JOIN fx_dims d ON d.dimension=c.dimension",
)
_MEAN = (
    "(CASE WHEN north IS NOT NULL AND west IS NOT NULL THEN ((ry-north)+(ry-west))/2.0e0 "
    "WHEN north IS NOT NULL THEN CAST(ry-north AS DOUBLE) WHEN west IS NOT NULL THEN CAST(ry-west AS DOUBLE) ELSE 0.0e0 END)"
)
_STEP = f"(greatest(-3.0e0,least(3.0e0,{_MEAN}))/3.0e0)"
_AMBIENT = "(CAST(ry-min_y AS DOUBLE)/greatest(1,max_y-min_y)*0.1e0+(1-0.1e0*0.5e0))"
RELIEF = f"((sign({_STEP})*sqrt(abs({_STEP}))*0.35e0+1)*{_AMBIENT})"


def _channels(make, names=q.RGB):
    return ", ".join(f"{make(i, ch)} AS {ch}" for i, ch in enumerate(names))


define(
    "o_tinted",
    ("o_near",),
    "SELECT *, " + RELIEF + " AS relief, "
    + ", ".join(f"{q.tint(f'b_{ch}', ch, 'b_tint')} AS t_{ch}, {q.tint(f'p_{ch}', ch, 'p_tint')} AS q_{ch}" for ch in q.RGB)
    + " FROM o_near",
)
define(
    "o_terrain",
    ("o_tinted",),
    "SELECT *, " + ", ".join(f"CASE WHEN water THEN {q.water(f't_{ch}', f'wa_{ch}', 'depth')} ELSE t_{ch} END AS g_{ch}" for ch in q.RGB)
    + " FROM o_tinted",
)
_T = "(CAST(ry-min_y AS DOUBLE)/greatest(1,max_y-min_y))"
BASE = {
    "terrain": lambda i, ch: f"g_{ch}",
    "biome": lambda i, ch: f"ov_{ch}",
    "height": lambda i, ch: q.gradient(_T, i),
    "light": lambda i, ch: q.light_style("block_light", i),
    "ore": lambda i, ch: q.ore_style(q.desaturate(f"g_{ch}", "g_r", "g_g", "g_b"), "ore_best", "ore_score", i),
}
# Base alpha is the block's own, except in the styles with opaque ramps.
BASE_A = {"terrain": "(CASE WHEN water THEN CASE WHEN depth=0 THEN b_a ELSE 255 END ELSE b_a END)"}
for _s, _make in BASE.items():
    define(
        f"o_base_{_s}",
        ("o_terrain",),
        "SELECT *, " + ", ".join(f"{_make(i, ch)} AS s_{ch}" for i, ch in enumerate(q.RGB)) + ", 255 AS s_a FROM o_terrain",
    )
    define(
        f"o_color_{_s}",
        (f"o_base_{_s}",),
        "SELECT dimension,x,z,"
        + _channels(
            lambda i, ch: q.clamp8(
                f"(CASE WHEN decoration_id IS NULL THEN s_{ch} ELSE {q.over(f'q_{ch}', f's_{ch}', 'p_a')} END)*relief"
            )
        )
        + f", CASE WHEN decoration_id IS NULL THEN s_a ELSE {q.over_alpha('p_a', 's_a')} END AS a FROM o_base_{_s}",
    )


def _cross(n: str) -> str:
    here, there = "floor(ry/8.0e0)", f"floor({n}/8.0e0)"
    return (
        f"(CASE WHEN {n} IS NULL OR {here}={there} THEN 0 WHEN CAST(least({here},{there})+1 AS INTEGER)%4=0 THEN 2 ELSE 1 END)"
    )


define("o_lines", ("o_near",), f"SELECT *, greatest({_cross('north')},{_cross('west')}) AS line FROM o_near")
define(
    "o_color_contour",
    ("o_lines",),
    "SELECT dimension,x,z,"
    + ", ".join(
        f"CASE WHEN line=2 THEN {C.CONTOUR_MAJOR[i]} ELSE {C.CONTOUR_MINOR[i]} END AS {ch}" for i, ch in enumerate("rgba")
    )
    + " FROM o_lines WHERE line>0",
)
define("o_base", ("o_color_terrain",), "SELECT dimension, 6 AS zoom, x AS gx, z AS gy, r,g,b,a FROM o_color_terrain")
for _z in range(5, 1, -1):
    define(
        f"o_level{_z}",
        ("o_base" if _z == 5 else f"o_level{_z + 1}",),
        f"SELECT dimension, {_z} AS zoom, CAST(floor(gx/2.0) AS INTEGER) AS gx, CAST(floor(gy/2.0) AS INTEGER) AS gy, "
        + ", ".join(
            f"CAST(floor((sum({ch})+(4-count(*))*{f}+2)/4) AS INTEGER) AS {ch}" for ch, f in zip("rgba", UNEXPLORED)
        )
        + f" FROM {'o_base' if _z == 5 else f'o_level{_z + 1}'} GROUP BY 1,2,3,4",
    )
define(
    "o_pyramid",
    ("o_base", "o_level2"),
    " UNION ALL ".join(["SELECT * FROM o_base"] + [f"SELECT * FROM o_level{z}" for z in range(5, 1, -1)]),
)
TILED = (
    "CAST(floor(gx/512.0) AS INTEGER) AS tile_x, CAST(floor(gy/512.0) AS INTEGER) AS tile_y, "
    "CAST(((gx%512)+512)%512 AS INTEGER) AS px, CAST(((gy%512)+512)%512 AS INTEGER) AS py"
)


def relief_rows(spark, sf):
    from voxelspark.operators.neighbours import with_neighbours
    from voxelspark.operators.surface import render_y

    c = columns(spark, sf).withColumn("ry", render_y()).join(fx.dimensions(spark), "dimension")
    return with_neighbours(c, {"north": ("z", -1, "ry"), "west": ("x", -1, "ry")})


def q_blank(spark, sf):
    """4 x 4 pixel tiles of an ore raster, repainted as unexplored in the west."""
    p = pyramid.averaged_pixels(colors(spark, sf, "ore"), 3)
    dark = F.col("gx") < -4
    p = p.withColumns({c: F.when(dark, F.lit(f)).otherwise(F.col(c)) for c, f in zip("rgba", UNEXPLORED)})
    t = p.withColumns(
        {"tile_x": grid.floor_div("gx", 4), "tile_y": grid.floor_div("gy", 4), "px": grid.floor_mod("gx", 4), "py": grid.floor_mod("gy", 4)}
    ).drop("gx", "gy")
    return pyramid.drop_blank(t, UNEXPLORED)


def base_errors(spark, sf):
    e = fx.blocks_xz(spark, sf).filter("y % 50 = 0")
    return e.select(
        F.lit(fx.DIM).alias("dimension"), F.lit(6).alias("zoom"), grid.floor_div("x", 512).alias("tile_x"),
        grid.floor_div("z", 512).alias("tile_y"), F.lit(1).alias("errors"),
    )


def q_incomplete(spark, sf):
    errors = pyramid.tile_errors(base_errors(spark, sf), 4)
    tiles = fx.blocks_xz(spark, sf).select(
        F.lit(fx.DIM).alias("dimension"), F.explode(F.sequence(F.lit(2), F.lit(6))).alias("zoom"), "x", "z"
    )
    tiles = tiles.select(
        "dimension", "zoom", grid.block_to_tile("x", F.col("zoom")).alias("tile_x"),
        grid.block_to_tile("z", F.col("zoom")).alias("tile_y"),
    ).distinct()
    return pyramid.complete_tiles(tiles, errors)


QUERIES = {
    "r1_terrain_color": lambda s, sf: colors(s, sf),
    "r1_biome_color": lambda s, sf: colors(s, sf, "biome"),
    "r1_height_color": lambda s, sf: colors(s, sf, "height"),
    "r1_light_color": lambda s, sf: colors(s, sf, "light"),
    "r1_ore_color": lambda s, sf: colors(s, sf, "ore"),
    "r1_contour_color": lambda s, sf: colors(s, sf, "contour", CONTOUR),
    "w1_relief_factor": lambda s, sf: relief_rows(s, sf).select(
        "dimension", "x", "z", F.floor(style.relief_factor(style.StyleOptions()) * 1000000 + 0.3).alias("relief_ppm")
    ),
    "w2_contour_crossing": lambda s, sf: relief_rows(s, sf).select(
        "dimension", "x", "z", style.contour_class(CONTOUR).alias("line")
    ),
    "r2_plan_tiles": lambda s, sf: pyramid.with_tiles(pyramid.base_pixels(colors(s, sf))),
    "r2_magnified_tiles": lambda s, sf: pyramid.with_tiles(pyramid.magnified_pixels(colors(s, sf), 7)),
    "a10_averaged_pixels": lambda s, sf: pyramid.averaged_pixels(colors(s, sf), 4),
    "a10_contour_pixels": lambda s, sf: pyramid.averaged_pixels(colors(s, sf, "contour", CONTOUR), 4, True),
    "a11_composite": lambda s, sf: pyramid.composite(pyramid.base_pixels(colors(s, sf)), UNEXPLORED),
    "r3_pyramid": lambda s, sf: pyramid.build_pyramid(pyramid.base_pixels(colors(s, sf)), UNEXPLORED, 4),
    "p10_blank_tiles": q_blank,
    "a20_tile_errors": lambda s, sf: pyramid.tile_errors(base_errors(s, sf), 4),
    "a20_complete_tiles": q_incomplete,
    "a21_any_present": lambda s, sf: columns(s, sf)
    .groupBy("dimension", grid.floor_div("x", 32).alias("tile_x"), grid.floor_div("z", 32).alias("tile_y"))
    .agg(F.bool_or("present").alias("any_present")),
    "a24_style_classes": lambda s, sf: pyramid.style_classes(columns(s, sf), 10),
}

_DARK = "gx<-4"
ORACLE = {
    **{f"r1_{n}_color": oracle(f"o_color_{n}", f"SELECT dimension,x,z,r,g,b,a FROM o_color_{n}") for n in (*BASE, "contour")},
    "w1_relief_factor": oracle("o_near", f"SELECT dimension,x,z,CAST(floor({RELIEF}*1000000+0.3e0) AS BIGINT) AS relief_ppm FROM o_near"),
    "w2_contour_crossing": oracle("o_lines", "SELECT dimension,x,z,line FROM o_lines"),
    "r2_plan_tiles": oracle("o_base", f"SELECT dimension,zoom,{TILED},r,g,b,a FROM o_base"),
    "r2_magnified_tiles": oracle(
        "o_base",
        f"SELECT dimension,7 AS zoom,{TILED},r,g,b,a FROM (SELECT dimension,gx*2+dx AS gx,gy*2+dy AS gy,r,g,b,a FROM o_base, (VALUES (0),(1)) t(dx), (VALUES (0),(1)) s(dy))",
    ),
    "a10_averaged_pixels": oracle(
        "o_color_terrain",
        "SELECT dimension,4 AS zoom,CAST(floor(x/4.0) AS INTEGER) AS gx,CAST(floor(z/4.0) AS INTEGER) AS gy,"
        + ",".join(f"CAST(floor(sum({c})/count(*)) AS INTEGER) AS {c}" for c in "rgb")
        + ",255 AS a FROM o_color_terrain GROUP BY 1,2,3,4",
    ),
    "a10_contour_pixels": oracle(
        "o_color_contour",
        "SELECT dimension,4 AS zoom,CAST(floor(x/4.0) AS INTEGER) AS gx,CAST(floor(z/4.0) AS INTEGER) AS gy,"
        + ",".join(f"CAST(floor(sum({c})/count(*)) AS INTEGER) AS {c}" for c in "rgba")
        + " FROM o_color_contour GROUP BY 1,2,3,4",
    ),
    "a11_composite": oracle("o_level5", "SELECT * FROM o_level5"),
    "r3_pyramid": oracle("o_pyramid", "SELECT * FROM o_pyramid"),
    "p10_blank_tiles": oracle(
        "o_color_ore",
        ", p AS (SELECT dimension,3 AS zoom,CAST(floor(x/8.0) AS INTEGER) AS gx,CAST(floor(z/8.0) AS INTEGER) AS gy,"
        + ",".join(f"CAST(floor(sum({c})/count(*)) AS INTEGER) AS {c}" for c in "rgb")
        + " FROM o_color_ore GROUP BY 1,2,3,4), "
        "t AS (SELECT dimension,zoom,CAST(floor(gx/4.0) AS INTEGER) AS tile_x,CAST(floor(gy/4.0) AS INTEGER) AS tile_y,((gx%4)+4)%4 AS px,((gy%4)+4)%4 AS py,"
        + ",".join(f"CASE WHEN {_DARK} THEN {f} ELSE {c} END AS {c}" for c, f in zip("rgb", UNEXPLORED))
        + ",255 AS a FROM p) SELECT * FROM t WHERE (tile_x,tile_y) IN (SELECT (tile_x,tile_y) FROM t WHERE NOT (r=20 AND g=22 AND b=26))",
    ),
    "a20_tile_errors": oracle(
        "fx_blocks",
        " UNION ALL ".join(
            f"SELECT 'overworld' AS dimension,{z} AS zoom,CAST(floor(x/{512 << (6 - z)}.0) AS INTEGER) AS tile_x,CAST(floor(z/{512 << (6 - z)}.0) AS INTEGER) AS tile_y,count(*) AS errors "
            "FROM fx_blocks WHERE y%50=0 GROUP BY 1,2,3,4"
            for z in range(6, 1, -1)
        ),
    ),
    "a20_complete_tiles": oracle(
        "fx_blocks",
        "SELECT * FROM ("
        + " UNION ALL ".join(
            f"SELECT 'overworld' AS dimension,{z} AS zoom,CAST(floor(x/{512 << (6 - z)}.0) AS INTEGER) AS tile_x,CAST(floor(z/{512 << (6 - z)}.0) AS INTEGER) AS tile_y "
            "FROM fx_blocks GROUP BY 1,2,3,4 HAVING count(*) FILTER (y%50=0)=0"
            for z in range(6, 1, -1)
        )
        + ")",
    ),
    "a21_any_present": oracle(
        "o_columns",
        "SELECT dimension,CAST(floor(x/32.0) AS INTEGER) AS tile_x,CAST(floor(z/32.0) AS INTEGER) AS tile_y,bool_or(present) AS any_present FROM o_columns GROUP BY 1,2,3",
    ),
    "a24_style_classes": oracle(
        "o_columns",
        "SELECT dimension,10 AS zoom,CAST(floor(x/32.0) AS INTEGER) AS tile_x,CAST(floor(z/32.0) AS INTEGER) AS tile_y,count(*) AS explored,"
        "count(*) FILTER (water) AS wet,count(*) FILTER (block_light<=0) AS dark,count(*) FILTER (block_light BETWEEN 1 AND 7) AS dim,"
        "count(*) FILTER (block_light>=8) AS lit,count(*) FILTER (ore_score>0) AS ore FROM o_columns GROUP BY 1,2,3,4",
    ),
}
