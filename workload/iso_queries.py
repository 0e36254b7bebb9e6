"""Isometric views and ray picks (ids J9-J11, J14, J18, R4-R6, W4, W5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.operators import changes, rays, surface
from voxelspark.plans import isometric, pyramid

from . import sqlcolor as q
from . import views as fx
from .surface_queries import columns, placed_slabs, slabs
from .style_queries import UNEXPLORED
from .views import define, oracle

# Ray candidates by the closed form of the ray's interval in each column (south-east).
define(
    "o_ray_queries",
    ("fx_rays", "fx_dims"),
    "SELECT r.*,d.min_y,d.max_y,u/2.0e0 AS du,v+max_y+1 AS shi,v+min_y AS slo,floor(u) AS k0,ceil(u) AS k1 FROM fx_rays r JOIN fx_dims d USING (dimension)",
)
_INSIDE = (
    "greatest(x-du,z+du) AS lo,least(x+1-du,z+1+du) AS hi,(x=floor(shi+du) AND z=floor(shi-du)) AS first"
)
_REACHED = "(first OR (hi>lo AND lo<shi AND hi>slo))"
define(
    "o_column_hits",
    ("o_ray_queries", "o_render"),
    f"SELECT qid,dimension,x,ry AS y,z FROM (SELECT *,row_number() OVER (PARTITION BY qid ORDER BY lo DESC) AS rn FROM ("
    f"SELECT q.*,c.x,c.z,c.ry,{_INSIDE} FROM o_ray_queries q JOIN o_render c ON c.dimension=q.dimension AND (c.x-c.z=q.k0 OR c.x-c.z=q.k1)) "
    f"WHERE {_REACHED} AND ry+1>=greatest(lo-v,min_y)) WHERE rn=1",
)
define(
    "o_voxel_hits",
    ("o_ray_queries", "o_slabs", "fx_palette"),
    f"SELECT qid,dimension,x,y,z,block_id,light FROM (SELECT *,row_number() OVER (PARTITION BY qid ORDER BY lo DESC,y DESC) AS rn FROM ("
    f"SELECT q.*,s.x,s.y,s.z,s.block_id,s.light,{_INSIDE} FROM o_ray_queries q JOIN o_slabs s ON s.dimension=q.dimension AND (s.x-s.z=q.k0 OR s.x-s.z=q.k1) JOIN fx_palette p ON p.id=s.block_id AND p.occludes) "
    f"WHERE {_REACHED} AND y>=floor(greatest(lo-v,min_y)) AND y<=ceil(CASE WHEN first THEN max_y+1.0e0 ELSE hi-v END)-1) WHERE rn=1",
)
define(
    "o_faces",
    ("o_slabs", "fx_palette"),
    "SELECT s.dimension,s.x,s.y,s.z,NOT coalesce(u.h,false) AS top_face,NOT coalesce(l.h,false) AS left_face,NOT coalesce(r.h,false) AS right_face FROM o_slabs s "
    + " ".join(
        f"LEFT JOIN (SELECT dimension,x,y,z,occludes AND height>=1 AS h FROM o_slabs JOIN fx_palette p ON p.id=block_id) {n} ON {n}.dimension=s.dimension AND {n}.x=s.x+{dx} AND {n}.y=s.y+{dy} AND {n}.z=s.z+{dz}"
        for n, dx, dy, dz in (("u", 0, 1, 0), ("l", 0, 0, 1), ("r", 1, 0, 0))
    ),
)
define(
    "o_exposed",
    ("o_render",),
    "SELECT c.*,CASE WHEN l.ry IS NULL THEN 4 ELSE greatest(0,c.ry-l.ry) END AS left_depth,CASE WHEN r.ry IS NULL THEN 4 ELSE greatest(0,c.ry-r.ry) END AS right_depth FROM o_render c "
    "LEFT JOIN o_render l ON l.dimension=c.dimension AND l.x=c.x AND l.z=c.z+1 LEFT JOIN o_render r ON r.dimension=c.dimension AND r.x=c.x+1 AND r.z=c.z",
)


def _shaded(ch: str, f: str) -> str:
    return q.clamp8(f"(CASE face WHEN 0 THEN top_{ch} ELSE side_{ch} END)*(CASE face WHEN 0 THEN 1.0e0 WHEN 1 THEN 0.82e0 ELSE 0.68e0 END)")


define(
    "o_iso_faces",
    ("o_exposed", "o_base_terrain", "o_color_terrain"),
    "SELECT e.dimension,e.x,e.z,e.ry,left_depth,right_depth,"
    + ",".join(f"c.{ch} AS top_{ch},{q.clamp8(f'b.s_{ch}*b.relief')} AS side_{ch}" for ch in "rgb")
    + ",c.a AS top_a FROM o_exposed e JOIN o_color_terrain c ON c.dimension=e.dimension AND c.x=e.x AND c.z=e.z JOIN o_base_terrain b ON b.dimension=e.dimension AND b.x=e.x AND b.z=e.z",
)
# zoom 7: two pixels per unit, a diamond of 4 x 2 with rows [1..0],[0..1],[0..1],[1..0]
define(
    "o_iso_cells",
    ("o_iso_faces",),
    "SELECT *,(x-z-1)*2+i AS gx,(x+z)-(ry+1)*2+j AS gy,CASE WHEN j<=hi THEN 0 WHEN i<2 THEN 1 ELSE 2 END AS face FROM ("
    "SELECT *,unnest(range(lo,hi+1+CASE WHEN i<2 THEN left_depth*2 ELSE right_depth*2 END)) AS j FROM (SELECT f.*,t.* FROM o_iso_faces f,(VALUES (0,1,0),(1,0,1),(2,0,1),(3,1,0)) t(i,lo,hi)))",
)
define(
    "o_iso_pixels",
    ("o_iso_cells",),
    "SELECT dimension,7 AS zoom,CAST(gx AS INTEGER) AS gx,CAST(gy AS INTEGER) AS gy,"
    + ",".join(f"{_shaded(ch, 'face')} AS {ch}" for ch in "rgb")
    + ",CASE face WHEN 0 THEN top_a ELSE 255 END AS a FROM (SELECT *,row_number() OVER (PARTITION BY dimension,gx,gy ORDER BY x+z DESC) AS rn FROM o_iso_cells) WHERE rn=1",
)

for _z in (6, 5, 4):
    _from = "o_iso_pixels" if _z == 6 else f"o_iso_level{_z + 1}"
    define(
        f"o_iso_level{_z}",
        (_from,),
        f"SELECT dimension,{_z} AS zoom,CAST(floor(gx/2.0) AS INTEGER) AS gx,CAST(floor(gy/2.0) AS INTEGER) AS gy,"
        + ",".join(f"CAST(floor((sum({c})+(4-count(*))*{f}+2)/4) AS INTEGER) AS {c}" for c, f in zip("rgba", UNEXPLORED))
        + f" FROM {_from} GROUP BY 1,2,3,4",
    )
# Voxel mode: every visible face of every slab voxel, plants painted on the voxel below.
define(
    "o_vox",
    ("o_slabs", "o_faces", "o_tinted", "fx_palette"),
    "SELECT s.dimension,s.x,s.y,s.z,s.top_y-s.depth+1 AS floor_y,b.decoration AS is_plant,b.water AS wet,b.a AS b_a,CASE WHEN b.height>0 AND b.height<=1 THEN b.height ELSE 1.0e0 END AS h,f.top_face,f.left_face,f.right_face,"
    "s.y=s.top_y-CASE WHEN pl.id IS NULL THEN 0 ELSE 1 END AS is_top,pl.id AS plant,c.relief,c.depth,"
    + ",".join(f"{q.tint(f'b.{ch}', ch, 'b.tint', 'c.')} AS v_{ch},{q.tint(f'pl.{ch}', ch, 'pl.tint', 'c.')} AS p_{ch},c.wa_{ch}" for ch in q.RGB)
    + ",pl.a AS p_a FROM o_slabs s JOIN o_faces f USING (dimension,x,y,z) JOIN fx_palette b ON b.id=s.block_id JOIN o_tinted c ON c.dimension=s.dimension AND c.x=s.x AND c.z=s.z "
    "LEFT JOIN (SELECT t.dimension,t.x,t.z,p.* FROM o_slabs t JOIN fx_palette p ON p.id=t.block_id AND p.decoration WHERE t.y=t.top_y) pl ON pl.dimension=s.dimension AND pl.x=s.x AND pl.z=s.z",
)
define(
    "o_vox_base",
    ("o_vox",),
    "SELECT *," + ",".join(f"CASE WHEN wet THEN {q.water(f'v_{ch}', f'wa_{ch}', 'depth')} ELSE v_{ch} END AS side_{ch}" for ch in q.RGB) + " FROM o_vox",
)
define(
    "o_vox_color",
    ("o_vox_base",),
    "SELECT *,"
    + ",".join(
        f"(CASE WHEN is_top AND top_face AND plant IS NOT NULL THEN {q.over(f'p_{ch}', lit, 'p_a')} ELSE {lit} END) AS top_{ch}"
        for ch, lit in ((ch, q.clamp8(f"side_{ch}*CASE WHEN is_top THEN relief ELSE 1.0e0 END")) for ch in q.RGB)
    )
    + " FROM o_vox_base",
)
define(
    "o_vox_cells",
    ("o_vox_color", "o_render"),
    "SELECT dimension,(x-z-1)*2+i AS gx,y0+j AS gy,rank,CASE WHEN j<=hi THEN 255 ELSE b_a END AS a,"
    + ",".join(f"CASE WHEN j<=hi THEN top_{ch} ELSE {q.clamp8(f'side_{ch}*CASE WHEN i<2 THEN 0.82e0 ELSE 0.68e0 END')} END AS {ch}" for ch in q.RGB)
    + " FROM (SELECT *,unnest(range(CASE WHEN tf THEN lo ELSE hi+1 END,hi+1+CAST(CASE WHEN i<2 THEN lw ELSE rw END AS INTEGER))) AS j FROM ("
    "SELECT *,floor(((x+z)*0.5e0-(y+h))*2+0.5e0) AS y0,top_face AS tf,CASE WHEN left_face THEN greatest(1,floor(h*2+0.5e0)) ELSE 0 END AS lw,CASE WHEN right_face THEN greatest(1,floor(h*2+0.5e0)) ELSE 0 END AS rw,(x+z)*100000+y AS rank FROM o_vox_color WHERE NOT is_plant AND (top_face OR left_face OR right_face) "
    "UNION ALL SELECT v.*,(v.x+v.z)-(v.y+1)*2,false,CASE WHEN l.ry IS NULL THEN 4 ELSE greatest(0,v.y-l.ry) END*2,CASE WHEN r.ry IS NULL THEN 4 ELSE greatest(0,v.y-r.ry) END*2,(v.x+v.z)*100000+50000 FROM o_vox_color v "
    "LEFT JOIN o_render l ON l.dimension=v.dimension AND l.x=v.x AND l.z=v.z+1 LEFT JOIN o_render r ON r.dimension=v.dimension AND r.x=v.x+1 AND r.z=v.z WHERE v.y=v.floor_y), (VALUES (0,1,0),(1,0,1),(2,0,1),(3,1,0)) t(i,lo,hi))",
)


def _tables(spark):
    return fx.palette(spark), fx.biomes(spark), fx.dimensions(spark)


def height_view(spark, sf, **how):
    return isometric.height_field_view(columns(spark, sf), *_tables(spark), **how)


ROWS_A_PARTITION = 250_000


def voxel_view(spark, sf, **how):
    """The world is placed by chunk once; its columns and slabs are made there without another shuffle."""
    rows = fx.table(spark, sf, "lineitem").count()
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), rows // ROWS_A_PARTITION)
    v, pal = fx.voxels(spark, sf, n), fx.palette(spark)
    seen = surface.surface_scan(v, pal, fx.placed(fx.sections(spark, sf), n))
    return isometric.voxel_view(placed_slabs(v, pal), seen, *_tables(spark), partitions=n, **how)


def q_contributing(spark, sf):
    """How many explored columns each affected zoom-9 tile may draw from."""
    chunks = fx.marks(spark, sf).select(F.lit(fx.DIM).alias("dimension"), (F.col("chunk_x") - 3).alias("chunk_x"), (F.col("chunk_z") - 3).alias("chunk_z"))
    tiles = changes.affected_tiles(chunks, 9, 9, modes=("iso",), min_y=0, max_y=63)
    tiles = tiles.withColumn("tile_id", F.concat_ws("_", "tile_x", "tile_y"))
    seen = surface.height_range(columns(spark, sf)).withColumn("depth", F.lit(0))
    band = surface.height_band(seen, fx.dimensions(spark), margin=8)
    return surface.window_sums(columns(spark, sf), isometric.contributing_windows(tiles, band, "nw", 40), "height")


def q_pyramid(spark, sf):
    return pyramid.build_pyramid(height_view(spark, sf), UNEXPLORED, 3)


QUERIES = {
    "j9_face_exposure": lambda s, sf: isometric.face_exposure(slabs(s, sf), fx.palette(s)).select("dimension", "x", "y", "z", "top_face", "left_face", "right_face"),
    "j10_height_rays": lambda s, sf: rays.pick_columns(fx.rays(s, sf), columns(s, sf), fx.dimensions(s)),
    "j11_voxel_rays": lambda s, sf: rays.pick_voxels(fx.rays(s, sf), slabs(s, sf), fx.palette(s), fx.dimensions(s)),
    "j14_pick": lambda s, sf: rays.pick(fx.rays(s, sf), slabs(s, sf), columns(s, sf), *_tables(s)),
    "j18_draw_list": lambda s, sf: isometric.draw_list(columns(s, sf), 8, "ne"),
    "w4_exposed_depth": lambda s, sf: isometric.with_exposure(columns(s, sf)).select("dimension", "x", "z", "left_depth", "right_depth"),
    "r4_height_field_view": height_view,
    "w5_visible_surface": lambda s, sf: isometric.with_exposure(columns(s, sf)).withColumns({"gx": F.col("x") - F.col("z"), "gy": F.col("x") + F.col("z") - 2 * F.col("ry")})
    .groupBy("dimension", "gx", "gy").agg(F.max_by("ry", F.col("x") + F.col("z")).alias("ry")),
    "r4_isometric_pyramid": q_pyramid,
    "r5_contributing_columns": q_contributing,
    "r6_voxel_view": voxel_view,
    "r6_sliced_view": lambda s, sf: voxel_view(s, sf, zoom=8, camera="nw", slice_y=30, style="height"),
}

_HIT = "SELECT q.qid,q.dimension,coalesce(v.x,g.x) AS x,coalesce(v.z,g.z) AS z,v.y AS vy,v.block_id AS vb,v.light AS vl,v.qid IS NOT NULL AS vox FROM fx_rays q LEFT JOIN o_voxel_hits v USING (qid) LEFT JOIN o_column_hits g USING (qid)"
ORACLE = {
    "j9_face_exposure": oracle("o_faces", "SELECT * FROM o_faces"),
    "j10_height_rays": oracle("o_column_hits", "SELECT * FROM o_column_hits"),
    "j11_voxel_rays": oracle("o_voxel_hits", "SELECT * FROM o_voxel_hits"),
    "j14_pick": oracle(
        "fx_rays o_voxel_hits o_column_hits o_columns fx_palette fx_biomes",
        f", h AS ({_HIT}) SELECT h.qid,h.dimension,h.x,coalesce(h.vy,c.height) AS y,h.z,b.name AS block,o.name AS biome,coalesce(h.vl,c.light) AS light,coalesce(c.water,false) AS water,c.water_y,(vox OR coalesce(c.present,false)) AS found "
        "FROM h LEFT JOIN o_columns c ON c.dimension=h.dimension AND c.x=h.x AND c.z=h.z LEFT JOIN fx_palette b ON b.id=coalesce(h.vb,c.block_id) LEFT JOIN fx_biomes o ON o.id=c.biome_id",
    ),
    "j18_draw_list": oracle(
        "o_render",
        # north-east: a=-z, b=x; zoom 8 has four pixels per unit
        ", p AS (SELECT dimension,x,z,(-z-x)*4 AS gx,(x-z)*2-(ry+1)*4 AS gy FROM o_render) SELECT dimension,x,z,CAST(floor(gx/512.0) AS INTEGER) AS tile_x,CAST(floor(gy/512.0) AS INTEGER) AS tile_y,((gx%512)+512)%512 AS px,((gy%512)+512)%512 AS py,x-z AS depth FROM p",
    ),
    "w4_exposed_depth": oracle("o_exposed", "SELECT dimension,x,z,left_depth,right_depth FROM o_exposed"),
    "w5_visible_surface": oracle(
        "o_render",
        "SELECT dimension,gx,gy,ry FROM (SELECT *,row_number() OVER (PARTITION BY dimension,gx,gy ORDER BY x+z DESC) AS rn FROM (SELECT dimension,x,z,ry,x-z AS gx,x+z-2*ry AS gy FROM o_render)) WHERE rn=1",
    ),
    "r4_height_field_view": oracle("o_iso_pixels", "SELECT * FROM o_iso_pixels"),
    "r4_isometric_pyramid": oracle(
        "o_iso_pixels o_iso_level4",
        "SELECT * FROM o_iso_pixels UNION ALL SELECT * FROM o_iso_level6 UNION ALL SELECT * FROM o_iso_level5 UNION ALL SELECT * FROM o_iso_level4",
    ),
    "r6_voxel_view": oracle(
        "o_vox_cells",
        "SELECT dimension,7 AS zoom,CAST(gx AS INTEGER) AS gx,CAST(gy AS INTEGER) AS gy,r,g,b,a FROM (SELECT *,row_number() OVER (PARTITION BY dimension,gx,gy ORDER BY rank DESC) AS rn FROM o_vox_cells) WHERE rn=1",
    ),
    "r5_contributing_columns": oracle(
        "fx_marks o_render",
        # footprint of the tiles that the marked chunks touch at zoom 9 (64 units wide)
        ", c AS (SELECT DISTINCT chunk_x-3 AS cx,chunk_z-3 AS cz FROM fx_marks), t AS (SELECT DISTINCT tx,CAST(unnest(range(CAST(floor(((cx+cz)*8-64-1)/64.0) AS BIGINT),CAST(floor(((cx+cz)*8+16+1)/64.0) AS BIGINT)+1)) AS INTEGER) AS ty FROM "
        "(SELECT *,CAST(unnest(range(CAST(floor(((cx-cz)*16-16-1)/64.0) AS BIGINT),CAST(floor(((cx-cz)*16+16+1)/64.0) AS BIGINT)+1)) AS INTEGER) AS tx FROM c)), "
        "h AS (SELECT greatest(0,min(ry)-8) AS lo,greatest(greatest(0,min(ry)-8),least(40,least(64,max(ry)+8))) AS hi FROM o_render WHERE dimension='overworld'), "
        "f AS (SELECT tx,ty,tx*32.0e0+ty*64+lo-1 AS a0,tx*32.0e0+32+ty*64+64+hi+1+1 AS a1,-tx*32.0e0-32+ty*64+lo-1 AS b0,-tx*32.0e0+ty*64+64+hi+1+1 AS b1 FROM t,h), "
        "w AS (SELECT tx,ty,floor(-a1)-1 AS x0,floor(-b1)-1 AS z0,ceil(-a0)+1+1 AS x1,ceil(-b0)+1+1 AS z1 FROM f) "
        "SELECT tx||'_'||ty AS window_id,count(*) AS n,CAST(sum(height) AS BIGINT) AS height FROM w JOIN o_render c ON c.dimension='overworld' AND c.x>=x0 AND c.x<x1 AND c.z>=z0 AND c.z<z1 GROUP BY 1",
    ),
}
