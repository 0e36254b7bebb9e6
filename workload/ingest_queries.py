"""Region files, worlds, palettes and unknown names (ids S1-S4, S9, S11, A13, A14, A16, J1, J2, J15, W10, X2, R7)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.functions import grid
from voxelspark.operators import lookups
from voxelspark.plans import pyramid
from voxelspark.sources import palettes, regions, tiles, worlds

from . import region_writer
from . import sqlcolor as q
from . import views as fx
from .grid_queries import _height, _hexch, _tint_hex
from .style_queries import UNEXPLORED, colors
from .views import define, oracle


def files(spark, sf):
    """A listing of region files, one per customer, over all directory layouts."""
    k = F.col("c_custkey")
    layout = F.element_at(F.array(*[F.lit(x) for x in LAYOUTS]), (k % len(LAYOUTS) + 1).cast("int"))
    name = F.concat(F.lit("/r."), (F.floor(k / 10) % 31 - 15).cast("string"), F.lit("."), (F.floor(k / 100) % 23 - 11).cast("string"), F.when(k % 50 == 3, F.lit(".mcc")).otherwise(F.lit(".mca")))
    return fx.table(spark, sf, "customer").select(F.concat(layout, name).alias("path"), F.floor(F.col("c_acctbal") + 5000).cast("long").alias("size"))


LAYOUTS = (
    "/srv/w/region", "/srv/w/DIM-1/region", "/srv/w/DIM1/region", "/srv/w_nether/DIM-1/region", "/srv/w/dimensions/mod/deep_dark/region",
    "/srv/w_dimensions/mod/deep_dark/region", "/srv/w_dimensions/sky/isles/region", "/srv/w/backup/region", "/other/moon", "/srv/w_the_end/DIM1/region",
)


def q_discover(spark, sf):
    dirs = worlds.region_directories(regions.with_region(files(spark, sf)))
    return worlds.discover(dirs, "/srv/w", {"mod:moon": "/other/moon"})


def located(spark, sf):
    f = regions.with_region(files(spark, sf))
    return f.withColumn("dimension", F.regexp_extract("path", "^(.*)/[^/]*$", 1))


def region_rows(spark, sf):
    table = region_writer.region_table(fx.voxels(spark, sf), fx.palette(spark), fx.biomes(spark))
    return regions.with_region(table)


def decoded(spark, sf):
    return regions.decode_chunks(regions.chunk_payloads(region_rows(spark, sf)))


def block_documents(spark, sf):
    """Layered palette documents of fifty entries each, two of three bare, with aliases."""
    k = F.col("id")
    color = F.format_string("#%06x", k * 7919 % 16777216)
    entry = F.when(
        k % 6 == 5, F.to_json(F.struct(F.concat(F.lit("Block_"), ((k * 3) % 211).cast("string")).alias("alias")))
    ).otherwise(
        F.to_json(F.struct(color.alias("color"), F.when(k % 4 == 1, "Leaves").alias("tint"), (k % 9 == 2).alias("water"), (k % 7 == 3).alias("transparent"),
                           F.when(k % 5 == 0, F.lit(0.25)).alias("height"), (k % 14 == 3).alias("decoration")))
    )
    name = F.concat(F.lit(" Block_"), (k % 211).cast("string"), F.when(k % 2 == 0, F.lit("_slab[half=top]")).otherwise(F.lit("")))
    rows = fx.markers(spark, sf).select(F.floor(k / 50).alias("doc"), "id", F.concat(F.lit('"'), name, F.lit('":'), entry).alias("e"))
    body = rows.groupBy("doc").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("id", "e"))), lambda s: s["e"]), ",").alias("b"))
    bare = F.concat(F.lit("{"), F.col("b"), F.lit("}"))
    return body.select(F.col("doc").cast("int").alias("layer"), F.when(F.col("doc") % 3 == 0, F.concat(F.lit('{"blocks":'), bare, F.lit("}"))).otherwise(bare).alias("value"))


define(
    "o_entries",
    ("fx_markers",),
    "SELECT id,CAST(floor(id/50.0) AS INTEGER) AS layer,'minecraft:block_'||id%211||CASE WHEN id%2=0 THEN '_slab' ELSE '' END AS name,CASE WHEN id%6=5 THEN 'minecraft:block_'||(id*3)%211 END AS alias,"
    "CAST(id*7919%16777216 AS INTEGER) AS rgb,CASE WHEN id%4=1 THEN 'foliage' ELSE 'none' END AS tint,id%9=2 AS water,id%7=3 AS transparent,"
    "CASE WHEN id%5=0 THEN 0.25e0 WHEN id%2=0 THEN 0.5e0 ELSE 1.0e0 END AS height,id%14=3 AS decoration FROM fx_markers",
)
define(
    "o_parsed",
    ("o_entries",),
    "SELECT * EXCLUDE (rn) FROM (SELECT *,row_number() OVER (PARTITION BY name ORDER BY layer DESC,late DESC,id DESC) AS rn FROM (SELECT id,layer,name,rgb,tint,water,transparent,height,decoration,0 AS late FROM o_entries WHERE alias IS NULL UNION ALL "
    "SELECT id,layer,name,rgb,tint,water,transparent,height,decoration,1 FROM (SELECT a.id,a.layer,a.name,d.rgb,d.tint,d.water,d.transparent,d.height,d.decoration,row_number() OVER (PARTITION BY a.name,a.layer ORDER BY d.layer DESC,d.id DESC) AS k FROM o_entries a JOIN o_entries d ON d.alias IS NULL AND d.name=a.alias AND d.layer<=a.layer WHERE a.alias IS NOT NULL) WHERE k=1)) WHERE rn=1",
)


def biome_documents(spark, sf):
    """Biome documents, one per raw name, some with only a grass colour."""
    k = F.col("id")
    entry = F.when(k % 3 == 0, F.format_string('{"grass":"#%06x"}', k * 31 % 16777216)).when(k % 3 == 1, F.lit("{}")).otherwise(
        F.format_string('{"water":"#%06x","overlay":"#abc"}', k * 77 % 16777216)
    )
    return fx.raw_names(spark, sf).select(k.cast("int").alias("layer"), F.concat(F.lit('{"'), "name", F.lit('":'), entry, F.lit("}")).alias("value"))


define("o_seen", ("o_keys",), f"SELECT key AS name,count(*) AS n,any_value({q.fnv('key')}) AS fnv FROM o_keys GROUP BY 1")
define(
    "o_last_biome",
    ("o_keys",),
    "SELECT key,arg_max(id,id) AS id FROM o_keys GROUP BY 1",
)


def known_palette(spark, sf):
    """A palette that maps a third of the raw names."""
    rows = fx.raw_names(spark, sf).select("id", lookups.names.normalize("name").alias("name")).groupBy("name").agg(F.min("id").alias("id")).filter("pmod(id, 3) = 0")
    k = F.col("id")
    return rows.select(
        k.cast("int").alias("id"), "name", (k % 256).cast("int").alias("r"), (k * 3 % 256).cast("int").alias("g"), (k * 5 % 256).cast("int").alias("b"), F.lit(255).alias("a"),
        F.lit("grass").alias("tint"), (k % 4 == 0).alias("water"), (k % 6 == 0).alias("transparent"), F.lit(1.0).alias("height"), F.lit(True).alias("grassy"),
        (k % 12 == 0).alias("decoration"), F.lit(True).alias("known"),
    ).withColumn("occludes", lookups.occludes())


def classifier(spark, sf):
    return fx.raw_names(spark, sf).select(lookups.names.normalize("name").alias("name")).distinct().select("name", F.col("name").contains("blue").alias("decoration"))


def q_resolve(spark, sf):
    out = lookups.with_fallback(fx.raw_names(spark, sf), known_palette(spark, sf), classifier(spark, sf))
    return out.drop("grassy")


define(
    "o_known",
    ("o_keys",),
    "SELECT name,id FROM (SELECT key AS name,min(id) AS id FROM o_keys GROUP BY 1) WHERE id%3=0",
)


def q_extended(spark, sf):
    """Fresh ids follow the largest known one, in name order."""
    p = lookups.extend_palette(known_palette(spark, sf), fx.raw_names(spark, sf))
    return p.select("id", "name", "known")


def q_pack(spark, sf):
    t = pyramid.with_tiles(pyramid.averaged_pixels(colors(spark, sf), 4))
    packed = tiles.pack_tiles(t, UNEXPLORED)
    return packed.select("dimension", "zoom", "tile_x", "tile_y", F.length("rgba").alias("bytes"), F.sha2(F.hex("rgba").cast("binary"), 256).alias("digest"))


QUERIES = {
    "s1_region_catalogue": lambda s, sf: regions.with_region(files(s, sf)),
    "s2_region_header": lambda s, sf: regions.header_slots(region_rows(s, sf)).select("dimension", "chunk_x", "chunk_z", "slot", "stamp", "error"),
    "s3_chunk_decode": lambda s, sf: regions.voxel_rows(decoded(s, sf)).select("dimension", "x", "y", "z", "block", "light", "block_light_above"),
    "s3_sections": lambda s, sf: regions.section_rows(decoded(s, sf)),
    "s4_block_palette": lambda s, sf: palettes.parse_blocks(block_documents(s, sf)).drop("grassy", "known"),
    "s4_biome_palette": lambda s, sf: palettes.parse_biomes(biome_documents(s, sf)).select(
        "name", *[F.col(f"{n}.{c}").alias(f"{n[0]}_{c}") for n in ("grass", "foliage", "water", "overlay") for c in "rgb"]),
    "s9_dimension_discovery": q_discover,
    "s11_world_scan": lambda s, sf: worlds.scan_report(regions.with_region(files(s, sf)).withColumn("dimension", F.substring("path", 1, 9))),
    "a13_scan_with_chunks": lambda s, sf: worlds.scan_report(region_rows(s, sf), regions.header_slots(region_rows(s, sf))).drop("bytes"),
    "a14_estimated_border": lambda s, sf: worlds.estimated_border(located(s, sf)),
    "a16_unknown_names": lambda s, sf: lookups.unknown_report(fx.raw_names(s, sf), known_palette(s, sf)),
    "j1_palette_fallback": q_resolve,
    "j1_extended_ids": q_extended,
    "j2_biome_fallback": lambda s, sf: lookups.with_biome_fallback(fx.raw_names(s, sf), fx.biomes(s)).select(
        "name", "known", *[F.col(f"{n}.{c}").alias(f"{n[0]}_{c}") for n in ("grass", "foliage", "water", "overlay") for c in "rgb"]),
    "j15_alias_resolution": lambda s, sf: _aliases(s, sf),
    "w10_last_wins": lambda s, sf: lookups.last_wins(fx.table(s, sf, "orders").select("o_custkey", "o_orderkey", "o_orderstatus", "o_totalprice"), ["o_custkey"], ["o_orderkey"]),
    "x2_decoration_classifier": lambda s, sf: lookups.with_fallback(fx.raw_names(s, sf), known_palette(s, sf), classifier(s, sf)).filter("decoration and not known").select("name", "transparent", "occludes"),
    "r7_packed_tiles": q_pack,
}


def _aliases(spark, sf):
    k = F.col("id")
    rows = fx.markers(spark, sf).select(
        "id", F.concat(F.lit("b"), (k % 700).cast("string")).alias("name"), F.when(k % 4 == 1, F.concat(F.lit("b"), ((k * 13 + 1) % 700).cast("string"))).alias("alias"),
        F.floor(k / 700).cast("int").alias("layer"),
    )
    out = lookups.resolve_aliases(rows)
    return out.filter("_late = 1").select("name", "layer", "id")


def _rgb(p: str) -> str:
    return f"CAST(floor({p}/65536.0) AS INTEGER) AS r,CAST(floor({p}/256.0)%256 AS INTEGER) AS g,CAST({p}%256 AS INTEGER) AS b"


_DIR = "regexp_replace(path,'/[^/]*$','')"
define(
    "o_files",
    (),
    f"SELECT *,CAST(regexp_extract(path,'r\\.(-?[0-9]+)\\.(-?[0-9]+)\\.mca$',1) AS INTEGER) AS region_x,CAST(regexp_extract(path,'r\\.(-?[0-9]+)\\.(-?[0-9]+)\\.mca$',2) AS INTEGER) AS region_z FROM ("
    f"SELECT ({fx._arr(LAYOUTS)})[CAST(c_custkey%{len(LAYOUTS)}+1 AS INTEGER)]||'/r.'||CAST(floor(c_custkey/10.0)%31-15 AS INTEGER)||'.'||CAST(floor(c_custkey/100.0)%23-11 AS INTEGER)||CASE WHEN c_custkey%50=3 THEN '.mcc' ELSE '.mca' END AS path,CAST(floor(c_acctbal+5000) AS BIGINT) AS size FROM customer) WHERE path LIKE '%.mca'",
)
_G = {"g": 1, "f": 2, "w": 3}
_TINTS = ",".join(f"{_tint_hex(n)} AS t{p}" for p, n in _G.items())
_OV = lambda ch: q.name_color("fnv", "rgb".index(ch))
_SCAN = "count(*) AS regions,CAST(sum(size) AS BIGINT) AS bytes,min(region_x)*512 AS min_x,min(region_z)*512 AS min_z,max(region_x)*512+512 AS max_x,max(region_z)*512+512 AS max_z"
_FOLD = lambda c: f"CASE WHEN {c}<0 THEN -{c}-1 ELSE {c} END"
ORACLE = {
    "s1_region_catalogue": oracle("o_files", "SELECT * FROM o_files"),
    "s2_region_header": oracle(
        "fx_sections",
        ", c AS (SELECT DISTINCT dimension,chunk_x,chunk_z FROM fx_sections) SELECT dimension,chunk_x,chunk_z,((chunk_x%32)+32)%32+((chunk_z%32)+32)%32*32 AS slot,"
        "CAST(1700000000+((chunk_x%32)+32)%32+((chunk_z%32)+32)%32*32 AS BIGINT) AS stamp,CAST(NULL AS VARCHAR) AS error FROM c",
    ),
    "s3_chunk_decode": oracle(
        "fx_voxels fx_palette", "SELECT dimension,x,y,z,p.name AS block,15 AS light,0 AS block_light_above FROM fx_voxels v JOIN fx_palette p ON p.id=v.block_id"
    ),
    "s3_sections": oracle("fx_sections", "SELECT * FROM fx_sections"),
    "s4_block_palette": oracle(
        "o_parsed",
        f"SELECT CAST(row_number() OVER (ORDER BY name)-1 AS INTEGER) AS id,name,{_rgb('rgb')},255 AS a,tint,water,transparent,height,decoration,NOT transparent AND NOT water AND NOT decoration AS occludes FROM o_parsed",
    ),
    "s4_biome_palette": oracle(
        "o_last_biome",
        f", t AS (SELECT key,id,{_TINTS},{q.fnv('key')} AS fnv FROM o_last_biome), h AS (SELECT *,printf('#%06x',id*31%16777216) AS hg,printf('#%06x',id*77%16777216) AS hw FROM t) SELECT key AS name,"
        + ",".join(f"{_hexch('CASE WHEN id%3=0 THEN hg ELSE tg END', at)} AS g_{c}" for c, at in zip("rgb", (2, 4, 6)))
        + ","
        + ",".join(f"{_hexch('tf', at)} AS f_{c}" for c, at in zip("rgb", (2, 4, 6)))
        + ","
        + ",".join(f"{_hexch('CASE WHEN id%3=2 THEN hw ELSE tw END', at)} AS w_{c}" for c, at in zip("rgb", (2, 4, 6)))
        + ","
        + ",".join(f"CASE WHEN id%3=0 THEN {_hexch('hg', at)} WHEN id%3=2 THEN {v} ELSE {_OV(c)} END AS o_{c}" for c, at, v in zip("rgb", (2, 4, 6), (170, 187, 204)))
        + " FROM h",
    ),
    "s9_dimension_discovery": oracle(
        "o_files",
        f", d AS (SELECT {_DIR} AS directory,count(*) AS regions,CAST(sum(size) AS BIGINT) AS bytes FROM o_files GROUP BY 1), "
        "r AS (SELECT * FROM (VALUES ('/srv/w/region','minecraft:overworld','Overworld',-64,320,false,0),('/srv/w/DIM-1/region','minecraft:the_nether','Nether',0,128,true,0),('/srv/w/DIM1/region','minecraft:the_end','The End',0,256,false,0),"
        "('/srv/w_nether/DIM-1/region','minecraft:the_nether','Nether',0,128,true,3),('/srv/w_the_end/DIM1/region','minecraft:the_end','The End',0,256,false,4),('/srv/w/dimensions/mod/deep_dark/region','mod:deep_dark','Deep Dark',-64,320,false,5),"
        "('/srv/w_dimensions/mod/deep_dark/region','mod:deep_dark','Deep Dark',-64,320,false,6),('/srv/w_dimensions/sky/isles/region','sky:isles','Isles',-64,320,false,6),('/other/moon','mod:moon','Moon',-64,320,false,0)) t(directory,dimension,name,min_y,max_y,has_ceiling,rank)) "
        "SELECT directory,regions,bytes,dimension,name,min_y,max_y,has_ceiling FROM (SELECT d.*,r.dimension,r.name,r.min_y,r.max_y,r.has_ceiling,row_number() OVER (PARTITION BY dimension ORDER BY rank) AS rn FROM d JOIN r USING (directory)) WHERE rn=1",
    ),
    "s11_world_scan": oracle("o_files", f"SELECT substr(path,1,9) AS dimension,{_SCAN} FROM o_files GROUP BY 1"),
    "a13_scan_with_chunks": oracle(
        "fx_sections",
        ", c AS (SELECT DISTINCT dimension,chunk_x,chunk_z,CAST(floor(chunk_x/32.0) AS INTEGER) AS rx,CAST(floor(chunk_z/32.0) AS INTEGER) AS rz FROM fx_sections) "
        "SELECT dimension,count(DISTINCT (rx,rz)) AS regions,min(rx)*512 AS min_x,min(rz)*512 AS min_z,max(rx)*512+512 AS max_x,max(rz)*512+512 AS max_z,count(*) AS chunks FROM c GROUP BY 1",
    ),
    "a14_estimated_border": oracle(
        "o_files", f"SELECT {_DIR} AS dimension,CAST((max(greatest({_FOLD('region_x')},{_FOLD('region_z')}))+1)*1024 AS INTEGER) AS border FROM o_files GROUP BY 1"
    ),
    "a16_unknown_names": oracle(
        "o_seen o_known",
        f"SELECT name,n,{q.hex_of(q.name_color('fnv', 0), q.name_color('fnv', 1), q.name_color('fnv', 2))} AS color FROM o_seen WHERE name NOT IN (SELECT name FROM o_known)",
    ),
    "j1_palette_fallback": oracle(
        "o_seen o_known",
        ", j AS (SELECT s.name,s.fnv,k.id,s.name AS key FROM o_seen s LEFT JOIN o_known k USING (name)) SELECT name,"
        + ",".join(f"CASE WHEN id IS NULL THEN {q.name_color('fnv', i)} ELSE CAST(id*{m}%256 AS INTEGER) END AS {c}" for i, (c, m) in enumerate(zip("rgb", (1, 3, 5))))
        + ",255 AS a,CASE WHEN id IS NULL THEN 'none' ELSE 'grass' END AS tint,coalesce(id%4=0,false) AS water,CASE WHEN id IS NULL THEN contains(name,'blue') ELSE id%6=0 END AS transparent,"
        + f"CASE WHEN id IS NULL THEN coalesce({_height('local')},1.0e0) ELSE 1.0e0 END AS height,CASE WHEN id IS NULL THEN contains(name,'blue') ELSE id%12=0 END AS decoration,id IS NOT NULL AS known,"
        + "CASE WHEN id IS NULL THEN NOT contains(name,'blue') ELSE id%6<>0 AND id%4<>0 END AS occludes FROM (SELECT *,regexp_replace(name,'^[^:]*:','') AS local FROM j)",
    ),
    "j1_extended_ids": oracle(
        "o_seen o_known",
        "SELECT CAST(id AS INTEGER) AS id,name,true AS known FROM o_known UNION ALL SELECT CAST((SELECT max(id) FROM o_known)+row_number() OVER (ORDER BY name) AS INTEGER),name,false FROM o_seen WHERE name NOT IN (SELECT name FROM o_known)",
    ),
    "j2_biome_fallback": oracle(
        "o_seen",
        f", t AS (SELECT name,name AS key,fnv FROM o_seen), h AS (SELECT *,{_TINTS} FROM t) SELECT name,false AS known,"
        + ",".join(f"{_hexch(f't{p}', at)} AS {p}_{c}" for p in "gfw" for c, at in zip("rgb", (2, 4, 6)))
        + ","
        + ",".join(f"{_OV(c)} AS o_{c}" for c in "rgb")
        + " FROM h",
    ),
    "j15_alias_resolution": oracle(
        "fx_markers",
        ", e AS (SELECT id,'b'||id%700 AS name,CASE WHEN id%4=1 THEN 'b'||(id*13+1)%700 END AS alias,CAST(floor(id/700.0) AS INTEGER) AS layer FROM fx_markers) "
        "SELECT name,layer,id FROM (SELECT a.name,a.layer,d.id,row_number() OVER (PARTITION BY a.name,a.layer ORDER BY d.layer DESC) AS rn FROM e a JOIN e d ON d.alias IS NULL AND d.name=a.alias AND d.layer<=a.layer WHERE a.alias IS NOT NULL) WHERE rn=1",
    ),
    "w10_last_wins": "SELECT o_custkey,o_orderkey,o_orderstatus,o_totalprice FROM (SELECT *,row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey DESC) AS rn FROM orders) WHERE rn=1",
    "x2_decoration_classifier": oracle(
        "o_seen o_known", "SELECT name,true AS transparent,false AS occludes FROM o_seen WHERE contains(name,'blue') AND name NOT IN (SELECT name FROM o_known)"
    ),
    "r7_packed_tiles": oracle(
        "o_color_terrain",
        ", p AS (SELECT dimension,CAST(floor(x/4.0) AS INTEGER) AS gx,CAST(floor(z/4.0) AS INTEGER) AS gy,"
        + ",".join(f"CAST(floor(sum({c})/count(*)) AS INTEGER) AS {c}" for c in "rgb")
        + " FROM o_color_terrain GROUP BY 1,2,3), t AS (SELECT *,CAST(floor(gx/512.0) AS INTEGER) AS tile_x,CAST(floor(gy/512.0) AS INTEGER) AS tile_y FROM p), "
        "k AS (SELECT DISTINCT dimension,tile_x,tile_y FROM t), h AS (SELECT k.*,i,coalesce(printf('%02X%02X%02XFF',r,g,b),'14161AFF') AS v FROM k JOIN (SELECT unnest(range(262144)) AS i) s ON true LEFT JOIN t ON t.dimension=k.dimension AND t.gx=k.tile_x*512+i%512 AND t.gy=k.tile_y*512+i//512) "
        "SELECT dimension,4 AS zoom,tile_x,tile_y,1048576 AS bytes,sha256(string_agg(v,'' ORDER BY i)) AS digest FROM h GROUP BY 1,2,3,4",
    ),
}
