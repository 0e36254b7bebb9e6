"""Region files written from the voxel table and read back through the data source (ids S1-S3)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.shared import new_path
from voxelspark.sources import region_source

from . import region_writer
from . import views as fx
from .views import define, oracle


def world(spark, sf):
    """A fresh world of region files, a folder for each dimension."""
    path = new_path(spark, "world")
    region_writer.write_world(fx.voxels(spark, sf), fx.palette(spark), path)
    return path


DIRECTORIES = {f"{d}/region": d for d in (fx.DIM, "view")}


def scan(spark, sf, content="chunks", **options):
    return region_source.read_world(spark, world(spark, sf), content, DIRECTORIES, **options)


def q_listed(spark, sf):
    """Every region file, empty and short ones too."""
    size = F.when(F.col("size") == 0, "empty").when(F.col("size") < 8192, "short").otherwise("whole")
    name = F.regexp_extract("path", "([^/]+)$", 1)
    return scan(spark, sf, "files").select("dimension", "region_x", "region_z", name.alias("name"), size.alias("size"))


def q_slots(spark, sf):
    return scan(spark, sf, "slots").select("dimension", "region_x", "region_z", "chunk_x", "chunk_z", "slot", "stamp", "error")


def q_decoded(spark, sf):
    """Voxels with their light and biome, sections, and errors: everything a scan gives."""
    rows = scan(spark, sf, split=1 << 16)
    return rows.select("kind", "dimension", "region_x", "region_z", "chunk_x", "chunk_z", "section_y", "x", "y", "z", "block", "light", "light_above", "block_light_above", "biome", "error")


def q_pruned(spark, sf):
    """One quarter of the world, cut at a chunk row and a region border."""
    rows = scan(spark, sf, split=1 << 16).filter("kind = 'voxel' and region_x >= 0 and chunk_z < 2")
    return rows.select("dimension", "x", "y", "z", "block")


_V = "(x,y,z)"
define(
    "o_filed",
    ("fx_voxels", "fx_palette"),
    "SELECT v.dimension,x,y,z,p.name AS block,cx,cz,((cx+2*cz)%5+5)%5 AS layout,lx,lz,y%16 AS ly,CAST(floor(y/16.0) AS INTEGER) AS sy FROM ("
    "SELECT *,CAST(floor(x/16.0) AS INTEGER) AS cx,CAST(floor(z/16.0) AS INTEGER) AS cz,((x%16)+16)%16 AS lx,((z%16)+16)%16 AS lz FROM fx_voxels) v JOIN fx_palette p ON p.id=v.block_id",
)
_R = "CAST(floor(cx/32.0) AS INTEGER) AS region_x,CAST(floor(cz/32.0) AS INTEGER) AS region_z"
_BLOCK = "(lx*3+({y})*5+lz*7+sy)%16"
_SKY = "(lx+({y})*11+lz*2+sy)%16"
_UP = "least(ly+1,15)"
_LIGHT = lambda y: f"CASE WHEN layout=3 THEN greatest({_BLOCK.format(y=y)},{_SKY.format(y=y)}) ELSE {_SKY.format(y=y)} END"
_NULLS = "CAST(NULL AS VARCHAR)"
_INT = "CAST(NULL AS INTEGER)"

QUERIES = {
    "s1_listed_files": q_listed,
    "s2_source_slots": q_slots,
    "s3_source_decode": q_decoded,
    "s3_source_pruned": q_pruned,
}

ORACLE = {
    "s1_listed_files": oracle(
        "o_filed",
        f", r AS (SELECT DISTINCT dimension,{_R} FROM o_filed) SELECT dimension,CAST(region_x+s.shift AS INTEGER) AS region_x,region_z,'r.'||(region_x+s.shift)||'.'||region_z||'.mca' AS name,s.size "
        "FROM r,(VALUES (0,'whole'),(100,'empty'),(200,'short')) s(shift,size)",
    ),
    "s2_source_slots": oracle(
        "o_filed",
        f", c AS (SELECT DISTINCT dimension,cx,cz,{_R},((cx%32)+32)%32+((cz%32)+32)%32*32 AS slot FROM o_filed) "
        f"SELECT dimension,region_x,region_z,cx AS chunk_x,cz AS chunk_z,CAST(slot AS INTEGER) AS slot,CAST(1700000000+slot AS BIGINT) AS stamp,{_NULLS} AS error FROM c UNION ALL "
        f"SELECT DISTINCT dimension,CAST(region_x+200 AS INTEGER),region_z,CAST((region_x+200)*32 AS INTEGER),CAST(region_z*32 AS INTEGER),{_INT},CAST(NULL AS BIGINT),'file too short for a header' FROM c",
    ),
    "s3_source_decode": oracle(
        "o_filed",
        f", f AS (SELECT *,{_R} FROM o_filed) SELECT 'voxel' AS kind,dimension,region_x,region_z,cx AS chunk_x,cz AS chunk_z,sy AS section_y,x,y,z,block,CAST({_LIGHT('ly')} AS INTEGER) AS light,CAST({_LIGHT(_UP)} AS INTEGER) AS light_above,"
        f"CAST(CASE WHEN layout=3 THEN {_BLOCK.format(y=_UP)} ELSE 0 END AS INTEGER) AS block_light_above,CASE WHEN layout<>3 THEN 'minecraft:desert' WHEN (lx+lz)%3=0 THEN 'minecraft:swamp' ELSE 'minecraft:plains' END AS biome,{_NULLS} AS error FROM f WHERE layout<>4 UNION ALL "
        f"SELECT DISTINCT 'section',dimension,region_x,region_z,cx,cz,sy,{_INT},{_INT},{_INT},{_NULLS},{_INT},{_INT},{_INT},{_NULLS},{_NULLS} FROM f WHERE layout<>4 UNION ALL "
        f"SELECT DISTINCT 'error',dimension,region_x,region_z,cx,cz,{_INT},{_INT},{_INT},{_INT},{_NULLS},{_INT},{_INT},{_INT},{_NULLS},'document ends early' FROM f WHERE layout=4 UNION ALL "
        f"SELECT DISTINCT 'error',dimension,CAST(region_x+200 AS INTEGER),region_z,CAST((region_x+200)*32 AS INTEGER),CAST(region_z*32 AS INTEGER),{_INT},{_INT},{_INT},{_INT},{_NULLS},{_INT},{_INT},{_INT},{_NULLS},'file too short for a header' FROM f",
    ),
    "s3_source_pruned": oracle("o_filed", "SELECT dimension,x,y,z,block FROM o_filed WHERE layout<>4 AND cx>=0 AND cz<2"),
}
