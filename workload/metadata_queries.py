"""Level documents and described dimensions of a world (id S9)."""

from __future__ import annotations

import gzip
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.shared import written
from voxelspark.sources import metadata, regions, worlds

from . import region_writer
from . import views as fx
from .views import oracle

WORLD = "/srv/n7"
# Where the two dimensions of the voxel table stand in that world.
FOLDERS = {"overworld": f"{WORLD}/region", "view": f"{WORLD}/dimensions/mod/view/region"}


def level_files(spark, sf):
    """A world for every nation: every third document plain, every fifth cut short, every fourth
    without the inner compound."""

    def write(batches):
        for b in batches:
            paths, bodies = [], []
            for r in b.to_pylist():
                k = r["n_nationkey"]
                data = {"LevelName": " " if k % 6 == 2 else r["n_name"], "SpawnX": k * 16 - 100, "SpawnZ": 50 - k, "BorderCenterX": k, "BorderSize": k * 2_000_000}
                body = region_writer.document(data if k % 4 == 1 else {"Data": data})
                body = body[:20] if k % 5 == 4 else body
                paths.append(f"/srv/n{k}/level.dat")
                bodies.append(body if k % 3 == 0 else gzip.compress(body))
            yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string()), pa.array(bodies, pa.binary())], ["path", "content"])

    return fx.table(spark, sf, "nation").select("n_nationkey", "n_name").mapInArrow(write, "path string, content binary")


def q_described(spark, sf):
    """Both dimensions of one world, with the chunks near the origin decoded and no others."""
    folder = reduce(lambda c, kv: F.when(F.col("dimension") == kv[0], F.lit(kv[1])).otherwise(c), FOLDERS.items(), F.lit(None))
    voxels = fx.voxels(spark, sf)
    moved = voxels.withColumns({"dimension": F.lit("view"), "x": F.col("x") + 640, "y": F.col("y") + 32})
    table = region_writer.region_table(voxels.unionByName(moved), fx.palette(spark), fx.biomes(spark))
    rows: DataFrame = regions.with_region(table.withColumn("path", F.concat(folder, F.regexp_extract("path", "(/[^/]+)$", 1))))
    # The world's files are made once; what follows reads names of all, and bodies of a few.
    rows = written(rows, "regions")
    found = worlds.discover(worlds.region_directories(rows), WORLD)
    place = F.regexp_replace("path", "/[^/]*$", "").alias("directory")
    named = rows.drop("dimension").withColumn("directory", place).join(found.select("directory", "dimension"), "directory")
    probes = metadata.probe_regions(named.select("dimension", "region_x", "region_z"))
    near = named.join(probes, ["dimension", "region_x", "region_z"], "left_semi")
    decoded = regions.decode_chunks(metadata.probe_chunks(regions.chunk_payloads(near)))
    ranges = metadata.height_ranges(regions.section_rows(decoded), probes)
    return metadata.described(found, WORLD, metadata.level_data(level_files(spark, sf)), ranges, worlds.estimated_border(named))


QUERIES = {
    "s9_level_documents": lambda s, sf: metadata.level_data(level_files(s, sf)).withColumn("error", F.col("error").isNotNull()),
    "s9_world_metadata": q_described,
}

_NUMBER = lambda sql, name: f"CAST(CASE WHEN k%5=4 THEN 0 ELSE {sql} END AS BIGINT) AS {name}"
_BORDER = "CASE WHEN k*2000000>=29000000 THEN 0 ELSE k*2000000 END"
_LEVELS = (
    "SELECT '/srv/n'||k AS world,CASE WHEN k%5=4 THEN '' WHEN k%6=2 THEN ' ' ELSE n_name END AS level_name,"
    + ",".join([_NUMBER("k*16-100", "spawn_x"), _NUMBER("64", "spawn_y"), _NUMBER("50-k", "spawn_z"), _NUMBER("k", "center_x"), _NUMBER("0", "center_z"), _NUMBER(_BORDER, "border")])
    + ",k%5=4 AS error FROM (SELECT n_nationkey AS k,n_name FROM nation)"
)
_CORNER = "cx-rx*32<8 AND cz-rz*32<8"

ORACLE = {
    "s9_level_documents": _LEVELS,
    "s9_world_metadata": oracle(
        "fx_voxels",
        ", v AS (SELECT dimension AS d,CAST(floor(x/16.0) AS INTEGER) AS cx,CAST(floor(z/16.0) AS INTEGER) AS cz,CAST(floor(y/16.0) AS INTEGER) AS sy,CAST(floor(x/512.0) AS INTEGER) AS rx,CAST(floor(z/512.0) AS INTEGER) AS rz FROM (SELECT dimension,x,y,z FROM fx_voxels UNION ALL SELECT 'view',x+640,y+32,z FROM fx_voxels)), "
        "r AS (SELECT *,row_number() OVER (PARTITION BY d ORDER BY rx*rx+rz*rz,rx,rz) AS probe FROM (SELECT DISTINCT d,rx,rz FROM v)), "
        "b AS (SELECT d,(max(greatest(CASE WHEN rx<0 THEN -rx-1 ELSE rx END,CASE WHEN rz<0 THEN -rz-1 ELSE rz END,0))+1)*1024 AS border FROM r GROUP BY d), "
        "c AS (SELECT d,probe,cz,cx,min(sy)*16 AS low,max(sy)*16+16 AS high FROM v JOIN r USING (d,rx,rz) WHERE probe<=3 AND " + _CORNER + " GROUP BY 1,2,3,4), "
        "f AS (SELECT * FROM (SELECT *,row_number() OVER (PARTITION BY d ORDER BY probe,cz,cx) AS n FROM c) WHERE n=1), "
        f"l AS ({_LEVELS}) "
        "SELECT CASE WHEN d='view' THEN 'mod:view' ELSE 'minecraft:overworld' END AS dimension,CASE WHEN d='view' THEN 'View' WHEN trim(level_name)<>'' THEN level_name ELSE 'Overworld' END AS name,"
        f"CASE WHEN d='view' THEN '{FOLDERS['view']}' ELSE '{FOLDERS['overworld']}' END AS directory,CAST(coalesce(low,-64) AS INTEGER) AS min_y,CAST(coalesce(high,320) AS INTEGER) AS max_y,false AS has_ceiling,"
        + ",".join(f"CASE WHEN d='view' THEN 0 ELSE {c} END AS {c}" for c in ("spawn_x", "spawn_z", "center_x", "center_z"))
        + ",CAST(CASE WHEN d<>'view' AND l.border>0 THEN l.border ELSE b.border END AS BIGINT) AS border,CAST(CASE WHEN d='view' THEN 3 ELSE 0 END AS INTEGER) AS place "
        f"FROM b LEFT JOIN f USING (d) CROSS JOIN l WHERE l.world='{WORLD}'",
    ),
}
