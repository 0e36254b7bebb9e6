"""Tables that are written and rewritten, and rows with missing values (ids S8, T6, A1, J12)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.operators import changes, surface
from voxelspark.plans import pyramid
from voxelspark.shared import written
from voxelspark.sources import tiles
from voxelspark.streaming import jobs

from . import views as fx
from .change_queries import affected, scratch
from .style_queries import UNEXPLORED, colors
from .surface_queries import columns
from .views import oracle


def q_tile_store(spark, sf):
    """Stores every plan tile, then every third one again with other bytes; all stay."""
    path = f"{scratch(spark)}/tiles"
    plan = affected(spark, sf).filter("mode = 'top'").drop("mode")
    text = F.concat_ws(":", F.col("zoom").cast("string"), F.col("tile_x").cast("string"), F.col("tile_y").cast("string"))
    plan = plan.withColumn("rgba", F.encode(text, "UTF-8"))
    tiles.write_tiles(plan, path)
    again = plan.filter(F.pmod(F.col("tile_x") + F.col("tile_y"), F.lit(3)) == 0)
    tiles.write_tiles(again.withColumn("rgba", F.encode(F.concat(text, F.lit("!")), "UTF-8")), path)
    return spark.read.parquet(path).select("dimension", "zoom", "tile_x", "tile_y", F.decode("rgba", "UTF-8").alias("bytes"))


def q_incremental(spark, sf):
    """Two micro-batches over all explored chunks; the second one repaints what the first drew."""
    out = scratch(spark)
    # Both batches, and every level of each, read chunks and pixels: they are made once.
    chunks = written(columns(spark, sf).select("dimension", F.shiftright("x", 4).alias("chunk_x"), F.shiftright("z", 4).alias("chunk_z")).distinct(), "chunks")
    chunks.coalesce(1).write.parquet(f"{out}/marks")
    pixels = written(pyramid.base_pixels(colors(spark, sf)).withColumns({"tile_x": F.shiftright("gx", 9), "tile_y": F.shiftright("gy", 9)}), "pixels")

    def base_of(red):
        keys = ["dimension", "zoom", "tile_x", "tile_y"]
        return lambda dirty: pixels.withColumn("r", red).join(dirty, keys, "left_semi").drop("tile_x", "tile_y")

    for red in (255 - F.col("r"), F.col("r")):
        marks = spark.readStream.schema(chunks.schema).parquet(f"{out}/marks")
        jobs.rebuild_tiles(marks, base_of(red), f"{out}/levels", f"{out}/checkpoint", 2, fill=UNEXPLORED).awaitTermination()
        chunks.coalesce(1).write.mode("append").parquet(f"{out}/marks")
    return jobs.read_levels(spark, f"{out}/levels").select("dimension", "zoom", "gx", "gy", *pyramid.CHANNELS)


def q_unmapped(spark, sf):
    """Stone under an unknown id, biomes and light that are missing: no voxel may be lost."""
    gap = lambda c, n: F.pmod(F.col(c), F.lit(n)) == 0
    v = fx.voxels(spark, sf).withColumns(
        {
            "block_id": F.when((F.col("block_id") == 0) & (F.pmod(F.col("x") + F.col("z"), F.lit(5)) == 0), 99).otherwise(F.col("block_id")),
            "biome_id": F.when(~gap("x", 7), F.col("biome_id")),
            "light_above": F.when(~gap("z", 6), F.col("light_above")),
            "block_light_above": F.when(~gap("z", 6), F.col("block_light_above")),
        }
    )
    scan = surface.surface_scan(v, fx.palette(spark), fx.sections(spark, sf))
    return scan.select("dimension", "x", "z", "height", "water_y", "block_id", "biome_id", "light", "block_light", "ore_best", "ore_score")


def q_seen(spark, sf):
    """Regions that were seen without chunks report their first ones."""
    before, now = fx.slots(spark, sf, "1997-01-01"), fx.slots(spark, sf, "1997-07-01")
    return changes.changed_slots(before, now, now.select(*changes.REGION).distinct())


QUERIES = {
    "s8_tile_store": q_tile_store,
    "t6_incremental_pyramid": q_incremental,
    "a1_unmapped_names": q_unmapped,
    "j12_seen_without_chunks": q_seen,
}

ORACLE = {
    "s8_tile_store": oracle(
        "o_affected",
        "SELECT dimension,zoom,tile_x,tile_y,zoom||':'||tile_x||':'||tile_y||CASE WHEN (tile_x+tile_y)%3=0 THEN '!' ELSE '' END AS bytes FROM o_affected WHERE mode='top'",
    ),
    "t6_incremental_pyramid": oracle("o_pyramid", "SELECT dimension,zoom,gx,gy,r,g,b,a FROM o_pyramid"),
    "a1_unmapped_names": oracle(
        "o_columns",
        "SELECT dimension,x,z,height,water_y,CASE WHEN block_id=0 AND (x+z)%5=0 THEN 99 ELSE block_id END AS block_id,CASE WHEN x%7<>0 THEN biome_id END AS biome_id,"
        "CASE WHEN z%6=0 THEN 15 ELSE light END AS light,CASE WHEN z%6=0 THEN 0 ELSE block_light END AS block_light,ore_best,ore_score FROM o_columns",
    ),
    "j12_seen_without_chunks": oracle(
        "fx_slots_prev fx_slots_curr",
        "SELECT c.dimension,CAST(c.region_x*32+c.slot%32 AS INTEGER) AS chunk_x,CAST(c.region_z*32+floor(c.slot/32.0) AS INTEGER) AS chunk_z,c.stamp FROM fx_slots_curr c LEFT JOIN fx_slots_prev p USING (dimension,region_x,region_z,slot) "
        "WHERE p.stamp IS NULL OR c.stamp>p.stamp",
    ),
}
