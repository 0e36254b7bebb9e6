"""Ingest into stored and versioned tables, through streams, and ids that stay (ids S6, T4, T5, J1, J2)."""

from __future__ import annotations

from pyspark.sql import functions as F

from voxelspark.shared import new_path
from voxelspark.sources import registry, versioned
from voxelspark.streaming import jobs

from . import views as fx
from .change_queries import batches, current_areas
from .grid_queries import _hexch, _tint_hex
from .ingest_queries import known_palette
from .views import define, oracle

EPOCHS = 3


def spelled(spark, sf):
    """The batches with dimensions as requests spell them: upper case, or none at all."""
    name = F.when(F.col("seq") % 6 == 1, F.upper("dimension")).when((F.col("seq") % 6 == 5) & (F.col("op") == "upsert"), "").otherwise(F.col("dimension"))
    return batches(spark, sf).withColumn("dimension", name)


def in_epochs(rows, part, folder: str):
    """``rows`` as one file an epoch, read as a stream of them."""
    for n in range(EPOCHS):
        rows.filter(part == n).coalesce(1).write.mode("append").parquet(folder)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def q_stored(spark, sf):
    """What an ingest stores: rows of accepted batches in resolved dimensions, the others apart.
    Every batch comes in three parts."""
    out = new_path(spark, "ingest")
    rows = spelled(spark, sf)
    stream = in_epochs(rows, F.col("seq") % EPOCHS, f"{out}/items")
    jobs.ingest(stream, fx.dimensions(spark), f"{out}/accepted", f"{out}/rejected", f"{out}/checkpoint", default="view").awaitTermination()
    good, bad = spark.read.parquet(f"{out}/accepted"), spark.read.parquet(f"{out}/rejected")
    keep = ["batch_id", "seq", "id", "op"]
    return good.select(*keep, "dimension", F.lit(True).alias("accepted")).unionByName(bad.select(*keep, F.lit(None).cast("string").alias("dimension"), F.lit(False).alias("accepted")))


def q_upserts(spark, sf):
    """Three epochs of operations over a snapshot, one of them again, a compaction between: the
    content at the latest version and at the one before the last epoch."""
    out = new_path(spark, "upserts")
    table = versioned.VersionedTable(spark, f"{out}/table")
    table.replace(current_areas(spark, sf), "initial")
    rows = batches(spark, sf)
    part = F.col("batch_id") % EPOCHS
    stream = in_epochs(rows, part, f"{out}/operations")
    versioned.stream_upserts(stream, f"{out}/table", f"{out}/checkpoint", compact_every=2).awaitTermination()
    before = [e.version for e in table.entries() if e.token == "stream-1"][0]
    table.apply(rows.filter(part == 0), "stream-0")  # a replay: nothing changes
    table.vacuum(3)
    at = lambda version, name: table.read(version).select("id", "dimension", "name", F.lit(name).alias("version"))
    return at(None, "latest").unionByName(at(before, "before"))


def q_snapshots(spark, sf):
    """Daily snapshots of players, three epochs of ten days: who is there after each epoch."""
    out = new_path(spark, "snapshots")
    rows = fx.positions(spark, sf).select("player", "ts", F.floor(F.unix_timestamp("ts") / 86400).alias("batch_id"))
    rows = rows.groupBy("player", "batch_id").agg(F.max("ts").alias("ts"))
    stream = in_epochs(rows, F.least(F.floor((F.dayofmonth("ts") - 1) / 10), F.lit(2)), f"{out}/updates")
    versioned.stream_snapshots(stream, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    table = versioned.VersionedTable(spark, f"{out}/table", "player")
    every = [table.read(n).select("player", "ts", F.lit(n).alias("version")) for n in range(EPOCHS)]
    return every[0].unionByName(every[1]).unionByName(every[2])


def q_biome_ids(spark, sf):
    """Biomes registered in two runs, the second over all names; ids of the first stay."""
    ids = registry.IdRegistry(spark, new_path(spark, "biomes"))
    ids.adopt(fx.biomes(spark))
    seen = fx.raw_names(spark, sf)
    registry.registered_biomes(fx.biomes(spark), seen.filter("id % 3 = 1"), ids)
    rows = registry.registered_biomes(fx.biomes(spark), seen, ids)
    return rows.select("id", "name", "known", *[F.col(f"grass.{c}").alias(f"g_{c}") for c in "rgb"])


def q_block_ids(spark, sf):
    """Blocks registered in two runs over a palette without ids of its own, air first."""
    ids = registry.IdRegistry(spark, new_path(spark, "blocks"), ("minecraft:air",))
    palette, seen = known_palette(spark, sf), fx.raw_names(spark, sf)
    registry.registered_blocks(palette.limit(0), seen.filter("id % 2 = 0"), ids)
    rows = registry.registered_blocks(palette, seen, ids)
    return rows.filter("id > 0").select("id", "name", "known", "water")


define(
    "o_spelled",
    ("o_batches",),
    "SELECT * EXCLUDE (dimension),CASE WHEN seq%6=5 AND op='upsert' THEN 'view' ELSE dimension END AS dimension FROM o_batches",
)
define(
    "o_operations",
    ("fx_areas", "o_batches"),
    f"SELECT id,dimension,name,-1 AS epoch,-1 AS batch_id,0 AS d,0 AS seq,'upsert' AS op FROM fx_areas UNION ALL SELECT id,dimension,name,batch_id%{EPOCHS},batch_id,CASE op WHEN 'delete' THEN 1 ELSE 0 END,seq,op FROM o_batches",
)
_AT = lambda name, epoch: (
    f"SELECT id,dimension,name,'{name}' AS version FROM (SELECT *,row_number() OVER (PARTITION BY id ORDER BY epoch DESC,batch_id DESC,d DESC,seq DESC) AS rn FROM o_operations WHERE epoch<={epoch}) WHERE rn=1 AND op='upsert'"
)

define("o_first_biomes", ("o_keys",), "SELECT DISTINCT key AS name FROM o_keys WHERE id%3=1")
define("o_first_blocks", ("o_keys",), "SELECT DISTINCT key AS name FROM o_keys WHERE id%2=0")


def _numbers(known: str, first: str, start: str) -> str:
    """Ids of the first run's fresh names, then of the others, by name after ``start``."""
    fresh = f"(SELECT name FROM o_seen WHERE name NOT IN ({known}))"
    return (
        f"SELECT name,CAST({start}+row_number() OVER (ORDER BY name NOT IN (SELECT name FROM {first}),name) AS INTEGER) AS id FROM {fresh}"
    )


QUERIES = {"s6_stored_rows": q_stored, "t5_upsert_stream": q_upserts, "t4_snapshot_stream": q_snapshots, "j2_biome_ids": q_biome_ids, "j1_block_ids": q_block_ids}

ORACLE = {
    "s6_stored_rows": oracle(
        "o_spelled fx_dims",
        ", b AS (SELECT batch_id,count(*) FILTER (op='upsert' AND dimension NOT IN (SELECT dimension FROM fx_dims))=0 AND count(*)<=20000 AS accepted FROM o_spelled GROUP BY 1) "
        "SELECT batch_id,seq,id,op,CASE WHEN accepted THEN dimension END AS dimension,accepted FROM o_spelled JOIN b USING (batch_id)",
    ),
    "t5_upsert_stream": oracle("o_operations", f"{_AT('latest', EPOCHS - 1)} UNION ALL {_AT('before', 1)}"),
    "j2_biome_ids": oracle(
        "o_seen o_first_biomes fx_biomes",
        f", n AS ({_numbers('SELECT name FROM fx_biomes', 'o_first_biomes', '(SELECT max(id) FROM fx_biomes)')}), t AS (SELECT id,name,{_tint_hex(1).replace('key', 'name')} AS h FROM n) "
        f"SELECT id,name,false AS known,{','.join(f'{_hexch(chr(104), at)} AS g_{c}' for c, at in zip('rgb', (2, 4, 6)))} FROM t UNION ALL SELECT CAST(id AS INTEGER),name,true,gr_r,gr_g,gr_b FROM fx_biomes",
    ),
    "j1_block_ids": oracle(
        "o_seen o_known o_first_blocks",
        f", n AS ({_numbers('SELECT NULL WHERE false', 'o_first_blocks', '0')}) SELECT n.id,name,k.id IS NOT NULL AS known,coalesce(k.id%4=0,false) AS water FROM n LEFT JOIN o_known k USING (name)",
    ),
    "t4_snapshot_stream": oracle(
        "fx_positions",
        ", p AS (SELECT player,floor(epoch(ts)/86400) AS day,least(floor((day(ts)-1)/10.0),2) AS epoch,max(ts) AS ts FROM fx_positions GROUP BY 1,2,3), l AS (SELECT epoch,max(day) AS day FROM p GROUP BY 1) "
        "SELECT player,ts,CAST(epoch AS INTEGER) AS version FROM p JOIN l USING (epoch,day)",
    ),
}
