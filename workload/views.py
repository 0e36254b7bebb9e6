"""Domain inputs derived from the given Parquet tables.

Each view exists twice: as a DataFrame (Spark side) and as a SQL text (oracle
side). The world grows with the tables: every 15 000 orders open another
128 x 128 block patch, 64 patches to a row of the map; every fifth patch lies in
another dimension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DIM = "overworld"
ORDERS_PER_PATCH = 15_000

# id, name, (r, g, b, a), tint, water, transparent, decoration, height, known
BLOCKS = (
    (0, "base:stone", (125, 125, 125, 255), "none", False, False, False, 1.0, True),
    (1, "base:dirt", (134, 96, 67, 255), "none", False, False, False, 1.0, True),
    (2, "base:grass_block", (160, 160, 160, 255), "grass", False, False, False, 1.0, True),
    (3, "base:water", (63, 118, 228, 255), "water", True, False, False, 1.0, True),
    (4, "base:oak_leaves", (150, 150, 150, 255), "foliage", False, False, False, 1.0, True),
    (5, "base:short_grass", (140, 190, 90, 150), "grass", False, True, True, 1.0, True),
    (6, "base:barrier", (0, 0, 0, 255), "none", False, True, False, 1.0, True),
    (7, "base:coal_ore", (105, 105, 105, 255), "none", False, False, False, 1.0, True),
    (8, "base:diamond_ore", (120, 200, 200, 255), "none", False, False, False, 1.0, True),
    (9, "base:gold_ore", (200, 180, 90, 255), "none", False, False, False, 1.0, True),
    (10, "somemod:tin_ore", (130, 140, 150, 255), "none", False, False, False, 1.0, False),
    (11, "base:oak_slab", (162, 130, 78, 255), "none", False, False, False, 0.5, True),
)

# id, name, grass, foliage, water, overlay
# Invented colours: grass, foliage, water and overlay by number.
BIOMES = tuple(
    (n, f"base:{name}", (40 + n * 23, 90 + n * 17, 30 + n * 11), (30 + n * 19, 70 + n * 21, 20 + n * 13), (20 + n * 9, 60 + n * 12, 140 + n * 8), (10 + n * 29, 200 - n * 15, 90 + n * 16))
    for n, name in enumerate(("plains", "forest", "desert", "taiga", "swamp", "jungle", "savanna", "ice_spikes"))
)
ORE_KIND = {7: 2, 8: 9, 9: 7, 10: 1}
ORE_POINT = {7: 0, 8: 12, 9: 4, 10: 1}

_b = lambda v: "true" if v else "false"


def _block_values() -> str:
    return ", ".join(
        f"({i},'{n}',{c[0]},{c[1]},{c[2]},{c[3]},'{t}',{_b(w)},{_b(tr)},CAST({h} AS DOUBLE),false,{_b(d)},"
        f"{_b(not w and not tr and not d)},{_b(k)},{ORE_KIND.get(i, 0)},{ORE_POINT.get(i, 0)})"
        for i, n, c, t, w, tr, d, h, k in BLOCKS
    )


def _biome_values() -> str:
    return ", ".join(
        f"({i},'{n}'," + ",".join(str(v) for c in (g, f, w, o) for v in c) + ")"
        for i, n, g, f, w, o in BIOMES
    )


BLOCK_COLS = (
    "id,name,r,g,b,a,tint,water,transparent,height,grassy,decoration,occludes,known,ore_kind,ore_points"
)
BIOME_COLS = "id,name," + ",".join(f"{p}_{c}" for p in ("gr", "fo", "wa", "ov") for c in "rgb")


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def palette(spark: SparkSession) -> DataFrame:
    """The block table; ore columns are for the oracle only and left out here."""
    return spark.sql(f"SELECT * FROM VALUES {_block_values()} AS t({BLOCK_COLS})").drop("ore_kind", "ore_points")


def biomes(spark: SparkSession) -> DataFrame:
    b = spark.sql(f"SELECT * FROM VALUES {_biome_values()} AS t({BIOME_COLS})")
    s = lambda p: F.struct(*[F.col(f"{p}_{c}").alias(c) for c in "rgb"], F.lit(255).alias("a"))
    return b.select(
        "id", "name", s("gr").alias("grass"), s("fo").alias("foliage"), s("wa").alias("water"), s("ov").alias("overlay")
    )


def dimensions(spark: SparkSession) -> DataFrame:
    return spark.sql(f"SELECT * FROM VALUES {DIM_VALUES} AS t({DIM_COLS})")


DIM_COLS = "dimension,min_y,max_y,has_ceiling,border,center_x,center_z,spawn_x,spawn_z,enabled"
DIM_VALUES = (
    "('overworld',0,64,false,1600,0,0,8,-8,true), ('click',0,128,true,900,100,-50,0,0,true), "
    "('error',0,256,false,0,0,0,16,16,true), ('purchase',-64,320,false,2000,0,0,0,0,true), "
    "('signup',0,64,false,700,-200,300,5,5,false), ('view',0,64,false,1200,0,0,1,2,true)"
)


def voxels(spark: SparkSession, sf: str, partitions: int | None = None) -> DataFrame:
    """The world's voxels; with ``partitions`` they carry their chunk and are partitioned by it."""
    patch = F.floor(F.col("l_orderkey") / ORDERS_PER_PATCH)
    x = F.col("l_partkey") % 128 - 64 + 128 * (patch % 64)
    z = F.col("l_orderkey") % 128 - 64 + 128 * F.floor(patch / 64)
    keys = [
        F.when(patch % 5 < 4, DIM).otherwise("view").alias("dimension"),
        x.cast("int").alias("x"),
        F.col("l_quantity").cast("int").alias("y"),
        z.cast("int").alias("z"),
    ]
    block = ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 12).cast("int")
    lines = table(spark, sf, "lineitem")
    if partitions is not None:
        lines = lines.select(*keys, block.alias("_block"))
        lines = placed(lines.withColumns({"chunk_x": F.shiftright("x", 4), "chunk_z": F.shiftright("z", 4)}), partitions)
        keys, block = ["dimension", "chunk_x", "chunk_z", "x", "y", "z"], F.col("_block")
    v = lines.groupBy(*keys).agg(F.min(block).alias("block_id"))
    mix = F.col("x") + 64 + F.col("z") + 64
    return v.withColumns(
        {
            "light": ((mix + F.col("y") * 3) % 16).cast("int"),
            "light_above": ((mix + F.col("y")) % 16).cast("int"),
            "block_light_above": ((F.col("y") * 5) % 16).cast("int"),
            "biome_id": ((F.shiftright(F.col("x") + 64, 5) * 4 + F.shiftright(F.col("z") + 64, 5)) % 8).cast("int"),
        }
    )


def placed(rows: DataFrame, partitions: int) -> DataFrame:
    return rows.repartition(partitions, "dimension", "chunk_x", "chunk_z")


def sections(spark: SparkSession, sf: str) -> DataFrame:
    return (
        voxels(spark, sf)
        .select(
            "dimension",
            F.shiftright("x", 4).alias("chunk_x"),
            F.shiftright("z", 4).alias("chunk_z"),
            F.shiftright("y", 4).alias("section_y"),
        )
        .distinct()
    )


def positions(spark: SparkSession, sf: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return table(spark, sf, "events").select(
        F.col("event_id"),
        F.col("user_id").alias("player"),
        F.concat(F.lit("player_"), F.col("user_id").cast("string")).alias("name"),
        F.col("event_type").alias("dimension"),
        "ts",
        (F.col("value") * 4 - 1000).alias("x"),
        F.lit(64).alias("y"),
        (k * 20 - 1000).cast("double").alias("z"),
        (k * 7 % 360).cast("double").alias("rotation"),
        (F.col("user_id") % 10 == 0).alias("hidden"),
    )


def marks(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").select(
        F.col("event_type").alias("dimension"),
        F.floor(F.col("value") / 16.0).cast("int").alias("chunk_x"),
        F.floor(F.get_json_object("props", "$.k").cast("int") / 16.0).cast("int").alias("chunk_z"),
        "ts",
    )


def areas(spark: SparkSession, sf: str) -> DataFrame:
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    big = k % 50 == 0
    x0, z0 = k * 37 % 4000 - 2000, k * 91 % 4000 - 2000
    size = lambda n: F.when(big, F.lit(40000)).otherwise(16 * (1 + n % 6))
    return c.select(
        k.alias("id"),
        F.lit(DIM).alias("dimension"),
        F.col("n_name").alias("owner"),
        F.when(F.col("c_mktsegment").isin("BUILDING", "HOUSEHOLD"), "claim").otherwise("region").alias("kind"),
        F.concat(F.lit("Area of "), F.col("c_name")).alias("name"),
        x0.cast("int").alias("min_x"),
        z0.cast("int").alias("min_z"),
        (x0 + size(k)).cast("int").alias("max_x"),
        (z0 + size(F.col("c_nationkey"))).cast("int").alias("max_z"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(k % 8).cast("int").alias("min_zoom"),
        F.when(k % 5 == 0, F.lit(None)).otherwise(k % 8 + 3).cast("int").alias("max_zoom"),
    )


def claim_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """Chunk lists of the even-numbered areas; the others are plain rectangles."""
    return (
        table(spark, sf, "orders")
        .select(
            (F.col("o_custkey") - F.col("o_custkey") % 2).alias("area_id"),
            F.lit(DIM).alias("dimension"),
            (F.col("o_orderkey") % 64 - 32).cast("int").alias("chunk_x"),
            ((F.col("o_orderkey") * 7) % 64 - 32).cast("int").alias("chunk_z"),
        )
        .distinct()
    )


def viewports(spark: SparkSession, sf: str) -> DataFrame:
    """One map window per supplier, from a few blocks to many thousands."""
    k = F.col("s_suppkey")
    x0, z0 = k * 53 % 4000 - 2000, k * 17 % 4000 - 2000
    edge = F.pow(F.lit(2.0), (k % 12 + 2).cast("double")).cast("int")
    return table(spark, sf, "supplier").select(
        k.alias("view_id"),
        F.lit(DIM).alias("dimension"),
        x0.cast("int").alias("min_x"),
        z0.cast("int").alias("min_z"),
        (x0 + edge).cast("int").alias("max_x"),
        (z0 + edge).cast("int").alias("max_z"),
        (k % 9 - 1).cast("int").alias("zoom"),
    )


def markers(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf, "part").select(
        k.alias("id"),
        F.when(k % 40 == 7, "spawn").otherwise("poi").alias("kind"),
        F.col("p_name").alias("name"),
        F.element_at(F.array(F.lit(DIM), F.lit("click"), F.lit("view")), (k % 3 + 1).cast("int")).alias("dimension"),
        (k * 53 % 4000 - 2000).cast("int").alias("x"),
        F.when(k % 4 == 0, F.lit(None)).otherwise(k % 100).cast("int").alias("y"),
        (k * 29 % 4000 - 2000).cast("int").alias("z"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(k % 8).cast("int").alias("min_zoom"),
    )


def blocks_xz(spark: SparkSession, sf: str) -> DataFrame:
    """Signed block coordinates with a zoom, one per order."""
    k = F.col("o_orderkey")
    return table(spark, sf, "orders").select(
        k.alias("id"),
        (k * 7919 % 60001 - 30000).cast("int").alias("x"),
        (k * 104729 % 60001 - 30000).cast("int").alias("z"),
        (k % 384 - 64).cast("int").alias("y"),
        (k % 16).cast("int").alias("zoom"),
    )


def rays(spark: SparkSession, sf: str) -> DataFrame:
    """Screen points to resolve, one per part, spread over the world's patches."""
    k = F.col("p_partkey")
    patch = F.floor(k / 2000)
    px, pz = patch % 64, F.floor(patch / 64)
    return table(spark, sf, "part").select(
        k.alias("qid"),
        F.lit(DIM).alias("dimension"),
        (k * 37 % 2048 / 16.0 - 64 + 128 * (px - pz)).alias("u"),
        (k * 53 % 2048 / 16.0 - 80 + 64 * (px + pz)).alias("v"),
    )


def slots(spark: SparkSession, sf: str, before: str) -> DataFrame:
    k = F.col("o_custkey")
    return (
        table(spark, sf, "orders")
        .filter(F.col("o_orderdate") < F.lit(before).cast("timestamp"))
        .groupBy(
            F.lit(DIM).alias("dimension"),
            F.floor(k / 64).cast("int").alias("region_x"),
            F.lit(0).alias("region_z"),
            (k % 64).cast("int").alias("slot"),
        )
        .agg(F.unix_timestamp(F.max("o_orderdate")).alias("stamp"))
    )


def raw_names(spark: SparkSession, sf: str) -> DataFrame:
    """Block-like identifiers spelled in assorted ways, one row per part."""
    k = F.col("p_partkey")
    kinds = F.array(*[F.lit(s) for s in RAW_SUFFIXES])
    base = F.regexp_replace(F.col("p_name"), " ", "_")
    suffix = F.element_at(kinds, (k % len(RAW_SUFFIXES) + 1).cast("int"))
    prefix = F.element_at(F.array(*[F.lit(p) for p in RAW_PREFIXES]), (k % 3 + 1).cast("int"))
    tail = F.when(k % 4 == 0, F.lit("[axis=y]")).otherwise(F.lit(""))
    return table(spark, sf, "part").select(k.alias("id"), F.concat(prefix, base, suffix, tail).alias("name"))


RAW_SUFFIXES = (
    "_ore", "_slab", "_Stairs", "_carpet", "_trapdoor", "_bed", "", "_diamond_ore", "_coal_ore_block",
    "_gold_ore", "_ore_rich", "_lapis_ore", "_desert", "_snowy_taiga", "_river", "_swamp_hills", "_debris",
)
RAW_PREFIXES = (" ", "Mod:", "base:")


# ---------------------------------------------------------------------------
# Oracle side
# ---------------------------------------------------------------------------

_X = f"CAST(l_partkey%128-64+128*(CAST(floor(l_orderkey/{ORDERS_PER_PATCH}.0) AS BIGINT)%64) AS INTEGER)"
_Z = f"CAST(l_orderkey%128-64+128*CAST(floor(floor(l_orderkey/{ORDERS_PER_PATCH}.0)/64.0) AS BIGINT) AS INTEGER)"
_MIX = "(x+64+z+64)"
_K = "CAST(json_extract_string(props,'$.k') AS INTEGER)"


def _arr(values) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + "]"


VIEWS: dict[str, tuple[tuple[str, ...], str]] = {
    "fx_palette": ((), f"SELECT * FROM (VALUES {_block_values()}) t({BLOCK_COLS})"),
    "fx_biomes": ((), f"SELECT * FROM (VALUES {_biome_values()}) t({BIOME_COLS})"),
    "fx_dims": ((), f"SELECT * FROM (VALUES {DIM_VALUES}) t({DIM_COLS})"),
    "fx_v0": (
        (),
        f"SELECT CASE WHEN CAST(floor(l_orderkey/{ORDERS_PER_PATCH}.0) AS BIGINT)%5<4 THEN '{DIM}' ELSE 'view' END AS dimension, {_X} AS x, CAST(l_quantity AS INTEGER) AS y, {_Z} AS z, "
        "CAST(MIN((l_suppkey*7+l_linenumber)%12) AS INTEGER) AS block_id FROM lineitem GROUP BY 1,2,3,4",
    ),
    "fx_voxels": (
        ("fx_v0",),
        f"SELECT *, CAST(({_MIX}+y*3)%16 AS INTEGER) AS light, CAST(({_MIX}+y)%16 AS INTEGER) AS light_above, "
        "CAST((y*5)%16 AS INTEGER) AS block_light_above, "
        "CAST((CAST(floor((x+64)/32.0) AS INTEGER)*4+CAST(floor((z+64)/32.0) AS INTEGER))%8 AS INTEGER) AS biome_id FROM fx_v0",
    ),
    "fx_sections": (
        ("fx_voxels",),
        "SELECT DISTINCT dimension, CAST(floor(x/16.0) AS INTEGER) AS chunk_x, CAST(floor(z/16.0) AS INTEGER) AS chunk_z, "
        "CAST(floor(y/16.0) AS INTEGER) AS section_y FROM fx_voxels",
    ),
    "fx_positions": (
        (),
        "SELECT event_id, user_id AS player, 'player_'||user_id AS name, event_type AS dimension, ts, value*4-1000 AS x, 64 AS y, "
        f"CAST({_K}*20-1000 AS DOUBLE) AS z, CAST({_K}*7%360 AS DOUBLE) AS rotation, user_id%10=0 AS hidden FROM events",
    ),
    "fx_marks": (
        (),
        "SELECT event_type AS dimension, CAST(floor(value/16.0) AS INTEGER) AS chunk_x, "
        f"CAST(floor({_K}/16.0) AS INTEGER) AS chunk_z, ts FROM events",
    ),
    "fx_areas": (
        (),
        f"SELECT c_custkey AS id, '{DIM}' AS dimension, n_name AS owner, "
        "CASE WHEN c_mktsegment IN ('BUILDING','HOUSEHOLD') THEN 'claim' ELSE 'region' END AS kind, "
        "'Area of '||c_name AS name, "
        "CAST(c_custkey*37%4000-2000 AS INTEGER) AS min_x, CAST(c_custkey*91%4000-2000 AS INTEGER) AS min_z, "
        "CAST(c_custkey*37%4000-2000+CASE WHEN c_custkey%50=0 THEN 40000 ELSE 16*(1+c_custkey%6) END AS INTEGER) AS max_x, "
        "CAST(c_custkey*91%4000-2000+CASE WHEN c_custkey%50=0 THEN 40000 ELSE 16*(1+c_nationkey%6) END AS INTEGER) AS max_z, "
        "CAST(CASE WHEN c_custkey%3=0 THEN NULL ELSE c_custkey%8 END AS INTEGER) AS min_zoom, "
        "CAST(CASE WHEN c_custkey%5=0 THEN NULL ELSE c_custkey%8+3 END AS INTEGER) AS max_zoom "
        "FROM customer JOIN nation ON c_nationkey=n_nationkey",
    ),
    "fx_claim_chunks": (
        (),
        f"SELECT DISTINCT o_custkey-o_custkey%2 AS area_id, '{DIM}' AS dimension, CAST(o_orderkey%64-32 AS INTEGER) AS chunk_x, "
        "CAST((o_orderkey*7)%64-32 AS INTEGER) AS chunk_z FROM orders",
    ),
    "fx_viewports": (
        (),
        f"SELECT s_suppkey AS view_id, '{DIM}' AS dimension, CAST(s_suppkey*53%4000-2000 AS INTEGER) AS min_x, "
        "CAST(s_suppkey*17%4000-2000 AS INTEGER) AS min_z, "
        "CAST(s_suppkey*53%4000-2000+(1<<CAST(s_suppkey%12+2 AS INTEGER)) AS INTEGER) AS max_x, "
        "CAST(s_suppkey*17%4000-2000+(1<<CAST(s_suppkey%12+2 AS INTEGER)) AS INTEGER) AS max_z, "
        "CAST(s_suppkey%9-1 AS INTEGER) AS zoom FROM supplier",
    ),
    "fx_markers": (
        (),
        "SELECT p_partkey AS id, CASE WHEN p_partkey%40=7 THEN 'spawn' ELSE 'poi' END AS kind, p_name AS name, "
        f"(['{DIM}','click','view'])[CAST(p_partkey%3+1 AS INTEGER)] AS dimension, "
        "CAST(p_partkey*53%4000-2000 AS INTEGER) AS x, CAST(CASE WHEN p_partkey%4=0 THEN NULL ELSE p_partkey%100 END AS INTEGER) AS y, "
        "CAST(p_partkey*29%4000-2000 AS INTEGER) AS z, "
        "CAST(CASE WHEN p_partkey%3=0 THEN NULL ELSE p_partkey%8 END AS INTEGER) AS min_zoom FROM part",
    ),
    "fx_blocks": (
        (),
        "SELECT o_orderkey AS id, CAST(o_orderkey*7919%60001-30000 AS INTEGER) AS x, "
        "CAST(o_orderkey*104729%60001-30000 AS INTEGER) AS z, CAST(o_orderkey%384-64 AS INTEGER) AS y, "
        "CAST(o_orderkey%16 AS INTEGER) AS zoom FROM orders",
    ),
    "fx_rays": (
        (),
        f"SELECT p_partkey AS qid, '{DIM}' AS dimension, "
        "CAST(p_partkey*37%2048/16.0e0-64+128*(CAST(floor(p_partkey/2000.0) AS BIGINT)%64-CAST(floor(p_partkey/128000.0) AS BIGINT)) AS DOUBLE) AS u, "
        "CAST(p_partkey*53%2048/16.0e0-80+64*(CAST(floor(p_partkey/2000.0) AS BIGINT)%64+CAST(floor(p_partkey/128000.0) AS BIGINT)) AS DOUBLE) AS v FROM part",
    ),
    "fx_names": (
        (),
        f"SELECT p_partkey AS id, ({_arr(RAW_PREFIXES)})[CAST(p_partkey%3+1 AS INTEGER)]||replace(p_name,' ','_')||"
        f"({_arr(RAW_SUFFIXES)})[CAST(p_partkey%{len(RAW_SUFFIXES)}+1 AS INTEGER)]||"
        "CASE WHEN p_partkey%4=0 THEN '[axis=y]' ELSE '' END AS name FROM part",
    ),
}
for _name, _date in (("fx_slots_prev", "1997-01-01"), ("fx_slots_curr", "1997-07-01")):
    VIEWS[_name] = (
        (),
        f"SELECT '{DIM}' AS dimension, CAST(floor(o_custkey/64.0) AS INTEGER) AS region_x, 0 AS region_z, "
        "CAST(o_custkey%64 AS INTEGER) AS slot, CAST(epoch(max(o_orderdate)) AS BIGINT) AS stamp "
        f"FROM orders WHERE o_orderdate < TIMESTAMP '{_date}' GROUP BY 1,2,3,4",
    )


def define(name: str, needs: tuple[str, ...], body: str) -> None:
    """Add a derived oracle view that later queries may build on."""
    VIEWS[name] = (needs, body)


def oracle(needs: str, body: str, recursive: bool = False) -> str:
    """SQL text of ``body`` preceded by the views it needs, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in VIEWS[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in needs.split():
        visit(name)
    if not order:
        return body
    ctes = ", ".join(f"{n} AS ({VIEWS[n][1]})" for n in order)
    return f"WITH {'RECURSIVE ' if recursive else ''}{ctes} {body}"
