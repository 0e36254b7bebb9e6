"""From changed chunks to stale tiles: detection, coalescing, fan-out, revisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import iso
from ..functions.grid import (
    CHUNK_BLOCKS,
    REGION_CHUNKS,
    block_to_tile,
    col,
    tiles_covering,
    x_shard,
)

REGION = ["dimension", "region_x", "region_z"]
TILE = ["dimension", "mode", "zoom", "tile_x", "tile_y"]


def changed_slots(before: DataFrame, now: DataFrame, regions: DataFrame | None = None) -> DataFrame:
    """Chunk slots that are new or carry a later stamp than in the last snapshot.

    A region never seen before is a baseline and reports nothing. Both sides have
    ``dimension, region_x, region_z, slot, stamp``; where both carry ``mtime``, a
    region whose file is not newer is skipped. ``regions`` lists the regions seen before
    (with ``mtime`` where that counts), those without any chunk too; by default those of
    ``before``.
    """
    known = before if regions is None else regions
    with_time = "mtime" in known.columns and "mtime" in now.columns
    seen = known.groupBy(*REGION).agg(*([F.max("mtime").alias("_mtime")] if with_time else [F.count("*").alias("_n")]))
    fresh = now.join(seen, REGION)
    if with_time:
        fresh = fresh.filter(F.col("mtime") > F.col("_mtime"))
    old = before.select(*REGION, "slot", F.col("stamp").alias("_old"))
    j = fresh.join(old, [*REGION, "slot"], "left")
    n = REGION_CHUNKS
    return j.filter(F.col("_old").isNull() | (F.col("stamp") > F.col("_old"))).select(
        "dimension",
        (F.col("region_x") * n + F.pmod("slot", F.lit(n))).alias("chunk_x"),
        (F.col("region_z") * n + F.floor(F.col("slot") / n).cast("int")).alias("chunk_z"),
        "stamp",
    )


def settled_chunks(marks: DataFrame, settle: str = "3 seconds") -> DataFrame:
    """One row per burst of marks of a chunk, once it has been quiet for ``settle``.

    The same expression serves batch tables and watermarked streams.
    """
    return (
        marks.groupBy("dimension", "chunk_x", "chunk_z", F.session_window("ts", settle))
        .agg(F.count("*").alias("marks"))
        .select(
            "dimension", "chunk_x", "chunk_z", F.col("session_window.end").alias("settled_at"), "marks"
        )
    )


def drain(marks: DataFrame, now: Column, settle: str = "3 seconds") -> DataFrame:
    """Chunks whose last mark is at least ``settle`` old."""
    last = marks.groupBy("dimension", "chunk_x", "chunk_z").agg(F.max("ts").alias("last_mark"))
    return last.filter(F.col("last_mark") <= now - F.expr(f"INTERVAL {settle}"))


def tiles_of_chunks(
    chunks: DataFrame,
    min_zoom: int,
    max_zoom: int,
    modes: tuple[str, ...] = ("top", "iso"),
    min_y: int | Column = -64,
    max_y: int | Column = 320,
    camera: str = iso.DEFAULT_CAMERA,
) -> DataFrame:
    """Each chunk with every tile it paints into, in every mode and zoom."""
    size = CHUNK_BLOCKS
    x0, z0 = F.col("chunk_x") * size, F.col("chunk_z") * size
    keys = chunks.select("dimension", "chunk_x", "chunk_z", col(min_y).alias("_lo"), col(max_y).alias("_hi")).distinct()
    each = keys.withColumn("zoom", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
    found = []
    for mode in modes:
        if mode == "iso":
            rect = iso.footprint_of_blocks((x0, z0, x0 + size, z0 + size), F.col("_lo"), F.col("_hi"), camera)
            cover = iso.tiles_of_screen_rect(rect, "zoom")
        else:
            cover = tiles_covering((x0, z0, x0 + size, z0 + size), F.col("zoom"))
        found.append(
            each.withColumns({"mode": F.lit(mode), "_t": F.explode(cover)}).select(
                "dimension", "chunk_x", "chunk_z", "mode", "zoom", "_t.tile_x", "_t.tile_y"
            )
        )
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def affected_tiles(chunks: DataFrame, min_zoom: int, max_zoom: int, **how) -> DataFrame:
    """Distinct tiles that any of the chunks paints into; see :func:`tiles_of_chunks`."""
    return tiles_of_chunks(chunks, min_zoom, max_zoom, **how).select(*TILE).distinct()


def deepest_first(tiles: DataFrame) -> DataFrame:
    return tiles.orderBy(F.desc("zoom"), "dimension", "mode", "tile_x", "tile_y")


def work_items(tiles: DataFrame, styles: list[str], variants: list[str] = [""]) -> DataFrame:
    """Every tile in every style; isometric tiles also in every camera variant."""
    v = F.when(F.col("mode") == "iso", F.array(*[F.lit(x) for x in variants])).otherwise(F.array(F.lit("")))
    return tiles.withColumn("style", F.explode(F.array(*[F.lit(s) for s in styles]))).withColumn(
        "variant", F.explode(v)
    )


def number_in_order(rows: DataFrame, group: str, order: list[str], start: int) -> DataFrame:
    """Consecutive numbers from ``start + 1`` by ``group``, then by ``order``.

    Rows are numbered among those that differ in the last column of ``order`` alone; only
    the counts of these runs (for tiles, one a column of tiles) are summed in one place.
    """
    rows = rows.withColumn("_part", F.struct(*order[:-1]))
    sizes = rows.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    totals = sizes.groupBy(group).agg(F.sum("_n").alias("_total"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_total").over(before), F.lit(0)))
    inside = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_off", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    offsets = sizes.join(totals, group).select(group, "_part", (F.col("_base") + F.col("_off")).alias("_off"))
    w = Window.partitionBy(group, "_part").orderBy(order[-1])
    return (
        rows.join(offsets, [group, "_part"])
        .withColumn("revision", F.lit(start) + F.col("_off") + F.row_number().over(w))
        .drop("_part", "_off")
    )


def effective_revisions(tile_bumps: DataFrame, dimension_bumps: DataFrame) -> DataFrame:
    """Current revision of each tile ever bumped: its own, unless its dimension was
    bumped later, which erases it."""
    own = tile_bumps.groupBy(*TILE).agg(F.max("revision").alias("_own"))
    base = dimension_bumps.groupBy("dimension").agg(F.max("revision").alias("_base"))
    j = own.join(base, "dimension", "left")
    live = F.col("_base").isNull() | (F.col("_own") > F.col("_base"))
    return j.select(*TILE, F.when(live, F.col("_own")).otherwise(F.col("_base")).alias("revision"), live.alias("override"))


def changed_since(tile_bumps: DataFrame, dimension_bumps: DataFrame, dimension: str | None = None) -> DataFrame:
    """Catch-up feed: tiles bumped after their dimension's baseline."""
    rows = effective_revisions(tile_bumps, dimension_bumps).filter("override").drop("override")
    return rows if dimension is None else rows.filter(F.col("dimension") == dimension)


def slice_retention(touches: DataFrame, keep: int = 12) -> DataFrame:
    """Slice levels of each family, marked kept or evicted by recency of touch."""
    last = touches.groupBy("family", "level").agg(F.max("ts").alias("last_touch"))
    rank = F.row_number().over(Window.partitionBy("family").orderBy(F.desc("last_touch"), F.desc("level")))
    return last.withColumn("kept", rank <= keep)


def tile_variant(mode, camera, slice_y) -> Column:
    """Storage variant of a tile: empty in plan view and for the default camera."""
    side = F.when(col(camera) == iso.DEFAULT_CAMERA, None).otherwise(col(camera))
    cut = F.concat(F.lit("y"), col(slice_y).cast("string"))
    return F.when(col(mode) == "iso", F.concat_ws("_", side, cut)).otherwise("")


def tile_keys(tiles: DataFrame) -> DataFrame:
    """Complete storage key; everything that changes the picture is part of it."""
    return tiles.withColumns({"x_shard": x_shard("tile_x")})


def apply_upserts(current: DataFrame, batches: DataFrame, key: str = "id") -> DataFrame:
    """Rows after applying upserts and deletes; within a batch, deletes come last.

    ``batches`` adds ``batch_id``, ``seq`` and ``op`` (``upsert`` or ``delete``).
    """
    base = current.withColumns({"batch_id": F.lit(-1).cast("long"), "seq": F.lit(0).cast("long"), "op": F.lit("upsert")})
    every = base.unionByName(batches, allowMissingColumns=True)
    late = F.struct("batch_id", (F.col("op") == "delete").cast("int").alias("d"), "seq")
    values = [c for c in every.columns if c not in (key, "batch_id", "seq")]
    last = every.groupBy(key).agg(F.max_by(F.struct(*values), late).alias("_s")).select(key, "_s.*")
    return last.filter("op = 'upsert'").drop("op")


def touched_dimensions(current: DataFrame, batches: DataFrame, key: str = "id") -> DataFrame:
    """Dimensions each batch touches, through its upserts or the rows it removes.

    A removal touches the dimension that its row has by then: that of the operation before
    it, where a batch's removals follow its upserts. A row that is gone has none.
    """
    base = current.select(key, "dimension", F.lit(-1).cast("long").alias("batch_id"), F.lit(0).cast("long").alias("seq"), F.lit("upsert").alias("op"))
    every = base.unionByName(batches.select(*base.columns))
    w = Window.partitionBy(key).orderBy("batch_id", F.col("op") == "delete", "seq")
    before = F.when(F.lag("op").over(w) == "upsert", F.lag("dimension").over(w))
    touched = every.withColumn("dimension", F.when(F.col("op") == "delete", before).otherwise(F.col("dimension")))
    return touched.filter("batch_id >= 0 and dimension is not null").select("batch_id", "dimension").distinct()


def live_entities(updates: DataFrame, key: str, now: Column, stale: str = "30 seconds") -> DataFrame:
    """Entities seen within ``stale`` of ``now``."""
    last = updates.groupBy(key).agg(F.max("ts").alias("last_seen"))
    return last.filter(F.col("last_seen") >= now - F.expr(f"INTERVAL {stale}"))


def covering_tiles(bounds: DataFrame, min_zoom: int, max_zoom: int) -> DataFrame:
    """Plan tiles covering block bounds at each zoom, by ranges rather than lists."""
    span = lambda lo, hi: F.sequence(block_to_tile(lo, F.col("zoom")), block_to_tile(F.col(hi) - 1, F.col("zoom")))
    each = bounds.filter((F.col("max_x") > F.col("min_x")) & (F.col("max_z") > F.col("min_z")))
    return (
        each.withColumn("zoom", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
        .withColumn("tile_x", F.explode(span("min_x", "max_x")))
        .withColumn("tile_y", F.explode(span("min_z", "max_z")))
        .select("dimension", F.lit("top").alias("mode"), "zoom", "tile_x", "tile_y")
    )


def sweep_plan(
    dimensions: DataFrame,
    stored: DataFrame,
    min_zoom: int,
    max_zoom: int,
    modes: tuple[str, ...] = ("top", "iso"),
    default_border: int = 4000,
    camera: str = iso.DEFAULT_CAMERA,
) -> DataFrame:
    """Tiles still missing from a store, over each dimension's border and every zoom."""
    half = F.floor(F.when(F.col("border") > 0, F.col("border")).otherwise(default_border) / 2).cast("int")
    cx, cz = F.col("center_x"), F.col("center_z")
    area = dimensions.select(
        "dimension", "min_y", "max_y", (cx - half).alias("min_x"), (cz - half).alias("min_z"),
        (cx + half).alias("max_x"), (cz + half).alias("max_z"),
    )
    plans = []
    if "top" in modes:
        plans.append(covering_tiles(area, min_zoom, max_zoom))
    if "iso" in modes:
        rect = iso.footprint_of_blocks(("min_x", "min_z", "max_x", "max_z"), "min_y", "max_y", camera)
        each = area.withColumn("zoom", F.explode(F.sequence(F.lit(min_zoom), F.lit(max_zoom))))
        (x0, y0), (x1, y1) = iso.tile_at(rect[0], rect[1], "zoom"), iso.tile_at(rect[2], rect[3], "zoom")
        plans.append(
            each.select("dimension", "zoom", F.sequence(x0, x1).alias("_xs"), F.sequence(y0, y1).alias("_ys"))
            .withColumn("tile_x", F.explode("_xs"))
            .withColumn("tile_y", F.explode("_ys"))
            .select("dimension", F.lit("iso").alias("mode"), "zoom", "tile_x", "tile_y")
        )
    plan = plans[0]
    for more in plans[1:]:
        plan = plan.unionByName(more)
    return plan.join(stored.select(*TILE), TILE, "left_anti")
