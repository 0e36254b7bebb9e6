"""Structured Streaming jobs around the change pipeline.

Every job is built from the batch operators, so a stream and a table give the same
rows. Sinks are idempotent per micro-batch: replays overwrite the same partitions.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.grid import x_shard
from ..operators import changes
from ..plans import pyramid
from ..sources.overlays import batch_verdicts, resolved_dimension
from ..sources.tiles import merge_partitions, staged, stored_rows


def settled_stream(marks: DataFrame, settle: str = "3 seconds", late: str = "0 seconds") -> DataFrame:
    """Chunks that have gone quiet, as a stream in append mode.

    A mark later than the watermark opens a new session; the rebuild it triggers is
    idempotent.
    """
    return changes.settled_chunks(marks.withWatermark("ts", late), settle)


def height_band_stream(observed: DataFrame) -> DataFrame:
    """Running elevation band per dimension, for update or complete output mode."""
    return observed.groupBy("dimension").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("depth").alias("depth")
    )


def ingest(
    items: DataFrame,
    dimensions: DataFrame,
    accepted_path: str,
    rejected_path: str,
    checkpoint: str,
    key: str = "id",
    default: str | None = None,
    shards: int = 64,
    **options,
) -> StreamingQuery:
    """Validated ingest: whole batches are stored or quarantined.

    Accepted rows are stored in their resolved dimension (an empty one is ``default``), those of
    the quarantine as they came, so that a verdict can be taken again. ``shards`` is the number of
    directories that batches are spread over; it is fixed for a store.

    A batch may arrive over several micro-batches. Its verdict is taken anew over all rows
    that have come, so what was stored of it moves to the quarantine when a bad row follows. The
    quarantine is written first: a replay finds every row in one place at least.
    """

    def route(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        new = batch.withColumns(
            {"epoch": F.lit(epoch).cast("long"), "batch_shard": F.pmod(F.xxhash64("batch_id"), F.lit(shards)).cast("int")}
        )
        ids = new.select("batch_id").distinct()
        rows, barred = new, ids.limit(0)
        for path in (rejected_path, accepted_path):
            old = stored_rows(spark, path, new.schema)
            if old is not None:
                # A batch that is in quarantine is there as a whole.
                old = old.filter(F.col("epoch") != epoch).join(ids, "batch_id", "left_semi").join(barred, "batch_id", "left_anti")
                rows, barred = rows.unionByName(old.select(*new.columns)), old.select("batch_id").distinct()
        verdict = batch_verdicts(rows, dimensions, key, default=default).select("batch_id", "accepted")
        with staged(rows.join(verdict, "batch_id"), rejected_path) as known:
            every = known.select("batch_shard", "batch_id")
            for path, good in ((rejected_path, False), (accepted_path, True)):
                part = known.filter(F.col("accepted") == good).select(*new.columns)
                part = resolved_dimension(part, dimensions, default) if good else part
                merge_partitions(part, every, path, ["batch_shard"], ["batch_id"])

    return _start(items, route, checkpoint, **options)


def rebuild_tiles(
    marks: DataFrame,
    base_pixels_of: Callable[[DataFrame], DataFrame],
    levels_path: str,
    checkpoint: str,
    min_zoom: int,
    base_zoom: int = 6,
    fill: tuple = (20, 22, 26, 255),
    **options,
) -> StreamingQuery:
    """Incremental pyramid: only tiles under the changed chunks are rebuilt.

    ``base_pixels_of(tiles)`` returns base-zoom pixels of the given tile keys.
    Each level is written before the next is read, deepest first, and replaces
    exactly its dirty tiles; a dirty tile without pixels keeps one row without colour
    (see :func:`read_levels`). Directories are shards of tiles, never single tiles.
    """

    def rebuild(batch: DataFrame, epoch: int) -> None:
        dirty = changes.affected_tiles(batch, min_zoom, base_zoom, modes=("top",)).select(
            "dimension", "zoom", "tile_x", "tile_y"
        )
        spark = batch.sparkSession
        base = base_pixels_of(dirty.filter(F.col("zoom") == base_zoom))
        _write_level(base, dirty.filter(F.col("zoom") == base_zoom), levels_path)
        for zoom in range(base_zoom - 1, min_zoom - 1, -1):
            want = dirty.filter(F.col("zoom") == zoom)
            below = read_levels(spark, levels_path).filter(F.col("zoom") == zoom + 1)
            parents = below.withColumns(
                {"_px": F.shiftright("tile_x", 1), "_py": F.shiftright("tile_y", 1)}
            ).join(
                want.select("dimension", F.col("tile_x").alias("_px"), F.col("tile_y").alias("_py")),
                ["dimension", "_px", "_py"],
                "left_semi",
            )
            above = pyramid.composite(parents.select("dimension", "zoom", "gx", "gy", *pyramid.CHANNELS), fill)
            _write_level(above, want, levels_path)

    return _start(marks, rebuild, checkpoint, **options)


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """Pixels of all stored levels."""
    return spark.read.parquet(path).filter(F.col(pyramid.CHANNELS[0]).isNotNull())


def _write_level(pixels: DataFrame, dirty: DataFrame, path: str) -> None:
    keys = ["dimension", "zoom", "x_shard", "tile_x", "tile_y"]
    rows = pixels.select("dimension", F.col("zoom").cast("int").alias("zoom"), "gx", "gy", *pyramid.CHANNELS)
    rows = rows.withColumns({"tile_x": F.shiftright("gx", 9), "tile_y": F.shiftright("gy", 9)}).withColumn("x_shard", x_shard("tile_x"))
    replaced = dirty.withColumn("x_shard", x_shard("tile_x")).select(*keys)
    corners = {"gx": F.shiftleft("tile_x", 9), "gy": F.shiftleft("tile_y", 9)}
    gone = replaced.join(rows.select(*keys).distinct(), keys, "left_anti").withColumns(corners)
    kinds = {c: rows.schema[c].dataType for c in rows.columns}
    gone = gone.select(*[F.lit(None).cast(k).alias(c) if c in pyramid.CHANNELS else F.col(c).cast(k).alias(c) for c, k in kinds.items()])
    merge_partitions(rows.unionByName(gone), replaced, path, ["dimension", "zoom", "x_shard"], ["tile_x", "tile_y"])


def player_events(players: DataFrame, dimensions: DataFrame) -> DataFrame:
    """``player.move`` rows, one per visible player, for enabled dimensions."""
    enabled = dimensions.filter("enabled").select("dimension")
    rows = players.filter(~F.col("hidden")).join(enabled, "dimension", "left_semi")
    return rows.select(
        "dimension",
        F.lit("player.move").alias("type"),
        F.to_json(F.struct("player", "name", "x", "y", "z", "rotation")).alias("data"),
    )


def chunk_events(chunk_tiles: DataFrame, revisions: DataFrame) -> DataFrame:
    """``chunk.updated`` rows: one per chunk and tile it dirtied, with the revision.

    ``chunk_tiles`` comes from :func:`changes.tiles_of_chunks`.
    """
    return chunk_tiles.join(revisions, changes.TILE).select(
        "dimension",
        F.lit("chunk.updated").alias("type"),
        F.to_json(F.struct("chunk_x", "chunk_z", "mode", "zoom", "tile_x", "tile_y", "revision")).alias("data"),
    )


def feature_events(touched: DataFrame, kinds: list[str]) -> DataFrame:
    """``<kind>.updated`` rows for each touched dimension."""
    kind = F.explode(F.array(*[F.lit(f"{k}.updated") for k in kinds]))
    return touched.select("dimension").distinct().select("dimension", kind.alias("type"), F.lit(None).cast("string").alias("data"))


def subscribed(events: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """Events each client should get: its dimension's, or all if it names none."""
    topics = events.withColumn("_topic", F.explode(F.array(F.col("dimension"), F.lit(""))))
    return topics.join(subscriptions.withColumnRenamed("dimension", "_topic"), "_topic").drop("_topic")


def _start(stream: DataFrame, per_batch, checkpoint: str, **options) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(per_batch)
        .option("checkpointLocation", checkpoint)
        .trigger(**(options or {"availableNow": True}))
        .start()
    )
