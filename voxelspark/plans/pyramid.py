"""Raster tiles as rows: one row per stored pixel, keyed by global pixel position.

``(zoom, gx, gy)`` addresses a pixel of a whole zoom level; its tile and offset
follow by arithmetic, so rasters are grouped, joined and rolled up like any table.
Pixels that are not stored have the fill colour.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.grid import BASE_ZOOM, TILE_PIXELS, floor_div, floor_mod

CHANNELS = ("r", "g", "b", "a")
TILE_KEYS = ("dimension", "zoom", "tile_x", "tile_y")


def base_pixels(colors: DataFrame) -> DataFrame:
    """Plan view at the base zoom: one pixel per column."""
    return colors.select(
        "dimension", F.lit(BASE_ZOOM).alias("zoom"), F.col("x").alias("gx"), F.col("z").alias("gy"), *CHANNELS
    )


def magnified_pixels(colors: DataFrame, zoom: int) -> DataFrame:
    """Plan view above the base zoom: each column repeats over a square of pixels."""
    n = 1 << (zoom - BASE_ZOOM)
    steps = F.sequence(F.lit(0), F.lit(n - 1))
    wide = colors.withColumn("_dx", F.explode(steps)).withColumn("_dy", F.explode(steps))
    return wide.select(
        "dimension",
        F.lit(zoom).alias("zoom"),
        (F.col("x") * n + F.col("_dx")).alias("gx"),
        (F.col("z") * n + F.col("_dy")).alias("gy"),
        *CHANNELS,
    )


def averaged_pixels(colors: DataFrame, zoom: int, keep_alpha: bool = False) -> DataFrame:
    """Plan view below the base zoom, straight from columns: the truncated mean of
    the explored ones. Opaque unless ``keep_alpha`` (contour lines)."""
    n = 1 << (BASE_ZOOM - zoom)
    mean = lambda c: F.floor(F.sum(c) / F.count("*")).cast("int")
    return colors.groupBy(
        "dimension", F.lit(zoom).alias("zoom"), floor_div("x", n).alias("gx"), floor_div("z", n).alias("gy")
    ).agg(
        *[mean(c).alias(c) for c in CHANNELS[:3]],
        (mean("a") if keep_alpha else F.lit(255)).alias("a"),
    )


def composite(pixels: DataFrame, fill: tuple, keys: tuple[str, ...] = ()) -> DataFrame:
    """One level up: the rounded mean of 2 x 2 pixels, missing ones being ``fill``."""
    merge = lambda c, f: F.floor((F.sum(c) + (4 - F.count("*")) * int(f) + 2) / 4).cast("int").alias(c)
    return pixels.groupBy(
        "dimension",
        *keys,
        (F.col("zoom") - 1).alias("zoom"),
        F.shiftright("gx", 1).alias("gx"),
        F.shiftright("gy", 1).alias("gy"),
    ).agg(*[merge(c, f) for c, f in zip(CHANNELS, fill)])


def build_pyramid(base: DataFrame, fill: tuple, levels: int) -> DataFrame:
    """``base`` and ``levels`` further zoom levels, each rolled up from the one before.

    Pixels are placed once by their ancestor at the last level. Every level's
    group then lies within one partition, so the whole pyramid costs one shuffle,
    which the levels share.
    """
    placed = base.withColumns(
        {"_ax": F.shiftright("gx", levels), "_ay": F.shiftright("gy", levels)}
    ).repartition("dimension", "_ax", "_ay")
    out = [placed]
    for _ in range(levels):
        out.append(composite(out[-1], fill, ("_ax", "_ay")))
    columns = ["dimension", "zoom", "gx", "gy", *CHANNELS]
    result = out[0].select(*columns)
    for level in out[1:]:
        result = result.unionByName(level.select(*columns))
    return result


def with_tiles(pixels: DataFrame) -> DataFrame:
    """Global pixel positions as tile index and offset within the tile."""
    return pixels.withColumns(
        {
            "tile_x": floor_div("gx", TILE_PIXELS),
            "tile_y": floor_div("gy", TILE_PIXELS),
            "px": floor_mod("gx", TILE_PIXELS),
            "py": floor_mod("gy", TILE_PIXELS),
        }
    ).drop("gx", "gy")


def is_fill(fill: tuple):
    return (F.col("r") == fill[0]) & (F.col("g") == fill[1]) & (F.col("b") == fill[2]) & (F.col("a") == fill[3])


def storable_tiles(tiled: DataFrame, fill: tuple) -> DataFrame:
    """Keys of tiles holding at least one pixel other than the fill colour."""
    return tiled.groupBy(*TILE_KEYS).agg(F.bool_or(~is_fill(fill)).alias("_drawn")).filter("_drawn").drop("_drawn")


def drop_blank(tiled: DataFrame, fill: tuple) -> DataFrame:
    """Pixels of tiles that are worth storing.

    A tile is blank exactly when all its stored pixels are fill, so dropping fill
    pixels alone would already be lossless; whole tiles are kept as written.
    """
    return tiled.join(storable_tiles(tiled, fill), list(TILE_KEYS), "left_semi")


def tile_errors(base_errors: DataFrame, levels: int) -> DataFrame:
    """Chunk read errors per tile, summed upward through the pyramid."""
    level = base_errors.groupBy(*TILE_KEYS).agg(F.sum("errors").alias("errors"))
    out = level
    for _ in range(levels):
        level = level.groupBy(
            "dimension",
            (F.col("zoom") - 1).alias("zoom"),
            floor_div("tile_x", 2).alias("tile_x"),
            floor_div("tile_y", 2).alias("tile_y"),
        ).agg(F.sum("errors").alias("errors"))
        out = out.unionByName(level)
    return out


def complete_tiles(tiled: DataFrame, errors: DataFrame) -> DataFrame:
    """Leave out tiles drawn with read errors, so that they are retried later."""
    bad = errors.filter("errors > 0").select(*TILE_KEYS)
    return tiled.join(bad, list(TILE_KEYS), "left_anti")


def style_classes(columns: DataFrame, zoom: int = BASE_ZOOM) -> DataFrame:
    """How many columns of each tile are explored, wet, dark, dim, lit and ore-bearing."""
    span = TILE_PIXELS << max(BASE_ZOOM - zoom, 0) if zoom <= BASE_ZOOM else TILE_PIXELS >> (zoom - BASE_ZOOM)
    light = F.col("block_light")
    return columns.groupBy(
        "dimension",
        F.lit(zoom).alias("zoom"),
        floor_div("x", span).alias("tile_x"),
        floor_div("z", span).alias("tile_y"),
    ).agg(
        F.count_if("present").alias("explored"),
        F.count_if("water").alias("wet"),
        F.count_if(light <= 0).alias("dark"),
        F.count_if((light >= 1) & (light <= 7)).alias("dim"),
        F.count_if(light >= 8).alias("lit"),
        F.count_if(F.col("ore_score") > 0).alias("ore"),
    )
