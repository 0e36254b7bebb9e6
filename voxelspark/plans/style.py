"""Column colours in six styles: terrain, biome, height, light, ore, contour."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import color
from ..functions.color import Rgba
from ..operators.neighbours import with_neighbours
from ..operators.surface import render_y, water_depth


@dataclass(frozen=True)
class StyleOptions:
    """Visual treatment; the defaults give pronounced relief."""

    height_shading: bool = True
    shading_strength: float = 0.35
    shading_clamp: float = 3.0
    ambient_height: float = 0.10
    biome_tint: bool = True
    water_depth_shading: bool = True
    max_water_depth: float = 28.0
    light_shading: bool = False
    contour: bool = False
    contour_interval: int = 8
    contour_major_every: int = 4
    unexplored: tuple = color.UNEXPLORED
    contour_minor_color: tuple = color.CONTOUR_MINOR
    contour_major_color: tuple = color.CONTOUR_MAJOR
    height_ramp: tuple = field(default=color.HEIGHT_RAMP)

    def fill(self, style: str) -> tuple:
        return (0, 0, 0, 0) if style == "contour" else self.unexplored


def relief_factor(o: StyleOptions, y="ry", north="north", west="west") -> Column:
    """Brightness from the step up or down to the northern and western columns."""
    h = F.col(y).cast("double")
    n, w = F.col(north), F.col(west)
    total = F.coalesce(h - n, F.lit(0.0)) + F.coalesce(h - w, F.lit(0.0))
    count = n.isNotNull().cast("int") + w.isNotNull().cast("int")
    mean = F.when(count > 0, total / F.greatest(count, F.lit(1))).otherwise(F.lit(0.0))
    limit = o.shading_clamp if o.shading_clamp > 0 else 6.0
    step = F.greatest(F.lit(-limit), F.least(F.lit(limit), mean)) / F.lit(limit)
    shade = F.signum(step) * F.sqrt(F.abs(step)) * o.shading_strength + 1
    if o.ambient_height <= 0:
        return shade
    t = color.height_percent(y, "min_y", "max_y")
    return shade * (t * o.ambient_height + (1 - o.ambient_height * 0.5))


def contour_class(o: StyleOptions, y="ry", north="north", west="west") -> Column:
    """2 for an index line, 1 for a minor line, 0 for none."""
    interval = o.contour_interval if o.contour_interval > 0 else 8
    every = o.contour_major_every if o.contour_major_every > 0 else 4
    level = lambda c: F.floor(F.col(c) / F.lit(interval))
    here = level(y)

    def against(other: str) -> Column:
        there = level(other)
        major = F.pmod(F.least(here, there) + 1, F.lit(every)) == 0
        return F.when(F.col(other).isNull() | (here == there), 0).when(major, 2).otherwise(1)

    return F.greatest(against(north), against(west))


def attach_palettes(columns: DataFrame, palette: DataFrame, biomes: DataFrame, dimensions: DataFrame) -> DataFrame:
    """Colours of block, decoration and biome, and the dimension's build range."""
    tone = F.struct("r", "g", "b", "a")
    block = palette.select(F.col("id").alias("block_id"), tone.alias("block_rgba"), F.col("tint").alias("block_tint"))
    plant = palette.select(
        F.col("id").alias("decoration_id"), tone.alias("plant_rgba"), F.col("tint").alias("plant_tint")
    )
    climate = biomes.select(
        F.col("id").alias("biome_id"),
        F.col("grass").alias("biome_grass"),
        F.col("foliage").alias("biome_foliage"),
        F.col("water").alias("biome_water"),
        F.col("overlay").alias("biome_overlay"),
    )
    span = dimensions.select("dimension", "min_y", "max_y")
    return (
        columns.join(block, "block_id", "left")
        .join(plant, "decoration_id", "left")
        .join(climate, "biome_id", "left")
        .join(span, "dimension", "left")
    )


def block_color(o: StyleOptions, which: str) -> Rgba:
    base = color.load(f"{which}_rgba")
    if not o.biome_tint:
        return base
    tints = [color.load(f"biome_{n}") for n in ("grass", "foliage", "water")]
    return color.apply_tint(base, f"{which}_tint", *tints)


def water_color(o: StyleOptions, floor: Rgba, depth) -> Rgba:
    water = color.load("biome_water") if o.biome_tint else color.rgba(color.PLAIN_WATER)
    if not o.water_depth_shading:
        return water
    return color.water_over(floor, water, depth, o.max_water_depth if o.max_water_depth > 0 else 28.0)


def paint(rows: DataFrame, style: str, o: StyleOptions) -> DataFrame:
    """Add ``base`` (side faces) and ``top`` (with decoration) colour structs, unshaded."""
    rows = rows.withColumn("_block", block_color(o, "block").struct())
    block = color.load("_block")
    if style in ("terrain", "ore"):
        terrain = color.pick(F.col("water"), water_color(o, block, water_depth()), block)
        rows = rows.withColumn("_terrain", terrain.struct())
    if style == "biome":
        base = color.load("biome_overlay")
    elif style == "height":
        base = color.gradient(o.height_ramp, color.height_percent(render_y(), "min_y", "max_y"))
    elif style == "light":
        base = color.light_style("block_light")
    elif style == "ore":
        base = color.ore_style(color.load("_terrain"), "ore_best", "ore_score")
    else:
        base = color.load("_terrain")
    rows = rows.withColumns({"base": base.struct(), "_plant": block_color(o, "plant").struct()})
    planted = color.alpha_over(color.load("_plant"), color.load("base"))
    top = color.pick(F.col("decoration_id").isNotNull(), planted, color.load("base"))
    return rows.withColumn("top", top.struct()).drop("_block", "_terrain", "_plant")


def shade(rows: DataFrame, o: StyleOptions, *fields: str) -> DataFrame:
    """Apply relief and light brightness to colour structs in place."""
    factors = []
    if o.height_shading:
        rows = rows.withColumn("_relief", relief_factor(o))
        factors.append(F.col("_relief"))
    if o.light_shading:
        factors.append(color.light_factor("light"))
    for name in fields:
        for f in factors:
            rows = rows.withColumn(name, color.scale(color.load(name), f).struct())
    return rows.drop("_relief")


def column_colors(
    columns: DataFrame,
    palette: DataFrame,
    biomes: DataFrame,
    dimensions: DataFrame,
    style: str = "terrain",
    options: StyleOptions = StyleOptions(),
    keep: tuple[str, ...] = (),
) -> DataFrame:
    """One pixel colour per explored column; contour keeps only columns on a line."""
    rows = columns.filter("present").withColumn("ry", render_y())
    if options.height_shading or style == "contour":
        rows = with_neighbours(rows, {"north": ("z", -1, "ry"), "west": ("x", -1, "ry")})
    if style == "contour":
        rows = rows.withColumn("_line", contour_class(options) if options.contour else F.lit(0))
        rows = rows.filter("_line > 0")
        c = color.pick(
            F.col("_line") == 2, color.rgba(options.contour_major_color), color.rgba(options.contour_minor_color)
        )
        return rows.select("dimension", "x", "z", *keep, *c.columns())
    rows = attach_palettes(rows, palette, biomes, dimensions)
    rows = shade(paint(rows, style, options), options, "top")
    return rows.select("dimension", "x", "z", *keep, "top.*")
