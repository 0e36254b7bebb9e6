"""Column summaries: what is visible when looking straight down.

Voxels carry ``dimension, x, y, z, block_id, light, light_above,
block_light_above, biome_id``; air is not stored. ``sections`` lists the populated
16-block sections of each chunk, including those that hold only air.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names
from ..functions.grid import block_to_chunk, floor_div, in_bounds
from .spatial import BOUNDS, rectangle_join

KEYS = ("dimension", "x", "z")
Y_BIAS = 2048  # elevations are 16-bit in the world format but within +-2048 in practice
NO_ID = (1 << 16) - 1  # stands for a missing block or biome inside a packed long


def is_placed(voxels: DataFrame) -> bool:
    """Whether voxels carry ``chunk_x`` and ``chunk_z``: then they are partitioned by chunk, and all
    that follows is done inside a chunk, without another shuffle."""
    return {"chunk_x", "chunk_z"} <= set(voxels.columns)


def with_block_flags(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """Attach the surface rules of each block; names are read once per palette row.

    A block that the palette does not know is solid ground without ores.
    """
    kind = names.classify_ore("name")
    flags = palette.select(
        F.col("id").alias("block_id"),
        "water",
        "transparent",
        "decoration",
        kind.alias("ore_kind"),
        names.ore_points(kind).alias("ore_points"),
    )
    unknown = {"water": False, "transparent": False, "decoration": False, "ore_kind": 0, "ore_points": 0}
    return voxels.join(flags, "block_id", "left").fillna(unknown)


def is_ground() -> Column:
    return ~F.col("water") & ~F.col("transparent")


def is_decoration() -> Column:
    return ~F.col("water") & F.col("transparent") & F.col("decoration")


def below_ceiling(voxels: DataFrame, dimensions: DataFrame) -> DataFrame:
    """In roofed dimensions, drop everything from the build limit up."""
    roof = dimensions.filter("has_ceiling").select("dimension", (F.col("max_y") - 1).alias("_roof"))
    j = voxels.join(roof, "dimension", "left")
    return j.filter(F.col("_roof").isNull() | (F.col("y") <= F.col("_roof"))).drop("_roof")


def _within(value: Column, bits: int, what: str) -> Column:
    """The value, or an error if it does not fit: a packed field never wraps."""
    text = F.concat(F.lit(f"{what} outside 0..{(1 << bits) - 1}: "), value.cast("string"))
    return F.when((value < 0) | (value >= 1 << bits), F.raise_error(text).cast("long")).otherwise(value.cast("long"))


def _id(name: str) -> Column:
    return F.coalesce(_within(F.col(name), 16, name), F.lit(NO_ID).cast("long"))


def _real_id(packed: str, low: int) -> Column:
    return F.nullif(_bits(packed, low, 16), F.lit(NO_ID))


def _pack(*fields: tuple[Column | str, int]) -> Column:
    """Fields from most to least significant, in one long, so that max() compares
    them in order and the aggregate stays a fixed-width hash aggregate."""
    out = F.lit(0).cast("long")
    for value, bits in fields:
        v = (F.col(value) if isinstance(value, str) else value).cast("long")
        out = F.shiftleft(out, bits).bitwiseOR(v)
    return out


def _bits(packed: str, low: int, width: int) -> Column:
    return F.shiftright(packed, low).bitwiseAND(F.lit((1 << width) - 1)).cast("int")


def chunk_floors(sections: DataFrame) -> DataFrame:
    return sections.groupBy("dimension", "chunk_x", "chunk_z").agg(
        (F.min("section_y") * 16).cast("int").alias("floor_y")
    )


def surface_scan(
    voxels: DataFrame, palette: DataFrame, sections: DataFrame, dimensions: DataFrame | None = None
) -> DataFrame:
    """One row per explored column: ground, water, decoration, light and ores.

    A single partial aggregation reduces each column to a few longs before the
    shuffle. Decorations, which depend on the ground found, are the only voxels
    joined back, on the same key and partitioning. Voxels that are placed by chunk
    (:func:`is_placed`) read their ground in a window instead; place ``sections`` likewise.
    """
    v = with_block_flags(voxels, palette)
    if dimensions is not None:
        v = below_ceiling(v, dimensions)
    height = _within(F.col("y") + Y_BIAS, 12, "elevation above -2048")
    light = F.coalesce(F.col("light_above"), F.lit(15))
    block_light = F.coalesce(F.col("block_light_above"), F.lit(0))
    block, biome = _id("block_id"), _id("biome_id")
    ground = _pack((height, 12), (block, 16), (light, 4), (block_light, 4), (biome, 16))
    summary = [
        F.max(F.when(is_ground(), ground)).alias("_ground"),
        F.max(F.when(F.col("water"), _pack((height, 12), (block, 16), (biome, 16)))).alias("_water"),
        F.max("ore_kind").alias("ore_best"),
        F.least(F.lit(255), F.sum("ore_points")).cast("int").alias("ore_score"),
    ]
    found = F.col("_ground").isNotNull() | F.col("_water").isNotNull()
    plant, ground_y = _pack((height, 12), (block, 16)), F.shiftright("_ground", 40)
    above = F.shiftright("_plant", 16) > ground_y
    lowest = F.min(F.when(above, F.col("_plant"))).alias("_plant")
    if is_placed(voxels):
        keys = ["dimension", "chunk_x", "chunk_z", "x", "z"]
        v = v.withColumn("_plant", F.when(is_decoration(), plant))
        v = v.withColumn("_ground", F.max(F.when(is_ground(), ground)).over(Window.partitionBy(*keys)))
        cols = v.groupBy(*keys).agg(*summary, lowest).filter(found)
    else:
        base = v.groupBy(*KEYS).agg(*summary).filter(found)
        plants = v.filter(is_decoration()).select(*KEYS, plant.alias("_plant"))
        cols = base.join(plants, list(KEYS), "left").groupBy(*base.columns).agg(lowest)
        cols = cols.withColumns({"chunk_x": block_to_chunk("x"), "chunk_z": block_to_chunk("z")})
    cols = cols.join(chunk_floors(sections), ["dimension", "chunk_x", "chunk_z"], "left")
    dry = F.col("_ground").isNotNull()
    water_y = (F.shiftright("_water", 32) - Y_BIAS).cast("int")
    ground_height = (ground_y - Y_BIAS).cast("int")
    wet = F.when(dry, F.coalesce(water_y > ground_height, F.lit(False))).otherwise(True)
    either = lambda on_ground, no_ground: F.when(dry, on_ground).otherwise(no_ground).cast("int")
    return cols.select(
        *KEYS,
        either(ground_height, F.col("floor_y")).alias("height"),
        F.when(wet, water_y).alias("water_y"),
        either(_real_id("_ground", 24), _real_id("_water", 16)).alias("block_id"),
        F.when(dry, _real_id("_plant", 0)).alias("decoration_id"),
        either(_real_id("_ground", 0), _real_id("_water", 0)).alias("biome_id"),
        either(_bits("_ground", 20, 4), F.lit(15)).alias("light"),
        either(_bits("_ground", 16, 4), F.lit(0)).alias("block_light"),
        "ore_best",
        "ore_score",
        F.lit(True).alias("present"),
        wet.alias("water"),
    )


def render_y() -> Column:
    """Elevation a column is drawn at: the water surface when wet."""
    return F.when(F.col("water"), F.col("water_y")).otherwise(F.col("height"))


def water_depth() -> Column:
    return F.when(F.col("water"), F.greatest(F.lit(0), F.col("water_y") - F.col("height"))).otherwise(0)


def ore_summary(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    return (
        with_block_flags(voxels, palette)
        .groupBy(*KEYS)
        .agg(
            F.max("ore_kind").alias("ore_best"),
            F.least(F.lit(255), F.sum("ore_points")).cast("int").alias("ore_score"),
        )
    )


def height_range(columns: DataFrame) -> DataFrame:
    return (
        columns.filter("present")
        .groupBy("dimension")
        .agg(F.min(render_y()).alias("low"), F.max(render_y()).alias("high"))
    )


def height_band(
    observed: DataFrame, dimensions: DataFrame, previous: DataFrame | None = None, margin: int = 32
) -> DataFrame:
    """Widen-only band of rendered elevations, padded and clamped per dimension.

    ``observed`` and ``previous`` have ``dimension, low, high, depth``; dimensions
    never observed get their full build range.
    """
    seen = observed if previous is None else previous.unionByName(observed)
    merged = seen.groupBy("dimension").agg(
        F.min("low").alias("low"), F.max("high").alias("high"), F.max("depth").alias("depth")
    )
    lo = F.greatest(F.col("min_y"), F.col("low") - margin)
    hi = F.least(F.col("max_y"), F.col("high") + margin)
    known = F.col("low").isNotNull()
    return dimensions.join(merged, "dimension", "left").select(
        "dimension",
        F.when(known, lo).otherwise(F.col("min_y")).alias("band_low"),
        F.when(known, F.greatest(lo, hi)).otherwise(F.col("max_y")).alias("band_high"),
        "depth",
        known.alias("observed"),
    )


def slab_depth_limit(depth, ceiling: int) -> Column:
    d = F.col(depth)
    return F.when(d.isNull() | (d <= 0) | (d > ceiling), F.lit(ceiling)).otherwise(d)


def chunk_ground_level(columns: DataFrame, percentile: int = 25) -> DataFrame:
    """Rendered elevation at a fixed index of each chunk's sorted columns.

    At most 256 columns exist per chunk, so the collected list is bounded.
    """
    ordered = F.sort_array(F.collect_list(render_y()))
    grouped = (
        columns.filter("present")
        .groupBy("dimension", block_to_chunk("x").alias("chunk_x"), block_to_chunk("z").alias("chunk_z"))
        .agg(ordered.alias("_h"))
    )
    index = F.floor(F.size("_h") * percentile / F.lit(100)).cast("int") + 1
    return grouped.select("dimension", "chunk_x", "chunk_z", F.element_at("_h", index).alias("ground_y"))


def dimension_y_range(sections: DataFrame) -> DataFrame:
    return sections.groupBy("dimension").agg(
        (F.min("section_y") * 16).cast("int").alias("min_y"),
        (F.max("section_y") * 16 + 16).cast("int").alias("max_y"),
    )


def window_columns(columns: DataFrame, windows: DataFrame, errors: DataFrame | None = None) -> DataFrame:
    """Columns of every requested block window, through the chunks that exist.

    ``windows`` has ``window_id, dimension, min_x, min_z, max_x, max_z``. A window of
    any size only meets stored chunks, so a missing chunk contributes nothing;
    unreadable ones are counted in ``chunk_errors``.
    """
    on = ["dimension", "chunk_x", "chunk_z"]
    cells = columns.withColumns({"chunk_x": block_to_chunk("x"), "chunk_z": block_to_chunk("z")})

    def meeting(chunks: DataFrame) -> DataFrame:
        rect = {n: F.col(c) * 16 + d for n, c, d in zip(BOUNDS, ("chunk_x", "chunk_z") * 2, (0, 0, 16, 16))}
        pairs = rectangle_join(windows, chunks.select(*on).distinct().withColumns(rect))
        return pairs.withColumnsRenamed({"r_chunk_x": "chunk_x", "r_chunk_z": "chunk_z"})

    keyed = meeting(cells).select("window_id", *on, *BOUNDS)
    hit = keyed.join(cells, on).filter(in_bounds("x", "z", *BOUNDS)).drop(*BOUNDS, "chunk_x", "chunk_z")
    if errors is None:
        return hit
    failed = meeting(errors).groupBy("window_id").agg(F.count("*").alias("chunk_errors"))
    return hit.join(failed, "window_id", "left").fillna({"chunk_errors": 0})


STRIP = 4  # bits: strips of 1, 16, 256, ... rows


def _strips(low: Column, high: Column, last: int) -> Column:
    """``[low, high)`` as the fewest whole strips of the levels 0 to ``last``, few of each level but the last."""
    begin = lambda k: F.call_function("shiftright", low + ((1 << STRIP * k) - 1), F.lit(STRIP * k))
    end = lambda k: F.call_function("shiftright", high, F.lit(STRIP * k))
    none = F.array().cast("array<bigint>")
    upto = lambda a, b: F.when(a < b, F.sequence(a, b - 1)).otherwise(none)
    parts = []
    for k in range(last + 1):
        a, b = begin(k), end(k)
        places = upto(a, b)
        if k < last:
            inner, outer = begin(k + 1), end(k + 1)
            places = F.when(inner < outer, F.concat(upto(a, inner * (1 << STRIP)), upto(outer * (1 << STRIP), b))).otherwise(places)
        level = F.lit(k).alias("level")
        parts.append(F.transform(places, lambda p: F.struct(level, p.alias("strip"))))  # noqa: B023  called at once
    return F.concat(*parts)


def window_sums(points: DataFrame, windows: DataFrame, value: str | None = None) -> DataFrame:
    """Per window with any point inside: ``window_id``, their number ``n`` and the sum of ``value``.

    No point is paired with a window. Points are summed into strips of whole rows of z, and a window's rows
    are few strips; in each, the running sums along x are read before both ends of the window.
    """
    x0, z0, x1, z1 = [F.ceil(F.col(c)).cast("long") for c in BOUNDS]
    w = windows.filter("dimension is not null").filter((F.col("max_x") > F.col("min_x")) & (F.col("max_z") > F.col("min_z")))
    w = w.select("window_id", "dimension", x0.alias("x0"), x1.alias("x1"), z0.alias("z0"), z1.alias("z1"))
    widest, last = w.agg(F.max(F.col("z1") - F.col("z0"))).first()[0] or 1, 0
    while (1 << STRIP * (last + 1)) <= widest:
        last += 1
    ends = F.array(F.struct(F.lit(-1).alias("sign"), F.col("x0").alias("at")), F.struct(F.lit(1).alias("sign"), F.col("x1").alias("at")))
    asked = w.withColumn("_s", F.explode(_strips(F.col("z0"), F.col("z1"), last))).withColumn("_e", F.explode(ends))
    zero = lambda name: F.lit(0).cast("long").alias(name)
    asked = asked.select("dimension", "_s.*", "_e.at", "_e.sign", "window_id", zero("n"), zero("known"), zero("total"))

    v = F.lit(None).cast("long") if value is None else F.col(value).cast("long")
    rows = points.filter("dimension is not null and x is not null and z is not null").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(last))))
    strip = F.expr(f"shiftright(cast(z as bigint), level * {STRIP})")
    rows = rows.groupBy("dimension", "level", strip.alias("strip"), F.col("x").cast("long").alias("at")).agg(
        F.count(F.lit(1)).alias("n"), F.count(v).alias("known"), F.coalesce(F.sum(v), F.lit(0)).alias("total")
    )
    # Rows of windows come before points at the same place: an end is not inside.
    rows = rows.withColumns({"sign": F.lit(0), "window_id": F.lit(None).cast(w.schema["window_id"].dataType)})
    along = Window.partitionBy("dimension", "level", "strip").orderBy("at", F.col("sign") == 0).rowsBetween(Window.unboundedPreceding, 0)
    names = ("n", "known", "total")
    run = rows.unionByName(asked).select("window_id", "sign", *[F.sum(c).over(along).alias(c) for c in names]).filter("sign <> 0")
    sums = run.groupBy("window_id").agg(*[F.sum(F.col("sign") * F.col(c)).alias(c) for c in names]).filter("n > 0")
    return sums.select("window_id", "n", *([] if value is None else [F.when(F.col("known") > 0, F.col("total")).alias(value)]))


def vertical_runs(voxels: DataFrame) -> DataFrame:
    """Top-down runs of stored voxels in each column: run 1 is the topmost."""
    down = Window.partitionBy(*KEYS).orderBy(F.desc("y"))
    gap = F.coalesce((F.lag("y").over(down) - F.col("y")) > 1, F.lit(False))
    runs = voxels.select(*KEYS, "y", gap.cast("int").alias("_gap"))
    return (
        runs.withColumn("run", F.sum("_gap").over(down) + 1)
        .groupBy(*KEYS, "run")
        .agg(F.max("y").alias("run_top"), F.min("y").alias("run_bottom"))
    )


def occupancy(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """16-bit occupancy word of every column section, built with partial bit-or.

    Sections without any opaque or decorative voxel in the whole chunk read as air.
    """
    v = with_block_flags(voxels, palette)
    solid = ~F.col("transparent") | F.col("decoration")
    words = v.groupBy(*KEYS, floor_div("y", 16).alias("section_y")).agg(
        F.bit_or(F.pow(F.lit(2), F.pmod("y", F.lit(16))).cast("int")).alias("word"),
        F.bool_or(solid).alias("_solid"),
    )
    words = words.withColumns({"chunk_x": block_to_chunk("x"), "chunk_z": block_to_chunk("z")})
    on = ["dimension", "chunk_x", "chunk_z", "section_y"]
    live = words.groupBy(*on).agg(F.bool_or("_solid").alias("_live")).filter("_live").select(*on)
    return words.join(live, on, "left_semi").drop("_solid")


def canopy_spans(voxels: DataFrame, palette: DataFrame) -> DataFrame:
    """Top of each column and the drop from it to the first surface under a gap.

    The column's words, top section first, make a string of 0s and 1s whose
    leading runs are the canopy and the gap; no gap gives NULL.
    """
    words = occupancy(voxels, palette).groupBy(*KEYS, "chunk_x", "chunk_z").agg(
        F.map_from_entries(F.collect_list(F.struct("section_y", "word"))).alias("_words"),
        F.max("section_y").alias("_top"),
        F.min("section_y").alias("_low"),
    )
    text = F.array_join(
        F.transform(
            F.sequence(F.col("_top"), F.col("_low")),
            lambda s: F.lpad(F.bin(F.coalesce(F.try_element_at("_words", s), F.lit(0))), 16, "0"),
        ),
        "",
    )
    words = words.withColumn("_bits", text)
    top = F.col("_top") * 16 + 15 - (F.instr("_bits", "1") - 1)
    span = F.length(F.regexp_extract("_bits", "^0*(1+0+)1", 1))
    return words.select(
        *KEYS,
        "chunk_x",
        "chunk_z",
        top.cast("int").alias("top_y"),
        F.when(span > 0, span).alias("span"),
    )


def slab_depths(
    spans: DataFrame, below_ground: int = 16, min_depth: int = 8, max_depth: int = 64
) -> DataFrame:
    """Layers kept per chunk: the deepest canopy drop plus a margin, clamped."""
    depth = F.coalesce(F.max("span"), F.lit(0)) + below_ground
    return spans.groupBy("dimension", "chunk_x", "chunk_z").agg(
        F.least(F.lit(max_depth), F.greatest(F.lit(min_depth), depth)).cast("int").alias("depth")
    )


def extract_slabs(voxels: DataFrame, spans: DataFrame, depths: DataFrame) -> DataFrame:
    """Voxels within ``depth`` layers of their column's top."""
    on = ["dimension", "chunk_x", "chunk_z"]
    tops = spans.join(depths, on).select(*KEYS, "top_y", "depth")
    kept = voxels.join(tops, list(KEYS)).filter(F.col("y") > F.col("top_y") - F.col("depth"))
    return kept.filter(F.col("y") <= F.col("top_y"))


def placed_slabs(voxels: DataFrame, palette: DataFrame, below_ground: int = 16, min_depth: int = 8, max_depth: int = 64) -> DataFrame:
    """:func:`extract_slabs` with its spans and depths for voxels placed by chunk, in windows of a chunk.

    A column's top is its highest voxel in a section that is not all air (see :func:`occupancy`);
    its span reaches down to the first such voxel under a gap.
    """
    chunk = ["dimension", "chunk_x", "chunk_z"]
    column = Window.partitionBy(*chunk, "x", "z")
    down = column.orderBy(F.desc("y"))
    v = with_block_flags(voxels, palette).withColumn("_section", floor_div("y", 16))
    live = F.bool_or(~F.col("transparent") | F.col("decoration")).over(Window.partitionBy(*chunk, "_section"))
    v = v.select(*voxels.columns, F.when(live, F.col("y")).alias("_y"))
    before = F.last("_y", ignorenulls=True).over(down.rowsBetween(Window.unboundedPreceding, -1))
    v = v.withColumn("_gap", F.coalesce(before - F.col("_y") > 1, F.lit(False)).cast("int"))
    v = v.withColumn("_run", F.sum("_gap").over(down.rowsBetween(Window.unboundedPreceding, 0)))
    v = v.withColumns({"top_y": F.max("_y").over(column), "_next": F.max(F.when(F.col("_run") == 1, F.col("_y"))).over(column)})
    span = F.coalesce(F.max(F.col("top_y") - F.col("_next")).over(Window.partitionBy(*chunk)), F.lit(0)) + below_ground
    v = v.withColumn("depth", F.least(F.lit(max_depth), F.greatest(F.lit(min_depth), span)).cast("int"))
    kept = v.filter((F.col("y") > F.col("top_y") - F.col("depth")) & (F.col("y") <= F.col("top_y")))
    return kept.select(*voxels.columns, "top_y", "depth")
