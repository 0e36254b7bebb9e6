"""Isometric views: faces, screen cells and the nearest contributor of each pixel.

Screen cells carry global pixel positions like every other raster here, so tiles
need no overscan: a tall column simply contributes rows to several tiles.

The voxel view sends no pixels over the network: whole faces go to squares of the screen, once, and
are spread into pixels there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, iso
from ..functions.color import Rgba
from ..functions.grid import BASE_ZOOM
from ..operators.neighbours import with_neighbours
from ..operators.surface import is_placed, render_y, slab_depth_limit, water_depth, window_columns
from ..shared import written
from .style import (
    StyleOptions,
    attach_palettes,
    block_color,
    contour_class,
    paint,
    relief_factor,
    shade,
    water_color,
)

# Brightness of the two side faces, and wall height at the world's edge.
LEFT_SHADE = 0.82
RIGHT_SHADE = 0.68
EDGE_SKIRT = 4
MIN_DIRECT_ZOOM = BASE_ZOOM + 1
RANK_Y = 8192  # room for an elevation and a flag below each depth plane
SQUARE = 7  # bits: squares of 128 x 128 pixels


def exposed_depth(y, neighbour, skirt: int = EDGE_SKIRT) -> Column:
    """Blocks of side face visible against a neighbour; a missing one shows a skirt."""
    y, n = F.col(y) if isinstance(y, str) else y, F.col(neighbour)
    return F.when(n.isNull(), F.lit(skirt)).otherwise(F.greatest(F.lit(0), y - n))


def with_exposure(columns: DataFrame, camera: str = iso.DEFAULT_CAMERA, skirt: int = EDGE_SKIRT) -> DataFrame:
    """Add ``left_depth`` (+b side) and ``right_depth`` (+a side) to present columns."""
    rows = columns.filter("present").withColumn("ry", render_y())
    (la, ls), (ra, rs) = iso.neighbour_step("b", camera), iso.neighbour_step("a", camera)
    near = {"_left": (la, ls, "ry"), "_right": (ra, rs, "ry"), "north": ("z", -1, "ry"), "west": ("x", -1, "ry")}
    rows = with_neighbours(rows, near)
    return rows.withColumns(
        {"left_depth": exposed_depth("ry", "_left", skirt), "right_depth": exposed_depth("ry", "_right", skirt)}
    ).withColumnsRenamed({"_left": "left_y", "_right": "right_y"})


def face_colors(
    exposed: DataFrame, palette: DataFrame, biomes: DataFrame, dimensions: DataFrame, style: str, o: StyleOptions
) -> DataFrame:
    """Shaded ``top`` and ``base`` colour of every column that may be drawn."""
    if style == "contour":
        line = contour_class(o) if o.contour else F.lit(0)
        none = color.rgba((0, 0, 0, 0))
        major, minor = color.rgba(o.contour_major_color), color.rgba(o.contour_minor_color)
        top = color.pick(line == 2, major, color.pick(line == 1, minor, none))
        return exposed.withColumns({"top": top.struct(), "base": none.struct()})
    rows = attach_palettes(exposed, palette, biomes, dimensions)
    return shade(paint(rows, style, o), o, "top", "base")


def argb(c: Rgba) -> Column:
    """A colour in one int-sized long: alpha, red, green, blue."""
    up = lambda ch, bits: F.shiftleft(ch.cast("long"), bits)
    return up(c.a, 24).bitwiseOR(up(c.r, 16)).bitwiseOR(up(c.g, 8)).bitwiseOR(c.b.cast("long"))


def from_argb(packed: str) -> list[Column]:
    part = lambda bits: F.shiftright(packed, bits).bitwiseAND(F.lit(255).cast("long")).cast("int")
    return [part(16).alias("r"), part(8).alias("g"), part(0).alias("b"), part(24).alias("a")]


def _spread(rows: DataFrame, ppu: int, left_px: Column, right_px: Column, top_on: Column, cut: bool = False) -> DataFrame:
    """Cells of a diamond and its two walls: offsets ``_i``, ``_j`` and ``_face``.

    The diamond is ``2 * ppu`` wide; ``_face`` is 0 top, 1 left wall, 2 right wall. ``cut`` leaves
    those within the row's square of the screen.
    """
    w, h = 2 * ppu, ppu
    begin = lambda square, at: F.shiftleft(square, SQUARE) - F.col(at)
    end = lambda square, at: begin(F.col(square) + 1, at) - 1
    i0, i1 = F.lit(0), F.lit(w - 1)
    if cut:
        i0, i1 = F.greatest(i0, begin(F.col("_sx"), "_x0")), F.least(i1, end("_sx", "_x0"))
    rows = rows.withColumn("_i", F.explode(F.sequence(i0, i1)))
    e = F.least(F.col("_i"), F.lit(w - 1) - F.col("_i"))
    low, high = F.shiftright(F.lit(h) - e, 1), F.shiftright(F.lit(h - 1) + e, 1)
    wall = F.when(F.col("_i") < ppu, left_px).otherwise(right_px)
    first = F.when(top_on, low).otherwise(high + 1)
    last = high + wall
    if cut:
        first, last = F.greatest(first, begin(F.col("_sy"), "_y0")), F.least(last, end("_sy", "_y0"))
    rows = rows.withColumns({"_high": high, "_first": first, "_last": last})
    cells = rows.filter(F.col("_last") >= F.col("_first")).withColumn("_j", F.explode(F.sequence("_first", "_last")))
    face = F.when(F.col("_j") <= F.col("_high"), 0).when(F.col("_i") < ppu, 1).otherwise(2)
    return cells.withColumn("_face", face).drop("_high", "_first", "_last")


def _face_colors(rows: DataFrame) -> DataFrame:
    """Packed colours of top, left and right face, once per block, before any cell exists."""
    base = color.load("base")
    return rows.withColumns(
        {
            "_c0": argb(color.load("top")),
            "_c1": argb(color.scale(base, F.lit(LEFT_SHADE))),
            "_c2": argb(color.scale(base, F.lit(RIGHT_SHADE))),
        }
    ).drop("top", "base")


def _cell_rows(cells: DataFrame, *carried: str) -> DataFrame:
    shown = F.when(F.col("_face") == 0, F.col("_c0")).when(F.col("_face") == 1, F.col("_c1")).otherwise(F.col("_c2"))
    return cells.select(
        "dimension",
        *carried,
        (F.col("_x0") + F.col("_i")).alias("gx"),
        (F.col("_y0") + F.col("_j")).alias("gy"),
        "_rank",
        shown.alias("_argb"),
    )


def nearest(cells: DataFrame, zoom: int) -> DataFrame:
    """The contributor nearest to the viewer at each pixel, by a hash aggregate.

    ``_rank`` grows toward the viewer, so no ordering of the cells is needed.
    """
    squares = [c for c in ("_sx", "_sy") if c in cells.columns]
    best = cells.groupBy("dimension", *squares, "gx", "gy").agg(F.max_by("_argb", "_rank").alias("_c"))
    return best.select("dimension", F.lit(zoom).alias("zoom"), "gx", "gy", *from_argb("_c"))


def nearest_faces(faces: DataFrame, zoom: int, partitions: int) -> DataFrame:
    """:func:`nearest` of whole faces: ``_x0, _y0`` of the diamond, heights ``_l, _r`` of its walls, ``_on``
    if its top is drawn, colours ``_c0, _c1, _c2`` and ``_rank``.

    A face goes to every square of the screen it touches; its cells there exist only in that
    square's task. Few bytes make many pixels, so the number of partitions is fixed.
    """
    ppu = 1 << (zoom - BASE_ZOOM)
    span = lambda low, more: F.explode(F.sequence(F.shiftright(low, SQUARE), F.shiftright(F.col(low) + more, SQUARE)))
    placed = faces.withColumn("_sx", span("_x0", F.lit(2 * ppu - 1)))
    placed = placed.withColumn("_sy", span("_y0", F.lit(ppu - 1) + F.greatest("_l", "_r"))).repartition(partitions, "dimension", "_sx", "_sy")
    cells = _spread(placed, ppu, F.col("_l"), F.col("_r"), F.col("_on"), cut=True)
    return nearest(_cell_rows(cells, "_sx", "_sy"), zoom)


def height_field_faces(faces: DataFrame, zoom: int, camera: str = iso.DEFAULT_CAMERA) -> DataFrame:
    """Columns with ``top``, ``base`` and exposures as faces of the screen; see :func:`nearest_faces`."""
    if zoom < MIN_DIRECT_ZOOM:
        raise ValueError("levels below the first direct zoom are composited, not drawn")
    ppu = 1 << (zoom - BASE_ZOOM)
    a, b = iso.rotate("x", "z", camera)
    rows = faces.select(
        "dimension", "left_depth", "right_depth", "top", "base", (a + b).cast("long").alias("_rank"),
        ((a - b - 1) * ppu).alias("_x0"), ((a + b) * (ppu // 2) - (F.col("ry") + 1) * ppu).alias("_y0"),
    )
    rows = rows.withColumns({"_l": F.col("left_depth") * ppu, "_r": F.col("right_depth") * ppu, "_on": F.lit(True)})
    return _face_colors(rows).drop("left_depth", "right_depth")


def height_field_cells(faces: DataFrame, zoom: int, camera: str = iso.DEFAULT_CAMERA) -> DataFrame:
    """Every screen cell that columns with ``top``, ``base`` and exposures contribute."""
    rows = height_field_faces(faces, zoom, camera)
    return _cell_rows(_spread(rows, 1 << (zoom - BASE_ZOOM), F.col("_l"), F.col("_r"), F.col("_on")))


def height_field_view(
    columns: DataFrame,
    palette: DataFrame,
    biomes: DataFrame,
    dimensions: DataFrame,
    zoom: int = MIN_DIRECT_ZOOM,
    camera: str = iso.DEFAULT_CAMERA,
    style: str = "terrain",
    options: StyleOptions = StyleOptions(),
    skirt: int = EDGE_SKIRT,
) -> DataFrame:
    """Isometric pixels of the column surface, drawn as extruded height field."""
    faces = face_colors(with_exposure(columns, camera, skirt), palette, biomes, dimensions, style, options)
    return nearest(height_field_cells(faces, zoom, camera), zoom)


def with_block_shape(voxels: DataFrame, palette: DataFrame, how: str = "inner") -> DataFrame:
    full = F.when((F.col("height") > 0) & (F.col("height") <= 1), F.col("height")).otherwise(F.lit(1.0))
    shape = palette.select(
        F.col("id").alias("block_id"), full.alias("block_height"), "decoration", F.col("water").alias("block_water"),
        (F.col("occludes") & (full >= 1)).alias("hides"),
    )
    return voxels.join(shape, "block_id", how)


def _hidden() -> dict[str, Column]:
    """Bits by elevation: which voxels are hidden on top, on the left and on the right."""
    return {
        "_up": F.expr("shiftrightunsigned(_word, 1) | shiftleft(coalesce(_over, 0L), 63)"),
        "_left": F.coalesce("_left", F.lit(0).cast("long")),
        "_right": F.coalesce("_right", F.lit(0).cast("long")),
    }


def _column_words(slabs: DataFrame, palette: DataFrame, camera: str) -> DataFrame:
    """One row per column and 64 elevations: its voxels (``_voxels``) and, as bits by elevation,
    which of them are hidden on top (``_up``), on the left (``_left``) and on the right (``_right``).

    Only these rows are shuffled to blocks and sorted for the neighbours.
    """
    v = with_block_shape(slabs, palette)
    carried = [c for c in v.columns if c not in ("dimension", "x", "z")]
    bit = F.expr("shiftleft(1L, y & 63)")
    rows = v.groupBy("dimension", "x", "z", F.shiftright("y", 6).alias("_part")).agg(
        F.bit_or(F.when(F.col("hides"), bit).otherwise(0)).alias("_word"),
        F.collect_list(F.struct(*carried)).alias("_voxels"),
    )
    (la, ls), (ra, rs) = iso.neighbour_step("b", camera), iso.neighbour_step("a", camera)
    near = {"_over": ("_part", 1, "_word"), "_left": (la, ls, "_word"), "_right": (ra, rs, "_word")}
    rows = with_neighbours(rows, near, axes=("x", "_part", "z"), blocked=("x", "z"), block=64)
    return rows.withColumns(_hidden()).drop("_word", "_over")


def _drawn_columns(slabs: DataFrame, columns: DataFrame, palette: DataFrame, camera: str, slice_y: int | None, partitions: int) -> DataFrame:
    """What the voxel view draws: one row per column and 64 elevations of its slab (see :func:`_column_words`),
    with the column's facts and its neighbours' elevations (``_fact``) and the plant on its top
    (``_crown``), and one row (``_bare``) of every column without a slab.

    Slabs and columns go to the same blocks in one shuffle; what a column knows reaches its slab by
    a window in the block. Everything above the slice is known air.
    """
    on = ["dimension", "x", "z"]
    cut = F.col("top_y") if slice_y is None else F.least(F.col("top_y"), F.lit(slice_y))
    keys = [*on, "chunk_x", "chunk_z"] if is_placed(slabs) else on
    v = with_block_shape(slabs.filter("dimension is not null and x is not null and z is not null"), palette, "left")
    kept = F.col("block_height").isNotNull() & (F.lit(True) if slice_y is None else F.col("y") <= slice_y)
    # The plant on top of a column, if its top voxel is one, is painted on the voxel below.
    plant = F.when(F.col("decoration"), F.struct(F.col("block_id").alias("id"), F.col("light").alias("light")))
    at_cut = kept & (F.col("y") == cut)
    words = v.groupBy(*keys, F.shiftright("y", 6).alias("_part")).agg(
        F.bit_or(F.when(kept & F.col("hides"), F.expr("shiftleft(1L, y & 63)")).otherwise(0)).alias("_word"),
        F.collect_list(F.when(kept, F.struct("y", "block_id", "light"))).alias("_voxels"),
        F.max("top_y").alias("top_y"), F.max("depth").alias("depth"),
        F.max((F.col("depth") > 0) & (F.col("y") == F.col("top_y"))).alias("_stored"),
        F.max(F.when(at_cut, plant)).alias("_crown"),
        F.max(F.when(at_cut & (F.col("y").bitwiseAND(F.lit(63)) == 0), plant)).alias("_foot"),
    )
    seen = columns.filter("present").withColumn("ry", render_y())
    fields = [c for c in columns.columns if c not in (*on, "chunk_x", "chunk_z")]
    seen = seen.select(*on, F.lit(None).cast("int").alias("_part"), "ry", F.struct(*fields).alias("_column"))
    rows = words.drop("chunk_x", "chunk_z").unionByName(seen, allowMissingColumns=True)
    (la, ls), (ra, rs) = iso.neighbour_step("b", camera), iso.neighbour_step("a", camera)
    near = {
        "_over": ("_part", 1, "_word"), "_left": (la, ls, "_word"), "_right": (ra, rs, "_word"), "_next": ("_part", 1, "_foot"),
        "left_y": (la, ls, "ry"), "right_y": (ra, rs, "ry"), "north": ("z", -1, "ry"), "west": ("x", -1, "ry"),
    }
    rows = with_neighbours(rows, near, axes=("x", "_part", "z"), blocked=("x", "z"), block=64, partitions=partitions, keep_homes=True)
    own = F.when(F.col("_column").isNotNull(), F.struct("_column.*", "ry", "left_y", "right_y", "north", "west"))
    whole = Window.partitionBy("dimension", "_home_x", "_home_z", "x", "z")
    rows = rows.withColumn("_own", own).withColumns(
        {"_fact": F.coalesce("_own", F.first("_own", ignorenulls=True).over(whole)), "_stored": F.max("_stored").over(whole)}
    )
    bare = F.col("_column").isNotNull()
    drawn = F.when(bare, ~F.coalesce("_stored", F.lit(False))).otherwise(F.col("_fact").isNotNull() & (F.size("_voxels") > 0))
    rows = rows.filter(drawn).withColumns(_hidden())
    crown = F.coalesce("_crown", "_next").alias("_crown")
    return rows.select(*on, bare.alias("_bare"), "top_y", "depth", "_up", "_left", "_right", crown, "_voxels", "_fact")


def _seen(word: str, y: str = "y") -> Column:
    return F.expr(f"(shiftrightunsigned({word}, {y} & 63) & 1L) = 0")


def face_exposure(slabs: DataFrame, palette: DataFrame, camera: str = iso.DEFAULT_CAMERA) -> DataFrame:
    """Visible faces of each slab voxel: hidden only by a known full-height occluder.

    Voxels outside a slab are unknown and hide nothing, as do partial blocks.
    """
    rows = _column_words(slabs, palette, camera)
    v = rows.select("dimension", "x", "z", "_up", "_left", "_right", F.explode("_voxels").alias("_v")).select("*", "_v.*").drop("_v")
    v = v.withColumns({"top_face": _seen("_up"), "left_face": _seen("_left"), "right_face": _seen("_right")})
    return v.drop("_up", "_left", "_right")


def voxel_view(
    slabs: DataFrame,
    columns: DataFrame,
    palette: DataFrame,
    biomes: DataFrame,
    dimensions: DataFrame,
    zoom: int = MIN_DIRECT_ZOOM,
    camera: str = iso.DEFAULT_CAMERA,
    style: str = "terrain",
    options: StyleOptions = StyleOptions(),
    slice_y: int | None = None,
    skirt: int = EDGE_SKIRT,
    partitions: int | None = None,
) -> DataFrame:
    """Isometric pixels of real voxels: visible faces, partial heights, plants on top.

    ``slabs`` carries ``top_y`` and ``depth`` of its column. Columns whose whole slab
    lies above the slice draw nothing; columns without a slab are drawn as height field.
    Both are written once with what they know of their neighbours, the session's number of
    partitions (or ``partitions``) deals them out.
    """
    partitions = partitions or int(slabs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ppu = 1 << (zoom - BASE_ZOOM)
    cut = F.col("top_y") if slice_y is None else F.least(F.col("top_y"), F.lit(slice_y))
    stored = written(_drawn_columns(slabs, columns, palette, camera, slice_y, partitions), "columns")
    v = stored.filter("not _bare").select("dimension", "x", "z", "top_y", "depth", "_up", "_left", "_right", "_crown", "_fact", F.explode("_voxels").alias("_v"))
    v = with_block_shape(v.select("*", "_v.*").drop("_v"), palette)
    planted = F.col("_crown").isNotNull() & (F.col("y") + 1 == cut)
    v = v.withColumns(
        {"top_face": _seen("_up"), "left_face": _seen("_left"), "right_face": _seen("_right"), "_floor": F.col("top_y") - F.col("depth") + 1}
    )
    shown = ~F.col("decoration") & (F.col("top_face") | F.col("left_face") | F.col("right_face"))
    v = v.withColumns({"_shown": shown, "_lowest": F.col("y") == F.col("_floor")}).filter(F.col("_shown") | F.col("_lowest"))
    v = v.withColumns(
        {
            "is_top": planted | (~F.col("decoration") & (F.col("y") == cut)),
            "decoration_id": F.when(planted & F.col("top_face"), F.col("_crown.id")),
            "plant_light": F.when(planted, F.col("_crown.light")),
        }
    ).drop("_crown", "_up", "_left", "_right").withColumnRenamed("light", "voxel_light")

    # Column facts: biome and water for colour, north and west for relief, walls for the skirt.
    facts = ("biome_id", "ry", "north", "west", "left_y", "right_y", "height", "water", "water_y", "block_light", "ore_best", "ore_score")
    v = v.select("*", *[F.col(f"_fact.{c}") for c in facts], F.col("_fact.block_id").alias("ground_id"), F.lit(True).alias("present")).drop("_fact")
    rows = _face_colors(_voxel_colors(v, palette, biomes, dimensions, style, options))

    a, b = iso.rotate("x", "z", camera)
    plane = (a + b).cast("long") * RANK_Y + F.col("y") + 2048
    side_px = F.greatest(F.lit(1), F.floor(F.col("block_height") * ppu + 0.5).cast("int"))
    y0 = F.floor(((a + b) * 0.5 - (F.col("y") + F.col("block_height"))) * ppu + 0.5).cast("int")
    part = lambda top, y, left, right, rank: F.struct(
        top.alias("_on"), y.alias("_y0"), left.cast("int").alias("_l"), right.cast("int").alias("_r"), rank.alias("_rank")
    )
    wall = lambda name: F.when(F.col(name), side_px).otherwise(0)
    depth = lambda name: exposed_depth("_floor", name, skirt) * ppu
    body = part(F.col("top_face"), y0, wall("left_face"), wall("right_face"), plane)
    basement = part(
        F.lit(False), ((a + b) * (ppu // 2) - (F.col("_floor") + 1) * ppu).cast("int"), depth("left_y"), depth("right_y"), plane + 4096
    )
    both = F.filter(F.array(F.when(F.col("_shown"), body), F.when(F.col("_lowest"), basement)), lambda p: p.isNotNull())
    drawn = rows.select(
        "dimension", "_c0", "_c1", "_c2", ((a - b - 1) * ppu).alias("_x0"), F.explode(both).alias("_p")
    ).select("dimension", "_c0", "_c1", "_c2", "_x0", "_p.*")
    bare = stored.filter("_bare").select("dimension", "x", "z", "_fact.*")
    if not bare.isEmpty():  # the usual case needs no second branch
        bare = bare.withColumns({"left_depth": exposed_depth("ry", "left_y", skirt), "right_depth": exposed_depth("ry", "right_y", skirt)})
        flat = height_field_faces(face_colors(bare, palette, biomes, dimensions, style, options), zoom, camera)
        drawn = drawn.unionByName(flat.withColumn("_rank", F.col("_rank") * RANK_Y + 2048))
    return nearest_faces(drawn, zoom, partitions)


def _voxel_colors(
    rows: DataFrame, palette: DataFrame, biomes: DataFrame, dimensions: DataFrame, style: str, o: StyleOptions
) -> DataFrame:
    """``top`` and ``base`` of one voxel: its own block in terrain, its column otherwise."""
    if style == "contour":
        line = F.when(F.col("is_top"), contour_class(o) if o.contour else F.lit(0)).otherwise(0)
        none = color.rgba((0, 0, 0, 0))
        major, minor = color.rgba(o.contour_major_color), color.rgba(o.contour_minor_color)
        top = color.pick(line == 2, major, color.pick(line == 1, minor, none))
        return rows.withColumns({"top": top.struct(), "base": none.struct()})
    own = rows.withColumn("_own", F.col("block_id"))
    if style != "terrain":
        own = own.withColumn("block_id", F.col("ground_id"))
    own = attach_palettes(own, palette, biomes, dimensions)
    if style == "terrain":
        block = block_color(o, "block")
        wet = water_color(o, block, water_depth())
        own = own.withColumn("base", color.pick(F.col("block_water"), wet, block).struct())
        plant = block_color(o, "plant")
    else:
        own = paint(own.drop("top"), style, o).drop("top")
        plant = color.load("base")
    factor = [F.when(F.col("is_top"), relief_factor(o)).otherwise(F.lit(1.0))] if o.height_shading else []
    glow = lambda light: [color.light_factor(light)] if o.light_shading else []

    def lit(c: Rgba, factors: list[Column]) -> Rgba:
        for f in factors:
            c = color.scale(c, f)
        return c

    base = color.load("base")
    top = lit(base, factor + glow("voxel_light"))
    topped = color.alpha_over(lit(plant, glow("plant_light")), top)
    own = own.withColumn("top", color.pick(F.col("decoration_id").isNotNull(), topped, top).struct())
    return own.withColumn("base", lit(base, glow("voxel_light")).struct()).withColumn("block_id", F.col("_own"))


def contributing_windows(
    tiles: DataFrame,
    band: DataFrame,
    camera: str = iso.DEFAULT_CAMERA,
    slice_y: int | None = None,
    slab_ceiling: int | None = None,
) -> DataFrame:
    """Block windows whose columns could paint into each isometric tile, tightened by the height band.

    ``tiles`` has ``tile_id, dimension, zoom, tile_x, tile_y``; ``band`` comes from
    :func:`~voxelspark.operators.surface.height_band`. For voxel tiles give the largest
    slab depth as ``slab_ceiling``: the band then reaches down to the slabs' floor.
    """
    high = F.col("band_high") if slice_y is None else F.least(F.col("band_high"), F.lit(slice_y))
    low = F.col("band_low") if slab_ceiling is None else F.col("band_low") - slab_depth_limit("depth", slab_ceiling)
    t = tiles.join(band.select("dimension", low.alias("band_low"), high.alias("_high")), "dimension")
    t = t.withColumn("_high", F.greatest("_high", "band_low"))
    box = iso.world_footprint(iso.tile_bounds("tile_x", "tile_y", "zoom"), F.col("band_low"), F.col("_high"), camera)
    grow = (-1, -1, 1, 1)
    return t.select(
        F.col("tile_id").alias("window_id"),
        "dimension",
        *[(c + d).alias(n) for c, d, n in zip(box, grow, ("min_x", "min_z", "max_x", "max_z"))],
    )


def contributing_columns(tiles: DataFrame, columns: DataFrame, band: DataFrame, *how, **named) -> DataFrame:
    """Columns that could paint into each isometric tile; see :func:`contributing_windows`."""
    return window_columns(columns, contributing_windows(tiles, band, *how, **named))


def draw_list(columns: DataFrame, zoom: int, camera: str = iso.DEFAULT_CAMERA) -> DataFrame:
    """Tile and pixel of every column's top vertex, straight from its position."""
    ppu = 1 << (zoom - BASE_ZOOM)
    a, b = iso.rotate("x", "z", camera)
    x0, y0 = (a - b) * ppu, (a + b) * (ppu // 2) - (render_y() + 1) * ppu
    return columns.filter("present").select(
        "dimension", "x", "z", F.shiftright(x0, 9).alias("tile_x"), F.shiftright(y0, 9).alias("tile_y"),
        F.pmod(x0, F.lit(512)).alias("px"), F.pmod(y0, F.lit(512)).alias("py"), iso.depth_key("x", "z", camera).alias("depth"),
    )
