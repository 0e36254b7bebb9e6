"""Overlay geometry in screen space: rings, points, box walls, selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iso
from ..functions.grid import CHUNK_BLOCKS, block_to_chunk, col
from ..operators.neighbours import with_neighbours
from ..operators.overlay import visible_at


def _screen(x, z, y, camera: str) -> Column:
    u, v = iso.project_block_top(x, y, z, camera)
    return F.struct(u.cast("double").alias("u"), v.cast("double").alias("v"))


def _rectangle(x0, z0, x1, z1) -> Column:
    corner = lambda x, z: F.struct(x.cast("double").alias("x"), z.cast("double").alias("z"))
    return F.array(corner(x0, z0), corner(x1, z0), corner(x1, z1), corner(x0, z1))


def area_rings(
    areas: DataFrame,
    zoom: int = -1,
    camera: str = iso.DEFAULT_CAMERA,
    reference_y: int = 63,
    min_zooms: dict[str, int] = {},
) -> DataFrame:
    """Closed outline rings of each visible area, one per chunk for chunk sets.

    ``min_zooms`` holds the layer thresholds by kind. Polygons with fewer than
    three points and empty chunk sets draw nothing.
    """
    shown = areas.filter(visible_at(F.lit(zoom), "min_zoom", "max_zoom"))
    for kind, least in min_zooms.items():
        shown = shown.filter((F.col("kind") != kind) | F.lit(zoom >= least))
    size = CHUNK_BLOCKS
    cells = F.transform(
        F.array_sort("chunks"),
        lambda c: _rectangle(c["x"] * size, c["z"] * size, c["x"] * size + size, c["z"] * size + size),
    )
    box = F.array(_rectangle(F.col("min_x"), F.col("min_z"), F.col("max_x"), F.col("max_z")))
    rings = (
        F.when((F.col("shape") == "polygon") & (F.size("polygon") >= 3), F.array("polygon"))
        .when((F.col("shape") == "chunks") & (F.size("chunks") > 0), cells)
        .when(~F.col("shape").isin("polygon", "chunks"), box)
    )
    each = shown.select("id", "kind", F.posexplode(rings).alias("part", "_ring"))
    path = F.transform("_ring", lambda p: _screen(p["x"], p["z"], F.lit(reference_y), camera))
    return each.select("id", "kind", "part", F.concat(path, F.slice(path, 1, 1)).alias("ring"))


def marker_points(
    markers: DataFrame, zoom: int = -1, camera: str = iso.DEFAULT_CAMERA, reference_y: int = 63
) -> DataFrame:
    """Screen position of each visible marker, at its own height where it has one."""
    shown = markers.filter(visible_at(F.lit(zoom), "min_zoom"))
    return shown.select("*", _screen("x", "z", F.coalesce("y", F.lit(reference_y)), camera).alias("_at")).select(
        *markers.columns, "_at.u", "_at.v"
    )


def extent_to_chunks(extents: DataFrame, camera: str = iso.DEFAULT_CAMERA, block_y: int = 63) -> DataFrame:
    """Inclusive chunk range under a screen box given in map axes (y upward).

    All four corners are unprojected: the box is a parallelogram in the world.
    """
    corners = [
        iso.unproject_flat(F.col(u), -F.col(y), F.lit(block_y), camera)
        for u in ("min_x", "max_x")
        for y in ("min_z", "max_z")
    ]
    xs, zs = [c[0] for c in corners], [c[1] for c in corners]
    return extents.withColumns(
        {
            "min_cx": block_to_chunk(F.least(*xs)),
            "min_cz": block_to_chunk(F.least(*zs)),
            "max_cx": block_to_chunk(F.greatest(*xs)),
            "max_cz": block_to_chunk(F.greatest(*zs)),
        }
    )


# How far selection walls sink below the lowest ground, and their least height.
WALL_UNDERCUT = 3
WALL_LEAST = 6


def selection_walls(selected: DataFrame, levels: DataFrame, fallback_y: int = 63) -> DataFrame:
    """One box per selection: a shared top, walls only where the selection ends.

    ``selected`` has ``selection_id, dimension, chunk_x, chunk_z``; ``levels`` gives
    ``ground_y`` per chunk. The top is the highest member's ground, the bottom lies
    below the lowest member's.
    """
    on = ["dimension", "chunk_x", "chunk_z"]
    rows = selected.join(levels, on, "left").withColumn("_y", F.coalesce("ground_y", F.lit(fallback_y)) + 1)
    band = rows.groupBy("selection_id").agg(F.max("_y").alias("top_y"), F.min("_y").alias("_low"))
    band = band.withColumn("bottom_y", F.least(F.col("_low") - WALL_UNDERCUT, F.col("top_y") - WALL_LEAST)).drop("_low")
    near = with_neighbours(
        selected,
        {"_front": ("chunk_z", 1, F.lit(True)), "_side": ("chunk_x", 1, F.lit(True))},
        keys=("selection_id", "dimension"),
        axes=("chunk_x", "chunk_z"),
    )
    walls = near.withColumns({"front_wall": F.col("_front").isNull(), "side_wall": F.col("_side").isNull()})
    return walls.drop("_front", "_side").join(band, "selection_id")


def wall_faces(walls: DataFrame, camera: str = iso.DEFAULT_CAMERA) -> DataFrame:
    """Top and exposed side faces of each box as rings in map axes."""
    s = CHUNK_BLOCKS
    x0, z0 = F.col("chunk_x") * s, F.col("chunk_z") * s
    x1, z1 = x0 + s, z0 + s

    def at(x, y, z) -> Column:
        u, v = iso.project(x, col(y), z, camera)
        return F.struct(u.alias("x"), (-v).alias("y"))

    t, d = "top_y", "bottom_y"
    return walls.select(
        "*",
        F.array(at(x0, t, z0), at(x1, t, z0), at(x1, t, z1), at(x0, t, z1)).alias("top"),
        F.when(F.col("front_wall"), F.array(at(x0, t, z1), at(x1, t, z1), at(x1, d, z1), at(x0, d, z1))).alias("front"),
        F.when(F.col("side_wall"), F.array(at(x1, t, z0), at(x1, t, z1), at(x1, d, z1), at(x1, d, z0))).alias("side"),
    )
