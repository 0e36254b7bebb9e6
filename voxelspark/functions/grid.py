"""Block, chunk, region and tile arithmetic on integer columns.

Everything rounds toward negative infinity, so the grids are continuous across
the origin. Integer columns stay integers: power-of-two divisions are shifts.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the coordinate system.
CHUNK_BLOCKS = 16
REGION_CHUNKS = 32
REGION_BLOCKS = 512
TILE_PIXELS = 512
BASE_ZOOM = 6
LAST_INTEGER_ZOOM = 15


def col(value) -> Column:
    """A column name, Column or Python literal as a Column."""
    if isinstance(value, Column):
        return value
    return F.col(value) if isinstance(value, str) else F.lit(value)


def floor_div(value, divisor: int) -> Column:
    if divisor > 0 and divisor & (divisor - 1) == 0:
        return F.shiftright(col(value), divisor.bit_length() - 1)
    return F.floor(col(value) / F.lit(divisor)).cast("int")


def floor_mod(value, divisor: int) -> Column:
    return F.pmod(col(value), F.lit(divisor))


def block_to_chunk(block) -> Column:
    return floor_div(block, CHUNK_BLOCKS)


def block_in_chunk(block) -> Column:
    return floor_mod(block, CHUNK_BLOCKS)


def chunk_to_block(chunk) -> Column:
    return col(chunk) * CHUNK_BLOCKS


def chunk_to_region(chunk) -> Column:
    return floor_div(chunk, REGION_CHUNKS)


def chunk_in_region(chunk) -> Column:
    return floor_mod(chunk, REGION_CHUNKS)


def block_to_region(block) -> Column:
    return floor_div(block, REGION_BLOCKS)


def map_xy(x, z) -> tuple[Column, Column]:
    """Screen axes of the plan view: y grows upward, so z is negated."""
    return col(x), -col(z)


def blocks_per_pixel(zoom) -> Column:
    return F.pow(F.lit(2.0), F.lit(BASE_ZOOM) - col(zoom))


def pixels_per_block(zoom) -> Column:
    return F.pow(F.lit(2.0), col(zoom) - F.lit(BASE_ZOOM))


def tile_span(zoom) -> Column:
    """Edge of one tile in whole blocks, never below one."""
    return F.pow(F.lit(2.0), F.greatest(F.lit(LAST_INTEGER_ZOOM) - col(zoom), F.lit(0))).cast("int")


def span_at(zoom: int) -> int:
    return 1 << max(LAST_INTEGER_ZOOM - zoom, 0)


def tile_span_exact(zoom) -> Column:
    return F.lit(float(TILE_PIXELS)) * blocks_per_pixel(zoom)


def tile_span_chunks(zoom) -> Column:
    return floor_div(tile_span(zoom), CHUNK_BLOCKS)


def block_to_tile(block, zoom) -> Column:
    """Tile index on one axis; ``zoom`` may be a literal or a column."""
    if isinstance(zoom, int):
        return floor_div(block, span_at(zoom))
    return F.floor(col(block) / tile_span(zoom)).cast("int")


def parent_tile(index) -> Column:
    return floor_div(index, 2)


def child_quadrant(index) -> Column:
    return floor_mod(index, 2)


def children_of(tile_x, tile_y, zoom) -> Column:
    """The four tiles one level deeper, north-west first."""
    return F.array(
        *[
            F.struct(
                (col(zoom) + 1).alias("zoom"),
                (col(tile_x) * 2 + dx).alias("tile_x"),
                (col(tile_y) * 2 + dy).alias("tile_y"),
            )
            for dy in (0, 1)
            for dx in (0, 1)
        ]
    )


def ancestors_of(tile_x, tile_y, zoom, min_zoom: int) -> Column:
    """Every containing tile from the nearest parent down to ``min_zoom``."""
    steps = col(zoom) - min_zoom
    up = F.when(steps > 0, F.sequence(F.lit(1), steps)).otherwise(F.array().cast("array<int>"))
    scale = lambda n: F.pow(F.lit(2.0), n)
    return F.transform(
        up,
        lambda n: F.struct(
            (col(zoom) - n).alias("zoom"),
            F.floor(col(tile_x) / scale(n)).cast("int").alias("tile_x"),
            F.floor(col(tile_y) / scale(n)).cast("int").alias("tile_y"),
        ),
    )


def is_empty(min_x, min_z, max_x, max_z) -> Column:
    return (col(max_x) <= col(min_x)) | (col(max_z) <= col(min_z))


def in_bounds(x, z, min_x, min_z, max_x, max_z) -> Column:
    """Half-open containment; empty bounds contain nothing."""
    return (
        (col(x) >= col(min_x)) & (col(x) < col(max_x)) & (col(z) >= col(min_z)) & (col(z) < col(max_z))
    )


def bounds_intersect(a: tuple, b: tuple) -> Column:
    """Overlap of two half-open rectangles given as (min_x, min_z, max_x, max_z)."""
    a, b = [col(c) for c in a], [col(c) for c in b]
    return (a[0] < b[2]) & (b[0] < a[2]) & (a[1] < b[3]) & (b[1] < a[3])


def intersection(a: tuple, b: tuple) -> tuple[Column, ...]:
    a, b = [col(c) for c in a], [col(c) for c in b]
    return (
        F.greatest(a[0], b[0]),
        F.greatest(a[1], b[1]),
        F.least(a[2], b[2]),
        F.least(a[3], b[3]),
    )


def expand(bounds: tuple, by) -> tuple[Column, ...]:
    b = [col(c) for c in bounds]
    return b[0] - by, b[1] - by, b[2] + by, b[3] + by


def chunk_range(bounds: tuple) -> tuple[Column, ...]:
    """Half-open chunk rectangle covering block bounds; zeros when empty."""
    b = [col(c) for c in bounds]
    empty = is_empty(*b)
    edges = (
        block_to_chunk(b[0]),
        block_to_chunk(b[1]),
        block_to_chunk(b[2] - 1) + 1,
        block_to_chunk(b[3] - 1) + 1,
    )
    return tuple(F.when(empty, F.lit(0)).otherwise(e) for e in edges)


def tiles_covering(bounds: tuple, zoom) -> Column:
    """Array of (tile_x, tile_y) covering block bounds at one zoom."""
    b = [col(c) for c in bounds]
    xs = F.sequence(block_to_tile(b[0], zoom), block_to_tile(b[2] - 1, zoom))
    ys = F.sequence(block_to_tile(b[1], zoom), block_to_tile(b[3] - 1, zoom))
    grid = F.flatten(
        F.transform(
            ys,
            lambda ty: F.transform(xs, lambda tx: F.struct(tx.alias("tile_x"), ty.alias("tile_y"))),
        )
    )
    none = F.array().cast("array<struct<tile_x:int,tile_y:int>>")
    return F.when(is_empty(*b), none).otherwise(grid)


def cover_count(bounds: tuple, zoom) -> Column:
    """How many tiles :func:`tiles_covering` would list, by arithmetic alone."""
    b = [col(c) for c in bounds]
    nx = block_to_tile(b[2] - 1, zoom) - block_to_tile(b[0], zoom) + 1
    nz = block_to_tile(b[3] - 1, zoom) - block_to_tile(b[1], zoom) + 1
    return F.when(is_empty(*b), F.lit(0).cast("long")).otherwise(nx.cast("long") * nz)


def clamp(value, low, high) -> Column:
    v = col(value)
    return F.when(v < col(low), col(low)).when(v > col(high), col(high)).otherwise(v)


def nice_scale(blocks) -> Column:
    """Scale-bar length: the nearest 1, 2 or 5 times a power of ten."""
    b = col(blocks).cast("double")
    base = F.pow(F.lit(10.0), F.floor(F.log10(b)))
    ratio = b / base
    step = (
        F.when(ratio < 1.5, F.lit(1.0)).when(ratio < 3.5, 2.0).when(ratio < 7.5, 5.0).otherwise(10.0)
    )
    return F.when(b <= 0, F.lit(1.0)).otherwise(step * base)


def shortest_turn(start, end) -> Column:
    """Signed rotation in degrees from ``start`` to ``end``, in (-180, 180]."""
    d = F.pmod(col(end) - col(start) + 180.0, F.lit(360.0)) - 180.0
    return F.when(d == -180.0, F.lit(180.0)).otherwise(d)


def position_label(x, z, y=None) -> Column:
    part = lambda axis, v: F.concat(F.lit(f"{axis}: "), F.floor(col(v)).cast("string"))
    mid = [] if y is None else [part("Y", y)]
    return F.concat_ws("   ", part("X", x), *mid, part("Z", z))


def x_shard(tile_x) -> Column:
    """Storage shard of a tile column: 64 tiles per shard, floored."""
    return F.shiftright(col(tile_x), 6)
