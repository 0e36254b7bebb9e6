"""The 2:1 dimetric view: camera rotation, projection and footprints.

In camera axes (a, b) a point lands on screen at ``u = a - b`` and
``v = (a + b) / 2 - y``. One level of height is one unit of v.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .grid import LAST_INTEGER_ZOOM, col, tile_span, tile_span_exact

# Camera names and, for each, how (x, z) maps to (a, b).
CAMERAS = {"se": ("x", "z"), "sw": ("z", "-x"), "nw": ("-x", "-z"), "ne": ("-z", "x")}
UNROTATED = {"se": ("a", "b"), "sw": ("-b", "a"), "nw": ("-a", "-b"), "ne": ("b", "-a")}
DEFAULT_CAMERA = "se"


def _swap(rule: tuple[str, str], first, second, names: str) -> tuple[Column, Column]:
    axes = {names[0]: col(first), names[1]: col(second)}
    pick = lambda t: -axes[t[1]] if t[0] == "-" else axes[t]
    return pick(rule[0]), pick(rule[1])


def rotate(x, z, camera: str = DEFAULT_CAMERA) -> tuple[Column, Column]:
    return _swap(CAMERAS[camera], x, z, "xz")


def unrotate(a, b, camera: str = DEFAULT_CAMERA) -> tuple[Column, Column]:
    return _swap(UNROTATED[camera], a, b, "ab")


def neighbour_step(axis: str, camera: str = DEFAULT_CAMERA) -> tuple[str, int]:
    """World axis and step of one move toward the viewer along ``a`` or ``b``."""
    rule = CAMERAS[camera][0 if axis == "a" else 1]
    return (rule[-1], -1 if rule[0] == "-" else 1)


def depth_key(x, z, camera: str = DEFAULT_CAMERA) -> Column:
    a, b = rotate(x, z, camera)
    return a + b


def project(x, y, z, camera: str = DEFAULT_CAMERA) -> tuple[Column, Column]:
    a, b = rotate(x, z, camera)
    return (a - b) * F.lit(1.0), (a + b) * F.lit(0.5) - col(y) * F.lit(1.0)


def project_block_top(x, y, z, camera: str = DEFAULT_CAMERA) -> tuple[Column, Column]:
    return project(x, col(y) + 1, z, camera)


def unproject(u, v, y, camera: str = DEFAULT_CAMERA) -> tuple[Column, Column]:
    """World (x, z) of a screen point on the plane at elevation ``y``."""
    half, du = col(v) + col(y), col(u) / 2.0
    return unrotate(half + du, half - du, camera)


def unproject_flat(u, v, block_y, camera: str = DEFAULT_CAMERA) -> tuple[Column, Column]:
    x, z = unproject(u, v, col(block_y) + 1, camera)
    return F.floor(x).cast("int"), F.floor(z).cast("int")


def sprite_height(top_y, floor_y) -> Column:
    return F.lit(1.0) + F.greatest(col(top_y) - col(floor_y), F.lit(0)).cast("double")


def tile_bounds(tile_x, tile_y, zoom) -> tuple[Column, ...]:
    """Screen rectangle (min_u, min_v, max_u, max_v) of one tile."""
    span = F.when(col(zoom) > LAST_INTEGER_ZOOM, tile_span_exact(zoom)).otherwise(
        tile_span(zoom).cast("double")
    )
    u, v = col(tile_x) * span, col(tile_y) * span
    return u, v, u + span, v + span


def tile_at(u, v, zoom) -> tuple[Column, Column]:
    span = tile_span_exact(zoom)
    return F.floor(col(u) / span).cast("int"), F.floor(col(v) / span).cast("int")


def world_footprint(iso_bounds: tuple, min_y, max_y, camera: str = DEFAULT_CAMERA) -> tuple[Column, ...]:
    """Block rectangle of every column that could paint into a screen rectangle."""
    u0, v0, u1, v1 = [col(c) for c in iso_bounds]
    lo, hi = col(min_y), col(max_y) + 1
    a0, a1 = u0 * 0.5 + v0 + lo - 1, u1 * 0.5 + v1 + hi + 1
    b0, b1 = -u1 * 0.5 + v0 + lo - 1, -u0 * 0.5 + v1 + hi + 1
    corners = [unrotate(a, b, camera) for a in (a0, a1) for b in (b0, b1)]
    xs, zs = [c[0] for c in corners], [c[1] for c in corners]
    return (
        F.floor(F.least(*xs)).cast("int"),
        F.floor(F.least(*zs)).cast("int"),
        F.ceil(F.greatest(*xs)).cast("int") + 1,
        F.ceil(F.greatest(*zs)).cast("int") + 1,
    )


def footprint_of_blocks(bounds: tuple, min_y, max_y, camera: str = DEFAULT_CAMERA) -> tuple[Column, ...]:
    """Screen rectangle that a block rectangle projects into over a height range."""
    x0, z0, x1, z1 = [col(c) for c in bounds]
    points = [
        project(x, y, z, camera) for x in (x0, x1) for z in (z0, z1) for y in (col(min_y), col(max_y) + 1)
    ]
    us, vs = [p[0] for p in points], [p[1] for p in points]
    return F.least(*us) - 1, F.least(*vs) - 1, F.greatest(*us) + 1, F.greatest(*vs) + 1


def tiles_of_screen_rect(rect: tuple, zoom) -> Column:
    """Array of (tile_x, tile_y) touched by a closed screen rectangle."""
    u0, v0, u1, v1 = [col(c) for c in rect]
    (x0, y0), (x1, y1) = tile_at(u0, v0, zoom), tile_at(u1, v1, zoom)
    return F.flatten(
        F.transform(
            F.sequence(y0, y1),
            lambda ty: F.transform(
                F.sequence(x0, x1), lambda tx: F.struct(tx.alias("tile_x"), ty.alias("tile_y"))
            ),
        )
    )
