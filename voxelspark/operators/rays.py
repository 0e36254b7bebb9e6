"""Which block is under a screen point: the view-ray march as an equi-join.

Along a view ray ``a - b = u`` is fixed, and a ray point at elevation y has
``(a + b) / 2 = v + y``. The part of the ray inside column (a, b) is the interval
``(lo, hi)`` of ``s = v + y``; the ray is entered at the top, so the first hit is the
one with the largest ``lo``. Closed form, no marching:

* a column lies on the ray only if ``u - 1 < a - b < u + 1``, so ``a - b`` is one of
  at most two integers;
* a single voxel additionally shows at ``a + b - 2y`` in ``(2v - 3, 2v + 2)``, which
  makes the screen cell itself the join key, whatever the size of the world.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import iso
from .surface import render_y

BAND = 8  # heights are matched in bands of 256 along the ray


def _ray(q: DataFrame) -> DataFrame:
    du = F.col("u") / 2.0
    return q.withColumns(
        {
            "_du": du,
            "_hi": F.col("v") + F.col("max_y") + 1,
            "_lo": F.col("v") + F.col("min_y"),
            "_diag": F.explode(F.array_distinct(F.array(F.floor("u"), F.ceil("u")))),
        }
    )


def _inside() -> tuple[Column, Column, Column, Column]:
    """Interval of s inside column (a, b), whether it is the entry column, and reach."""
    a, b, du = F.col("_a"), F.col("_b"), F.col("_du")
    lo = F.greatest(a - du, b + du)
    hi = F.least(a + 1 - du, b + 1 + du)
    first = (a == F.floor(F.col("_hi") + du)) & (b == F.floor(F.col("_hi") - du))
    reached = first | ((hi > lo) & (lo < F.col("_hi")) & (hi > F.col("_lo")))
    return lo, hi, first, reached


def pick_columns(
    queries: DataFrame, columns: DataFrame, dimensions: DataFrame, camera: str = iso.DEFAULT_CAMERA
) -> DataFrame:
    """First column hit by each ray through a height field.

    ``queries`` has ``qid, dimension, u, v``; rays that hit nothing are left out.
    """
    q = _ray(queries.join(dimensions.select("dimension", "min_y", "max_y"), "dimension"))
    lowest = F.floor(F.col("_lo") * 2 - 2).cast("long")
    highest = F.ceil(F.col("_hi") * 2 + 2).cast("long")
    q = q.withColumn("_band", F.explode(F.sequence(F.shiftright(lowest, BAND), F.shiftright(highest, BAND))))
    a, b = iso.rotate("x", "z", camera)
    cells = columns.filter("present").select(
        "dimension", "x", "z", render_y().alias("_surf"), a.alias("_a"), b.alias("_b"),
        (a - b).cast("long").alias("_diag"), F.shiftright((a + b).cast("long"), BAND).alias("_band"),
    )
    lo, _, _, reached = _inside()
    bottom = F.greatest(lo - F.col("v"), F.col("min_y").cast("double"))
    hits = q.join(cells, ["dimension", "_diag", "_band"]).filter(reached & (F.col("_surf") + 1 >= bottom))
    best = hits.groupBy("qid").agg(F.max_by(F.struct("dimension", "x", F.col("_surf").alias("y"), "z"), lo).alias("_h"))
    return best.select("qid", "_h.*")


def pick_voxels(
    queries: DataFrame,
    slabs: DataFrame,
    palette: DataFrame,
    dimensions: DataFrame,
    camera: str = iso.DEFAULT_CAMERA,
) -> DataFrame:
    """First occluding voxel hit by each ray, gaps honoured.

    ``queries`` may carry ``slice_y``, the level the view is cut at.
    """
    q = queries.join(dimensions.select("dimension", "min_y", "max_y"), "dimension")
    if "slice_y" in queries.columns:
        q = q.withColumn("max_y", F.coalesce("slice_y", "max_y")).drop("slice_y")
    q = _ray(q)
    twice = F.col("v") * 2
    offsets = F.sequence((F.floor(twice - 3) + 1).cast("long"), (F.ceil(twice + 2) - 1).cast("long"))
    even = F.filter(offsets, lambda m: F.pmod(m + F.col("_diag"), F.lit(2)) == 0)
    q = q.withColumn("_row", F.explode(even))
    a, b = iso.rotate("x", "z", camera)
    solid = palette.filter("occludes").select(F.col("id").alias("block_id"))
    cells = slabs.join(solid, "block_id", "left_semi").select(
        "dimension", "x", "y", "z", "block_id", "light", a.alias("_a"), b.alias("_b"),
        (a - b).cast("long").alias("_diag"), (a + b - F.col("y") * 2).cast("long").alias("_row"),
    )
    lo, hi, first, reached = _inside()
    bottom = F.floor(F.greatest(lo - F.col("v"), F.col("min_y").cast("double")))
    top = F.ceil(F.when(first, F.col("max_y") + 1.0).otherwise(hi - F.col("v"))) - 1
    hits = q.join(cells, ["dimension", "_diag", "_row"]).filter(reached & F.col("y").between(bottom, top))
    best = hits.groupBy("qid").agg(
        F.max_by(F.struct("dimension", "x", "y", "z", "block_id", "light"), F.struct(lo, "y")).alias("_h")
    )
    return best.select("qid", "_h.*")


def pick(
    queries: DataFrame,
    slabs: DataFrame,
    columns: DataFrame,
    palette: DataFrame,
    biomes: DataFrame,
    dimensions: DataFrame,
    camera: str = iso.DEFAULT_CAMERA,
) -> DataFrame:
    """Full answer to a click: the voxel hit, else the column hit, with names."""
    voxel = pick_voxels(queries, slabs, palette, dimensions, camera).select(
        "qid", F.struct("x", "y", "z", "block_id", "light").alias("_v")
    )
    flat = queries.drop("slice_y") if "slice_y" in queries.columns else queries
    ground = pick_columns(flat, columns, dimensions, camera).select("qid", F.struct("x", "z").alias("_g"))
    j = queries.select("qid", "dimension").join(voxel, "qid", "left").join(ground, "qid", "left")
    j = j.select(
        "qid", "dimension", "_v", F.coalesce("_v.x", "_g.x").alias("x"), F.coalesce("_v.z", "_g.z").alias("z")
    )
    hit = j.join(columns.drop("ry"), ["dimension", "x", "z"], "left")
    block = F.coalesce("_v.block_id", "block_id")
    named = hit.withColumns(
        {
            "y": F.coalesce("_v.y", "height"),
            "_block": block,
            "light": F.coalesce("_v.light", "light"),
            "found": F.col("_v").isNotNull() | F.coalesce("present", F.lit(False)),
        }
    )
    b = palette.select(F.col("id").alias("_block"), F.col("name").alias("block"))
    o = biomes.select(F.col("id").alias("biome_id"), F.col("name").alias("biome"))
    named = named.join(b, "_block", "left").join(o, "biome_id", "left")
    return named.select(
        "qid", "dimension", "x", "y", "z", "block", "biome", "light",
        F.coalesce("water", F.lit(False)).alias("water"), "water_y", "found",
    )
