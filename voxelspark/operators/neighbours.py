"""Values of adjacent cells without a self-join.

Cells are sent to square blocks of the grid, once, together with a thin halo of
edge copies for the blocks next door. Every neighbour lookup is then a window
inside one block, so any number of them costs a single shuffle, and no group can
outgrow a block however large the map is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import floor_div


def with_neighbours(
    cells: DataFrame,
    wanted: dict[str, tuple[str, int, Column | str]],
    keys: tuple[str, ...] = ("dimension",),
    axes: tuple[str, ...] = ("x", "z"),
    blocked: tuple[str, ...] | None = None,
    block: int = 256,
    partitions: int | None = None,
    keep_homes: bool = False,
) -> DataFrame:
    """Add ``name -> value`` columns read from the cell one step along an axis.

    ``wanted`` maps an output name to ``(axis, step, value)``. A missing
    neighbour gives NULL. ``axes`` identify a cell within ``keys``; ``blocked``
    are the axes cut into blocks (all by default). ``keep_homes`` leaves the block's columns,
    ``_home_`` and the axis, by which the result is partitioned with ``keys``.
    """
    blocked = blocked or axes
    home = [floor_div(a, block) for a in blocked]
    names = [f"_home_{a}" for a in blocked]
    spot = lambda values, halo: F.struct(
        *[v.alias(n) for v, n in zip(values, names)], F.lit(halo).alias("_halo")
    )
    # A cell at p is needed by the block that holds p - step.
    copies = [F.array(spot(home, False))]
    for axis, step in sorted({(a, s) for a, s, _ in wanted.values() if a in blocked}):
        i = blocked.index(axis)
        there = floor_div(F.col(axis) - step, block)
        moved = [there if n == i else h for n, h in enumerate(home)]
        copies.append(F.when(there != home[i], F.array(spot(moved, True))))
    every = F.filter(
        F.concat(*[F.coalesce(c, F.array_remove(copies[0], copies[0][0])) for c in copies]), lambda s: s.isNotNull()
    )
    values = {f"_v_{n}": v for n, (_, _, v) in wanted.items() if not isinstance(v, str)}  # columns travel anyway
    placed = (
        cells.withColumns(values)
        .withColumn("_spot", F.explode(every))
        .select(*cells.columns, *values, "_spot.*")
        .repartition(*([] if partitions is None else [partitions]), *keys, *names)
    )
    group = [*keys, *names]
    out: dict[str, Column] = {}
    for name, (axis, step, value) in wanted.items():
        w = Window.partitionBy(*group, *[a for a in axes if a != axis]).orderBy(axis)
        near = F.lag if step < 0 else F.lead
        adjacent = near(axis, 1).over(w) == F.col(axis) + step
        out[name] = F.when(adjacent, near(value if isinstance(value, str) else f"_v_{name}", 1).over(w))
    return placed.withColumns(out).filter(~F.col("_halo")).drop("_halo", *([] if keep_homes else names), *values)
