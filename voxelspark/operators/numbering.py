"""Consecutive numbers over a total order, without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voxelspark.shared import written


def numbered(rows: DataFrame, order: list[Column | str], name: str, start: int = 0) -> DataFrame:
    """``rows`` with a long ``name``: ``start``, ``start + 1``, ... by ``order``.

    The rows are split into ranges and sorted inside them, each range counts itself, and only
    the counts (one a range) are summed on the driver. The split rows are written once: ranges
    are drawn from a sample, so a second evaluation could cut them elsewhere. Rows equal in
    ``order`` lie in one range; pass an order without long runs of ties.
    """
    ranged = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper 31 bits of the id are the partition, the lower 33 count from 0 inside it.
    placed = written(ranged.withColumn("_place", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_place", 33)
    sizes = placed.groupBy(part.alias("part")).agg(F.max(F.col("_place").bitwiseAND((1 << 33) - 1)).alias("last")).orderBy("part").collect()
    offsets, total = [], start
    for r in sizes:
        offsets += [F.lit(r["part"]), F.lit(total)]
        total += r["last"] + 1
    if not offsets:
        return placed.withColumn(name, F.lit(start).cast("long")).drop("_place")
    base = F.element_at(F.create_map(*offsets), part)
    return placed.withColumn(name, (base + F.col("_place").bitwiseAND((1 << 33) - 1)).cast("long")).drop("_place")
