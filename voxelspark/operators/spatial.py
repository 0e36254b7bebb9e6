"""Rectangle joins on integer coordinates, without theta joins or hot overflow cells.

Every rectangle has a level: the smallest power-of-two cell size, from 512 blocks
up, that is at least as large as the rectangle, so it touches at most four cells of
its own level. A pair of rectangles meets at the larger of their two levels, in the
cell that holds the low corner of their intersection: each match is found once, and
no result needs deduplicating. A huge area costs four rows like any other.

A cell of a high level can hold a large part of all small rectangles. From ``SALTED_LEVEL`` on,
the smaller rectangles are therefore spread over ``SALTS`` parts of their cell, and the few
large ones are copied to each part. The large ones travel in arrays of at most ``HELD``, so a pair
costs a step along an array, and all tables keep the session's number of partitions: their few
bytes tell nothing of the pairs they make.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.grid import bounds_intersect

BOUNDS = ("min_x", "min_z", "max_x", "max_z")
FIRST_LEVEL = 9  # 512 blocks
LAST_LEVEL = 27  # beyond any world
SALTED_LEVEL = 10  # 1024 blocks
SALTS = 32
HELD = 1024


def _level(b: list[Column]) -> Column:
    extent = F.greatest(b[2] - b[0], b[3] - b[1], F.lit(1)).cast("double")
    return F.greatest(F.lit(FIRST_LEVEL), F.least(F.lit(LAST_LEVEL), F.ceil(F.log2(extent)).cast("int")))


def _cell(value: Column, level: Column) -> Column:
    return F.call_function("shiftright", value, level)


def _cells(rows: DataFrame, bounds: list[Column], level: Column) -> DataFrame:
    """One row per cell of ``level`` that the rectangle touches."""
    span = lambda lo, hi: F.sequence(_cell(lo, level), _cell(F.greatest(lo, hi - 1), level))
    return (
        rows.withColumn("_level", level)
        .withColumn("_cx", F.explode(span(bounds[0], bounds[2])))
        .withColumn("_cz", F.explode(span(bounds[1], bounds[3])))
    )


def rectangle_join(
    left: DataFrame,
    right: DataFrame,
    keys: tuple[str, ...] = ("dimension",),
    left_bounds: tuple[str, ...] = BOUNDS,
    right_bounds: tuple[str, ...] = BOUNDS,
    prefix: str = "r_",
) -> DataFrame:
    """Pairs of rows whose half-open rectangles overlap.

    Right columns other than ``keys`` come out prefixed. Rows are only lifted to the
    levels that occur on the other side, of which there are at most nineteen.
    """
    names = {c: prefix + c for c in right.columns if c not in keys}
    right = right.select(*keys, *[F.col(c).alias(n) for c, n in names.items()])
    lb = [F.col(c) for c in left_bounds]
    rb = [F.col(names[c]) for c in right_bounds]
    full = lambda b: (b[2] > b[0]) & (b[3] > b[1])
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    left = left.filter(known & full(lb)).withColumn("_own", _level(lb))
    right = right.filter(known & full(rb)).withColumn("_other", _level(rb))
    first = (F.greatest(lb[0], rb[0]), F.greatest(lb[1], rb[1]))
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))

    def meet(low: DataFrame, low_bounds, own: str, high: DataFrame, high_bounds, top: str, strict: bool) -> DataFrame:
        """Pairs at the level of ``high``; ``low`` is lifted to every such level."""
        levels = high.select(F.col(top).alias("_to")).distinct()
        fits = F.col("_to") > F.col(own) if strict else F.col("_to") >= F.col(own)
        # At most nineteen distinct levels exist, whatever the tables hold.
        lifted = low.join(F.broadcast(levels), fits)
        hot = F.col("_level") >= SALTED_LEVEL
        spread, all_parts = F.pmod(F.xxhash64(*low_bounds), F.lit(SALTS)).cast("int"), F.sequence(F.lit(0), F.lit(SALTS - 1))
        a = _cells(lifted, low_bounds, F.col("_to")).drop("_to").withColumn("_part", F.when(hot, spread).otherwise(0))
        b = _cells(high, high_bounds, F.col(top)).withColumn("_part", F.explode(F.when(hot, all_parts).otherwise(F.array(F.lit(0)))))
        # One column for all of a cell's key: Spark keeps both tables where it puts them.
        a, b = (side.withColumn("_spot", F.struct(*keys, "_level", "_cx", "_cz", "_part")).repartition(n, "_spot") for side in (a, b))
        place = F.row_number().over(Window.partitionBy("_spot").orderBy(*high_bounds)) - 1
        held = b.withColumn("_slice", F.floor(place / HELD)).groupBy("_spot", "_slice").agg(
            F.collect_list(F.struct(*[c for c in high.columns if c not in keys])).alias("_held")
        )
        pairs = a.join(held.drop("_slice"), "_spot").withColumn("_held", F.explode("_held")).select("*", "_held.*")
        once = (F.col("_cx") == _cell(first[0], F.col("_level"))) & (F.col("_cz") == _cell(first[1], F.col("_level")))
        return pairs.filter(bounds_intersect(lb, rb) & once)

    columns = [*left.columns[:-1], *names.values()]
    upward = meet(left, lb, "_own", right, rb, "_other", False).select(*columns)
    downward = meet(right, rb, "_other", left, lb, "_own", True).select(*columns)
    return upward.unionByName(downward)


def points_in_rectangles(
    points: DataFrame, rectangles: DataFrame, keys: tuple[str, ...] = ("dimension",), prefix: str = "r_"
) -> DataFrame:
    """Points with the rectangles that contain their coordinates cut to whole blocks."""
    cut = {"_px": F.col("x").cast("int"), "_pz": F.col("z").cast("int")}
    p = points.withColumns(cut).withColumns({"_qx": F.col("_px") + 1, "_qz": F.col("_pz") + 1})
    hit = rectangle_join(p, rectangles, keys, ("_px", "_pz", "_qx", "_qz"), BOUNDS, prefix)
    return hit.drop("_px", "_pz", "_qx", "_qz")
