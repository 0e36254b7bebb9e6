"""Areas, markers and players: geometry, viewport queries, claims and search."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color
from ..functions.grid import CHUNK_BLOCKS, col, floor_div
from ..shared import written
from .spatial import BOUNDS, points_in_rectangles, rectangle_join

DEFAULT_LIMIT = 5000
GROWTH = 8  # of the areas from round to round


def kind_matches(kind, kinds: list[str]) -> Column:
    return F.lower(col(kind)).isin([k.lower() for k in kinds]) if kinds else F.lit(True)


def visible_at(zoom, min_zoom="min_zoom", max_zoom=None) -> Column:
    """Zoom thresholds; a negative zoom shows everything, a missing bound is open."""
    z = col(zoom)
    ok = F.coalesce(col(min_zoom) <= z, F.lit(True))
    if max_zoom is not None:
        ok = ok & F.coalesce(col(max_zoom) >= z, F.lit(True))
    return (z < 0) | ok


def shown_players(players: DataFrame) -> DataFrame:
    return players.filter(~F.col("hidden"))


def area_bounds(areas: DataFrame) -> DataFrame:
    """Bounding box of each shape: ``shape``, ``polygon``, ``chunks`` or the given rectangle.

    Empty shapes keep their rectangle; inverted rectangles are swapped.
    """
    outline = (F.col("shape") == "polygon") & (F.size("polygon") > 0)
    cells = (F.col("shape") == "chunks") & (F.size("chunks") > 0)
    of = lambda field, part: F.transform(field, lambda e: e[part])
    chunk = CHUNK_BLOCKS

    def low(axis: str, given: str) -> Column:
        return (
            F.when(outline, F.floor(F.array_min(of("polygon", axis))).cast("int"))
            .when(cells, F.array_min(of("chunks", axis)) * chunk)
            .otherwise(F.col(given))
        )

    def high(axis: str, given: str) -> Column:
        return (
            F.when(outline, F.ceil(F.array_max(of("polygon", axis))).cast("int"))
            .when(cells, F.array_max(of("chunks", axis)) * chunk + chunk)
            .otherwise(F.col(given))
        )

    boxed = areas.select(
        *[c for c in areas.columns if c not in BOUNDS],
        low("x", "min_x").alias("_x0"),
        low("z", "min_z").alias("_z0"),
        high("x", "max_x").alias("_x1"),
        high("z", "max_z").alias("_z1"),
    )
    return boxed.withColumns(
        {
            "min_x": F.least("_x0", "_x1"),
            "min_z": F.least("_z0", "_z1"),
            "max_x": F.greatest("_x0", "_x1"),
            "max_z": F.greatest("_z0", "_z1"),
            "shape": F.coalesce("shape", F.lit("rect")),
        }
    ).drop("_x0", "_z0", "_x1", "_z1")


def areas_in_views(views: DataFrame, areas: DataFrame, kinds: list[str] = [], max_zoom: str | None = "r_max_zoom") -> DataFrame:
    """Areas overlapping each viewport that its zoom and kinds let through."""
    wanted = areas.filter(kind_matches("kind", kinds))
    return rectangle_join(views, wanted).filter(visible_at("zoom", "r_min_zoom", max_zoom))


def markers_in_views(views: DataFrame, markers: DataFrame, kinds: list[str] = []) -> DataFrame:
    spots = markers.filter(kind_matches("kind", kinds)).withColumns(
        {"min_x": F.col("x"), "min_z": F.col("z"), "max_x": F.col("x") + 1, "max_z": F.col("z") + 1}
    )
    return rectangle_join(views, spots).filter(visible_at("zoom", "r_min_zoom"))


def players_in_views(views: DataFrame, players: DataFrame) -> DataFrame:
    return points_in_rectangles(shown_players(players), views)


def bounded(rows: DataFrame, keys: list[str], order: list, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """The first ``limit`` rows per key with a flag telling whether more existed.

    One row beyond the limit is kept to tell, so ``rows`` is evaluated once. The rank is
    computed with Spark's group-limit pushdown: a hot key is cut inside each task before
    the shuffle.
    """
    w = Window.partitionBy(*keys)
    first = rows.withColumn("_n", F.row_number().over(w.orderBy(*order))).filter(F.col("_n") <= limit + 1)
    flagged = first.withColumn("truncated", F.max("_n").over(w) > limit).filter(F.col("_n") <= limit)
    others = [c for c in rows.columns if c not in keys]
    return flagged.select(*keys, *others, "truncated")


def first_areas_in_views(
    views: DataFrame, areas: DataFrame, limit: int = DEFAULT_LIMIT, kinds: list[str] = [], max_zoom: str | None = "r_max_zoom"
) -> DataFrame:
    """``bounded`` areas of each viewport by id, without all pairs of the two.

    The areas come in rounds of rising ids, each ``GROWTH`` times as many as all before; a viewport
    that has met more than ``limit`` takes no part in later rounds. Any cut of the ids is right.
    """
    areas = written(areas, "areas")
    n, size, shares = areas.count(), 64 * limit, []
    while size < n:
        shares.append(size / n)
        size *= GROWTH
    cuts = sorted(set(areas.approxQuantile("id", shares, shares[0] / 4))) if shares else []
    left, found = views.withColumn("_seen", F.lit(0).cast("long")), []
    for low, high in zip([None, *cuts], [*cuts, None]):
        part = areas if high is None else areas.filter((F.col("id") < high) | F.col("id").isNull())
        part = part if low is None else part.filter(F.col("id") >= low)
        rank = F.row_number().over(Window.partitionBy("view_id").orderBy("r_id"))
        hits = areas_in_views(left, part, kinds, max_zoom).drop("_seen").withColumn("_n", rank).filter(F.col("_n") <= limit + 1).drop("_n")
        found.append(written(hits, "hits"))
        if high is None:
            break
        more = found[-1].groupBy("view_id").agg(F.count("*").alias("_more"))
        seen = F.col("_seen") + F.coalesce("_more", F.lit(0))
        left = written(left.join(more, "view_id", "left").withColumn("_seen", seen).filter(F.col("_seen") <= limit).drop("_more"), "views")
        if left.isEmpty():
            break
    return bounded(reduce(DataFrame.unionByName, found), ["view_id"], ["r_id"], limit)


def area_chunk_rows(areas: DataFrame, members: DataFrame) -> DataFrame:
    """Exact chunks of chunk-shaped claims."""
    return members.join(areas.filter("kind = 'claim'").select(F.col("id").alias("area_id")), "area_id", "left_semi")


def claim_conflicts(requested: DataFrame, areas: DataFrame, members: DataFrame) -> DataFrame:
    """Requested chunks already covered by a claim.

    ``requested`` has ``request_id, dimension, chunk_x, chunk_z``. Claims that list
    chunks are matched exactly, all others by overlap of their box.
    """
    claims = areas.filter("kind = 'claim'")
    listed = members.select("area_id").distinct()
    exact = area_chunk_rows(areas, members).select("dimension", "chunk_x", "chunk_z").distinct()
    boxes = claims.join(listed, claims["id"] == listed["area_id"], "left_anti").select("dimension", "id", *BOUNDS)
    c = CHUNK_BLOCKS
    cells = requested.select("dimension", "chunk_x", "chunk_z").distinct().withColumns(
        {
            "_x0": F.col("chunk_x") * c,
            "_z0": F.col("chunk_z") * c,
            "_x1": F.col("chunk_x") * c + c,
            "_z1": F.col("chunk_z") * c + c,
        }
    )
    over = rectangle_join(cells, boxes, left_bounds=("_x0", "_z0", "_x1", "_z1"))
    taken = exact.unionByName(over.select("dimension", "chunk_x", "chunk_z")).distinct()
    return requested.join(taken, ["dimension", "chunk_x", "chunk_z"], "left_semi")


def accepted_requests(requested: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Requests without a single conflicting chunk."""
    return requested.join(conflicts.select("request_id"), "request_id", "left_anti")


def unclaim(members: DataFrame, areas: DataFrame, removed: DataFrame) -> DataFrame:
    """Claim chunks left after removal; claims that lose every chunk vanish."""
    claims = areas.filter("kind = 'claim'").select(F.col("id").alias("area_id"))
    touched = members.join(claims, "area_id", "left_semi")
    kept = touched.join(removed, ["dimension", "chunk_x", "chunk_z"], "left_anti")
    other = members.join(claims, "area_id", "left_anti")
    return kept.unionByName(other)


def chunk_boxes(members: DataFrame) -> DataFrame:
    """Bounding box in blocks of each area's chunk set, recomputed after edits."""
    c = CHUNK_BLOCKS
    return members.groupBy("area_id").agg(
        (F.min("chunk_x") * c).alias("min_x"),
        (F.min("chunk_z") * c).alias("min_z"),
        (F.max("chunk_x") * c + c).alias("max_x"),
        (F.max("chunk_z") * c + c).alias("max_z"),
        F.count("*").alias("chunks"),
    )


def force_loaded(current: DataFrame, changes: DataFrame) -> DataFrame:
    """The per-dimension chunk set after adding (``loaded``) or removing chunks."""
    on = ["dimension", "chunk_x", "chunk_z"]
    added = changes.filter("loaded").select(*on)
    removed = changes.filter("not loaded").select(*on)
    return current.select(*on).unionByName(added).distinct().join(removed, on, "left_anti")


def snapshot_diff(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Who joined and who left between two full snapshots."""
    b, a = before.select(key).distinct(), after.select(key).distinct()
    joined = a.join(b, key, "left_anti").withColumn("change", F.lit("joined"))
    left = b.join(a, key, "left_anti").withColumn("change", F.lit("left"))
    return joined.unionByName(left)


def latest_positions(updates: DataFrame) -> DataFrame:
    """Last known row of each player, hidden ones excluded."""
    rest = [c for c in updates.columns if c != "player"]
    last = updates.groupBy("player").agg(F.max_by(F.struct(*rest), F.struct("ts", "event_id")).alias("s"))
    return last.select("player", "s.*").filter(~F.col("hidden"))


def owner_legend(areas: DataFrame, members: DataFrame) -> DataFrame:
    """Claimed chunks per owner; claims without a chunk list are estimated from their box."""
    n = members.groupBy("area_id").agg(F.count("*").alias("_n"))
    claims = areas.filter("kind = 'claim'")
    side = lambda lo, hi: F.greatest(F.lit(1), F.floor((F.col(hi) - F.col(lo)) / 16 + 0.5))
    rough = side("min_x", "max_x") * side("min_z", "max_z")
    j = claims.join(n, claims["id"] == n["area_id"], "left")
    owner = F.coalesce("owner", F.lit("Unclaimed"))
    return (
        j.groupBy(owner.alias("owner"))
        .agg(F.sum(F.coalesce("_n", rough)).cast("long").alias("chunks"))
        .withColumn("color", color.owner_color("owner"))
        .orderBy(F.desc("chunks"), "owner")
    )


def seed_spawn_markers(dimensions: DataFrame, markers: DataFrame) -> DataFrame:
    """A spawn marker for every enabled dimension that has none."""
    from ..functions.names import safe_id

    have = markers.filter(kind_matches("kind", ["spawn"])).select("dimension")
    return (
        dimensions.filter("enabled")
        .join(have, "dimension", "left_anti")
        .select(
            F.concat(F.lit("spawn-"), safe_id("dimension")).alias("id"),
            F.lit("spawn").alias("kind"),
            F.lit("Spawn").alias("name"),
            "dimension",
            F.col("spawn_x").alias("x"),
            F.col("spawn_z").alias("z"),
        )
    )


def select_range(ranges: DataFrame) -> DataFrame:
    """Every chunk of inclusive ranges ``min_cx, min_cz, max_cx, max_cz`` in any corner order."""
    axis = lambda a, b: F.sequence(F.least(a, b), F.greatest(a, b))
    return (
        ranges.withColumn("chunk_x", F.explode(axis("min_cx", "max_cx")))
        .withColumn("chunk_z", F.explode(axis("min_cz", "max_cz")))
        .drop("min_cx", "min_cz", "max_cx", "max_cz")
    )


def toggled(clicks: DataFrame, keys: list[str]) -> DataFrame:
    """Cells left selected after toggling: those clicked an odd number of times."""
    return clicks.groupBy(*keys).agg(F.count("*").alias("_n")).filter("_n % 2 = 1").drop("_n")


def search(
    term: str,
    players: DataFrame | None = None,
    markers: DataFrame | None = None,
    areas: DataFrame | None = None,
    dimension: str | None = None,
    limit: int = 20,
) -> DataFrame:
    """Ranked substring search; the first matching field of a row decides its score.

    Score is -1 for an exact match, else the offset. Ties go by name, then type and
    id. Players are never filtered by dimension, but hidden ones do not appear. A blank
    term finds nothing; a limit of zero or less is the default one.
    """
    needle = term.strip().lower()
    limit = limit if limit > 0 else 20
    here = lambda df: df if dimension is None else df.filter(F.col("dimension") == dimension)

    def scored(rows: DataFrame, fields: list[str], **out: Column) -> DataFrame:
        score = F.coalesce(
            *[
                F.when(F.lower(f) == needle, F.lit(-1)).when(
                    F.instr(F.lower(f), needle) > 0, F.instr(F.lower(f), needle) - 1
                )
                for f in fields
            ]
        )
        rows = rows.withColumn("score", score).filter(F.col("score").isNotNull() & F.lit(needle != ""))
        return rows.select(*[c.alias(n) for n, c in out.items()], "dimension", "score")

    found = []
    if players is not None:
        found.append(
            scored(
                shown_players(players),
                ["name"],
                type=F.lit("player"),
                id=F.col("player").cast("string"),
                name=F.col("name"),
                x=F.col("x").cast("int"),
                z=F.col("z").cast("int"),
            )
        )
    if markers is not None:
        rows = here(markers).withColumn("id", F.col("id").cast("string"))
        found.append(
            scored(rows, ["name", "id"], type=F.col("kind"), id=F.col("id"), name=F.col("name"), x=F.col("x"), z=F.col("z"))
        )
    if areas is not None:
        rows = here(areas).withColumn("id", F.col("id").cast("string"))
        title = F.when(F.coalesce("name", F.lit("")) == "", F.col("owner")).otherwise(F.col("name"))
        middle = lambda a, b: ((F.col(a) + F.col(b)) / 2).cast("int")  # toward zero
        found.append(
            scored(
                rows,
                ["name", "owner", "id"],
                type=F.col("kind"),
                id=F.col("id"),
                name=title,
                x=middle("min_x", "max_x"),
                z=middle("min_z", "max_z"),
            )
        )
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result.orderBy("score", "name", "type", "id").limit(limit)


def parse_coordinates(text) -> Column:
    """``x z``, ``x,z`` or ``x y z`` as a struct, NULL for anything else."""
    parts = F.filter(F.split(F.trim(col(text)), "[ ,\t;]+"), lambda p: p != "")
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    n = F.size(parts)
    good = F.forall(numbers, lambda v: v.isNotNull()) & n.isin(2, 3)
    last = F.try_element_at(numbers, F.lit(-1))
    return F.when(good, F.struct(F.try_element_at(numbers, F.lit(1)).alias("x"), last.alias("z")))


def inventory(areas: DataFrame, markers: DataFrame, players: DataFrame) -> DataFrame:
    count = lambda df, name: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("what"), "n")
    return count(areas, "areas").unionByName(count(markers, "markers")).unionByName(count(players, "players"))


def chunk_of(x, z) -> tuple[Column, Column]:
    return floor_div(x, CHUNK_BLOCKS), floor_div(z, CHUNK_BLOCKS)
