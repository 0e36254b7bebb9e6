"""Worlds on disk: which directory is which dimension, and header-only reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.grid import REGION_BLOCKS
from ..functions.names import DEFAULT_NAMESPACE, pretty_name
from ..operators.lookups import last_wins

# Ids of the three base dimensions, in display order.
OVERWORLD = f"{DEFAULT_NAMESPACE}:overworld"
NETHER = f"{DEFAULT_NAMESPACE}:the_nether"
THE_END = f"{DEFAULT_NAMESPACE}:the_end"
DISPLAY_ORDER = (OVERWORLD, NETHER, THE_END)
DEFAULTS = {OVERWORLD: (-64, 320, False), NETHER: (0, 128, True), THE_END: (0, 256, False)}


def region_directories(files: DataFrame) -> DataFrame:
    """Directories holding at least one region file, with their totals."""
    folder = F.regexp_replace("path", "/[^/]*$", "")
    return files.groupBy(folder.alias("directory")).agg(F.count("*").alias("regions"), F.sum("size").alias("bytes"))


NAMES = {OVERWORLD: "Overworld", NETHER: "Nether", THE_END: "The End"}


def discover(directories: DataFrame, world: str, overrides: dict[str, str] = {}, level_name: str = "") -> DataFrame:
    """Dimension of each region directory of the world at path ``world``.

    Four layouts are recognised: inside the world folder, in sibling folders with a
    dimension suffix, and namespaced folders in either place. The first rule that
    names an id wins it; an explicit override beats them all. The main dimension bears the
    level's name; a dimension named by an override has no preset heights or roof. Paths are
    compared as text, whatever characters they hold.
    """
    w = world.rstrip("/")
    d = F.col("directory")
    below = lambda root: F.when(d.startswith(f"{root}/"), F.substring(d, len(root) + 2, 1 << 20)).otherwise("")
    named = lambda root: F.regexp_extract(below(root), "^([^/]+)/([^/]+)/region$", 1)
    path = lambda root: F.regexp_extract(below(root), "^([^/]+)/([^/]+)/region$", 2)
    rules: list[tuple[Column, Column]] = [
        (d == f"{w}/region", F.lit(OVERWORLD)),
        (d == f"{w}/DIM-1/region", F.lit(NETHER)),
        (d == f"{w}/DIM1/region", F.lit(THE_END)),
        (d == f"{w}_nether/DIM-1/region", F.lit(NETHER)),
        (d == f"{w}_the_end/DIM1/region", F.lit(THE_END)),
    ]
    for root in (f"{w}/dimensions", f"{w}_dimensions"):
        rules.append((named(root) != "", F.concat(named(root), F.lit(":"), path(root))))
    found = []
    for rank, (match, name) in enumerate(rules):
        hit = directories.filter(match).select("*", name.alias("dimension"), F.lit(-rank).alias("_rank"))
        found.append(hit.filter(~F.col("dimension").isin(*overrides)) if overrides else hit)
    for name, folder in overrides.items():
        base = folder.rstrip("/")
        inner = (d == f"{base}/region").cast("int")
        hit = directories.filter(d.isin(base, f"{base}/region"))
        found.append(hit.select("*", F.lit(name).alias("dimension"), (inner + 1).alias("_rank")))
    rows = last_wins(reduce(DataFrame.unionByName, found), ["dimension"], ["_rank"]).drop("_rank")
    pick = lambda n, default: reduce(
        lambda c, kv: F.when(F.col("dimension") == kv[0], F.lit(kv[1][n])).otherwise(c),
        [kv for kv in DEFAULTS.items() if kv[0] not in overrides],
        F.lit(default),
    )
    title = pretty_name("dimension")
    for name, text in (NAMES | ({OVERWORLD: level_name} if level_name else {})).items():
        if name not in overrides:
            title = F.when(F.col("dimension") == name, F.lit(text)).otherwise(title)
    return rows.withColumns(
        {
            "name": title,
            "min_y": pick(0, -64),
            "max_y": pick(1, 320),
            "has_ceiling": pick(2, False),
        }
    )


def scan_report(regions: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Regions, bytes and block extent per dimension; chunk counts if slots are given."""
    x0, z0 = F.col("region_x") * REGION_BLOCKS, F.col("region_z") * REGION_BLOCKS
    report = regions.groupBy("dimension").agg(
        F.count("*").alias("regions"),
        F.sum("size").alias("bytes"),
        F.min(x0).alias("min_x"),
        F.min(z0).alias("min_z"),
        (F.max(x0) + REGION_BLOCKS).alias("max_x"),
        (F.max(z0) + REGION_BLOCKS).alias("max_z"),
    )
    if slots is None:
        return report
    n = slots.filter("error is null").groupBy("dimension").agg(F.count("*").alias("chunks"))
    return report.join(n, "dimension", "left").fillna({"chunks": 0})


def estimated_border(regions: DataFrame) -> DataFrame:
    """Border that would hold every region, from the farthest region index."""
    fold = lambda c: F.when(F.col(c) < 0, -F.col(c) - 1).otherwise(F.col(c))
    far = F.max(F.greatest(fold("region_x"), fold("region_z"), F.lit(0)))
    return regions.groupBy("dimension").agg(((far + 1) * (REGION_BLOCKS * 2)).cast("int").alias("border"))
