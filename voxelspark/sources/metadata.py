"""What a world says of itself: level documents, probed height ranges, borders and display order."""

from __future__ import annotations

import gzip
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.grid import REGION_CHUNKS
from . import tagged
from .worlds import DISPLAY_ORDER, OVERWORLD

# File name, fields and defaults of level documents, the size from which a border
# counts as none, and how far a height range is looked for.
LEVEL_FILE = "level.dat"
NUMBERS = {"spawn_x": ("SpawnX", 0), "spawn_y": ("SpawnY", 64), "spawn_z": ("SpawnZ", 0), "center_x": ("BorderCenterX", 0), "center_z": ("BorderCenterZ", 0), "border": ("BorderSize", 0)}
NO_BORDER = 29_000_000
NEAREST_REGIONS = 3
PROBED = 8  # chunks along each side of a region's first corner
LEVEL = "world string, level_name string, " + ", ".join(f"{n} long" for n in NUMBERS) + ", error string"


def read_levels(spark: SparkSession, path: str) -> DataFrame:
    """Level documents anywhere below ``path``, as ``path, content``."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", LEVEL_FILE).option("recursiveFileLookup", "true").load(path)
    return rows.select("path", "content")


def _read(content: bytes | None) -> dict:
    try:
        data = gzip.decompress(content or b"")
    except (OSError, EOFError, zlib.error):
        data = content or b""  # some tools write it plain
    root = tagged.parse(data)
    found = root.get("Data", root)
    found = found if isinstance(found, dict) else {}
    name = found.get("LevelName")
    out: dict = {"level_name": name if isinstance(name, str) else ""}
    for column, (field, default) in NUMBERS.items():
        value = found.get(field)
        out[column] = int(value) if isinstance(value, (int, float)) else default
    if out["border"] >= NO_BORDER:
        out["border"] = 0
    return out


def _levels(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for row in batch.to_pylist():
            try:
                rows.append({"world": row["world"], **_read(row["content"])})
            except Exception as fault:  # a world without metadata is still a world
                rows.append({"world": row["world"], "level_name": "", **{n: 0 for n in NUMBERS}, "error": str(fault)})
        kinds = [("world", pa.string()), ("level_name", pa.string()), *((n, pa.int64()) for n in NUMBERS), ("error", pa.string())]
        yield pa.RecordBatch.from_pylist(rows, pa.schema(kinds))


def level_data(files: DataFrame) -> DataFrame:
    """One row per level document: its world's folder, name, spawn and border; what cannot be read
    has an error and neither name nor spawn nor border."""
    folder = F.regexp_replace("path", "/[^/]*$", "").alias("world")
    return files.select(folder, "content").mapInArrow(_levels, LEVEL)


def probe_regions(regions: DataFrame) -> DataFrame:
    """The regions of each dimension that lie nearest to the origin, a few whatever the world's
    size; ``probe`` is their order. Each task cuts its own before they meet."""
    far = F.col("region_x").cast("long") * F.col("region_x") + F.col("region_z").cast("long") * F.col("region_z")
    order = Window.partitionBy("dimension").orderBy(far, "region_x", "region_z")
    return regions.withColumn("probe", F.row_number().over(order)).filter(F.col("probe") <= NEAREST_REGIONS)


def probe_chunks(rows: DataFrame) -> DataFrame:
    """Of chunk rows, those in the first corner of their region: all that need decoding."""
    corner = lambda c: F.pmod(F.col(c), F.lit(REGION_CHUNKS)) < PROBED
    return rows.filter(corner("chunk_x") & corner("chunk_z"))


def height_ranges(sections: DataFrame, probes: DataFrame) -> DataFrame:
    """``dimension, low, high`` of the first probed chunk with any section, region by region and row by
    row. ``sections`` are those of the decoded chunks, ``probes`` comes from :func:`probe_regions`."""
    region = lambda c: F.floor(F.col(c) / REGION_CHUNKS).cast("int")
    chunks = probe_chunks(sections).groupBy("dimension", "chunk_x", "chunk_z").agg(
        F.min("section_y").alias("_least"), F.max("section_y").alias("_most")
    )
    chunks = chunks.withColumns({"region_x": region("chunk_x"), "region_z": region("chunk_z")})
    met = chunks.join(probes.select("dimension", "region_x", "region_z", "probe"), ["dimension", "region_x", "region_z"])
    first = F.min_by(F.struct("_least", "_most"), F.struct("probe", "chunk_z", "chunk_x")).alias("_s")
    return met.groupBy("dimension").agg(first).select(
        "dimension", (F.col("_s._least") * 16).alias("low"), (F.col("_s._most") * 16 + 16).alias("high")
    )


def described(dimensions: DataFrame, world: str, levels: DataFrame, ranges: DataFrame, borders: DataFrame, overrides: dict[str, str] = {}) -> DataFrame:
    """Discovered dimensions with spawn, border, height range and place in the list.

    The main dimension alone takes name, spawn and border from its world's document; a name given
    by an override stays. A border that is not set is estimated, a height range that could not
    be probed is the preset one. ``place`` sorts the known dimensions first, then ``dimension``.
    """
    level = levels.filter((F.col("world") == world.rstrip("/")) & F.col("error").isNull()).withColumn("dimension", F.lit(OVERWORLD)).drop("world", "error")
    out = dimensions.join(level.withColumnRenamed("border", "_set"), "dimension", "left")
    out = out.join(ranges, "dimension", "left").join(borders, "dimension", "left")
    named = (F.trim("level_name") != "") & (F.lit(OVERWORLD not in overrides))
    place = F.coalesce(F.array_position(F.array(*map(F.lit, DISPLAY_ORDER)), F.col("dimension")), F.lit(0)).cast("int")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return out.select(
        "dimension",
        F.when(named, F.col("level_name")).otherwise(F.col("name")).alias("name"),
        "directory",
        F.coalesce("low", "min_y").alias("min_y"),
        F.coalesce("high", "max_y").alias("max_y"),
        "has_ceiling",
        *[zero(c) for c in ("spawn_x", "spawn_z", "center_x", "center_z")],
        F.when(F.col("_set") > 0, F.col("_set")).otherwise(F.col("border")).cast("long").alias("border"),
        F.when(place > 0, place - 1).otherwise(len(DISPLAY_ORDER)).alias("place"),
    )
