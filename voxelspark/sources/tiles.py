"""Tile storage: long-form pixels, packed tiles and their partitioning."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from ..functions.grid import TILE_PIXELS, x_shard
from ..functions.names import safe_id
from ..plans.pyramid import TILE_KEYS

STORE_KEYS = ("dimension_id", "mode", "variant", "style", "zoom", "x_shard")


def pack_tiles(tiled: DataFrame, fill: tuple, size: int = TILE_PIXELS) -> DataFrame:
    """One row per tile with its raw RGBA bytes, row by row; unstored pixels are fill.

    A pixel travels as its place in the tile and one number; each tile is one buffer that
    its pixels are scattered into. A tile holds at most ``size`` squared of them.
    """
    inside = F.col("px").between(0, size - 1) & F.col("py").between(0, size - 1)
    color = sum((F.shiftleft(F.col(c).cast("long"), n) for c, n in zip("gba", (16, 8, 0))), F.shiftleft(F.col("r").cast("long"), 24))
    rows = tiled.select(*TILE_KEYS, F.when(inside, F.col("py") * size + F.col("px")).cast("int").alias("at"), color.alias("rgba"))
    blank = int.from_bytes(bytes(fill), "big")

    def scatter(key: tuple, pixels: pa.Table) -> pa.Table:
        stored = pixels.select(["at", "rgba"]).drop_null()
        tile = np.full(size * size, blank, ">u4")
        tile[stored["at"].to_numpy()] = stored["rgba"].to_numpy()
        return pa.table({**{name: [k.as_py()] for name, k in zip(TILE_KEYS, key)}, "rgba": [tile.tobytes()]}, schema)

    kinds = {name: rows.schema[name].dataType for name in TILE_KEYS}
    schema = pa.schema([(name, to_arrow_type(t)) for name, t in kinds.items()] + [("rgba", pa.binary())])
    return rows.groupBy(*TILE_KEYS).applyInArrow(scatter, ", ".join([*(f"{n} {t.simpleString()}" for n, t in kinds.items()), "rgba binary"]))


def stored_rows(spark: SparkSession, path: str, schema: StructType) -> DataFrame | None:
    """The rows at ``path`` in a known schema, or None before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return None
        raise


@contextmanager
def staged(rows: DataFrame, path: str) -> Iterator[DataFrame]:
    """``rows`` as a table next to ``path`` that is gone afterwards."""
    spark, place = rows.sparkSession, f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    rows.write.parquet(place)
    try:
        yield spark.read.schema(rows.schema).parquet(place)
    finally:
        _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(place))


def _delete(spark: SparkSession, folder) -> None:
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def merge_partitions(rows: DataFrame, replaced: DataFrame, path: str, partitions: list[str], keys: list[str]) -> None:
    """Replace the stored rows under the given keys and keep all others.

    ``replaced`` holds the ``partitions`` and ``keys`` of every row that goes; ``rows`` come
    in. Only touched partitions are written anew, with what they held besides. The result
    is staged next to ``path`` first, so that nothing is overwritten while it is read; writing
    the same rows again changes nothing.
    """
    spark = rows.sparkSession
    where = list(dict.fromkeys([*partitions, *keys]))
    replaced = replaced.select(*where).distinct()
    shards = replaced.select(*partitions).unionByName(rows.select(*partitions)).distinct()
    found = stored_rows(spark, path, rows.schema)
    if found is not None:
        kept = found.join(shards, partitions, "left_semi").join(replaced, where, "left_anti")
        rows = rows.unionByName(kept.select(*rows.columns))
    emptied: list[str] = []
    with staged(rows, path) as merged:
        if found is not None:
            # An overwrite leaves partitions alone that get no row; those of the touched ones go.
            folder = F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("folder")
            old = found.select(*partitions, folder).join(shards, partitions, "left_semi")
            gone = old.join(merged.select(*partitions).distinct(), partitions, "left_anti")
            emptied = [r["folder"] for r in gone.select("folder").distinct().collect()]
        merged.repartition(*partitions).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            *partitions
        ).parquet(path)
    for folder in emptied:
        _delete(spark, spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(folder)))


def write_tiles(
    tiles: DataFrame, path: str, mode: str = "top", style: str = "terrain", variant: str = ""
) -> None:
    """Store or replace exactly the given tiles; other tiles of their shards stay.

    Every attribute that changes the picture is part of the partition key.
    """
    rows = tiles.withColumns(
        {
            "dimension_id": safe_id("dimension"),
            "mode": F.lit(mode),
            "variant": F.lit(variant or "default"),
            "style": F.lit(style),
            "x_shard": x_shard("tile_x"),
        }
    )
    merge_partitions(rows, rows, path, list(STORE_KEYS), ["tile_x", "tile_y"])
