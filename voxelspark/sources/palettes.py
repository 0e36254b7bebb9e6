"""Block and biome palettes from layered JSON documents."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import color, names
from ..operators.lookups import PALETTE_COLUMNS, biome_fallback, last_wins, occludes, resolve_aliases
from ..operators.numbering import numbered

_BLOCK = (
    "struct<color:string,tint:string,water:boolean,transparent:boolean,height:double,"
    "grassy:boolean,decoration:boolean,alias:string>"
)
_BIOME = "struct<grass:string,foliage:string,water:string,overlay:string>"


def read_layers(spark: SparkSession, paths: list[str]) -> DataFrame:
    """One ``(layer, value)`` row per document; later paths are later layers."""
    layers = [spark.read.text(p, wholetext=True).withColumn("layer", F.lit(n)) for n, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, layers)


def _entries(documents: DataFrame, wrapper: str, entry: str) -> DataFrame:
    """Rows of a name-keyed map, bare or under a ``wrapper`` key."""
    wrapped = F.from_json("value", f"struct<{wrapper}:map<string,{entry}>>")[wrapper]
    bare = F.from_json("value", f"map<string,{entry}>")
    chosen = F.when(F.size(wrapped) > 0, wrapped).otherwise(bare)
    return documents.select("layer", F.explode(chosen).alias("_name", "e")).select(
        "layer", names.normalize("_name").alias("name"), "e.*"
    )


def parse_blocks(documents: DataFrame) -> DataFrame:
    """Palette rows: the last layer wins a name; aliases copy their target."""
    raw = _entries(documents, "blocks", _BLOCK)
    alias = F.when(F.coalesce("alias", F.lit("")) != "", names.normalize("alias"))
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).alias(c)
    rows = raw.select(
        "layer",
        "name",
        alias.alias("alias"),
        color.parse_hex("color").alias("c"),
        names.parse_tint("tint").alias("tint"),
        flag("water"),
        flag("transparent"),
        F.coalesce("height", names.infer_height("name"), F.lit(1.0)).alias("height"),
        flag("grassy"),
        flag("decoration"),
    )
    rows = last_wins(resolve_aliases(rows), ["name"], ["layer", "_late"])
    rows = rows.select("*", "c.*", occludes().alias("occludes"), F.lit(True).alias("known"))
    # Air is always id 0; the rest number in name order.
    rows = numbered(rows, [F.col("name") != names.AIR, F.col("name")], "id")
    return rows.withColumn("id", F.col("id").cast("int")).select(*PALETTE_COLUMNS)


def parse_biomes(documents: DataFrame) -> DataFrame:
    """Biome rows; missing channels come from the name, a lone grass also sets the overlay."""
    raw = last_wins(_entries(documents, "biomes", _BIOME), ["name"], ["layer"])
    guess = biome_fallback()
    given = {n: color.parse_hex(n) for n in ("grass", "foliage", "water", "overlay")}
    pick = {n: F.coalesce(given[n], guess[n]) for n in ("grass", "foliage", "water")}
    pick["overlay"] = F.coalesce(given["overlay"], given["grass"], guess["overlay"])
    rows = raw.select("name", *[c.alias(n) for n, c in pick.items()], F.lit(True).alias("known"))
    rows = numbered(rows, [F.col("name") != names.PLAINS, F.col("name")], "id")
    return rows.select(
        F.col("id").cast("int").alias("id"), "name", "grass", "foliage", "water", "overlay", "known"
    )


def read_blocks(spark: SparkSession, paths: list[str]) -> DataFrame:
    return parse_blocks(read_layers(spark, paths))


def read_biomes(spark: SparkSession, paths: list[str]) -> DataFrame:
    return parse_biomes(read_layers(spark, paths))
