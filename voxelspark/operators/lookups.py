"""Dimension tables: block palettes, biome tints, and how rows find them.

A palette has at most 65 536 rows, because block ids are 16-bit by contract. Read
it from a written table: Spark then knows its size, and its own size check turns
every palette join into a broadcast. No join here is hinted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import color, names
from .numbering import numbered

PALETTE_COLUMNS = (
    "id", "name", "r", "g", "b", "a", "tint", "water", "transparent",
    "height", "grassy", "decoration", "occludes", "known",
)


def last_wins(rows: DataFrame, keys: list[str], order: list) -> DataFrame:
    """Keep, whole, the row of each key that comes last in ``order``."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(o) if isinstance(o, str) else o for o in order])
    return rows.withColumn("_rank", F.row_number().over(w)).filter("_rank = 1").drop("_rank")


def resolve_aliases(entries: DataFrame, keys: list[str] = ["name"]) -> DataFrame:
    """Replace alias rows by their target's attributes; drop dangling aliases.

    ``entries`` has ``name``, nullable ``alias`` and ``layer``; a target is the
    last direct entry of the same or an earlier layer.
    """
    direct = entries.filter(F.col("alias").isNull())
    alias = entries.filter(F.col("alias").isNotNull()).select(
        F.col("name").alias("_from"), F.col("alias").alias("_to"), F.col("layer").alias("_layer")
    )
    # Targets and questions of a name in one order of layers, one row a layer: no pairs of the two.
    target = last_wins(direct, ["name", "layer"], ["layer"])
    target = target.select(F.col("name").alias("_to"), F.col("layer").alias("_layer"), F.lit(0).alias("_ask"), F.struct(*entries.columns).alias("_e"))
    asked = alias.select("_to", "_layer").distinct().select("_to", "_layer", F.lit(1).alias("_ask"), F.lit(None).cast(target.schema["_e"].dataType).alias("_e"))
    so_far = Window.partitionBy("_to").orderBy("_layer", "_ask").rowsBetween(Window.unboundedPreceding, 0)
    answer = target.unionByName(asked).withColumn("_e", F.last("_e", ignorenulls=True).over(so_far)).filter("_ask = 1 AND _e IS NOT NULL")
    found = alias.join(answer, ["_to", "_layer"]).select("_from", "_layer", "_e.*")
    found = last_wins(found, ["_from", "_layer"], ["layer"])
    found = found.withColumns({"name": F.col("_from"), "layer": F.col("_layer")}).select(
        *entries.columns, F.lit(1).alias("_late")
    )
    return direct.select(*entries.columns, F.lit(0).alias("_late")).unionByName(found)


def occludes() -> Column:
    return ~F.col("transparent") & ~F.col("water") & ~F.col("decoration")


def with_fallback(seen: DataFrame, palette: DataFrame, classifier: DataFrame | None = None) -> DataFrame:
    """Attributes of every distinct ``name`` in ``seen``, known or guessed.

    ``classifier`` is an optional table ``(name, decoration)`` that marks unmapped
    names as thin plants.
    """
    key = seen.select(names.normalize("name").alias("name")).distinct()
    if classifier is not None:
        key = key.join(
            classifier.select("name", F.col("decoration").alias("_plant")), "name", "left"
        )
    else:
        key = key.withColumn("_plant", F.lit(False))
    p = palette.drop("known").withColumn("_known", F.lit(True))
    j = key.join(p, "name", "left")
    known = F.col("_known").isNotNull()
    guess = color.name_color("_hash")
    plant = F.coalesce(F.col("_plant"), F.lit(False))
    j = j.withColumn("_hash", F.when(~known, color.name_hash("name")))
    out = j.select(
        "name",
        *[F.when(known, F.col(n)).otherwise(c).cast("int").alias(n) for n, c in zip("rgba", guess)],
        F.coalesce("tint", F.lit("none")).alias("tint"),
        F.coalesce("water", F.lit(False)).alias("water"),
        F.when(known, F.col("transparent")).otherwise(plant).alias("transparent"),
        F.coalesce("height", names.infer_height("name"), F.lit(1.0)).alias("height"),
        F.coalesce("grassy", F.lit(False)).alias("grassy"),
        F.when(known, F.col("decoration")).otherwise(plant).alias("decoration"),
        known.alias("known"),
    )
    return out.withColumn("occludes", occludes())


def extend_palette(palette: DataFrame, seen: DataFrame, classifier: DataFrame | None = None) -> DataFrame:
    """The palette plus one guessed row, with a fresh id, per unmapped name (for ids that outlive
    this call, see ``sources.registry``)."""
    new = with_fallback(seen, palette, classifier).filter(~F.col("known"))
    top = palette.agg(F.max("id").alias("top")).first()["top"]
    new = numbered(new, ["name"], "id", (top or 0) + 1).withColumn("id", F.col("id").cast("int"))
    return palette.select(*PALETTE_COLUMNS).unionByName(new.select(*PALETTE_COLUMNS))


def encode_names(rows: DataFrame, table: DataFrame, name: str, as_id: str) -> DataFrame:
    """Swap a name column for the id of the same name in a dimension table."""
    ids = table.select(F.col("name").alias(name), F.col("id").alias(as_id))
    return rows.join(ids, name, "left").drop(name)


def biome_fallback(key: Column | str = "name") -> dict[str, Column]:
    """Columns grass, foliage, water, overlay of an unmapped biome."""
    grass, foliage, water = names.biome_tints(key)
    return {
        "grass": grass.struct(),
        "foliage": foliage.struct(),
        "water": water.struct(),
        "overlay": color.name_color(color.name_hash(key)).struct(),
    }


def with_biome_fallback(seen: DataFrame, biomes: DataFrame) -> DataFrame:
    key = seen.select(names.normalize("name").alias("name")).distinct()
    j = key.join(biomes.withColumn("_known", F.lit(True)), "name", "left")
    known = F.col("_known").isNotNull()
    guess = biome_fallback()
    return j.select(
        "name",
        *[F.coalesce(F.col(n), guess[n]).alias(n) for n in ("grass", "foliage", "water", "overlay")],
        known.alias("known"),
    )


def unknown_report(seen: DataFrame, palette: DataFrame, limit: int | None = None) -> DataFrame:
    """Unmapped names with their occurrence count and generated colour."""
    counted = seen.groupBy(names.normalize("name").alias("name")).agg(F.count("*").alias("n"))
    rows = counted.join(palette.select("name"), "name", "left_anti").select(
        "name", "n", color.format_hex(color.name_color(color.name_hash("name"))).alias("color")
    )
    rows = rows.orderBy(F.desc("n"), "name")
    return rows.limit(limit) if limit else rows
