"""Block assets: layered packs, model inheritance, shapes, textures and their mips."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from ..functions.grid import col
from ..functions.names import DEFAULT_NAMESPACE
from ..operators.lookups import last_wins

# Fixed value: longest model chain and longest run of variable references.
MAX_CHAIN = 16


def read_packs(spark: SparkSession, folders: list[str]) -> DataFrame:
    """Files of every readable pack: ``pack, asset, content``; later packs rank higher."""
    found = []
    for rank, folder in enumerate(folders):
        root = folder.rstrip("/")
        try:
            files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
        except AnalysisException:
            continue  # a missing pack is skipped, the others still load
        asset = F.regexp_extract("path", f"{root}/(.*)$", 1)
        found.append(files.select(F.lit(rank).alias("pack"), asset.alias("asset"), "content"))
    return reduce(DataFrame.unionByName, found)


def effective_assets(files: DataFrame) -> DataFrame:
    """The file of the highest pack at each asset path."""
    return last_wins(files, ["asset"], ["pack"])


def model_id(ref) -> Column:
    """``namespace:path`` of a model reference."""
    r = F.trim(col(ref))
    return F.when(F.coalesce(r, F.lit("")) == "", None).when(r.contains(":"), r).otherwise(
        F.concat(F.lit(f"{DEFAULT_NAMESPACE}:"), r)
    )


def model_chains(models: DataFrame) -> DataFrame:
    """Ancestors of every model with their distance: ``model, ancestor, depth``.

    Known path lengths double with each join, so a chain of sixteen takes four. A
    model that comes up again ends the chain, as does a missing or built-in parent.
    """
    known = models.select(F.col("model").alias("_p"))
    parent = F.when(~F.col("parent").startswith("builtin/"), model_id("parent"))
    links = models.select("model", parent.alias("_p")).join(known.withColumn("_ok", F.lit(True)), "_p", "left")
    last = F.when(F.col("_ok"), F.col("_p"))
    none = F.array().cast("array<string>")
    paths = links.select("model", F.when(last.isNotNull(), F.array(last)).otherwise(none).alias("path"), last.alias("last"))
    length = 1
    while length < MAX_CHAIN:
        further = paths.select(F.col("model").alias("last"), F.col("path").alias("_path"), F.col("last").alias("_last"))
        paths = paths.join(further, "last", "left").select(
            "model", F.concat("path", F.coalesce("_path", none)).alias("path"), F.col("_last").alias("last")
        )
        length *= 2
    whole = F.slice(F.concat(F.array("model"), F.col("path")), 1, MAX_CHAIN)
    each = paths.select("model", F.posexplode(whole).alias("depth", "ancestor"))
    return each.groupBy("model", "ancestor").agg(F.min("depth").alias("depth"))


def resolve_models(models: DataFrame) -> DataFrame:
    """Inherited geometry and texture variables of every model.

    ``models`` has ``model, parent, textures map, elements``. The nearest model with
    elements supplies them; a variable is taken from the nearest model that sets it.
    """
    chain = model_chains(models)
    parts = chain.join(models.select(F.col("model").alias("ancestor"), "textures", "elements"), "ancestor")
    shape = parts.groupBy("model").agg(
        F.min_by("elements", F.when(F.size("elements") > 0, F.col("depth"))).alias("elements"),
        F.max("depth").alias("chain"),
    )
    variables = parts.select("model", "depth", F.explode("textures").alias("k", "v"))
    variables = variables.groupBy("model", "k").agg(F.min_by("v", "depth").alias("v"))
    merged = variables.groupBy("model").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("textures"))
    return shape.join(merged, "model", "left")


def resolve_texture(ref, variables) -> Column:
    """Follow ``#name`` references to a texture path; empty when one is missing."""
    table = col(variables)

    def follow(current: Column, _: Column) -> Column:
        target = F.try_element_at(table, F.substring(current, 2, 1 << 20))
        return F.when(current.startswith("#"), F.coalesce(target, F.lit(""))).otherwise(current)

    end = F.aggregate(F.sequence(F.lit(1), F.lit(MAX_CHAIN)), col(ref), follow)
    return F.when(end.startswith("#"), F.lit("")).otherwise(end)


def is_billboard(elements) -> Column:
    """Crossed planes: an even number of upright elements, each thin on one of x and z."""

    def plane(e: Column) -> Column:
        lo, hi = e["from"], e["to"]
        thin_x, thin_z = lo[0] == hi[0], lo[2] == hi[2]
        return (thin_x != thin_z) & (hi[1] - lo[1] >= 14) & ~F.array_contains(e["faces"], "up") & ~F.array_contains(e["faces"], "down")

    n = F.size(col(elements))
    return (n > 0) & (n % 2 == 0) & F.forall(col(elements), plane)


def is_full_cube(elements) -> Column:
    whole = lambda e: (F.array_min(e["from"]) == 0) & (F.array_max(e["from"]) == 0) & (F.array_min(e["to"]) == 16) & (F.array_max(e["to"]) == 16)
    return (F.size(col(elements)) == 1) & F.forall(col(elements), whole)


def pick_variant(variants) -> Column:
    """Model of a block state file: the unnamed variant, else the upright one, else
    the first in key order that names a model. Values are an object or a list."""
    v = col(variants)
    models = lambda raw: F.filter(
        F.transform(F.from_json(raw, "array<struct<model:string>>"), lambda m: m["model"]), lambda m: F.coalesce(m, F.lit("")) != ""
    )
    rank = lambda k: F.when(k == "", 0).when(k == "axis=y", 1).otherwise(2)
    listed = F.transform(
        F.map_entries(v),
        lambda e: F.struct(rank(e["key"]).alias("rank"), e["key"].alias("key"), F.try_element_at(models(e["value"]), F.lit(1)).alias("model")),
    )
    good = F.filter(listed, lambda e: e["model"].isNotNull())
    return F.try_element_at(F.array_sort(good), F.lit(1))["model"]


def image_pixels(images: DataFrame) -> DataFrame:
    """Pixels of the top-left square of decoded images: frame 0 of a sprite sheet.

    ``images`` comes from Spark's image source, whose bytes are in BGR(A) order.
    """
    i = images.select("image.*")
    edge = F.least("width", "height")
    at = lambda offset: F.conv(F.hex(F.substring("data", F.col("_p") + offset + 1, F.lit(1))), 16, 10).cast("int")
    cells = (
        i.filter(edge > 0)
        .withColumn("size", edge)
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
        .withColumn("_row", F.substring("data", F.col("y") * F.col("width") * F.col("nChannels") + 1, F.col("size") * F.col("nChannels")))
        .select(F.col("origin").alias("texture"), "size", "nChannels", "y", F.col("_row").alias("data"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("size") - 1)))
        .withColumn("_p", F.col("x") * F.col("nChannels"))
    )
    grey = F.col("nChannels") == 1
    return cells.select(
        "texture", "size", "x", "y", F.when(grey, at(0)).otherwise(at(2)).alias("r"), F.when(grey, at(0)).otherwise(at(1)).alias("g"),
        at(0).alias("b"), F.when(F.col("nChannels") == 4, at(3)).otherwise(255).alias("a"),
    )


def halve(pixels: DataFrame) -> DataFrame:
    """Next mip level: alpha-weighted colour of 2 x 2 texels, mean alpha of four."""
    half = F.greatest(F.lit(1), F.shiftright("size", 1))
    inside = (F.col("x") < half * 2) & (F.col("y") < half * 2)
    weight = F.sum("a")
    mix = lambda c: F.when(weight > 0, F.floor(F.sum(F.col(c) * F.col("a")) / weight)).otherwise(0).cast("int").alias(c)
    return (
        pixels.filter((F.col("size") > 1) & inside)
        .groupBy("texture", half.alias("size"), F.shiftright("x", 1).alias("x"), F.shiftright("y", 1).alias("y"))
        .agg(*[mix(c) for c in "rgb"], F.floor(F.sum("a") / 4).cast("int").alias("a"))
    )


def mip_levels(pixels: DataFrame, levels: int) -> DataFrame:
    """A texture's pixels and ``levels`` halvings; one shuffle by texture serves all."""
    level = pixels.repartition("texture")
    out = level
    for _ in range(levels):
        level = halve(level)
        out = out.unionByName(level)
    return out


def level_at_most(mips: DataFrame, want: int) -> DataFrame:
    """The largest level not above ``want`` texels, else the smallest there is."""
    sizes = mips.select("texture", "size").distinct().groupBy("texture").agg(
        F.coalesce(F.max(F.when(F.col("size") <= want, F.col("size"))), F.min("size")).alias("size")
    )
    return mips.join(sizes, ["texture", "size"], "left_semi")


def representative_color(mips: DataFrame) -> DataFrame:
    return mips.filter("size = 1").select("texture", "r", "g", "b", "a")


def has_alpha(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("texture").agg(F.bool_or(F.col("a") != 255).alias("has_alpha"))


def downgrade_occluders(palette: DataFrame, alpha: DataFrame) -> DataFrame:
    """Blocks whose texture shows through no longer occlude; never the reverse."""
    j = palette.join(alpha.select(F.col("texture").alias("name"), "has_alpha"), "name", "left")
    return j.withColumn("occludes", F.col("occludes") & ~F.coalesce("has_alpha", F.lit(False))).drop("has_alpha")


def decoration_classifier(blocks: DataFrame) -> DataFrame:
    """``(name, decoration)`` of unmapped blocks by the shape of their resolved model."""
    return blocks.select("name", is_billboard("elements").alias("decoration"))
