"""Overlay documents and validated overlay ingest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.grid import col
from ..functions.names import safe_id

_POINTS = "array<struct<x:double,z:double>>"
_CHUNKS = "array<struct<x:int,z:int>>"
AREA = (
    "struct<id:string,kind:string,name:string,owner:string,dimension:string,shape:string,minX:int,minZ:int,"
    f"maxX:int,maxZ:int,polygon:{_POINTS},chunks:{_CHUNKS},fill:string,stroke:string,fillOpacity:double,"
    "label:string,minZoom:int,maxZoom:int,properties:map<string,string>>"
)
MARKER = (
    "struct<id:string,kind:string,name:string,dimension:string,x:int,y:int,z:int,icon:string,color:string,"
    "minZoom:int,maxZoom:int,properties:map<string,string>>"
)
PLAYER = (
    "struct<uuid:string,name:string,dimension:string,x:double,y:double,z:double,rotation:double,"
    "health:double,armor:double,updatedAt:timestamp>"
)
DOCUMENT = f"struct<areas:array<{AREA}>,markers:array<{MARKER}>,players:array<{PLAYER}>>"

# Fixed value: the largest batch one ingest request may carry.
MAX_INGEST_ITEMS = 20_000


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path, wholetext=True)


def _section(documents: DataFrame, name: str) -> DataFrame:
    doc = F.from_json("value", DOCUMENT)
    return documents.select(F.explode(doc[name]).alias("e")).select("e.*")


def parse_areas(documents: DataFrame) -> DataFrame:
    from ..operators.overlay import area_bounds

    rows = _section(documents, "areas")
    snake = {"minX": "min_x", "minZ": "min_z", "maxX": "max_x", "maxZ": "max_z", "minZoom": "min_zoom", "maxZoom": "max_zoom"}
    rows = rows.withColumnsRenamed({**snake, "fillOpacity": "fill_opacity"})
    corners = {c: F.coalesce(c, F.lit(0)) for c in ("min_x", "min_z", "max_x", "max_z")}
    return area_bounds(rows.withColumns(corners))


def parse_markers(documents: DataFrame) -> DataFrame:
    return _section(documents, "markers").withColumnsRenamed({"minZoom": "min_zoom", "maxZoom": "max_zoom"})


def parse_players(documents: DataFrame) -> DataFrame:
    rows = _section(documents, "players").withColumnsRenamed({"uuid": "player", "updatedAt": "ts"})
    return rows.withColumn("hidden", F.lit(False))


def display_order(dimension, first: tuple[str, ...]) -> list[Column]:
    """Sort keys: the listed dimensions in their order, then the rest by name."""
    rank = F.lit(99)
    for n, name in reversed(list(enumerate(first))):
        rank = F.when(col(dimension) == name, n).otherwise(rank)
    return [rank, col(dimension)]


def invalid_rows(batch: DataFrame, dimensions: DataFrame, key: str = "id") -> DataFrame:
    """Rows that make their whole batch unacceptable, with the reason."""
    known = dimensions.select("dimension", F.lit(True).alias("_known"))
    j = batch.join(known, "dimension", "left")
    reason = F.when(F.coalesce(F.col(key).cast("string"), F.lit("")) == "", "missing id").when(
        F.col("_known").isNull(), "unknown dimension"
    )
    return j.withColumn("reason", reason).filter(F.col("reason").isNotNull()).drop("_known")


def resolved_dimension(items: DataFrame, known: DataFrame, default: str | None = None) -> DataFrame:
    """``items`` with each request's dimension as a known one, or null: empty is the default, and
    other spellings go by their safe form, an exact one first. Removals (``op``) name none and keep
    what they came with."""
    forms = known.select("dimension").distinct().groupBy(safe_id("dimension").alias("_safe")).agg(F.sort_array(F.collect_set("dimension")).alias("_names"))
    raw = F.coalesce(F.col("dimension"), F.lit(""))
    raw = F.when(raw == "", F.lit(default)).otherwise(raw)
    joined = items.withColumn("_raw", raw).withColumn("_safe", safe_id("_raw")).join(forms, "_safe", "left")
    name = F.when(F.array_contains("_names", F.col("_raw")), F.col("_raw")).otherwise(F.element_at("_names", -1))
    if "op" in items.columns:
        name = F.when(F.coalesce(F.col("op"), F.lit("upsert")) == "delete", F.col("dimension")).otherwise(name)
    return joined.withColumn("dimension", name).select(*items.columns)


def batch_verdicts(
    items: DataFrame, dimensions: DataFrame, key: str = "id", most: int = MAX_INGEST_ITEMS, default: str | None = None
) -> DataFrame:
    """Accept or reject each ``batch_id`` as a whole: one bad row rejects it.

    The dimension is judged as :func:`resolved_dimension` has it.
    With a column ``op``, removals (``delete``) count towards the limit but need neither a
    dimension nor, as unknown ids are simply absent, a known id.
    """
    bad = (F.coalesce(F.col(key).cast("string"), F.lit("")) == "") | F.col("dimension").isNull()
    if "op" in items.columns:
        bad &= F.coalesce(F.col("op"), F.lit("upsert")) != "delete"
    return (
        resolved_dimension(items, dimensions, default)
        .groupBy("batch_id")
        .agg(F.count("*").alias("items"), F.count_if(bad).alias("bad"))
        .withColumn("accepted", (F.col("bad") == 0) & (F.col("items") <= most))
    )


def accepted_items(
    items: DataFrame, dimensions: DataFrame, key: str = "id", most: int = MAX_INGEST_ITEMS, default: str | None = None
) -> DataFrame:
    """Rows of the accepted batches, in their resolved dimension: what is to be stored."""
    good = batch_verdicts(items, dimensions, key, most, default).filter("accepted").select("batch_id")
    return resolved_dimension(items, dimensions, default).join(good, "batch_id", "left_semi").select(*items.columns)
