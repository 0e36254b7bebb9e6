"""Ids that stay: a stored dictionary of names that only ever grows.

An id is given once and never changes, whatever names come later, so stored columns of ids stay
readable. Fresh names are numbered after the largest id by ranges of names (:func:`numbered`); no
task sees them all. A registration is one version of a :class:`VersionedTable` and becomes visible
as a whole; where two run at once, the later one finds its version taken and numbers again.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import names
from ..operators.lookups import with_biome_fallback, with_fallback
from ..operators.numbering import numbered
from .versioned import DELTA, VersionedTable


class IdRegistry:
    """``(name, id)`` under ``root``. ``reserved`` names come first in an empty registry, in order."""

    def __init__(self, spark: SparkSession, root: str, reserved: tuple[str, ...] = ()):
        self.spark = spark
        self.table = VersionedTable(spark, root, "name")
        if reserved and not self.table.entries():
            rows = spark.createDataFrame(list(zip(reserved, range(len(reserved)))), "name string, id int")
            self._save(rows, -1)

    def ids(self, version: int | None = None) -> DataFrame:
        rows = self.table.read(version)
        return self.spark.createDataFrame([], "name string, id int") if rows is None else rows.select("name", "id")

    def adopt(self, known: DataFrame) -> None:
        """Takes over names with the ids they already have; the registry must not hold them yet."""
        self._save(known.select("name", F.col("id").cast("int").alias("id")), self._latest())

    def extend(self, seen: DataFrame) -> DataFrame:
        """All names with their ids, after those of ``seen`` (a column ``name``) have one.

        Null names get none. Ids go by name among the fresh ones; running again adds nothing.
        """
        while True:
            at = self._latest()
            held = self.ids(at) if at >= 0 else self.ids()
            fresh = seen.select("name").where("name is not null").distinct().join(held.select("name"), "name", "left_anti")
            top = held.agg(F.max("id").alias("top")).first()["top"]
            rows = numbered(fresh, ["name"], "id", 0 if top is None else top + 1).select("name", F.col("id").cast("int").alias("id"))
            if rows.isEmpty() or self._save(rows, at):
                return self.ids()

    def _latest(self) -> int:
        known = self.table.entries()
        return known[-1].version if known else -1

    def _save(self, rows: DataFrame, after: int) -> bool:
        rows = rows.withColumn("op", F.lit("upsert"))
        return self.table._write(rows, DELTA, f"names-{uuid.uuid4().hex}", after=after) is not None


def registered_blocks(palette: DataFrame, seen: DataFrame, ids: IdRegistry, classifier: DataFrame | None = None) -> DataFrame:
    """Every block name ever seen, mapped or guessed, under its registered id."""
    named = seen.select(names.normalize("name").alias("name")).union(palette.select("name"))
    known = ids.extend(named)
    return known.join(with_fallback(known, palette.drop("id"), classifier), "name")


def registered_biomes(biomes: DataFrame, seen: DataFrame, ids: IdRegistry) -> DataFrame:
    """Every biome name ever seen, mapped or guessed, under its registered id."""
    named = seen.select(names.normalize("name").alias("name")).union(biomes.select("name"))
    known = ids.extend(named)
    return known.join(with_biome_fallback(known, biomes.drop("id")), "name")
