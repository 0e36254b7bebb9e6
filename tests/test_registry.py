"""Ids that stay, and numbers over a total order."""

from pyspark.sql import functions as F

from voxelspark.operators.numbering import numbered
from voxelspark.sources.registry import IdRegistry
from workload import views as fx


def ids(rows):
    return {r["name"]: r["id"] for r in rows.collect()}


def test_ids_never_change(spark, tmp_path):
    name = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    held = IdRegistry(spark, str(tmp_path / "r"), ("air",))
    first = ids(held.extend(name("m", "b", "m", None, "air")))
    assert first == {"air": 0, "b": 1, "m": 2}
    second = ids(held.extend(name("a", "m", "c")))
    assert second == first | {"a": 3, "c": 4}
    again = IdRegistry(spark, str(tmp_path / "r"), ("air",))
    assert ids(again.extend(name("a"))) == second and len(again.table.entries()) == 3


def test_two_registrations_at_once(spark, tmp_path):
    name = lambda *n: spark.createDataFrame([(x,) for x in n], "name string")
    a, b = (IdRegistry(spark, str(tmp_path / "r")) for _ in range(2))
    latest = a._latest

    def late():
        a._latest = latest
        at = latest()
        b.extend(name("x", "y"))  # comes in after the other has read
        return at

    a._latest = late
    assert ids(a.extend(name("w", "x"))) == {"x": 0, "y": 1, "w": 2}


def test_numbers_without_one_window(spark):
    rows = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(4000)).alias("k"), "id").repartition(7)
    got = numbered(rows, ["k", "id"], "n", 10)
    want = {r: i + 10 for i, r in enumerate(sorted((r["k"], r["id"]) for r in rows.collect()))}
    assert {(r["k"], r["id"]): r["n"] for r in got.collect()} == want
    assert numbered(rows.limit(0), ["k"], "n").count() == 0


def test_no_palette_is_numbered_by_a_global_window(spark, sf):
    from voxelspark.operators import lookups
    from workload.ingest_queries import known_palette

    plan = lookups.extend_palette(known_palette(spark, sf), fx.raw_names(spark, sf))._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "SinglePartition" not in plan
