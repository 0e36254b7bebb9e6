"""The versioned table: whole batches, former versions, replays, rival writers, compaction."""

import pytest
from voxelspark.sources import versioned
from voxelspark.streaming import jobs

OPS = "id string, v int, op string, batch_id bigint, seq bigint"


def content(table, version=None):
    rows = table.read(version)
    return None if rows is None else {r["id"]: r["v"] for r in rows.collect()}


def test_versions_replays_and_compaction(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "t"))
    assert t.read() is None and t.compact() is None and t.vacuum() == []
    ops = lambda *rows: spark.createDataFrame(rows, OPS)
    assert t.apply(ops(("a", 1, "upsert", 1, 1), ("b", 2, "upsert", 1, 2), ("b", 3, "upsert", 1, 1)), "w-0") == 0
    assert t.apply(ops(("a", 9, "upsert", 2, 5), ("a", None, "delete", 2, 1), ("c", 4, None, 2, 1)), "w-1") == 1
    assert t.apply(ops(("z", 0, "upsert", 1, 1)), "w-0") == 0  # the epoch had been committed
    assert [content(t, v) for v in (0, 1)] == [{"a": 1, "b": 2}, {"b": 2, "c": 4}]
    assert t.compact() == 2 and t.compact() is None
    assert t.apply(ops(("b", None, "delete", 3, 1)), "w-2") == 3
    t.replace(spark.createDataFrame([("q", 7)], "id string, v int"), "s-0")
    t.replace(spark.createDataFrame([], "id string, v int"), "s-1")
    assert [content(t, v) for v in range(6)] == [{"a": 1, "b": 2}, {"b": 2, "c": 4}, {"b": 2, "c": 4}, {"c": 4}, {"q": 7}, {}]
    assert [r["kind"] for r in t.history().orderBy("version").collect()] == ["delta", "delta", "compact", "delta", "snapshot", "snapshot"]
    assert len(t.vacuum(3)) == 2  # the two deltas below the compaction
    assert content(t, 3) == {"c": 4} and content(t) == {}


def test_a_compaction_beside_a_writer_loses_nothing(spark, tmp_path):
    t = versioned.VersionedTable(spark, str(tmp_path / "t"))
    ops = lambda v: spark.createDataFrame([("a", v, "upsert", 1, 1)], OPS)
    t.apply(ops(1), "w-0")
    write = t._write

    def slow(rows, kind, token, upto=-1):
        t._write = write
        t.apply(ops(2), "w-1")  # another writer commits before the compaction does
        return write(rows, kind, token, upto)

    t._write = slow
    t.compact()
    assert content(t) == {"a": 2}
    # A snapshot that comes in between outranks the compaction, too.
    t.apply(ops(3), "w-2")

    def slower(rows, kind, token, upto=-1):
        t._write = write
        t.replace(spark.createDataFrame([("n", 5)], "id string, v int"), "s-0")
        return write(rows, kind, token, upto)

    t._write = slower
    t.compact()
    assert content(t) == {"n": 5}


def test_two_writers_of_one_number(spark, tmp_path):
    a, b = (versioned.VersionedTable(spark, str(tmp_path / "t")) for _ in range(2))
    entries, hidden = a.entries, []

    def stale(version=None):
        if not hidden:
            hidden.append(b.apply(spark.createDataFrame([("b", 1, "upsert", 1, 1)], OPS), "b-0"))
            return []
        return entries(version)

    rows = spark.createDataFrame([("a", 1, "upsert", 1, 1)], OPS)
    rows.write.parquet(str(tmp_path / "t/data/a"))
    a.entries = stale
    assert a._commit(versioned.DELTA, "data/a", "a-0", rows.schema) == 1
    assert content(b) == {"a": 1, "b": 1}


def test_stored_rows_are_resolved(spark, tmp_path):
    schema = "batch_id bigint, id string, dimension string, op string"
    src, good, bad, ck = [str(tmp_path / n) for n in ("src", "good", "bad", "ck")]
    rows = [(1, "a", "minecraft_overworld", "upsert"), (1, "b", "", "upsert"), (1, "c", None, "delete"), (2, "d", "Nowhere", "upsert")]
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(src)
    dims = spark.createDataFrame([("minecraft:overworld",), ("a:b",)], "dimension string")
    jobs.ingest(spark.readStream.schema(schema).parquet(src), dims, good, bad, ck, default="a:b").awaitTermination()
    assert {(r["id"], r["dimension"]) for r in spark.read.parquet(good).collect()} == {("a", "minecraft:overworld"), ("b", "a:b"), ("c", None)}
    assert [r["dimension"] for r in spark.read.parquet(bad).collect()] == ["Nowhere"]


@pytest.mark.parametrize("replayed", [False, True])
def test_stream_of_upserts(spark, tmp_path, replayed):
    src, root = str(tmp_path / "src"), str(tmp_path / "t")
    for n in range(3):
        rows = [("a", n, "upsert", n, 1), (f"only{n}", n, "upsert", n, 2), ("only0", None, "delete" if n == 2 else "upsert", n, 3)]
        spark.createDataFrame(rows, OPS).coalesce(1).write.mode("append").parquet(src)
    for ck in ("one", "two") if replayed else ("one",):  # a lost checkpoint runs every epoch again
        stream = spark.readStream.schema(OPS).option("maxFilesPerTrigger", 1).parquet(src)
        versioned.stream_upserts(stream, root, str(tmp_path / ck)).awaitTermination()
    t = versioned.VersionedTable(spark, root)
    assert content(t) == {"a": 2, "only1": 1, "only2": 2} and len(t.entries()) == 3
