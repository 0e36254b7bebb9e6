"""A keyed table as a log of versions: batches of upserts and deletes, snapshots, compaction.

    root/data/<writer>-<epoch>-<try>/   rows of one commit, Parquet in shards of the key
    root/log/<version>                  what the commit is, one small file

A commit writes its rows first, in a folder nobody reads, and then becomes visible by one atomic
rename of its log file to the next number; where another writer took that number, it takes the
one after. So readers see whole batches or nothing, at the latest or at any former version,
and a stream's epoch that runs again finds its own entry and adds nothing.

Three kinds of entry: ``delta`` (upserts and deletes by key), ``snapshot`` (all there is from then
on, perhaps nothing) and ``compact`` (the same content as the versions up to the one it names, in
one set of files). A read starts at the last snapshot or compaction and applies later deltas; what
it shuffles are the shards it reads. Compaction may run beside writers: it changes no content.
``vacuum`` deletes data that no version of the last ``keep`` needs.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

DELTA, SNAPSHOT, COMPACT = "delta", "snapshot", "compact"


@dataclass(frozen=True)
class Entry:
    version: int
    kind: str
    folder: str
    upto: int  # for a compaction, the version whose content it holds
    token: str  # who wrote it and which epoch it was
    schema: str


class VersionedTable:
    """``key`` is the column whose value a later row replaces."""

    def __init__(self, spark: SparkSession, root: str, key: str = "id"):
        self.spark, self.root, self.key = spark, root.rstrip("/"), key
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        for part in ("log", "data"):
            self._files.mkdirs(self._path(f"{self.root}/{part}"))

    # ------------------------------------------------------------------ the log

    def entries(self, version: int | None = None) -> list[Entry]:
        """Log entries in order, up to ``version``."""
        found = []
        for status in self._files.listStatus(self._path(f"{self.root}/log")):
            name = status.getPath().getName()
            if name.isdigit() and (version is None or int(name) <= version):
                found.append(int(name))
        return [self._entry(n) for n in sorted(found)]

    def _entry(self, n: int) -> Entry:
        stream = self._files.open(self._path(f"{self.root}/log/{n:020d}"))
        try:
            text = self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return Entry(version=n, **json.loads(text))

    def _commit(self, kind: str, folder: str, token: str, schema: StructType, upto: int = -1, after: int | None = None) -> int | None:
        """The version under which the entry became visible; that of a former try, if it did.

        With ``after``, only as the very next version; None where another writer was first.
        """
        body = {"kind": kind, "folder": folder, "upto": upto, "token": token, "schema": schema.json()}
        draft = self._path(f"{self.root}/log/_{uuid.uuid4().hex}")
        out = self._files.create(draft, False)
        try:
            out.write(bytearray(json.dumps(body).encode()))
        finally:
            out.close()
        while True:
            known = self.entries()
            mine = [e for e in known if e.token == token]
            if mine:
                self._files.delete(draft, False)
                return mine[0].version
            version = known[-1].version + 1 if known else 0
            if after is not None and version != after + 1:
                self._files.delete(draft, False)
                return None
            if self._rename(draft, self._path(f"{self.root}/log/{version:020d}")):
                return version

    def _rename(self, draft, place) -> bool:
        """Renames unless the place is taken (one step where the store has such a rename)."""
        jvm = self.spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._files.getUri(), self.spark._jsc.hadoopConfiguration())
        never = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
        try:
            context.rename(self._files.makeQualified(draft), self._files.makeQualified(place), never)
        except Exception:  # a Java error, of one kind or another by store
            if self._files.exists(place):
                return False
            raise
        return True

    def committed(self, token: str) -> bool:
        return any(e.token == token for e in self.entries())

    # ------------------------------------------------------------------ writing

    def _write(self, rows: DataFrame, kind: str, token: str, upto: int = -1, after: int | None = None) -> int | None:
        folder = f"data/{token.replace('/', '_')}-{uuid.uuid4().hex[:8]}"
        rows.write.parquet(f"{self.root}/{folder}")
        return self._commit(kind, folder, token, rows.schema, upto, after)

    def apply(self, batch: DataFrame, token: str) -> int:
        """Operations (``op``: ``upsert`` or ``delete``) as one version.

        Where there are several of a key, the one of the last ``batch_id`` counts; of one batch a
        delete, else the last ``seq``.
        """
        if self.committed(token):
            return self._commit(DELTA, "", token, batch.schema)
        late = (F.coalesce(F.col("op"), F.lit("upsert")) == "delete").cast("int").alias("late")
        order = [F.col(c) if c in batch.columns else F.lit(0).alias(c) for c in ("batch_id", "seq")]
        values = [c for c in batch.columns if c != self.key]
        last = batch.groupBy(self.key).agg(F.max_by(F.struct(*values), F.struct(order[0], late, order[1])).alias("_r"))
        return self._write(last.select(self.key, "_r.*"), DELTA, token)

    def replace(self, rows: DataFrame, token: str) -> int:
        """A snapshot: ``rows`` are all there is."""
        if self.committed(token):
            return self._commit(SNAPSHOT, "", token, rows.schema)
        return self._write(rows.withColumn("op", F.lit("upsert")), SNAPSHOT, token)

    def compact(self) -> int | None:
        """The present content as one set of files; None where there is nothing to gain."""
        known = self.entries()
        if not known or known[-1].kind != DELTA:
            return None
        rows = self.read(known[-1].version)
        return self._write(rows.withColumn("op", F.lit("upsert")), COMPACT, f"compact-{known[-1].version}", known[-1].version)

    def vacuum(self, keep: int = 10) -> list[str]:
        """Deletes the data that versions older than the last ``keep`` alone read, and unfinished tries."""
        known = self.entries()
        if not known:
            return []
        needed = {e.folder for v in [e.version for e in known[-keep:]] for e in self._read_set(v, known)}
        gone = []
        for status in self._files.listStatus(self._path(f"{self.root}/data")):
            folder = f"data/{status.getPath().getName()}"
            of_old = any(e.folder == folder for e in known)
            if folder not in needed and of_old:
                self._files.delete(status.getPath(), True)
                gone.append(folder)
        return gone

    # ------------------------------------------------------------------ reading

    def _read_set(self, version: int | None, known: list[Entry] | None = None) -> list[Entry]:
        """The base that serves ``version``, if there is one, and the deltas after it."""
        known = [e for e in (known or self.entries()) if version is None or e.version <= version]
        start, base = -1, None
        for e in known:
            # A compaction holds what was there at ``upto``; a snapshot after that outranks it.
            at = e.version if e.kind == SNAPSHOT else e.upto if e.kind == COMPACT else None
            if at is not None and at >= start:
                start, base = at, e
        deltas = [e for e in known if e.kind == DELTA and e.version > start]
        return ([base] if base else []) + deltas

    def read(self, version: int | None = None) -> DataFrame | None:
        """Rows by key as of ``version`` (default: the latest); None before the first commit."""
        chosen = self._read_set(version)
        if not chosen:
            return None
        base = [e for e in chosen if e.kind != DELTA]
        every = None
        for e in chosen:
            part = self.spark.read.schema(StructType.fromJson(json.loads(e.schema))).parquet(f"{self.root}/{e.folder}")
            part = part.withColumn("_version", F.lit(e.upto if e.kind == COMPACT else e.version).cast("long"))
            every = part if every is None else every.unionByName(part, allowMissingColumns=True)
        if base and len(chosen) == 1:
            return every.drop("op", "_version")
        values = [c for c in every.columns if c not in (self.key, "_version")]
        last = every.groupBy(self.key).agg(F.max_by(F.struct(*values), "_version").alias("_r")).select(self.key, "_r.*")
        return last.filter(F.coalesce(F.col("op"), F.lit("upsert")) != "delete").drop("op")

    def history(self) -> DataFrame:
        """version, kind and token of every commit."""
        rows = [(e.version, e.kind, e.token) for e in self.entries()]
        return self.spark.createDataFrame(rows, "version bigint, kind string, token string")


def stream_upserts(batches: DataFrame, root: str, checkpoint: str, key: str = "id", writer: str = "stream", compact_every: int = 0, **options) -> StreamingQuery:
    """Each epoch of a stream of operations (``op``, ``batch_id``, ``seq``) as one version.

    A replayed epoch adds nothing. With ``compact_every``, every so many epochs are compacted after
    their commit.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        kept = VersionedTable(batch.sparkSession, root, key)
        kept.apply(batch, f"{writer}-{epoch}")
        if compact_every and epoch % compact_every == compact_every - 1:
            kept.compact()

    return _start(batches, commit, checkpoint, **options)


def stream_snapshots(updates: DataFrame, root: str, checkpoint: str, key: str = "player", writer: str = "sync", **options) -> StreamingQuery:
    """The latest snapshot (``batch_id``) of each epoch replaces the table, as one version.

    A snapshot of nobody comes as a row whose ``key`` is null; an epoch without rows changes nothing.
    """

    def commit(batch: DataFrame, epoch: int) -> None:
        last = batch.agg(F.max("batch_id").alias("b")).first()["b"]
        if last is not None:
            rows = batch.filter((F.col("batch_id") == last) & F.col(key).isNotNull())
            VersionedTable(batch.sparkSession, root, key).replace(rows, f"{writer}-{epoch}")

    return _start(updates, commit, checkpoint, **options)


def _start(stream: DataFrame, commit, checkpoint: str, **options) -> StreamingQuery:
    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(options or {"availableNow": True})).start()
