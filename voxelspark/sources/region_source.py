"""Region files as a Spark data source, so that a scan plans, prunes and seeks.

    spark.dataSource.register(RegionFiles)
    spark.read.format("region_files").option("content", "chunks").load(world)

``content`` chooses what a scan returns:

* ``files``: one row a region file, empty ones too;
* ``slots``: one row a stored chunk, from the 8 KiB header alone;
* ``chunks`` (default): voxels, sections and errors, as :func:`regions.decode_chunks` gives them.

A scan is planned by file and range of header slots: a file of more than ``split`` bytes (option,
4 MiB) is read by several tasks, each of which reads the header, seeks to its own chunks and
decodes one chunk at a time. Filters on ``dimension``, ``region_x``, ``region_z``, ``chunk_x`` and
``chunk_z`` leave out files and slot ranges before anything is opened. (Spark applies the filters
again to the rows.)

``directories`` (JSON, folder below the root to dimension) names the folders to read; without it
every folder that holds region files is one, and its path below the root is its dimension.
Paths go through the file systems of Arrow, so a store is listed and read by range as a disk is.
A missing root has no rows; a short file, an unreadable header or chunk is an error row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual
from pyspark.sql.pandas.types import from_arrow_schema
from pyspark.sql.types import StructType

from ..functions.grid import REGION_CHUNKS
from . import regions, tagged

SPLIT = 4 << 20
SLOTS_SCHEMA = pa.schema(
    [("dimension", pa.string())]
    + [(n, pa.int32()) for n in ("region_x", "region_z", "chunk_x", "chunk_z", "slot", "sector", "sectors")]
    + [("stamp", pa.int64()), ("mtime", pa.int64()), ("error", pa.string())]
)
FILES_SCHEMA = pa.schema(
    [("dimension", pa.string()), ("path", pa.string()), ("region_x", pa.int32()), ("region_z", pa.int32()), ("size", pa.int64()), ("mtime", pa.int64())]
)
CHUNKS_SCHEMA = pa.schema([f for f in regions.DECODED][:2] + [("region_x", pa.int32()), ("region_z", pa.int32())] + [f for f in regions.DECODED][2:])
SCHEMAS = {"files": FILES_SCHEMA, "slots": SLOTS_SCHEMA, "chunks": CHUNKS_SCHEMA}


@dataclass
class SlotRange(InputPartition):
    """Slots ``first`` to ``last`` (exclusive) of one region file."""

    path: str
    dimension: str
    region_x: int
    region_z: int
    size: int
    mtime: int
    first: int
    last: int


@dataclass
class FileList(InputPartition):
    rows: list


def _store(root: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(root if "://" in root or root.startswith("file:") else f"file://{root}")


class RegionReader(DataSourceReader):
    def __init__(self, options: dict[str, str], content: str):
        self.root = options["path"].rstrip("/")
        self.content = content
        self.split = int(options.get("split", SPLIT))
        given = options.get("directories")
        self.directories = None if given is None else {k.strip("/"): v for k, v in json.loads(given).items()}
        self.bounds: dict[str, list] = {}
        self.names: set[str] | None = None

    # ------------------------------------------------------------------ planning

    def pushFilters(self, filters):
        """Narrows what is planned; every filter also stays with Spark, for the rows."""
        for f in filters:
            column = f.attribute[0] if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            if column == "dimension" and isinstance(f, (EqualTo, In)):
                names = set(f.value) if isinstance(f, In) else {f.value}
                self.names = names if self.names is None else self.names & names
            elif column in ("region_x", "region_z", "chunk_x", "chunk_z"):
                low, high = self.bounds.get(column, [-(1 << 31), (1 << 31) - 1])
                if isinstance(f, EqualTo):
                    low, high = max(low, f.value), min(high, f.value)
                elif isinstance(f, In):
                    low, high = max(low, min(f.value)), min(high, max(f.value))
                elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    low = max(low, f.value + isinstance(f, GreaterThan))
                elif isinstance(f, (LessThan, LessThanOrEqual)):
                    high = min(high, f.value - isinstance(f, LessThan))
                self.bounds[column] = [low, high]
            yield f

    def _meets(self, column: str, low: int, high: int) -> bool:
        a, b = self.bounds.get(column, (low, high))
        return a <= high and low <= b

    def files(self) -> list[tuple]:
        """(path, dimension, region_x, region_z, size, mtime) of the files that may hold wanted rows."""
        store, root = _store(self.root)
        root = root.rstrip("/")
        if store.get_file_info(root).type != pafs.FileType.Directory:
            return []
        folders = [root] if self.directories is None else [f"{root}/{d}" if d else root for d in self.directories]
        found = []
        for folder in folders:
            chosen = pafs.FileSelector(folder, allow_not_found=True, recursive=self.directories is None)
            for info in store.get_file_info(chosen):
                name = re.search("/" + regions.FILE_NAME, info.path)
                if info.type != pafs.FileType.File or not name:
                    continue
                below = info.path[len(root) :].strip("/").rpartition("/")[0]
                dimension = below if self.directories is None else self.directories[below]
                x, z = int(name[1]), int(name[2])
                n = REGION_CHUNKS
                inside = self._meets("region_x", x, x) and self._meets("region_z", z, z)
                inside = inside and self._meets("chunk_x", x * n, x * n + n - 1) and self._meets("chunk_z", z * n, z * n + n - 1)
                if inside and (self.names is None or dimension in self.names):
                    found.append((info.path, dimension, x, z, info.size, int((info.mtime_ns or 0) // 1_000_000)))
        return sorted(found)

    def partitions(self):
        files = self.files()
        if self.content == "files":
            return [FileList(files[i : i + 10_000]) for i in range(0, len(files), 10_000)] or [FileList([])]
        out = []
        for f in files:
            if not f[4]:
                continue  # an empty file holds no chunks
            parts = 1 if self.content == "slots" or f[4] < regions.HEADER else max(1, min(REGION_CHUNKS, -(-f[4] // self.split)))
            # A row of slots is one chunk_z; ranges are whole rows, so chunk_z prunes them.
            edges = [REGION_CHUNKS * i // parts for i in range(parts + 1)]
            for a, b in zip(edges[:-1], edges[1:]):
                z = f[3] * REGION_CHUNKS
                if a == 0 and f[4] < regions.HEADER or self._meets("chunk_z", z + a, z + b - 1):
                    out.append(SlotRange(*f, a * REGION_CHUNKS, b * REGION_CHUNKS))
        return out or [FileList([])]

    # ------------------------------------------------------------------ reading

    def read(self, partition) -> Iterator[pa.RecordBatch]:
        if isinstance(partition, FileList):
            if self.content == "files" and partition.rows:
                columns = list(zip(*[(d, p, x, z, size, time) for p, d, x, z, size, time in partition.rows]))
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, FILES_SCHEMA)], schema=FILES_SCHEMA)
            return
        store, _ = _store(self.root)
        corner = (partition.region_x * REGION_CHUNKS, partition.region_z * REGION_CHUNKS)
        try:
            file = store.open_input_file(partition.path)
        except OSError as fault:  # gone since the listing
            yield from self._error(partition, *corner, f"cannot open: {fault}")
            return
        with file:
            size = file.size()
            if size < regions.HEADER:
                if partition.first == 0 and size:
                    yield from self._error(partition, *corner, "file too short for a header")
                return
            head = file.read_at(regions.HEADER, 0)
            number = lambda at, n: int.from_bytes(head[at : at + n], "big")
            slots = []
            for slot in range(partition.first, partition.last):
                sector, sectors = number(slot * 4, 3), number(slot * 4 + 3, 1)
                if sector and sectors:
                    slots.append((slot, sector, sectors, number(regions.SECTOR + slot * 4, 4)))
            if self.content == "slots":
                yield from self._slots(partition, slots)
                return
            # In the order of the file, so that reads run forward.
            for slot, sector, sectors, _ in sorted(slots, key=lambda s: s[1]):
                cx, cz = corner[0] + slot % REGION_CHUNKS, corner[1] + slot // REGION_CHUNKS
                if self._meets("chunk_x", cx, cx) and self._meets("chunk_z", cz, cz):
                    yield from self._chunk(partition, store, file, size, sector, sectors, cx, cz)

    def _chunk(self, partition, store, file, size: int, sector: int, sectors: int, cx: int, cz: int):
        try:
            at = sector * regions.SECTOR
            if at < regions.HEADER or at + sectors * regions.SECTOR > size + regions.SECTOR:
                raise ValueError("sectors outside the file")
            lead = file.read_at(5, at)
            length, scheme = int.from_bytes(lead[:4], "big"), lead[4] if len(lead) == 5 else 0
            if not 1 <= length <= regions.MAX_PAYLOAD:
                raise ValueError("implausible payload length")
            if at + 4 + length > size:
                raise ValueError("payload runs past the end")
            if scheme & regions.EXTERNAL_FLAG:
                body = self._external(partition, store, cx, cz)
            else:
                body = file.read_at(length - 1, at + 5)
            data = regions._inflate(scheme & (regions.EXTERNAL_FLAG - 1), body)
            parts = regions.decode_document(tagged.parse(data))
        except Exception as fault:  # recorded per chunk, never fatal to the job
            yield from self._error(partition, cx, cz, str(fault))
            return
        for part in parts:
            yield self._placed(partition, regions._rows(part, partition.dimension, cx, cz))

    def _external(self, partition, store, cx: int, cz: int) -> bytes:
        path = f"{partition.path.rpartition('/')[0]}/c.{cx}.{cz}.mcc"
        info = store.get_file_info(path)
        if info.type != pafs.FileType.File:
            raise ValueError("external file missing")
        if info.size > regions.MAX_PAYLOAD:
            raise ValueError("implausible payload length")
        with store.open_input_file(path) as far:
            return far.read()

    def _error(self, partition, cx: int, cz: int, text: str):
        if self.content == "chunks":
            yield self._placed(partition, regions._rows({"kind": "error", "error": text}, partition.dimension, cx, cz))
        else:
            row = (partition.dimension, partition.region_x, partition.region_z, cx, cz, None, None, None, None, partition.mtime, text)
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip(row, SLOTS_SCHEMA)], schema=SLOTS_SCHEMA)

    def _placed(self, partition, rows: pa.RecordBatch) -> pa.RecordBatch:
        extra = [pa.repeat(pa.scalar(v, pa.int32()), rows.num_rows) for v in (partition.region_x, partition.region_z)]
        return pa.RecordBatch.from_arrays(rows.columns[:2] + extra + rows.columns[2:], schema=CHUNKS_SCHEMA)

    def _slots(self, partition, slots: list[tuple]):
        if not slots:
            return
        slot, sector, sectors, stamp = zip(*slots)
        n, p = REGION_CHUNKS, partition
        same = lambda v: [v] * len(slot)
        columns = (
            same(p.dimension), same(p.region_x), same(p.region_z), [p.region_x * n + s % n for s in slot], [p.region_z * n + s // n for s in slot],
            slot, sector, sectors, stamp, same(p.mtime), same(None),
        )
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, SLOTS_SCHEMA)], schema=SLOTS_SCHEMA)


class RegionFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "region_files"

    def schema(self) -> StructType:
        return from_arrow_schema(SCHEMAS[self._content()])

    def reader(self, schema) -> RegionReader:
        return RegionReader(dict(self.options), self._content())

    def _content(self) -> str:
        content = self.options.get("content", "chunks")
        if content not in SCHEMAS:
            raise ValueError(f"content is one of {', '.join(SCHEMAS)}")
        return content


def read_world(spark: SparkSession, path: str, content: str = "chunks", directories: dict[str, str] | None = None, split: int = SPLIT) -> DataFrame:
    """A scan of the world at ``path``; see the module. Turns filter pushdown of Python data
    sources on for the session, without which Spark refuses a reader that prunes."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RegionFiles)
    reader = spark.read.format("region_files").option("content", content).option("split", str(split))
    if directories is not None:
        reader = reader.option("directories", json.dumps(directories))
    return reader.load(path)
