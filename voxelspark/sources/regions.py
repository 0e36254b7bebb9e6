"""Region files: catalogue, header slots, chunk payloads and decoded voxels.

Spark does the splitting: headers and payloads are sliced with SQL expressions, so a
large region file becomes many small rows before any Python runs, and each chunk is
decoded by an independent call. A bad chunk yields an error row and nothing else.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from ..functions.grid import REGION_CHUNKS
from ..functions.names import AIR, DEFAULT_NAMESPACE, LEGACY_BIOMES, PLAINS, USABLE_STATUS
from . import tagged

# Fixed values of the file format.
FILE_NAME = r"r\.(-?\d+)\.(-?\d+)\.mca$"
EXTERNAL_NAME = r"c\.(-?\d+)\.(-?\d+)\.mcc$"
SECTOR = 4096
HEADER = 8192
SLOTS = 1024
MAX_PAYLOAD = 32 << 20
MAX_INFLATED = 64 << 20
EXTERNAL_FLAG = 0x80
ALIGNED_SINCE = 2529  # first data version whose entries do not cross longs


def _read(spark: SparkSession, path: str, pattern: str) -> DataFrame:
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", "true")
        .load(path)
        .withColumnsRenamed({"modificationTime": "mtime", "length": "size"})
    )


def with_region(files: DataFrame) -> DataFrame:
    """Region coordinates from the file name; other files are left out."""
    part = lambda n: F.regexp_extract("path", FILE_NAME, n).cast("int")
    named = files.filter(F.col("path").rlike(FILE_NAME))
    return named.withColumns({"region_x": part(1), "region_z": part(2)})


def list_regions(spark: SparkSession, path: str) -> DataFrame:
    """Catalogue without contents: ``path, mtime, size, region_x, region_z``.

    The file source leaves out empty files; they hold no chunks.
    """
    return with_region(_read(spark, path, "r.*.mca").drop("content"))


def read_regions(spark: SparkSession, path: str) -> DataFrame:
    return with_region(_read(spark, path, "r.*.mca"))


def read_external(spark: SparkSession, path: str) -> DataFrame:
    """Oversized chunks stored in files of their own: ``chunk_x, chunk_z, content``."""
    part = lambda n: F.regexp_extract("path", EXTERNAL_NAME, n).cast("int")
    return _read(spark, path, "c.*.mcc").select("path", part(1).alias("chunk_x"), part(2).alias("chunk_z"), "content")


def _number(content, at, size: int) -> Column:
    return F.conv(F.hex(F.substring(content, at, F.lit(size))), 16, 10).cast("long")


def header_slots(regions: DataFrame) -> DataFrame:
    """One row per present chunk slot: sector offset and count, and time stamp.

    Empty files have no slots; shorter than a header is an error row.
    """
    head = F.substring("content", 1, HEADER)
    keep = [c for c in regions.columns if c != "content"]
    rows = regions.filter(F.col("size") > 0).select(*keep, head.alias("_head"))
    slot = lambda i: F.struct(
        i.alias("slot"),
        _number(F.col("_head"), i * 4 + 1, 3).cast("int").alias("sector"),
        _number(F.col("_head"), i * 4 + 4, 1).cast("int").alias("sectors"),
        _number(F.col("_head"), i * 4 + SECTOR + 1, 4).alias("stamp"),
    )
    every = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), slot), lambda s: (s["sector"] != 0) & (s["sectors"] != 0)
    )
    good = rows.filter(F.length("_head") == HEADER).select(*keep, F.explode(every).alias("_s"))
    n = REGION_CHUNKS
    good = good.select(*keep, "_s.*").withColumns(
        {
            "chunk_x": F.col("region_x") * n + F.pmod("slot", F.lit(n)),
            "chunk_z": F.col("region_z") * n + F.floor(F.col("slot") / n).cast("int"),
            "error": F.lit(None).cast("string"),
        }
    )
    short = rows.filter(F.length("_head") < HEADER).select(*keep, F.lit("file too short for a header").alias("error"))
    return good.unionByName(short, allowMissingColumns=True)


def chunk_payloads(regions: DataFrame, external: DataFrame | None = None) -> DataFrame:
    """Compressed chunk documents, or the reason why one cannot be read.

    Slices are taken inside one projection, so file contents are never repeated. A file
    shorter than a header is one error row at its region's first chunk.
    """
    content, size = F.col("content"), F.col("size")
    start = lambda s: s["sector"].cast("long") * SECTOR
    keep = [c for c in ("dimension", "region_x", "region_z", "path") if c in regions.columns]

    def entry(i: Column) -> Column:
        return F.struct(
            i.alias("slot"),
            _number(content, i * 4 + 1, 3).cast("int").alias("sector"),
            _number(content, i * 4 + 4, 1).cast("int").alias("sectors"),
        )

    def located(s: Column) -> Column:
        outside = (start(s) < HEADER) | (start(s) + s["sectors"] * SECTOR > size + SECTOR)
        at = (start(s) + 1).cast("int")
        return F.struct(
            s["slot"].alias("slot"),
            at.alias("at"),
            F.when(outside, F.lit("sectors outside the file")).alias("error"),
            F.when(~outside, F.coalesce(_number(content, at, 4), F.lit(0))).alias("length"),
            F.when(~outside, _number(content, at + 4, 1).cast("int")).alias("scheme"),
        )

    def payload(s: Column) -> Column:
        fault = (
            F.when(s["error"].isNotNull(), s["error"])
            .when((s["length"] < 1) | (s["length"] > MAX_PAYLOAD), F.lit("implausible payload length"))
            .when(s["at"] + 4 + s["length"] - 1 > size, F.lit("payload runs past the end"))
        )
        body = F.substring(content, s["at"] + 5, (s["length"] - 1).cast("int"))
        return F.struct(
            s["slot"].alias("slot"), s["scheme"].alias("scheme"), fault.alias("error"), F.when(fault.isNull(), body).alias("payload")
        )

    present = F.filter(
        F.transform(F.sequence(F.lit(0), F.lit(SLOTS - 1)), entry), lambda s: (s["sector"] != 0) & (s["sectors"] != 0)
    )
    whole = regions.filter(size >= HEADER)
    rows = whole.select(*keep, F.transform(F.transform(present, located), payload).alias("_c"))
    n = REGION_CHUNKS
    rows = rows.select(*keep, F.explode("_c").alias("_s")).select(*keep, "_s.*").withColumns(
        {
            "chunk_x": F.col("region_x") * n + F.pmod("slot", F.lit(n)),
            "chunk_z": F.col("region_z") * n + F.floor(F.col("slot") / n).cast("int"),
        }
    )
    short = regions.filter((size > 0) & (size < HEADER)).select(
        *keep, (F.col("region_x") * n).alias("chunk_x"), (F.col("region_z") * n).alias("chunk_z"), F.lit("file too short for a header").alias("error")
    )
    rows = rows.unionByName(short, allowMissingColumns=True)
    apart = F.coalesce(F.col("scheme").bitwiseAND(F.lit(EXTERNAL_FLAG)) != 0, F.lit(False))
    if external is not None:
        on = [c for c in ("dimension", "chunk_x", "chunk_z") if c in external.columns]
        rows = rows.join(external.select(*on, F.col("content").alias("_far")), on, "left")
        rows = rows.withColumns(
            {
                "error": F.when(F.col("error").isNotNull() | ~apart, F.col("error"))
                .when(F.col("_far").isNull(), F.lit("external file missing"))
                .when(F.length("_far") > MAX_PAYLOAD, F.lit("implausible payload length")),
                "payload": F.when(apart, F.col("_far")).otherwise(F.col("payload")),
            }
        ).drop("_far")
    else:
        rows = rows.withColumn("error", F.when(F.col("error").isNull() & apart, F.lit("external file missing")).otherwise(F.col("error")))
    return rows.withColumn("scheme", F.col("scheme").bitwiseAND(F.lit(EXTERNAL_FLAG - 1)))


DECODED = pa.schema(
    [(n, pa.string()) for n in ("kind", "dimension")]
    + [(n, pa.int32()) for n in ("chunk_x", "chunk_z", "section_y", "x", "y", "z")]
    + [("block", pa.string()), ("waterlogged", pa.bool_())]
    + [(n, pa.int32()) for n in ("light", "light_above", "block_light_above")]
    + [("biome", pa.string()), ("error", pa.string())]
)


def _inflate(scheme: int, payload: bytes) -> bytes:
    if scheme in (1, 2):
        d = zlib.decompressobj(31 if scheme == 1 else 15)
        data = d.decompress(payload, MAX_INFLATED + 1)
        if len(data) > MAX_INFLATED:
            raise ValueError("chunk inflates beyond the limit")
        if not d.eof:
            raise ValueError("compressed chunk ends early")
        return data
    if scheme == 3:
        return payload
    raise ValueError(f"unsupported compression {scheme}")


def unpack(longs: np.ndarray, bits: int, count: int, crossing: bool) -> np.ndarray:
    """``count`` fixed-width entries of a long array; missing ones are 0."""
    words = np.asarray(longs).astype(np.uint64)
    mask = np.uint64((1 << bits) - 1)
    index = np.arange(count, dtype=np.int64)
    if crossing:
        bit = index * bits
        word, shift = bit >> 6, (bit & 63).astype(np.uint64)
    else:
        per = 64 // bits
        word, shift = index // per, ((index % per) * bits).astype(np.uint64)
    padded = np.concatenate([words, np.zeros(max(0, int(word.max()) + 2 - len(words)), np.uint64)])
    out = padded[word] >> shift
    if crossing:
        spill = shift.astype(np.int64) + bits > 64
        left = np.where(spill, np.uint64(64) - shift, np.uint64(0))
        out = np.where(spill, out | (padded[word + 1] << left), out)
    return (out & mask).astype(np.int64)


def _width(entries: int) -> int:
    return max(1, (entries - 1).bit_length())


def _nibbles(data) -> np.ndarray | None:
    """4-bit levels in (y, z, x) order, None when the array is missing or short."""
    if not isinstance(data, bytes) or len(data) < 2048:
        return None
    raw = np.frombuffer(data[:2048], np.uint8)
    return np.stack([raw & 15, raw >> 4], axis=1).reshape(16, 16, 16).astype(np.int32)


def _name(entry) -> str:
    text = entry if isinstance(entry, str) else (entry.get("Name") or "" if isinstance(entry, dict) else "")
    text = text.strip().lower().split("[")[0]
    if not text:
        return AIR
    return text if ":" in text else f"{DEFAULT_NAMESPACE}:{text}"


def _section_biomes(section: dict) -> np.ndarray | None:
    box = section.get("biomes")
    palette = box.get("palette") if isinstance(box, dict) else None
    if not palette:
        return None
    names = np.array([_name(p) if isinstance(p, str) else PLAINS for p in palette], dtype=object)
    data = box.get("data")
    if len(names) == 1 or data is None or len(data) == 0:
        cells = np.zeros(64, np.int64)
    else:
        cells = unpack(data, _width(len(names)), 64, False)
    cube = np.where(cells < len(names), cells, 0).reshape(4, 4, 4)
    return names[cube.repeat(4, 0).repeat(4, 1).repeat(4, 2)]


def _legacy_biomes(raw, lowest: int, y: np.ndarray, z: np.ndarray, x: np.ndarray) -> np.ndarray | None:
    """Biome names from a chunk-wide id array, flat or in 4-block cells."""
    if raw is None or isinstance(raw, (str, dict, list)) or len(raw) == 0:
        return None
    ids = np.frombuffer(raw, np.uint8) if isinstance(raw, bytes) else np.asarray(raw)
    cells = not isinstance(raw, bytes) and len(ids) >= 1024
    at = np.clip((y - lowest * 16) >> 2, 0, 63) * 16 + (z >> 2) * 4 + (x >> 2) if cells else z * 16 + x
    known = at < len(ids)
    numbers = ids[np.where(known, at, 0)]
    table = {int(n): f"{DEFAULT_NAMESPACE}:{LEGACY_BIOMES.get(int(n), 'plains')}" for n in np.unique(numbers)}
    return np.array([table[int(n)] for n in numbers], dtype=object)


def _section_voxels(section: dict, crossing: bool) -> dict | None:
    """Block names, light and flags of the non-air voxels of one section."""
    box = section.get("block_states")
    if isinstance(box, dict):
        palette, data = box.get("palette"), box.get("data")
    else:
        palette, data = section.get("Palette"), section.get("BlockStates")
    if not palette:
        return None
    names = np.array([_name(p) for p in palette], dtype=object)
    soaked = np.array([isinstance(p, dict) and (p.get("Properties") or {}).get("waterlogged") == "true" for p in palette])
    if len(names) == 1 or data is None or len(data) == 0:
        index = np.zeros(4096, np.int64)
    else:
        bits = _width(len(names)) if crossing else max(4, _width(len(names)))
        index = unpack(data, bits, 4096, crossing)
    known = index < len(names)
    index = np.where(known, index, 0)
    solid = (known & (names[index] != AIR)).reshape(16, 16, 16)
    y, z, x = np.nonzero(solid)
    chosen = index.reshape(16, 16, 16)[y, z, x]
    block, sky = _nibbles(section.get("BlockLight")), _nibbles(section.get("SkyLight"))
    levels = [a for a in (block, sky) if a is not None]
    light = np.maximum.reduce(levels) if levels else np.full((16, 16, 16), 15, np.int32)
    up = np.minimum(y + 1, 15)
    return {
        "y": y, "z": z, "x": x, "block": names[chosen], "waterlogged": soaked[chosen], "light": light[y, z, x],
        "light_above": light[up, z, x], "block_light_above": block[up, z, x] if block is not None else np.zeros(len(y), np.int32),
    }


def decode_document(root: dict) -> list[dict]:
    """Column arrays of the sections and voxels of one chunk, in chunk-local x and z."""
    level = root.get("Level") if isinstance(root.get("Level"), dict) else root
    status = level.get("Status") or root.get("Status") or ""
    prefix = f"{DEFAULT_NAMESPACE}:"
    if str(status).removeprefix(prefix) not in USABLE_STATUS:
        return []
    crossing = int(root.get("DataVersion", 0)) < ALIGNED_SINCE
    listed = next((t[k] for t in (level, root) for k in ("sections", "Sections") if isinstance(t.get(k), list)), [])
    found = {}
    for section in listed:
        if not isinstance(section, dict) or "Y" not in section:
            continue
        try:
            voxels = _section_voxels(section, crossing)
        except (ValueError, IndexError, TypeError, AttributeError):
            continue  # one unreadable section must not cost the rest of the column
        if voxels is not None:
            found[int(section["Y"])] = (section, voxels)
    out = [{"kind": "section", "section_y": np.array(sorted(found), np.int32)}] if found else []
    for sy, (section, v) in sorted(found.items()):
        y = v["y"] + sy * 16
        cube = _section_biomes(section)
        if cube is not None:
            biome = cube[v["y"], v["z"], v["x"]]
        else:
            biome = _legacy_biomes(level.get("Biomes"), min(found), y, v["z"], v["x"])
        if biome is None:
            biome = np.full(len(y), PLAINS, dtype=object)
        out.append({"kind": "voxel", "section_y": np.full(len(y), sy, np.int32), **v, "y": y, "biome": biome})
    return out


def _rows(part: dict, dimension: str, cx: int, cz: int) -> pa.RecordBatch:
    """One output batch; constants are repeated and absent columns are NULL."""
    part = {**part, "dimension": dimension, "chunk_x": cx, "chunk_z": cz}
    if "x" in part:
        part |= {"x": part["x"] + cx * 16, "z": part["z"] + cz * 16}
    n = max((len(v) for v in part.values() if isinstance(v, np.ndarray)), default=1)
    arrays = []
    for f in DECODED:
        value = part.get(f.name)
        if isinstance(value, np.ndarray):
            arrays.append(pa.array(value, f.type))
        else:
            arrays.append(pa.repeat(pa.scalar(value, f.type), n))
    return pa.RecordBatch.from_arrays(arrays, schema=DECODED)


def _decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for row in batch.to_pylist():
            where = (row["dimension"], row["chunk_x"], row["chunk_z"])
            try:
                if row["error"] is not None:
                    raise ValueError(row["error"])
                parts = decode_document(tagged.parse(_inflate(row["scheme"], row["payload"])))
            except Exception as fault:  # recorded per chunk, never fatal to the job
                parts = [{"kind": "error", "error": str(fault)}]
            for part in parts:
                yield _rows(part, *where)


def decode_chunks(payloads: DataFrame) -> DataFrame:
    """Voxels, populated sections and errors of chunks, told apart by ``kind``.

    ``payloads`` comes from :func:`chunk_payloads`. Chunks are spread evenly first,
    so one large region file does not hold up a task.
    """
    rows = payloads.select("dimension", "chunk_x", "chunk_z", "scheme", "payload", "error")
    return rows.repartition("dimension", "chunk_x", "chunk_z").mapInArrow(_decode, from_arrow_schema(DECODED))


def write_world(decoded: DataFrame, path: str) -> None:
    """Decoded rows in one table, partitioned by region, sorted by kind and column.

    A region that is written again loses all that it held, errors too.
    """
    rows = decoded.withColumns({"region_x": F.shiftright("chunk_x", 5), "region_z": F.shiftright("chunk_z", 5)})
    (
        rows.repartition("dimension", "region_x", "region_z", F.shiftright("chunk_x", 3), F.shiftright("chunk_z", 3))
        .sortWithinPartitions("dimension", "region_x", "region_z", "kind", "x", "z", "y")
        .write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("dimension", "region_x", "region_z")
        .parquet(path)
    )


def voxel_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter("kind = 'voxel'").select(
        "dimension", "x", "y", "z", "block", "waterlogged", "light", "light_above", "block_light_above", "biome"
    )


def section_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter("kind = 'section'").select("dimension", "chunk_x", "chunk_z", "section_y")


def error_rows(decoded: DataFrame) -> DataFrame:
    return decoded.filter("kind = 'error'").select("dimension", "chunk_x", "chunk_z", "error")
