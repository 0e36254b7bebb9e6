"""Region file bytes for fixtures: encodes voxel rows the way game worlds store them.

Only tests and checks use it; the library reads region files and never writes them.
"""

from __future__ import annotations

import gzip
import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPE = {"byte": 1, "short": 2, "int": 3, "long": 4, "bytes": 7, "str": 8, "list": 9, "dict": 10, "ints": 11, "longs": 12}


def _text(s: str) -> bytes:
    raw = s.encode()
    return struct.pack(">H", len(raw)) + raw


def _payload(v) -> tuple[int, bytes]:
    if isinstance(v, dict):
        body = b"".join(bytes([t]) + _text(k) + b for k, (t, b) in ((k, _payload(x)) for k, x in v.items()))
        return TYPE["dict"], body + b"\0"
    if isinstance(v, str):
        return TYPE["str"], _text(v)
    if isinstance(v, bytes):
        return TYPE["bytes"], struct.pack(">i", len(v)) + v
    if isinstance(v, np.ndarray):
        kind = "longs" if v.dtype.itemsize == 8 else "ints"
        return TYPE[kind], struct.pack(">i", len(v)) + v.astype(">i8" if kind == "longs" else ">i4").tobytes()
    if isinstance(v, list):
        items = [_payload(x) for x in v]
        return TYPE["list"], bytes([items[0][0] if items else 0]) + struct.pack(">i", len(items)) + b"".join(b for _, b in items)
    return TYPE["int"], struct.pack(">i", int(v))


def document(root: dict) -> bytes:
    return bytes([TYPE["dict"]]) + _text("") + _payload(root)[1]


def pack(index: np.ndarray, entries: int, least: int = 4, crossing: bool = False) -> np.ndarray:
    """Palette indices as a long array, aligned to longs or running across them."""
    bits = max(least, max(1, (entries - 1).bit_length()))
    if crossing:
        total = 0
        for i, v in enumerate(index):
            total |= int(v) << (i * bits)
        words = -(-len(index) * bits // 64)
        return np.array([(total >> (64 * n)) & (2**64 - 1) for n in range(words)], dtype=np.uint64).astype(np.int64)
    per = 64 // bits
    padded = np.concatenate([index, np.zeros(-len(index) % per, np.int64)]).astype(np.uint64).reshape(-1, per)
    return (padded << (np.arange(per, dtype=np.uint64) * np.uint64(bits))).sum(axis=1, dtype=np.uint64).view(np.int64)


def nibbles(cube: np.ndarray) -> bytes:
    flat = cube.reshape(-1)
    return bytes((flat[0::2] | (flat[1::2] << 4)).astype(np.uint8))


def chunk_document(v: pd.DataFrame, version: int = 3465) -> bytes:
    """One chunk from its voxels: columns x, y, z (block), name, biome, sky, torch."""
    sections = []
    for sy, part in v.groupby(v["y"] // 16):
        names = ["minecraft:air", *sorted(part["name"].unique())]
        at = {n: i for i, n in enumerate(names)}
        cube = np.zeros((16, 16, 16), np.int64)
        spot = (part["y"] % 16, part["z"] % 16, part["x"] % 16)
        cube[spot] = part["name"].map(at)
        biomes = sorted(v["biome"].unique())
        cells = np.zeros((4, 4, 4), np.int64)
        cells[part["y"] % 16 // 4, part["z"] % 16 // 4, part["x"] % 16 // 4] = part["biome"].map({b: i for i, b in enumerate(biomes)})
        palette = {"palette": biomes} if len(biomes) == 1 else {"palette": biomes, "data": pack(cells.reshape(-1), len(biomes), 1)}
        sections.append(
            {
                "Y": int(sy),
                "block_states": {"palette": [{"Name": n} for n in names], "data": pack(cube.reshape(-1), len(names))},
                "biomes": palette,
            }
        )
    return document({"DataVersion": version, "Status": "minecraft:full", "sections": sections})


def _lights(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """Block and sky levels of a section by (y, z, x), both from positions alone."""
    y, z, x = np.indices((16, 16, 16))
    return (x * 3 + y * 5 + z * 7 + seed) % 16, (x + y * 11 + z * 2 + seed) % 16


def old_document(v: pd.DataFrame, version: int = 2230) -> bytes:
    """One chunk of the older layout: a wrapping level, entries across longs, ids of biomes in
    one flat array of columns (here plains and swamp by column), light arrays."""
    sections = []
    for sy, part in v.groupby(v["y"] // 16):
        names = ["minecraft:air", *sorted(part["name"].unique())]
        at = {n: i for i, n in enumerate(names)}
        cube = np.zeros((16, 16, 16), np.int64)
        cube[part["y"] % 16, part["z"] % 16, part["x"] % 16] = part["name"].map(at)
        block, sky = _lights(int(sy))
        sections.append({"Y": int(sy), "Palette": [{"Name": n} for n in names], "BlockStates": pack(cube.reshape(-1), len(names), 1, crossing=True), "BlockLight": nibbles(block), "SkyLight": nibbles(sky)})
    z, x = np.indices((16, 16))
    biomes = np.where((x + z) % 3 == 0, 6, 1).astype(np.uint8).tobytes()
    return document({"DataVersion": version, "Level": {"Status": "full", "Biomes": biomes, "Sections": sections}})


def lit_document(v: pd.DataFrame, version: int = 3465) -> bytes:
    """A chunk of the present layout with sky light only."""
    sections = []
    for sy, part in v.groupby(v["y"] // 16):
        names = ["minecraft:air", *sorted(part["name"].unique())]
        at = {n: i for i, n in enumerate(names)}
        cube = np.zeros((16, 16, 16), np.int64)
        cube[part["y"] % 16, part["z"] % 16, part["x"] % 16] = part["name"].map(at)
        states = {"palette": [{"Name": n} for n in names], "data": pack(cube.reshape(-1), len(names))}
        sections.append({"Y": int(sy), "block_states": states, "biomes": {"palette": ["minecraft:desert"]}, "SkyLight": nibbles(_lights(int(sy))[1])})
    return document({"DataVersion": version, "Status": "minecraft:full", "sections": sections})


def region_file(chunks: dict[tuple[int, int], bytes], schemes: dict | None = None, stamp: int = 1_700_000_000) -> bytes:
    """A whole region file from chunk documents keyed by chunk position."""
    head, body, sector = bytearray(8192), [], 2
    for (cx, cz), doc in chunks.items():
        scheme = (schemes or {}).get((cx, cz), 2)
        packed = {1: gzip.compress, 2: zlib.compress}.get(scheme & 0x7F, bytes)(doc)
        entry = struct.pack(">IB", len(packed) + 1, scheme) + packed
        entry += b"\0" * (-len(entry) % 4096)
        slot = cx % 32 + cz % 32 * 32
        struct.pack_into(">I", head, slot * 4, sector << 8 | len(entry) // 4096)
        struct.pack_into(">I", head, 4096 + slot * 4, stamp + slot)
        body.append(entry)
        sector += len(entry) // 4096
    return bytes(head) + b"".join(body)


def region_table(voxels: DataFrame, palette: DataFrame, biomes: DataFrame) -> DataFrame:
    """Region files of a voxel table as rows ``dimension, path, size, content``.

    Chunks are encoded one by one; a region joins at most 1 024 of them.
    """
    named = voxels.join(palette.select(F.col("id").alias("block_id"), "name"), "block_id").join(
        biomes.select(F.col("id").alias("biome_id"), F.col("name").alias("biome")), "biome_id"
    )
    keyed = named.select(
        "dimension", F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz"), "x", "y", "z", "name", "biome"
    )

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"dimension": [key[0]], "cx": [key[1]], "cz": [key[2]], "doc": [chunk_document(pdf)]})

    docs = keyed.groupBy("dimension", "cx", "cz").applyInPandas(encode, "dimension string, cx int, cz int, doc binary")
    docs = docs.withColumns({"rx": F.shiftright("cx", 5), "rz": F.shiftright("cz", 5)})

    def join(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        # One chunk in eight is stored with gzip instead.
        pdf = pdf.sort_values(["cx", "cz"])
        spots = list(zip(pdf["cx"], pdf["cz"]))
        data = region_file(dict(zip(spots, pdf["doc"])), {s: 1 for s in spots if (s[0] * 3 + s[1]) % 8 == 0})
        return pd.DataFrame({"dimension": [key[0]], "path": [f"w/region/r.{key[1]}.{key[2]}.mca"], "size": [len(data)], "content": [data]})

    return docs.groupBy("dimension", "rx", "rz").applyInPandas(join, "dimension string, path string, size bigint, content binary")


def write_world(voxels: DataFrame, palette: DataFrame, path: str) -> None:
    """Region files of a voxel table under ``path``, written by the tasks that encode them.

    Chunks by (chunk_x + 2 chunk_z) mod 5: 0 to 2 of the present layout, 3 of the old one, 4 with
    a payload cut short. Every region also leaves a file of another name, an empty region file
    and one shorter than a header, 100 and 200 regions away in x.
    """
    from voxelspark.sources.region_source import _store

    named = voxels.join(palette.select(F.col("id").alias("block_id"), "name"), "block_id")
    keyed = named.select("dimension", F.shiftright("x", 4).alias("cx"), F.shiftright("z", 4).alias("cz"), "x", "y", "z", "name")

    def encode(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        kind = (key[1] + 2 * key[2]) % 5
        doc = old_document(pdf) if kind == 3 else lit_document(pdf)
        return pd.DataFrame({"dimension": [key[0]], "cx": [key[1]], "cz": [key[2]], "doc": [doc[: len(doc) // 2] if kind == 4 else doc]})

    docs = keyed.groupBy("dimension", "cx", "cz").applyInPandas(encode, "dimension string, cx int, cz int, doc binary")
    docs = docs.withColumns({"rx": F.shiftright("cx", 5), "rz": F.shiftright("cz", 5)})

    def save(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        store, root = _store(path)
        folder = f"{root}/{key[0].replace(':', '/')}/region"
        store.create_dir(folder, recursive=True)
        chunks = dict(zip(zip(pdf["cx"], pdf["cz"]), pdf["doc"]))
        data = region_file(chunks, {s: (1, 2, 3)[(s[0] + s[1]) % 3] for s in chunks})
        x, z = key[1], key[2]
        for name, body in ((f"r.{x}.{z}.mca", data), (f"r.{x + 100}.{z}.mca", b""), (f"r.{x + 200}.{z}.mca", b"short"), (f"notes.{x}.{z}.txt", b"-")):
            with store.open_output_stream(f"{folder}/{name}") as out:
                out.write(body)
        return pd.DataFrame({"bytes": [len(data)]})

    docs.groupBy("dimension", "rx", "rz").applyInPandas(save, "bytes long").agg(F.sum("bytes")).collect()
