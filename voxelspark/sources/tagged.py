"""Reader of the tagged binary documents that chunk payloads hold.

Used only inside ingest tasks. Values come back as plain Python: dict, list, str,
int, float, bytes for byte arrays and numpy arrays for int and long arrays.
"""

from __future__ import annotations

import struct

import numpy as np

MAX_DEPTH = 512

# Tag numbers of the format and the layout of the fixed-size ones.
END, BYTE_ARRAY, STRING, LIST, COMPOUND, INT_ARRAY, LONG_ARRAY = 0, 7, 8, 9, 10, 11, 12
SCALARS = {1: ">b", 2: ">h", 3: ">i", 4: ">q", 5: ">f", 6: ">d"}
ARRAYS = {BYTE_ARRAY: None, INT_ARRAY: ">i4", LONG_ARRAY: ">i8"}


class Cursor:
    def __init__(self, data: bytes):
        self.data = data
        self.at = 0

    def take(self, size: int) -> bytes:
        end = self.at + size
        if size < 0 or end > len(self.data):
            raise ValueError("document ends early")
        piece = self.data[self.at : end]
        self.at = end
        return piece

    def number(self, layout: str):
        return struct.unpack(layout, self.take(struct.calcsize(layout)))[0]

    def text(self) -> str:
        return self.take(self.number(">H")).decode("utf-8", "replace")

    def value(self, tag: int, depth: int = 0):
        if depth > MAX_DEPTH:
            raise ValueError("document nests too deeply")
        if tag in SCALARS:
            return self.number(SCALARS[tag])
        if tag == STRING:
            return self.text()
        if tag in ARRAYS:
            count = self.number(">i")
            layout = ARRAYS[tag]
            if layout is None:
                return self.take(count)
            return np.frombuffer(self.take(count * np.dtype(layout).itemsize), dtype=layout)
        if tag == LIST:
            kind, count = self.number(">B"), self.number(">i")
            if count > 0 and kind == END:
                raise ValueError("list of nothing")
            return [self.value(kind, depth + 1) for _ in range(max(count, 0))]
        if tag == COMPOUND:
            out = {}
            while (kind := self.number(">B")) != END:
                name = self.text()
                out[name] = self.value(kind, depth + 1)
            return out
        raise ValueError(f"unknown tag {tag}")


def parse(data: bytes) -> dict:
    """The root compound of a document."""
    cursor = Cursor(data)
    if cursor.number(">B") != COMPOUND:
        raise ValueError("root is not a compound")
    cursor.text()
    return cursor.value(COMPOUND)
