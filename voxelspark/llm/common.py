"""Helpers shared by the operators: tables, the shared folder, folds and hashed words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The white space of every contract here, \x20 and \x09-\x0D, as a Java class.
SPACE = r"[\x20\x09-\x0D]+"
_LOCAL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a folder of this machine only where it is unset."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = _LOCAL.setdefault("folder", tempfile.mkdtemp(prefix="spark-"))
    return folder.rstrip("/")


def written(df: DataFrame) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: read again, never computed again."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/llm-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def fold(doc_id: Column | str, n: int) -> Column:
    """``crc32`` of the id as text, modulo ``n``; a null id counts as the empty text."""
    text = (F.col(doc_id) if isinstance(doc_id, str) else doc_id).cast("string")
    return (F.crc32(F.coalesce(text, F.lit("")).cast("binary")) % n).cast("int")


def chunks(values: list, sizes, limit: int):
    """Slices of ``values`` of about ``limit`` in summed size; a larger value stands alone."""
    start, total = 0, 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield slice(start, i)
            start, total = i, 0
        total += size
    if start < len(values):
        yield slice(start, len(values))


def small_batches(spark: SparkSession, rows: int = 2000) -> None:
    """At most ``rows`` rows in a batch for Python from here on. Whole texts are long: of the 10,000 rows
    that are usual, the executor and its Python workers hold several copies at once."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(name))
    if not 0 < now <= rows:
        spark.conf.set(name, str(rows))


def packed(batches, limit: int):
    """Lists of ``doc_id`` and of texts (null: empty) of about ``limit`` characters, whatever the
    batches; a longer text stands alone."""
    docs, texts, total = [], [], 0
    for b in batches:
        for at in range(0, b.num_rows, 256):
            for doc, text in zip(b["doc_id"].slice(at, 256).to_pylist(), b["text"].slice(at, 256).to_pylist()):
                text = text or ""
                if total and total + len(text) > limit:
                    yield docs, texts
                    docs, texts, total = [], [], 0
                docs.append(doc)
                texts.append(text)
                total += len(text)
    if docs:
        yield docs, texts


# ---------------------------------------------------------------------- hashed words

_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**63, 256, dtype=np.uint64) | np.uint64(1)
_POWER = np.uint64(0x9E3779B97F4A7C15)
WHITE = np.zeros(256, bool)
WHITE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
PUNCTUATION = np.zeros(256, bool)
PUNCTUATION[[b for b in range(128) if not chr(b).isalnum()]] = True


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser that spreads every bit of 64."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def encoded(texts) -> list[bytes]:
    return [b"" if t is None else t.encode("utf-8", "surrogatepass") for t in texts]


def hashed_words(texts: list[bytes], gaps: np.ndarray = WHITE, flags: np.ndarray | None = None):
    """Words of several texts at once, as 64-bit hashes of their A-Z lower-cased bytes.

    Returns ``(hashes, first)``: document ``i`` has the words ``first[i]:first[i + 1]``. With
    ``flags`` (a uint8 per byte value), also the bitwise or of the flags in each word and the
    words' lengths. Two different words share a hash with a chance of about 2**-64.
    """
    if not texts:
        empty = np.zeros(0, np.uint64)
        return (empty, np.zeros(1, np.int64)) + ((empty.astype(np.uint8), empty.astype(np.int64)) if flags is not None else ())
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    gap = gaps[raw]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], gap)).view(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    low = LOWER[raw]
    ends_of_docs = np.cumsum([len(t) + 1 for t in texts])
    first = np.concatenate(([0], np.searchsorted(starts, ends_of_docs)))
    if not len(starts):
        h = np.zeros(0, np.uint64)
        return (h, first) + ((h.astype(np.uint8), h.astype(np.int64)) if flags is not None else ())
    length = ends - starts
    place = np.arange(len(raw), dtype=np.int32)[~gap]
    place -= np.repeat(starts.astype(np.int32), length)
    powers = np.cumprod(np.full(int(length.max()), _POWER, np.uint64))
    inner = np.concatenate(([0], np.cumsum(length)[:-1]))
    h = mix(np.add.reduceat(_BYTE[low[~gap]] * powers[place], inner))
    if flags is None:
        return h, first
    return h, first, np.bitwise_or.reduceat(flags[raw[~gap]], inner), length


def hashed_batches(texts: list[bytes], gaps: np.ndarray = WHITE, flags=None, limit: int = 1 << 20):
    """``hashed_words`` in pieces of about ``limit`` bytes, each with the slice it covers."""
    for part in chunks(texts, map(len, texts), limit):
        yield part, hashed_words(texts[part], gaps, flags)
