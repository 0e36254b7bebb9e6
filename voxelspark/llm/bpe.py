"""BPE encoding and decoding through a table of distinct words.

Texts are split into words (the vocabulary's own splitting rule) in Spark, in blocks of whole
documents. A block keeps the place of every word as a number into its own list of distinct
words; the lists go, by a hash of the word, to the one task that encodes each distinct word
once. The ids come back to the block's lists and are joined to the words by place. Decoding
joins ids with the id-to-piece table: as a DataFrame join for stored ids (``decode_ids``), as a
map-side join where the vocabulary file bounds the table (about 50,000 pieces).

Shuffled are the word lists of blocks, their ids, and the blocks' places; never a row a word.
A block holds ``BLOCK`` bytes of text, or one longer document. The number of encoding buckets
follows the session's shuffle partitions. The texts are read and split once: places travel
beside the lists and pass the encoding untouched.

Nulls: a null text counts as empty and has no ids. Repeated rows are encoded as they stand.
"""

from __future__ import annotations

import hashlib
import json
import os
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import packed

BLOCK = 8 << 20
# Fixed value: the splitting rule of byte-level BPE vocabularies of this family.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@cache
def _tokenizer(path: str):
    # A task has one core; threads of its own would each keep memory.
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


@cache
def _splitter(path: str):
    """Words of a text: the special tokens whole, the rest by the pattern."""
    with open(path, encoding="utf-8") as f:
        special = [t["content"] for t in json.load(f)["added_tokens"]]
    words = regex.compile(PATTERN)
    if not special:
        return words.findall
    cut = regex.compile("(" + "|".join(map(regex.escape, sorted(special, key=len, reverse=True))) + ")")

    def split(text: str) -> list[str]:
        if not any(s in text for s in special):
            return words.findall(text)
        out: list[str] = []
        for i, part in enumerate(cut.split(text)):
            out += [part] if i % 2 else words.findall(part)
        return out

    return split


@cache
def pieces(path: str) -> list[bytes]:
    """The bytes of every id: byte-level pieces spell each byte as one printable character."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    out = [b""] * (1 + max([*data["model"]["vocab"].values(), *(t["id"] for t in data["added_tokens"])]))
    for piece, i in data["model"]["vocab"].items():
        out[i] = bytes(spelled[c] for c in piece) if all(c in spelled for c in piece) else piece.encode()
    for t in data["added_tokens"]:
        out[t["id"]] = t["content"].encode()
    return out


def encode_words(words: list[str], path: str) -> list[list[int]]:
    encode = _tokenizer(path).encode_batch
    return [e.ids for at in range(0, len(words), 4096) for e in encode(words[at : at + 4096], add_special_tokens=False)]


# ---------------------------------------------------------------- blocks and word lists


def _pack(*parts: bytes) -> bytes:
    return zstandard.ZstdCompressor(level=9).compress(b"".join(parts))


def _unpack(blob: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(blob)


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers byte by byte, all lowest bytes first: small numbers pack well."""
    return np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def _numbers_of(raw: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(4, -1).T).view("<u4").ravel()


def _blocks(path: str, buckets: int, limit: int):
    """Blocks of whole documents: one row with the places of their words (``places``), and their
    lists of distinct words, one row a bucket. A block is named after its documents, so that a
    task that runs again names it alike; frequent words have small numbers."""
    fields = [("block", pa.binary()), ("places", pa.bool_()), ("bucket", pa.int32()), ("data", pa.binary()), ("head", pa.binary())]

    def cut(docs: list, texts: list[str]) -> list[tuple]:
        split, number = _splitter(path), {}
        add = number.setdefault
        ends, every = [], []
        for t in texts:
            found = np.array([add(w, len(number)) for w in split(t)], np.uint32)
            ends.append(len(found))
            every.append(found)
        places = np.concatenate(every)
        words = [w.encode("utf-8", "surrogatepass") for w in number]
        del number, add, every
        rank = np.argsort(-np.bincount(places, minlength=len(words)), kind="stable")
        words = [words[i] for i in rank.tolist()]
        renamed = np.empty(len(words), np.uint32)
        renamed[rank] = np.arange(len(words), dtype=np.uint32)
        name = hashlib.blake2b(json.dumps(docs).encode(), digest_size=16)
        for t in texts:
            name.update(t.encode("utf-8", "surrogatepass") + b"\xff")
        name = name.digest()
        owner = np.array([zlib.crc32(w) % buckets for w in words], np.uint32)
        head = json.dumps([len(words), docs]).encode()
        at = int.from_bytes(name[:4], "little") % buckets
        rows = [(name, True, at, _pack(_planes(np.array(ends, np.uint32)), _planes(owner), _planes(renamed[places])), head)]
        order = np.argsort(owner, kind="stable")
        cuts = np.searchsorted(owner[order], np.arange(buckets + 1))
        for k in np.flatnonzero(np.diff(cuts)):
            own = [words[i] for i in order[cuts[k] : cuts[k + 1]].tolist()]
            sizes = np.array([len(w) for w in own], np.uint32).tobytes()
            rows.append((name, False, int(k), _pack(sizes, *own), len(own).to_bytes(4, "little")))
        return rows

    def run(batches):
        for docs, texts in packed(batches, limit):
            rows = cut(docs, texts)
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, (_, kind) in zip(zip(*rows), fields)], [f for f, _ in fields])

    return run


def _encoded(path: str):
    """One bucket: every distinct word of all its lists encoded once, ids back list by list.
    Rows of places pass as they are."""

    def run(frames):
        known: dict[bytes, bytes] = {}
        for pdf in frames:
            out = []
            for blob, count, places in zip(pdf.data, pdf["head"], pdf.places):
                if places:
                    out.append(blob)
                    continue
                n = int.from_bytes(count, "little")
                raw = _unpack(blob)
                edges = np.concatenate(([0], np.cumsum(np.frombuffer(raw[: 4 * n], np.uint32), dtype=np.int64))) + 4 * n
                words = [raw[a:b] for a, b in zip(edges[:-1].tolist(), edges[1:].tolist())]
                new = [w for w in words if w not in known]
                for w, ids in zip(new, encode_words([w.decode("utf-8", "surrogatepass") for w in new], path)):
                    known[w] = np.array(ids, "<u2" if len(pieces(path)) <= 65536 else "<u4").tobytes()
                found = [known[w] for w in words]
                out.append(_pack(np.array([len(f) for f in found], np.uint32).tobytes(), *found))
            yield pdf.assign(data=out)

    return run


def _assembled(path: str, finish, names: list[str]):
    """One block: its words' ids joined to their places; ``finish`` makes the columns of a row."""
    width = 2 if len(pieces(path)) <= 65536 else 4

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        lists = pdf[~pdf.places].drop_duplicates("bucket").sort_values("bucket")
        rows: list[tuple] = []
        listed = sum(int.from_bytes(count, "little") for count in lists["head"])
        # Blocks of one name hold the same documents, repeated; each copy has its own rows.
        for blob, head in pdf.loc[pdf.places, ["data", "head"]].itertuples(index=False):
            words, docs = json.loads(head)
            if words != listed:
                raise ValueError("a block lacks words of its own")
            raw = _unpack(blob)
            a, b = 4 * len(docs), 4 * (len(docs) + words)
            ends, places = _numbers_of(raw[:a]), _numbers_of(raw[b:])
            order = np.argsort(_numbers_of(raw[a:b]), kind="stable").tolist()
            ids_of: list = [b""] * words
            seen = 0
            for got, count in lists[["data", "head"]].itertuples(index=False):
                n, got = int.from_bytes(count, "little"), _unpack(got)
                edges = (np.concatenate(([0], np.cumsum(np.frombuffer(got[: 4 * n], np.uint32), dtype=np.int64))) + 4 * n).tolist()
                for i, a, b in zip(order[seen : seen + n], edges[:-1], edges[1:]):
                    ids_of[i] = got[a:b]
                seen += n
            start = 0
            for doc, n in zip(docs, ends.tolist()):
                ids = np.frombuffer(b"".join([ids_of[i] for i in places[start : start + n].tolist()]), f"<u{width}")
                rows.append((doc, *finish(ids)))
                start += n
        out = pd.DataFrame(rows, columns=["doc_id", *names])
        return out.astype({"doc_id": "Int64"})

    return run


def assemble(docs: DataFrame, finish, columns: str, path: str | None = None, buckets: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row per document: ``doc_id`` and what ``finish`` makes of its array of ids."""
    path = path or vocabulary()
    n = buckets or int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    schema = "block binary, places boolean, bucket int, data binary, head binary"
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    both = docs.mapInArrow(_blocks(path, n, block), schema).repartition("bucket").mapInPandas(_encoded(path), schema)
    names = [c.split()[0] for c in columns.split(", ")]
    return both.groupBy("block").applyInPandas(_assembled(path, finish, names), f"doc_id long, {columns}")


def encode(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """``doc_id`` and ``ids``, the token ids of the whole text."""
    return assemble(docs, lambda ids: (ids.astype(np.int32),), "ids array<int>", path, **options)


def piece_table(spark, path: str | None = None) -> DataFrame:
    rows = [(i, bytearray(p)) for i, p in enumerate(pieces(path or vocabulary()))]
    return spark.createDataFrame(rows, "id int, piece binary")


def decode_ids(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id`` and ``text`` of rows (doc_id, ids): the ids joined with the id-to-piece table.

    Rows are told apart by a digest of their ids besides ``doc_id``, so rows that repeat an id keep
    their own pieces. Unknown ids are left out; bytes that are no UTF-8 become the replacement
    character.
    """
    spark = encoded.sparkSession
    named = encoded.select("doc_id", "ids", F.sha2(F.array_join("ids", ",", "?"), 256).alias("row"))
    rows = named.dropDuplicates(["row"]).select("row", F.posexplode("ids").alias("place", "id")).join(piece_table(spark, path), "id")
    joined = rows.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "piece"))).alias("p"))
    text = F.decode(F.unhex(F.array_join(F.transform("p", lambda x: F.hex(x["piece"])), "")), "UTF-8")
    out = joined.select("row", text.alias("text"))
    return named.select("doc_id", "row").join(out, "row", "left").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))


def digests(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: the text encoded, and decoded again."""
    path = path or vocabulary()

    def finish(ids: np.ndarray):
        piece, number = pieces(path), _numbers(path)
        every = ids.tolist()
        text = b"".join([piece[i] for i in every]).decode("utf-8", "replace")
        return (
            len(every),
            hashlib.sha256(",".join([number[i] for i in every]).encode()).hexdigest(),
            hashlib.sha256(text.encode()).hexdigest(),
        )

    return assemble(docs, finish, "n_tokens long, ids_sha256 string, decoded_sha256 string", path, **options)


def tokens(docs: DataFrame, path: str | None = None, **options) -> DataFrame:
    """doc_id, n_tokens and ids of every whole text, with the digest of the text decoded again."""
    path = path or vocabulary()

    def finish(ids: np.ndarray):
        text = b"".join(map(pieces(path).__getitem__, ids.tolist())).decode("utf-8", "replace")
        return len(ids), ids.astype(np.int32), hashlib.sha256(text.encode()).hexdigest()

    return assemble(docs, finish, "n_tokens long, ids array<int>, decoded_sha256 string", path, **options)


@cache
def _numbers(path: str) -> list[str]:
    return [str(i) for i in range(len(pieces(path)))]
