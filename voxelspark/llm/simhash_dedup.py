"""Near duplicates by SimHash: deletion-variant signatures, equality join, verification.

Fingerprints link at ``BITS`` or fewer differing bits. They are cut into ``BITS // 2 + 1``
segments, so that two linked ones agree in some segment up to one bit. Each distinct
fingerprint is indexed once for each segment and each wildcard position in it (the bit there
cleared); fingerprints under one key are compared exactly. Within a key only a forest is kept:
each member is tied to the smallest member it reaches there, so the rows stay linear.

A key with more than ``LIMIT`` members (a hot segment) is not compared pairwise: its members
are indexed by all pairs of wildcards over the whole fingerprint. Two fingerprints under such
a key differ by two bits at most without any check, so each is tied to the key's smallest.

``deduplicated`` takes shingles of any length and a similarity of the shingle sets: SimHash finds the
near copies, an index by shingles every other pair, and the shingles of both documents decide.

Nulls: a null text counts as empty and has the fingerprint zero, linked like any other. Rows
that repeat an id are one document if their texts agree.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.common import chunks, encoded, hashed_batches, mix, written

BITS = 2
SHINGLE = 3
LIMIT = 2048
SEED = 42


def fingerprint(text: bytes, words: int = SHINGLE) -> int:
    """SimHash of word shingles, repeats included; zero without words."""
    tokens = text.lower().split()  # bytes: exactly A-Z, and white space \x20 \x09-\x0D
    if not tokens:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(tokens) <= words:
        return digest(b" ".join(tokens), SEED)
    joined = b" ".join(tokens)
    start, end, total = 0, -1, 0
    edges = np.cumsum([len(t) + 1 for t in tokens])
    starts = [0, *edges[: len(tokens) - words].tolist()]
    ends = (edges[words - 1 :] - 1).tolist()
    counts = np.zeros(64, np.int64)
    for at in range(0, len(starts), 1 << 16):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + (1 << 16)], ends[at : at + (1 << 16)])], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(starts), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``fp`` (the 64 bits as a long) of every whole text."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t) for t in encoded(b["text"].to_pylist())], np.uint64)
            yield pa.RecordBatch.from_arrays([b["doc_id"], pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, fp long")


def variants(fp: Column, bits: int = BITS) -> Column:
    """The index keys of a fingerprint: segment number and wildcard position above, bits below."""
    segments = bits // 2 + 1
    edges = [64 * i // segments for i in range(segments + 1)]
    keys = []
    for lo, hi in zip(edges, edges[1:]):
        width = hi - lo
        part = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << width) - 1))
        keys += [F.lit((lo + at) << width).bitwiseOR(part.bitwiseAND(F.lit((1 << width) - 1 - (1 << at)))) for at in range(width)]
    return F.array(*keys)


def _ties(run: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The forest of one key: each member with the smallest one it reaches inside the key."""
    label = np.arange(len(run))
    for at in range(0, len(run), 512):
        near = np.bitwise_count(run[at : at + 512, None] ^ run[None, :]) <= bits
        for i, j in zip(*np.nonzero(near)):
            i += at
            if j > i:
                a, b = i, j
                while label[a] != a:
                    a = label[a]
                while label[b] != b:
                    b = label[b]
                label[max(a, b)] = min(a, b)
    for i in range(len(run)):
        label[i] = label[label[i]]
    tied = np.flatnonzero(label != np.arange(len(run)))
    return run[tied], run[label[tied]]


def _compare(bits: int, limit: int):
    """Rows sorted by key -> links (a, b), and (a, a) for each member of a hot key."""

    def emit(a, b):
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    def run(batches):
        key, fp, hot = np.zeros(0, np.int64), np.zeros(0, np.uint64), None
        for b in batches:
            key = np.concatenate([key, b["key"].to_numpy()])
            fp = np.concatenate([fp, b["fp"].to_numpy().view(np.uint64)])
            if not len(key):
                continue
            last = int(np.searchsorted(key, key[-1]))
            yield from inside(key[:last], fp[:last], hot)
            if last:
                hot = None
            key, fp = key[last:], fp[last:]
            if len(key) > limit:  # a hot key need not be held
                yield emit(fp, fp)
                hot, key, fp = key[0], key[:0], fp[:0]
        yield from inside(key, fp, hot)

    def inside(key, fp, hot):
        if not len(key):
            return
        edges = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
        sizes = np.diff(edges)
        two = edges[:-1][sizes == 2]
        a, b = fp[two], fp[two + 1]
        near = np.bitwise_count(a ^ b) <= bits
        if near.any():
            yield emit(np.maximum(a, b)[near], np.minimum(a, b)[near])
        for at, size in zip(edges[:-1], sizes):
            if size > limit or key[at] == hot:
                yield emit(fp[at : at + size], fp[at : at + size])
            elif size > 2:
                a, b = _ties(np.sort(fp[at : at + size]), bits)
                if len(a):
                    yield emit(a, b)

    return run


def _tied(distinct: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """What ``_compare`` finds under all keys."""
    keyed = distinct.select(F.explode(variants(F.col("fp"), bits)).alias("key"), "fp")
    return keyed.repartition("key").sortWithinPartitions("key").mapInArrow(_compare(bits, limit), "a long, b long").distinct()


def links(distinct: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """Links (a, b), a != b, between distinct fingerprints ``fp`` that join exactly those groups
    that all pairs within ``bits`` (2 or 3) join."""
    found = written(_tied(distinct, bits, limit))
    pairs, hot = found.where("a <> b"), found.where("a = b").select(F.col("a").alias("fp"))
    if hot.isEmpty():
        return pairs
    masks = [sum(1 << i for i in gone) for gone in combinations(range(64), bits)]
    signed = [m - (1 << 64) if m >= 1 << 63 else m for m in masks]
    number = F.posexplode(F.array(*[F.lit(~m) for m in signed])).alias("n", "keep")
    star = hot.select("fp", number).select("fp", "n", F.col("fp").bitwiseAND(F.col("keep")).alias("rest"))
    least = star.groupBy("n", "rest").agg(F.min("fp").alias("b"), F.count(F.lit(1)).alias("c")).where("c > 1")
    tied = star.join(least, ["n", "rest"]).where("fp <> b").select(F.col("fp").alias("a"), "b")
    return written(pairs.union(tied).distinct())


def components(edges: DataFrame) -> DataFrame:
    """Connected components of links (a, b) of longs as (node, root), root the smallest node.

    Alternating large-star and small-star steps; each round is a written table, and only two
    sums of it reach the driver. Ends when a round changes nothing.
    """
    current = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct()
    current, before = written(current), None
    while True:
        state = tuple(current.agg(F.count(F.lit(1)), F.sum((F.xxhash64("a", "b") % 1_000_003).cast("long"))).first())
        if state == before or not state[0]:
            return current.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a").select(F.explode(F.array(F.struct("b", "m"), F.struct(F.col("a").alias("b"), "m"))).alias("e"))
        current = written(small.select(F.col("e.b").alias("a"), F.col("e.m").alias("b")).where("a <> b").distinct())


def near_groups(docs: DataFrame, bits: int = BITS, limit: int = LIMIT) -> DataFrame:
    """One row per row of ``docs``: doc_id, fingerprint (hex), component_id (smallest id)."""
    found = written(fingerprints(docs))
    first = written(found.groupBy("fp").agg(F.min("doc_id").alias("first")))
    root = components(links(first.select("fp"), bits, limit))
    named = first.join(root.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named = written(named)
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    classes = named.join(least, "root").select("fp", "component_id")
    return found.join(classes, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ------------------------------------------------------------------- shingle similarity
# The pipeline's stage joins texts whose sets of ``STAGE_SHINGLE``-word shingles have a similarity of
# 0.8, in two rounds. The first finds near copies: by SimHash as above, and the nearest of the next rows under
# the last keys of each text. The second checks every pair that is left, by an index that misses none:
# two sets of that similarity share a shingle among the first n - ceil(0.8 n) + 1 of each, whatever
# the order, as long as it is one for all. Frequent shingles come last, so texts of a family that are
# not similar enough rarely meet; ends that the first round has joined need no check.

STAGE_SHINGLE = 5
SIMILARITY = 0.8
NEAREST = 4
FREQUENT = 8
WINDOW = 256
BITMAP = 1024
EARLIER = ("e1", "e2")  # the shared keys before a row's own in its text's order; 0 where there is none
RANKED = 1 << 19  # frequent shingles with a place of their own in the order, 8 bytes each
_MASK = np.uint64(np.random.default_rng(20240301).integers(1, 2**63))
_TIMES = np.uint64(0x9E3779B97F4A7C15)


def shingle_sets(texts: list[bytes], words: int = STAGE_SHINGLE):
    """Sorted distinct 64-bit hashes of each text's word shingles; of all its words if it has fewer."""
    for _, (h, first) in hashed_batches(texts):
        for a, b in zip(first.tolist(), first[1:].tolist()):
            size = min(words, b - a)
            s = np.zeros(b - a - size + 1 if size else 0, np.uint64)
            for at in range(size):
                s = (s + h[a + at : a + at + len(s)]) * _TIMES
            yield np.unique(mix(s))


def set_fingerprint(shingles: np.ndarray) -> np.uint64:
    """SimHash of a set of shingles."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        h = mix(shingles[at : at + (1 << 16)] ^ _MASK)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0]


def _sets_of(batches, words: int):
    """Batches -> (batch, slice, sets) of about 1 MB of text each."""
    for b in batches:
        raw = encoded(b["text"].to_pylist())
        for part in chunks(raw, map(len, raw), 1 << 20):
            yield b, part, list(shingle_sets(raw[part], words))


def _nodes(own: list[np.ndarray]) -> np.ndarray:
    """A hash of each whole set."""
    return np.array([mix(s * _TIMES + _MASK).sum(dtype=np.uint64) for s in own], np.uint64).view(np.int64)


def _described(words: int):
    """Batches -> doc_id, node, fp, n (shingles of the set) and ``BITMAP`` bits, in which every shingle sets one."""

    def run(batches):
        for b, part, own in _sets_of(batches, words):
            fps = np.array([set_fingerprint(s) for s in own], np.uint64).view(np.int64)
            bits = np.zeros((len(own), BITMAP), bool)
            for row, s in zip(bits, own):
                row[(s % np.uint64(BITMAP)).astype(np.int64)] = True
            packed = pa.array([row.tobytes() for row in np.packbits(bits, axis=1)], pa.binary())
            n = pa.array([len(s) for s in own], pa.int32())
            ids = b["doc_id"].slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays([ids, pa.array(_nodes(own)), pa.array(fps), n, packed], ["doc_id", "node", "fp", "n", "bits"])

    return run


def _shingled(words: int):
    """Batches -> node and shingles."""

    def run(batches):
        for _, _, own in _sets_of(batches, words):
            sets = pa.array([s.view(np.int64) for s in own], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array(_nodes(own)), sets], ["node", "shingles"])

    return run


def _halves(words: int):
    """Batches -> the upper halves of all shingles."""

    def run(batches):
        for _, _, own in _sets_of(batches, words):
            flat = np.concatenate(own).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array((flat >> 32).astype(np.int32))], ["h"])

    return run


def _frequent(half: DataFrame, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Of the halves ``h`` of all shingles: the halves of frequent shingles, sorted, and their places from 1 by rising count. All shingles are
    counted; more than ``most`` frequent ones leave those of the lower powers of two without a place."""
    counted = written(half.groupBy("h").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") >= FREQUENT))
    power = F.floor(F.log2("c")).cast("int")
    low, total = 63, 0
    for p, n in sorted(map(tuple, counted.groupBy(power.alias("p")).agg(F.count(F.lit(1))).collect()), reverse=True):
        if total + n > most:
            break
        low, total = p, total + n
    rows = counted.where(power >= low).toPandas()
    h, c = rows["h"].to_numpy(np.int32), rows["c"].to_numpy(np.int64)
    place = np.empty(len(h), np.int32)
    place[np.lexsort((h, c))] = np.arange(1, len(h) + 1, dtype=np.int32)
    order = np.argsort(h)
    return h[order], place[order]


def _prefixes(shared, similarity: float, words: int):
    """Batches -> index rows: key, node, pos (of the key in its order), and whether the key is one of its
    last two."""

    def run(batches):
        frequent, places = shared.value
        for _, _, own in _sets_of(batches, words):
            node, n, s = _nodes(own), np.array([len(x) for x in own]), np.concatenate(own).view(np.int64)
            rank = np.zeros(len(s), np.int32)
            if len(frequent):
                h = (s >> 32).astype(np.int32)
                at = np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)
                rank = np.where(frequent[at] == h, places[at], 0)
            which = np.repeat(np.arange(len(n)), n)
            order = np.lexsort((s, rank, which))
            pos = np.arange(len(s)) - np.repeat(np.cumsum(n) - n, n)
            last = n - np.ceil(similarity * n - 1e-9).astype(np.int64)
            keep = np.flatnonzero(pos <= last[which])
            doc, pos = which[keep], pos[keep]
            arrays = [s[order[keep]], node[doc], pos.astype(np.int32), pos >= last[doc] - 1]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], ["key", "node", "pos", "last"])

    return run


def _whole_keys(batches, names: list[str]):
    """Batches sorted by the first column as arrays that hold whole keys."""
    parts, size = [], 0
    for b in batches:
        if not b.num_rows:
            continue
        parts.append([b[c].to_numpy(zero_copy_only=False) for c in names])
        size += b.num_rows
        if size >= 1 << 16 and parts[0][0][0] != parts[-1][0][-1]:
            rows = [np.concatenate(c) for c in zip(*parts)]
            cut = int(np.searchsorted(rows[0], rows[0][-1]))
            yield [c[:cut] for c in rows]
            parts, size = [[c[cut:] for c in rows]], size - cut
    if parts:
        yield [np.concatenate(c) for c in zip(*parts)]


def _shared_keys(batches):
    """Index rows sorted by key and node -> those of keys that several nodes share, each once."""
    names = ["key", "node", "pos", "last"]
    for rows in _whole_keys(batches, names):
        key, node = rows[:2]
        once = np.concatenate(([True], (key[1:] != key[:-1]) | (node[1:] != node[:-1])))
        rows = [c[once] for c in rows]
        same = rows[0][1:] == rows[0][:-1]
        some = np.concatenate((same, [False])) | np.concatenate(([False], same))
        yield pa.RecordBatch.from_arrays([pa.array(c[some]) for c in rows], names)


def _met(similarity: float, window: int | None, nearest: int = NEAREST):
    """Index rows sorted by key -> pairs (a, b) of nodes that may be similar. With a window, each row
    gives the ``nearest`` of its next rows; without, all pairs of different roots that may be similar
    if this is the first key that they share.

    A bit of one side that the other lacks is a shingle that it lacks, so bits bound what two sets share.
    ``EARLIER`` keys before each row's own tell of a key that a pair has met under before: whatever passes here
    passed there too, as positions only grow, so the pair is not given again.
    """
    need = similarity / (1 + similarity)
    names = ["key", "node", "n", "pos", "bits"] + ([] if window else ["root", *EARLIER])

    def pairs(node, i, j):
        ends = np.unique(np.sort(np.stack([node[i], node[j]]), axis=0), axis=1)
        return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(e)) for e in ends], ["a", "b"])

    def run(batches):
        for key, node, n, pos, bits, *more in _whole_keys(batches, names):
            root, bits = more[0] if more else node, np.frombuffer(b"".join(bits), "<u8").reshape(len(key), -1)
            earlier = more[1:]
            after = n - pos

            def fit(i, j):
                """Which of these pairs may be similar."""
                at = np.arange(len(i))
                if window is None:
                    at = np.flatnonzero((root[i] != root[j]) & (np.minimum(after[i], after[j]) >= need * (n[i] + n[j]) - 1e-9))
                    met = np.zeros(len(at), bool)
                    for x in earlier:
                        own = x[i[at]]
                        for y in earlier:
                            met |= (own == y[j[at]]) & (own != 0)
                    at = at[~met]
                i, j = i[at], j[at]
                common = bits[i] & bits[j]
                lack = [np.bitwise_count(bits[k] & ~common).sum(axis=1, dtype=np.int32) for k in (i, j)]
                return at[np.minimum(n[i] - lack[0], n[j] - lack[1]) >= need * (n[i] + n[j]) - 1e-9]

            far = np.full((len(key), nearest), 8 * BITMAP, np.int32)
            who = np.zeros((len(key), nearest), np.int64)
            edges = np.concatenate(([0], np.flatnonzero(np.diff(key)) + 1, [len(key)]))
            sizes = np.diff(edges)
            large = np.repeat((sizes > 64) & (window is None), sizes)
            left, step = np.flatnonzero((key[:-1] == key[1:]) & ~large[:-1]), 1
            while len(left) and (window is None or step <= window):
                i = left[fit(left, left + step)]
                if len(i) and window is None:
                    yield pairs(node, i, i + step)
                elif len(i):
                    distance = np.bitwise_count(bits[i] ^ bits[i + step]).sum(axis=1, dtype=np.int32)
                    for a, b in ((i, i + step), (i + step, i)):
                        worst = far[a].argmax(axis=1)
                        nearer = distance < far[a, worst]
                        far[a[nearer], worst[nearer]], who[a[nearer], worst[nearer]] = distance[nearer], b[nearer]
                step += 1
                left = left[left + step < len(key)]
                left = left[key[left] == key[left + step]]
            a, slot = np.nonzero(far < 8 * BITMAP)
            if len(a):
                yield pairs(node, a, who[a, slot])
            for at, size in zip(edges[:-1], sizes) if window is None else ():
                if size <= 64:
                    continue
                # Only the rows outside the largest group meet the others.
                _, group, count = np.unique(root[at : at + size], return_inverse=True, return_counts=True)
                outside, every = group != count.argmax(), np.arange(at, at + size)
                rest = every[outside]
                block = max(1, (1 << 18) // size)
                for k in range(0, len(rest), block):
                    i = np.repeat(rest[k : k + block], size)
                    j = np.tile(every, len(rest[k : k + block]))
                    once = ~(outside[j - at] & (j <= i))
                    i, j = i[once], j[once]
                    ok = fit(i, j)
                    if len(ok):
                        yield pairs(node, i[ok], j[ok])

    return run


def _close(pairs: DataFrame, docs: DataFrame, first: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets have at least ``similarity``. Sets are made anew, from the
    texts of one document each (``first``: node, doc_id) of the nodes that pairs name."""
    named = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
    named = written(first.join(named, "node", "left_semi").select(F.col("first").alias("asked")).distinct())
    texts = docs.select("doc_id", "text").join(named, F.col("doc_id").eqNullSafe(F.col("asked")), "left_semi")
    sets = texts.select("text").mapInArrow(_shingled(shingle), "node long, shingles array<long>")
    # Repeated rows have equal sets; so has each of several texts under one node.
    sets = written(sets.dropDuplicates(["node"]))
    both = pairs.join(sets.toDF("a", "x"), "a").join(sets.toDF("b", "y"), "b")
    counted = both.select("a", "b", F.size(F.array_intersect("x", "y")).alias("i"), (F.size("x") + F.size("y")).alias("n"))
    return written(counted.where(F.col("i") / (F.col("n") - F.col("i")) >= similarity).select("a", "b"))


def similar_groups(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY, limit: int = WINDOW, ranked: int = RANKED) -> DataFrame:
    """One row per row of ``docs``: doc_id and component_id, the smallest id of those linked by
    pairs whose shingle sets have at least ``similarity``. No pair is left out.

    ``docs`` is read five times; the shingle sets of all texts are larger than the texts and never stored."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    text = docs.select("text")
    own = written(docs.select("doc_id", "text").mapInArrow(_described(shingle), f"doc_id {kind}, node long, fp long, n int, bits binary"))
    first = written(own.groupBy("node").agg(F.min("doc_id").alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"), F.min("bits").alias("bits")))
    order = spark.sparkContext.broadcast(_frequent(text.mapInArrow(_halves(shingle), "h int"), ranked))
    index = text.mapInArrow(_prefixes(order, similarity, shingle), "key long, node long, pos int, last boolean")
    index = written(index.repartition("key").sortWithinPartitions("key", "node").mapInArrow(_shared_keys, index.schema))

    near = written(first.groupBy("fp").agg(F.min("node").alias("node"), F.max("node").alias("other")))
    ties = _tied(near.select("fp")).where("a <> b")
    node = near.select("fp", "node")
    ties = written(ties.join(node.toDF("a", "x"), "a").join(node.toDF("b", "y"), "b").select("x", "y"))
    along = Window.partitionBy("node").orderBy("pos")
    earlier = {c: F.coalesce(F.lag("key", k).over(along), F.lit(0)) for k, c in enumerate(EARLIER, 1)}
    index = written(index.join(first.select("node", "n", "bits"), "node").withColumns(earlier))
    next_ = index.where("last").repartition("key").sortWithinPartitions("key", F.xxhash64("key", "node")).mapInArrow(_met(similarity, limit), "a long, b long")
    tried = ties.union(near.where("node <> other").select("node", "other")).union(next_).toDF("a", "b")
    tried = written(tried.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    links = _close(tried, docs, first, shingle, similarity)

    rooted = index.join(components(links), "node", "left").select("key", "node", "n", "pos", "bits", F.coalesce("root", "node").alias("root"), *EARLIER)
    rest = rooted.repartition("key").sortWithinPartitions("key", "n", "node").mapInArrow(_met(similarity, None), "a long, b long")
    rest = written(rest.distinct().join(tried, ["a", "b"], "left_anti"))
    root = components(links.unionByName(_close(rest, docs, first, shingle, similarity)))
    named = written(first.join(root, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root")))
    least = named.groupBy("root").agg(F.min("first").alias("component_id"))
    return own.select("doc_id", "node").join(named.join(least, "root").select("node", "component_id"), "node").select("doc_id", "component_id")


def deduplicated(docs: DataFrame, shingle: int = STAGE_SHINGLE, similarity: float = SIMILARITY, limit: int = WINDOW, ranked: int = RANKED) -> DataFrame:
    """The rows of ``docs`` that stay: in each group of ``similar_groups``, the one with the smallest
    id. Rows without an id share one fate, as do rows that repeat one."""
    row = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    stays = F.max(F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("stays")
    fate = similar_groups(docs, shingle, similarity, limit, ranked).groupBy(row.alias("__row_id")).agg(stays)
    gone = written(fate.where(~F.col("stays")).select("__row_id"))
    return docs.withColumn("__row_id", row).join(gone, "__row_id", "left_anti").drop("__row_id")
