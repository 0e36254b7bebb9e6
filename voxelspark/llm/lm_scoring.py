"""Language-model scores of whole documents: unigram base and a gated recurrent network.

Counting covers all training documents: tasks count the 64-bit hashes of their words, and Spark
sums the counts. The network (a GRU with a class-factored softmax, plain numpy) knows the
``VOCABULARY`` most frequent words one by one; every other word belongs to one of ``SHAPES``
open classes by its script and length, in which its chance is its smoothed count. The class is
chosen first, then the word within it, so the chances of all words, known or not, and of the
end sum to 1. Classes of the closed words hold equal shares of the training tokens.

Training is truncated backpropagation on windows of ``WINDOW`` tokens over lanes of segments of
``SEGMENT`` tokens. It covers every token of all training documents, which are split into ``ROUNDS``
parts by a hash of id and text. In each round replicas
of the network, one for about ``REPLICA_TOKENS`` tokens, start from the same weights, pass once over
their own documents in their own tasks, and are averaged by their tokens in groups of
``AVERAGED``, level by level; one network reaches the driver. The first weights give every class and
every closed word its share of all training tokens, so even a tiny corpus starts from the counts.
Scoring carries the state from window to window through the whole document, whatever its length.

The counts of the ``KNOWN`` most frequent words are broadcast, a few MB at most. All others grow with
the corpus: they are never broadcast but joined, one row per distinct word and document.

Nulls: a null text is empty and has one token, its end. A null id falls into the fold of the
empty text. Rows that repeat an id and a text share their scores. Without any training document
all counts are 0 and the network is the uniform one.
"""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelspark.llm.common import chunks, encoded, fold, hashed_batches, written

VOCABULARY = 4096
CLASSES = 64
HIDDEN = 24
WINDOW = 32
LANES = 256
TRAIN_LANES = 256
SEGMENT = 512  # tokens after which training starts afresh, so that long documents fill the lanes too
SHARE = 1.0
ROUNDS = 3
RATE = 0.03  # of the first round; it falls evenly with the rounds
REPLICA_TOKENS = 2_000_000
AVERAGED = 32  # networks of under 2 MB that meet in one task
KNOWN = 1 << 18  # words whose counts are broadcast, 16 bytes each
BATCH = 12 << 20  # bytes of text scored at once; a longer document stands alone
SMOOTHING = 0.1
END = 0x5851F42D4C957F2D  # the end's place among the hashed words
_END = np.array([END], np.uint64).view(np.int64)[0]
SHAPES = 24

# Flags of a word's bytes: a letter of A-Z, a digit, another sign, and the UTF-8 lead and tail
# bytes that tell the accents of one script from another.
_FLAGS = np.zeros(256, np.uint8)
_FLAGS[[b for b in range(128) if not chr(b).isalnum()]] = 1
_FLAGS[[b for b in range(128) if chr(b).isdigit()]] = 2
_FLAGS[128:] = 4
_FLAGS[[0xA4, 0xB6, 0xBC, 0x9F]] = 8
_FLAGS[[0xB1, 0xB3, 0xAD, 0xA1, 0xBA]] = 16


def shape_of(flags: np.ndarray, length: np.ndarray) -> np.ndarray:
    """The open class of a word: six kinds of writing by four lengths."""
    kind = np.where(flags & 2, 5, np.where(flags & 8, 2, np.where(flags & 16, 3, np.where(flags & 4, 1, np.where(flags & 1, 4, 0)))))
    return kind * 4 + np.digitize(length, (4, 7, 10))


def tokens_of(texts: list[bytes], limit: int = 1 << 20):
    """Pieces of ``(slice, hashes, shapes, first)`` over a batch, the end of each text included."""
    for part, (h, first, flags, length) in hashed_batches(texts, flags=_FLAGS, limit=limit):
        end = np.uint64(END)
        yield part, np.insert(h, first[1:], end), np.insert(shape_of(flags, length), first[1:], 0), first + np.arange(len(first))


# --------------------------------------------------------------------------- the network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class Network:
    """A GRU over token ids; ids from ``words`` on are open classes, the last id is the end."""

    def __init__(self, words: int, classes: int, share: np.ndarray, opens: np.ndarray | None = None, hidden: int = HIDDEN, seed: int = 1):
        rng = np.random.default_rng(seed)
        self.words, self.hidden = words, hidden
        self.classes = max(1, min(classes, words))
        self.ids = words + SHAPES + 1
        # Closed words, by falling count, in classes of about equal share of the tokens.
        total = np.concatenate(([0], np.cumsum(share)))[:-1] / max(share.sum(), 1e-9)
        self.class_of = np.zeros(self.ids, np.int32)
        self.class_of[:words] = np.minimum((total * self.classes).astype(np.int32), self.classes - 1)
        _, self.class_of[:words] = np.unique(self.class_of[:words], return_inverse=True)
        self.classes = int(self.class_of[:words].max()) + 1 if words else 0
        self.class_of[words:] = self.classes + np.arange(SHAPES + 1)
        self.start = np.searchsorted(self.class_of[:words], np.arange(self.classes + 1)).astype(np.int64)
        self.outputs = self.classes + SHAPES + 1
        mass = np.ones(self.outputs)
        if opens is not None:
            mass = np.maximum(np.concatenate([np.bincount(self.class_of[:words], share, self.classes), opens]), 0.5)

        def w(*shape):
            return rng.normal(0, 1 / np.sqrt(hidden), shape).astype(np.float32)

        self.p = {
            "E": (w(self.ids, 3 * hidden) * 0.5),
            "U": w(hidden, 3 * hidden),
            "b": np.zeros(3 * hidden, np.float32),
            "C": w(hidden, self.outputs) * 0.1,
            "c": np.log(mass / mass.sum()).astype(np.float32),
            "W": w(max(words, 1), hidden) * 0.1,
            "w": np.log(np.maximum(share, 0.5)).astype(np.float32) if words else np.zeros(1, np.float32),
        }

    def forward(self, x: np.ndarray, fresh: np.ndarray, h: np.ndarray, keep: bool = False):
        """States before each token of a window (steps, lanes); ``x`` is the previous token."""
        n, p = self.hidden, self.p
        given = p["E"][x] + p["b"]
        states, saved = np.empty((*x.shape, n), np.float32), []
        for t in range(len(x)):
            h = h * ~fresh[t][:, None]
            zr = _sigmoid(given[t, :, : 2 * n] + h @ p["U"][:, : 2 * n])
            z, r = zr[:, :n], zr[:, n:]
            rh = r * h
            new = np.tanh(given[t, :, 2 * n :] + rh @ p["U"][:, 2 * n :])
            if keep:
                saved.append((h, z, r, rh, new))
            h = h + z * (new - h)
            states[t] = h
        return states, h, saved

    def log_chances(self, states: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Natural log chance of the class, and of a closed word in it, for each (state, token)."""
        p = self.p
        own = self.class_of[y]
        out = states @ p["C"] + p["c"]
        top = out.max(axis=1)
        got = out[np.arange(len(y)), own] - top - np.log(np.exp(out - top[:, None]).sum(axis=1))
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(self.classes + 1))
        for k in range(self.classes):
            rows = order[cuts[k] : cuts[k + 1]]
            if len(rows):
                a, b = self.start[k], self.start[k + 1]
                inner = states[rows] @ p["W"][a:b].T + p["w"][a:b]
                top = inner.max(axis=1)
                got[rows] += inner[np.arange(len(rows)), y[rows] - a] - top - np.log(np.exp(inner - top[:, None]).sum(axis=1))
        return got

    def gradients(self, x, y, real, fresh, h):
        """Gradients over one window (truncated: none flows before it), the loss and the last state."""
        p, n = self.p, self.hidden
        states, last, saved = self.forward(x, fresh, h, keep=True)
        g = {k: np.zeros_like(v) for k, v in p.items()}
        at = np.flatnonzero(real.ravel())
        s, target = states.reshape(-1, n)[at], y.ravel()[at]
        own = self.class_of[target]
        out = s @ p["C"] + p["c"]
        out = np.exp(out - out.max(axis=1, keepdims=True))
        out /= out.sum(axis=1, keepdims=True)
        loss = -np.log(out[np.arange(len(at)), own] + 1e-12).sum()
        out[np.arange(len(at)), own] -= 1
        scale = np.float32(1 / max(1, len(at)))
        out *= scale
        g["C"], g["c"] = s.T @ out, out.sum(axis=0)
        ds = out @ p["C"].T
        order = np.argsort(own, kind="stable")
        cuts = np.searchsorted(own[order], np.arange(self.classes + 1))
        for k in range(self.classes):
            rows = order[cuts[k] : cuts[k + 1]]
            if len(rows):
                a, b = self.start[k], self.start[k + 1]
                inner = s[rows] @ p["W"][a:b].T + p["w"][a:b]
                inner = np.exp(inner - inner.max(axis=1, keepdims=True))
                inner /= inner.sum(axis=1, keepdims=True)
                mine = (np.arange(len(rows)), target[rows] - a)
                loss -= np.log(inner[mine] + 1e-12).sum()
                inner[mine] -= 1
                inner *= scale
                g["W"][a:b], g["w"][a:b] = inner.T @ s[rows], inner.sum(axis=0)
                ds[rows] += inner @ p["W"][a:b]
        dstates = np.zeros((x.size, n), np.float32)
        dstates[at] = ds
        dstates = dstates.reshape(*x.shape, n)
        dh, dgiven = np.zeros_like(h), np.empty((*x.shape, 3 * n), np.float32)
        for t in range(len(x) - 1, -1, -1):
            before, z, r, rh, new = saved[t]
            dh = dh + dstates[t]
            dnew = dh * z * (1 - new * new)
            dz = dh * (new - before) * z * (1 - z)
            drh = dnew @ p["U"][:, 2 * n :].T
            dr = drh * before * r * (1 - r)
            gates = np.concatenate([dz, dr], axis=1)
            dgiven[t] = np.concatenate([gates, dnew], axis=1)
            dh = (dh * (1 - z) + drh * r + gates @ p["U"][:, : 2 * n].T) * ~fresh[t][:, None]
        g["b"] = dgiven.sum(axis=(0, 1))
        before, rh = (np.stack([step[k] for step in saved]).reshape(-1, n) for k in (0, 3))
        g["U"][:, : 2 * n] = before.T @ dgiven.reshape(-1, 3 * n)[:, : 2 * n]
        g["U"][:, 2 * n :] = rh.T @ dgiven.reshape(-1, 3 * n)[:, 2 * n :]
        flat = x.ravel()
        order = np.argsort(flat, kind="stable")
        first = np.flatnonzero(np.concatenate(([True], np.diff(flat[order]) > 0)))
        g["E"][flat[order][first]] = np.add.reduceat(dgiven.reshape(-1, 3 * n)[order], first)
        return g, loss / max(1, len(at)), last

    def train(self, tokens: np.ndarray, first: np.ndarray, window: int = WINDOW, lanes: int = 64, rate: float = 0.01) -> list[float]:
        """One pass of Adam over the documents ``tokens[first[i]:first[i + 1]]``; mean losses."""
        x, y, real, fresh, _ = laned(tokens, first, self.ids - 1, lanes)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        v = {k: np.zeros_like(a) for k, a in self.p.items()}
        h, losses = np.zeros((x.shape[1], self.hidden), np.float32), []
        windows = max(1, -(-len(x) // window))
        for step in range(windows):
            part = slice(step * window, (step + 1) * window)
            if not real[part].any():
                continue
            g, loss, h = self.gradients(x[part], y[part], real[part], fresh[part], h)
            losses.append(float(loss))
            norm = float(np.sqrt(sum(float((a * a).sum()) for a in g.values())))
            now = rate * (1 - 0.9 * step / windows) * min(1.0, 1.0 / max(norm, 1e-6))
            for k, a in g.items():
                m[k] += 0.1 * (a - m[k])
                v[k] += 0.01 * (a * a - v[k])
                self.p[k] -= now * (m[k] / (1 - 0.9 ** (step + 1))) / (np.sqrt(v[k] / (1 - 0.99 ** (step + 1))) + 1e-7)
        return losses

    def score(self, tokens: np.ndarray, first: np.ndarray, window: int = WINDOW, lanes: int = LANES) -> np.ndarray:
        """Natural log chance of each document's classes and closed words, its end included."""
        x, y, real, fresh, doc = laned(tokens, first, self.ids - 1, lanes)
        total, h = np.zeros(len(first) - 1), np.zeros((x.shape[1], self.hidden), np.float32)
        for at in range(0, len(x), window):
            part = slice(at, at + window)
            states, h, _ = self.forward(x[part], fresh[part], h)
            own = np.flatnonzero(real[part].ravel())
            got = self.log_chances(states.reshape(-1, self.hidden)[own], y[part].ravel()[own])
            total += np.bincount(doc[part].ravel()[own], got, len(total))
        return total

    def dumped(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, class_of=self.class_of, start=self.start, meta=np.array([self.words, self.classes, self.hidden]), **self.p)
        return out.getvalue()

    @staticmethod
    def loaded(blob: bytes) -> Network:
        data = np.load(io.BytesIO(blob))
        net = Network.__new__(Network)
        net.words, net.classes, net.hidden = map(int, data["meta"])
        net.ids, net.outputs = net.words + SHAPES + 1, net.classes + SHAPES + 1
        net.class_of, net.start = data["class_of"], data["start"]
        net.p = {k: data[k] for k in ("E", "U", "b", "C", "c", "W", "w")}
        return net


def laned(tokens: np.ndarray, first: np.ndarray, end: int, lanes: int):
    """Whole documents one after the other in lanes, the fullest lane left alone: arrays (steps,
    lanes) of the previous token, the token, whether it is real, whether it opens a document, and
    the document. The token before the first one is the end of another document."""
    sizes = np.diff(first)
    # No more lanes than keep the longest document from outlasting the others.
    lanes = max(1, min(lanes, len(sizes), max(8, -(-int(sizes.sum()) // max(1, int(sizes.max(initial=1)))))))
    fill = np.zeros(lanes, np.int64)
    base, lane = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    import heapq

    heap = [(0, k) for k in range(lanes)]
    for i in np.argsort(-sizes, kind="stable").tolist():
        used, k = heapq.heappop(heap)
        base[i], lane[i] = used, k
        heapq.heappush(heap, (used + int(sizes[i]), k))
        fill[k] = used + sizes[i]
    steps = int(fill.max()) if len(sizes) else 0
    which = np.repeat(np.arange(len(sizes)), sizes)
    row = np.arange(len(which)) - np.repeat(first[:-1], sizes) + base[which]
    y = np.full((steps, lanes), end, np.int32)
    real, doc = np.zeros((steps, lanes), bool), np.zeros((steps, lanes), np.int32)
    y[row, lane[which]], real[row, lane[which]], doc[row, lane[which]] = tokens[first[0] : first[-1]], True, which
    x = np.full_like(y, end)
    x[1:] = y[:-1]
    fresh = np.zeros((steps, lanes), bool)
    some = sizes > 0
    fresh[base[some], lane[some]] = True
    x[base[some], lane[some]] = end
    return x, y, real, fresh, doc


# ------------------------------------------------------------------------------ the corpus


def counts(docs: DataFrame, held_out: int = 10) -> DataFrame:
    """(word, shape, c): hashed words of the training documents with their counts."""

    def run(batches):
        for b in batches:
            for _, h, shape, _ in tokens_of(encoded(b["text"].to_pylist()), 3 << 20):
                names, at, c = np.unique(h, return_index=True, return_counts=True)
                arrays = [pa.array(names.view(np.int64)), pa.array(shape[at].astype(np.int32)), pa.array(c)]
                yield pa.RecordBatch.from_arrays(arrays, ["word", "shape", "c"])

    rows = docs.where(fold("doc_id", held_out) != 0).select("text").mapInArrow(run, "word long, shape int, c long")
    return rows.groupBy("word").agg(F.first("shape").alias("shape"), F.sum("c").alias("c"))


class Lexicon:
    """The most frequent words by falling count; the first ``closed`` of them have ids of their own."""

    def __init__(self, words: np.ndarray, counts: np.ndarray, closed: int):
        order = np.lexsort((words, -counts))
        self.words, self.counts, self.closed = words[order], counts[order], min(closed, len(words))
        self.order = np.argsort(self.words).astype(np.int32)
        self.sorted = self.words[self.order]
        self.share = self.counts[: self.closed].astype(float)

    def rank(self, h: np.ndarray) -> np.ndarray:
        """The place of each hashed word in the lexicon, or -1."""
        if not len(self.words):
            return np.full(len(h), -1, np.int32)
        at = np.minimum(np.searchsorted(self.sorted, h), len(self.words) - 1)
        return np.where(self.sorted[at] == h, self.order[at], -1).astype(np.int32)

    def ids(self, rank: np.ndarray, h: np.ndarray, shape: np.ndarray) -> np.ndarray:
        n = self.closed
        out = np.where((rank >= 0) & (rank < n), rank, n + shape)
        return np.where(h == np.uint64(END), n + SHAPES, out).astype(np.int32)


def lexicon(counted: DataFrame, closed: int = VOCABULARY, most: int = KNOWN) -> Lexicon:
    """All words from the lowest count bucket on that leaves at most ``most`` of them (at least the
    words of the top bucket that fits); buckets are sixteenths of powers of two, so few."""
    bucket = F.floor(F.log2("c") * 16).cast("int")
    rest = counted.where(F.col("word") != int(_END))
    sizes = sorted(((r["b"], r["n"]) for r in rest.groupBy(bucket.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect()), reverse=True)
    low, total = None, 0
    for b, n in sizes:
        if total + n > most:
            break
        low, total = b, total + n
    if low is None:
        return Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), closed)
    rows = rest.where(bucket >= low).select("word", "c").toPandas()
    return Lexicon(rows["word"].to_numpy(np.int64).view(np.uint64), rows["c"].to_numpy(np.int64), closed)


def train(docs: DataFrame, lex: Lexicon, opens: np.ndarray, total: int, held_out: int = 10, share: float = SHARE, rounds: int = ROUNDS, replica: int = REPLICA_TOKENS) -> bytes:
    """The trained network: ``rounds`` rounds of replicas over their own documents, averaged."""
    spark = docs.sparkSession
    place = F.pmod("h", F.lit(1_000_000))
    limit = max(1, int(share * 1_000_000))
    chosen = docs.where(fold("doc_id", held_out) != 0).select("text", F.xxhash64("doc_id", "text").alias("h"))
    replicas = max(1, -(-int(total * share / rounds) // replica))
    blob = Network(lex.closed, CLASSES, lex.share, opens).dumped()
    for k in range(rounds):
        shared = spark.sparkContext.broadcast((lex, blob))
        part = chosen.where((place >= limit * k // rounds) & (place < limit * (k + 1) // rounds))
        # Another hash than the one that picks, or few replicas would get all documents.
        part = part.withColumn("id", F.pmod(F.xxhash64("h"), F.lit(replicas)).cast("int"))
        part = part.repartition(replicas, "id").sortWithinPartitions("id", "h").select("id", "text")
        nets = part.mapInArrow(_replica(shared, RATE * (rounds - k) / rounds), "id int, weight long, net binary")
        left = replicas
        while left > 1:
            left = -(-left // AVERAGED)
            nets = nets.groupBy(F.pmod("id", F.lit(left)).alias("at")).applyInPandas(_averaged, "id int, weight long, net binary")
        rows = nets.collect()
        blob = bytes(rows[0]["net"]) if rows else blob
        shared.unpersist()
    return blob


def _replica(shared, rate: float):
    """One pass of each replica of a task, one after the other, over rows sorted by ``id``."""

    def run(batches):
        lex, blob = shared.value
        now, ids, first = None, [], [np.zeros(1, np.int64)]

        def trained():
            net, tokens, starts = Network.loaded(blob), np.concatenate(ids), np.concatenate(first)
            net.train(tokens, segments(starts), lanes=TRAIN_LANES, rate=rate)
            arrays = [pa.array([now], pa.int32()), pa.array([len(tokens)]), pa.array([net.dumped()], pa.binary())]
            return pa.RecordBatch.from_arrays(arrays, ["id", "weight", "net"])

        for b in batches:
            who = b["id"].to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(who)) + 1).tolist(), len(who)]
            for x, y in zip(cuts, cuts[1:]) if len(who) else ():
                if now is not None and who[x] != now:
                    yield trained()
                    ids, first = [], [np.zeros(1, np.int64)]
                now = int(who[x])
                for _, h, shape, f in tokens_of(encoded(b["text"].slice(x, y - x).to_pylist())):
                    ids.append(lex.ids(lex.rank(h), h, shape))
                    first.append(f[1:] + first[-1][-1])
        if ids:
            yield trained()

    return run


def segments(first: np.ndarray, most: int = SEGMENT) -> np.ndarray:
    """The starts of documents, and every ``most`` tokens within them."""
    count = -(-np.diff(first) // most)
    at = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
    return np.append(np.repeat(first[:-1], count) + most * at, first[-1])


def _averaged(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
    """The mean network of a group, by weight and in the order of the ids."""
    rows = rows.sort_values("id")
    total, out, sums = int(rows["weight"].sum()), None, {}
    for weight, blob in zip(rows["weight"], rows["net"]):
        net = Network.loaded(blob)
        out = out or net
        for name, a in net.p.items():
            sums[name] = sums.get(name, 0) + a.astype(np.float64) * (weight / total)
    out.p = {name: a.astype(np.float32) for name, a in sums.items()}
    return pd.DataFrame({"id": [key[0]], "weight": [total], "net": [out.dumped()]})


def score(docs: DataFrame, vocabulary: int = VOCABULARY, train_share: float = SHARE, held_out: int = 10, known: int = KNOWN) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, n_tokens, n_known, train_tokens,
    base_score and score, both log10."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", F.hash("text").alias("text_key"), "text")
    counted = written(counts(docs, held_out))
    shapes = counted.groupBy("shape").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()
    types, total = sum(r["v"] for r in shapes), sum(r["n"] for r in shapes)
    lex = lexicon(counted, vocabulary, known)
    # Within the open classes: the smoothed counts of the words outside the closed vocabulary.
    inside = spark.createDataFrame([(int(w),) for w in lex.words[: lex.closed].view(np.int64)] + [(int(_END),)], "word long")
    open_words = counted.join(F.broadcast(inside), "word", "left_anti")
    rest = {r["shape"]: (r["v"], r["n"]) for r in open_words.groupBy("shape").agg(F.count(F.lit(1)).alias("v"), F.sum("c").alias("n")).collect()}
    mass = [np.log10(rest.get(s, (0, 0))[1] + SMOOTHING * (rest.get(s, (0, 0))[0] + 1)) for s in range(SHAPES)]
    end_count = float(sum(r["c"] for r in counted.where(F.col("word") == int(_END)).collect()))

    opens = np.array([rest.get(s, (0, 0))[1] for s in range(SHAPES)] + [end_count], float)
    net = spark.sparkContext.broadcast((lex, train(docs, lex, opens, total, held_out, train_share)))

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = written(docs.mapInArrow(_scored(net, mass, end_count), f"doc_id {kind}, text_key int, n_tokens long, n_known long, base double, score double, words array<long>, times array<int>"))
    keys = ["doc_id", "text_key"]
    asked = parts.dropDuplicates(keys).select(*keys, F.explode(F.arrays_zip("words", "times")).alias("w"))
    asked = asked.select(*keys, F.col("w.words").alias("word"), F.col("w.times").alias("times"))
    found = asked.join(counted.select("word", "c"), "word").select(*keys, "times", "c")
    # Unseen words stand in the parts with the smoothing alone; seen ones add what is missing.
    more = F.col("times") * (F.log10(F.col("c") + SMOOTHING) - float(np.log10(SMOOTHING)))
    sums = found.groupBy(*keys).agg(F.sum(more).alias("more"), F.sum(F.col("times").cast("long")).alias("known"))
    left, right = parts.drop("words", "times").alias("l"), sums.alias("r")
    same = F.col("l.doc_id").eqNullSafe(F.col("r.doc_id")) & (F.col("l.text_key") == F.col("r.text_key"))
    joined = left.join(right, same, "left")
    scale = float(np.log10(total + SMOOTHING * (types + 1)))
    more = F.coalesce("r.more", F.lit(0.0))
    return joined.select(
        F.col("l.doc_id").alias("doc_id"),
        (fold(F.col("l.doc_id"), held_out) == 0).alias("held_out"),
        F.col("l.n_tokens").alias("n_tokens"),
        (F.col("l.n_known") + F.coalesce("r.known", F.lit(0))).alias("n_known"),
        F.lit(total).cast("long").alias("train_tokens"),
        (F.col("l.base") + more - scale * F.col("l.n_tokens")).alias("base_score"),
        (F.col("l.score") + more).alias("score"),
    )


def _scored(shared, mass: list[float], end_count: float):
    """Per document: both sums over the words of the lexicon, and its other words with times."""
    mass, names = np.array(mass), ["doc_id", "text_key", "n_tokens", "n_known", "base", "score", "words", "times"]

    def run(batches):
        lex, blob = shared.value
        net, n = Network.loaded(blob), lex.closed
        # By rank; the last one stands for words outside the lexicon.
        logs = np.log10(np.append(lex.counts, 0) + SMOOTHING)
        for b in batches:
            raw = encoded(b["text"].to_pylist())
            for part in chunks(raw, map(len, raw), BATCH):
                yield pa.RecordBatch.from_arrays([b[c].slice(part.start, part.stop - part.start) for c in names[:2]] + sums(raw[part], lex, net, n, logs), names)

    def sums(raw, lex, net, n, logs):
        ids, first, words, times, base, inner, seen = [], [np.zeros(1, np.int64)], [], [], [], [], []
        for _, h, shape, f in tokens_of(raw):
            rank, end = lex.rank(h), h == np.uint64(END)
            own = lex.ids(rank, h, shape)
            add = np.where(end, np.log10(end_count + SMOOTHING), logs[rank])
            base.append(np.add.reduceat(add, f[:-1]))
            inner.append(np.add.reduceat(np.where((own >= n) & ~end, add - mass[shape], 0.0), f[:-1]))
            seen.append(np.add.reduceat(np.where(end, end_count > 0, rank >= 0).astype(np.int64), f[:-1]))
            rare = np.flatnonzero((rank < 0) & ~end)
            which = np.searchsorted(f, rare, "right") - 1
            order = np.lexsort((h[rare], which))
            w, d = h[rare][order], which[order]
            edge = np.flatnonzero(np.concatenate(([True], (np.diff(w) != 0) | (np.diff(d) != 0)))) if len(w) else np.zeros(0, np.int64)
            count = np.diff(np.append(edge, len(w)))
            cuts = np.searchsorted(d[edge], np.arange(len(f)))
            words += [w[edge[x:y]].view(np.int64) for x, y in zip(cuts, cuts[1:])]
            times += [count[x:y].astype(np.int32) for x, y in zip(cuts, cuts[1:])]
            ids.append(own)
            first.append(f[1:] + first[-1][-1])
        ids, first = np.concatenate(ids), np.concatenate(first)
        got = net.score(ids, first) / np.log(10) + np.concatenate(inner)
        arrays = [pa.array(np.diff(first)), pa.array(np.concatenate(seen)), pa.array(np.concatenate(base)), pa.array(got)]
        return [*arrays, pa.array(words, pa.list_(pa.int64())), pa.array(times, pa.list_(pa.int32()))]

    return run
