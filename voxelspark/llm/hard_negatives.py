"""Hard negatives by cover trees over norm-augmented vectors.

Components become whole numbers; a row's score is its inner product with the anchor. Rows are cut
into blocks around pivots (from a bounded sample; a pivot with many rows, say of one repeated
vector, has many blocks), and every block holds a cover tree. A vector ``x`` is augmented by
``sqrt(M^2 - |x|^2)`` with ``M`` the block's greatest norm, so all vectors lie on one sphere and
nearest means greatest inner product. Every node knows the greatest distance of its rows to its
centre; on the sphere that is an angle, and with it the node's inner products with an anchor lie
between two cosines. An anchor goes down level by level, leaves out the nodes outside all of its
windows, visits leaves from the highest bound on, and stops where the bound is below the last
score it would keep. Scores in leaves are exact: products of doubles below 2**53, else of longs.

Anchors are a stated set and meet all rows in blocks: a cell is one block and one group of
anchors, about a megabyte each. First the positives (best of the same label), then, in windows
drawn from their scores, the negatives. Cells return the best few of every window; those are
merged by a ranked window.

Defined cases: rows with a null id, label or vector, or with a null or non-finite component, take
no part. A shorter vector counts as followed by zeros. Rows that repeat an id are rows of their
own (other than each other). Ties go to the smaller id. Products beyond 64 bits are an error.
An empty table, or one without anchors, gives no row.
"""

from __future__ import annotations

import pickle

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voxelspark.llm.common import written

SCALE = 256
BLOCK = 4096  # rows of a block, on average
GROUP = 4096  # anchors of a group, on average
PIVOTS = 256
LEAF, FAN = 128, 16
POSITIVES, NEGATIVES = 5, 3
LOW, HIGH = 50, 95  # per cent of the positive's score
_NONE = np.iinfo(np.int64).min


# ---------------------------------------------------------------------- the tree of a block


def cover_tree(x: np.ndarray) -> dict:
    """A tree over the rows of ``x``: ``order`` puts the rows of a node side by side. Nodes are
    listed level by level with centre (a row), angle, parent and slice; ``leaf`` marks the last."""
    f = x.astype(np.float64)
    squares = np.einsum("ij,ij->i", f, f)
    top = float(np.sqrt(squares.max(initial=0.0)))
    f = np.column_stack((f, np.sqrt(np.maximum(top * top - squares, 0.0))))
    order = np.arange(len(x))
    centre, angle, parent, start, end, leaf = [], [], [], [], [], []
    waiting = [(0, -1, 0, len(x))]
    while waiting:
        below = []
        for c, up, a, b in waiting:
            own = order[a:b]
            d = np.linalg.norm(f[own] - f[c], axis=1)
            radius = float(d.max())
            me = len(centre)
            centre.append(c)
            angle.append(2 * np.arcsin(min(1.0, radius / (2 * top))) if top else 0.0)
            parent.append(up)
            start.append(a)
            end.append(b)
            leaf.append(b - a <= LEAF or radius == 0)
            if leaf[-1]:
                continue
            # The centre stays one of the children's; others are the farthest until half is covered.
            kids, nearest = [c], np.zeros(b - a, np.int64)
            while len(kids) < FAN and d.max() > radius / 2:
                kids.append(int(own[d.argmax()]))
                e = np.linalg.norm(f[own] - f[kids[-1]], axis=1)
                nearest[e < d] = len(kids) - 1
                d = np.minimum(d, e)
            by = np.argsort(nearest, kind="stable")
            order[a:b] = own[by]
            cuts = a + np.searchsorted(nearest[by], np.arange(len(kids) + 1))
            below += [(k, me, i, j) for k, i, j in zip(kids, cuts[:-1].tolist(), cuts[1:].tolist()) if j > i]
        waiting = below
    return {
        "order": order,
        "top": top,
        "centres": x[centre],
        "angle": np.array(angle),
        "parent": parent,
        "slices": list(zip(start, end)),
        "leaf": np.array(leaf, bool),
    }


def _floats(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether all inner products are exact as doubles; an error where 64 bits do not hold them."""
    sizes = [float(np.sqrt((m.astype(np.float64) ** 2).sum(1).max(initial=0.0))) for m in (a, b)]
    most = sizes[0] * sizes[1] * 1.0001 + 1
    if most >= 2**63:
        raise ValueError("inner products beyond 64 bits")
    return most < 2**53


def search(block: dict, q: np.ndarray, label: np.ndarray, own: np.ndarray, low: np.ndarray, high: np.ndarray, same: bool, k: int):
    """The best ``k`` of every window (anchor ``i``, window ``j``: scores from ``low[i, j]`` to
    ``high[i, j]``) among the block's rows of the same, or of another, label.

    Returns arrays (anchor, window, score, vec_id, row), best first within a window.
    """
    tree, x = block["tree"], block["x"]
    exact = _floats(q, x)
    kind = np.float64 if exact else np.int64
    qs, xs = q.astype(kind), x.astype(kind)
    n, w = low.shape
    # Bounds: the angle to the centre, less and more the angle that the node covers.
    size = np.linalg.norm(q.astype(np.float64), axis=1)
    reach = size * tree["top"]
    with np.errstate(divide="ignore", invalid="ignore"):
        turn = np.arccos(np.clip(np.where(reach[:, None] > 0, (q.astype(np.float64) @ tree["centres"].T.astype(np.float64)) / reach[:, None], 0), -1, 1))
    slack = 1e-7 * reach + 1e-3
    upper = reach[:, None] * np.cos(np.maximum(turn - tree["angle"], 0)) + slack[:, None]
    lower = reach[:, None] * np.cos(np.minimum(turn + tree["angle"], np.pi)) - slack[:, None]
    open_ = low <= high
    floor = np.where(open_, low, np.iinfo(np.int64).max).min(1)
    ceiling = np.where(open_, high, _NONE).max(1)
    alive = (upper >= floor[:, None]) & (lower <= ceiling[:, None]) & open_.any(1)[:, None]
    for node, up in enumerate(tree["parent"]):
        if up >= 0:
            alive[:, node] &= alive[:, up]
    leaves = np.flatnonzero(tree["leaf"])
    bound = np.where(alive[:, leaves], upper[:, leaves], -np.inf)
    turnwise = np.argsort(-bound, axis=1, kind="stable")
    best = _Best(n, w, k, np.where(open_, low, np.iinfo(np.int64).max))
    for visit in range(len(leaves)):
        chosen = turnwise[:, visit]
        going = np.flatnonzero(bound[np.arange(n), chosen] >= best.least)
        if not len(going):
            break  # bounds fall from visit to visit, and what is kept only rises
        going = going[np.argsort(chosen[going], kind="stable")]
        cuts = np.flatnonzero(np.diff(chosen[going], prepend=-1, append=-1))
        found = []
        for i, j in zip(cuts[:-1], cuts[1:]):
            a, b = tree["slices"][leaves[chosen[going[i]]]]
            who = going[i:j]
            s = qs[who] @ xs[a:b].T
            fits = (s >= best.least[who, None]) & (s <= ceiling[who, None])
            at, row = np.nonzero(fits)
            row += a
            ok = ((block["label"][row] == label[who[at]]) == same) & (block["row"][row] != own[who[at]])
            at, row = at[ok], row[ok]
            found.append((who[at], row, s[at, row - a].astype(np.int64)))
        at, row, s = (np.concatenate(c) for c in zip(*found))
        in_window = (s[:, None] >= low[at]) & (s[:, None] <= high[at])
        i, j = np.nonzero(in_window)
        best.add(at[i], j, s[i], block["vec_id"][row[i]], block["row"][row[i]])
    return best.rows()


class _Best:
    """The best ``k`` (score, then smaller id) of every anchor and window so far."""

    def __init__(self, n: int, w: int, k: int, low: np.ndarray):
        self.w, self.k, self.low = w, k, low.copy()
        self.kept = tuple(np.zeros(0, np.int64) for _ in range(4))  # cell, score, vec_id, row
        self.least = low.min(1) if w else np.zeros(n, np.int64)

    def add(self, at, window, score, vec_id, row) -> None:
        if not len(at):
            return
        cell, score, vec_id, row = (np.concatenate(c) for c in zip(self.kept, (at * self.w + window, score, vec_id, row)))
        by = np.lexsort((row, vec_id, -score, cell))
        cell = cell[by]
        first = np.flatnonzero(np.diff(cell, prepend=-1))
        rank = np.arange(len(cell)) - np.repeat(first, np.diff(np.append(first, len(cell))))
        stay = by[rank < self.k]
        full = by[rank == self.k - 1]
        self.kept = (cell[rank < self.k], score[stay], vec_id[stay], row[stay])
        # An equal score may still hold a smaller id, so the bound is the last score kept itself.
        self.low.reshape(-1)[cell[rank == self.k - 1]] = score[full]
        self.least = self.low.min(1)

    def rows(self):
        cell, score, vec_id, row = self.kept
        return cell // self.w, cell % self.w, score, vec_id, row


# ---------------------------------------------------------------------- Spark


def prepared(vectors: DataFrame, label: Column | None = None) -> DataFrame:
    """Rows that take part: row, vec_id, label and x (whole numbers)."""
    number = lambda v: F.floor(v.cast("double") * SCALE)
    bad = F.exists("embedding", lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) >= F.lit(2.0**54)))
    rows = vectors.where("vec_id is not null and label is not null and embedding is not null")
    too_large = F.exists("embedding", lambda v: (F.abs(v.cast("double")) >= F.lit(2.0**54)) & (F.abs(v.cast("double")) < F.lit(float("inf"))) & ~F.isnan(v))
    rows = rows.withColumn("embedding", F.when(F.coalesce(too_large, F.lit(False)), F.raise_error(F.lit("inner products beyond 64 bits"))).otherwise(F.col("embedding")))
    rows = rows.where(~F.coalesce(bad, F.lit(True)))
    return rows.select(
        F.monotonically_increasing_id().alias("row"),
        F.col("vec_id").cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.transform("embedding", number).cast("array<bigint>").alias("x"),
    )


def _matrix(column, width: int) -> np.ndarray:
    """Rows of whole numbers, zeros behind the shorter ones."""
    sizes = np.array([len(v) for v in column], np.int64)
    out = np.zeros((len(column), width), np.int64)
    if len(column) and (sizes == width).all():
        return np.stack(column.to_numpy()).astype(np.int64).reshape(len(column), width)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _small(x: np.ndarray) -> np.ndarray:
    most = int(np.abs(x).max(initial=0))
    return x.astype(np.int16 if most < 2**15 else np.int32 if most < 2**31 else np.int64)


def blocks(rows: DataFrame, width: int) -> tuple[DataFrame, int]:
    """The index: one row a block, (block, data), and the number of blocks. Every row is in it."""
    count = rows.count()
    pivots = max(1, min(PIVOTS, -(-count // BLOCK)))
    some = rows.orderBy(F.xxhash64("row"), "row").limit(pivots).select("x").toPandas()
    centres = _matrix(some["x"], width).astype(np.float64)
    half = (centres**2).sum(1) / 2

    def nearest(frames):
        for pdf in frames:
            x = _matrix(pdf["x"], width).astype(np.float64)
            yield pdf.assign(pivot=(x @ centres.T - half).argmax(1).astype(np.int32) if len(x) else np.zeros(0, np.int32))

    placed = written(rows.mapInPandas(nearest, "row long, vec_id long, label long, x array<bigint>, pivot int"))
    held = {r["pivot"]: r["n"] for r in placed.groupBy("pivot").agg(F.count("*").alias("n")).collect()}
    parts, base, total = [], [], 0
    for p in sorted(held):
        n = max(1, -(-held[p] // BLOCK))
        parts += [F.lit(p), F.lit(n)]
        base += [F.lit(p), F.lit(total)]
        total += n
    if not total:
        return placed.select(F.lit(0).alias("block"), F.lit(None).cast("binary").alias("data")).limit(0), 0
    part = F.pmod(F.xxhash64("row"), F.element_at(F.create_map(*parts), F.col("pivot")).cast("long"))
    block = (F.element_at(F.create_map(*base), F.col("pivot")) + part).cast("int")

    def built(key, pdf):
        x = _matrix(pdf["x"], width)
        tree = cover_tree(x)
        by = tree.pop("order")
        data = {"tree": tree, "x": _small(x[by])} | {c: pdf[c].to_numpy(np.int64)[by] for c in ("row", "vec_id", "label")}
        return pd.DataFrame({"block": [key[0]], "data": [pickle.dumps(data, protocol=5)]})

    trees = placed.withColumn("block", block).groupBy("block").applyInPandas(built, "block int, data binary")
    return written(trees), total


def _cells(index: DataFrame, count: int, packed: DataFrame, groups: int, same: bool, k: int) -> DataFrame:
    """Every block meets every group of anchors: the best ``k`` of each window in each cell."""

    def cell(left, right):
        if not len(left) or not len(right):
            return pd.DataFrame({c: np.zeros(0, np.int64) for c in ("anchor", "window", "score", "other_id", "other")})
        block, group = pickle.loads(left["data"].iloc[0]), pickle.loads(right["data"].iloc[0])
        at, window, score, vec_id, row = search(block, group["x"].astype(np.int64), group["label"], group["row"], group["low"], group["high"], same, k)
        return pd.DataFrame({"anchor": group["row"][at], "window": window, "score": score, "other_id": vec_id, "other": row})

    left = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
    right = packed.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    met = left.groupBy("block", "group").cogroup(right.groupBy("block", "group"))
    met = met.applyInPandas(cell, "anchor long, window long, score long, other_id long, other long")
    ranked = Window.partitionBy("anchor", "window").orderBy(F.desc("score"), "other_id", "other")
    return met.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k)


def _packed(anchors: DataFrame, groups: int, width: int) -> DataFrame:
    """One row a group of anchors; ``positives`` (window, score), if there, make the windows."""
    scored = "positives" in anchors.columns

    def pack(key, pdf):
        if scored:
            scores = np.full((len(pdf), POSITIVES), _NONE, np.int64)
            for i, found in enumerate(pdf["positives"]):
                for p in found:
                    scores[i, p["window"]] = p["score"]
            wide = np.abs(np.where(scores == _NONE, 0, scores)).max(initial=0) >= 2**55
            s = scores.astype(object) if wide else scores
            none = scores == _NONE
            low = np.where(none, 1, -(-np.where(none, 0, s) * LOW // 100)).astype(np.int64)
            high = np.where(none, 0, np.where(none, 0, s) * HIGH // 100).astype(np.int64)
        else:
            low, high = np.full((len(pdf), 1), _NONE + 1), np.full((len(pdf), 1), np.iinfo(np.int64).max)
        data = {"x": _small(_matrix(pdf["x"], width)), "low": low, "high": high} | {c: pdf[c].to_numpy(np.int64) for c in ("row", "label")}
        return pd.DataFrame({"group": [key[0]], "data": [pickle.dumps(data, protocol=5)]})

    group = F.pmod(F.xxhash64("row"), F.lit(groups).cast("long")).cast("int")
    return written(anchors.withColumn("group", group).groupBy("group").applyInPandas(pack, "group int, data binary"))


def mine(vectors: DataFrame, is_anchor: Column, label: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` and ``label`` are expressions over the columns of ``vectors`` (vec_id, label,
    embedding); ``label`` replaces the given one.
    """
    rows = written(prepared(vectors, label))
    width = rows.agg(F.max(F.size("x")).alias("w")).first()["w"] or 0
    anchors = rows.where(is_anchor)
    many = anchors.count()
    groups = max(1, -(-many // GROUP))
    index, count = blocks(rows, width)
    empty = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    if not count or not many:
        return vectors.sparkSession.createDataFrame([], empty)
    positives = _cells(index, count, _packed(anchors, groups, width), groups, True, POSITIVES)
    positives = written(positives.select("anchor", (F.col("rank") - 1).alias("window"), "score", F.col("other_id").alias("positive_id")))
    of_anchor = positives.groupBy("anchor").agg(F.collect_list(F.struct("window", "score")).alias("positives"))
    searching = anchors.join(of_anchor, anchors["row"] == of_anchor["anchor"]).drop("anchor")
    found = _cells(index, count, _packed(searching, groups, width), groups, False, NEGATIVES)
    found = found.select("anchor", "window", F.col("rank").cast("int").alias("rank"), F.col("other_id").alias("negative_id"), F.col("score").alias("negative_score"))
    named = anchors.select(F.col("row").alias("anchor"), F.col("vec_id").alias("anchor_id"))
    out = found.join(positives.withColumnRenamed("score", "positive_score"), ["anchor", "window"]).join(named, "anchor")
    return out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
