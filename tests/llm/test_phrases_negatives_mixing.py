"""Phrases, hard negatives and mixing: SQL, brute force and the defined cases."""

import itertools
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from voxelspark.llm import hard_negatives, mixing, phrases
from workload.compare import check, oracle_connection

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.mark.parametrize("name", ["op11_phrase_stripes", "op12_cover_tree_negatives", "op13_hash_threshold_mixing"])
def test_sql(spark, name):
    got = check(spark, oracle_connection(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert got.startswith("ok"), got


# ---------------------------------------------------------------------------- phrases


def brute_phrases(rows, least, top):
    counts, n = Counter(), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0a-\x0d]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, 6):
                for i in range(len(w) - k + 1):
                    counts[lang, tuple(w[i : i + k])] += 1
    frequent = {p: a for p, a in counts.items() if a >= least and len(p[1]) > 1}
    inside = defaultdict(int)
    for (lang, p), a in frequent.items():
        for i, j in itertools.combinations(range(len(p) + 1), 2):
            if j - i < len(p):
                inside[lang, p[i:j]] = max(inside[lang, p[i:j]], a)
    out = defaultdict(list)
    for (lang, p), a in frequent.items():
        if 100 * inside[lang, p] >= 100 * a:
            continue
        score, k = min((1000 * a * n[lang] // (counts[lang, p[:k]] * counts[lang, p[k:]]), k) for k in range(1, len(p)))
        out[lang].append((-score, -a, " ".join(p).encode(), a, counts[lang, p[:k]], counts[lang, p[k:]]))
    return {(lang, i + 1, x[2].decode(), x[3], x[4], x[5], n[lang], -x[0]) for lang, found in out.items() for i, x in enumerate(sorted(found)[:top])}


def test_phrases_brute_force(spark):
    rng = random.Random(5)
    words = ["A", "b", "Über", "d'e", " x", "é", "zz"]
    rows = []
    for i in range(300):
        text = "".join(rng.choice(words) + rng.choice([" ", " ", "\t", ". ", "\n", "  ", ", "]) for _ in range(rng.randrange(0, 40)))
        rows.append((i % 50, text, rng.choice(["en", "de", None, "und", ""]), "s", 1))
    rows += [(1, None, "en", "s", 1), (2, "", None, None, None), (None, "no number here " * 40, "en", "s", 1), (7, "w" * 200_000, "en", None, 0), (8, " , . \n", "fr", "s", 1)]
    rows += [(9, "hot prefix one, hot prefix two, hot prefix three", "de", "s", 1)] * 30
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("h", "a", "words", "prefix", "counts", "n")})
    for top, parts in ((2000, 8), (7, 3)):
        got = phrases.collocations(df.repartition(parts, "doc_id"), 20, 5, top)
        assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert {tuple(r) for r in got.collect()} == brute_phrases([(r[1], r[2]) for r in rows], 20, top)
    assert phrases.collocations(df.where("false")).count() == 0


def test_stripes_merge_across_batches(spark, monkeypatch):
    """Small holds and small Arrow batches: stripes of a hot prefix come in many rows."""
    monkeypatch.setattr(phrases, "BLOCK", 200)
    monkeypatch.setattr(phrases, "HELD", 50)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rng = random.Random(6)
        rows = [(i, " ".join(rng.choice("abcdefgh") for _ in range(60)), "en", "s", 1) for i in range(60)]
        got = phrases.collocations(spark.createDataFrame(rows, DOCS), 10, 5, 2000)
        assert {tuple(r) for r in got.collect()} == brute_phrases([(r[1], r[2]) for r in rows], 10, 2000)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_scores_beyond_64_bits(spark):
    row = spark.createDataFrame([(["a", "b"], 4 * 10**12, [5 * 10**12, 4 * 10**12], [6 * 10**12, 4 * 10**12], 9 * 10**13, "en")], "words array<string>, a long, heads array<long>, tails array<long>, n long, lang string")
    got = phrases._scored(row, 2).first()
    assert got["score"] == 1000 * 4 * 10**12 * 9 * 10**13 // (5 * 10**12 * 6 * 10**12)


# ---------------------------------------------------------------------------- negatives


def brute_negatives(rows, every=50):
    """By (vec_id, label, vector) in a list; rows that take part only."""
    rows = [(i, lab, [int(np.floor(256 * float(np.float32(v)))) for v in x]) for i, lab, x in rows]
    out = []
    for a, (i, lab, x) in enumerate(rows):
        if i % every:
            continue
        score = [sum(p * q for p, q in zip(x, y)) for _, _, y in rows]
        order = sorted((b for b in range(len(rows)) if b != a), key=lambda b: (-score[b], rows[b][0], b))
        for p in [b for b in order if rows[b][1] == lab][:5]:
            ok = [b for b in order if rows[b][1] != lab and 50 * score[p] <= 100 * score[b] <= 95 * score[p]][:3]
            out += [(i, rows[p][0], k + 1, rows[b][0], score[p], score[b]) for k, b in enumerate(ok)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<float>, label int"


def clustered(n, seed, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    x = centres[rng.integers(0, 12, n)] + rng.normal(size=(n, dim)) * 0.2
    return [(int(i), int(rng.integers(0, 4)), [float(v) for v in row]) for i, row in enumerate(x)]


def mined(spark, rows):
    df = spark.createDataFrame([(i, x, lab) for i, lab, x in rows], VECTORS).withColumns({c: F.lit("x") for c in ("row", "block", "group", "x", "score", "anchor")})
    return hard_negatives.mine(df, F.col("vec_id") % 50 == 0)


def test_negatives_of_clusters(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK", 300)
    monkeypatch.setattr(hard_negatives, "GROUP", 8)
    monkeypatch.setattr(hard_negatives, "LEAF", 16)
    rows = clustered(1500, 3)
    rows += [(5000 + i, i % 3, rows[0][2]) for i in range(700)]  # one vector of a third of the rows
    assert sorted(tuple(r) for r in mined(spark, rows).collect()) == brute_negatives(rows)


def test_negatives_defined_cases(spark):
    rows = [(0, 1, [1.0, 0.5]), (50, 2, [0.0, 0.0]), (100, 1, [-1.0, -0.5]), (3, 1, [1.0, 0.5]), (4, 1, [1.0]), (5, 2, [0.7, 0.3]), (6, 2, [0.7, 0.3]), (7, 3, [0.6]), (150, 9, [3.0, 3.0])]
    bad = [(None, 1, [1.0, 0.5]), (8, None, [1.0, 0.5]), (9, 1, None), (10, 2, [0.7, None]), (11, 2, [float("nan"), 0.1]), (12, 2, [float("inf"), 0.1])]
    wide = [(i, lab, list(x) + [0.0] * (2 - len(x))) for i, lab, x in rows]
    assert sorted(tuple(r) for r in mined(spark, rows + bad).collect()) == brute_negatives(wide)
    assert mined(spark, bad).count() == 0
    assert mined(spark, [(1, 1, [1.0])]).count() == 0
    with pytest.raises(Exception, match="64 bits"):
        mined(spark, [(0, 1, [1e15]), (1, 1, [1e15])]).collect()


def test_tree_bounds_and_skips():
    x = np.array([r[2] for r in clustered(2000, 4)])
    x = np.floor(256 * x).astype(np.int64)
    tree = hard_negatives.cover_tree(x)
    order = tree["order"]
    assert sorted(order) == list(range(2000))
    own = {"tree": tree, "x": x[order], "row": order, "vec_id": order, "label": np.zeros(2000, np.int64)}
    q = x[:40]
    scores = q @ x.T
    low, high = np.full((40, 1), 1000), np.full((40, 1), 60_000)
    at, _, score, vec_id, _ = hard_negatives.search(own, q, np.ones(40, np.int64), np.full(40, -1), low, high, False, 3)
    for i in range(40):
        fit = sorted((-s, j) for j, s in enumerate(scores[i]) if 1000 <= s <= 60_000)[:3]
        assert [(-s, v) for s, v in zip(score[at == i], vec_id[at == i])] == fit
    # Bounds hold for every node, so skipping is lossless.
    for node, (a, b) in enumerate(tree["slices"]):
        inner = scores[:, order[a:b]] / (np.linalg.norm(q, axis=1) * tree["top"])[:, None]
        c = (q @ tree["centres"][node]) / (np.linalg.norm(q, axis=1) * tree["top"])
        turn = np.arccos(np.clip(c, -1, 1))
        assert (inner.max(1) <= np.cos(np.maximum(turn - tree["angle"][node], 0)) + 1e-6).all()
        assert (inner.min(1) >= np.cos(np.minimum(turn + tree["angle"][node], np.pi)) - 1e-6).all()


# ---------------------------------------------------------------------------- mixing


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, full = {s: 0.0 for s in names}, set()
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in full)
        share = {s: left * weight[s] / max(1, sum(weight[t] for t in names if t not in full)) for s in names if s not in full}
        over = {s for s in share if share[s] > 2 * sizes[s]}
        if not over:
            return {s: share.get(s, 2.0 * sizes[s]) for s in names}
        full |= over


def test_mixing_brute_force(spark):
    rng = random.Random(9)
    rows = [(i, "w " * rng.randrange(0, 60), None, rng.choice(["a", "b", "B", "é", "tiny", None]), 1) for i in range(4000)]
    rows += [(10_000 + i, "w " * 50, None, "hot", 1) for i in range(3000)]
    rows += [(1, None, None, "a", 1), (2, "", None, "only empty", 1), (None, "x y", None, "b", 1), (3, "v " * 90_000, None, "a", 1), (4, "q q", None, "one", 1), (4, "q q", None, "one", 1)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("x") for c in ("key", "place", "size", "taken", "edge", "whole")})
    got = mixing.mix(df).collect()
    assert sorted((r["doc_id"] or -1, r["size"]) for r in got) == sorted((r[0] or -1, len((r[1] or "").split())) for r in rows)
    sizes, taken, least = Counter(), Counter(), {}
    for r in got:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] in (0, r["size"], 2 * r["size"])
    want = brute_targets(sizes)
    assert abs(sum(want.values()) - 1.5 * sum(sizes.values())) < 1e-3
    for r in got:
        assert r["source_size"] == sizes[r["source"]]
        assert abs(r["target"] - want[r["source"]]) < 1e-6
    for s in sizes:
        longest = max([r["size"] for r in got if r["source"] == s])
        assert abs(taken[s] - want[s]) <= (longest if s != "one" else 4)
    again = mixing.mix(df.repartition(5)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))
    assert mixing.mix(df.where("false")).count() == 0


def test_mixing_many_sources(spark):
    """More sources than weights, joined without a broadcast."""
    df = spark.range(3000).select(F.col("id").alias("doc_id"), F.expr("repeat('w ', cast(id % 13 as int))").alias("text"), F.concat(F.lit("s"), F.col("id") % 97).alias("source"))
    small, mixing.SMALL = mixing.SMALL, 0
    try:
        got = mixing.mix(df).collect()
    finally:
        mixing.SMALL = small
    sizes = Counter()
    for r in got:
        sizes[r["source"]] += r["size"]
    want = brute_targets(sizes)
    assert len(got) == 3000 and all(abs(r["target"] - want[r["source"]]) < 1e-6 for r in got)
    for s in sizes:
        assert abs(sum(r["taken"] for r in got if r["source"] == s) - want[s]) <= 6
