"""Near duplicates by shingle similarity against brute force over all pairs."""

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

import corpus_pipeline
from voxelspark.llm import simhash_dedup


def shingles(text):
    words = text.lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def survivors(rows):
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in combinations(sorted(sets), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i for i in root if find(i) == i}


def planted():
    rng = np.random.default_rng(21)
    words = ["".join(rng.choice(list("abcdefghij"), 6)) for _ in range(2000)]
    rows = []
    for k in range(60):
        text = rng.choice(words, 150).tolist()
        rows.append((len(rows), " ".join(text)))
        for edits in (1, 2, 3, 9)[: k % 5]:
            near = list(text)
            for at in rng.choice(150, edits, replace=False):
                near[at] = str(rng.choice(words))
            rows.append((len(rows), " ".join(near)))
    text = rng.choice(words, 150).tolist()  # one large group of near copies
    for _ in range(80):
        near = list(text)
        for at in rng.choice(150, 2, replace=False):
            near[at] = str(rng.choice(words))
        rows.append((len(rows), " ".join(near)))
    return rows


def test_stage_takes_five_words_and_similarity(spark):
    rows = planted()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in corpus_pipeline.distinct_fingerprints(spark, docs, "").select("doc_id").collect()}
    want = survivors(rows)
    assert want <= got and len(got - want) <= 0.03 * (len(rows) - len(want))


def test_large_keys_and_missing_values(spark):
    """A window of eight rows under each key still joins the large group; nulls stand for the empty text."""
    rows = planted()[-80:]
    docs = spark.createDataFrame([*rows, (None, None), (9000, ""), (None, " ".join("abcdefghijk"))], "doc_id long, text string")
    got = [r["doc_id"] for r in simhash_dedup.deduplicated(docs, limit=8).select("doc_id").collect()]
    assert sum(i is not None and i < 9000 for i in got) <= 4 and 9000 in got and got.count(None) == 2
    assert simhash_dedup.deduplicated(docs.where(F.lit(False))).count() == 0


def test_no_pair_is_left_out(spark):
    """The groups of brute force over all pairs, whatever the first round meets and which shingles are frequent."""
    rows = planted()
    rng = np.random.default_rng(5)
    text = rows[0][1].split()
    for _ in range(150):  # a family too unlike for one group, with a few pairs that are alike
        near = list(text)
        for at in rng.choice(150, 8, replace=False):
            near[at] = f"w{rng.integers(10**6)}"
        rows.append((len(rows), " ".join(near)))
        if rng.random() < 0.1:
            near[3] = "other"
            rows.append((len(rows), " ".join(near)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = survivors(rows)
    got = {r["doc_id"] for r in simhash_dedup.deduplicated(docs, limit=1).select("doc_id").collect()}
    assert got == want


def test_pairs_at_the_least_similarity(spark):
    """Pairs that share 178 of 222 shingles, far apart in their fingerprints: all are joined."""
    rng, rows = np.random.default_rng(8), []
    for k in range(400):
        text = [f"a{x}" for x in rng.integers(10**7, size=204)]
        near = text[:90] + [f"b{x}" for x in rng.integers(10**7, size=18)] + text[108:]
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r["doc_id"] for r in simhash_dedup.deduplicated(docs).select("doc_id").collect()} == {2 * k for k in range(400)}


def test_pairs_that_share_many_keys_are_given_once():
    """Ten sets of different roots under ten keys, each key a task of its own: 45 pairs, not 45 a key."""
    node, n, keys = np.arange(10), np.full(10, 100), np.arange(1, 11) * 7
    given = []
    for pos, key in enumerate(keys):
        e1, e2 = (int(keys[pos - k]) if pos >= k else 0 for k in (1, 2))
        columns = {"key": [key] * 10, "node": node, "n": n, "pos": np.full(10, pos), "bits": [b"\xff" * 128] * 10, "root": node, "e1": [e1] * 10, "e2": [e2] * 10}
        batch = pa.RecordBatch.from_pydict(columns)
        given += [(a, b) for out in simhash_dedup._met(0.8, None)([batch]) for a, b in zip(out["a"].to_pylist(), out["b"].to_pylist())]
    assert sorted(given) == list(combinations(range(10), 2))
