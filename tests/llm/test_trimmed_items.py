"""A benchmark item trimmed on both sides, between other documents of its batch."""

import numpy as np

from voxelspark.llm import decontamination


def test_trimmed_item_between_documents(spark):
    rng = np.random.default_rng(31)
    words = ["".join(rng.choice(list("abcdefghij"), 7)) for _ in range(3000)]
    items = [(k, " ".join(rng.choice(words, 40))) for k in range(10)]
    rows = []
    for _, item in items:
        rows += [" ".join(rng.choice(words, 60)), " ".join(item.split()[1:-1]), " ".join(item.split()[3:-3]), "one", ""]
    docs = spark.createDataFrame(list(enumerate([*rows, "the last one"])), "doc_id long, text string").coalesce(1)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["distance"] for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {(5 * k + n, k): d for k in range(10) for n, d in ((1, 2), (2, 6))}
    left = {r["doc_id"] for r in decontamination.clean(docs, bench).select("doc_id").collect()}
    assert left == set(range(51)) - {i for i, _ in got}
