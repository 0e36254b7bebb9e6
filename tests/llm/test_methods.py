"""Operators against brute force, round trips, SQL and held-out rows."""

import hashlib
import re
import zlib
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from voxelspark.llm import bpe, decontamination, exact_dedup, html_extraction, language_id, lm_scoring, pii, simhash_dedup, toxicity, url_filter
from test_similarity import survivors
from workload.compare import check, oracle_connection

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


def test_registered():
    names = set(entry.queries())
    assert "pipeline" in names
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11))


def test_exact_dedup_sql(spark):
    name = "op2_cuckoo_exact_dedup"
    got = check(spark, oracle_connection(SF), SF, name, entry.queries()[name], entry.oracle_sql()[name])
    assert got.startswith("ok"), got


# ------------------------------------------------------------------------- cuckoo filter


def keys(n, seed):
    return np.random.default_rng(seed).integers(0, 256, (n, 32)).astype(np.uint8)


def test_cuckoo_inserts_deletes_and_grows():
    shard, some, other = exact_dedup.CuckooShard(4), keys(5000, 1), keys(5000, 2)
    for at in range(0, 5000, 700):
        shard.insert(some[at : at + 700])
    assert len(shard.prints) * 4 >= 5000  # it overflowed and was resized
    assert (shard.find(some) >= 0).all() and (shard.find(other) < 0).all()
    assert shard.delete(some[:2000]).all() and not shard.delete(other[:10]).any()
    assert (shard.find(some[:2000]) < 0).all() and (shard.find(some[2000:]) >= 0).all()
    shard.insert(some[:100])
    assert (shard.find(some[:100]) >= 0).all()


def test_index_table(spark):
    rows = [(bytes(k), True, 1) for k in keys(300, 3)]
    changes = spark.createDataFrame(rows, "digest binary, live boolean, seq int")
    index = exact_dedup.apply_changes(None, changes, 3)
    later = spark.createDataFrame([(r[0], False, 2) for r in rows[:50]] + [(bytes(k), True, 2) for k in keys(20, 4)], "digest binary, live boolean, seq int")
    index = exact_dedup.apply_changes(index, later, 3)
    asked = exact_dedup.probe(index, changes, 3)
    known = {bytes(r["digest"]): r["known"] for r in asked.collect()}
    assert [known[r[0]] for r in rows] == [False] * 50 + [True] * 250


# ------------------------------------------------------------------------------- simhash


def brute_fingerprint(text):
    words = text.encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def classes(fps, bits):
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(sorted(fps), 2):
        if (a ^ b).bit_count() <= bits:
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {f: find(f) for f in fps}


def test_near_groups_brute_force(docs, texts):
    fps = {i: brute_fingerprint(t) for i, t in texts.items()}
    root = classes(set(fps.values()), 2)
    least = {}
    for i, f in fps.items():
        least[root[f]] = min(i, least.get(root[f], i))
    want = {(i, format(f, "016x"), least[root[f]]) for i, f in fps.items()}
    assert {tuple(r) for r in simhash_dedup.near_groups(docs).collect()} == want


@pytest.mark.parametrize("limit", [2048, 3])
def test_links_join_the_same_groups(spark, limit):
    """Dense and sparse fingerprints; with a low limit the hot keys take the other way."""
    rng = np.random.default_rng(5)
    base = rng.integers(0, 2**63, 12).tolist()
    fps = set(base)
    for b in base[:6]:
        for _ in range(12):
            for k in rng.integers(0, 64, rng.integers(1, 4)):
                b ^= 1 << int(k)
            fps.add(b % 2**64)
    signed = [f - 2**64 if f >= 2**63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = simhash_dedup.links(df, limit=limit)
    got = {r["node"]: r["root"] for r in simhash_dedup.components(links).collect()}
    groups = {}
    for f in signed:
        groups.setdefault(got.get(f, f), set()).add(f % 2**64)
    want = {}
    for f, r in classes(fps, 2).items():
        want.setdefault(r, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_components_of_a_chain(spark):
    edges = [(i, i + 1) for i in range(200)] + [(1000, 1001), (1002, 1001)]
    got = {r["node"]: r["root"] for r in simhash_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 201)}, 1001: 1000, 1002: 1000}


# ----------------------------------------------------------------------------------- bpe

ODD = [
    "", " ", "\n\n a", "don't we'll  it's", "a<|endoftext|>b <|endoftext|>", "ñandú ½ 三 ‍ 👩‍👩‍👧", "x" * 3000, "tab\tand nbsp   wide", "1234 56,7 é", "\r\n\r\n  end  ",
]


def test_bpe_as_the_library(spark, docs):
    from tokenizers import Tokenizer

    lib = Tokenizer.from_file(bpe.vocabulary())
    odd = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(ODD)], "doc_id long, text string")
    every = docs.select("doc_id", "text").unionByName(odd)
    got = {r["doc_id"]: r for r in bpe.digests(every, block=20_000).collect()}
    for r in every.collect():
        ids = lib.encode(r["text"] or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want = len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()
        assert tuple(got[r["doc_id"]])[1:] == want, r["text"][:80]


def test_bpe_round_trip(spark):
    rows = spark.createDataFrame(list(enumerate(ODD)), "doc_id long, text string")
    back = {r["doc_id"]: r["text"] for r in bpe.decode_ids(bpe.encode(rows)).collect()}
    assert back == dict(enumerate(ODD))


# ----------------------------------------------------------------------- decontamination


def spoiled(item, rate, rng):
    words = item.tolist()
    for _ in range(int(rate * len(item))):
        at, kind = int(rng.integers(0, len(words))), rng.integers(0, 3)
        if kind == 0:
            words[at] = int(rng.integers(1, 2**63))
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, int(rng.integers(1, 2**63)))
    return np.array(words, np.uint64)


def brute_distance(a, b):
    row = list(range(len(b) + 1))
    row = [0] * len(row)
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j - 1] + (x != y), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_edit_distance():
    rng = np.random.default_rng(1)
    for _ in range(60):
        a, b = rng.integers(0, 4, rng.integers(1, 9)), rng.integers(0, 4, rng.integers(0, 14))
        d, left, right = decontamination.edit_distance(a.astype(np.uint64), b.astype(np.uint64))
        assert d == brute_distance(a.tolist(), b.tolist())
        assert brute_distance(a.tolist(), b[left:right].tolist()) == d


def test_recall_of_spoiled_items(spark):
    rows = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    index, rng = decontamination.Index(list(range(len(rows))), rows), np.random.default_rng(2)
    pool, found, total = np.concatenate(index.items), 0, 0
    for rate in (0.0, 0.1, 0.2):
        for k, item in enumerate(index.items):
            if len(item) < 14:
                continue
            words = np.concatenate([rng.choice(pool, 40), spoiled(item, rate, rng), rng.choice(pool, 40)])
            hits = decontamination.matches(index, words, np.array([0, len(words)]))
            assert all(d <= 0.2 * len(index.items[i]) for _, i, d, _, _ in hits)
            found, total = found + any(i == k for _, i, *_ in hits), total + 1
    assert found / total >= 0.95


def test_exact_leaks_all_found(spark, docs, texts):
    def plain(t):
        return " " + " ".join(re.sub(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t)).split()) + " "

    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = {r["item_id"]: plain(r["text"]) for r in bench.collect()}
    want = {(i, k) for i, t in texts.items() for k, item in items.items() if item in plain(t)}
    got = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert want and want <= got


# ---------------------------------------------------------------------------- models


def test_language_held_out(docs, spark):
    big = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(big).join(big.select("doc_id", "lang"), "doc_id").where("held_out")
    row = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int")), F.min("score"), F.max("score")).first()
    assert row[0] > 0.97 and row[1] >= 0 and row[2] <= 1


def test_language_prototypes_do_not_depend_on_partitions(docs):
    a, b = language_id.learn(docs), language_id.learn(docs.repartition(7))
    assert all(np.array_equal(a[k], b[k]) for k in a)


def test_language_ignores_the_held_out_fold(docs):
    other = docs.withColumn("lang", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit("xx")).otherwise(F.col("lang")))
    assert "xx" not in language_id.learn(other)


@pytest.mark.parametrize("known", [1 << 18, 300, 0])
def test_lm_base_and_gain(docs, texts, known):
    import collections
    import math

    def words(t):
        return t.encode().lower().split() + [b"\n"]

    out = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i in texts}
    c = collections.Counter(w for i, t in texts.items() if not out[i] for w in words(t))
    n, v = sum(c.values()), len(c)
    got = {r["doc_id"]: r for r in lm_scoring.score(docs, known=known, vocabulary=200).collect()}
    for i, t in texts.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (out[i], len(words(t)), sum(c[w] > 0 for w in words(t)), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[w] + 0.1) / (n + 0.1 * (v + 1))) for w in words(t)), rel=1e-9)
    assert known == 0 or sum(got[i]["score"] - got[i]["base_score"] for i in texts if not out[i]) > 0


def test_network_is_a_distribution_and_carries_its_state():
    rng = np.random.default_rng(3)
    net = lm_scoring.Network(20, 4, np.arange(20, 0, -1).astype(float), hidden=8)
    states = rng.normal(size=(1, 8)).astype(np.float32)
    every = np.arange(net.ids)
    chances = np.exp(net.log_chances(np.repeat(states, net.ids, axis=0), every))
    assert chances.sum() == pytest.approx(1, abs=1e-5)
    tokens, first = rng.integers(0, net.ids, 300), np.array([0, 200, 200, 300])
    a, b = net.score(tokens, first, window=7, lanes=2), net.score(tokens, first, window=64, lanes=1)
    assert np.allclose(a, b, atol=1e-3) and a[1] == 0
    again = lm_scoring.Network.loaded(net.dumped())
    assert np.allclose(again.score(tokens, first), net.score(tokens, first), atol=1e-4)


def test_network_gradients():
    rng = np.random.default_rng(4)
    net = lm_scoring.Network(6, 2, np.ones(6), hidden=4)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y, real, fresh, _ = lm_scoring.laned(rng.integers(0, net.ids, 24), np.array([0, 10, 24]), net.ids - 1, 2)
    h = np.zeros((2, 4))
    g, _, _ = net.gradients(x, y, real, fresh, h)
    for name in ("U", "E", "W", "C", "b"):
        at = tuple(rng.integers(0, s) for s in net.p[name].shape)
        if name == "E":
            at = (int(x[1, 0]), at[1])
        losses = []
        for eps in (1e-4, -1e-4):
            net.p[name][at] += eps
            losses.append(net.gradients(x, y, real, fresh, h)[1])
            net.p[name][at] -= eps
        assert g[name][at] == pytest.approx((losses[0] - losses[1]) / 2e-4, abs=1e-4)


def test_toxicity_finds_marked_words(spark):
    rng = np.random.default_rng(6)
    plain = ["".join(rng.choice(list("abcdefgh"), 5)) for _ in range(300)]
    rows = []
    for i in range(1500):
        words = rng.choice(plain, 40).tolist()
        if i % 5 == 0:
            words[int(rng.integers(0, 40))] = str(rng.choice(["Moron", "zzstupid,", "clownish"]))
        rows.append((i, " ".join(words), int(i % 5 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    got = toxicity.score(df.select("doc_id", "text"), df.select("doc_id", "toxic")).join(df, "doc_id").where("held_out")
    row = got.agg(F.avg((F.col("predicted") == F.col("toxic")).cast("int")), F.count("*")).first()
    assert row[0] > 0.97 and row[1] > 200


def test_ftrl_is_sparse():
    model, rng = toxicity.FTRL(1 << 12), np.random.default_rng(7)
    for i in range(400):
        at = np.unique(rng.integers(100, 4000, 30))
        model.step(np.append(at, 5) if i % 4 == 0 else at, int(i % 4 == 0))
    at, w, _ = model.model()
    assert 5 in at and w[list(at).index(5)] == w.max() and len(at) < 400


# ------------------------------------------------------------------------------------ pii

# The contract's patterns as they stand.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    s = 0
    for i, ch in enumerate(reversed(d)):
        v = int(ch) * (1 + i % 2)
        s += v - 9 if v > 9 else v
    return s % 10 == 0


def base_spans(t):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, t):
            d = re.sub("[^0-9]", "", m[0])
            good = {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m[0].split(".")), "card": 16 <= len(d) <= 19 and luhn(d), "phone": 8 <= len(d) <= 15}
            if good[kind]:
                out.append(f"{kind}:{m.start()}:{m.end()}")
    return out


def test_base_spans_brute_force(spark, docs):
    rng = np.random.default_rng(8)
    bits = ["4111111111111111", "4111 1111 1111 1111", "1.2.3.4", "1.2.3.4.5.6.7.8", "300.1.1.1", "a@b.c", "a@b.c_d@e.f", "x+y@z-1.co.uk", "@", ".", "-", " ", "+", "+49 (30) 123-4567", "+1", "é", "😀", "12", "0000000000000000", "_", "%", "a", "--", "\n"]
    rows = [(i, "".join(rng.choice(bits, 12))) for i in range(600)]
    every = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select(F.col("doc_id") + 1000, "text").toDF("doc_id", "text"))
    want = {r["doc_id"]: base_spans(r["text"] or "") for r in every.collect()}
    for r in pii.find(every).collect():
        own = want[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(",".join(own).encode()).hexdigest()
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s.startswith(k) for s in own) for k in pii.KINDS]
        assert set(own) <= set(r["spans"].split(",")) | {""}


def test_boosting_adds_what_looks_like_personal_data(spark):
    rng = np.random.default_rng(9)
    rows = []
    for i in range(900):
        tail = f"{rng.integers(200, 999)}) 555-{rng.integers(1000, 9999)}"
        text = f"please call +1 ({tail} today" if i % 3 else f"in all 12 of 34 or {rng.integers(1, 99)} things"
        rows.append((i, f"please call 1 ({tail} today" if i == 0 else text))
    got = {r["doc_id"]: r for r in pii.find(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[0]["n_phone"] == 0 and "phone:" in got[0]["spans"]
    assert all(r["spans"] == "" for i, r in got.items() if i % 3 == 0 and i)


# ----------------------------------------------------------------------------------- html


def test_marginals_brute_force():
    rng = np.random.default_rng(10)
    model = html_extraction.TreeModel()
    model.w, model.edge = rng.normal(size=len(html_extraction.FEATURES)), rng.normal(size=(2, 2))
    parent, x = [-1, 0, 0, 1, 1, 4], rng.normal(size=(6, len(html_extraction.FEATURES)))
    node, pairs, z = model.marginals(parent, x)
    total, on, both = 0.0, np.zeros(6), np.zeros((2, 2))
    for state in np.ndindex(*[2] * 6):
        p = np.exp(sum(s * (x[i] @ model.w) for i, s in enumerate(state)) + sum(model.edge[state[parent[i]], state[i]] for i in range(1, 6)))
        total += p
        on += p * np.array(state)
        for i in range(1, 6):
            both[state[parent[i]], state[i]] += p
    assert z == pytest.approx(np.log(total)) and np.allclose(node, on / total) and np.allclose(pairs, both / total)


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var a="<p>no</p>";</script></head><body>
<header><a href="/">Logo</a><nav><ul><li><a href="/a">One</a><li><a href="/b">Two</a></ul></nav></header>
<div class="cookie-notice"><p>We use cookies on this site.</p></div>
<main><article><h1>A  title</h1><p>First <b>bold</b> paragraph &amp; more,<br>with a break and enough words to be read.
<p>Second paragraph with a <a href="#">link</a> and quite a few words in it.</p><ul><li>An item of the list</li></ul></article></main>
<aside class="sidebar"><p>Read this too</p></aside><section class="comments"><div class="comment"><p>Great article, thanks for it!</p></div></section>
<form><label>Mail</label><button>Go</button></form><footer>&copy; 2024 somebody</footer></body></html>"""


def test_main_text_of_a_page():
    want = "A title\nFirst bold paragraph & more, with a break and enough words to be read.\nSecond paragraph with a link and quite a few words in it.\nAn item of the list"
    assert html_extraction.main_text(PAGE, html_extraction.trained()) == want


def test_pages_of_the_corpus(spark):
    """On these pages the article element holds the text; the model is not told so."""
    import html as entities

    for r in html_extraction.extract(spark.read.parquet("/root/testdata/sf0.01/pages.parquet")).join(spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("page_id", "html"), "page_id").collect():
        inner = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.S)[1]
        blocks = [" ".join(entities.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r["text"] == "\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


def test_fresh_layouts():
    rng, model, right, total = np.random.default_rng(11), html_extraction.trained(), 0, 0
    for layout in html_extraction.LAYOUTS * 4:
        page, labels = html_extraction.labelled_page(layout, rng)
        nodes, pieces = html_extraction.parse(page)
        html_extraction.measured(nodes, pieces)
        own, parents, x = html_extraction.tree(nodes)
        got = model.marginals(parents, x)[0] >= 0.5
        right, total = right + sum(g == labels[i] for g, i in zip(got, own) if nodes[i].text), total + sum(nodes[i].text > 0 for i in own)
    assert right / total > 0.95


# ------------------------------------------------------------------------------------ urls


def test_rules_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r in url_filter.judge(pages).join(pages.select("page_id", "url"), "page_id").collect():
        host = path = ""
        if "://" in (r["url"] or ""):
            host, path = re.match(r"([^/?#]*)([^?#]*)", r["url"].split("://", 1)[1]).groups()
        host = host.lower()
        fits = [(len(rule), rule, v) for v, rule in url_filter.RULES for h, p in [rule.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
        best = max(fits, default=(0, None, None))
        assert (r["host"], r["path"], r["rule"]) == (host, path, best[1])
        assert r["verdict"] == best[2] if best[1] else r["verdict"] in ("allow", "block")


def test_url_model_against_brute_force(spark):
    """The scores of the DataFrame model equal a dictionary version of the same recursion."""
    import collections
    import math

    rng = np.random.default_rng(12)
    urls = ["".join(rng.choice(list("abc/."), rng.integers(3, 12))) for _ in range(120)]
    rows = [("^^^" + u + "$", "allow" if i % 2 else "block", 1) for i, u in enumerate(dict.fromkeys(urls))]
    df = spark.createDataFrame(rows, "text string, kind string, n long")
    got = {r["text"]: r["score"] for r in url_filter.scored(df, url_filter.models(df.limit(80))).collect()}
    used = {r["text"]: r["kind"] for r in df.limit(80).collect()}
    counts = {k: [collections.Counter() for _ in range(4)] for k in ("allow", "block")}
    for t, kind in used.items():
        for i in range(3, len(t)):
            for k in range(4):
                counts[kind][k][t[i - k : i + 1]] += 1

    def chance(kind, gram):
        k = len(gram) - 1
        c = counts[kind][k]
        if k == 0:
            return (c[gram] + 0.5) / (sum(c.values()) + 0.5 * 41)
        after = {g: n for g, n in c.items() if g[:-1] == gram[:-1]}
        lower = chance(kind, gram[1:])
        if not after:
            return lower
        return (c[gram] + len(after) * lower) / (sum(after.values()) + len(after))

    seen0 = set(counts["allow"][0]) | set(counts["block"][0])
    for t, s in got.items():
        if set(t[3:]) <= seen0:
            want = np.mean([math.log(chance("allow", t[i - 3 : i + 1]) / chance("block", t[i - 3 : i + 1])) for i in range(3, len(t))])
            assert s == pytest.approx(want, abs=1e-9)


# -------------------------------------------------------------------------------- pipeline


def test_pipeline_brute_force(spark, docs, texts, tmp_path):
    got = {r["doc_id"] for r in corpus_pipeline.run(spark, SF).select("doc_id").collect()}
    lang = {r["doc_id"] for r in language_id.identify(docs).where("lang_pred <> 'und' and score > 0").collect()}
    first = {}
    for i in sorted(lang):
        first.setdefault(re.sub(r"[\x20\x09-\x0d]+", " ", texts[i]), i)
    kept = set(first.values())
    kept = survivors([(i, texts[i]) for i in sorted(kept)])  # five-word shingles, similarity 0.8
    leaks = decontamination.contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).select("doc_id").collect()
    assert got == kept - {r["doc_id"] for r in leaks}


def test_training_grows_and_averages(spark, docs, monkeypatch):
    """Replicas in tasks of their own: one network comes out, near the one of a single replica."""
    counted = lm_scoring.counts(docs)
    lex, total = lm_scoring.lexicon(counted, 300), sum(r["c"] for r in counted.collect())
    opens = np.ones(lm_scoring.SHAPES + 1)
    monkeypatch.setattr(lm_scoring, "AVERAGED", 2)
    start = lm_scoring.Network(lex.closed, lm_scoring.CLASSES, lex.share, opens)
    one, many = (lm_scoring.Network.loaded(lm_scoring.train(docs, lex, opens, total, share=0.5, replica=r)) for r in (10**9, total // 30))
    assert all(np.abs(many.p[k] - start.p[k]).max() > 0 for k in ("E", "U", "C", "W"))
    rng = np.random.default_rng(1)
    tokens, first = rng.integers(0, start.ids, 500), np.array([0, 500])
    assert np.isfinite([n.score(tokens, first)[0] for n in (one, many)]).all()


def test_replicas_of_one_task_stay_apart():
    """Every training document is learned from, and a task gives one network for each of its replicas."""
    import pyarrow as pa

    class Shared:
        value = (lm_scoring.Lexicon(np.zeros(0, np.uint64), np.zeros(0, np.int64), 0), lm_scoring.Network(0, 1, np.zeros(0)).dumped())

    batches = [pa.RecordBatch.from_pydict({"id": pa.array(i, pa.int32()), "text": t}) for i, t in (([0, 0, 4], ["a b", "c", "d e f"]), ([4, 7], ["g", None]))]
    got = [(b["id"][0].as_py(), b["weight"][0].as_py()) for b in lm_scoring._replica(Shared, 0.01)(iter(batches))]
    assert got == [(0, 5), (4, 6), (7, 1)] and lm_scoring.SHARE == 1
    assert lm_scoring.segments(np.array([0, 3, 10, 12]), 3).tolist() == [0, 3, 6, 9, 10, 12]


def test_averaged_networks_weigh_by_tokens():
    import pandas as pd

    nets = [lm_scoring.Network(6, 2, np.ones(6), hidden=4, seed=s) for s in (1, 2)]
    rows = pd.DataFrame({"id": [1, 0], "weight": [3, 1], "net": [n.dumped() for n in nets]})
    out = lm_scoring.Network.loaded(lm_scoring._averaged((0,), rows)["net"][0])
    for k in out.p:
        assert np.allclose(out.p[k], 0.75 * nets[0].p[k] + 0.25 * nets[1].p[k], atol=1e-6)


def test_language_of_documents_beyond_two_million_trigrams(spark):
    long = "ein langer text mit vielen worten und noch mehr davon " * 45_000
    rows = [(i, t, n) for i, (t, n) in enumerate([(long, "de"), ("the quick brown fox and the other dogs", "en")] * 4)]
    docs = spark.createDataFrame([(i, t, n) for i, t, n in rows], "doc_id long, text string, lang string")
    learned = language_id.learn(docs)
    assert set(learned) == {"de", "en"} and all(np.linalg.norm(v) == pytest.approx(1) for v in learned.values())
    langs, scores = language_id.predict(["mit vielen worten und noch mehr", "the brown dogs"], learned)
    assert langs == ["de", "en"] and (scores > 0.3).all()
