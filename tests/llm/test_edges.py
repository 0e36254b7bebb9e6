"""Every operator on null, empty, repeated, tied, long and strangely named rows, and on empty tables."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from voxelspark.llm import bpe, decontamination, exact_dedup, html_extraction, language_id, lm_scoring, pii, simhash_dedup, toxicity, url_filter

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORDS = "the quick brown fox jumps over the lazy dog near the river bank today"
ROWS = [
    (1, "Hello world, write to a.b@mail.example.com or +1 (389) 555-5010.", "en", "s", 1),
    (2, None, "en", "s", 0),
    (3, "", None, None, None),
    (4, " \t\n ", "en", "s", 3),
    (5, "Hello  world", "en", "s", 1),
    (6, "Hello world", "en", "s", 1),
    (6, "Hello world", "en", "s", 1),
    (None, "Hello world", "en", "s", 1),
    (None, None, None, None, None),
    (7, "x" * 50_000, "de", "s", 1),
    (8, ("Der Hund läuft über die Straße und " * 3000), "de", "s", 1),
    (9, "El niño está aquí <|endoftext|> 4111 1111 1111 1111", "es", "s", 1),
    (10, f"before {WORDS} after", "en", "s", 1),
    (11, "12345 !!! 192.168.0.1 999.1.1.1", "en", "s", 1),
]


@pytest.fixture(scope="module")
def docs(spark):
    # Extra columns whose names the operators use themselves.
    df = spark.createDataFrame(ROWS, DOCS)
    return df.withColumns({c: F.lit("x") for c in ("digest", "keep_id", "fp", "score", "key", "word", "held_out", "place", "block", "e", "a")})


@pytest.fixture(scope="module")
def empty(docs):
    return docs.where("false")


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (5, 1, 1), (6, 0, None), (7, None, 0), (None, 1, 1), (5, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, WORDS), (2, None), (3, ""), (4, WORDS)], "item_id long, text string")


@pytest.fixture(scope="module")
def pages(spark):
    rows = [(1, "http://a.com/en/1", "<p>x</p>"), (2, None, None), (None, "no scheme", ""), (3, "HTTP://B.Org/es/x?q#f", "plain"), (3, "HTTP://B.Org/es/x?q#f", "plain"), (4, "https://", "<div" + "<p>y" * 2000)]
    return spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("t")).withColumn("rule", F.lit("r")).withColumn("gram", F.lit("g"))


OPERATORS = {
    "lm": lambda d, **k: lm_scoring.score(d),
    "exact": lambda d, **k: exact_dedup.exact_groups(d),
    "toxicity": lambda d, **k: toxicity.score(d, k["labels"]),
    "pii": lambda d, **k: pii.find(d),
    "language": lambda d, **k: language_id.identify(d),
    "simhash": lambda d, **k: simhash_dedup.near_groups(d),
    "bpe": lambda d, **k: bpe.digests(d),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_row(docs, labels, name):
    rows = OPERATORS[name](docs, labels=labels).collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r[0]) for r in ROWS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(empty, labels, name):
    assert OPERATORS[name](empty, labels=labels.where("false")).collect() == []


def test_defined_results(docs):
    exact = {(r["doc_id"], r["text_sha256"]): r for r in exact_dedup.exact_groups(docs).collect()}
    hello = [r for r in exact.values() if r["group_size"] == 4]
    assert {r["doc_id"] for r in hello} == {5, 6, None} and {r["keep_id"] for r in hello} == {5}
    assert [r["doc_id"] for r in hello if r["kept"]] == [5]
    near = {r["doc_id"]: r for r in simhash_dedup.near_groups(docs).where("doc_id is not null").collect()}
    assert near[2]["fingerprint"] == near[4]["fingerprint"] == "0" * 16 and near[4]["component_id"] == 2
    lang = {r["doc_id"]: r for r in language_id.identify(docs).where("doc_id is not null").collect()}
    assert lang[2]["lang_pred"] == lang[3]["lang_pred"] == lang[4]["lang_pred"] == "und" and lang[2]["score"] == 0
    found = {r["doc_id"]: r for r in pii.find(docs).where("doc_id is not null").collect()}
    assert (found[1]["n_email"], found[1]["n_phone"], found[9]["n_card"], found[11]["n_ip"]) == (1, 1, 1, 1)
    assert found[2]["spans"] == ""
    lm = {r["doc_id"]: r for r in lm_scoring.score(docs).where("doc_id is not null").collect()}
    assert lm[2]["n_tokens"] == lm[3]["n_tokens"] == lm[4]["n_tokens"] == 1 and lm[7]["n_tokens"] == 2


def test_decontamination(docs, benchmark, empty):
    got = decontamination.contaminated(docs, benchmark).collect()
    assert {(r["doc_id"], r["item_id"], r["distance"]) for r in got} == {(10, 1, 0), (10, 4, 0)}
    assert decontamination.contaminated(docs, benchmark.where("false")).collect() == []
    assert decontamination.contaminated(empty, benchmark).collect() == []
    assert decontamination.clean(docs, benchmark).count() == len(ROWS) - 1


def test_pages(pages):
    rows = html_extraction.extract(pages).collect()
    assert len(rows) == 6 and {r["text"] for r in rows if r["page_id"] == 3} == {"plain"}
    assert [r["text"] for r in rows if r["page_id"] == 2] == [""]
    assert html_extraction.extract(pages.where("false")).collect() == []
    judged = url_filter.judge(pages).collect()
    assert len(judged) == 6
    by = {r["page_id"]: r for r in judged}
    assert (by[3]["host"], by[3]["path"], by[3]["rule"], by[3]["verdict"]) == ("b.org", "/es/x", "org/es/", "block")
    assert by[2]["host"] == by[2]["path"] == "" and by[2]["rule"] is None
    assert url_filter.judge(pages.where("false")).collect() == []


@pytest.mark.parametrize("number", range(4))
def test_stages_keep_columns(spark, docs, benchmark, number, tmp_path):
    benchmark.write.parquet(f"{tmp_path}/benchmark.parquet")
    _, stage = corpus_pipeline.STAGES[number]
    got = stage(spark, docs, str(tmp_path))
    assert got.columns == docs.columns
    ids = sorted(str(r["doc_id"]) for r in got.select("doc_id").collect())
    assert len(ids) < len(ROWS)
    assert stage(spark, docs.where("false"), str(tmp_path)).collect() == []


def test_stage_decisions(spark, docs, tmp_path):
    kept = corpus_pipeline.distinct_texts(spark, docs, "").select("doc_id").collect()
    # The repeated row goes, null and empty text are one, all of "Hello world" is one.
    assert sorted((r["doc_id"] for r in kept), key=str) == sorted([1, 2, 4, 5, 7, 8, 9, 10, 11], key=str)
    last = corpus_pipeline.tokenized(spark, docs, "")
    assert last.count() == len(ROWS)
