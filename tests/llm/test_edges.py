"""Nulls, empty and long texts, ties, repeated rows, extra columns and empty tables, for every operator."""

import pytest

from weftline.llm import decontam, fingerprint, htmlmain, langid, licenses, linededup, mixing, setjoin, sharding, toxicity

LONG = " ".join(f"word{i}" for i in range(200_000))
ROWS = [
    (1, "Alpha beta gamma delta epsilon zeta.\nSecond line here.", "en", "a", 50, "x"),
    (1, "Alpha beta gamma delta epsilon zeta.\nSecond line here.", "en", "a", 50, "x"),
    (2, None, None, None, None, None),
    (3, "", "en", "a", 0, ""),
    (4, "   \n\t ", "fr", "b", 6, None),
    (None, "no id at all, but some words", "en", None, 10, None),
    (5, "Alpha beta gamma delta epsilon zeta.\nSecond line here.", "en", "b", 50, "x"),
    (6, LONG, "en", "c", len(LONG), "x"),
    (7, "einzeln", "de", "c", 7, "x"),
    (8, "%%% ### 123", "de", "c", 7, "x"),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string"
LABELS = "doc_id long, quality int, toxic int"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (1, 1, 1), (3, None, None), (None, 1, 1), (7, 0, 0), (5, 0, 0)], LABELS)


OPS = {
    "mix": lambda s, d, x: mixing.mix_report(d),
    "mix_documents": lambda s, d, x: mixing.mix_documents(d),
    "language": lambda s, d, x: langid.language_report(d),
    "fingerprint": lambda s, d, x: fingerprint.fingerprint_report(d),
    "toxicity": lambda s, d, x: toxicity.toxicity_report(d, x),
    "keep_clean": lambda s, d, x: toxicity.keep_clean(d, x),
    "lines": lambda s, d, x: linededup.dedup_report(d),
    "licenses": lambda s, d, x: licenses.license_report(d),
    "shards": lambda s, d, x: sharding.shard_report(d, 3),
    "place": lambda s, d, x: sharding.place(d, 3),
    "decontam": lambda s, d, x: decontam.drop_contaminated(d, s.createDataFrame([(1, "alpha beta gamma delta epsilon zeta"), (2, None), (3, "too short"), (1, "alpha beta gamma delta epsilon zeta")], "item_id long, text string")),
    "jaccard": lambda s, d, x: setjoin.jaccard_components(d, 3, 90, 100),
    "keep_one": lambda s, d, x: setjoin.keep_one(d),
}
ROWS_OUT = {"mix_documents": None, "keep_clean": 10, "decontam": 7, "keep_one": 8}


def test_repeated_ids_with_different_texts_are_kept_apart(spark):
    rows = [(1, "one two three four five six seven", "a"), (1, "eight nine ten eleven twelve thirteen", "a"), (1, "one two three four five six seven", "b"), (2, "eight nine ten eleven twelve thirteen", "c"), (None, "x", "d")]
    got = setjoin.keep_one(spark.createDataFrame(rows, "doc_id long, text string, size string")).collect()
    assert len(got) == 3 and {r["text"] for r in got} == {rows[0][1], rows[1][1], "x"}


def test_short_items_are_found_where_they_are_the_whole_text(spark):
    bench = spark.createDataFrame([(1, "Four words of it"), (2, "five words are in it"), (3, "!!")], "item_id long, text string")
    docs = spark.createDataFrame([(1, "four words, of it"), (2, "here four words of it are"), (3, "now five words are in it too"), (4, None), (5, "...")], "doc_id long, text string")
    got = decontam.contaminated(docs, bench).collect()
    assert sorted((r["doc_id"], r["item_id"], r["n_shingles"]) for r in got) == [(1, 1, 1), (3, 2, 1)]


@pytest.mark.parametrize("name", OPS)
def test_odd_rows(spark, docs, labels, name):
    got = OPS[name](spark, docs, labels).collect()
    want = ROWS_OUT.get(name, len(ROWS))
    assert want is None or len(got) == want


@pytest.mark.parametrize("name", OPS)
def test_empty_tables(spark, docs, labels, name):
    assert OPS[name](spark, docs.limit(0), labels.limit(0)).collect() == []


def test_defined_values(spark, docs, labels):
    lang = {r["doc_id"]: r for r in langid.language_report(docs).collect()}
    assert lang[2]["lang_pred"] == lang[3]["lang_pred"] == lang[8]["lang_pred"] == "und" and lang[2]["score"] == 0
    comp = {r["doc_id"]: r for r in setjoin.jaccard_components(docs, 3, 90, 100).collect()}
    assert (comp[5]["component_id"], comp[2]["component_id"], comp[3]["n_shingles"], comp[None]["component_id"], comp[7]["n_shingles"]) == (1, 2, 0, None, 1)
    fp = {r["doc_id"]: r for r in fingerprint.fingerprint_report(docs).collect()}
    assert fp[2]["fingerprint"] == fp[3]["fingerprint"] and fp[1]["fingerprint"] == fp[5]["fingerprint"] and fp[2]["near_next"] == 1.0
    sh = sharding.shard_report(docs, 3).collect()
    assert {r["shard"] for r in sh if r["doc_id"] in (1, 5)}.__len__() == 1 and all(r["size"] >= 16 for r in sh)


def test_pages(spark):
    rows = [(1, "u", None), (2, None, ""), (3, "u", "<p>Only</p>"), (4, "u", "<script>x" * 3), (5, "u", "no markup &amp; &bogus; text"), (5, "u", "<div>" * 3000 + "deep" + "</div>" * 10)]
    got = htmlmain.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert [r["text"] for r in got] == ["", "", "Only", "", "no markup & &bogus; text", "deep"]
    assert htmlmain.main_text(spark.createDataFrame([], "page_id long, url string, html string")).collect() == []
