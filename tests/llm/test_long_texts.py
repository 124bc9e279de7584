"""Texts of megabytes are handled whole by every operator."""

import random

import pytest

from tessera.llm import decontaminate, jaccard_join, language, mixing, quality, repeats, secrets, spotsigs, toxicity


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(1)
    words = [f"{rng.choice(['alpha', 'beta', 'the', 'of', 'gamma'])}{i % 997}" if i % 3 else rng.choice(["the", "of", "und"]) for i in range(400_000)]
    text = " ".join(words)
    assert len(text) > 2_500_000
    rows = [(1, text, "en", "a"), (2, text + " one two three four five six seven eight password=abcdefgh12345678", "en", "a"), (3, "short", "en", "b")]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")


def test_repeats(docs):
    got = {r.doc_id: (r.n_words, r.n_removed) for r in repeats.remove_repeats(docs).collect()}
    assert got == {1: (400_000, 0), 2: (400_009, 400_000), 3: (1, 0)}


def test_near_duplicates(docs):
    assert sorted(map(tuple, jaccard_join.join(docs).collect())) == [(1, 1, 1), (2, 1, 1), (3, 3, 0)]


def test_ends_of_texts(spark, docs):
    items = spark.createDataFrame([(7, "One two three, four five six seven eight!")], "item_id int, text string")
    assert [(r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()] == [(2, 7)]
    spans = {r.doc_id: [(s.kind, s.end - s.start) for s in r.secret_spans] for r in secrets.find_secrets(docs).collect()}
    assert spans[2] == [("assign", len("password=abcdefgh12345678"))] and spans[3] == []


def test_models(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (3, 1, 1)], "doc_id long, quality int, toxic int")
    assert language.predict(docs, language.fit(docs)).count() == 3 and quality.keep(docs, labels).count() == 3
    assert all(0 <= r.score <= 1 for r in toxicity.score(docs, toxicity.fit(docs, labels)).collect())
    assert {r.doc_id: r.times for r in mixing.mix(docs).collect()}.keys() <= {1, 2, 3}


def test_fingerprints(docs):
    short = docs.selectExpr("doc_id", "substring(text, 1, 400000) as text")
    sets = {r.doc_id: set(r.s) for r in short.select("doc_id", spotsigs.signature_set(short["text"]).alias("s")).collect()}
    assert sets[1] == sets[2] and len(sets[1]) > 1000 and len(sets[3]) == 1
