"""Stages of the corpus pipeline."""

import random

import corpus_pipeline
from veilspark.llm import language, suffix

COLUMNS = "doc_id long, text string, lang string"


def words(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(n))


def test_language_stage_keeps_ambiguous_documents(spark, monkeypatch):
    seen = [(1, "clean text", "en", "en", 0.9, False), (2, "word", "en", "en", 0.52, True), (3, "12", "en", "und", 0.0, False)]
    found = spark.createDataFrame(seen, COLUMNS + ", lang_pred string, score double, ambiguous boolean")
    monkeypatch.setattr(language, "fit", lambda docs: None)
    monkeypatch.setattr(language, "identify", lambda docs, model, names: found)
    got = corpus_pipeline.identify_language(spark, found.select("doc_id", "text", "lang"), "")
    assert sorted(map(tuple, got.collect())) == [(1, "clean text", "en"), (2, "word", "en")]


def test_repeats_are_cut_by_text_where_a_doc_id_has_two(spark):
    rng = random.Random(14)
    shared = words(rng, 60)
    rows = [(1, shared + " " + words(rng, 90)), (7, words(rng, 100) + " " + shared), (7, words(rng, 70)), (None, words(rng, 60))]
    got = suffix.without_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = {(i, t.replace(" " + shared, "")) if t.endswith(shared) else (i, t) for i, t in rows}
    assert {(r["doc_id"], r["text"].strip()) for r in got} == want and len(got) == 4
