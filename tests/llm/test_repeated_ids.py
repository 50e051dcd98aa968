"""Repeated and null ids, and tables without a label, in the near-copy join, the profiles and the pipeline."""

import pytest

import corpus_pipeline
from furlong.llm import jaccard_join, language

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def rows(spark, pairs, lang=None):
    return spark.createDataFrame([(i, t, lang, "s", 1) for i, t in pairs], SCHEMA).repartition(3)


A, B = "a b c d e f g h", "q r s t u v w x"


def test_different_texts_under_one_id_are_rows_of_their_own(spark):
    docs = rows(spark, [(1, A), (1, B), (2, A), (3, B), (4, "only one here"), (None, A), (None, "nobody else has this"), (5, ""), (5, None)])
    got = sorted((r.doc_id or 0, r.class_id, r.n_links) for r in jaccard_join.near_copies(docs).collect() if r.class_id)
    assert got == [(0, 1, 2), (1, 1, 1), (1, 1, 2), (2, 1, 2), (3, 1, 1), (4, 4, 0), (5, 5, 0), (5, 5, 0)]
    kept = sorted((r.doc_id or 0, r.text or "") for r in jaccard_join.one_per_class(docs).collect())
    assert kept == sorted([(1, A), (1, B), (4, "only one here"), (0, "nobody else has this"), (5, ""), (5, "")])


def test_a_third_of_all_rows_repeat_one_row(spark):
    docs = rows(spark, [(7, A)] * 40 + [(k, f"{B} number {k} of many {k}") for k in range(10, 60)] + [(None, A)] * 40)
    kept = [(r.doc_id, r.text) for r in jaccard_join.one_per_class(docs).collect()]
    assert kept.count((7, A)) == 1 and (None, A) not in kept and len(kept) == 51


def test_no_row_has_a_language(spark):
    docs = rows(spark, [(1, "some text"), (2, "123"), (3, None)])
    profiles = language.fit(language.training_rows(docs))
    assert {r.lang_pred for r in language.identify(docs, profiles).collect()} == {"und"}
    assert [r.doc_id for r in corpus_pipeline.known_language(spark, docs, "").collect()] == [1]
    empty = rows(spark, [(1, None)]).limit(0)
    assert corpus_pipeline.known_language(spark, empty, "").collect() == []


def test_the_language_stage_drops_what_no_profile_knows(spark):
    english = [(k, f"the cat and the dog of house number {k} went to the market in the morning") for k in range(40)]
    known = rows(spark, english, "en")
    other = rows(spark, [(100, "Это совсем другой язык"), (100, "the dog went to the house in the morning"), (None, "日本語の文章です"), (101, "!!! ???")])
    kept = corpus_pipeline.known_language(spark, known.unionByName(other), "").collect()
    assert sorted(r.doc_id for r in kept) == [*range(40), 100]
    assert [r.text for r in kept if r.doc_id == 100] == ["the dog went to the house in the morning"]


@pytest.mark.parametrize("stage", [f for _, f in corpus_pipeline.STAGES[:-1]])
def test_stages_return_the_columns_of_an_empty_table(spark, tmp_path, stage):
    spark.createDataFrame([(1, "what is the answer of this question here")], "item_id bigint, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    empty = spark.createDataFrame([], SCHEMA)
    got = stage(spark, empty, str(tmp_path))
    assert got.columns == empty.columns and got.collect() == []
