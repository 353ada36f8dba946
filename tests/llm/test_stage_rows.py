"""Which rows leave the stages of the pipeline."""

import data

import corpus_pipeline
from textquarry.llm import language


def test_emptied_copies_are_not_packed(spark, tmp_path):
    rows = [(i, data.prose(1, 40)) for i in range(4)] + [(8, data.prose(2, 40))]
    docs = corpus_pipeline.lines(spark, data.frame(spark, rows, clashing=False), str(tmp_path))
    assert sorted(r.doc_id for r in docs.collect() if not r.text) == [1, 2, 3]
    assert sorted(r.doc_id for r in corpus_pipeline.near_copies(spark, docs, str(tmp_path)).collect()) == [0, 8]


def test_rows_with_a_letter_stay_without_any_label(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, "12 !", None), (3, None, None), (4, "字", None)], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in language.with_known_language(docs).collect()) == [1, 4]
