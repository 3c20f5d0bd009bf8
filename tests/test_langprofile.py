"""Languages of labelled texts that weren't learned from."""

from factloom.operators.langprofile import detect
from factloom.plans.catalog import QUERIES


def test_accuracy_beats_stop_words(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id % 3 = 1 AND lang IS NOT NULL AND text IS NOT NULL").select("doc_id", "lang")
    right = lambda name: docs.join(QUERIES[name](spark, sf), "doc_id").where("lang = detected").count() / docs.count()
    profiles, words = right("T13"), right("T13_words")
    assert profiles > 0.95 and profiles > words, (profiles, words)


def test_odd_texts(spark):
    labelled = spark.createDataFrame([("en", "the cat and the dog"), ("de", "der hund und die katze"), (None, "x"), ("xx", None)], "lang string, text string")
    docs = spark.createDataFrame([(1, "und der"), (2, "the and"), (3, None), (4, "12 !"), (5, ""), (6, "日本")], "doc_id long, text string")
    assert {r["doc_id"]: r["detected"] for r in detect(docs, labelled).collect()} == {1: "de", 2: "en"}
    assert detect(docs.where("false"), labelled).count() == 0 and detect(docs, labelled.where("false")).count() == 0
