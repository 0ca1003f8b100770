from helpers import docs
from pyspark.sql import functions as F

from tracewell.llm import langid

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    got = langid.op4(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out and lang is not null").toPandas()
    assert (got.lang_pred == got.lang).mean() > 0.97
    assert got.score.between(0, 1).all()


def test_odd_texts(spark):
    en, de = "the cat and the other thing that is here " * 5, "der hund und das andere ding ist nicht da " * 5
    texts = [en, de, en, None, "", "123 !?", "é", de, en * 300, *[en, de, "x"] * 8]
    table = docs(spark, texts, extra=True)
    got = {r.doc_id: r for r in langid.predictions(table, langid.train(table)).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (3, 4, 5))
    assert got[6].lang_pred in ("en", "de") and got[8].lang_pred == "en"
    assert got[0].score == got[2].score


def test_nothing_to_learn_and_rejection(spark):
    nothing = langid.train(docs(spark, ["abc"]).withColumn("lang", F.lit(None).cast("string")))
    assert langid.predictions(docs(spark, ["abc", None]), nothing).where("lang_pred != 'und'").count() == 0
    assert langid.predictions(docs(spark, ["a"]).limit(0), nothing).count() == 0
    close = langid.Model({"a": [b"some text"], "b": [b"some text"]}, {"a": 2, "b": 1}, reject_margin=0.1)
    assert close.predict("some text")[0] == "und"
    assert langid.Model({"a": [b"some text"], "b": [b"some text"]}, {"a": 2, "b": 3}).predict("some text")[0] == "b"
