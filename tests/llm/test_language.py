import os
import random

import pytest
from pyspark.sql import functions as F

from quarry.llm.language import _sample, held_out, op3_subword_softmax, predict_language

WORDS = {"en": "the of and ing tion that with", "de": "der und ung schaft nicht über", "fr": "les des ment eau être où"}


def corpus(spark, n=120):
    rng = random.Random(2)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(WORDS))
        parts = WORDS[lang].split()
        rows.append((i, " ".join("".join(rng.choices(parts, k=rng.randint(1, 3))) for _ in range(rng.randint(5, 60))), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def test_held_out_accuracy(spark):
    df = corpus(spark)
    fold = held_out(F.col("doc_id"))
    got = predict_language(spark, df, df.where(~fold)).join(df, "doc_id").where(fold).select("lang", "lang_pred", "score").collect()
    assert len(got) > 15 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_labels_of_the_fold_are_never_used(spark):
    df = corpus(spark)
    fold = held_out(F.col("doc_id"))
    lied = df.withColumn("lang", F.when(fold, F.lit("en")).otherwise(F.col("lang")))
    a, b = (sorted(tuple(r) for r in predict_language(spark, x, x.where(~fold)).collect()) for x in (df, lied))
    assert a == b


def test_same_for_any_partitioning(spark):
    df = corpus(spark, 60)
    a, b = (sorted(tuple(r) for r in predict_language(spark, x, x, sample=40).collect()) for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_rows_that_repeat_and_many_languages(spark):
    """One id with very many rows is a bounded part of the sample; 150 languages are all learned, one of long texts alone as well."""
    rng = random.Random(7)
    letters = "abcdefghijklmnopqrstuvwxyz"
    marks = sorted({"".join(rng.choices(letters, k=4)) for _ in range(150)})
    rows = [(i, " ".join(m + rng.choice(letters) for _ in range(30)), m) for i, m in enumerate(marks * 8)]
    long = " ".join("щука" + rng.choice("абв") for _ in range(6000))
    rows += [(10**6 + i, long[i:], "ru") for i in range(8)] + [(5, "always the same text of one id", "en")] * 3000 + [(5, f"another {i} of one id", "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    bags = _sample(df.select("lang", "text", F.col("doc_id").alias("id")), 100, 20_000).groupBy("lang").count().collect()
    assert len(bags) == len(marks) + 2 and max(r["count"] for r in bags) <= 20
    got = predict_language(spark, df, df).join(df.select("doc_id", "lang", "text").dropDuplicates(["doc_id"]), "doc_id").where("doc_id <> 5").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.95 * len(got)
    assert {r["lang_pred"] for r in got if r["lang"] == "ru"} == {"ru"}


def test_texts_without_letters_are_undetermined(spark, awkward, nothing):
    rows = [(1, None), (2, ""), (3, "123 !? ²½"), (4, "x"), (5, "ü")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: r for r in predict_language(spark, docs, corpus(spark, 60)).collect()}
    assert [got[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and all(got[i]["score"] == 0 and got[i]["rejected"] for i in (1, 2, 3))
    assert got[4]["lang_pred"] != "und" and got[5]["lang_pred"] != "und"
    assert predict_language(spark, awkward, awkward).count() == 10
    assert {r["lang_pred"] for r in predict_language(spark, awkward, nothing).collect()} == {"und"}
    assert predict_language(spark, nothing, awkward).isEmpty()


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no driver tables")
def test_driver_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    got = op3_subword_softmax(spark, "/root/testdata/sf0.01").join(docs, "doc_id").where("held_out").collect()
    assert sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
