"""From raw documents to a weighted training corpus, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written
as Parquet in the shared folder and read again as the next stage's documents. All
but the last return the columns of documents.

1. language_id: documents without a recognisable language go.
2. line_dedup: lines of templates that recur across documents are dropped.
3. near_dedup: of each group of near duplicates the one of smallest id stays.
4. decontamination: documents with passages of two benchmark items or more go;
   from the others the words of benchmark passages are cut.
5. mixing: every document gets a rate and a number of copies, so that the expected
   tokens by domain have the target weights.

Null texts are rejected by the first stage, for want of a letter; documents that
become empty later stay, with a rate of 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm.common import Work, table
from quarry.llm.decontaminate import contamination, without_spans
from quarry.llm.language import predict_language
from quarry.llm.line_templates import drop_recurring_lines
from quarry.llm.mixing import TARGETS, label_domain, mix
from quarry.llm.near_dedup import near_duplicates

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
OWN = COLUMNS[2:]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the documents whose language is recognised; learned from all that have a language."""
    out = predict_language(spark, docs, docs, columns=("text", *OWN))
    return out.where(~F.col("rejected")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop recurring lines; n_chars follows."""
    out = drop_recurring_lines(spark, docs, columns=OWN)
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group; those without words are no group."""
    copies = near_duplicates(spark, docs).where("not kept").select("doc_id", "text_key").distinct()
    # their number grows with the corpus: merged, never broadcast
    return docs.withColumn("text_key", F.xxhash64("text")).join(copies.hint("merge"), ["doc_id", "text_key"], "left_anti").select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents, cut single passages; n_chars follows."""
    out = contamination(spark, docs, table(spark, sf_dir, "benchmark"), columns=("text", *OWN))
    out = out.where(F.size("items") < 2).withColumn("text", without_spans(F.col("text"), F.col("byte_spans")))
    return out.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Weigh all documents."""
    labels = table(spark, sf_dir, "labels").select("doc_id", label_domain(F.col("quality"), F.col("toxic")).alias("domain"))
    return mix(spark, docs, labels, TARGETS, columns=("text", *OWN))


STAGES = [
    ("language_id", language_id),
    ("line_dedup", line_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
]

#: Training a classifier, signatures and the fit of rates are beyond SQL; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = Work(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = work.write(stage(spark, docs, sf_dir), name)
    return docs
