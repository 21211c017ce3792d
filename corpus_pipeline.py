"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written as Parquet
and read again as the next stage's docs.  All but the last return the columns of documents.

In every stage an empty table gives no rows, and columns beyond doc_id, text, lang, source and
n_chars are carried along whatever their names; what nulls, empty and long texts, ties and
repeated rows do is said of each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from statloom.llm import risk_thresholds, similar_documents, slack_packing, substring_dedup, systematic_mixing
from statloom.llm._shared import read_table, shared_dir


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go.

    A null text is empty and goes, as fewer than 20 words do; a null language is a language;
    repeated rows are judged alike; of several labels of a document the worst counts; without
    labels only the base rules reject.
    """
    return risk_thresholds.kept_documents(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies (similarity of 5-word shingles 0.8 or more) stays.

    SimHash with BK-trees proposes the closest pairs, MinHash the rest; all are verified.  The
    smallest doc_id stays, among equal ones the smaller hash of the text, of repeated rows one;
    rows without doc_id only where no row of the class has one.  Null and wordless texts are one
    class; texts of fewer than five words are near copies only if their words are equal.
    """
    return similar_documents.keep_one_of_each(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages of 20 words or more that occur earlier in the corpus are cut from the texts.

    Earlier is the smaller doc_id, then the earlier place; rows without doc_id come last.  All
    rows stay: null texts null, texts that are repeats throughout empty.  Rows of equal doc_id
    do not cut each other.
    """
    return substring_dedup.without_repeats(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for, up to three times.

    A null source is the last source; null texts have no words; ties within a source are ordered
    by size, doc_id and text; repeated rows are documents of their own.
    """
    return systematic_mixing.mixed_documents(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, each with its ids, its sequence and its offset there.

    Null and empty texts are the end id alone; longer documents than a sequence are cut; repeated
    rows, also those that mixing made, are packed each.
    """
    return slack_packing.pack_documents(docs)


STAGES = [
    ("quality", quality),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("mixing", mixing),
    ("packing", packing),
]

#: Fingerprints and token ids have no SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another over the documents."""
    docs = read_table(spark, sf_dir, "documents")
    for name, function in STAGES:
        path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        function(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
