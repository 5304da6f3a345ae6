"""Corpus pipeline: quality classifier, language ID, line dedup, near-dedup, packing.

Every stage takes and, but for the last, returns rows of the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import language, lines, neardup, packing, quality
from paperloom.llm.common import clear_scratch, materialize, scratch, table
from paperloom.llm.queries import vocabulary

DOCUMENT = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier rejects go.

    Null and blank texts are rejected; null ids, languages and sources are not a reason to go.
    Every row is judged by itself, repeated ones alike.  An empty table stays empty.
    """
    return quality.classify(docs, table(spark, sf_dir, "labels")).where("keep").select(*DOCUMENT)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of no certain language go; ``lang`` becomes the identified one.

    Texts that are null or have no letters go; a null ``lang`` or ``source`` is no evidence.
    An empty table stays empty.
    """
    return language.identify(docs, declared="lang", host="source").where("keep").withColumn("lang", F.col("language")).select(*DOCUMENT)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of many documents go, and documents of which nothing but white space is left.

    A document that loses no line stays as it is, null and empty texts too.  An empty table
    stays empty.
    """
    cut = lines.dedup_lines(docs).where((F.col("n_dropped") == 0) | F.col("text").rlike(r"\S"))
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*DOCUMENT)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: that of the smallest id.

    Texts without words and null ids are near nothing and stay; rows of one id are one
    document.  An empty table stays empty.
    """
    kept = neardup.near_duplicates(docs, percent=80, words=5).where("kept").select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col("kept_id")), "left_semi").select(*DOCUMENT)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All that is left, in sequences of at most 1024 tokens.

    A null or empty text is its end id, null ids and repeated rows are documents like others.
    An empty table gives no pieces.
    """
    return packing.pack(docs, vocabulary("byte_bpe_50k.json"), end_id=0, capacity=1024)


STAGES = [
    ("quality classifier", quality_classifier),
    ("language ID", language_id),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("packing", pack),
]
#: Tokenisation and trained models are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = table(spark, sf_dir, "documents"), scratch(spark)
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
        clear_scratch(spark, docs, since=before)  # what a stage needed on its way, and the stage before
    return STAGES[-1][1](spark, docs, sf_dir)
