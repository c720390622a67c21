"""Cleaning and packing a corpus of documents, as stages over written tables.

Each stage reads all that the one before it kept. All but the last return the
columns of documents; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.decontamination import find_leaks
from ledgerloom.llm.language import fitted, identify_languages
from ledgerloom.llm.near_dedup import near_duplicates
from ledgerloom.llm.packing import pack_sequences
from ledgerloom.llm.phrase_dedup import remove_recurring
from ledgerloom.llm.storage import shared_dir

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language (null, empty or without letters) go; ``lang`` becomes the language found.

    Without any learned language nothing can be rejected for it, and only texts without letters go.
    """
    model = fitted(docs)
    found = identify_languages(docs, model)
    if not model.langs:
        return docs.where(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return near_duplicates(docs).where("kept").select(*COLUMNS)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that recur go; a document that loses nothing keeps its text as it is, one that loses all goes."""
    found = remove_recurring(docs.withColumn("_before", F.col("text")))
    text = F.when(F.col("n_removed") > 0, F.col("kept")).otherwise(F.col("_before"))
    n_chars = F.when(F.col("n_removed") > 0, F.length("kept")).otherwise(F.col("n_chars")).cast("long")
    found = found.where("n_removed < n_words or n_words = 0")
    return found.withColumns({"text": text, "n_chars": n_chars}).select(*COLUMNS)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item, exactly or edited, go."""
    benchmark = spark.read.parquet(f"{sf_dir.rstrip('/')}/benchmark.parquet")
    return find_leaks(docs, benchmark).where(F.size("leaks") == 0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with the sequence and offset where each lies."""
    return pack_sequences(docs).select("doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("language ID", language_id),
    ("MinHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("benchmark decontamination", decontamination),
    ("packing", packing),
]

#: Learned models, alignment scores and packing are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over ``documents``; each stage's rows are written to the shared folder."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
