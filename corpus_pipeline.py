"""The corpus pipeline: toxicity, near duplicates, repeated passages, mixing, encoding.

Each stage takes what its predecessor kept, as a table, and its decision takes
effect.  All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from railweave.llm.frames import fresh, written
from railweave.llm.mixing import mix_sources
from railweave.llm.ngram_join import ngram_join
from railweave.llm.pieces import encode_texts
from railweave.llm.substring_dedup import strip_repeats
from railweave.llm.toxicity import THRESHOLD, learn, toxicity


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose toxicity is under the threshold.

    The model is learned from the labelled rows among docs.  Without labels all stay.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    names = docs.columns
    score = fresh("score", names)
    scored = toxicity(docs, learn(docs, labels), keep=True, name=score)
    return scored.filter(F.col(score) < THRESHOLD).select(*names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group of linked documents.

    Rows that share a doc_id stay or go together; rows without doc_id and documents
    without words are linked with nothing and stay.
    """
    found = ngram_join(docs).filter(F.col("doc_id") != F.col("component_id")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(*docs.columns)


def drop_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes word windows that start in a document with a smaller doc_id."""
    return strip_repeats(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats documents so that every source has the same share, in shuffled order."""
    return mix_sources(docs).drop("mix_copy", "mix_key")


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, ids, n_ids and round_trip (the decoded ids are the text) of every document of the mix."""
    return encode_texts(docs, check=True).select("doc_id", "source", "ids", "n_ids", "round_trip")


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_duplicates), ("repeated passages", drop_repeats), ("mixing", mix), ("pieces", encode)]

#: SQL cannot express the stages; tests/llm holds them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
