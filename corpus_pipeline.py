"""Corpus pipeline: toxicity, near-dedup, substring dedup, decontamination, BPE.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame; all but the last return the columns of
``docs``.  :func:`run` writes every stage's result as Parquet into the shared checkpoint folder and reads
it back for the next one.  Null or empty texts pass every stage; a document is only dropped where it is
toxic, a near copy of one with a smaller id, or holds a benchmark item.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from churnlens.llm import bpe, decontam, rlz, simhash, toxicity
from churnlens.llm.common import materialize, table
from churnlens.llm.queries import vocabulary


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go."""
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays: the smallest id."""
    return simhash.drop_near_duplicates(docs, shingle=3, max_bits=2)


def drop_repeated_spans(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more that stand in a document with a smaller id are cut out of the text."""
    return rlz.drop_repeats(docs, window=50)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return decontam.drop_contaminated(docs, table(spark, sf_dir, "benchmark"), k=5, share=0.8)


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, and the text they decode to."""
    path = vocabulary("byte_bpe_50k.json")
    return (bpe.round_trip(docs, path)
            .select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", F.col("decoded").alias("text")))


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash near-dedup", drop_near_copies),
    ("substring dedup", drop_repeated_spans),
    ("benchmark decontamination", drop_leaks),
    ("bpe", tokenise),
]

#: The toxicity stage is a trained model, which SQL can't express; tests compare with plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
