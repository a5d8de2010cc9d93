"""A corpus pipeline: quality rules, near copies, repeated passages, packed sequences.

Each stage is a function of (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of `documents`. `run` writes each stage's rows to the shared
folder and reads them again for the next one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from trafficward.llm import packing, quality, repeats, simhash
from trafficward.llm.common import read, stored


#: Rows of an Arrow batch: a batch is held by an executor and its Python worker at once, several times over.
BATCH_ROWS = "1000"


def _slim(spark: SparkSession) -> None:
    """Small Arrow batches, as texts are long and workers keep what earlier stages took."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the n-gram likelihood ratio."""
    _slim(spark)
    ratio = quality.fit_ratio(docs, read(spark, sf_dir, "labels"))
    return quality.kept_documents(docs, ratio)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, likeness 0.8 or more).

    SimHash fingerprints give the first candidates, shared shingles the rest; the sets confirm each link.
    """
    _slim(spark)
    return simhash.without_near_copies(docs)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the words of passages that stand anywhere else; `n_chars` follows the text."""
    _slim(spark)
    left = repeats.without_repeats(docs)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def packed_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 2048 tokens."""
    _slim(spark)
    placed = packing.packed_documents(docs)
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


STAGES = [
    ("quality rules", quality_rules),
    ("SimHash near-dedup", near_copies),
    ("substring dedup", repeated_passages),
    ("best-fit packing", packed_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs


#: SQL cannot tokenise or sign; the tests hold the stages against brute force.
ORACLE_SQL = None
