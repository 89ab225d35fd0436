"""The corpus pipeline: documents in, cleaned and tokenised documents out.

Each stage works on all that the one before kept, is written as Parquet and read again. STAGES and run() are the interface;
SQL cannot express the trained stages, so ORACLE_SQL is None and the tests compare with plain Python versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from factorlake.llm.common import materialise
from factorlake.llm.decontaminate import decontaminate
from factorlake.llm.exact_dedup import drop_exact_copies
from factorlake.llm.jaccard_join import drop_near_copies
from factorlake.llm.sentencepiece_sa import encode
from factorlake.llm.toxicity import drop_toxic

ORACLE_SQL = None


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier rejects go."""
    return drop_toxic(docs, _table(spark, sf_dir, "labels"))


def exact_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the row with the smallest doc_id stays."""
    return drop_exact_copies(docs)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked at 0.8 of their five-word shingles or more, the one with the smallest doc_id stays."""
    return drop_near_copies(docs, n=5, percent=80)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of ten words of the benchmark go."""
    return decontaminate(docs, _table(spark, sf_dir, "benchmark"))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, and whether these decode to the text."""
    return encode(docs)


STAGES = [
    ("toxicity", toxicity_stage),
    ("exact_dedup", exact_dedup_stage),
    ("jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("sentencepiece", sentencepiece_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
