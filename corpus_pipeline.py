"""Preparation of the documents table in five stages, each an operator of tidemill.llm.

Every stage takes (spark, docs, sf_dir) and works on all rows that the stage before it kept. Rows come as Parquet and go as
Parquet, so a lost executor costs no more than its tasks. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemill.llm.common import written
from tidemill.llm.decontaminate import leaks
from tidemill.llm.ngram_join import one_of_each_group
from tidemill.llm.pieces import sampled_pieces
from tidemill.llm.pii import redact
from tidemill.llm.toxicity import scored

_MARK = "__pipeline_mark"


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows whose toxicity is below 0.5; the network learns from the labels of rows that are here."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return scored(docs, labels, held_out=None, score_col=_MARK).where(F.col(_MARK) < 0.5).drop(_MARK)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that of the smallest id, of each group linked by five-word shingles at a similarity of 0.8 or more."""
    return one_of_each_group(docs, width=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold no benchmark item by half or more."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return leaks(docs, benchmark, leak_col=_MARK).where(F.size(_MARK) == 0).drop(_MARK)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, personal data in texts replaced by its kind; n_chars follows the text."""
    cleaned = redact(docs)
    return cleaned.withColumn("n_chars", F.char_length("text").cast("long")) if "n_chars" in docs.columns else cleaned


def pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two distinct sampled segmentations of each row's text: doc_id, rank, ids, log_probability, inclusion."""
    return sampled_pieces(docs, public_tokenizers.path("piece_bpe_32k.model"), k=2)


STAGES = [("toxicity", toxicity), ("near_copies", near_copies), ("decontamination", decontamination), ("personal_data", personal_data), ("pieces", pieces)]
#: Learnt scores and sampled segmentations are beyond SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            docs = written(docs, f"pipeline-{name}")
    return docs
