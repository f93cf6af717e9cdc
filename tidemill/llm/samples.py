"""Bounded samples of labelled documents, for the operators that learn from labels."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.llm.common import fold_column


def chosen_labels(labels: DataFrame, label_col: str, per_class: int, folds: int, held_out: int | None, id_col: str = "doc_id", seed: int = 11) -> pd.DataFrame:
    """doc_id and label of at most per_class documents of each class, by lowest seeded hash, outside the held-out fold.

    Null ids and null labels are left out; of repeated ids the largest label counts.
    """
    rows = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label")).dropna()
    if held_out is not None:
        rows = rows.where(fold_column(F.col("doc_id"), folds) != held_out)
    rows = rows.groupBy("doc_id").agg(F.max("label").alias("label"))
    by_hash = F.xxhash64(F.lit(seed), F.col("doc_id"))
    parts = [rows.where(F.col("label") == k).orderBy(by_hash, "doc_id").limit(per_class).toPandas() for k in (0, 1)]
    return pd.concat(parts, ignore_index=True)


def labelled(docs: DataFrame, chosen: pd.DataFrame) -> DataFrame:
    """One document of each id of the sample, with its label; the sample's size is a parameter, so it goes to all executors.

    Of rows that share an id, the one of the lowest hash stays, so there are never more rows than ids.
    """
    spark = docs.sparkSession
    sample = spark.createDataFrame(chosen, "doc_id long, label int")
    rest = [c for c in docs.columns if c != "doc_id"]
    one = docs.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "label").agg(F.min_by(F.struct(*rest), F.xxhash64(*rest)).alias("row"))
    return one.select("doc_id", "label", "row.*")
