"""Aggregates with one meaning on every engine."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays, summed as doubles in order."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def _log_sums(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Sum of the logarithms and number of the positive values of each key, batch by batch."""
    for frame in frames:
        x = frame["x"].where(frame["x"] > 0)
        parts = pd.DataFrame({"key": frame["key"], "logs": np.log(x)}).groupby("key", dropna=False)["logs"].agg(["sum", "count"])
        yield parts.reset_index().rename(columns={"sum": "logs", "count": "n"})


def _softsign(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for x in batches:
        yield x / (1 + x.abs())


def geometric_mean(df: DataFrame, key: str, x: str) -> DataFrame:
    """`key` (of type string) and `mean` of its positive values; null for none. Batches give partial sums, so no group is held."""
    parts = df.select(F.col(key).alias("key"), F.col(x).cast("double").alias("x")).mapInPandas(_log_sums, "key string, logs double, n long")
    return parts.groupBy(F.col("key").alias(key)).agg(F.exp(F.sum("logs") / F.nullif(F.sum("n"), F.lit(0))).alias("mean"))


def softsign(x: Column | str) -> Column:
    """x / (1 + |x|), batch by batch."""
    return F.pandas_udf(_softsign, "double")(x)
