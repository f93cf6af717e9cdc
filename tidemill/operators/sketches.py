"""Distinct counts by stored sketches that merge: days are counted once and summed upwards without their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import through


def daily_sketches(df: DataFrame, ts: str, keys: list[str], counted: str, bits: int = 12) -> DataFrame:
    """day, the keys and a HyperLogLog sketch of `counted`, written: one row of some kilobytes for each day and keys."""
    days = df.groupBy(F.to_date(F.col(ts)).alias("day"), *keys).agg(F.hll_sketch_agg(F.col(counted), F.lit(bits)).alias("sketch"))
    return through(days, "parquet")


def merged(sketches: DataFrame, *by) -> DataFrame:
    """The sketches of each group as one, and what it estimates; rows of the table alone are read. A group of nulls alone estimates 0."""
    union = sketches.groupBy(*by).agg(F.hll_union_agg("sketch").alias("sketch"))
    return union.withColumn("estimate", F.hll_sketch_estimate("sketch"))
