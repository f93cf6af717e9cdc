"""Ordered runs of rows by key, assembled without holding a key in one place."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import through


def assembled(rows: DataFrame, key: str, number: str, *ties: str) -> DataFrame:
    """Every row with its `position` in its key's order (from 1), `gap` (numbers missing before it) and `repeated` (its number has come before).

    Rows are dealt out by ranges of key, number and the columns `ties`, so a key that a third of all rows have lies in many parts, each in order. Positions and
    neighbours are taken within a part; what the key's parts before it hold comes from one row for each key and part. The first row of a key
    has no gap. A null key is a key; a null number comes first, has no gap and isn't repeated. Rows that agree in all three share a part and are in no given order.
    """
    ranged = rows.repartitionByRange(key, number, *(F.xxhash64(c) for c in ties)).withColumn("__part", F.spark_partition_id())
    ranged = through(ranged, "parquet")  # written, so that parts stay what they are
    inside = Window.partitionBy("__part", key).orderBy(F.col(number).asc_nulls_first(), *(F.xxhash64(c) for c in ties))
    placed = ranged.select("*", F.row_number().over(inside).cast("long").alias("__place"), F.lag(number).over(inside).alias("__before"))
    held = ranged.groupBy(F.col("__part").alias("__p"), F.col(key).alias("__k")).agg(F.count("*").alias("__n"), F.max(number).alias("__most"))
    ahead = Window.partitionBy("__k").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    held = through(held.select("__p", "__k", F.coalesce(F.sum("__n").over(ahead), F.lit(0)).alias("__offset"), F.max("__most").over(ahead).alias("__last")), "parquet")
    joined = placed.join(held, (F.col("__part") == F.col("__p")) & F.col(key).eqNullSafe(F.col("__k")))
    before = F.when(F.col("__place") == 1, F.col("__last")).otherwise(F.col("__before"))
    gap = F.greatest(F.coalesce(F.col(number) - before - 1, F.lit(0)), F.lit(0)).cast("long")
    return joined.select(*rows.columns, (F.col("__offset") + F.col("__place")).alias("position"), gap.alias("gap"), F.coalesce(F.col(number) == before, F.lit(False)).alias("repeated"))
