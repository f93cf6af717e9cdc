"""Joins that Spark has no operator of its own for, made of ones that it has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(left: DataFrame, right: DataFrame, by: list[str], on: str, value: str) -> DataFrame:
    """Each left row with `value` of the last right row at or before its `on`, within the columns `by`; null if none.

    One union and one window: a single shuffle on `by` and one sort, where a range condition would compare all pairs of a
    key. Of right rows with equal `on` the largest value counts; a null value of the last row is the answer, not one before.
    """
    keys = [*by, on]
    one = left.select(F.struct("*").alias("row"), *keys, F.lit(None).cast(T.StructType().add("value", right.schema[value].dataType)).alias("hit"), F.lit(1).alias("side"))
    two = right.select(F.lit(None).cast(one.schema["row"].dataType).alias("row"), *keys, F.struct(F.col(value).alias("value")).alias("hit"), F.lit(0).alias("side"))
    latest = Window.partitionBy(*by).orderBy(on, "side", "hit").rowsBetween(Window.unboundedPreceding, 0)
    both = one.unionByName(two).withColumn("found", F.last("hit", ignorenulls=True).over(latest))
    return both.where("side = 1").select("row.*", F.col("found")["value"].alias(f"asof_{value}"))


def interval_join(left: DataFrame, right: DataFrame, by: list[str], on: str, width: str, seconds: int) -> DataFrame:
    """Pairs of equal `by` whose right `on` is after the left one by at most `width` (of `seconds`).

    Time is cut into bins of that width and joined on key and bin, so the rows of one hot key spread over its bins, and each
    right row meets two bins alone. Right columns are prefixed with r_.
    """
    stamp = F.unix_seconds(F.col(on).cast("timestamp"))
    binned = left.withColumn("bin", F.floor(stamp / seconds))
    other = right.select(*(F.col(c).alias(f"r_{c}") for c in right.columns)).withColumn("r_stamp", F.unix_seconds(F.col(f"r_{on}").cast("timestamp")))
    other = other.withColumn("bin", F.explode(F.array(F.floor(F.col("r_stamp") / seconds), F.floor(F.col("r_stamp") / seconds) - 1)))
    same = [binned[c] == other[f"r_{c}"] for c in by] + [binned["bin"] == other["bin"]]
    after = (other[f"r_{on}"] > binned[on]) & (other[f"r_{on}"] <= binned[on] + F.expr(f"INTERVAL {width}"))
    condition: Column = after
    for c in same:
        condition = condition & c
    return binned.join(other, condition).drop("bin", "r_stamp")


def band_join(left: DataFrame, right: DataFrame, on: str, width: float) -> DataFrame:
    """Pairs whose right `on` is above the left one by at most `width`, with no key that must be equal.

    Values are cut into bands of that width and joined on the band, so Spark hashes bands instead of comparing all rows with
    all; each right row meets two bands alone. Nulls and NaN meet nothing. Right columns are prefixed with r_.
    """
    banded = left.where(~F.isnan(F.col(on).cast("double"))).withColumn("band", F.floor(F.col(on) / width))
    other = right.where(~F.isnan(F.col(on).cast("double"))).select(*(F.col(c).alias(f"r_{c}") for c in right.columns))
    other = other.withColumn("r_band", F.explode(F.array(*(F.floor(F.col(f"r_{on}") / width) - k for k in (0, 1)))))
    above = (F.col(f"r_{on}") > F.col(on)) & (F.col(f"r_{on}") - F.col(on) <= width)
    return banded.join(other, (F.col("band") == F.col("r_band")) & above).drop("band", "r_band")


def small_or_merge(left: DataFrame, right: DataFrame, on: list[str], how: str, limit: int = 8 << 20) -> DataFrame:
    """Joins with a broadcast of the right side if Spark's own estimate of its size is at most `limit` bytes, else by sort-merge.

    The estimate comes from the files' sizes and the columns read, so no job counts rows first; where Spark knows nothing it is huge.
    """
    size = int(str(right._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return left.join(F.broadcast(right) if size <= limit else right.hint("merge"), on, how)


def top_k(df: DataFrame, k: int, by: list[str], *order: Column) -> DataFrame:
    """The first k rows of each group in the given order; Spark limits each group before and after the shuffle."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("place") <= k)
