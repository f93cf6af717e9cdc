"""Equi-joins whose left side has keys with very many rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner", share: float = 0.25) -> DataFrame:
    """`left.join(right, on, how)` for inner, left, left_semi and left_anti, with the rows of heavy keys of the left side dealt out.

    A counting pass finds the heavy keys: those with more rows than `share` of what one of the session's shuffle partitions would hold
    on average, which are at most partitions / share, so their table is broadcast. Left rows of such a key get one of as many salts as
    its rows fill shares, the right rows of the key go to each of them; all other rows have salt 0 on both sides. One join on
    key and salt then has no large task, on any number of machines. Null keys meet nothing, as in a plain join, and are dealt out too.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a join of kind {how} would give right rows of heavy keys more than once")
    spark = left.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counted = left.groupBy(*(F.col(c).alias(f"__{c}") for c in on)).agg(F.count("*").alias("__n"))
    total = left.count()
    limit = max(1, int(share * total / parts))
    heavy = counted.where(F.col("__n") > limit).withColumn("__salts", F.ceil(F.col("__n") / limit).cast("int")).drop("__n")
    heavy = F.broadcast(heavy)  # no more rows than partitions / share

    def with_salts(df: DataFrame) -> DataFrame:
        same = [df[c].eqNullSafe(heavy[f"__{c}"]) for c in on]
        condition = same[0]
        for c in same[1:]:
            condition = condition & c
        return df.join(heavy, condition, "left").drop(*(f"__{c}" for c in on))

    dealt = with_salts(left).withColumn("__salt", F.coalesce(F.pmod(F.xxhash64(*left.columns, F.monotonically_increasing_id()), F.col("__salts")), F.lit(0)).cast("int")).drop("__salts")
    copied = with_salts(right).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("__salts"), F.lit(1)) - 1))).drop("__salts")
    return dealt.join(copied, [*on, "__salt"], how).drop("__salt")
