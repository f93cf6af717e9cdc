"""Exact order statistics without holding a group: quantiles by narrowing histograms, and inequality joins by running counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemill.sources.tables import through

#: Bins of a range in one pass, and rows of a bin up to which they are sorted.
BINS, LEAF = 4_096, 4_096
#: Groups up to which the table of their ranges is broadcast.
SMALL = 50_000


def _bin(x: Column, lo: Column, hi: Column) -> Column:
    """The bin of a value in a range: never smaller for a larger value, so ranks of bins are ranks of values.

    A range of values of one sign and within a factor of 16 is cut evenly; any other by sign and binary exponent.
    """
    size = F.log2(F.abs(x))
    exponent = F.when(x == 0, 0).otherwise((F.floor(F.greatest(F.least(size, F.lit(1100.0)), F.lit(-1100.0))) + 1101) * F.signum(x)).cast("int")
    even = ((lo > 0) & (hi <= lo * 16)) | ((hi < 0) & (lo >= hi * 16))
    step = F.when(lo == hi, 0).otherwise(F.floor((x - lo) / (hi - lo) * BINS)).cast("int")
    return F.when(F.isnan(x), 5_000).when(even & (F.abs(hi - lo) < F.lit(float("inf"))), step).otherwise(exponent)


def exact_quantiles(df: DataFrame, by: list[str], wanted: dict[str, tuple[str, float]]) -> DataFrame:
    """The columns `by`, and for each name of `wanted` (a numeric column, a share q from 0 to 1) the interpolated quantile, as doubles.

    The value at place q (n - 1) of a group's sorted values, between two of them in proportion. Each pass counts the values of every range in
    BINS bins and goes on with the bin that holds the place, until that bin holds equal values or at most LEAF rows, which are
    sorted; the binary exponent and then 12 bits of the rest are settled by a pass, so no more than eight are needed. A group, however large, is counts
    and never one buffer. Nulls have no place and a group of nulls alone has null; NaN is above all else, as Spark sorts it; null keys are a group.
    """
    columns = sorted({c for c, _ in wanted.values()})
    names = [f"k{i}" for i in range(len(by))]
    keyed = df.select(*(F.col(c).alias(n) for n, c in zip(names, by)), *(F.col(c).cast("double").alias(f"x{i}") for i, c in enumerate(columns)))
    each = F.explode(F.array(*(F.struct(F.lit(i).alias("c"), F.col(f"x{i}").alias("x")) for i in range(len(columns)))))
    values = keyed.select(*names, each.alias("v")).select(F.struct(*names, "v.c").alias("key"), "v.x").where("x IS NOT NULL")
    sizes = through(values.groupBy("key").agg(F.count("*").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi")), "parquet")
    places = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(columns.index(c)).alias("of"), F.lit(float(q)).alias("q")) for name, (c, q) in wanted.items()))
    asked = sizes.withColumn("w", F.explode(places)).where("w.of = key.c").withColumn("place", F.col("w.q") * (F.col("n") - 1))
    asked = asked.select("key", "n", "lo", "hi", "w.name", "place", F.floor("place").alias("low"), F.ceil("place").alias("high"))
    ranks = asked.select("key", F.explode(F.array("low", "high")).alias("rank"), "n", "lo", "hi").distinct()
    state, done = through(ranks.withColumn("left", F.col("rank")), "parquet"), []
    hint = F.broadcast if state.count() <= SMALL else (lambda ranges: ranges)
    range_ = ["key", "lo", "hi"]

    def inside(ranges: DataFrame) -> DataFrame:
        return values.join(hint(ranges.select(*range_).distinct()), "key").where((F.col("x") >= F.col("lo")) & (F.col("x") <= F.col("hi")))

    while not state.isEmpty():
        settled = F.col("lo") == F.col("hi")
        done.append(state.where(settled).select("key", "rank", F.col("lo").alias("x")))
        few, many = state.where(~settled & (F.col("n") <= LEAF)), state.where(~settled & (F.col("n") > LEAF))
        if not few.isEmpty():
            place = F.row_number().over(Window.partitionBy(*range_).orderBy("x")).cast("long") - 1
            done.append(through(few.join(inside(few).withColumn("left", place), [*range_, "left"]).select("key", "rank", "x"), "parquet"))
        bins = inside(many).groupBy(*range_, _bin(F.col("x"), F.col("lo"), F.col("hi")).alias("bin")).agg(F.count("*").alias("m"), F.min("x").alias("new_lo"), F.max("x").alias("new_hi"))
        bins = bins.withColumn("before", F.sum("m").over(Window.partitionBy(*range_).orderBy("bin")) - F.col("m"))
        here = (F.col("left") >= F.col("before")) & (F.col("left") < F.col("before") + F.col("m"))
        narrowed = many.join(bins, range_).where(here)
        state = through(narrowed.select("key", "rank", (F.col("left") - F.col("before")).alias("left"), F.col("m").alias("n"), F.col("new_lo").alias("lo"), F.col("new_hi").alias("hi")), "parquet")
    found = df.sparkSession.createDataFrame([], ranks.select("key", "rank", F.col("lo").alias("x")).schema)
    for part in done:
        found = found.unionByName(part)
    found = through(found, "parquet")
    first, second = (found.select("key", F.col("rank").alias(r), F.col("x").alias(x)) for r, x in (("low", "x0"), ("high", "x1")))
    both = asked.join(first, ["key", "low"]).join(second, ["key", "high"])
    value = F.when(F.col("x0") == F.col("x1"), F.col("x0")).otherwise(F.col("x0") + (F.col("x1") - F.col("x0")) * (F.col("place") - F.col("low")))
    values_of = both.select(*(F.col(f"key.{n}") for n in names), "name", value.alias("value")).unionByName(keyed.select(*names).distinct(), allowMissingColumns=True)
    wide = values_of.groupBy(*names).agg(*(F.max(F.when(F.col("name") == name, F.col("value"))).alias(name) for name in wanted))
    return wide.select(*(F.col(n).alias(c) for n, c in zip(names, by)), *wanted)


def below(left: DataFrame, right: DataFrame, on: str, value: str, count_name: str = "n_below", sum_name: str = "sum_below") -> DataFrame:
    """Every left row with the number of right rows whose `on` is smaller than its own, and the sum of their `value`.

    What a join on left > right and a count would give, without its pairs: rows of equal `on` are summed up first, so a value that a
    third of all rows have is one row; distinct values are dealt out by range, running sums are taken within each range, and what all ranges before
    hold is added. A row of a null `on` counts nothing (0 and null) and is counted by nobody; nulls of `value` add nothing.
    """
    there = right.where(F.col(on).isNotNull()).groupBy(F.col(on).alias("x")).agg(F.count("*").alias("n"), F.sum(value).alias("s"))
    asked = left.where(F.col(on).isNotNull()).select(F.col(on).alias("x")).distinct().select("x", F.lit(0).cast("long").alias("n"), F.lit(None).cast(there.schema["s"].dataType).alias("s"))
    points = there.unionByName(asked).groupBy("x").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    ranged = through(points.repartitionByRange("x").withColumn("part", F.spark_partition_id()), "parquet")  # written, so that parts stay what they are
    totals = ranged.groupBy("part").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))  # a row for each range
    ahead = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("n0"), F.sum("s").over(ahead).alias("s0"))
    inside = Window.partitionBy("part").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    running = ranged.select("part", "x", F.coalesce(F.sum("n").over(inside), F.lit(0)).alias("n1"), F.sum("s").over(inside).alias("s1")).join(F.broadcast(offsets), "part")
    total = F.when(F.col("s0").isNull(), F.col("s1")).when(F.col("s1").isNull(), F.col("s0")).otherwise(F.col("s0") + F.col("s1"))
    running = through(running.select(F.col("x").alias("__x"), (F.col("n0") + F.col("n1")).alias("__n"), total.alias("__s")), "parquet")
    joined = left.join(running, left[on] == running["__x"], "left")
    return joined.select(*(left[c] for c in left.columns), F.coalesce("__n", F.lit(0).cast("long")).alias(count_name), F.col("__s").alias(sum_name))
