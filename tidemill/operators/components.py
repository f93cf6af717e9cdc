"""Connected components of an undirected graph, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemill.sources.tables import written


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """node and component (its smallest node) for every node that has an edge; edges: columns a, b of one type.

    Each round links every node's larger neighbours to its smallest one, then every node and its smaller neighbours to
    the smallest; rounds grow with the logarithm of a component's width. Every step aggregates by key before it joins,
    and what a join reads is written to the shared folder first: both sides then come straight out of a shuffle, and Spark
    can split the rows of a node with very many neighbours over tasks. Loops, repeated edges and edges with a null end are harmless.
    """
    pairs = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("a <> b").distinct()
    state, last = written(pairs, name), None
    while True:
        both = state.unionByName(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m")), name)
        large = written(both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), name)
        least = written(large.groupBy("u").agg(F.min("v").alias("m")), name)
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(least.select("u", F.col("m").alias("v")))
        state = written(small.distinct(), name)
        now = state.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == last or now[0] == 0:
            break
        last = now
    return state.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(state.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
