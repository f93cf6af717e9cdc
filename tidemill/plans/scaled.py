"""Queries on the library's own operators over the given tables: vectors, near-duplicate texts, order statistics, sketches, skew, markup, turns.

Registered as those of `relational`, each beside the DuckDB SQL that must give the same rows, where SQL can say it.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemill.functions.tables import Runs
from tidemill.operators.near_duplicates import BANDS, ROWS, masks, near_duplicates
from tidemill.operators.order_statistics import below, exact_quantiles
from tidemill.operators.sketches import daily_sketches, merged
from tidemill.operators.skew import salted_join
from tidemill.operators.turns import assembled
from tidemill.operators.vectors import exact_neighbours, index_neighbours, recall
from tidemill.plans.relational import Query
from tidemill.sources.tables import bucketed, overwritten, shared_folder, table, through
from tidemill.streaming import timed

QUERIES: dict[str, Query] = dict(timed.QUERIES)
ORACLES: dict[str, str] = dict(timed.ORACLES)


def query(sql: str | None):
    """Registers a query under its function's name, with its twin in DuckDB's SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


# vectors; the rows that ask are those whose id is divisible by 50


def _asks():
    return F.col("vec_id") % 50 == 0


@query("""SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank
    FROM (SELECT a.vec_id AS query_id, b.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""")
def vec_topk(spark, sf_dir):
    """The ten nearest of each asking row, against all rows in blocks."""
    return exact_neighbours(table(spark, sf_dir, "embeddings"), _asks(), k=10)


@query(None)
def vec_topk_index(spark, sf_dir):
    """The same by the inverted file: its nearest cells alone."""
    return index_neighbours(table(spark, sf_dir, "embeddings"), _asks(), k=10)


@query("SELECT count(*) AS wanted, true AS enough FROM (SELECT unnest(range(least(10, (SELECT count(*) FROM embeddings) - 1))) FROM embeddings WHERE vec_id % 50 = 0)")
def vec_recall(spark, sf_dir):
    """How many neighbours there are by the exact way, and whether the inverted file finds nine in ten."""
    vectors = table(spark, sf_dir, "embeddings")
    exact = through(exact_neighbours(vectors, _asks(), k=10), "parquet")
    return recall(index_neighbours(vectors, _asks(), k=10), exact).select("wanted", (F.col("hits") >= 0.9 * F.col("wanted")).alias("enough"))


# near-duplicate texts

_MINIMA = ", ".join(f"min(xor(h, {m})) AS m{i}" for i, m in enumerate(masks()))
_BANDS = ", ".join(f"md5(concat_ws(',', {b}, {', '.join(f'm{b * ROWS + r}' for r in range(ROWS))}))" for b in range(BANDS))


@query(rf"""WITH RECURSIVE
word AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t-\r]+'), lambda w: w <> '') AS ws FROM documents),
run AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] ELSE list_distinct(list_transform(range(1, greatest(len(ws) - 4, 1) + 1), lambda i: array_to_string(ws[i:i + 4], ' '))) END AS runs FROM word),
hashed AS (SELECT doc_id, list_sort(list_transform(runs, lambda x: CAST('0x' || substr(md5(x), 1, 15) AS BIGINT))) AS hashes FROM run),
sets AS (SELECT min(doc_id) AS set_id, hashes FROM hashed WHERE len(hashes) > 0 GROUP BY hashes),
minima AS (SELECT set_id, {_MINIMA} FROM (SELECT set_id, unnest(hashes) AS h FROM sets) GROUP BY set_id),
bucket AS (SELECT set_id, unnest([{_BANDS}]) AS bucket FROM minima),
pair AS (SELECT DISTINCT a, set_id AS b FROM bucket JOIN (SELECT bucket, min(set_id) AS a FROM bucket GROUP BY bucket) USING (bucket) WHERE set_id <> a),
link AS (SELECT a, b FROM (SELECT pair.*, len(list_intersect(x.hashes, y.hashes)) AS common, len(x.hashes) + len(y.hashes) AS both_ FROM pair JOIN sets x ON x.set_id = a JOIN sets y ON y.set_id = b)
  WHERE 100 * common >= 80 * (both_ - common)),
edge AS (SELECT a, b FROM link UNION SELECT b, a FROM link),
reach AS (SELECT a AS node, a AS seen FROM edge UNION SELECT reach.node, edge.b FROM reach JOIN edge ON edge.a = reach.seen),
component AS (SELECT node, min(seen) AS component FROM reach GROUP BY node)
SELECT doc_id, CAST(len(hashed.hashes) AS BIGINT) AS n_shingles, coalesce(component, set_id, doc_id) AS group_id FROM hashed LEFT JOIN sets ON sets.hashes = hashed.hashes LEFT JOIN component ON node = set_id""")
def text_dedup_near(spark, sf_dir):
    """Groups of documents alike at 0.8 or more by five-word runs, through star links of MinHash buckets."""
    return near_duplicates(table(spark, sf_dir, "documents"))


# order statistics


@query("""SELECT l_returnflag, l_linestatus, median(l_quantity) AS mid, quantile_cont(l_extendedprice, 0.9) AS p90, quantile_cont(l_extendedprice, 0.999) AS p999,
    quantile_cont(l_tax, 0.25) AS q1 FROM lineitem GROUP BY ALL""")
def agg_quantiles(spark, sf_dir):
    """Exact quantiles of large groups by narrowing histograms."""
    wanted = {"mid": ("l_quantity", 0.5), "p90": ("l_extendedprice", 0.9), "p999": ("l_extendedprice", 0.999), "q1": ("l_tax", 0.25)}
    return exact_quantiles(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], wanted)


@query("""SELECT a.o_orderkey, count(b.o_orderkey) AS n_below, round(sum(b.o_totalprice), 2) AS sum_below
    FROM orders a LEFT JOIN orders b ON b.o_totalprice < a.o_totalprice AND b.o_orderstatus = 'F' GROUP BY a.o_orderkey""")
def join_inequality(spark, sf_dir):
    """For each order, how many finished orders are cheaper, and what they come to: orders with orders on an inequality alone."""
    orders = table(spark, sf_dir, "orders")
    found = below(orders.select("o_orderkey", "o_totalprice"), orders.where("o_orderstatus = 'F'").select("o_totalprice", F.col("o_totalprice").alias("price")), "o_totalprice", "price")
    return found.select("o_orderkey", "n_below", F.round("sum_below", 2).alias("sum_below"))


# skew, sketches, sinks, table functions


@query("""SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM (SELECT CASE WHEN l_orderkey % 3 = 0 THEN 1 ELSE l_orderkey END AS k, l_quantity FROM lineitem)
    JOIN orders ON k = o_orderkey GROUP BY o_orderpriority""")
def join_skew(spark, sf_dir):
    """Lines with their orders, where a third of all lines have one order: its key is salted."""
    key = F.when(F.col("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_orderkey")).alias("k")
    lines = table(spark, sf_dir, "lineitem").select(key, "l_quantity")
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_orderpriority")
    return salted_join(lines, orders, ["k"]).groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


@query("SELECT event_type, count(DISTINCT user_id) AS exact, true AS near FROM events GROUP BY ROLLUP (event_type)")
def agg_sketches(spark, sf_dir):
    """Users of each event type and of all, by daily sketches merged upwards, held against exact counts: within 5 %."""
    events = table(spark, sf_dir, "events")
    days = daily_sketches(events, "ts", ["event_type"], "user_id")
    types = merged(days, "event_type")
    whole = merged(types.drop("estimate"), F.lit(None).cast("string").alias("event_type"))
    exact = events.rollup("event_type").agg(F.countDistinct("user_id").alias("exact"))
    both = exact.join(F.broadcast(types.unionByName(whole).select(F.col("event_type").alias("t"), "estimate")), F.col("event_type").eqNullSafe(F.col("t")))
    return both.select("event_type", "exact", (F.abs(F.col("estimate") - F.col("exact")) <= 0.05 * F.col("exact")).alias("near"))


@query("SELECT o_orderkey, o_orderpriority, count(*) AS n FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY ALL")
def sink_bucketed(spark, sf_dir):
    """Orders and lines as tables bucketed by order: joined and counted without moving a row."""
    orders = bucketed(table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey")
    lines = bucketed(table(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey")
    joined = orders.hint("merge").join(lines, orders["o_orderkey"] == lines["l_orderkey"])
    return joined.groupBy("o_orderkey", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice * 2 ELSE o_totalprice END AS price, o_orderstatus FROM orders")
def sink_overwrite(spark, sf_dir):
    """A table in folders by status, one of which is written anew, twice."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("price"), "o_orderstatus")
    path = shared_folder(spark, "overwritten")
    orders.write.partitionBy("o_orderstatus").parquet(path)
    doubled = orders.where("o_orderstatus = 'F'").withColumn("price", F.col("price") * 2)
    for _ in range(2):  # as a driver that tries again would
        overwritten(doubled, path, "o_orderstatus")
    return spark.read.schema(orders.schema).parquet(path)


@query("""WITH a AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS island FROM events)
    SELECT user_id, event_type, arg_min(event_id, (ts, event_id)) AS first, arg_max(event_id, (ts, event_id)) AS last, count(*) AS n FROM a GROUP BY user_id, event_type, island""")
def udtf_runs(spark, sf_dir):
    """Runs of events of one type of each user, by a table function."""
    events = table(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "ts")
    return Runs(events.asTable().partitionBy("user_id").orderBy("ts", "event_id"), F.lit("user_id"), F.lit("event_type"), F.lit("event_id"))


@query("""SELECT conv_id, turn, role, row_number() OVER w AS position, greatest(coalesce(turn - lag(turn) OVER w - 1, 0), 0) AS gap, coalesce(turn = lag(turn) OVER w, false) AS repeated
    FROM (SELECT * FROM conversations WHERE turn <> 2 UNION ALL SELECT * FROM conversations WHERE turn = 4) WINDOW w AS (PARTITION BY conv_id ORDER BY turn)""")
def conv_assemble(spark, sf_dir):
    """Turns of each conversation in order, from rows that lack the third turn and bring the fifth twice."""
    turns = table(spark, sf_dir, "conversations")
    return assembled(turns.where("turn <> 2").unionByName(turns.where("turn = 4")).select("conv_id", "turn", "role"), "conv_id", "turn", "role")
