"""Relational queries over the star-schema tables, each with the DuckDB SQL that must give the same rows.

Everything is declared with DataFrames or Spark SQL and left to Catalyst: filters and columns reach the scans, aggregates
combine before they shuffle, and joins pick their strategy at run time. Money sums are rounded, as the order in which
partial sums meet is not fixed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemill.functions.stats import geometric_mean, softsign
from tidemill.operators.joins import asof_join, band_join, interval_join, small_or_merge, top_k
from tidemill.operators.order_statistics import exact_quantiles
from tidemill.sources.tables import partitioned, table, through
from tidemill.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = dict(streams.QUERIES)
ORACLES: dict[str, str] = dict(streams.ORACLES)


#: Users that one call of a function on groups is given, on average.
USERS = 4_096


def query(sql: str | None) -> Callable[[Query], Query]:
    """Registers a query under its function's name, with its twin in DuckDB's SQL."""

    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _revenue():
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def _sql(spark: SparkSession, sf_dir: str, text: str, *names: str) -> DataFrame:
    """Spark SQL over tables given by name as parameters of the statement, without leaving views behind."""
    return spark.sql(text, **{n: table(spark, sf_dir, n) for n in names})


# scans and sinks


@query("""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty,
    round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n_rows FROM lineitem GROUP BY ALL""")
def agg_hash(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.groupBy("l_returnflag", "l_linestatus").agg(
        F.round(F.sum("l_quantity"), 2).alias("sum_qty"), F.round(F.sum(_revenue()), 2).alias("revenue"), F.count("*").alias("n_rows")
    )


@query("SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity > 40 AND l_shipdate >= TIMESTAMP '1997-01-01'")
def scan_parquet(spark, sf_dir):
    line = table(spark, sf_dir, "lineitem")
    return line.where((F.col("l_quantity") > 40) & (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz"))).select("l_orderkey", "l_quantity")


_ORDERS = "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders"


@query(_ORDERS)
def scan_csv(spark, sf_dir):
    return through(table(spark, sf_dir, "orders"), "csv", header="true")


@query(_ORDERS)
def scan_json(spark, sf_dir):
    return through(table(spark, sf_dir, "orders"), "json")


@query(_ORDERS)
def scan_orc(spark, sf_dir):
    return through(table(spark, sf_dir, "orders"), "orc")


@query("SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_orderstatus = 'F'")
def sink_partitioned(spark, sf_dir):
    return partitioned(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderstatus"), "o_orderstatus").where("o_orderstatus = 'F'")


# projections and predicates


@query("""SELECT o_orderkey, CASE WHEN o_totalprice > 300000 THEN 'large' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'small' END AS size,
    CAST(floor(o_totalprice) AS BIGINT) AS whole, TRY_CAST(o_orderpriority AS INTEGER) AS not_a_number FROM orders""")
def project_case(spark, sf_dir):
    price = F.col("o_totalprice")
    size = F.when(price > 300000, "large").when(price > 100000, "middle").otherwise("small")
    return table(spark, sf_dir, "orders").select("o_orderkey", size.alias("size"), F.floor(price).cast("bigint").alias("whole"), F.col("o_orderpriority").try_cast("int").alias("not_a_number"))


@query("""SELECT p_partkey, p_size, p_brand, p_name FROM part WHERE p_size BETWEEN 10 AND 30 AND p_brand IN ('Brand#1', 'Brand#12', 'Brand#23')
    AND p_name LIKE '%a%' AND regexp_matches(p_brand, '#[0-9]+$')""")
def filter_predicates(spark, sf_dir):
    keep = F.col("p_size").between(10, 30) & F.col("p_brand").isin("Brand#1", "Brand#12", "Brand#23") & F.col("p_name").like("%a%") & F.col("p_brand").rlike("#[0-9]+$")
    return table(spark, sf_dir, "part").where(keep).select("p_partkey", "p_size", "p_brand", "p_name")


# joins


@query("""SELECT n_name, r_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS n FROM lineitem
    JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey AND s_nationkey = c_nationkey
    JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""")
def join_inner_multi(spark, sf_dir):
    line, orders, customer, supplier, nation, region = (table(spark, sf_dir, t) for t in ("lineitem", "orders", "customer", "supplier", "nation", "region"))
    joined = (
        line.join(orders, line["l_orderkey"] == orders["o_orderkey"])
        .join(customer, orders["o_custkey"] == customer["c_custkey"])
        .join(supplier, (line["l_suppkey"] == supplier["s_suppkey"]) & (supplier["s_nationkey"] == customer["c_nationkey"]))
        .join(nation, supplier["s_nationkey"] == nation["n_nationkey"])
        .join(region, nation["n_regionkey"] == region["r_regionkey"])
    )
    return joined.groupBy("n_name", "r_name").agg(F.round(F.sum(_revenue()), 2).alias("revenue"), F.count("*").alias("n"))


def _outer(spark, sf_dir, how):
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 25")
    return orders.join(line, orders["o_orderkey"] == line["l_orderkey"], how).select("o_orderkey", "o_orderstatus", "l_orderkey", "l_partkey", "l_quantity")


def _outer_sql(how):
    return f"SELECT o_orderkey, o_orderstatus, l_orderkey, l_partkey, l_quantity FROM orders {how} JOIN (SELECT * FROM lineitem WHERE l_quantity > 25) ON o_orderkey = l_orderkey"


for _name, _how in (("join_left", "left"), ("join_right", "right"), ("join_full", "full")):
    QUERIES[_name] = lambda spark, sf_dir, how=_how: _outer(spark, sf_dir, how)
    ORACLES[_name] = _outer_sql(_how.upper())


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_quantity > 49)")
def join_semi(spark, sf_dir):
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem").where("l_quantity > 49")
    return orders.join(line, orders["o_orderkey"] == line["l_orderkey"], "left_semi").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def join_anti(spark, sf_dir):
    orders, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    return orders.join(line, orders["o_orderkey"] == line["l_orderkey"], "left_anti").select("o_orderkey", "o_totalprice")


@query("SELECT o_orderkey FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)")
def join_not_in(spark, sf_dir):
    """Spark can only broadcast the whole list of a NOT IN; an anti join on equal keys is a shuffle, and one row of counts says what nulls and an empty list do to it."""
    orders, keys = table(spark, sf_dir, "orders").select("o_orderkey"), table(spark, sf_dir, "lineitem").select("l_orderkey")
    counts = keys.agg(F.count("*").alias("listed"), F.count_if(F.col("l_orderkey").isNull()).alias("nulls"))
    missing = orders.join(keys.where("l_orderkey IS NOT NULL"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti")
    return missing.crossJoin(F.broadcast(counts)).where("listed = 0 OR (nulls = 0 AND o_orderkey IS NOT NULL)").select("o_orderkey")


@query("""SELECT s_nationkey, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY s_nationkey""")
def join_by_size(spark, sf_dir):
    line, supplier = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier").withColumnRenamed("s_suppkey", "l_suppkey")
    return small_or_merge(line, supplier, ["l_suppkey"], "inner").groupBy("s_nationkey").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


def _hinted(spark: SparkSession, sf_dir: str, hint: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderpriority")
    line = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity")
    return line.join(orders.hint(hint), "o_orderkey").groupBy("o_orderpriority").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("qty"))


for _name, _hint in (("join_merge", "merge"), ("join_shuffle_hash", "shuffle_hash")):
    QUERIES[_name] = lambda spark, sf_dir, hint=_hint: _hinted(spark, sf_dir, hint)
    ORACLES[_name] = "SELECT o_orderpriority, count(*) AS n, round(sum(l_quantity), 2) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY o_orderpriority"


@query("SELECT event_id, props->>'$.k' AS k FROM events")
def fn_json_path(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"))


@query("""SELECT a.s_nationkey, count(*) AS pairs FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal GROUP BY a.s_nationkey""")
def join_theta(spark, sf_dir):
    a, b = table(spark, sf_dir, "supplier").alias("a"), table(spark, sf_dir, "supplier").alias("b")
    pairs = a.join(b, F.expr("a.s_nationkey = b.s_nationkey AND a.s_acctbal < b.s_acctbal"))
    return pairs.groupBy(F.col("a.s_nationkey").alias("s_nationkey")).agg(F.count("*").alias("pairs"))


@query("SELECT a.s_suppkey, b.s_suppkey AS r_s_suppkey FROM supplier a JOIN supplier b ON b.s_acctbal > a.s_acctbal AND b.s_acctbal - a.s_acctbal <= 64")
def join_band(spark, sf_dir):
    balances = table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal")
    return band_join(balances, balances, "s_acctbal", 64).select("s_suppkey", "r_s_suppkey")


@query("""SELECT c.user_id, c.event_id, p.event_id AS r_event_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click'
    AND p.event_type = 'purchase' AND p.ts > c.ts AND p.ts <= c.ts + INTERVAL 30 MINUTE""")
def join_interval(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return interval_join(e.where("event_type = 'click'"), e.where("event_type = 'purchase'"), ["user_id"], "ts", "30 MINUTES", 1800).select("user_id", "event_id", "r_event_id")


@query("""SELECT e.event_id, e.user_id, v.event_id AS asof_event_id FROM (SELECT * FROM events WHERE event_type = 'purchase') e
    ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'view') v ON e.user_id = v.user_id AND e.ts >= v.ts""")
def join_asof(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", "event_type")
    return asof_join(e.where("event_type = 'purchase'"), e.where("event_type = 'view'"), ["user_id"], "ts", "event_id").select("event_id", "user_id", "asof_event_id")


@query("SELECT r_name, n_name FROM region, nation")
def join_cross(spark, sf_dir):
    return table(spark, sf_dir, "nation").crossJoin(F.broadcast(table(spark, sf_dir, "region"))).select("r_name", "n_name")  # five regions


# aggregates


@query("SELECT event_type, count(DISTINCT user_id) AS users, count(DISTINCT props) AS props_seen FROM events GROUP BY event_type")
def agg_distinct(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.countDistinct("user_id").alias("users"), F.countDistinct("props").alias("props_seen"))


@query("SELECT event_type, count(*) FILTER (WHERE value > 50) AS large, count(*) AS n FROM events GROUP BY event_type")
def agg_filter(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count_if(F.col("value") > 50).alias("large"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def agg_rollup(spark, sf_dir):
    return table(spark, sf_dir, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, CAST(grouping(o_orderstatus) AS INTEGER) AS over_status, count(*) AS n FROM orders GROUP BY CUBE (o_orderstatus, o_orderpriority)")
def agg_cube(spark, sf_dir):
    return table(spark, sf_dir, "orders").cube("o_orderstatus", "o_orderpriority").agg(F.grouping("o_orderstatus").cast("int").alias("over_status"), F.count("*").alias("n"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def agg_grouping_sets(spark, sf_dir):
    text = "SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM {orders} GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())"
    return _sql(spark, sf_dir, text, "orders")


@query("""SELECT l_returnflag, round(stddev_samp(l_quantity), 6) AS sd, round(var_pop(l_quantity), 6) AS var, median(l_quantity) AS mid,
    quantile_cont(l_extendedprice, 0.9) AS p90, min(l_discount) AS least, max(l_tax) AS most FROM lineitem GROUP BY l_returnflag""")
def agg_stats(spark, sf_dir):
    q, line = F.col("l_quantity"), table(spark, sf_dir, "lineitem")
    moments = line.groupBy("l_returnflag").agg(F.round(F.stddev_samp(q), 6).alias("sd"), F.round(F.var_pop(q), 6).alias("var"), F.min("l_discount").alias("least"), F.max("l_tax").alias("most"))
    quantiles = exact_quantiles(line, ["l_returnflag"], {"mid": ("l_quantity", 0.5), "p90": ("l_extendedprice", 0.9)}).withColumnRenamed("l_returnflag", "flag")
    return moments.join(quantiles, F.col("l_returnflag").eqNullSafe(F.col("flag"))).select("l_returnflag", "sd", "var", "mid", "p90", "least", "most")


@query("""WITH m AS (SELECT l_returnflag, count(*) AS n, avg(l_tax) AS a, avg(l_tax * l_tax) AS b, avg(l_tax * l_tax * l_tax) AS c FROM lineitem GROUP BY 1)
    SELECT l_returnflag, round((c - 3 * a * b + 2 * a * a * a) / pow(b - a * a, 1.5), 6) AS skew FROM m""")
def agg_skewness(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.skewness("l_tax"), 6).alias("skew"))


@query("SELECT l_returnflag, round(kurtosis_pop(l_quantity), 6) AS kurt FROM lineitem GROUP BY l_returnflag")
def agg_kurtosis(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.round(F.kurtosis("l_quantity"), 6).alias("kurt"))


@query(None)
def agg_approx_distinct(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey", 0.02).alias("parts"))


@query("SELECT n_regionkey, list_sort(list(n_name)) AS names FROM nation GROUP BY n_regionkey")
def agg_collect(spark, sf_dir):
    return table(spark, sf_dir, "nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_name")).alias("names"))


_TYPES = ("click", "error", "purchase", "signup", "view")


@query("SELECT user_id, " + ", ".join(f"count(*) FILTER (WHERE event_type = '{t}') AS \"{t}\"" for t in _TYPES) + " FROM events GROUP BY user_id")
def agg_pivot(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy("user_id").pivot("event_type", list(_TYPES)).agg(F.count(F.lit(1))).fillna(0)


@query("""SELECT s_suppkey, 'acctbal' AS name, s_acctbal AS amount FROM supplier UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS DOUBLE) FROM supplier""")
def unpivot(spark, sf_dir):
    wide = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_acctbal").alias("acctbal"), F.col("s_nationkey").cast("double").alias("nation"))
    return wide.unpivot("s_suppkey", ["acctbal", "nation"], "name", "amount")


# windows


@query("""SELECT c_custkey, CAST(rank() OVER w AS INTEGER) AS r, CAST(dense_rank() OVER w AS INTEGER) AS d, CAST(ntile(4) OVER w AS INTEGER) AS q,
    percent_rank() OVER w AS p, cume_dist() OVER w AS c, CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY c_mktsegment, c_custkey) AS INTEGER) AS n
    FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey)""")
def win_rank(spark, sf_dir):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf_dir, "customer").select(
        "c_custkey", F.rank().over(w).alias("r"), F.dense_rank().over(w).alias("d"), F.ntile(4).over(w).alias("q"), F.percent_rank().over(w).alias("p"),
        F.cume_dist().over(w).alias("c"), F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_mktsegment", "c_custkey")).alias("n"),
    )


@query("""SELECT event_id, lag(value) OVER w AS before, lead(value, 2) OVER w AS later, first_value(event_id) OVER w AS opening,
    nth_value(event_id, 3) OVER w AS third FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)""")
def win_analytic(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, sf_dir, "events").select(
        "event_id", F.lag("value").over(w).alias("before"), F.lead("value", 2).over(w).alias("later"), F.first("event_id").over(w).alias("opening"), F.nth_value("event_id", 3).over(w).alias("third")
    )


@query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 3 PRECEDING AND 1 FOLLOWING), 4) AS near FROM events")
def win_frame_rows(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-3, 1)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 4).alias("near"))


@query("SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n FROM events")
def win_frame_range(spark, sf_dir):
    text = "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS day_n FROM {events}"
    return _sql(spark, sf_dir, text, "events")


# order and limits


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25")
def sort_topk(spark, sf_dir):
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(25)


@query("""SELECT o_custkey, o_orderkey, o_totalprice, CAST(place AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey
    ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders) WHERE place <= 3""")
def topk_per_group(spark, sf_dir):
    return top_k(table(spark, sf_dir, "orders"), 3, ["o_custkey"], F.desc("o_totalprice"), F.asc("o_orderkey")).select("o_custkey", "o_orderkey", "o_totalprice", "place")


# set operations


_SETS = {
    "set_union": ("UNION", lambda a, b: a.union(b).distinct()), "set_union_all": ("UNION ALL", lambda a, b: a.union(b)),
    "set_intersect": ("INTERSECT", lambda a, b: a.intersect(b)), "set_intersect_all": ("INTERSECT ALL", lambda a, b: a.intersectAll(b)),
    "set_except": ("EXCEPT", lambda a, b: a.subtract(b)), "set_except_all": ("EXCEPT ALL", lambda a, b: a.exceptAll(b)),
}


def _set(spark, sf_dir, combine):
    e = table(spark, sf_dir, "events")
    return combine(e.where("event_type = 'click'").select("user_id", "props"), e.where("event_type = 'view'").select("user_id", "props"))


for _name, (_word, _combine) in _SETS.items():
    QUERIES[_name] = lambda spark, sf_dir, combine=_combine: _set(spark, sf_dir, combine)
    ORACLES[_name] = f"SELECT user_id, props FROM events WHERE event_type = 'click' {_word} SELECT user_id, props FROM events WHERE event_type = 'view'"


# subqueries and common table expressions


@query("SELECT o_orderkey FROM orders WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM orders)")
def subquery_scalar(spark, sf_dir):
    return _sql(spark, sf_dir, "SELECT o_orderkey FROM {orders} WHERE o_totalprice > (SELECT avg(o_totalprice) * 1.5 FROM {orders})", "orders")


_CORRELATED = "SELECT l_orderkey, l_partkey, l_quantity FROM {0} a WHERE l_quantity > (SELECT 1.5 * avg(l_quantity) FROM {0} b WHERE b.l_partkey = a.l_partkey)"


@query(_CORRELATED.format("lineitem"))
def subquery_correlated(spark, sf_dir):
    return _sql(spark, sf_dir, _CORRELATED.format("{lineitem}"), "lineitem")


_CTE = """WITH spent AS (SELECT o_custkey, sum(o_totalprice) AS total, count(*) AS n FROM {orders} GROUP BY o_custkey), many AS (SELECT * FROM spent WHERE n > 10)
    SELECT c_mktsegment, count(*) AS customers, round(sum(total), 2) AS total FROM many JOIN {customer} ON o_custkey = c_custkey GROUP BY c_mktsegment"""


@query(_CTE.format(orders="orders", customer="customer"))
def cte(spark, sf_dir):
    return _sql(spark, sf_dir, _CTE, "orders", "customer")


_RECURSIVE = """WITH RECURSIVE numbers(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM numbers WHERE n < 7)
    SELECT n, count(l_linenumber) AS n_lines FROM numbers LEFT JOIN {lineitem} ON n = l_linenumber GROUP BY n"""


@query(_RECURSIVE.format(lineitem="lineitem"))
def recursive_cte(spark, sf_dir):
    """Lines are counted by number before they meet the seven numbers: a join on a handful of keys would hold all lines of a key in one task."""
    text = """WITH RECURSIVE numbers(n) AS (SELECT 1 UNION ALL SELECT n + 1 FROM numbers WHERE n < 7),
        counted AS (SELECT l_linenumber, count(l_linenumber) AS n_lines FROM {lineitem} GROUP BY l_linenumber)
        SELECT n, coalesce(n_lines, 0) AS n_lines FROM numbers LEFT JOIN counted ON n = l_linenumber"""
    return _sql(spark, sf_dir, text, "lineitem")


@query("""SELECT c_custkey, o_orderkey FROM customer, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY o_totalprice DESC, o_orderkey LIMIT 2)""")
def lateral(spark, sf_dir):
    # Spark turns ORDER BY and LIMIT of a lateral subquery into row numbers without an order of their own, which a shuffle can disturb
    text = """SELECT c_custkey, o_orderkey FROM {customer}, LATERAL (SELECT o_orderkey FROM (SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC NULLS LAST, o_orderkey NULLS LAST) AS place FROM {orders}) WHERE o_custkey = c_custkey AND place <= 2)"""
    return _sql(spark, sf_dir, text, "customer", "orders")


# scalar functions


@query("""SELECT p_partkey, lower(p_name) AS low, trim(p_type) AS trimmed, string_split(p_brand, '#')[2] AS number, substr(p_name, 2, 3) AS middle, length(p_name) AS size,
    regexp_replace(p_name, '[aeiou]', '', 'g') AS consonants, md5(p_brand) AS digest, sha256(p_brand) AS digest2, CAST(levenshtein(p_brand, p_type) AS INTEGER) AS distance FROM part""")
def fn_string(spark, sf_dir):
    return table(spark, sf_dir, "part").select(
        "p_partkey", F.lower("p_name").alias("low"), F.trim("p_type").alias("trimmed"), F.element_at(F.split("p_brand", "#"), 2).alias("number"), F.substring("p_name", 2, 3).alias("middle"),
        F.length("p_name").cast("bigint").alias("size"), F.regexp_replace("p_name", "[aeiou]", "").alias("consonants"), F.md5("p_brand").alias("digest"), F.sha2("p_brand", 256).alias("digest2"),
        F.levenshtein("p_brand", "p_type").alias("distance"),
    )


@query("""SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS month, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(quarter(o_orderdate) AS INTEGER) AS q,
    CAST(date_diff('day', TIMESTAMP '1995-01-01', o_orderdate) AS INTEGER) AS days, o_orderdate + INTERVAL 36 HOUR AS later FROM orders""")
def fn_date(spark, sf_dir):
    day = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", F.date_trunc("month", day).cast("timestamp_ntz").alias("month"), F.year(day).alias("y"), F.quarter(day).alias("q"),
        F.datediff(day, F.lit("1995-01-01").cast("date")).alias("days"), (day + F.expr("INTERVAL 36 HOURS")).alias("later"),
    )


@query("""SELECT l_orderkey, l_partkey, round(ln(l_extendedprice), 8) AS natural, round(log10(l_extendedprice), 8) AS common, CAST(l_orderkey % 7 AS BIGINT) AS rest,
    round(sqrt(l_quantity) * power(l_tax + 1, 2), 8) AS mixed, abs(l_discount - 0.05) AS distance, CAST(ceil(l_extendedprice) AS BIGINT) AS above FROM lineitem""")
def fn_math(spark, sf_dir):
    price = F.col("l_extendedprice")
    return table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", F.round(F.ln(price), 8).alias("natural"), F.round(F.log10(price), 8).alias("common"), (F.col("l_orderkey") % 7).cast("bigint").alias("rest"),
        F.round(F.sqrt("l_quantity") * F.pow(F.col("l_tax") + 1, F.lit(2)), 8).alias("mixed"), F.abs(F.col("l_discount") - 0.05).alias("distance"), F.ceil(price).cast("bigint").alias("above"),
    )


@query("""WITH a AS (SELECT o_custkey, list_sort(list(o_orderkey)) AS keys FROM orders GROUP BY o_custkey)
    SELECT o_custkey, list_transform(keys, lambda x: x * 2) AS doubled, list_filter(keys, lambda x: x % 2 = 0) AS even, list_contains(keys, 7) AS has_7, CAST(len(keys) AS INTEGER) AS n FROM a""")
def fn_array(spark, sf_dir):
    keys = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.sort_array(F.collect_list("o_orderkey")).alias("keys"))
    return keys.select("o_custkey", F.transform("keys", lambda x: x * 2).alias("doubled"), F.filter("keys", lambda x: x % 2 == 0).alias("even"), F.array_contains("keys", 7).alias("has_7"), F.size("keys").alias("n"))


@query("SELECT user_id, event_type AS k, max(value) AS v FROM events GROUP BY ALL")
def fn_map(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    maps = best.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))
    return maps.select("user_id", F.explode("m").alias("k", "v"))


@query("SELECT user_id, upper(event_type) AS k, max(value) * 2 AS v FROM events GROUP BY user_id, event_type HAVING max(value) > 1")
def fn_map_transform(spark, sf_dir):
    best = table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max("value").alias("v"))
    maps = best.groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "v"))).alias("m"))  # one entry for each type
    changed = F.transform_keys(F.transform_values(F.map_filter("m", lambda k, v: v > 1), lambda k, v: v * 2), lambda k, v: F.upper(k))
    return maps.select("user_id", F.explode(changed).alias("k", "v"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fn_json(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS host, regexp_extract(url, '^([a-z]+):', 1) AS scheme FROM pages")
def fn_url(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", F.parse_url("url", F.lit("HOST")).alias("host"), F.parse_url("url", F.lit("PROTOCOL")).alias("scheme"))


# functions of the user


@query("SELECT n_nationkey, reverse(n_name) AS mirrored FROM nation")
def udf_plain(spark, sf_dir):
    mirrored = F.udf(lambda text: None if text is None else text[::-1], "string")  # row by row: for small tables alone
    return table(spark, sf_dir, "nation").select("n_nationkey", mirrored("n_name").alias("mirrored"))


@query("SELECT event_id, value / (1 + abs(value)) AS soft FROM events")
def udf_pandas(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", softsign("value").alias("soft"))


@query("SELECT event_type, round(exp(avg(ln(value)) FILTER (WHERE value > 0)), 6) AS mean FROM events GROUP BY event_type")
def udaf_pandas(spark, sf_dir):
    return geometric_mean(table(spark, sf_dir, "events"), "event_type", "value").select("event_type", F.round("mean", 6).alias("mean"))


@query("SELECT p_partkey, unnest(string_split(p_name, ' ')) AS word FROM part")
def udtf_words(spark, sf_dir):
    @F.udtf(returnType=T.StructType([T.StructField("word", T.StringType())]))
    class Words:
        def eval(self, text: str):
            for word in [] if text is None else text.split(" "):  # a null text has no words
                yield (word,)

    part = table(spark, sf_dir, "part").select("p_partkey", "p_name")
    return part.lateralJoin(Words(F.col("p_name").outer())).select("p_partkey", "word")


@query("""SELECT user_id, count(*) FILTER (WHERE event_type = 'click') AS clicks, count(*) FILTER (WHERE event_type = 'view') AS views FROM events
    WHERE event_type IN ('click', 'view') GROUP BY user_id""")
def cogroup_pandas(spark, sf_dir):
    """Clicks and views of each user, met in pandas in groups of many users: a call of Python for each user would cost more than all else."""
    import pandas as pd

    def both(clicks: pd.DataFrame, views: pd.DataFrame) -> pd.DataFrame:
        sides = [side.assign(clicks=side["n"] * (i == 0), views=side["n"] * (i == 1)) for i, side in enumerate((clicks, views)) if len(side)]  # an empty side has no columns
        return pd.concat(sides).groupby(["nobody", "user_id"], as_index=False)[["clicks", "views"]].sum()

    def side(kind: str) -> DataFrame:  # each reads the table itself: a cogroup takes columns that both sides share for its left ones
        e = table(spark, sf_dir, "events").where(F.col("event_type") == kind).groupBy("user_id").agg(F.count("*").alias("n"))  # one row of a user
        return e.select(F.pmod(F.xxhash64("user_id"), F.lit(groups)).alias("part"), F.col("user_id").isNull().alias("nobody"), F.coalesce("user_id", F.lit(0)).cast("long").alias("user_id"), "n")

    groups = -(-table(spark, sf_dir, "events").agg(F.approx_count_distinct("user_id")).first()[0] // USERS) or 1  # as the users, so a group stays small
    found = side("click").groupBy("part").cogroup(side("view").groupBy("part")).applyInPandas(both, "nobody boolean, user_id long, clicks long, views long")
    return found.select(F.when(~F.col("nobody"), F.col("user_id")).alias("user_id"), "clicks", "views")
