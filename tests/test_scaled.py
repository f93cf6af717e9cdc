"""The library's own operators against plain definitions, their plans, hot groups and edge cases."""

import io
import math
import random
import re
from contextlib import redirect_stdout

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import same
from tidemill.operators import near_duplicates as near_duplicates_module
from tidemill.operators import order_statistics, vectors
from tidemill.functions.tables import Runs
from tidemill.operators.joins import small_or_merge
from tidemill.operators.near_duplicates import near_duplicates, shingle_sets, star_links
from tidemill.operators.order_statistics import below, exact_quantiles
from tidemill.operators.sketches import daily_sketches, merged
from tidemill.operators.skew import salted_join
from tidemill.operators.turns import assembled
from tidemill.operators.vectors import exact_neighbours, index_neighbours, inverted_file, recall
from tidemill.plans.scaled import ORACLES, QUERIES
from tidemill.streaming.timed import clicks_with_purchases, sessions_read, timed_sessions

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        same(df, SF, ORACLES[name])
    else:
        assert df.count() > 0


def plan(df) -> str:
    out = io.StringIO()
    with redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


# vectors


def nearest(rows, asked, k):
    out = set()
    for i, v in rows:
        if i is None or v is None or not asked(i):
            continue
        scores = sorted((-round(float(np.dot(np.array(v, dtype=np.float64), np.array(w, dtype=np.float64))), 6), j) for j, w in rows if j is not None and w is not None and j != i)
        out |= {(i, rank, j, -s) for rank, (s, j) in enumerate(scores[:k], 1)}
    return out


def made_vectors(n=300, hot=120):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=6).astype(np.float32).tolist()) for i in range(n)]
    rows += [(1_000 + i, rows[0][1]) for i in range(hot)]  # copies, more than any list holds
    return [*rows, (None, rows[1][1]), (5_000, None)]


def table_of(spark, rows):
    return spark.createDataFrame([(*r, "clash") for r in rows], "vec_id long, embedding array<float>, key string").repartition(5)


@pytest.mark.parametrize("block", [4_096, 7])
def test_exact_neighbours(spark, monkeypatch, block):
    monkeypatch.setattr(vectors, "BLOCK", block)
    rows = made_vectors()
    found = exact_neighbours(table_of(spark, rows), F.col("vec_id") % 10 == 0, k=4).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in found} == nearest(rows, lambda i: i % 10 == 0, 4)
    assert len(found) == len(set(found))


def test_index_of_all_cells_is_exact(spark, monkeypatch):
    monkeypatch.setattr(vectors, "PIECE", 50)  # cells and their questions are cut
    rows = made_vectors()
    found = index_neighbours(table_of(spark, rows), F.col("vec_id") % 10 == 0, k=4, probes=1_000, per_cell=20).collect()
    assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in found} == nearest(rows, lambda i: i % 10 == 0, 4)


def test_scores_held_at_once_are_few(spark, monkeypatch):
    """Whatever the questions, rows and centres, a task scores them in pieces; the pieces change nothing."""
    rows, sizes = made_vectors(), []
    monkeypatch.setattr(vectors, "HELD", 3_000)
    rng = np.random.default_rng(3)
    points, centres = rng.normal(size=(500, 6)), rng.normal(size=(70, 6))
    cell, near = vectors._nearest(points, centres)
    full = ((points[:, None, :] - centres) ** 2).sum(axis=2)
    assert (cell == full.argmin(axis=1)).all() and np.allclose(near, full.min(axis=1))
    best = vectors._best
    monkeypatch.setattr(vectors, "_best", lambda score, ids, k: sizes.append(score.size) or best(score, ids, k))
    batch = vectors.pa.table({"vec_id": list(range(500)), "vector": points.tolist()})
    asks = vectors.pa.table({"question": [str(i) for i in range(70)], "asked": centres.tolist()})
    found = vectors._piece(4)(("x",), asks, batch)
    assert found.num_rows == 70 * 5 and max(sizes) <= 3_000
    sent = type("Sent", (), {"value": centres})
    probed = list(vectors._probing(sent, 9)(iter([vectors.pa.RecordBatch.from_arrays([vectors.pa.array([str(i) for i in range(500)]), vectors.pa.array(points.tolist())], names=["key", "vector"])])))
    assert sum(b.num_rows for b in probed) == 500 * 9 and max(b.num_rows for b in probed) * 70 <= 9 * 3_000
    for found in (exact_neighbours, lambda t, a, k: index_neighbours(t, a, k=k, probes=1_000, per_cell=20)):
        got = found(table_of(spark, rows), F.col("vec_id") % 10 == 0, k=4).collect()
        assert {(r.query_id, r["rank"], r.vec_id, round(r.score, 6)) for r in got} == nearest(rows, lambda i: i % 10 == 0, 4)


def test_cells_that_are_full_are_fitted_again(spark):
    """A third of all vectors lie so close that they start in one cell."""
    rng = np.random.default_rng(6)
    close = rng.normal(size=8)
    rows = [(i, (close + rng.normal(size=8) * 1e-3 if i % 3 == 0 else rng.normal(size=8) * 10).tolist()) for i in range(3_000)]
    index = vectors.entries(table_of(spark, rows), 10, "vec_id", "embedding")
    held, centres = inverted_file(index, 3_000, sample=1_024, per_cell=50)
    sizes = [r["count"] for r in held.groupBy("cell").count().collect()]
    assert sum(sizes) == 3_000 and max(sizes) <= vectors.HOT * 50 and len(centres) > 60


def test_recall_of_the_index(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    exact = exact_neighbours(table, F.col("vec_id") % 50 == 0)
    r = recall(index_neighbours(table, F.col("vec_id") % 50 == 0, per_cell=40), exact).first()
    assert r.wanted == 400 and r.hits >= 0.9 * r.wanted


def test_vectors_of_empty_tables(spark):
    none = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert exact_neighbours(none, F.col("vec_id") > 0).collect() == [] == index_neighbours(none, F.col("vec_id") > 0).collect()
    one = spark.createDataFrame([(1, [1.0, 2.0])], "vec_id long, embedding array<float>")
    assert exact_neighbours(one, F.col("vec_id") > 0).collect() == [] == index_neighbours(one, F.col("vec_id") > 0).collect()


# near-duplicate texts


def sets_of(texts, width=5):
    out = []
    for t in texts:
        ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        out.append({tuple(ws[i : i + width]) for i in range(max(len(ws) - width + 1, 1))} if ws else set())
    return out


def alike(a, b):
    return bool(a) and 100 * len(a & b) >= 80 * len(a | b)


def test_near_duplicates_against_all_pairs(spark):
    """No pair without a reason is in a group; of pairs alike at 0.8 or more, 97 % or more are in one."""
    rows = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").limit(400).collect()]
    got = {r.doc_id: r.group_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = sets_of([t for _, t in rows])
    pairs = [(i, j) for i in range(len(rows)) for j in range(i) if alike(sets[i], sets[j])]
    together = sum(got[rows[i][0]] == got[rows[j][0]] for i, j in pairs)
    assert len(pairs) > 10 and together >= 0.97 * len(pairs)
    linked = {i for p in pairs for i in p}
    assert all(got[rows[i][0]] == rows[i][0] for i in range(len(rows)) if i not in linked)


@pytest.mark.parametrize("held", [1 << 19, 5])
def test_signatures_take_no_row_for_each_hash(spark, monkeypatch, held):
    """Minima are taken set by set, whatever a task holds at once; the plan neither explodes nor shuffles."""
    monkeypatch.setattr(near_duplicates_module, "HELD", held)
    rng = random.Random(4)
    sets = [(i, sorted(rng.randrange(1 << 60) for _ in range(n))) for i, n in enumerate((1, 2, 40, 3, 1, 7))]
    found = near_duplicates_module.signatures(spark.createDataFrame([*sets, (9, [])], "set_id long, hashes array<long>").coalesce(1))
    assert "Generate" not in plan(found) and "Exchange" not in plan(found)
    assert {r.set_id: r.minima for r in found.collect()} == {i: [min(h ^ m for h in hashes) for m in near_duplicates_module.masks()] for i, hashes in sets}


@pytest.mark.parametrize("held", [1 << 19, 3])
def test_hashed_shingles_are_those_of_the_columns(spark, monkeypatch, held):
    nd = near_duplicates_module
    monkeypatch.setattr(nd, "HELD", held)
    texts = [None, "", " \n", "A b\tC\x0bd", "one two one two one two one two", "\u00c9t\u00e9 \u00a0 x\x1cy z \U0001f600 q\x85r", "a b c d e\x0c\rf  "]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = docs.select("doc_id", nd.words(F.col("text")).alias("ws"))
    want = split.select("doc_id", F.sort_array(F.transform(nd.shingles(F.col("ws"), 3), nd.md5_number)).alias("hashes"))
    assert sorted(map(str, nd.hashed_shingles(docs, 3).collect())) == sorted(map(str, want.collect()))


def test_a_shared_bucket_gives_stars(spark):
    """Near copies as a third of the rows: links grow as the rows, not as their pairs."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for i in range(150):
        words = list(base)
        words[rng.randrange(300)] = f"new{i}"
        texts.append(" ".join(words))
    texts += [" ".join(rng.choices("abcdefghij", k=60)) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    links = star_links(shingle_sets(docs, 5)[1], 80, 100).collect()
    assert len({(r.a, r.b) for r in links}) == len(links) < 150 * 12
    got = {r.doc_id: r.group_id for r in near_duplicates(docs).collect()}
    assert sum(got[i] == 0 for i in range(150)) >= 147 and all(got[i] == i for i in range(150, 450))


def test_near_duplicates_of_edge_cases(spark):
    rows = [(5, None), (6, ""), (7, " \n"), (8, "one two"), (3, "ONE\ttwo"), (None, "one two"), (None, None), (9, "a b c d e f"), (9, "a b c d e f")]
    got = near_duplicates(spark.createDataFrame([(*r, "clash") for r in rows], "doc_id long, text string, hashes string")).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.group_id)) for r in got) == sorted(
        [("5", 0, "5"), ("6", 0, "6"), ("7", 0, "7"), ("8", 1, "3"), ("3", 1, "3"), ("None", 1, "3"), ("None", 0, "None"), ("9", 2, "9"), ("9", 2, "9")]
    )
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


# order statistics


def quantile(values, q):
    values = sorted(x for x in values if x is not None)
    if not values:
        return None
    place = q * (len(values) - 1)
    a, b = values[math.floor(place)], values[math.ceil(place)]
    return a if a == b else a + (b - a) * (place - math.floor(place))


@pytest.mark.parametrize("leaf", [4_096, 3])
def test_quantiles(spark, monkeypatch, leaf):
    monkeypatch.setattr(order_statistics, "LEAF", leaf)
    rng = random.Random(8)
    values = {
        "ties": [float(rng.randrange(3)) for _ in range(500)] + [1.0] * 400,
        "wide": [rng.choice([-1, 1]) * 10.0 ** rng.uniform(-300, 300) for _ in range(400)] + [0.0, 5e-324, -5e-324],
        "near": [1.0 + i * 2.0**-52 for i in range(300)],
        "one": [7.5],
        "nulls": [None, None],
        None: [rng.gauss(0, 1) for _ in range(300)] + [None] * 20,
        "ends": [-math.inf, *(rng.uniform(-5, 5) for _ in range(99)), math.inf],
        "negative": [-rng.expovariate(1) * 1e-9 for _ in range(333)],
    }
    rows = [(k, x, "clash") for k, xs in values.items() for x in xs]
    table = spark.createDataFrame(rows, "g string, v double, x string").repartition(4)
    wanted = {f"q{i}": ("v", q) for i, q in enumerate((0.0, 0.1, 0.5, 0.9, 0.999, 1.0))}
    got = {r.g: r for r in exact_quantiles(table, ["g"], wanted).collect()}
    assert set(got) == set(values)
    for k, xs in values.items():
        for name, (_, q) in wanted.items():
            assert got[k][name] == quantile(xs, q), (k, q)


def test_quantiles_of_the_whole_and_of_nothing(spark):
    table = spark.range(10_001).select((F.col("id") * 3 % 10_001).alias("v"))
    assert exact_quantiles(table, [], {"mid": ("v", 0.5), "top": ("v", 1.0)}).collect() == [(5_000.0, 10_000.0)]
    assert exact_quantiles(spark.createDataFrame([], "g int, v int"), ["g"], {"mid": ("v", 0.5)}).collect() == []
    nan = spark.createDataFrame([(1.0,), (2.0,), (math.nan,)], "v double")
    low, high = exact_quantiles(nan, [], {"low": ("v", 0.5), "high": ("v", 1.0)}).first()
    assert low == 2.0 and math.isnan(high)


def test_quantiles_hold_no_group(spark):
    found = plan(QUERIES["agg_quantiles"](spark, SF))
    assert "percentile" not in found.lower() and "median" not in found.lower() and "collect_list" not in found.lower()


@pytest.mark.parametrize("parts", [1, 7])
def test_below(spark, parts):
    rng = random.Random(9)
    left = [(i, rng.choice([None, 0, 1, 2, 5, 9])) for i in range(60)]
    right = [(rng.choice([None, 1, 1, 1, 2, 3, 9]), rng.choice([None, 1.5, 2.0])) for _ in range(80)]
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        found = below(spark.createDataFrame(left, "i int, x int"), spark.createDataFrame(right, "x int, s double"), "x", "s").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    for r in found:
        smaller = [v for x, v in right if x is not None and r.x is not None and x < r.x]
        sums = [v for v in smaller if v is not None]
        assert (r.n_below, r.sum_below) == (len(smaller), sum(sums) if sums else None)
    assert len(found) == 60


def test_below_forms_no_pairs(spark):
    found = plan(QUERIES["join_inequality"](spark, SF))
    assert "NestedLoop" not in found and "Cartesian" not in found
    empty = spark.createDataFrame([], "x int, s double")
    assert below(empty, empty, "x", "s").collect() == []
    assert [tuple(r) for r in below(spark.createDataFrame([(1, 1.0)], "x int, s double"), empty, "x", "s").collect()] == [(1, 1.0, 0, None)]


# skew, sketches, sinks, table functions, streams with timers


def rows_of_tasks(df):
    return sorted(r["count"] for r in df.groupBy(F.spark_partition_id().alias("p")).count().collect())


def test_a_heavy_key_is_dealt_out(spark):
    """A third of lineitem has one order: the largest task of the salted join is near the median, that of the plain one isn't."""
    lines = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").select(F.when(F.col("l_orderkey") % 3 == 0, F.lit(1).cast("long")).otherwise(F.col("l_orderkey")).alias("k"), "l_quantity")
    orders = spark.read.parquet("/root/testdata/sf0.01/orders.parquet").select(F.col("o_orderkey").alias("k"), "o_totalprice")
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.sql.autoBroadcastJoinThreshold")}
    for c, v in zip(before, ("false", "16", "-1")):
        spark.conf.set(c, v)
    try:
        salted, plain = rows_of_tasks(salted_join(lines, orders, ["k"])), rows_of_tasks(lines.join(orders, "k"))
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sum(salted) == sum(plain) == 60_000 and len(salted) == 16
    assert salted[-1] < 2 * salted[8] and plain[-1] > 5 * plain[8]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_salted_join_is_a_join(spark, how):
    rng = random.Random(11)
    left = spark.createDataFrame([(rng.choice([1, 1, 1, 1, 2, 3, None, 9]), rng.choice(["a", "b"]), i) for i in range(300)], "k int, g string, i int")
    right = spark.createDataFrame([(1, "a", 5), (1, "a", 6), (1, "b", 7), (2, "a", 8), (None, "a", 9)], "k int, g string, w int")
    got, want = salted_join(left, right, ["k", "g"], how), left.join(right, ["k", "g"], how)
    assert got.columns == want.columns and sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
    with pytest.raises(ValueError, match="more than once"):
        salted_join(left, right, ["k"], "full")


def test_bucketed_tables_join_in_place(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert "Exchange" not in plan(QUERIES["sink_bucketed"](spark, SF))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_sketches_merge_upwards(spark):
    rows = [(f"2024-01-{1 + i % 28:02d} 00:00:00", f"t{i % 3}", i % 5_000) for i in range(40_000)]
    df = spark.createDataFrame(rows, "ts string, t string, u long").withColumn("ts", F.col("ts").cast("timestamp_ntz"))
    days = daily_sketches(df, "ts", ["t"], "u")
    assert days.count() == 84
    for r in merged(days, "t").collect() + merged(days, F.trunc("day", "month")).collect():
        assert abs(r.estimate - 5_000) < 250
    nulls = daily_sketches(spark.createDataFrame([(None,)], "u long").withColumn("ts", F.current_timestamp()), "ts", [], "u")
    assert [r.estimate for r in merged(nulls).collect()] == [0]


def test_runs_of_nulls_and_of_nothing(spark):
    schema = "k int, v string, i int, extra int"
    rows = [(1, "a", 1, 0), (1, "a", 2, 0), (1, None, 3, 0), (1, None, 4, 0), (1, "a", 5, 0), (None, "b", 6, 0), (None, "b", 7, 0), (2, "c", 8, 0)]
    names = [F.lit(c) for c in "kvi"]
    table = spark.createDataFrame(rows, schema)
    got = Runs(table.asTable().partitionBy("k").orderBy("i"), *names)
    assert got.dtypes == [("k", "int"), ("v", "string"), ("first", "int"), ("last", "int"), ("n", "bigint")]
    assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, "a", 1, 2, 2), (1, None, 3, 4, 2), (1, "a", 5, 5, 1), (None, "b", 6, 7, 2), (2, "c", 8, 8, 1)], key=str)
    assert Runs(table.limit(0).asTable().partitionBy("k").orderBy("i"), *names).collect() == []
    with pytest.raises(Exception, match="constants that the table has"):
        Runs(table.asTable().partitionBy("k").orderBy("i"), F.lit("k"), F.lit("none"), F.lit("i")).collect()


def test_timers_stop_and_go_on(spark, tmp_path):
    """Rows in any order, in three runs on one checkpoint: a session that spans runs is one, late rows within the delay join, and what is open stays open."""
    source, path, state = (f"file://{tmp_path}/{x}" for x in ("source", "out", "state"))
    hour, day = 3_600, 1_700_006_400
    runs = [[(1, 1, 5 * hour), (2, 1, 0), (3, 2, hour), (4, None, 0)], [(5, 1, 10 * hour), (6, 2, 30 * hour)], [(7, 1, 60 * hour), (8, 2, 31 * hour), (9, 2, 60 * hour)]]
    for rows in runs:
        df = spark.createDataFrame([(i, u, day + s) for i, u, s in rows], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").alias("ts"))
        df.write.mode("append").parquet(source)
        timed_sessions(spark, source, path, state, delay="24 hours")
    got = sessions_read(spark, path).select("user_id", *(F.unix_seconds(F.col(c).cast("timestamp")).alias(c) for c in ("start", "end")), "n").collect()
    assert sorted((r.user_id, r.start - day, r.end - day, r.n) for r in got) == [(1, 0, 16 * hour, 3), (2, hour, 7 * hour, 1)]


def test_a_key_has_one_timer(spark, tmp_path):
    """A user of many sessions costs one timer a run, not one for each; sessions that end at the very watermark are over, in company or alone."""
    day, hour, mark = 1_700_006_400, 3_600, 1_700_006_400 + 1_000 * 3_600
    at = [(u, day + 10 * hour * i) for u in (1, 2) for i in range(30)] + [(2, mark - 6 * hour), (3, mark - 6 * hour), (4, mark - 6 * hour + 1), (5, mark + 600)]
    events = spark.createDataFrame([(i, u, s) for i, (u, s) in enumerate(at)], "event_id long, user_id long, s long").select("event_id", "user_id", F.timestamp_seconds("s").cast("timestamp_ntz").alias("ts"))
    events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    same(QUERIES["stream_timers"](spark, str(tmp_path)), str(tmp_path), ORACLES["stream_timers"])
    source, path, state = (f"file://{tmp_path}/{x}" for x in ("source", "out", "state"))
    events.withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(source)
    reports = timed_sessions(spark, source, path, state)
    timers = [o["customMetrics"] for p in reports for o in p["stateOperators"]]
    assert sum(m["numRegisteredTimers"] for m in timers) <= 5 + 2


def test_outer_join_frees_its_state(spark):
    progress = []
    found = clicks_with_purchases(spark, SF, progress)
    assert found.where("buy_id IS NULL").count() > 0
    reports = [p if isinstance(p, dict) else p.jsonValue() for p in progress]
    removed = sum(o.get("numRowsRemoved", 0) for p in reports for o in p["stateOperators"])
    left = reports[-1]["stateOperators"][0]["numRowsTotal"]
    assert removed > 0 and left < 0.1 * spark.read.parquet(f"{SF}/events.parquet").count()


def test_broadcast_by_bytes(spark):
    left, right = spark.range(1_000).withColumnRenamed("id", "k"), spark.read.parquet(f"{SF}/supplier.parquet").select(F.col("s_suppkey").alias("k"), "s_name")
    assert "BroadcastHashJoin" in plan(small_or_merge(left, right, ["k"], "inner")) and "SortMergeJoin" in plan(small_or_merge(left, right, ["k"], "inner", limit=10))


# turns


def test_turns_of_a_hot_key(spark):
    """A third of the rows have one key, which lies in several parts; nulls, gaps and repeats are marked as a plain loop marks them."""
    rng = random.Random(12)
    rows = [(1, 2 * i if i % 5 else 2 * i - 2, "a") for i in range(200)] + [(rng.choice([2, 3, 4, None]), rng.choice([None, *range(12)]), rng.choice("ab")) for _ in range(400)]
    rng.shuffle(rows)
    before = {c: spark.conf.get(c) for c in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions")}
    for c, v in zip(before, ("false", "8")):
        spark.conf.set(c, v)
    try:
        got = [tuple(r) for r in assembled(spark.createDataFrame(rows, "k int, n int, role string").repartition(5), "k", "n", "role").collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert len(got) == len(rows)
    for key in (1, 2, 3, 4, None):
        mine = sorted((r for r in got if r[0] == key), key=lambda r: r[3])
        assert [r[3] for r in mine] == list(range(1, len(mine) + 1))
        assert sorted((str(r[1]), r[2]) for r in mine) == sorted((str(n), role) for k, n, role in rows if k == key)
        last = None
        for _, n, _, _, gap, repeated in mine:
            assert (gap, repeated) == (max(n - last - 1, 0) if n is not None and last is not None else 0, n is not None and n == last)
            assert last is None or n >= last
            last = n
    empty = spark.createDataFrame([], "k int, n int, role string")
    assert assembled(empty, "k", "n", "role").collect() == []


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    """Without spark.checkpoint.dir a session that isn't local says so instead of writing where others can't read."""
    from tidemill.sources.tables import shared_folder

    class Elsewhere:
        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

        class conf:  # noqa: N801
            get = staticmethod(lambda name, default=None: default)

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        shared_folder(Elsewhere, "x")
