import pytest

from tests.compare import same
from tidemill.plans.relational import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, name):
    df = QUERIES[name](spark, SF)
    same(df, SF, ORACLES[name])


def test_comparison_finds_a_wrong_value(spark):
    df = QUERIES["agg_hash"](spark, SF)
    with pytest.raises(AssertionError):
        same(df, SF, ORACLES["agg_hash"].replace("count(*)", "count(*) + 1"))


def test_approximate_count(spark):
    (a,) = [r.parts for r in QUERIES["agg_approx_distinct"](spark, SF).collect()][:1]
    assert 150 <= a <= 250


def test_user_functions_hold_no_group(spark):
    """Groups are summed up before Python or Spark holds them together."""
    import math

    from tidemill.functions.stats import geometric_mean
    from tidemill.plans.relational import QUERIES

    plan = {q: QUERIES[q](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString() for q in ("udaf_pandas", "cogroup_pandas")}
    assert "AggregateInPandas" not in plan["udaf_pandas"] and "ArrowAggregatePython" not in plan["udaf_pandas"]
    assert plan["cogroup_pandas"].count("partial_count") == 2
    rows = [("a", 2.0), ("a", 8.0), ("a", -1.0), ("a", None), ("b", 0.0), (None, 3.0)]
    got = dict(map(tuple, geometric_mean(spark.createDataFrame(rows, "k string, x double"), "k", "x").collect()))
    assert math.isclose(got["a"], 4) and got["b"] is None and math.isclose(got[None], 3) and len(got) == 3


def test_hints_pick_the_join(spark):
    for name, join in (("join_merge", "SortMergeJoin"), ("join_shuffle_hash", "ShuffledHashJoin")):
        assert join in QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


def test_asof_takes_the_last_row_with_its_null(spark):
    from tidemill.operators.joins import asof_join

    left = spark.createDataFrame([(1, 5), (1, 1), (2, 9)], "k int, t int")
    right = spark.createDataFrame([(1, 2, "old"), (1, 4, None), (2, 9, "a"), (2, 9, "b")], "k int, t int, v string")
    got = {(r.k, r.t): r.asof_v for r in asof_join(left, right, ["k"], "t", "v").collect()}
    assert got == {(1, 5): None, (1, 1): None, (2, 9): "b"}


def test_band_join_meets_every_pair_once(spark):
    from tidemill.operators.joins import band_join

    values = [-10.0, -5.0, 0.0, 4.5, 5.0, 9.75, 10.0, 10.0, None, float("nan")]
    df = spark.createDataFrame(list(enumerate(values)), "i int, x double")
    joined = band_join(df, df, "x", 5)
    assert "SortMergeJoin" in (plan := joined.hint("merge")._jdf.queryExecution().executedPlan().toString()) or "HashJoin" in plan
    real = [(i, x) for i, x in enumerate(values) if x is not None and x == x]
    want = sorted((i, j) for i, x in real for j, y in real if 0 < y - x <= 5)
    assert sorted((r.i, r.r_i) for r in joined.collect()) == want


def test_late_rows_are_dropped_and_open_days_count(spark, tmp_path):
    from tidemill.streaming.events import ORACLES, late_dropped

    rows = [(1, "2024-01-01 10:00:00"), (50, "2024-01-01 11:00:00"), (2, "2024-01-02 10:00:00"), (3, "2024-01-03 12:00:00"), (100, "2024-01-03 13:00:00"), (150, "2024-01-04 13:00:00")]
    events = spark.createDataFrame(rows, "event_id long, at string").selectExpr("event_id", "cast(at as timestamp_ntz) as ts")
    events.toPandas().to_parquet(tmp_path / "events.parquet", coerce_timestamps="us")
    df = late_dropped(spark, str(tmp_path))
    same(df, str(tmp_path), ORACLES["stream_late"])
    assert sorted((str(r.start)[:10], r.n) for r in df.collect()) == [("2024-01-01", 1), ("2024-01-02", 1), ("2024-01-03", 2)]


def tables(folder, **rows):
    """Parquet tables of plain rows (SQL of DuckDB) in a folder."""
    import duckdb

    folder.mkdir(exist_ok=True)
    for name, sql in rows.items():
        duckdb.sql(f"COPY ({sql}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    return str(folder)


def test_not_in_broadcasts_no_list(spark, tmp_path):
    """The keys go by shuffle where they are many; nulls on either side and an empty list count as SQL says."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = QUERIES["join_not_in"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "LeftAnti" in plan and "HashedRelationBroadcastMode" not in plan and "BroadcastHashJoin" not in plan
    orders = "SELECT unnest([1, 2, 2, 3, NULL])::BIGINT AS o_orderkey"
    for i, keys in enumerate(("[2, 2, 9]", "[2, NULL]", "[]", "[NULL]")):
        folder = tables(tmp_path / str(i), orders=orders, lineitem=f"SELECT unnest({keys}::BIGINT[]) AS l_orderkey")
        same(QUERIES["join_not_in"](spark, folder), folder, ORACLES["join_not_in"])


def test_lateral_numbers_rows_in_order(spark, tmp_path):
    """The order is the window's own, not left to a sort before a shuffle; nulls come last in both columns."""
    plan = QUERIES["lateral"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    specs = [line for line in plan.splitlines() if "row_number()" in line and "Window" in line]
    assert specs and all("o_totalprice" in line and "DESC NULLS LAST" in line for line in specs)
    orders = "SELECT (CASE WHEN i % 3 = 0 THEN NULL ELSE i END)::BIGINT AS o_orderkey, (i % 11)::BIGINT AS o_custkey, (CASE WHEN i % 5 < 3 THEN 7.5 WHEN i % 5 = 4 THEN i END)::DOUBLE AS o_totalprice FROM range(700) t(i)"
    folder = tables(tmp_path / "x", customer="SELECT unnest([0, 1, 1, 5, 40, NULL])::BIGINT AS c_custkey", orders=orders)
    same(QUERIES["lateral"](spark, folder), folder, ORACLES["lateral"])


def test_lines_are_counted_before_they_are_joined(spark, tmp_path):
    """No join has the rows of lineitem on a side: what meets the numbers are partial counts, made final."""
    plan = QUERIES["recursive_cte"](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    join = next(i for i, line in enumerate(lines) if "Join LeftOuter" in line)
    scan = next(i for i, line in enumerate(lines) if "Relation" in line and "l_linenumber" in line)
    assert any("Aggregate" in line and "l_linenumber" in line for line in lines[join + 1 : scan])
    folder = tables(tmp_path / "x", lineitem="SELECT unnest([1, 1, 3, 9, NULL])::INTEGER AS l_linenumber")
    same(QUERIES["recursive_cte"](spark, folder), folder, ORACLES["recursive_cte"])


def test_cogroup_meets_many_users_at_once(spark, tmp_path, monkeypatch):
    """Groups are parts of the users, not users; users on one side, a null user and ids beyond 2**53 keep their counts."""
    from tidemill.plans import relational

    plan = QUERIES["cogroup_pandas"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapCoGroupsInPandas [part" in plan
    events = "SELECT (CASE WHEN i % 7 = 0 THEN NULL WHEN i % 7 = 1 THEN 9007199254740993 WHEN i % 7 = 2 THEN 0 ELSE i END)::BIGINT AS user_id, (CASE i % 3 WHEN 0 THEN 'click' WHEN 1 THEN 'view' ELSE 'error' END) AS event_type FROM range(200) t(i)"
    folder = tables(tmp_path / "x", events=events)
    one = tables(tmp_path / "y", events="SELECT 5::BIGINT AS user_id, 'click' AS event_type")
    for users in (4_096, 20, 1):
        monkeypatch.setattr(relational, "USERS", users)
        same(QUERIES["cogroup_pandas"](spark, folder), folder, ORACLES["cogroup_pandas"])
        same(QUERIES["cogroup_pandas"](spark, one), one, ORACLES["cogroup_pandas"])
