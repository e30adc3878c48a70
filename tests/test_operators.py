"""Cases with known answers for the operator kit."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from millrace.sources import in_years
from millrace.functions import decode_half, decode_month, half_index, month_index, whole_number
from millrace.operators import (
    AGGREGATES, JOIN_KINDS, MAPS, PREDICATES, REDUCERS, build_filter, equi_join, fan_out, filter_rows, group_by, map_rows, multiset_diff, name_columns, pad_columns,
    reduce_rows, register_aggregate, register_join, register_map, register_predicate, register_reducer, same_rows, select_rows, summary, union_all,
)


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize(
    "op,constraints,values,expected",
    [
        ("<", [30], [25, 35], [True, False]),
        (">", [70], [85, 60], [True, False]),
        ("<=", [30], [30, 25, 35], [True, True, False]),
        (">=", [70], [70, 60, 85], [True, False, True]),
        ("between", [150, 180], [160, 145, 150, 180], [True, False, True, True]),
    ],
)
@pytest.mark.parametrize("kind", ["int", "double", "string", "decimal(10,2)"])
def test_numeric_predicates(spark, op, constraints, values, expected, kind):
    df = spark.createDataFrame([(i, str(v)) for i, v in enumerate(values)], "i int, v string").select("i", F.col("v").cast(kind))
    kept = {r.i for r in filter_rows(df, [["v", op, constraints]]).collect()}
    assert kept == {i for i, ok in enumerate(expected) if ok}


def test_no_number_fails_and_nan_fails(spark):
    df = spark.createDataFrame([("80",), ("x",), ("",), (None,), ("nan",)], "v string")
    assert rows(filter_rows(df, [["v", ">=", [75]]])) == [("80",)]
    df = spark.createDataFrame([(80.0,), (float("nan"),), (None,)], "v double")
    assert rows(filter_rows(df, [["v", ">=", [75]]])) == [(80.0,)]


def test_membership(spark):
    df = spark.createDataFrame([("active",), ("disabled",), (None,), ("",)], "s string")
    assert rows(filter_rows(df, [["s", "equals_any", ["active", "pending"]]])) == [("active",)]
    assert rows(filter_rows(df, [["s", "not_equals", ["active"]]])) == [("disabled",), (None,), ("",)]
    assert rows(filter_rows(df, [["s", "not_equals", ["", "None"]]])) == [("active",), ("disabled",)]
    ids = spark.createDataFrame([(1,), (None,)], "u long")
    assert rows(filter_rows(ids, [["u", "not_equals", ["", "None"]]])) == [(1,)]
    assert rows(filter_rows(ids, [["u", "equals_any", ["1"]]])) == [(1,)]


def test_conjunction_and_errors(spark):
    data = [(2024, 7, 88), (2025, 23, 942), (2024, 6, 942), (2027, 7, 88), (2025, 24, 942), (2024, 6, 55)]
    df = spark.createDataFrame(data, "year int, hour int, amount int")
    conf = [["year", "equals_any", ["2024", "2025"]], [1, "between", [6, 23]], ["amount", ">", [75]]]
    assert rows(filter_rows(df, conf)) == data[:3]
    assert filter_rows(df, []).count() == 6
    with pytest.raises(ValueError, match="unknown predicate"):
        build_filter(df, [["year", "like", [1]]])
    with pytest.raises(ValueError, match="unknown column"):
        build_filter(df, [["nope", ">", [1]]])


def test_calendar_maps(spark):
    one = spark.range(1)
    ask = lambda c: one.select(c).first()[0]
    lit = F.lit
    assert [ask(month_index(lit(y), lit(m), i)) for y, m, i in [(2021, 3, 2020), (2022, 5, 2021), (2020, 0, 2020)]] == [15, 17, 0]
    assert [ask(half_index(lit(y), lit(m), i)) for y, m, i in [(2022, 6, 2020), (2022, 7, 2020), (2025, 6, 2024), (2025, 7, 2024)]] == [4, 5, 2, 3]
    assert [ask(decode_month(lit(i), 2024)) for i in (1, 12, 13, 24)] == ["2024-01", "2024-12", "2025-01", "2025-12"]
    assert [ask(decode_half(lit(i), 2024)) for i in (0, 1, 3)] == ["2024-H1", "2024-H2", "2025-H2"]
    assert [ask(whole_number(lit(x))) for x in ("13060.0", "", "x")] == [13060, None, None]


def test_map_chain_projection_and_padding(spark):
    df = spark.createDataFrame([(2021, 0)], "year int, month int")
    assert rows(map_rows(df, [["map_month", {"init_year": 2020}]] * 2, ["month", "year"])) == [(24, 2021)]
    assert rows(map_rows(df, [["identity", {}]], [1, 0])) == [(0, 2021)]
    assert name_columns(df, ["y"]).columns == ["y"]
    assert rows(pad_columns(df, ["z"])) == [(2021, 0, None)]
    with pytest.raises(ValueError):
        name_columns(df, ["a", "b", "c"])
    with pytest.raises(AnalysisException):
        map_rows(df, out=["nope"])
    with pytest.raises(ValueError, match="unknown map"):
        map_rows(df, [["nope", {}]])


def test_aggregates(spark):
    df = spark.createDataFrame([("a", 12.0), ("a", 15.0), ("b", -10.0)], "k string, v double")
    out = group_by(df, ["k"], [["sum", "v", "total"], ["max", "v", "top"], ["avg", "v", "mean"], ["count", "n"]], ["k", "total", "top", "mean", "n"])
    assert sorted(rows(out)) == [("a", 27.0, 15.0, 13.5, 2), ("b", -10.0, -10.0, -10.0, 1)]
    with pytest.raises(ValueError, match="unknown aggregate"):
        group_by(df, ["k"], [["median", "v"]])
    with pytest.raises(ValueError, match="unknown column"):
        group_by(df, ["k"], [["sum", "nope"]])


def test_bad_number_in_an_aggregate_fails(spark):
    with pytest.raises(Exception, match="CAST_INVALID_INPUT"):
        group_by(spark.createDataFrame([("a", "x")], "k string, v string"), ["k"], [["sum", "v"]]).collect()


def test_group_by_two_keys_and_session(spark):
    data = [("s", "pr1", 7, 88.0), ("s", "pr1", 7, 88.0), ("t", "pr1", 7, 5.0), ("s", "pr1", 8, 10.0)]
    df = spark.createDataFrame(data, "session_id string, p string, m int, v double")
    out = group_by(df, ["p", "m"], [["sum", "v"], ["count", "n"]], session="session_id")
    assert sorted(rows(out)) == [("s", "pr1", 7, 176.0, 2), ("s", "pr1", 8, 10.0, 1), ("t", "pr1", 7, 5.0, 1)]


def test_reducers(spark):
    df = spark.createDataFrame([(1, 10), (2, 50), (3, 20), (4, 5), (5, 20), (6, 20)], "id int, rev int").withColumn("g", F.lit("x"))
    ids = lambda *a: [r.id for r in reduce_rows(df, ["g"], *a, rank=True).orderBy("rank").collect()]
    assert ids("keep_top_k", {"comp_key": "rev", "limit": 3, "ties": ["id"]}) == [2, 3, 5]
    assert ids("keep_least_k", {"comp_key": "rev", "limit": 3, "ties": ["id"]}) == [4, 1, 3]
    assert ids("keep_top_row", {"comp_key": "rev", "ties": ["id"]}) == [2]
    assert ids("keep_all_rows", {"ties": ["id"]}) == [1, 2, 3, 4, 5, 6]
    assert reduce_rows(df, ["g"], "keep_all_rows").count() == 6
    with pytest.raises(ValueError, match="unknown reducer"):
        reduce_rows(df, ["g"], "nope")


def test_score_descending_then_age_ascending(spark):
    df = spark.createDataFrame([(10, 5), (10, 10), (10, 20), (10, 10), (10, 9), (10, 10), (10, 10), (11, 40)], "score int, age int").withColumn("g", F.lit(1))
    out = reduce_rows(df, ["g"], "keep_asc_desc", {"comp_key": "score", "comp_key2": "age", "limit": 3}, ["score", "age"], rank=True)
    assert rows(out.orderBy("rank").drop("rank")) == [(11, 40), (10, 5), (10, 9)]


def test_joins(spark):
    left = spark.createDataFrame([("prod_1", "n1"), ("prod_2", "n2"), ("prod_3", "n3")], "product_id string, name string")
    right = spark.createDataFrame([("prod_1", 1, "r"), ("prod_1", 2, "r"), ("prod_2", 3, "r"), ("prod_4", 4, "r")], "product_id string, month int, name string")
    out = equi_join(left, right, ("product_id", "product_id"), ["month", "product_id", "name"])
    assert sorted(rows(out)) == [(1, "prod_1", "n1"), (2, "prod_1", "n1"), (3, "prod_2", "n2")]
    assert equi_join(left, right, ("product_id", "product_id")).columns == ["product_id", "name", "month"]
    assert equi_join(left, right, ("product_id", "product_id"), keep_duplicates=True).columns == ["product_id", "name", "product_id", "month", "name"]
    assert rows(equi_join(left, right, ("product_id", "product_id"), [("r", "name"), ("l", "name")]).limit(1))[0][0] == "r"
    with pytest.raises(ValueError, match="unknown join"):
        equi_join(left, right, ("product_id", "product_id"), kind="outer")


def test_fan_out_of_three_queries(spark):
    df = spark.createDataFrame([("tr1", 2024, 24, 88), ("tr2", 2026, 7, 88), ("tr3", 2024, 7, 75), ("tr4", 2025, 7, 90)], "id string, year int, hour int, amount int")
    years, hours = ["year", "equals_any", [2024, 2025]], ["hour", "between", [6, 23]]
    branches = {
        "q4": lambda d: select_rows(d, [years], out=["id"]),
        "q3": lambda d: select_rows(d, [years, hours], [["map_semester", {"init_year": 2024, "col_month": "hour", "col_out": "s"}]], ["id"]),
        "q1": lambda d: select_rows(d, [years, hours, ["amount", ">", [75]]], out=["id"]),
    }
    with fan_out(df, branches) as out:
        assert {k: [r.id for r in v.collect()] for k, v in out.items()} == {"q4": ["tr1", "tr3", "tr4"], "q3": ["tr3", "tr4"], "q1": ["tr4"]}


def test_multiset_comparison(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (1, None), (3, "y")], "k int, v string")
    assert sorted(rows(multiset_diff(a, b))) == [(1, None, 2, 1), (3, "y", 0, 1)]
    assert same_rows(a, a.orderBy("k")) and not same_rows(a, b)
    assert dict(rows(summary(spark, {"p": a, "q": a, "r": a}, {"p": a, "q": b}))) == {"p": "matched", "q": "different", "r": "missing"}
    assert union_all([a, b.drop("v")]).count() == 6


def test_registries_take_new_operators(spark):
    register_predicate("even", lambda c, kind, args: c % 2 == 0)
    register_map("double_it", lambda df, col: df.withColumn(col, F.col(col) * 2))
    register_aggregate("min", F.min)
    register_reducer("keep_first", lambda comp_key: ([F.col(comp_key)], 1))
    register_join("no_case", lambda a, b: F.lower(a) == F.lower(b))
    df = spark.range(4).withColumn("g", F.lit("A"))
    assert rows(select_rows(df, [["id", "even", []]], [["double_it", {"col": "id"}]], ["id"])) == [(0,), (4,)]
    assert rows(group_by(df, ["g"], [["min", "id", "lo"]])) == [("A", 0)]
    assert rows(reduce_rows(df, ["g"], "keep_first", {"comp_key": "id"}, ["id"])) == [(0,)]
    assert equi_join(df, spark.createDataFrame([("a",)], "h string"), ("g", "h"), kind="no_case").count() == 4
    PREDICATES.pop("even"), MAPS.pop("double_it"), AGGREGATES.pop("min"), REDUCERS.pop("keep_first"), JOIN_KINDS.pop("no_case")


def test_plans_are_the_ones_wanted(spark, tmp_path):
    spark.range(1000).select("id", (F.col("id") % 7).alias("g"), F.col("id").cast("double").alias("v")).write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    plan = select_rows(df, [["v", ">=", [75]]], out=["id"])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(v,75" in plan and "ReadSchema: struct<id:bigint,v:double>" in plan
    plan = reduce_rows(df, ["g"], "keep_top_k", {"comp_key": "v", "limit": 3, "ties": ["id"]})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_sums_of_any_size(spark):
    rows = [("a", 0.00004)] * 100 + [("b", 3e20), ("b", 1.0)]
    out = {r.k: r for r in group_by(spark.createDataFrame(rows, "k string, v double"), ["k"], [["sum", "v", "s"], ["avg", "v", "m"]]).collect()}
    assert abs(out["a"].s - 0.004) < 1e-12 and abs(out["a"].m - 0.00004) < 1e-15 and out["b"].s == 3e20


def test_result_sets_are_compared_by_position(spark):
    a = spark.createDataFrame([(1, "x")], "a int, b string")
    out = {r.name: r.status for r in summary(spark, {"p": a, "q": a}, {"p": a.toDF("c", "d"), "q": a.select("a")}).collect()}
    assert out == {"p": "matched", "q": "different"}


def test_years_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.sql("select timestamp'2023-12-31 23:59:59' as ts, 1 as x union all select timestamp'2024-01-01', 2 union all select timestamp'2025-12-31 23:59:59', 3 union all select timestamp'2027-05-01', 4").write.parquet(path)
    kept = in_years(spark.read.parquet(path), "ts", (2025, 2024, 2027))
    assert sorted(r.x for r in kept.collect()) == [2, 3, 4]
    plan = in_years(spark.read.parquet(path), "ts", (2024, 2025))._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(ts,2024" in plan and "LessThan(ts,2026" in plan
