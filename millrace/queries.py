"""The registered queries over the driver's tables, each with the SQL that must give the same rows.

Roles: ``events`` are transactions with hours (event_type is the store), ``orders`` are transactions
whose store is the customer's nation, ``lineitem`` are transaction items, ``part`` is the menu,
``customer`` are the users.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plans as P
from . import sinks, sources
from .functions import decode_half, decode_month
from .operators import (
    Accumulator, accumulate, compared, equi_join, filter_rows, group_by, least_rows, map_rows, multiset_diff, name_columns, pad_columns, reduce_rows,
    register_accumulator, register_join, register_map, register_predicate, register_row_order, select_rows, summary, tagged_union, top_rows, totals,
)
from .scratch import new_folder, remove, written
from .streaming import (
    Published, append_stream, completed_join, completed_keys, completed_rows, completion_gate, read_completed, read_completed_join, read_fan_out, read_session,
    read_top_k, ready_sessions, stream_completed, stream_completed_join, stream_fan_out, stream_filter, stream_near_join, stream_results, stream_top_k,
)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        QUERIES[name] = fn
        if sql:
            SQL[name] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_transactions(table(spark, sf_dir, "events"))


def as_transactions(e: DataFrame) -> DataFrame:
    ts = F.col("ts")
    return e.select(
        F.col("event_id").alias("transaction_id"), F.year(ts).alias("year"), F.col("event_type").alias("store_id"), "user_id",
        F.month(ts).alias("month"), F.hour(ts).alias("hour"), F.col("value").alias("final_amount"),
    )


def items(spark: SparkSession, sf_dir: str, years: tuple[int, ...] = (1996, 1997)) -> DataFrame:
    at = F.col("l_shipdate")
    return sources.in_years(table(spark, sf_dir, "lineitem"), "l_shipdate", years).select(
        F.col("l_partkey").alias("item_id"), F.year(at).alias("year"), F.month(at).alias("month"),
        F.col("l_extendedprice").alias("subtotal"), F.col("l_quantity").alias("quantity"),
    )


def nation_orders(spark: SparkSession, sf_dir: str, years: tuple[int, ...] = (1996, 1997)) -> DataFrame:
    at = F.col("o_orderdate")
    orders = sources.in_years(table(spark, sf_dir, "orders"), "o_orderdate", years).select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    return equi_join(orders, table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), ("o_custkey", "c_custkey")).select(
        F.col("o_orderkey").alias("transaction_id"), F.year(at).alias("year"), F.col("c_nationkey").alias("store_id"),
        F.col("o_custkey").alias("user_id"), F.month(at).alias("month"), F.hour(at).alias("hour"), F.col("o_totalprice").alias("final_amount"),
    )


def _menu(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"))


def _users(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), F.col("c_name").alias("birthdate"))


def _nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("store_id"), F.col("n_name").alias("store_name"))


def event_sources(spark: SparkSession, sf_dir: str) -> P.Sources:
    """The event types are the stores, so the dimension is derived from the events."""
    tx = as_transactions(sources.in_years(table(spark, sf_dir, "events"), "ts", (2024, 2025)))
    stores = events(spark, sf_dir).select("store_id", F.col("store_id").alias("store_name")).distinct()
    return P.Sources(tx, items(spark, sf_dir), _menu(spark, sf_dir), stores, _users(spark, sf_dir))


def order_sources(spark: SparkSession, sf_dir: str) -> P.Sources:
    return P.Sources(nation_orders(spark, sf_dir), items(spark, sf_dir), _menu(spark, sf_dir), _nations(spark, sf_dir), _users(spark, sf_dir),
                     years=(1996, 1997), init_year=1995, hours=(0, 23))


Q1_SQL = """select event_id as transaction_id, value as final_amount from events
where year(ts) in (2024,2025) and hour(ts) between 6 and 23 and value >= 75"""
_MONTHLY = """with g as (select l_partkey k, (year(l_shipdate)-1995)*12+month(l_shipdate) m, sum(l_quantity) q,
 sum(cast(l_extendedprice as decimal(18,2))) v from lineitem where year(l_shipdate) in (1996,1997) group by 1,2)"""
_BEST = """select printf('%04d-%02d', 1995+(m-1)//12, (m-1)%12+1) as year_month, p_name as item_name, cast(q as bigint) as sellings_qty
from (select *, row_number() over (partition by m order by q desc, k asc) rn from g) join part on p_partkey=k where rn=1"""
Q3_SQL = """select cast(year(o_orderdate) as varchar)||'-'||case when month(o_orderdate)<=6 then 'H1' else 'H2' end as year_half,
 n_name as store_name, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as tpv
from orders join customer on o_custkey=c_custkey join nation on c_nationkey=n_nationkey
where year(o_orderdate) in (1996,1997) and hour(o_orderdate) between 0 and 23 group by 1,2"""
Q4_SQL = """with g as (select event_type as store_id, user_id, count(*) as n from events
 where year(ts) in (2024,2025) and user_id is not null group by 1,2),
r as (select *, row_number() over (partition by store_id order by n desc, user_id asc) rn from g)
select store_id as store_name, c_name as birthdate from r join customer on user_id=c_custkey where rn<=3"""


@query("q1_transactions_filter", Q1_SQL)
def q1(spark, sf_dir):
    return P.transactions_filter(event_sources(spark, sf_dir))


@query("q2_best_selling", f"{_MONTHLY} {_BEST}")
def q2_best(spark, sf_dir):
    return P.best_selling(order_sources(spark, sf_dir))


@query("q2_most_profit", """with g as (select l_partkey k, date_trunc('month', l_shipdate) m, sum(cast(l_extendedprice as decimal(18,2))) q
 from lineitem where year(l_shipdate) in (1996,1997) group by 1,2),
r as (select *, row_number() over (partition by m order by q desc, k asc) rn from g)
select strftime(m,'%Y-%m') as year_month, cast(q as double) as profit_sum, p_name as item_name from r join part on p_partkey=k where rn=1""")  # fmt: skip
def q2_profit(spark, sf_dir):
    return P.most_profit(order_sources(spark, sf_dir))


@query("q3_tpv", Q3_SQL)
def q3(spark, sf_dir):
    return P.payment_volume(order_sources(spark, sf_dir))


@query("q4_top3", Q4_SQL)
def q4(spark, sf_dir):
    return P.top_buyers(event_sources(spark, sf_dir))


# Predicates: one query each, over events.
_PREDICATES = {
    "filter_gt": (["value", ">", [75]], "value > 75"),
    "filter_ge": (["value", ">=", [75]], "value >= 75"),
    "filter_lt": (["value", "<", [20]], "value < 20"),
    "filter_le": (["value", "<=", [20]], "value <= 20"),
    "filter_between": (["value", "between", [20, 75]], "value between 20 and 75"),
    "filter_equals_any": (["event_type", "equals_any", ["click", "purchase", "view"]], "event_type in ('click','purchase','view')"),
    "filter_not_equals": (["event_type", "not_equals", ["click", "view"]], "event_type is null or event_type not in ('click','view')"),
    "filter_user_present": (["user_id", "not_equals", ["", "None"]], "user_id is not null"),
}
for _name, (_conf, _where) in _PREDICATES.items():
    query(_name, f"select event_id, user_id, event_type, value from events where {_where}")(
        lambda spark, sf_dir, conf=_conf: filter_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), [conf])
    )


@query("filter_conjunction", "select event_id, value from events where value >= 20 and value < 75 and event_type in ('purchase','click')")
def conjunction(spark, sf_dir):
    conf = [["value", ">=", [20]], ["value", "<", [75]], ["event_type", "equals_any", ["purchase", "click"]]]
    return select_rows(table(spark, sf_dir, "events"), conf, out=["event_id", "value"])


@query("filter_text_numbers", "select event_id from (select event_id, try_cast(case when event_id % 7 = 0 then 'n/a' else cast(value as varchar) end as double) v from events) where v >= 75")
def text_numbers(spark, sf_dir):
    """Numbers that arrive as text: what is no number is dropped by the predicate."""
    text = F.when(F.col("event_id") % 7 == 0, "n/a").otherwise(F.col("value").cast("string"))
    return select_rows(table(spark, sf_dir, "events").withColumn("v", text), [["v", ">=", [75]]], out=["event_id"])


@query("project_reorder", "select n_name, n_nationkey from nation")
def reorder(spark, sf_dir):
    return map_rows(table(spark, sf_dir, "nation").select("n_nationkey", "n_name"), out=[1, 0])


@query("rename_positional", "select r_regionkey as id, r_name as label from region")
def positional(spark, sf_dir):
    return name_columns(table(spark, sf_dir, "region").select("r_regionkey", "r_name"), ["id", "label"])


@query("pad_columns", "select r_name, cast(null as varchar) as note from region")
def padded(spark, sf_dir):
    return pad_columns(table(spark, sf_dir, "region").select("r_name"), ["note"])


@query("map_month", "select event_id, cast((year(ts)-2020)*12+month(ts) as integer) as m from events")
def months(spark, sf_dir):
    return map_rows(events(spark, sf_dir).withColumnRenamed("transaction_id", "event_id"), [["map_month", {"init_year": 2020, "col_out": "m"}]], ["event_id", "m"])


@query("map_semester", "select o_orderkey, cast((year(o_orderdate)-1995)*2+(month(o_orderdate)-1)//6 as integer) as s from orders")
def semesters(spark, sf_dir):
    at = F.col("o_orderdate")
    return map_rows(table(spark, sf_dir, "orders").withColumns({"year": F.year(at), "month": F.month(at)}), [["map_semester", {"init_year": 1995, "col_out": "s"}]], ["o_orderkey", "s"])


@query("map_chain", "select event_id, cast((year(ts)-2024)*12+((year(ts)-2024)*12+month(ts)) as integer) as month from events")
def chained_maps(spark, sf_dir):
    twice = [["map_month", {"init_year": 2024}]] * 2
    return map_rows(events(spark, sf_dir).withColumnRenamed("transaction_id", "event_id"), twice, ["event_id", "month"])


@query("decode_month", "select l_orderkey, l_linenumber, strftime(l_shipdate, '%Y-%m') as year_month from lineitem")
def months_back(spark, sf_dir):
    at = F.col("l_shipdate")
    index = (F.year(at) - 1995) * 12 + F.month(at)
    return table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", decode_month(index, 1995).alias("year_month"))


@query("decode_semester", "select o_orderkey, cast(year(o_orderdate) as varchar)||case when month(o_orderdate)<=6 then '-H1' else '-H2' end as year_half from orders")
def halves_back(spark, sf_dir):
    return semesters(spark, sf_dir).select("o_orderkey", decode_half(F.col("s"), 1995).alias("year_half"))


_AGGREGATES = {
    "agg_sum": (["sum", "value", "x"], "round(sum(value), 3)"),
    "agg_max": (["max", "value", "x"], "max(value)"),
    "agg_avg": (["avg", "value", "x"], "round(avg(value), 6)"),
    "agg_money_sum": (["money_sum", "value", "x"], "cast(sum(cast(value as decimal(24,4))) as double)"),
    "agg_count": (["count", "x"], "count(*)"),
}
for _name, (_agg, _expr) in _AGGREGATES.items():
    query(_name, f"select event_type, {_expr} as x from events group by 1")(
        lambda spark, sf_dir, agg=_agg: _rounded(group_by(table(spark, sf_dir, "events"), ["event_type"], [agg]), agg[0])
    )


def _rounded(df: DataFrame, op: str) -> DataFrame:
    """Sums of doubles depend on the order of the rows in their last digits."""
    return df.withColumn("x", F.round("x", {"sum": 3, "avg": 6}[op])) if op in ("sum", "avg") else df


@query("agg_multi", """select o_custkey, year(o_orderdate) as y, round(sum(o_totalprice), 3) as total,
 max(o_totalprice) as top, count(*) as n from orders group by 1,2""")  # fmt: skip
def multi(spark, sf_dir):
    orders = table(spark, sf_dir, "orders").withColumn("y", F.year("o_orderdate"))
    return group_by(orders, ["o_custkey", "y"], [["sum", "o_totalprice", "total"], ["max", "o_totalprice", "top"], ["count", "n"]]).withColumn("total", F.round("total", 3))


@query("agg_per_session", "select user_id, event_type, count(*) as n from events group by 1,2")
def per_session(spark, sf_dir):
    return group_by(table(spark, sf_dir, "events"), ["event_type"], [["count", "n"]], session="user_id")


def _ranked(order: str, k: int) -> str:
    return f"""select event_type, event_id, value, rank from (select event_type, event_id, value,
 cast(row_number() over (partition by event_type order by {order}) as integer) as rank from events) where rank <= {k}"""


_TOP = {
    "top_row": ("keep_top_row", {"comp_key": "value", "ties": ["event_id"]}, _ranked("value desc, event_id", 1)),
    "top_k": ("keep_top_k", {"comp_key": "value", "limit": 5, "ties": ["event_id"]}, _ranked("value desc, event_id", 5)),
    "least_k": ("keep_least_k", {"comp_key": "value", "limit": 5, "ties": ["event_id"]}, _ranked("value, event_id", 5)),
    "top_k_asc_desc": ("keep_asc_desc", {"comp_key": "value", "comp_key2": "user_id", "limit": 5, "ties": ["event_id"]}, _ranked("value desc, user_id, event_id", 5)),
    "keep_all": ("keep_all_rows", {"ties": ["event_id"]}, _ranked("event_id", 2**31 - 1)),
}
for _name, (_reducer, _params, _sql) in _TOP.items():
    query(_name, _sql)(
        lambda spark, sf_dir, r=_reducer, p=_params: reduce_rows(table(spark, sf_dir, "events"), ["event_type"], r, p, ["event_type", "event_id", "value"], rank=True).withColumn("rank", F.col("rank").cast("int"))
    )


@query("join_project_all", "select n_nationkey, n_name, n_regionkey, r_regionkey, r_name from nation join region on n_regionkey=r_regionkey")
def join_all(spark, sf_dir):
    n, r = table(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey"), table(spark, sf_dir, "region").select("r_regionkey", "r_name")
    return equi_join(n, r, ("n_regionkey", "r_regionkey"))


@query("join_ordered", "select o_orderkey, c_name, o_totalprice, c_custkey from customer join orders on c_custkey=o_custkey")
def join_ordered(spark, sf_dir):
    return equi_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), ("c_custkey", "o_custkey"), ["o_orderkey", "c_name", "o_totalprice", "c_custkey"])


@query("join_name_clash", "select c_custkey as id, c_name as name, o_orderkey from customer join orders on c_custkey=o_custkey")
def join_clash(spark, sf_dir):
    left = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"))
    right = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("id"), F.lit("right").alias("name"), "o_orderkey")
    return equi_join(left, right, ("id", "id"))


@query("join_chained", """select o_orderkey, n_name, r_name from orders join customer on o_custkey=c_custkey
 join nation on c_nationkey=n_nationkey join region on n_regionkey=r_regionkey""")  # fmt: skip
def join_chained(spark, sf_dir):
    oc = equi_join(table(spark, sf_dir, "customer"), table(spark, sf_dir, "orders"), ("c_custkey", "o_custkey"), ["o_orderkey", "c_nationkey"])
    ocn = equi_join(table(spark, sf_dir, "nation"), oc, ("n_nationkey", "c_nationkey"), ["o_orderkey", "n_name", "n_regionkey"])
    return equi_join(table(spark, sf_dir, "region"), ocn, ("r_regionkey", "n_regionkey"), ["o_orderkey", "n_name", "r_name"])


@query("join_shared_dim", """select 'customer' as query, c_custkey as id, n_name from customer join nation on c_nationkey=n_nationkey
 union all select 'supplier', s_suppkey, n_name from supplier join nation on s_nationkey=n_nationkey""")  # fmt: skip
def join_shared(spark, sf_dir):
    nation = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    side = lambda name, p: equi_join(nation, table(spark, sf_dir, name), ("n_nationkey", f"{p}_nationkey"), [f"{p}_{'cust' if p == 'c' else 'supp'}key", "n_name"]).toDF("id", "n_name")
    return tagged_union({"customer": side("customer", "c"), "supplier": side("supplier", "s")}).select("query", "id", "n_name")


@query("fanout_q1_q3_q4", """select 'q1' as query, cast(event_id as varchar) as k, value as v from events
 where year(ts) in (2024,2025) and hour(ts) between 6 and 23 and value >= 75
 union all select 'q3', event_type, cast(sum(cast(value as decimal(24,4))) as double) from events
 where year(ts) in (2024,2025) and hour(ts) between 6 and 23 group by 2
 union all select 'q4', k, v from (select event_type||'/'||cast(user_id as varchar) as k, cast(n as double) as v,
 row_number() over (partition by event_type order by n desc, user_id) rn from
 (select event_type, user_id, count(*) n from events where year(ts) in (2024,2025) and user_id is not null group by 1,2)) where rn<=3""")  # fmt: skip
def fanout(spark, sf_dir):
    """One scan of the events, pruned and kept in the shared folder, serves three reports."""
    tx, years = written(event_sources(spark, sf_dir).transactions, "fan-out"), ["year", "equals_any", [2024, 2025]]
    q1 = select_rows(tx, [years, ["hour", "between", [6, 23]], ["final_amount", ">=", [75]]]).select(F.col("transaction_id").cast("string").alias("k"), F.col("final_amount").alias("v"))
    q3 = group_by(select_rows(tx, [years, ["hour", "between", [6, 23]]]), ["store_id"], [["money_sum", "final_amount", "v"]]).toDF("k", "v")
    top = {"comp_key": "n", "comp_key2": "user_id", "limit": 3}
    q4 = reduce_rows(group_by(select_rows(tx, [years, ["user_id", "not_equals", ["", "None"]]]), ["store_id", "user_id"], [["count", "n"]]), ["store_id"], "keep_asc_desc", top)
    q4 = q4.select(F.concat_ws("/", "store_id", F.col("user_id").cast("string")).alias("k"), F.col("n").cast("double").alias("v"))
    return tagged_union({"q1": q1, "q3": q3, "q4": q4}).select("query", "k", "v")


@query("shared_aggregate_two_topk", f"""{_MONTHLY} select 'quantity' as query, m, k, cast(q as double) as x from
 (select *, row_number() over (partition by m order by q desc, k) rn from g) where rn=1
 union all select 'revenue', m, k, cast(v as double) from (select *, row_number() over (partition by m order by v desc, k) rn from g) where rn=1""")  # fmt: skip
def shared_aggregate(spark, sf_dir):
    """The monthly sums are made once, and both rankings in the one aggregation over them."""
    grouped = P.reports.monthly_products(order_sources(spark, sf_dir))
    tops = top_rows(grouped, ["month"], {"quantity": "quantity_sold", "revenue": "revenue"}, ["item_id"])
    return tops.select("query", F.col("month").alias("m"), F.col("item_id").alias("k"), F.col("value").alias("x"))


@query("multiset_diff", """select event_type, cast(sum(a) as bigint) as n_expected, cast(sum(b) as bigint) as n_actual from (select event_type, 1 as a, 0 as b from events
 union all select event_type, 0, 1 from events where value >= 10) group by 1 having sum(a) <> sum(b)""")  # fmt: skip
def diff(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    return multiset_diff(e.select("event_type"), filter_rows(e, [["value", ">=", [10]]]).select("event_type"))


def _messages(e: DataFrame) -> DataFrame:
    """Each user's upload is a session: a message per event, an end marker that announces one message
    too many for users divisible by 5 and aborts users divisible by 7."""
    data = e.select(F.col("user_id").cast("string").alias("session_id"), F.lit(None).cast("long").alias("expected"), F.lit(1).cast("long").alias("n_messages"),
                    F.when(F.col("value") >= 75, F.col("event_id").cast("string")).alias("payload"))
    ends = e.groupBy("user_id").count().select(
        F.col("user_id").cast("string").alias("session_id"),
        F.when(F.col("user_id") % 7 == 0, -1).when(F.col("user_id") % 5 == 0, F.col("count") + 1).otherwise(F.col("count")).alias("expected"),
        F.lit(0).cast("long").alias("n_messages"), F.lit(None).cast("string").alias("payload"))
    return data.unionByName(ends)


_COMPLETE_SQL = """select cast(user_id as varchar) as session_id, cast(event_id as varchar) as payload from events
 where value >= 75 and user_id % 7 <> 0 and user_id % 5 <> 0"""


@query("completion_gate", _COMPLETE_SQL)
def gate(spark, sf_dir):
    return completed_rows(_messages(table(spark, sf_dir, "events")))


def _arriving(messages: DataFrame, what: str) -> DataFrame:
    """The messages as a stream of some micro-batches, each of rows of any session."""
    spark, kept = messages.sparkSession, written(messages, what)
    return spark.readStream.schema(kept.schema).option("maxFilesPerTrigger", max(1, len(kept.inputFiles()) // 3)).parquet(kept._written_to)


@query("stream_completion_gate", _COMPLETE_SQL)
def stream_gate(spark, sf_dir):
    """The same by the stateful gate over a stream of files."""
    out, provider = new_folder(spark, "stream-gate"), "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        released = completion_gate(_arriving(_messages(table(spark, sf_dir, "events")), "messages"), groups=1024)
        released.writeStream.format("parquet").option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).start(f"{out}/rows").awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema("session_id string, payload string").parquet(f"{out}/rows")


def _order_sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Orders and their items as the two sides of 50 sessions. Of sessions divisible by 5 an order is
    missing; those divisible by 7 are aborted on the side of the items."""
    none = F.lit(None).cast("long").alias("expected")

    def side(df: DataFrame, key: str, announced) -> DataFrame:
        df = df.withColumn("n", F.col(key) % 50)
        ends = df.groupBy("n").count().select(F.col("n").cast("string").alias("session_id"), announced(F.col("count"), F.col("n")).cast("long").alias("expected"), F.lit(0).cast("long").alias("n_messages"))
        rows = df.select(F.col("n").cast("string").alias("session_id"), none, F.lit(1).cast("long").alias("n_messages"), *[c for c in df.columns if c != "n"])
        return rows.unionByName(ends, allowMissingColumns=True)

    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    return side(orders, "o_orderkey", lambda n, s: F.when(s % 5 == 0, n + 1).otherwise(n)), side(lines, "l_orderkey", lambda n, s: F.when(s % 7 == 0, -1).otherwise(n))


_SIDES_SQL = """select cast(o_orderkey % 50 as varchar) as session_id, o_orderkey, o_totalprice, l_orderkey, l_linenumber, l_partkey
 from orders join lineitem on o_orderkey = l_orderkey where o_orderkey % 50 % 5 <> 0 and o_orderkey % 50 % 7 <> 0"""


@query("join_completed", _SIDES_SQL)
def join_completed(spark, sf_dir):
    """Sessions are joined only when both of their sides are complete."""
    return completed_join(*_order_sides(spark, sf_dir), ("o_orderkey", "l_orderkey"))


@query("stream_join_completed", _SIDES_SQL)
def stream_join_completed(spark, sf_dir):
    """The same over two streams of files."""
    out = new_folder(spark, "stream-join")
    left, right = [_arriving(side, "side") for side in _order_sides(spark, sf_dir)]
    stream_completed_join(left, right, ("o_orderkey", "l_orderkey"), f"{out}/state", f"{out}/checkpoint").awaitTermination()
    return read_completed_join(spark, f"{out}/state")


def _as_csv(spark: SparkSession, sf_dir: str, amount=None, parts: int | None = None) -> str:
    """The events as files of the transactions dataset; the folder."""
    value = F.col("value")
    path = new_folder(spark, "transactions")
    events = table(spark, sf_dir, "events")
    (events.repartition(parts) if parts else events).select(
        F.col("event_id").alias("transaction_id"), (F.col("user_id") % 10).alias("store_id"), F.lit(1).alias("payment_method_id"), F.lit(None).cast("string").alias("voucher_id"),
        F.col("user_id").cast("double").alias("user_id"), value.alias("original_amount"), F.lit(0.0).alias("discount_applied"),
        (value if amount is None else amount).alias("final_amount"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    ).write.option("header", True).csv(path)
    return path


_SCANNED = """select cast(event_id as varchar) as transaction_id, cast(year(ts) as integer) as year, cast(user_id % 10 as integer) as store_id, user_id,
 cast(month(ts) as integer) as month, cast(hour(ts) as integer) as hour, value as final_amount from events"""


@query("csv_transactions_scan", _SCANNED)
def csv_scan(spark, sf_dir):
    """Header check, typed scan, calendar parts and "13060.0" as a number."""
    return sources.transactions(sources.read_dataset(spark, _as_csv(spark, sf_dir), "transactions"))


@query("csv_malformed_dropped", _SCANNED + " where event_id % 10 <> 3")
def csv_dropped(spark, sf_dir):
    amount = F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.col("value").cast("string"))
    return sources.transactions(sources.read_dataset(spark, _as_csv(spark, sf_dir, amount), "transactions", "DROPMALFORMED"))


def _csv(df: DataFrame, name: str) -> str:
    """The rows as files of a dataset, with its header; the folder."""
    path = new_folder(df.sparkSession, name)
    df.select(*[F.col(c) for c in sources.SCHEMAS[name].names]).write.option("header", True).csv(path)
    return path


def _scan(df: DataFrame, name: str) -> DataFrame:
    return sources.read_dataset(df.sparkSession, _csv(df, name), name)


def _menu_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_name").alias("item_name"), F.col("p_type").alias("category"), F.col("p_retailprice").alias("price"),
        (F.col("p_size") > 25).alias("is_seasonal"), F.lit("2024-01-01").alias("available_from"), F.lit(None).cast("string").alias("available_to"))


def _user_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    born = F.date_add(F.lit("1970-01-01").cast("date"), F.col("c_custkey").cast("int"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("gender"), born.alias("birthdate"), F.lit("2025-01-01 07:31:48").alias("registered_at"))


def _item_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("quantity"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"), F.col("l_extendedprice").alias("subtotal"),
        F.date_format("l_shipdate", "yyyy-MM-dd HH:mm:ss").alias("created_at"))


@query("csv_items_scan", """select cast(l_partkey as integer) as item_id, cast(year(l_shipdate) as integer) as year, cast(month(l_shipdate) as integer) as month,
 l_extendedprice as subtotal, cast(l_quantity as integer) as quantity from lineitem""")  # fmt: skip
def csv_items(spark, sf_dir):
    return sources.transaction_items(_scan(_item_rows(spark, sf_dir), "transaction_items"))


@query("csv_menu_scan", "select cast(p_partkey as integer) as item_id, p_name as item_name from part")
def csv_menu(spark, sf_dir):
    return sources.menu_items(_scan(_menu_rows(spark, sf_dir), "menu_items"))


@query("csv_stores_scan", "select cast(s_suppkey as integer) as store_id, s_name as store_name from supplier")
def csv_stores(spark, sf_dir):
    """The suppliers as stores; the commas of the streets are quoted."""
    return sources.stores(_scan(_store_rows(spark, sf_dir), "stores"))


def _store_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(
        F.col("s_suppkey").alias("store_id"), F.col("s_name").alias("store_name"), F.concat_ws(", ", "s_name", "s_nationkey").alias("street"), F.lit("00123").alias("postal_code"),
        F.lit("city").alias("city"), F.lit("state").alias("state"), F.col("s_acctbal").alias("latitude"), F.col("s_acctbal").alias("longitude"))


@query("csv_users_scan", "select c_custkey as user_id, strftime(date '1970-01-01' + cast(c_custkey as integer), '%Y-%m-%d') as birthdate from customer")
def csv_users(spark, sf_dir):
    return sources.users(_scan(_user_rows(spark, sf_dir), "users")).withColumn("birthdate", F.col("birthdate").cast("string"))


@query("csv_sanitised_round_trip", "select cast(p_partkey as integer) as item_id, p_name as item_name, p_type as category, p_retailprice as price from part")
def csv_sanitised(spark, sf_dir):
    """The wide columns of the menu, written without a header and read back."""
    path = new_folder(spark, "sanitised")
    sources.wide(_scan(_menu_rows(spark, sf_dir), "menu_items"), "menu_items").write.csv(path)
    return sources.read_sanitised(spark, path, "menu_items")


@query("stream_transactions_scan", _SCANNED)
def stream_scan(spark, sf_dir):
    """Files of a dataset folder as increments."""
    out = new_folder(spark, "stream-scan")
    rows = sources.transactions(sources.stream_dataset(spark, _as_csv(spark, sf_dir), "transactions", 2))
    stream_filter(rows, f"{out}/rows", f"{out}/checkpoint").awaitTermination()
    return spark.read.schema(rows.schema).parquet(f"{out}/rows")


@query("run_all_reports", f"""with o as (select o_orderkey k, o_totalprice v, c_nationkey s, o_custkey u from orders join customer on o_custkey=c_custkey where year(o_orderdate) in (1996,1997))
select 'query_1' as query, cast(k as varchar) as name, cast(null as varchar) as period, v as value from o where v >= 75
union all select 'query_2_best_selling', item_name, year_month, cast(sellings_qty as double) from ({_MONTHLY} {_BEST})
union all select 'query_2_most_profits', item_name, year_month, profit_sum from ({SQL['q2_most_profit']})
union all select 'query_3', store_name, year_half, tpv from ({Q3_SQL})
union all select 'query_4', n_name, strftime(date '1970-01-01' + cast(u as integer), '%Y-%m-%d'), null from
 (select s, u, row_number() over (partition by s order by count(*) desc, u) rn from o group by s, u) join nation on s=n_nationkey where rn<=3""")  # fmt: skip
def run_all_reports(spark, sf_dir):
    """All five reports of a session, published as files and read back."""
    s, out = replace(order_sources(spark, sf_dir), users=_user_rows(spark, sf_dir).select("user_id", "birthdate")), new_folder(spark, "results")
    P.run_all(s, out, "session")
    return _as_one(sinks.read_results(spark, out, "session"))


def _as_one(back: dict[str, DataFrame]) -> DataFrame:
    none = F.lit(None)
    parts = {
        "query_1": ("transaction_id", none, "final_amount"), "query_2_best_selling": ("item_name", "year_month", "sellings_qty"), "query_2_most_profits": ("item_name", "year_month", "profit_sum"),
        "query_3": ("store_name", "year_half", "tpv"), "query_4": ("store_name", "birthdate", none),
    }
    column = lambda c, kind: (F.col(c) if isinstance(c, str) else c).cast(kind)
    rows = {q: back[q].select(column(n, "string").alias("name"), column(p, "string").alias("period"), column(v, "double").alias("value")) for q, (n, p, v) in parts.items()}
    return tagged_union(rows).select("query", "name", "period", "value")


@query("result_files_round_trip", Q1_SQL.replace("event_id as", "cast(event_id as varchar) as"))
def result_files(spark, sf_dir):
    """The first report through its headerless session files."""
    path = sinks.write_result(q1(spark, sf_dir), new_folder(spark, "results"), "session", "query_1")
    return sources.read_result(spark, path, "query_1")


@query("comparison_summary", "select * from (values ('q1', 'matched'), ('q4', 'different'), ('q5', 'missing')) t(name, status)")
def comparison(spark, sf_dir):
    """Result sets held against each other: the first report and its stream twin, buyers with and without the last rank."""
    s = event_sources(spark, sf_dir)
    expected = {"q1": q1(spark, sf_dir), "q4": P.top_buyers(s, 3), "q5": q1(spark, sf_dir)}
    return summary(spark, expected, {"q1": stream_q1(spark, sf_dir), "q4": P.top_buyers(s, 2)})


def _stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    return as_transactions(spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir))


@query("stream_q1", Q1_SQL)
def stream_q1(spark, sf_dir):
    """The first report over a stream of files; equals the batch report."""
    out = new_folder(spark, "stream-q1")
    conf = [["year", "equals_any", [2024, 2025]], ["hour", "between", [6, 23]], ["final_amount", ">=", [75]]]
    stream_filter(_stream(spark, sf_dir), f"{out}/rows", f"{out}/checkpoint", conf, out=["transaction_id", "final_amount"]).awaitTermination()
    return spark.read.parquet(f"{out}/rows")


@query("stream_q4", Q4_SQL)
def stream_q4(spark, sf_dir):
    """Lists of three buyers a store, kept as the counts grow; the users are joined in the end."""
    out = new_folder(spark, "stream-q4")
    rows = filter_rows(_stream(spark, sf_dir), [["year", "equals_any", [2024, 2025]], ["user_id", "not_equals", ["", "None"]]])
    top = {"comp_key": "n", "comp_key2": "user_id", "limit": 3}
    stream_top_k(rows, out, f"{out}/checkpoint", ["store_id", "user_id"], ["count", "n"], ["store_id"], "keep_asc_desc", top).awaitTermination()
    lists = read_top_k(spark, out, "store_id string, user_id long, n long")
    return equi_join(_users(spark, sf_dir), lists, ("user_id", "user_id"), ["store_id", "birthdate"]).toDF("store_name", "birthdate")


def _hot(df: DataFrame, spread: int) -> DataFrame:
    """A stream of the table in several micro-batches."""
    return _arriving(df.repartition(spread), "increments")


@query("stream_append_replayed", Q1_SQL)
def append_replayed(spark, sf_dir):
    """The first report appended to a table by a stream. Then the last micro-batch runs again, since its mark in
    the checkpoint is gone, and a folder lies there that was never published: readers see each row once."""
    out = new_folder(spark, "append")
    rows = P.transactions_filter(replace(event_sources(spark, sf_dir), transactions=as_transactions(_hot(table(spark, sf_dir, "events"), 6))))
    append_stream(rows, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    log = Published(spark, f"{out}/table")
    last = log.batches()[-1]
    _forget_commit(spark, f"{out}/checkpoint", last)
    append_stream(rows, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    rows_of = log.read(rows.schema)
    rows_of.write.parquet(log.folder(last + 1))
    return log.read(rows.schema)


@query("stream_append_compacted", Q1_SQL)
def append_compacted(spark, sf_dir):
    """The same table, its micro-batches merged into one folder before the last one is repeated."""
    out = new_folder(spark, "append")
    rows = P.transactions_filter(replace(event_sources(spark, sf_dir), transactions=as_transactions(_hot(table(spark, sf_dir, "events"), 6))))
    append_stream(rows, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    log = Published(spark, f"{out}/table")
    log.compact(rows.schema)
    log.vacuum()
    _forget_commit(spark, f"{out}/checkpoint", log.batches()[-1])
    append_stream(rows, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return log.read(rows.schema)


def _forget_commit(spark: SparkSession, checkpoint: str, n: int) -> None:
    """As if the driver had been lost before micro-batch ``n`` was marked as done."""
    for name in (str(n), f".{n}.crc"):
        remove(spark, f"{checkpoint}/commits/{name}")


#: Lines in a partial result.
LINES = 500


def _partial_results(e: DataFrame) -> DataFrame:
    """Six sessions' results of each event type, in messages of up to LINES lines. Session 5 lacks a message of its
    clicks, and session 3 is aborted; of session 4 the end of the views is not announced."""
    e = e.select((F.col("user_id") % 6).cast("string").alias("session_id"), F.col("event_type").alias("query"), F.floor(F.col("event_id") / LINES).alias("part"),
                 F.concat_ws(",", F.col("event_id").cast("string"), F.col("value").cast("string")).alias("line"))
    key = ["session_id", "query"]
    data = e.groupBy(*key, "part").agg(F.collect_list("line").alias("lines")).select(*key, F.lit(None).cast("long").alias("expected"), F.lit(1).cast("long").alias("n_messages"), "lines")
    announced = F.when(F.col("session_id") == "3", -1).when((F.col("session_id") == "5") & (F.col("query") == "click"), F.col("n") + 1).otherwise(F.col("n"))
    ends = e.groupBy(*key).agg(F.count_distinct("part").alias("n")).filter("not (session_id = '4' and query = 'view')")
    ends = ends.select(*key, announced.cast("long").alias("expected"), F.lit(0).cast("long").alias("n_messages"), F.lit(None).cast("array<string>").alias("lines"))
    return data.unionByName(ends)


_PARTS_SQL = """select cast(user_id % 6 as varchar) as session_id, event_type as query, cast(event_id as varchar) as event_id from events
 where user_id % 6 <> 3 and not (user_id % 6 = 5 and event_type = 'click') and not (user_id % 6 = 4 and event_type = 'view')"""


def _ledger(spark, sf_dir) -> str:
    out = new_folder(spark, "ledger")
    stream_results(_hot(_partial_results(table(spark, sf_dir, "events")), 6), out, f"{out}/checkpoint").awaitTermination()
    return out


def _released_parts(spark, sf_dir) -> DataFrame:
    lines = read_completed(spark, _ledger(spark, sf_dir), "session_id string, query string, lines array<string>")
    return lines.select("session_id", "query", F.explode("lines").alias("line")).select("session_id", "query", F.split("line", ",")[0].alias("event_id"))


@query("stream_result_ledger", _PARTS_SQL)
def result_ledger(spark, sf_dir):
    """Partial results come in any order; a session's report is published once all of its messages are there."""
    return _released_parts(spark, sf_dir)


@query("stream_ready_sessions", "select distinct cast(user_id % 6 as varchar) as session_id from events where user_id % 6 not in (3, 4, 5)")
def sessions_ready(spark, sf_dir):
    """Sessions whose reports are all published."""
    types = [r[0] for r in table(spark, sf_dir, "events").select("event_type").distinct().collect()]
    return ready_sessions(completed_keys(spark, _ledger(spark, sf_dir), "session_id string, query string"), types)


@query("stream_session_results", SQL["run_all_reports"])
def session_results(spark, sf_dir):
    """The five reports of two sessions arrive in parts of up to LINES lines, in any order; the one session that
    is complete is read back, typed. Of the other, one report lacks a message."""
    s, out = replace(order_sources(spark, sf_dir), users=_user_rows(spark, sf_dir).select("user_id", "birthdate")), new_folder(spark, "session-results")
    reports = zip(P.reports.REPORTS, (P.transactions_filter, P.best_selling, P.most_profit, P.payment_volume, P.top_buyers), strict=True)
    lines = tagged_union({q: f(s).select(F.to_csv(F.struct("*")).alias("line")) for q, f in reports})
    parts = lines.withColumn("part", F.floor(F.monotonically_increasing_id() / LINES)).groupBy("query", "part").agg(F.collect_list("line").alias("lines"))
    parts = written(parts.select("query", "lines"), "parts").withColumn("session_id", F.explode(F.array(F.lit("first"), F.lit("second"))))
    messages = parts.select("session_id", "query", F.lit(None).cast("long").alias("expected"), F.lit(1).cast("long").alias("n_messages"), "lines")
    lacks = F.when((F.col("session_id") == "second") & (F.col("query") == "query_3"), 1).otherwise(0)
    ends = parts.groupBy("session_id", "query").count().select("session_id", "query", (F.col("count") + lacks).alias("expected"), F.lit(0).cast("long").alias("n_messages"), F.lit(None).cast("array<string>").alias("lines"))
    stream_results(_hot(messages.unionByName(ends), 6), out, f"{out}/checkpoint").awaitTermination()
    return _as_one(read_session(spark, out, "first"))


@query("stream_split_gate", _COMPLETE_SQL)
def split_gate(spark, sf_dir):
    """The gate with each session's rows spread over shards; only counts meet in a session."""
    out = new_folder(spark, "split-gate")
    stream_completed(_hot(_messages(table(spark, sf_dir, "events")), 6), ["session_id"], out, f"{out}/checkpoint").awaitTermination()
    return read_completed(spark, out, "session_id string, payload string")


@query("stream_fanout_q1_q3_q4", SQL["fanout_q1_q3_q4"])
def stream_fanout(spark, sf_dir):
    """One stream of the events feeds three reports; each micro-batch is read once. Sums and counts of the
    micro-batches are added up in the end."""
    out, years, hours = new_folder(spark, "stream-fan-out"), ["year", "equals_any", [2024, 2025]], ["hour", "between", [6, 23]]
    branches = {
        "q1": lambda d: select_rows(d, [years, hours, ["final_amount", ">=", [75]]], out=["transaction_id", "final_amount"]),
        "q3": lambda d: group_by(select_rows(d, [years, hours]), ["store_id"], [["money_sum", "final_amount", "v"]]),
        "q4": lambda d: group_by(select_rows(d, [years, ["user_id", "not_equals", ["", "None"]]]), ["store_id", "user_id"], [["count", "n"]]),
    }
    stream_fan_out(as_transactions(_hot(table(spark, sf_dir, "events"), 6)), branches, out, f"{out}/checkpoint").awaitTermination()
    q1 = read_fan_out(spark, out, "q1", "transaction_id long, final_amount double").select(F.col("transaction_id").cast("string").alias("k"), F.col("final_amount").alias("v"))
    q3 = group_by(read_fan_out(spark, out, "q3", "store_id string, v double"), ["store_id"], [["money_sum", "v"]]).toDF("k", "v")
    counts = read_fan_out(spark, out, "q4", "store_id string, user_id long, n long").groupBy("store_id", "user_id").agg(F.sum("n").alias("n"))
    q4 = reduce_rows(counts, ["store_id"], "keep_asc_desc", {"comp_key": "n", "comp_key2": "user_id", "limit": 3})
    q4 = q4.select(F.concat_ws("/", "store_id", F.col("user_id").cast("string")).alias("k"), F.col("n").cast("double").alias("v"))
    return tagged_union({"q1": q1, "q3": q3, "q4": q4}).select("query", "k", "v")


@query("stream_join_two_sided", """select o_orderkey, o_totalprice, l_linenumber, l_partkey from orders join lineitem on o_orderkey = l_orderkey
 where l_shipdate between o_orderdate - interval 130 days and o_orderdate + interval 130 days""")  # fmt: skip
def join_two_sided(spark, sf_dir):
    """Orders and their items as two streams, in append mode; rows that can match nothing any more are freed."""
    out, cols = new_folder(spark, "stream-stream"), ["o_orderkey", "o_totalprice", "l_linenumber", "l_partkey"]
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", F.col("o_orderdate").cast("timestamp").alias("ordered"))
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_shipdate").cast("timestamp").alias("shipped"))
    files, on = max(6, spark.sparkContext.defaultParallelism), ("o_orderkey", "l_orderkey")
    left, right = [_arriving(df.repartitionByRange(files, at), "side") for df, at in ((orders, "ordered"), (lines, "shipped"))]
    stream_near_join(left, right, on, cols, ("ordered", "shipped"), "130 days", "3650 days", out, f"{out}/checkpoint").awaitTermination()
    return Published(spark, f"{out}/table").read(equi_join(orders, lines, on, cols).schema)


class _Spread(Accumulator):
    """Largest less smallest value."""

    def new(self):
        return None

    def add(self, state, value):
        return state if value is None else (value, value) if state is None else (min(state[0], value), max(state[1], value))

    def merge(self, state, other):
        return other if state is None else state if other is None else (min(state[0], other[0]), max(state[1], other[1]))

    def result(self, state):
        return None if state is None else state[1] - state[0]


class _Odd(Accumulator):
    """How many values are odd."""

    out = "long"

    def new(self):
        return 0

    def add(self, state, value):
        return state + (value is not None and value % 2)

    def merge(self, state, other):
        return state + other


@query("accumulate_own", "select event_type, max(value) - min(value) as spread, count(*) filter (event_id % 2 = 1) as odd from events group by 1")
def accumulate_own(spark, sf_dir):
    """A user's own aggregates by partial states."""
    register_accumulator("spread", _Spread())
    register_accumulator("odd", _Odd())
    return accumulate(table(spark, sf_dir, "events"), ["event_type"], [["spread", "value", "spread"], ["odd", "event_id", "odd"]])


@query("reduce_own", """select event_type, event_id, value, rank from (select event_type, event_id, value,
 row_number() over (partition by event_type order by abs(value - 50), event_id) as rank from events) where rank <= 4""")  # fmt: skip
def reduce_own(spark, sf_dir):
    """A user's own order of rows: the four nearest to 50 of each type."""
    register_row_order("nearest to 50", lambda row: (row["value"] is None, abs((row["value"] or 0) - 50), row["event_id"]))
    events = table(spark, sf_dir, "events").select("event_type", "event_id", "value")
    return least_rows(events, ["event_type"], "nearest to 50", 4, rank=True).withColumn("rank", F.col("rank").cast("long"))


@query("stream_by_bytes", _SCANNED)
def stream_by_bytes(spark, sf_dir):
    """The transactions as increments of about a tenth of their bytes."""
    out, path = new_folder(spark, "stream-bytes"), _as_csv(spark, sf_dir, parts=20)
    size = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(path).agg(F.sum("length")).first()[0]
    rows = sources.transactions(sources.stream_dataset(spark, path, "transactions", bytes_per_trigger=size // 10))
    append_stream(rows, f"{out}/table", f"{out}/checkpoint").awaitTermination()
    return Published(spark, f"{out}/table").read(rows.schema)


@query("csv_quarantine", f"""select 'row' as kind, transaction_id, final_amount, null as line from ({_SCANNED} where event_id % 10 <> 3)
 union all select 'line', null, null, cast(event_id as varchar) from events where event_id % 10 = 3""")  # fmt: skip
def csv_quarantine(spark, sf_dir):
    """Malformed lines go to a table of their own, with their file; the rest stays. One parse for both."""
    amount = F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.col("value").cast("string"))
    good, bad = sources.quarantine(spark, _as_csv(spark, sf_dir, amount), "transactions")
    rows = sources.transactions(good).select(F.lit("row").alias("kind"), "transaction_id", "final_amount", F.lit(None).cast("string").alias("line"))
    lines = bad.filter("file like '%.csv'").select(F.lit("line").alias("kind"), F.lit(None).cast("string"), F.lit(None).cast("double"), F.split("line", ",")[0])
    return rows.unionAll(lines)


def _sets(spark, sf_dir) -> tuple[dict[str, DataFrame], dict[str, DataFrame]]:
    e = table(spark, sf_dir, "events")
    large, some = (filter_rows(e, [["value", ">=", [v]]]).select("event_type", "user_id") for v in (75, 50))
    return {"large": large, "some": some, "gone": large}, {"large": stream_q1(spark, sf_dir).select(F.lit("x"), "final_amount"), "some": large}


@query("comparison_counts", """with e as (select event_type, user_id, value from events),
c as (select count(*) filter (value >= 75) as l, count(*) filter (value >= 50) as s, count(*) filter (value >= 75 and year(ts) in (2024,2025) and hour(ts) between 6 and 23) as q from events)
select 'large' as name, 'different' as status, l as n_expected, q as n_actual, l as n_lost, q as n_added from c
union all select 'some', case when l = s then 'matched' else 'different' end, s, l, s - l, 0 from c
union all select 'gone', 'missing', l, 0, l, 0 from c""")  # fmt: skip
def comparison_counts(spark, sf_dir):
    """Result sets held against each other, with the rows that either side lacks."""
    return compared(spark, *_sets(spark, sf_dir))


@query("comparison_totals", """select count(*) filter (true) - 1 as n_compared, count(*) filter (same) as n_matched, count(*) filter (not same) - 1 as n_different, 1 as n_missing,
 'failed' as status from (select false as same union all select count(*) filter (value >= 75) = count(*) filter (value >= 50) from events union all select false)""")  # fmt: skip
def comparison_totals(spark, sf_dir):
    return totals(compared(spark, *_sets(spark, sf_dir)))


@query("join_duplicate_names", "select o_orderkey as a, o_custkey as b, 'left' as c, c_custkey as d, c_name as e, c_nationkey as f from orders join customer on o_custkey = c_custkey")
def join_duplicate_names(spark, sf_dir):
    """All columns of both sides, those of one name included: named by position in the end."""
    left = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_custkey").alias("id"), F.lit("left").alias("name"))
    right = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), "c_nationkey")
    return name_columns(equi_join(left, right, ("id", "id"), keep_duplicates=True), list("abcdef"))


@query("run_new_session", "select count(*) as n_rows, 1 as n_sessions from orders join customer on o_custkey = c_custkey where year(o_orderdate) in (1996, 1997) and o_totalprice >= 75")
def run_new_session(spark, sf_dir):
    """All reports under a session id of their own; its first report is found in its folder."""
    s, out = replace(order_sources(spark, sf_dir), users=_user_rows(spark, sf_dir).select("user_id", "birthdate")), new_folder(spark, "results")
    paths = P.run_all(s, out)
    session = paths["query_1"].removeprefix(out).split("/")[1].removeprefix("session_id=")
    return sinks.read_results(spark, out, session)["query_1"].agg(F.count(F.lit(1)).alias("n_rows"), F.count_distinct(F.lit(session)).alias("n_sessions"))


def _round_trip(df: DataFrame, name: str) -> DataFrame:
    """The wide columns of a dataset, written without a header and read back."""
    path = new_folder(df.sparkSession, "sanitised")
    sources.wide(_scan(df, name), name).write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return sources.read_sanitised(df.sparkSession, path, name)


@query("sanitised_items", """select cast(l_orderkey as varchar) as transaction_id, cast(l_partkey as integer) as item_id, cast(l_quantity as integer) as quantity,
 l_extendedprice as subtotal, strftime(l_shipdate, '%Y-%m-%d %H:%M:%S') as created_at from lineitem""")  # fmt: skip
def sanitised_items(spark, sf_dir):
    back = _round_trip(_item_rows(spark, sf_dir), "transaction_items").drop("unit_price")
    return back.withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


@query("sanitised_users", """select c_custkey as user_id, strftime(date '1970-01-01' + cast(c_custkey as integer), '%Y-%m-%d') as birthdate, '2025-01-01 07:31:48' as registered_at from customer""")
def sanitised_users(spark, sf_dir):
    back = _round_trip(_user_rows(spark, sf_dir), "users")
    return back.select("user_id", F.col("birthdate").cast("string").alias("birthdate"), F.date_format("registered_at", "yyyy-MM-dd HH:mm:ss").alias("registered_at"))


@query("sanitised_stores", "select cast(s_suppkey as integer) as store_id, s_name as store_name, 'city' as city, 'state' as state from supplier")
def sanitised_stores(spark, sf_dir):
    return _round_trip(_store_rows(spark, sf_dir), "stores")


@query("sanitised_transactions", """select cast(event_id as varchar) as transaction_id, cast(user_id % 10 as integer) as store_id, user_id, value as original_amount, value as final_amount,
 strftime(ts, '%Y-%m-%d %H:%M:%S') as created_at from events""")  # fmt: skip
def sanitised_transactions(spark, sf_dir):
    path = new_folder(spark, "sanitised")
    rows = sources.read_dataset(spark, _as_csv(spark, sf_dir), "transactions")
    sources.wide(rows, "transactions").write.option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(path)
    return sources.read_sanitised(spark, path, "transactions").withColumn("created_at", F.date_format("created_at", "yyyy-MM-dd HH:mm:ss"))


_SESSIONS_SQL = """with e as (select cast(user_id % 8 as varchar) as session_id, event_type as store_id, user_id, year(ts) as y from events where user_id % 8 not in (3, 6)),
g as (select session_id, store_id, user_id, count(*) as n from e where y in (2024, 2025) group by 1, 2, 3),
r as (select *, row_number() over (partition by session_id, store_id order by n desc, user_id) as rn from g)
select session_id, store_id as store_name, c_name as birthdate from r join customer on user_id = c_custkey where rn <= 3"""


@query("stream_session_top_buyers", _SESSIONS_SQL)
def session_top_buyers(spark, sf_dir):
    """From messages to a report: eight sessions' transactions arrive in any order, those of complete sessions are
    grouped, ranked and joined, session by session. Session 3 is aborted, session 6 lacks a message."""
    out, s = new_folder(spark, "session-buyers"), event_sources(spark, sf_dir)
    session = (F.col("user_id") % 8).cast("string").alias("session_id")
    tx = as_transactions(table(spark, sf_dir, "events"))
    none, own = F.lit(None).cast("long"), tx.columns
    data = tx.select(session, none.alias("expected"), F.lit(1).cast("long").alias("n_messages"), *own)
    announced = F.when(F.col("session_id") == "3", -1).when(F.col("session_id") == "6", F.col("count") + 1).otherwise(F.col("count"))
    ends = tx.groupBy(session).count().select("session_id", announced.alias("expected"), F.lit(0).cast("long").alias("n_messages"))
    stream_completed(_hot(data.unionByName(ends, allowMissingColumns=True), 6), ["session_id"], out, f"{out}/checkpoint").awaitTermination()
    released = read_completed(spark, out, "session_id string, " + ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in tx.schema))
    return P.top_buyers(replace(s, transactions=released), session="session_id")


@query("project_identity", "select event_id, user_id, event_type, value from events")
def project_identity(spark, sf_dir):
    return map_rows(table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value"), [["identity", {}]])


@query("own_predicate_and_map", "select event_id, value * 2 as value from events where event_id % 2 = 0 and value >= 20")
def own_predicate_and_map(spark, sf_dir):
    """A predicate and a map action of a user's own beside those of the kit."""
    register_predicate("divisible", lambda col, _, by: col % by[0] == 0)
    register_map("times", lambda df, *, col, by: df.withColumn(col, F.col(col) * by))
    return select_rows(table(spark, sf_dir, "events"), [["event_id", "divisible", [2]], ["value", ">=", [20]]], [["times", {"col": "value", "by": 2}]], ["event_id", "value"])


@query("own_join", "select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey")
def own_join(spark, sf_dir):
    """A join kind of a user's own: keys that are equal as text without blanks, in any case."""
    register_join("same_text", lambda a, b: F.lower(F.trim(a)) == F.lower(F.trim(b)))
    key = lambda c, case: case(F.concat_ws("", F.lit(" n"), F.col(c).cast("string"))).alias("k")
    left = table(spark, sf_dir, "nation").select(key("n_nationkey", F.upper), "n_name")
    right = table(spark, sf_dir, "customer").select(key("c_nationkey", F.lower), "c_custkey")
    return equi_join(left, right, ("k", "k"), ["c_custkey", "n_name"], kind="same_text")


@query("text_parts", "select c_custkey, split_part(c_name, '#', 1) as a, split_part(c_name, '#', 2) as b, split_part(c_name, '#', 2) || ',' || split_part(c_name, '#', 1) as c from customer")
def text_parts(spark, sf_dir):
    """Strip, split, join."""
    parts = F.split(F.trim(F.concat(F.lit("  "), F.col("c_name"), F.lit(" "))), "#")
    return table(spark, sf_dir, "customer").select("c_custkey", parts[0].alias("a"), F.coalesce(F.get(parts, F.lit(1)), F.lit("")).alias("b")).withColumn("c", F.concat_ws(",", "b", "a"))


@query("csv_permissive", "select event_id % 10 = 3 as broken, count(*) as n from events group by 1")
def csv_permissive(spark, sf_dir):
    """Malformed rows stay, with their raw line beside them."""
    amount = F.when(F.col("event_id") % 10 == 3, "n/a").otherwise(F.col("value").cast("string"))
    rows = sources.read_dataset(spark, _as_csv(spark, sf_dir, amount), "transactions", "PERMISSIVE")
    kept = written(rows.select("transaction_id", F.col(sources.CORRUPT).alias("raw"), "final_amount"), "permissive")
    return kept.groupBy(F.col("raw").isNotNull().alias("broken")).agg(F.count(F.lit(1)).alias("n"))


@query("header_dispatch", """select 'transactions' as dataset, count(*) as n from events union all select 'menu_items', count(*) from part
 union all select 'users', count(*) from customer union all select 'stores', count(*) from supplier union all select 'transaction_items', count(*) from lineitem""")  # fmt: skip
def header_dispatch(spark, sf_dir):
    """Folders of unknown kind are read by the headers of their files."""
    made = {"menu_items": _menu_rows, "users": _user_rows, "stores": _store_rows, "transaction_items": _item_rows}
    folders = [_as_csv(spark, sf_dir), *[_csv(rows(spark, sf_dir), name) for name, rows in made.items()]]
    read = {sources.detect(spark, f): f for f in folders}
    counts = [sources.read_dataset(spark, f, n).agg(F.count(F.lit(1)).alias("n")).select(F.lit(n).alias("dataset"), "n") for n, f in read.items()]
    return tagged_union(dict(enumerate(counts))).select("dataset", "n")


@query("results_appended", f"select transaction_id, final_amount from ({Q1_SQL.replace('event_id as', 'cast(event_id as varchar) as')}) cross join (select unnest([1, 2]))")
def results_appended(spark, sf_dir):
    """A report written in two parts, and the same once more: appended rows are all there."""
    out, report = new_folder(spark, "results"), q1(spark, sf_dir)
    for part in (report.filter("final_amount < 90"), report.filter("final_amount >= 90"), report):
        path = sinks.write_result(part, out, "session", "query_1", mode="append")
    return sources.read_result(spark, path, "query_1")


@query("session_aborted", Q1_SQL.replace("event_id as", "cast(event_id as varchar) as"))
def session_aborted(spark, sf_dir):
    """Of two sessions one is aborted: its results are gone, the other's stay."""
    out = new_folder(spark, "results")
    for session in ("kept", "aborted"):
        sinks.write_result(q1(spark, sf_dir), out, session, "query_1")
    sinks.abort_session(spark, out, "aborted")
    return spark.read.schema("transaction_id string, final_amount double, session_id string, query string").csv(out).select("transaction_id", "final_amount")
