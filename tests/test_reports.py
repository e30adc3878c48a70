"""Sources, sinks, the five reports on small files, streaming and the entry point."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as spark_entry
from millrace import plans as P
from millrace import queries as Q
from millrace import sinks, sources
from millrace.operators import same_rows
from millrace.streaming import completed_join, completed_rows, completion_gate, read_completed_join, stream_completed_join

HEADERS = {
    "transactions": "transaction_id,store_id,payment_method_id,voucher_id,user_id,original_amount,discount_applied,final_amount,created_at",
    "transaction_items": "transaction_id,item_id,quantity,unit_price,subtotal,created_at",
    "menu_items": "item_id,item_name,category,price,is_seasonal,available_from,available_to",
    "stores": "store_id,store_name,street,postal_code,city,state,latitude,longitude",
    "users": "user_id,gender,birthdate,registered_at",
}
LINES = {
    "transactions": [
        "t1,1,3,,10.0,80,0,80.0,2024-01-01 06:00:00", "t2,1,3,,10.0,75,0,75.0,2024-12-31 23:59:59", "t3,1,3,,11.0,74.99,0,74.99,2025-07-01 12:00:00",
        "t4,2,3,,,90,0,90.0,2025-07-01 05:59:59", "t5,2,3,,12.0,90,0,90.0,2023-05-01 12:00:00", "t6,2,3,,9.0,100,0,100.0,2025-08-01 12:00:00",
        "t7,1,3,,9.0,1,0,1.0,2024-03-01 12:00:00", "t8,1,3,,8.0,1,0,1.0,2024-03-01 12:00:00",
    ],
    "transaction_items": [
        "t1,1,2,50,100.0,2024-12-05 10:00:00", "t2,2,5,0.6,3.0,2024-12-06 10:00:00", "t3,3,1,99,99.0,2024-12-07 10:00:00",
        "t4,1,1,4,4.0,2023-12-07 10:00:00", "t5,2,1,4,4.0,2025-01-07 10:00:00", "t6,3,1,4,4.0,2025-01-07 10:00:00",
    ],
    "menu_items": ["1,Espresso,coffee,6.0,False,,", "2,Latte,coffee,8.0,False,,", "3,Mocha,coffee,9.0,True,2024-01-01,2024-02-01"],
    "stores": ['1,"G Coffee, A",Street,50998,City,State,3.1,101.6', "2,G Coffee B,Street,00123,City,State,3.1,101.6"],
    "users": ["8,male,1980-01-08,2025-01-01 07:31:48", "9,male,1980-01-09,2025-01-01 07:31:48", "10,male,1980-01-10,2025-01-01 07:31:48", "11,male,1980-01-11,2025-01-01 07:31:48", "12,male,1980-01-12,2025-01-01 07:31:48"],
}


@pytest.fixture(scope="module")
def root(tmp_path_factory):
    top = tmp_path_factory.mktemp("csv")
    for name, lines in LINES.items():
        (top / name / "sub").mkdir(parents=True)
        half = len(lines) // 2
        (top / name / "a.csv").write_text("\n".join([HEADERS[name], *lines[:half]]))  # no newline at the end
        (top / name / "sub" / "b.csv").write_text("\n".join([HEADERS[name], *lines[half:], ""]))
        (top / name / "c.csv").write_text(HEADERS[name] + "\n")
    return str(top)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_header_dispatch(spark):
    assert {sources.dataset_of(h): n for n, h in HEADERS.items()} == {n: n for n in HEADERS}
    with pytest.raises(ValueError):
        sources.dataset_of("a,b")


def test_scans(spark, root):
    tx = sources.transactions(sources.read_dataset(spark, f"{root}/transactions", "transactions"))
    assert tx.count() == 8
    assert tuple(tx.filter("transaction_id = 't2'").first()) == ("t2", 2024, 1, 10, 12, 23, 75.0)
    assert tx.filter("user_id is null").count() == 1
    stores = sources.read_dataset(spark, f"{root}/stores", "stores")
    assert stores.filter("store_id = 2").first().postal_code == "00123"
    for name, columns in sources.WIDE.items():
        assert sources.wide(sources.read_dataset(spark, f"{root}/{name}", name), name).columns == columns


def test_sanitised_copy_reads_back(spark, root, tmp_path):
    users = sources.wide(sources.read_dataset(spark, f"{root}/users", "users"), "users")
    users.write.csv(str(tmp_path / "u"))
    assert same_rows(users, sources.read_sanitised(spark, str(tmp_path / "u"), "users"))


def test_malformed_rows(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADERS["users"] + "\n1,m,1971-03-18,2025-01-01 07:31:48\nx,m,1971-03-18,2025-01-01 07:31:48\n2,m\n")
    read = lambda mode: sources.read_dataset(spark, str(tmp_path), "users", mode)
    assert [r.user_id for r in read("DROPMALFORMED").collect()] == [1]
    with pytest.raises(Exception, match="MALFORMED"):
        read("FAILFAST").collect()
    kept = read("PERMISSIVE").cache()
    assert kept.count() == 3 and kept.filter(F.col(sources.CORRUPT).isNotNull()).count() == 2
    kept.unpersist()


def test_other_header_fails(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADERS["stores"] + "\n" + LINES["stores"][0] + "\n")
    with pytest.raises(Exception, match="header"):
        sources.read_dataset(spark, str(tmp_path), "users").collect()


def test_reports(spark, root):
    s = P.retail_sources(spark, root)
    assert rows(P.transactions_filter(s)) == [("t1", 80.0), ("t2", 75.0), ("t6", 100.0)]
    assert rows(P.best_selling(s)) == [("2024-12", "Latte", 5), ("2025-01", "Latte", 1)]
    assert rows(P.most_profit(s)) == [("2024-12", 100.0, "Espresso"), ("2025-01", 4.0, "Latte")]
    assert rows(P.payment_volume(s)) == [("2024-H1", "G Coffee, A", 82.0), ("2024-H2", "G Coffee, A", 75.0), ("2025-H2", "G Coffee B", 100.0), ("2025-H2", "G Coffee, A", 74.99)]
    day = lambda d: dt.date(1980, 1, d)
    assert rows(P.top_buyers(s)) == [("G Coffee B", day(9)), ("G Coffee, A", day(10)), ("G Coffee, A", day(8)), ("G Coffee, A", day(9))]


def test_run_all_publish_append_and_abort(spark, root, tmp_path):
    s, out = P.retail_sources(spark, root), str(tmp_path)
    with pytest.raises(LookupError):
        sinks.read_results(spark, out, "s1")
    for _ in range(2):  # a second completion changes nothing
        P.run_all(s, out, "s1")
    back = sinks.read_results(spark, out, "s1")
    assert list(back) == list(P.reports.REPORTS)
    assert same_rows(back["query_1"], P.transactions_filter(s)) and same_rows(back["query_4"], P.top_buyers(s))
    assert "2024-12,Latte,5" in "".join(r.value + "\n" for r in spark.read.text(sinks.result_path(out, "s1", "query_2_best_selling")).collect())
    sinks.write_result(P.transactions_filter(s), out, "s1", "query_1", mode="append")
    assert sinks.read_results(spark, out, "s1")["query_1"].count() == 6
    assert sinks.abort_session(spark, out, "s1") and not sinks.is_ready(spark, out, "s1", "query_1")


def test_reports_per_session(spark, root):
    s = P.retail_sources(spark, root)
    both = s.transactions.withColumn("session_id", F.lit("a")).unionByName(s.transactions.withColumn("session_id", F.lit("b")))
    twice = P.Sources(both, s.items, s.menu, s.stores, s.users)
    out = P.top_buyers(twice, session="session_id")
    assert out.groupBy("session_id").count().count() == 2 and out.count() == 8


MESSAGES = [
    ("early", 2, 0, None), ("early", None, 1, "x"), ("early", None, 1, None),  # the end comes first; one batch was filtered away
    ("open", None, 1, "y"), ("open", 2, 0, None), ("gone", None, 1, "z"), ("gone", -1, 0, None), ("empty", 0, 0, None),
]
SCHEMA = "session_id string, expected long, n_messages long, payload string"


def test_completion_gate_stream_equals_batch(spark, tmp_path):
    messages = spark.createDataFrame(MESSAGES, SCHEMA)
    assert rows(completed_rows(messages)) == [("early", "x")]
    for i, m in enumerate(MESSAGES):  # one message in each file and micro-batch
        spark.createDataFrame([m], SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 3).json(str(tmp_path / "in"))
    q = completion_gate(stream).writeStream.format("memory").queryName("gate").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("gate")) == [("early", "x")]


def test_gate_frees_the_rows_it_released(spark, tmp_path):
    spark.createDataFrame(MESSAGES, SCHEMA).coalesce(1).write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    completion_gate(stream).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    state = spark.read.format("statestore").option("stateVarName", "rows").load(str(tmp_path / "c"))
    assert {r.key.session_id for r in state.collect()} == {"open"}


@pytest.mark.parametrize("groups", [None, 2])
def test_gate_of_many_sessions(spark, tmp_path, groups, monkeypatch):
    """Sessions that share groups, over three micro-batches: some are cut by HELD, ENTRY and SLICE, some get their end last, some two ends."""
    from millrace.streaming import completion

    sizes = {f"s{k}": 7 * k + 1 for k in range(12)} | {"big": 450}
    data = [(s, None, 1, f"{s}/{i}" if i % 3 else None) for s, n in sizes.items() for i in range(n)]
    ends = [(s, -1 if s == "s3" else n + (s == "s5"), 0, None) for s, n in sizes.items()] + [("s4", 10**6, 0, None), ("none", 1, 0, None), (None, 1, 0, None), (None, None, 1, "x")]
    for part in (data[::2], ends + data[1::4], data[3::4]):  # each a file and micro-batch
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    for name, n in (("PACK", 5), ("ENTRY", 20), ("HELD", 60), ("SLICE", 7)):
        monkeypatch.setattr(completion, name, n)
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).json(str(tmp_path / "in"))
    gate = completion_gate(stream, groups=groups)
    gate.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out")).awaitTermination(120)
    expected = rows(completed_rows(spark.read.schema(SCHEMA).json(str(tmp_path / "in"))))
    assert {s for s, _ in expected} == set(sizes) - {"s0", "s3", "s5"}  # s0 has one message and no rows
    assert rows(spark.read.schema("session_id string, payload string").parquet(str(tmp_path / "out"))) == expected
    state = spark.read.format("statestore").option("stateVarName", "rows").load(str(tmp_path / "c"))
    assert {r.user_map_key.session_id for r in state.collect()} == {"s5"}  # only what is open


def test_gate_packs_rows_by_session():
    import pyarrow as pa

    from millrace.streaming.completion import PACK, _fold

    n = 3 * PACK + 1
    messages = pa.table({"session_id": ["a", "b"] * n, "expected": pa.nulls(2 * n, pa.int64()), "n_messages": [1] * (2 * n), "payload": [str(i) if i % 2 or i < 4 else None for i in range(2 * n)]})
    out = pa.Table.from_batches(_fold("payload")(iter(messages.to_batches(max_chunksize=50)))).to_pylist()
    assert {r["session_id"]: r["n_messages"] for r in out if r["n_messages"]} == {"a": n, "b": n}
    packs = [(r["session_id"], len(r["payload"])) for r in out if r["payload"]]
    assert sorted(packs) == [("a", 2), ("b", 1), *[("b", PACK)] * 3]
    assert [v for r in out if r["session_id"] == "b" for v in r["payload"] or ()] == [str(i) for i in range(1, 2 * n, 2)]


LEFT = [
    ("late", None, 1, 1, "e"), ("late", 1, 0, None, None), ("both", 2, 0, None, None), ("both", None, 1, 1, "a"), ("both", None, 1, 2, "b"),  # the end comes first
    ("half", None, 1, 1, "c"), ("half", 1, 0, None, None), ("gone", None, 1, 1, "d"), ("gone", 1, 0, None, None), ("empty", 0, 0, None, None),
]
RIGHT = [
    ("late", None, 1, 1, 0.1), ("late", 1, 0, None, None), ("half", None, 1, 1, 0.2), ("gone", -1, 0, None, None), ("empty", 0, 0, None, None),
    ("both", None, 1, 1, 0.3), ("both", None, 1, 1, 0.4), ("both", None, 1, 9, 0.5), ("both", 3, 0, None, None), ("gone", None, 1, 1, 0.6), ("late", None, 1, 1, 0.7),
]
MARKS = "session_id string, expected long, n_messages long"


@pytest.mark.parametrize("at_once", [1, 4, 100])
def test_join_waits_for_both_sides(spark, tmp_path, at_once):
    schemas = f"{MARKS}, k long, name string", f"{MARKS}, k long, x double"
    sides = [spark.createDataFrame(rows, schema) for rows, schema in zip((LEFT, RIGHT), schemas, strict=True)]
    expected = [("both", 1, "a", 0.3), ("both", 1, "a", 0.4), ("late", 1, "e", 0.1)]
    assert rows(completed_join(sides[0], sides[1].limit(len(RIGHT) - 1), ("k", "k"))) == expected
    for i, part in enumerate((LEFT, RIGHT)):
        for k in range(0, len(part), at_once):  # a file and micro-batch for each slice
            spark.createDataFrame(part[k : k + at_once], schemas[i]).coalesce(1).write.mode("append").json(str(tmp_path / f"in{i}"))
    left, right = [spark.readStream.schema(s).option("maxFilesPerTrigger", 3 if at_once == 1 else 1).json(str(tmp_path / f"in{i}")) for i, s in enumerate(schemas)]
    stream_completed_join(left, right, ("k", "k"), str(tmp_path / "state"), str(tmp_path / "c")).awaitTermination(300)
    released = rows(read_completed_join(spark, str(tmp_path / "state")))
    if at_once == 1:  # what comes after a session's release, in a later micro-batch, is dropped
        assert released == expected
    else:
        assert [r for r in released if r[-1] != 0.7] == expected
    assert len(list((tmp_path / "state" / "sessions").iterdir())) <= 2


@pytest.mark.parametrize("twin,batch", [("stream_completion_gate", "completion_gate"), ("stream_join_completed", "join_completed"), ("stream_transactions_scan", "csv_transactions_scan")])
def test_stateful_streams_equal_batch(spark, twin, batch):
    sf = "/root/testdata/sf0.001"
    assert same_rows(Q.QUERIES[batch](spark, sf), Q.QUERIES[twin](spark, sf))


@pytest.mark.parametrize("twin,batch", [("stream_q1", "q1_transactions_filter"), ("stream_q4", "q4_top3")])
def test_streams_equal_batch(spark, twin, batch):
    sf = "/root/testdata/sf0.001"
    assert same_rows(Q.QUERIES[batch](spark, sf), Q.QUERIES[twin](spark, sf))


def test_entry(spark):
    assert spark_entry.entry(spark).columns == ["year_month", "item_name", "sellings_qty"]
    every, sql = spark_entry.queries(), spark_entry.oracle_sql()
    assert set(sql) <= set(every) and set(Q.SQL) == set(Q.QUERIES)
