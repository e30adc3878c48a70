"""Exactly-once tables, the ledger of messages, incremental top-k, one stream for several reports, joins of streams."""

import glob
import os
import random

import pytest
from pyspark.sql import functions as F

from millrace import queries as Q
from millrace import sources
from millrace.operators import group_by, reduce_rows, same_rows
from millrace.streaming import (
    Published, append_stream, completed_keys, completed_rows, read_completed, read_fan_out, read_session, read_top_k, ready_sessions, stream_completed, stream_fan_out, stream_join, stream_near_join, stream_results, stream_top_k,
)
from millrace.streaming.ledger import Ledger

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def increments(spark, path, parts, schema):
    """A stream of one file, and micro-batch, for each part."""
    for part in parts:
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").json(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(path)


def replay(root, query="c"):
    """Forget that the last micro-batch was committed."""
    commits = sorted((p for p in glob.glob(f"{root}/{query}/commits/*") if os.path.basename(p).isdigit()), key=lambda p: int(os.path.basename(p)))
    os.remove(commits[-1])
    os.remove(os.path.join(os.path.dirname(commits[-1]), f".{os.path.basename(commits[-1])}.crc"))


def test_published_table(spark, tmp_path):
    log = Published(spark, str(tmp_path / "t"))
    assert log.batches() == [] and log.read("a int").count() == 0
    one, two = (spark.createDataFrame([(i, "x,y\n")], "a int, b string") for i in (1, 2))
    assert log.append(0, one) and not log.append(0, two) and log.append(3, two)
    two.write.parquet(log.folder(4))  # begun, never published
    assert rows(log.read(one.schema)) == [(1, "x,y\n"), (2, "x,y\n")] and log.batches() == [0, 3] and rows(log.read("a int", [3])) == [(2,)]
    assert log.append(4, one) and log.read("a int").count() == 3  # the folder is written anew
    text = Published(spark, str(tmp_path / "csv"), "csv")
    text.append(0, one.withColumn("session_id", F.lit("s")), ["session_id"])
    assert os.path.isdir(tmp_path / "csv" / "batch=0" / "session_id=s") and rows(text.read("a int, session_id string")) == [(1, "s")]


def test_micro_batches_are_merged_by_one_mark(spark, tmp_path, monkeypatch):
    log, frame = Published(spark, str(tmp_path / "t")), lambda k: spark.createDataFrame([(k, f"g{k % 2}")], "a int, g string")
    for n in (0, 1, 2, 5, 7, 8):
        log.append(n, frame(n), ["g"])
    every, see = [(n, f"g{n % 2}") for n in (0, 1, 2, 5, 7, 8)], lambda: rows(log.read("a int, g string"))
    create = Published._publish
    monkeypatch.setattr(Published, "_publish", lambda self, span, df, by: df.write.parquet(self.folder(span)) or (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        log.compact("a int, g string")
    assert see() == every and log.vacuum() == []  # the merged folder was not published
    monkeypatch.setattr(Published, "_publish", create)
    assert log.compact("a int, g string", partition_by=["g"]) == [(0, 2), (7, 8)] and log.spans() == [(0, 2), (5, 5), (7, 8)]
    assert see() == every and log.batches() == [0, 1, 2, 5, 7, 8]
    assert log.vacuum() == [(0, 0), (1, 1), (2, 2), (7, 7), (8, 8)] and see() == every
    assert not os.path.exists(log.folder(1)) and not log.append(1, frame(99)) and log.append(6, frame(6), ["g"])  # merged ones are known
    assert rows(log.read("a int", [5, 6])) == [(5,), (6,)]
    with pytest.raises(ValueError, match="merged"):
        log.read("a int", [1])
    assert log.compact("a int, g string", partition_by=["g"]) == [(5, 8)] and log.spans() == [(0, 2), (5, 8)]
    log.vacuum()
    assert see() == sorted([*every, (6, "g0")], key=repr)


def test_a_repeated_micro_batch_adds_nothing(spark, tmp_path):
    stream = increments(spark, str(tmp_path / "in"), [[(k,)] for k in range(4)], "k long")
    for _ in range(2):
        append_stream(stream, str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination(120)
        assert rows(Published(spark, str(tmp_path / "t")).read("k long")) == [(k,) for k in range(4)]
        replay(tmp_path)


KEYS = ["session_id", "query"]
MESSAGES = "session_id string, query string, expected long, n_messages long, line string"


def partial_results():
    out = []
    for s in ("a", "b", "c"):
        for q in ("query_1", "query_3"):
            out += [(s, q, None, 1, f"{s}{q}{k}") for k in range(5)] + [(s, q, None, 1, None)]  # one message without rows
            if (s, q) != ("b", "query_3"):
                out.append((s, q, -1 if s == "c" else 6, 0, None))
    return [*out, ("d", "query_1", 0, 0, None)]


@pytest.mark.parametrize("seed,size", [(1, 1), (2, 7), (3, 100)])
def test_reports_are_published_when_all_parts_are_there(spark, tmp_path, seed, size):
    messages = partial_results()
    random.Random(seed).shuffle(messages)
    messages = messages if size > 1 else messages[-12:] + messages[:-12]
    parts = [messages[k : k + size] for k in range(0, len(messages), size)] if size > 1 else [[m] for m in messages[:14]] + [messages[14:]]
    stream = increments(spark, str(tmp_path / "in"), parts, MESSAGES)
    root = str(tmp_path / "out")
    stream_completed(stream, KEYS, root, str(tmp_path / "c"), shards=3, partition_by=KEYS).awaitTermination(300)
    expected = sorted((s, q, f"{s}{q}{k}") for s, q in (("a", "query_1"), ("a", "query_3"), ("b", "query_1")) for k in range(5))
    released = lambda: read_completed(spark, root, "session_id string, query string, line string")
    assert rows(released()) == expected
    keys = completed_keys(spark, root, "session_id string, query string")
    assert rows(keys) == [("a", "query_1"), ("a", "query_3"), ("b", "query_1"), ("d", "query_1")]  # the last one without a row
    assert rows(ready_sessions(keys, ["query_1", "query_3"])) == [("a",)] and rows(ready_sessions(keys, ["query_1"])) == [("a",), ("b",), ("d",)]
    replay(tmp_path)
    stream_completed(stream, KEYS, root, str(tmp_path / "c"), shards=3, partition_by=KEYS).awaitTermination(300)
    assert rows(released()) == expected
    assert len(glob.glob(f"{root}/counts/batch=*")) <= 2


def test_a_session_is_read_when_its_five_reports_are_complete(spark, tmp_path):
    lines = {
        "query_1": ["t1,80.5"], "query_2_best_selling": ['2024-12,"Latte, large",5', "2025-01,Mocha,1"], "query_2_most_profits": ["2024-12,99.25,Mocha"],
        "query_3": [], "query_4": ["G Coffee,1980-01-08"],
    }
    schema, root = "session_id string, query string, expected long, n_messages long, lines array<string>", str(tmp_path / "out")
    data = [(s, q, None, 1, [x]) for s in ("a", "b") for q, own in lines.items() for x in own]
    ends = [(s, q, len(own), 0, None) for s in ("a", "b") for q, own in lines.items() if (s, q) != ("b", "query_3")]
    stream = increments(spark, str(tmp_path / "in"), [ends[:6] + data[:3], data[3:] + ends[6:]], schema)
    stream_results(stream, root, str(tmp_path / "c")).awaitTermination(300)
    back = read_session(spark, root, "a")
    assert {q: len(rows(df)) for q, df in back.items()} == {q: len(own) for q, own in lines.items()} and list(back) == list(lines)
    assert rows(back["query_2_best_selling"]) == [("2024-12", "Latte, large", 5), ("2025-01", "Mocha", 1)]
    assert rows(back["query_1"]) == [("t1", 80.5)] and str(back["query_4"].first().birthdate) == "1980-01-08"
    for session, missing in (("b", "query_3"), ("nobody", "query_1, query_2")):
        with pytest.raises(LookupError, match=missing):
            read_session(spark, root, session)


def test_a_step_that_failed_before_it_published_is_done_again(spark, tmp_path, monkeypatch):
    parts = [[("a", "q", None, 1, "x")], [("a", "q", 2, 0, None)], [("a", "q", None, 1, "y")], [("a", "q", None, 1, "late")]]
    frames = [spark.createDataFrame(p, MESSAGES) for p in parts]
    ledger, append = Ledger(str(tmp_path), KEYS), Published.append
    for n, frame in enumerate(frames):
        monkeypatch.setattr(Published, "append", lambda *a, **k: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ledger.step(frame, n)
        monkeypatch.setattr(Published, "append", append)
        for _ in range(2):
            ledger.step(frame, n)
    assert rows(read_completed(spark, str(tmp_path), "session_id string, query string, line string")) == [("a", "q", "x"), ("a", "q", "y")]
    assert {os.path.basename(p) for p in glob.glob(f"{tmp_path}/rows/batch=*")} <= {"batch=3"}  # rows of what is over are gone


def test_a_large_session_is_released_by_its_shards(spark, tmp_path):
    schema, n, shards = "session_id string, expected long, n_messages long, payload string", 2_000, 8
    large = [("large", None, 1, f"row {k}") for k in range(n)]
    messages = [("large", n, 0, None), *large, *[(f"s{k}", None, 1, "x") for k in range(40)], *[(f"s{k}", 1 + k % 2, 0, None) for k in range(40)]]
    stream = increments(spark, str(tmp_path / "in"), [messages[:700], messages[700:1_500], messages[1_500:]], schema)
    root = str(tmp_path / "out")
    stream_completed(stream, ["session_id"], root, str(tmp_path / "c"), shards).awaitTermination(300)
    released = read_completed(spark, root, "session_id string, payload string")
    assert rows(released) == rows(completed_rows(spark.createDataFrame(messages, schema)))
    files = released.filter("session_id = 'large'").groupBy(F.input_file_name()).count().collect()  # a file for each task
    assert len(files) == shards and max(r["count"] for r in files) < 1.25 * n / shards


def test_lists_follow_the_counts(spark, tmp_path):
    rng = random.Random(7)
    parts = [[(rng.choice("abc"), rng.randrange(9)) for _ in range(rng.randrange(1, 30))] for _ in range(6)] + [[("d", 1)]]
    stream = increments(spark, str(tmp_path / "in"), parts, "store string, user long")
    top, root = {"comp_key": "n", "comp_key2": "user", "limit": 2}, str(tmp_path / "out")
    run = lambda: stream_top_k(stream, root, str(tmp_path / "c"), ["store", "user"], ["count", "n"], ["store"], "keep_asc_desc", top).awaitTermination(300)
    run()
    every = spark.createDataFrame([r for p in parts for r in p], "store string, user long")
    expected = rows(reduce_rows(group_by(every, ["store", "user"], [["count", "n"]]), ["store"], "keep_asc_desc", top))
    schema = "store string, user long, n long"
    assert rows(read_top_k(spark, root, schema)) == expected
    last = Published(spark, f"{root}/changes").batches()[-1]
    said = Published(spark, f"{root}/changes")
    assert all(said.read(schema, [k]).count() <= 8 for k in said.batches())
    ones = [k for k in said.batches() if rows(said.read("store string", [k]).distinct()) == [("d",)]]
    assert len(ones) == 1  # the micro-batch that changed this store only
    replay(tmp_path)
    run()
    assert rows(read_top_k(spark, root, schema)) == expected and said.batches()[-1] == last


def test_lists_are_for_rising_aggregates(spark, tmp_path):
    stream = increments(spark, str(tmp_path / "in"), [[("a", 1.0)]], "g string, v double")
    for agg, reducer, key in ((["sum", "v", "n"], "keep_top_k", "n"), (["count", "n"], "keep_least_k", "n"), (["count", "n"], "keep_top_k", "g")):
        with pytest.raises(ValueError, match="largest"):
            stream_top_k(stream, "x", "y", ["g"], agg, ["g"], reducer, {"comp_key": key, "limit": 1})


def test_one_stream_feeds_several_tables(spark, tmp_path):
    stream = increments(spark, str(tmp_path / "in"), [[(k, k % 3)] for k in range(9)], "k long, g long")
    failing = {"on": True}

    def sums(df):
        if failing["on"] and df.filter("k = 5 or k = 8").count():
            raise RuntimeError("lost")
        return group_by(df, ["g"], [["count", "n"]])

    branches, root = {"all": lambda d: d.select("k"), "sums": sums}, str(tmp_path / "out")
    run = lambda: stream_fan_out(stream, branches, root, str(tmp_path / "c"))
    with pytest.raises(Exception, match="lost"):
        run().awaitTermination(120)
    done = read_fan_out(spark, root, "all", "k long").count()
    assert done == read_fan_out(spark, root, "sums", "g long, n long").count() + 1  # one table has the micro-batch, the other lacks it
    failing["on"] = False
    q = run()
    q.awaitTermination(120)
    assert rows(read_fan_out(spark, root, "all", "k long")) == [(k,) for k in range(9)]
    assert rows(read_fan_out(spark, root, "sums", "g long, n long").groupBy("g").agg(F.sum("n"))) == [(0, 3), (1, 3), (2, 3)]
    assert sum(p["numInputRows"] for p in q.recentProgress) <= 9  # each row is read once, for both


def test_joined_streams_free_their_rows(spark, tmp_path):
    at = lambda d: F.timestamp_seconds(86_400 * (d + 10_000))
    days = range(0, 60, 10)
    for k in days:
        side = spark.range(k, k + 10).select("id", at(F.col("id")).alias("t"))
        side.coalesce(1).write.mode("append").parquet(str(tmp_path / "l"))
        side.select("id", (F.col("t") + F.expr("interval 1 day")).alias("u"), (F.col("id") * 2).alias("x")).coalesce(1).write.mode("append").parquet(str(tmp_path / "r"))
    stream = lambda name, schema: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / name))
    left, right = stream("l", "id long, t timestamp"), stream("r", "id long, u timestamp, x long")

    def run(name, **times):
        joined = stream_join(left, right, ("id", "id"), ["id", "x"], **times)
        q = append_stream(joined, str(tmp_path / name), str(tmp_path / f"{name}-c"))
        q.awaitTermination(300)
        held = [p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress if p["stateOperators"]]
        return rows(Published(spark, str(tmp_path / name)).read("id long, x long")), held[-1]

    expected = [(k, 2 * k) for k in range(60)]
    kept, freed = run("kept"), run("freed", times=("t", "u"), apart="2 days", late="1 day")
    assert kept[0] == sorted(expected, key=repr) == freed[0]
    assert kept[1] == 120 and freed[1] < 60


@pytest.mark.parametrize("apart,late", [("2 days", "1 day"), ("2 days", "3650 days")])
def test_near_join_keeps_and_frees_tables(spark, tmp_path, apart, late):
    """No row is in the state of Spark; what can match nothing any more is freed, and nothing that can."""
    at = lambda d: F.timestamp_seconds(86_400 * (d + 10_000))
    order = range(0, 60, 10) if late == "1 day" else (30, 0, 50, 20, 10, 40)  # in time, or in any order
    write = lambda df, name: df.coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    for k in order:
        side = spark.range(k, k + 10).select("id", at(F.col("id")).alias("t"))
        write(side.unionAll(spark.sql(f"select null, timestamp_seconds(864000000 + {k})")).unionAll(spark.sql(f"select {k}L, null")), "l")
        # a day later, so the last one of a file meets the next; three days later; a day later in another file
        for days, x in ((1, 2), (3, 3)):
            write(side.select("id", (F.col("t") + F.expr(f"interval {days} day")).alias("u"), (F.col("id") * x).alias("x")), "r")
    schemas = {"l": "id long, t timestamp", "r": "id long, u timestamp, x long"}
    stream = lambda name, n: spark.readStream.schema(schemas[name]).option("maxFilesPerTrigger", n).parquet(str(tmp_path / name))
    root = str(tmp_path / "out")
    run = lambda: stream_near_join(stream("l", 1), stream("r", 2), ("id", "id"), ["id", "x"], ("t", "u"), apart, late, root, str(tmp_path / "c"))
    q = run()
    q.awaitTermination(300)
    assert not any(p["stateOperators"] for p in q.recentProgress)
    read = lambda: rows(Published(spark, f"{root}/table").read("id long, x long"))
    expected = sorted([(k, 2 * k) for k in range(60)], key=repr)
    assert read() == expected
    assert len(list((tmp_path / "out" / "left").glob("batch=*"))) == (6 if late == "3650 days" else 1)
    assert len(list((tmp_path / "out" / "right").glob("batch=*"))) <= (6 if late == "3650 days" else 2)
    last = Published(spark, f"{root}/table").batches()[-1]
    (tmp_path / "c" / "commits" / str(last)).unlink()  # the last micro-batch runs again
    (tmp_path / "c" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    run().awaitTermination(300)
    assert read() == expected
    write(spark.range(59, 60).select("id", at(F.col("id") - 1).alias("t")), "l")  # one side only: meets what is kept
    run().awaitTermination(300)
    assert read() == sorted([*expected, (59, 118)], key=repr)


def test_two_sided_join_needs_no_state(spark, monkeypatch):
    from pyspark.sql.streaming.readwriter import DataStreamWriter

    started, start = [], DataStreamWriter.start
    monkeypatch.setattr(DataStreamWriter, "start", lambda self, *a, **k: started.append(start(self, *a, **k)) or started[-1])
    out = Q.QUERIES["stream_join_two_sided"](spark, SF)
    assert len(started) == 1 and len(started[0].recentProgress) > 1 and not any(p["stateOperators"] for p in started[0].recentProgress)
    orders, lines = [spark.read.parquet(f"{SF}/{t}.parquet") for t in ("orders", "lineitem")]
    near = F.expr("o_orderkey = l_orderkey and l_shipdate between o_orderdate - interval 130 days and o_orderdate + interval 130 days")
    assert same_rows(orders.join(lines, near).select(*out.columns), out)


def test_increments_by_bytes(spark, tmp_path):
    header = "user_id,gender,birthdate,registered_at\n"
    (tmp_path / "in").mkdir()
    for k in range(6):
        (tmp_path / "in" / f"{k}.csv").write_text(header + f"{k},m,1971-03-18,2025-01-01 07:31:48\n" * 10)
    size = (tmp_path / "in" / "0.csv").stat().st_size
    for limit, batches in ((2 * size, 3), (1, 6), (100 * size, 1)):
        stream = sources.stream_dataset(spark, str(tmp_path / "in"), "users", bytes_per_trigger=limit)
        q = append_stream(stream, str(tmp_path / f"t{limit}"), str(tmp_path / f"c{limit}"))
        q.awaitTermination(120)
        sizes = [p["numInputRows"] for p in q.recentProgress if p["numInputRows"]]
        assert len(sizes) == batches and all(n % 10 == 0 for n in sizes)
        assert Published(spark, str(tmp_path / f"t{limit}")).read("user_id long").count() == 60


@pytest.mark.parametrize("twin,batch", [("stream_split_gate", "completion_gate"), ("stream_append_replayed", "q1_transactions_filter"), ("stream_fanout_q1_q3_q4", "fanout_q1_q3_q4"), ("stream_by_bytes", "csv_transactions_scan")])
def test_streams_equal_batch(spark, twin, batch):
    assert same_rows(Q.QUERIES[batch](spark, SF), Q.QUERIES[twin](spark, SF))
