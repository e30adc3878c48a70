"""A user's own aggregates and orders, ranks of large groups, top rows in one aggregation, quarantine, comparison counts."""

import random
import sys

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from millrace import plans as P
from millrace import sources
from millrace.operators import ACCUMULATORS, ROW_ORDERS, Accumulator, accumulate, compared, least_rows, name_columns, reduce_rows, register_accumulator, register_row_order, top_rows, totals
from millrace.operators import accumulators as A
from millrace.operators.reducers import ranked_all


cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors cannot import a test


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


class Longest(Accumulator):
    """The longest text, the smallest of equals."""

    out = "string"

    def new(self):
        return None

    def add(self, state, value):
        return self.merge(state, value)

    def merge(self, state, other):
        return min((x for x in (state, other) if x is not None), key=lambda x: (-len(x), x), default=None)


class Mean(Accumulator):
    def new(self):
        return 0, 0.0

    def add(self, state, value):
        return state if value is None else (state[0] + 1, state[1] + value)

    def merge(self, state, other):
        return state[0] + other[0], state[1] + other[1]

    def result(self, state):
        return state[1] / state[0] if state[0] else None


@pytest.fixture
def own():
    register_accumulator("longest", Longest())
    register_accumulator("mean", Mean())
    register_row_order("by length", lambda row: len(row["s"] or ""))
    yield
    ACCUMULATORS.clear(), ROW_ORDERS.clear()


def data(spark, n=400):
    rng = random.Random(1)
    every = [(rng.choice(["hot", "hot", "hot", "cold", None]), k, None if k % 9 == 0 else "x" * rng.randrange(9) + str(k % 5), float(k % 7)) for k in range(n)]
    return every, spark.createDataFrame(every, "g string, id long, s string, v double").repartition(6)


@pytest.mark.parametrize("most_keys", [1, 100_000])
def test_own_aggregates(spark, own, monkeypatch, most_keys):
    monkeypatch.setattr(A, "MOST_KEYS", most_keys)
    every, df = data(spark)
    out = accumulate(df, ["g"], [["longest", "s", "long"], ["mean", "v"]], ["long", "g", "v"])
    expected = []
    for g in ("hot", "cold", None):
        of = [r for r in every if r[0] == g]
        expected.append((min((r[2] for r in of if r[2] is not None), key=lambda x: (-len(x), x)), g, pytest.approx(sum(r[3] for r in of) / len(of))))
    text = plan(out)
    assert rows(out) == sorted(expected, key=repr)
    assert text.count("MapInArrow") == 3 and "FlatMapGroups" not in text  # states, not groups, meet
    assert accumulate(df.limit(0), ["g"], [["mean", "v"]]).count() == 0
    assert rows(accumulate(df, [], [["mean", "v"]])) == [(pytest.approx(sum(r[3] for r in every) / len(every)),)]


def test_merging_reads_states_and_not_rows(spark, own):
    """Six tasks: a key's merges are at most its states, and their counts add up to its rows."""

    class Count(Accumulator):
        out = "array<long>"

        def new(self):
            return [0, 0]  # rows, merges

        def add(self, state, value):
            return [state[0] + 1, state[1]]

        def merge(self, state, other):
            return [state[0] + other[0], state[1] + other[1] + 1]

    register_accumulator("counts", Count())
    out = accumulate(data(spark, 3_000)[1], ["g"], [["counts", "v", "c"]]).collect()
    assert sum(r.c[0] for r in out) == 3_000 and max(r.c[1] for r in out) <= 5


def test_unknown_names(spark, own):
    _, df = data(spark)
    with pytest.raises(ValueError, match="unknown accumulator"):
        accumulate(df, ["g"], [["nope", "v"]])
    with pytest.raises(ValueError, match="unknown column"):
        accumulate(df, ["g"], [["mean", "nope"]])
    with pytest.raises(ValueError, match="unknown order"):
        least_rows(df, ["g"], "nope", 1)


@pytest.mark.parametrize("k", [1, 3, 1000])
def test_own_order_of_rows(spark, own, k):
    every, df = data(spark)
    found = rows(least_rows(df, ["g"], "by length", k, ["g", "id"], rank=True))
    expected = []
    for g in ("hot", "cold", None):
        of = sorted((r for r in every if r[0] == g), key=lambda r: (len(r[2] or ""), repr(sorted({"g": r[0], "id": r[1], "s": r[2], "v": r[3]}.items()))))
        expected += [(g, r[1], at + 1) for at, r in enumerate(of[:k])]
    assert found == sorted(expected, key=repr)


def test_ranks_of_a_large_group(spark):
    rng = random.Random(3)
    every = [("hot" if k % 10 else None, rng.randrange(400), k) for k in range(3_000)] + [("one", 1, -1)]
    df = spark.createDataFrame(every, "g string, v int, id int")
    out = ranked_all(df, ["g"], [F.col("v").desc(), F.col("id").asc()])
    expected = []
    for g in ("hot", None, "one"):
        of = sorted((r for r in every if r[0] == g), key=lambda r: (-r[1], r[2]))
        expected += [(*r, at + 1) for at, r in enumerate(of)]
    text = plan(out)
    assert rows(out) == sorted(expected, key=repr)
    assert text.count("Window") and all("__part" in line for line in text.splitlines() if "Window [" in line and "row_number" in line)


def test_a_large_group_is_in_many_ranges(spark):
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = ranked_all(spark.range(10_000).select(F.lit("hot").alias("g"), F.lit(1).alias("v")), ["g"], [F.col("v").asc()])  # all rows tie
        assert rows(out.select("rank")) == sorted(((k + 1,) for k in range(10_000)), key=repr)
        sizes = [r["count"] for r in spark.read.parquet(*[f for f in out.inputFiles() if "/ranked-sizes" not in f]).groupBy("__part").count().collect()]
        assert len(sizes) == 4 and max(sizes) < 5_000
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_keep_all_without_an_order(spark):
    out = reduce_rows(spark.range(50).withColumn("g", F.col("id") % 2), ["g"], "keep_all_rows", rank=True)
    assert sorted(r["rank"] for r in out.collect()) == sorted([*range(1, 26)] * 2)


def test_top_rows_in_one_aggregation(spark):
    df = spark.createDataFrame([("a", 2, 5, 1.0), ("a", 1, 5, 3.0), ("a", 3, None, 3.0), ("b", 9, None, None), ("b", 8, None, 0.5)], "m string, i int, q int, r double")
    out = top_rows(df, ["m"], {"q": "q", "r": "r"}, ["i"])
    text = plan(out)
    assert rows(out) == [("q", "a", 1, 5.0), ("r", "a", 1, 3.0), ("r", "b", 8, 0.5)]
    assert "Window" not in text and text.count("Exchange") == 1


def test_quarantine(spark, tmp_path):
    header = "user_id,gender,birthdate,registered_at\n"
    (tmp_path / "a.csv").write_text(header + "1,m,1971-03-18,2025-01-01 07:31:48\nx,m,1971-03-18,2025-01-01 07:31:48\n")
    (tmp_path / "b.csv").write_text(header + "2,m\n3,f,1971-03-19,2025-01-01 07:31:48\n")
    good, bad = sources.quarantine(spark, str(tmp_path), "users")
    assert [r.user_id for r in good.orderBy("user_id").collect()] == [1, 3] and good.columns == sources.SCHEMAS["users"].names
    assert sorted((r.file.rsplit("/", 1)[1], r.block_start, r.line) for r in bad.collect()) == [("a.csv", 0, "x,m,1971-03-18,2025-01-01 07:31:48"), ("b.csv", 0, "2,m")]
    (tmp_path / "b.csv").unlink(), (tmp_path / "a.csv").write_text(header)
    good, bad = sources.quarantine(spark, str(tmp_path), "users")
    assert good.count() == bad.count() == 0


def test_comparison_counts(spark):
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "k int, v string")
    b = spark.createDataFrame([(2, "x"), (1, None), (3, "y")], "p int, q string")
    out = compared(spark, {"p": a, "q": a, "r": a, "s": a}, {"p": a, "q": b, "s": b.select("p")})
    assert rows(out) == [("p", "matched", 3, 3, 0, 0), ("q", "different", 3, 3, 1, 1), ("r", "missing", 3, 0, 3, 0), ("s", "different", 3, 3, 3, 3)]
    assert rows(totals(out)) == [(3, 1, 2, 1, "failed")] and rows(totals(out.filter("name = 'p'"))) == [(1, 1, 0, 0, "ok")]
    assert compared(spark, {}, {}).count() == 0


def test_names_for_repeated_names(spark):
    twice = spark.range(1).select(F.lit(1).alias("a"), F.lit(2).alias("a"), F.lit(3).alias("b"))
    assert name_columns(twice, ["x", "y"]).first().asDict() == {"x": 1, "y": 2}


def test_years_of_reports_reach_the_csv_scan(spark, tmp_path):
    for name in sources.WIDE:
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(",".join(sources.SCHEMAS[name].names) + "\n")
    length = spark.conf.get("spark.sql.maxMetadataStringLength")
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    text = plan(P.transactions_filter(P.retail_sources(spark, str(tmp_path))))
    spark.conf.set("spark.sql.maxMetadataStringLength", length)
    assert "GreaterThanOrEqual(created_at,2024" in text and "LessThan(created_at,2026" in text


def test_a_run_makes_its_own_session(spark, tmp_path):
    for name in sources.WIDE:
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.csv").write_text(",".join(sources.SCHEMAS[name].names) + "\n")
    s = P.retail_sources(spark, str(tmp_path))
    sessions = [P.run_all(s, str(tmp_path / "out"))["query_1"].split("session_id=")[1].split("/")[0] for _ in range(2)]
    assert sessions[0] != sessions[1] and all(len(x) == 36 for x in sessions)


def test_folders_are_known_by_their_headers(spark, tmp_path):
    users, stores = (",".join(sources.SCHEMAS[n].names) for n in ("users", "stores"))
    (tmp_path / "a" / "sub").mkdir(parents=True), (tmp_path / "b").mkdir(), (tmp_path / "c").mkdir()
    (tmp_path / "a" / "1.csv").write_text(users + "\n1,m,1971-03-18,2025-01-01 07:31:48\n"), (tmp_path / "a" / "sub" / "2.csv").write_text(users + "\n")
    (tmp_path / "b" / "1.csv").write_text(users + "\n"), (tmp_path / "b" / "2.csv").write_text(stores + "\n")
    (tmp_path / "c" / "1.csv").write_text("user_id,gender,other\n")
    assert sources.detect(spark, str(tmp_path / "a")) == "users"
    with pytest.raises(ValueError, match="stores, users"):
        sources.detect(spark, str(tmp_path / "b"))
    with pytest.raises(ValueError, match="unknown header"):
        sources.detect(spark, str(tmp_path / "c"))
