"""Joins that wait for both sides: the rows of a session are joined when as many messages of each side
have arrived as that side's end marker announced, whichever side is complete first. A negative
announcement on either side aborts the session.

Both sides are messages as in :mod:`.completion`: ``session_id string, expected long, n_messages long``
and columns of their own. End markers and messages without rows have a null join column, so they never
match.

The streaming form keeps its state in tables: the rows of each micro-batch, a row of counters for
each open session, and apart from them the ids of those that are over. A finished session is joined as one batch join on session and key, so a session of any
size is spread by its keys. Each micro-batch writes folders of its own number and reads only those of
smaller numbers, so a repeated one writes the same again.

:func:`stream_near_join` keeps its rows in tables too: those of two streams that match by key and at most some
interval apart in time.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import equi_join
from ..scratch import remove
from .published import Published

SIDES = ("left", "right")
MARKS = ("session_id", "expected", "n_messages")
COMPLETE = " and ".join(f"expected_{s} >= 0 and received_{s} >= expected_{s}" for s in SIDES)
ABORTED = "least(expected_left, expected_right) < 0"


def both_sides(left: DataFrame, right: DataFrame) -> DataFrame:
    """One stream of messages: its marks, the side, and a struct of the columns of each side."""
    own = {s: [c for c in df.columns if c not in MARKS] for s, df in zip(SIDES, (left, right), strict=True)}
    left = left.select(*MARKS, F.lit("left").alias("side"), F.struct(*own["left"]).alias("left"))
    right = right.select(*MARKS, F.lit("right").alias("side"), F.struct(*own["right"]).alias("right"))
    return left.unionByName(right, allowMissingColumns=True)


def _progress(messages: DataFrame) -> DataFrame:
    """Counters of each session and side."""
    of = lambda s, c: F.when(F.col("side") == s, F.col(c))
    received = [F.coalesce(F.sum(of(s, "n_messages")), F.lit(0)).alias(f"received_{s}") for s in SIDES]
    return messages.groupBy("session_id").agg(*received, *[F.min(of(s, "expected")).alias(f"expected_{s}") for s in SIDES])


def _matches(messages: DataFrame, done: DataFrame, on: tuple[str, str]) -> DataFrame:
    """The inner join of the finished sessions' sides; a name of both sides is the left one's."""
    rows = messages.join(done.select("session_id"), "session_id", "left_semi")
    left, right = [rows.filter(F.col("side") == s).select("session_id", f"{s}.*") for s in SIDES]
    left, right = left.filter(F.col(on[0]).isNotNull()).alias("l"), right.filter(F.col(on[1]).isNotNull()).alias("r")
    same = (F.col("l.session_id") == F.col("r.session_id")) & (F.col(f"l.{on[0]}") == F.col(f"r.{on[1]}"))
    return left.join(right, same).select("l.*", *[F.col(f"r.{c}") for c in right.columns if c not in left.columns])


def completed_join(left: DataFrame, right: DataFrame, on: tuple[str, str]) -> DataFrame:
    """Batch form: ``session_id``, the left side's columns, then the right ones whose names are new."""
    messages = both_sides(left, right)
    return _matches(messages, _progress(messages).filter(COMPLETE), on)


def stream_completed_join(left: DataFrame, right: DataFrame, on: tuple[str, str], root: str, checkpoint: str) -> StreamingQuery:
    """Streaming form, over what is there now; :func:`read_completed_join` reads what it has released.
    A session is released once; what comes after it is dropped. Rows that no open session needs are removed."""
    messages, freed = both_sides(left, right), [0]

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        table = lambda name, k: f"{root}/{name}/batch={k}"
        batch.write.mode("overwrite").parquet(table("rows", n))
        now = _progress(spark.read.schema(batch.schema).parquet(table("rows", n))).withColumns({"since": F.lit(n), "over": F.lit(None).cast("int")})
        before = now.limit(0)
        if n:  # what comes for a session that is over is dropped
            before = spark.read.schema(now.schema).parquet(table("sessions", n - 1)).filter("over is null")
            past = spark.read.schema("session_id string, batch int").parquet(f"{root}/over").filter(F.col("batch") < n)
            now = now.join(past, "session_id", "left_anti")
        sums = [F.sum(f"received_{s}").alias(f"received_{s}") for s in SIDES]
        least = [F.min(c).alias(c) for c in ("expected_left", "expected_right", "since", "over")]
        total = before.unionByName(now).groupBy("session_id").agg(*sums, *least)
        total.withColumn("over", F.coalesce("over", F.when(F.expr(f"{COMPLETE} or {ABORTED}"), n))).write.mode("overwrite").parquet(table("sessions", n))

        over = spark.read.schema(total.schema).parquet(table("sessions", n)).filter(f"over = {n}")
        over.select("session_id").write.mode("overwrite").parquet(table("over", n))
        done = over.filter(COMPLETE)
        first = done.agg(F.min("since")).first()[0]
        rows = spark.read.schema(T.StructType([*batch.schema, T.StructField("batch", T.IntegerType())])).parquet(f"{root}/rows")
        rows = rows.filter(F.col("batch").between(n if first is None else first, n)).drop("batch")
        _matches(rows, done, on).write.mode("overwrite").parquet(table("joined", n))

        # open before this micro-batch: only those sessions' rows can be read by it, or by its repetition
        needed = before.agg(F.min("since")).first()[0] if n else 0
        while freed[0] < (n if needed is None else needed):
            remove(spark, table("rows", freed[0]))
            freed[0] += 1
        if n > 1:
            remove(spark, table("sessions", n - 2))

    return messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def read_completed_join(spark, root: str) -> DataFrame:
    """What :func:`stream_completed_join` has released so far."""
    return spark.read.parquet(f"{root}/joined").drop("batch")


def stream_near_join(
    left: DataFrame, right: DataFrame, on: tuple[str, str], out: Sequence, times: tuple[str, str], apart: str, late: str, root: str, checkpoint: str,
) -> StreamingQuery:
    """Inner join of two streams by key, of rows at most ``apart`` in time, over what is there now; matches are appended
    once to the table ``root/table`` (:class:`.published.Published`), in the micro-batch of the later row.

    :func:`.reports.stream_join` gives the same from Spark's own state, of some 440 bytes a row in memory (by the default provider). Here the
    rows lie in tables, by micro-batch, and a micro-batch joins its own with those kept, as a batch join that may spill. Of the
    kept rows it reads those within ``apart`` of the times of its own. The rows that a micro-batch brought to one side are freed
    once the other side's watermark (its largest time less ``late``) has passed all that they could match; a row
    that comes later than that meets what is still kept."""
    names, parts, freed = dict(zip(SIDES, times, strict=True)), {s: df.schema for s, df in zip(SIDES, (left, right), strict=True)}, set()
    near = f"r.{times[1]} between l.{times[0]} - interval {apart} and l.{times[0]} + interval {apart}"
    streams = [df.select(F.lit(s).alias("side"), F.struct(*df.columns).alias(s)) for s, df in zip(SIDES, (left, right), strict=True)]
    span = "side string, batch int, first long, last long"

    def each(batch: DataFrame, n: int) -> None:
        spark, log = batch.sparkSession, Published(batch.sparkSession, f"{root}/table")
        if log.has(n):
            return
        kept = {}
        for s in SIDES:
            batch.filter(F.col("side") == s).select(f"{s}.*").write.mode("overwrite").parquet(f"{root}/{s}/batch={n}")
            kept[s] = spark.read.schema(T.StructType([*parts[s], T.StructField("batch", T.IntegerType())])).parquet(f"{root}/{s}").filter(F.col("batch") <= n)
        own = [kept[s].filter(F.col("batch") == n).agg(*[f(F.unix_micros(names[s])).alias(a) for f, a in ((F.min, "first"), (F.max, "last"))]) for s in SIDES]
        own = own[0].select(F.lit("left").alias("side"), F.lit(n).alias("batch"), "*").unionAll(own[1].select(F.lit("right"), F.lit(n), "*"))
        own.coalesce(1).write.mode("overwrite").parquet(f"{root}/spans/batch={n}")
        spans = spark.read.schema(span).parquet(f"{root}/spans").filter(F.col("batch") <= n)
        spans = spans.selectExpr("*", f"unix_micros(timestamp_micros(last) + interval {apart}) as until", f"unix_micros(timestamp_micros(last) - interval {late}) as mark").collect()
        now = {r.side: r for r in spans if r.batch == n}

        def reach(s: str, other: str) -> DataFrame:
            """Rows of this micro-batch, and those kept that one of the other side's in it may match."""
            mine, met = F.col("batch") == n, now[other]
            if met.last is None:
                return kept[s].filter(mine)
            day = F.expr(f"interval {apart} + interval 1 day")  # days are not all of 24 hours
            return kept[s].filter(mine | F.col(names[s]).between(F.timestamp_micros(F.lit(met.first)) - day, F.timestamp_micros(F.lit(met.last)) + day))

        log.append(n, equi_join(reach("left", "right"), reach("right", "left"), on, out, also=f"{near} and greatest(l.batch, r.batch) = {n}"))
        for s, other in (SIDES, SIDES[::-1]):
            mark = max((r.mark for r in spans if r.side == other and r.mark is not None), default=None)
            for r in spans:
                gone = r.side == s and r.batch < n and (s, r.batch) not in freed and (r.until is None or mark is not None and r.until < mark)
                if gone:
                    remove(spark, f"{root}/{s}/batch={r.batch}")
                    freed.add((s, r.batch))

    return streams[0].unionByName(streams[1], allowMissingColumns=True).writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
