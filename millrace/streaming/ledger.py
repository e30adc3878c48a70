"""Rows that wait until all messages of their key have come: partial results of a session's reports, or
the rows of a session.

Messages have the columns of the key, ``expected long, n_messages long`` and columns of their own. A
message with rows has ``expected`` null and ``n_messages`` its weight; one whose own columns are all null
only counts. An end marker announces in ``expected`` how many messages its key has, and may come first; a
negative number aborts the key. A key is released once; what comes after that is dropped. Messages with a
null in their key are never released.

State is two-level and kept in tables. The rows of each micro-batch are spread over shards by a hash of
their content; only counts, added up in each task first, meet in their key. When a key's counts are
complete, its release is sent to each of its shards, so a key of any size is released by as many tasks as
it has shards, and none of them sees more than its share (equal rows are of one shard). Shards of one key
are never in one task.

Each micro-batch writes folders of its own number and reads only those of smaller numbers; what it releases
is published by :class:`.published.Published`. So a repeated micro-batch gives the same, and nothing twice.
Of keys that are over, only the key is kept, in the folder of the micro-batch that ended them.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..plans.reports import REPORTS
from ..scratch import remove
from ..sources import RESULT_SCHEMAS
from .published import Published, run_through

MARKS = ("expected", "n_messages")
SHARDS = 16
COMPLETE, ABORTED = "expected >= 0 and received >= expected", "expected < 0"


class Ledger:
    def __init__(self, root: str, keys: Sequence[str], shards: int = SHARDS, partition_by: Sequence[str] = ()):
        self.root, self.keys, self.shards, self.partition_by = root.rstrip("/"), list(keys), shards, partition_by
        self.freed = 0

    def _own(self, columns: Sequence[str]) -> list[str]:
        return [c for c in columns if c not in (*self.keys, *MARKS)]

    def _table(self, name: str, n: int) -> str:
        return f"{self.root}/{name}/batch={n}"

    def step(self, batch: DataFrame, n: int) -> None:
        spark, keys, own = batch.sparkSession, self.keys, self._own(batch.columns)
        released, finished = (Published(spark, f"{self.root}/{name}") for name in ("released", "keys"))
        if finished.has(n):
            return run_through(batch)
        shard = F.pmod(F.xxhash64(*own), F.lit(self.shards)).cast("int").alias("shard")
        batch.select("*", shard).write.mode("overwrite").parquet(self._table("rows", n))
        kept = T.StructType([*batch.schema, T.StructField("shard", T.IntegerType())])
        now = spark.read.schema(kept).parquet(self._table("rows", n)).groupBy(*keys).agg(F.coalesce(F.sum("n_messages"), F.lit(0)).alias("received"), F.min("expected").alias("expected"), F.lit(n).alias("since"))
        counts, key = now.schema, T.StructType([now.schema[k] for k in keys])
        if n:
            past = spark.read.schema(T.StructType([*key, T.StructField("batch", T.IntegerType())])).parquet(f"{self.root}/over").filter(F.col("batch") < n)
            same = reduce(lambda a, b: a & b, [now[k].eqNullSafe(past[k]) for k in keys])
            before = spark.read.schema(counts).parquet(self._table("counts", n - 1)).filter(f"not ({COMPLETE} or {ABORTED}) or expected is null")
            now = before.unionByName(now.join(past, same, "left_anti"))
        total = now.groupBy(*keys).agg(F.sum("received").alias("received"), F.min("expected").alias("expected"), F.min("since").alias("since"))
        total.write.mode("overwrite").parquet(self._table("counts", n))
        total = spark.read.schema(counts).parquet(self._table("counts", n))
        total.filter(f"{COMPLETE} or {ABORTED}").select(*keys).write.mode("overwrite").parquet(self._table("over", n))
        done = total.filter(COMPLETE)
        if not released.has(n):
            released.append(n, self._released(spark, kept, done, n), self.partition_by)
        finished.append(n, done.select(*keys))  # last, so that the rows of a key that is told of are there
        self._free(spark, total, n)

    def _released(self, spark: SparkSession, schema: T.StructType, done: DataFrame, n: int) -> DataFrame:
        keys, own = self.keys, self._own([c for c in schema.names if c != "shard"])
        first = done.agg(F.min("since")).first()[0]
        rows = spark.read.schema(T.StructType([*schema, T.StructField("batch", T.IntegerType())])).parquet(f"{self.root}/rows")
        filled = reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in own])
        rows = rows.filter(F.col("batch").between(n if first is None else first, n) & filled)
        told = done.select(*keys, F.explode(F.sequence(F.lit(0), F.lit(self.shards - 1))).alias("shard"))
        parts = max(self.shards, int(spark.conf.get("spark.sql.shuffle.partitions")))
        place = F.pmod(F.pmod(F.xxhash64(*keys), F.lit(parts)) + F.col("shard"), F.lit(parts)).cast("int")
        return rows.join(told, [*keys, "shard"]).repartitionById(parts, place).select(*keys, *own)

    def _free(self, spark: SparkSession, total: DataFrame, n: int) -> None:
        """Remove what no later micro-batch reads: rows older than every open key, and old counts."""
        oldest = total.filter(f"not ({COMPLETE} or {ABORTED}) or expected is null").agg(F.min("since")).first()[0]
        needed = n if oldest is None else min(n, oldest)  # micro-batch n may be read by its own repetition
        while self.freed < needed:
            remove(spark, self._table("rows", self.freed))
            self.freed += 1
        if n > 1:
            remove(spark, self._table("counts", n - 2))


def stream_completed(messages: DataFrame, keys: Sequence[str], root: str, checkpoint: str, shards: int = SHARDS, partition_by: Sequence[str] = ()) -> StreamingQuery:
    """Over what is there now: release the rows of each key when its messages are complete."""
    ledger = Ledger(root, keys, shards, partition_by)
    return messages.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(ledger.step).start()


def read_completed(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """What was released so far: the columns of the key and the messages' own."""
    return Published(spark, f"{root.rstrip('/')}/released").read(schema)


def completed_keys(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """The keys that were released so far, those without any row included."""
    return Published(spark, f"{root.rstrip('/')}/keys").read(schema)


def ready_sessions(keys: DataFrame, reports: Sequence[str], session: str = "session_id", query: str = "query") -> DataFrame:
    """Sessions all of whose reports are among the completed keys."""
    return keys.filter(F.col(query).isin(*reports)).groupBy(session).agg(F.count_distinct(query).alias("n")).filter(F.col("n") == len(set(reports))).select(session)


#: The key of a partial result, and its own column: lines as the result files have them.
RESULT_KEYS, RESULT_LINES = ("session_id", "query"), "lines array<string>"


def stream_results(messages: DataFrame, root: str, checkpoint: str, shards: int = SHARDS) -> StreamingQuery:
    """Collect the partial results of sessions' reports, over what is there now. Messages hold ``lines``, and an end
    marker for each session and report tells how many messages it has."""
    return stream_completed(messages, RESULT_KEYS, root, checkpoint, shards, RESULT_KEYS)


def read_session(spark: SparkSession, root: str, session_id: str) -> dict[str, DataFrame]:
    """All five reports of a session in their fixed order, typed; LookupError while one of them is not complete."""
    keys = "session_id string, query string"
    done = {r[0] for r in completed_keys(spark, root, keys).filter(F.col("session_id") == session_id).select("query").collect()}
    waiting = [q for q in REPORTS if q not in done]
    if waiting:
        raise LookupError(f"not complete yet: {', '.join(waiting)}")
    lines = read_completed(spark, root, f"{keys}, {RESULT_LINES}").filter(F.col("session_id") == session_id)
    schema = lambda q: ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in RESULT_SCHEMAS[q])
    parsed = lambda q: lines.filter(F.col("query") == q).select(F.explode("lines").alias("line")).select(F.from_csv("line", schema(q)).alias("r")).select("r.*")
    return {q: parsed(q) for q in REPORTS}
