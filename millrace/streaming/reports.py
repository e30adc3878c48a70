"""Reports over increments. A filter or map is stateless. A top-k over running counts keeps the counts in
state, spread by their whole key, and lists of k rows a group in a table. Several reports of one stream
share each micro-batch."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..operators import equi_join, group_by, reduce_rows, select_rows
from ..scratch import remove
from .published import Published, run_through

#: Aggregates that never fall as rows come, and reducers that keep the largest: only for these a list of k
#: rows a group is all that has to be remembered.
RISING = ("count", "max")
LARGEST = ("keep_top_row", "keep_top_k", "keep_asc_desc")


def stream_filter(stream: DataFrame, path: str, checkpoint: str, filters: Sequence = (), maps: Sequence = (), out: Sequence[str] | None = None) -> StreamingQuery:
    """Filter, map and project a stream into Parquet, over what is there now."""
    rows = select_rows(stream, filters, maps, out)
    return rows.writeStream.format("parquet").option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start(path)


def stream_join(
    left: DataFrame, right: DataFrame, on: tuple[str, str], out: Sequence | None = None, times: tuple[str, str] | None = None,
    apart: str = "1 day", late: str = "0 seconds",
) -> DataFrame:
    """Inner join of two streams, or of a stream with a table, in append mode: a match is given once, as soon
    as both of its rows have come, whichever is first. Spark keeps the rows of both streams in state, spread
    by the key.

    Without ``times`` rows stay in state for ever. With the time columns of both sides, only rows at most
    ``apart`` in time match, and a row is freed once the other side's watermark (its largest time less
    ``late``) has passed all rows that it could match; a row that comes later than that is dropped. Watermarks
    begin at 1970, so earlier times are late from the start."""
    if times is None:
        return equi_join(left, right, on, out)
    near = f"r.{times[1]} between l.{times[0]} - interval {apart} and l.{times[0]} + interval {apart}"
    return equi_join(left.withWatermark(times[0], late), right.withWatermark(times[1], late), on, out, also=near)


def stream_top_k(
    stream: DataFrame, root: str, checkpoint: str, keys: Sequence[str], agg: Sequence[str], top_keys: Sequence[str], reducer: str, params: dict,
) -> StreamingQuery:
    """The largest rows of each group by a running aggregate, over what is there now.

    Only keys whose aggregate has changed reach a micro-batch; their k largest of each group, found in
    each task first, are ranked together with the group's list so far. What a group's rows beyond its list
    would say is not needed: without a change they don't overtake, and no member of the list falls. So a
    micro-batch never handles more than its own keys and k rows a group, and publishes the lists that it
    has changed. ``agg`` must be one of ``RISING`` and ``reducer`` of ``LARGEST``."""
    op, value = agg[0], agg[-1]
    if op not in RISING or reducer not in LARGEST or params.get("comp_key") != value:
        raise ValueError(f"lists are kept for the largest by {' or '.join(RISING)} only")
    grouped = group_by(stream, keys, [agg])
    schema = grouped.schema
    best = lambda df: reduce_rows(df, top_keys, reducer, params)

    def each(batch: DataFrame, n: int) -> None:
        spark = batch.sparkSession
        log, table = Published(spark, f"{root}/changes"), lambda k: f"{root}/lists/batch={k}"
        if log.has(n):
            return run_through(batch)
        before = spark.read.schema(schema).parquet(table(n - 1)) if n else spark.createDataFrame([], schema)
        merged = before.unionByName(best(batch)).groupBy(*keys).agg(F.max(value).alias(value)).select(*schema.names)
        best(merged).write.mode("overwrite").parquet(table(n))
        after = spark.read.schema(schema).parquet(table(n))
        changed = after.exceptAll(before).unionAll(before.exceptAll(after)).select(*top_keys).distinct()
        log.append(n, after.join(changed, list(top_keys), "left_semi").select(*schema.names))
        if n > 1:
            remove(spark, table(n - 2))

    return grouped.writeStream.outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def read_top_k(spark: SparkSession, root: str, schema: str | T.StructType) -> DataFrame:
    """The lists as of the last micro-batch: the columns of the key and the aggregate."""
    last = Published(spark, f"{root}/changes").batches()[-1:]
    return spark.read.schema(schema).parquet(f"{root}/lists/batch={last[0]}") if last else spark.createDataFrame([], schema)


def stream_fan_out(stream: DataFrame, branches: dict[str, Callable[[DataFrame], DataFrame]], root: str, checkpoint: str) -> StreamingQuery:
    """One stream feeds several tables, over what is there now. Each micro-batch is read once and kept while
    its branches are written; every table publishes on its own, so after a failure only those that lack
    the micro-batch write it. A branch is a report's part: rows, or sums and counts of the micro-batch that
    :func:`read_fan_out` leaves to be added up."""

    def each(batch: DataFrame, n: int) -> None:
        logs = {name: Published(batch.sparkSession, f"{root}/{name}") for name in branches}
        waiting = [name for name, log in logs.items() if not log.has(n)]
        if not waiting:
            return run_through(batch)
        batch.persist(StorageLevel.MEMORY_AND_DISK)
        try:
            for name in waiting:
                logs[name].append(n, branches[name](batch))
        finally:
            batch.unpersist()

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()


def read_fan_out(spark: SparkSession, root: str, name: str, schema: str | T.StructType) -> DataFrame:
    """What one branch has published."""
    return Published(spark, f"{root}/{name}").read(schema)
