"""Order-insensitive comparison of result sets by whole-row occurrence counts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def multiset_diff(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Rows whose number of occurrences differs, with both counts. One aggregation, nulls equal nulls."""
    if expected.columns != actual.columns:
        raise ValueError(f"columns differ: {expected.columns} and {actual.columns}")
    sides = expected.withColumns({"_e": F.lit(1), "_a": F.lit(0)}).unionAll(actual.withColumns({"_e": F.lit(0), "_a": F.lit(1)}))
    counted = sides.groupBy(*expected.columns).agg(F.sum("_e").alias("n_expected"), F.sum("_a").alias("n_actual"))
    return counted.filter(F.col("n_expected") != F.col("n_actual"))


def same_rows(expected: DataFrame, actual: DataFrame) -> bool:
    """Compared by position: result files have no header."""
    return len(expected.columns) == len(actual.columns) and multiset_diff(expected, actual.toDF(*expected.columns)).isEmpty()


def summary(spark: SparkSession, expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """One row per result set: matched, different, or missing."""
    return compared(spark, expected, actual).select("name", "status")


def compared(spark: SparkSession, expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """One row per result set: its status (matched, different, or missing), the rows of both sides, and how many
    rows of each the other one lacks. Each pair is compared in one aggregation; columns by position. Sets
    of different numbers of columns have no row in common."""
    parts = [_counted(name, frame, actual.get(name)) for name, frame in expected.items()]
    return reduce(lambda a, b: a.unionAll(b), parts) if parts else spark.createDataFrame([], COMPARED)


COMPARED = "name string, status string, n_expected long, n_actual long, n_lost long, n_added long"


def _counted(name: str, expected: DataFrame, actual: DataFrame | None) -> DataFrame:
    same = actual is not None and len(expected.columns) == len(actual.columns)
    one, none = F.lit(1), F.lit(0)
    if same:
        names = [f"c{i}" for i in range(len(expected.columns))]
        sides = expected.toDF(*names).select("*", one.alias("_e"), none.alias("_a")).unionAll(actual.toDF(*names).select("*", none, one)).groupBy(*names).agg(F.sum("_e").alias("e"), F.sum("_a").alias("a"))
    else:
        sides = expected.select(one.alias("e"), none.alias("a"))
        if actual is not None:
            sides = sides.unionAll(actual.select(none, one))
    total = lambda c: F.coalesce(F.sum(c), none).cast("long")
    lost, added = (F.greatest(F.col(x) - F.col(y), none) for x, y in (("e", "a"), ("a", "e")))
    told = sides.agg(total(F.col("e")).alias("n_expected"), total(F.col("a")).alias("n_actual"), total(lost).alias("n_lost"), total(added).alias("n_added"))
    status = F.lit("missing") if actual is None else F.when(F.lit(same) & (F.col("n_lost") + F.col("n_added") == 0), "matched").otherwise("different")
    return told.select(F.lit(name).alias("name"), status.alias("status"), "n_expected", "n_actual", "n_lost", "n_added")


def totals(sets: DataFrame) -> DataFrame:
    """The outcome of :func:`compared` in one row: sets compared, matched, different and missing, and whether all matched."""
    of = lambda s: F.count(F.when(F.col("status") == s, 1))
    told = sets.agg(F.count(F.when(F.col("status") != "missing", 1)).alias("n_compared"), of("matched").alias("n_matched"), of("different").alias("n_different"), of("missing").alias("n_missing"))
    return told.withColumn("status", F.when(F.col("n_different") + F.col("n_missing") == 0, "ok").otherwise("failed"))
