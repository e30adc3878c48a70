"""Headerless CSV results, one folder per session and report. Spark's commit protocol publishes a
report (``_SUCCESS``); overwriting makes a repeated completion harmless."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .plans.reports import REPORTS
from .sources import read_result


def result_path(out_dir: str, session_id: str, query: str) -> str:
    return f"{out_dir}/session_id={session_id}/query={query}"


def format_columns(df: DataFrame) -> list[Column]:
    """Values as the result files spell them: dates as yyyy-MM-dd, all else as Spark's CSV writes it."""
    return [F.date_format(f.name, "yyyy-MM-dd").alias(f.name) if isinstance(f.dataType, T.DateType) else F.col(f.name) for f in df.schema]


def write_result(df: DataFrame, out_dir: str, session_id: str, query: str, mode: str = "overwrite") -> str:
    """``mode="append"`` adds a partial result; the default replaces the report as a whole."""
    path = result_path(out_dir, session_id, query)
    df.select(*format_columns(df)).write.mode(mode).option("header", False).csv(path)
    return path


def _fs(spark: SparkSession, path: str):
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()), target


def is_ready(spark: SparkSession, out_dir: str, session_id: str, query: str) -> bool:
    fs, path = _fs(spark, f"{result_path(out_dir, session_id, query)}/_SUCCESS")
    return fs.exists(path)


def read_results(spark: SparkSession, out_dir: str, session_id: str) -> dict[str, DataFrame]:
    """All five reports in their fixed order; LookupError while one of them is not yet published."""
    waiting = [q for q in REPORTS if not is_ready(spark, out_dir, session_id, q)]
    if waiting:
        raise LookupError(f"not published yet: {', '.join(waiting)}")
    return {q: read_result(spark, result_path(out_dir, session_id, q), q) for q in REPORTS}


def abort_session(spark: SparkSession, out_dir: str, session_id: str) -> bool:
    """Remove everything a session has written."""
    fs, path = _fs(spark, f"{out_dir}/session_id={session_id}")
    return fs.delete(path, True)
