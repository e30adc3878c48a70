"""Folders for intermediate tables that the driver and all executors can reach."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in ``spark.checkpoint.dir``. Where it is unset: a temporary folder in
    local mode (driver and executors are then one machine), ValueError on a cluster."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not sc.master.startswith("local[") and sc.master != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors can reach")
    global _local
    if _local is None:
        _local = tempfile.mkdtemp(prefix="spark-")
    return f"file://{_local}"


_local: str | None = None


def new_folder(spark: SparkSession, what: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, partition_by: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write as Parquet to the shared folder and read back."""
    path = new_folder(df.sparkSession, what)
    df.write.parquet(path, partitionBy=partition_by)
    out = df.sparkSession.read.schema(df.schema).parquet(path).select(*[f"`{c}`" for c in df.columns])  # columns of folders come last
    out._written_to = path
    return out


def remove_tables(*tables: DataFrame) -> None:
    """Delete what :func:`written` gave, once nothing will read it again."""
    for df in tables:
        remove(df.sparkSession, df._written_to)


def remove(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
