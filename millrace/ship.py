"""Sends the library to the executors, so that Python functions can import it there."""

from __future__ import annotations

import os
import tempfile
import zipfile

from pyspark.sql import SparkSession


def ship(spark: SparkSession) -> None:
    """Once in a session; needless where the library is installed, and harmless there."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.abspath(__file__))
    if getattr(sc, "_millrace_sent", False) or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in (n for n in names if n.endswith(".py")):
                path = os.path.join(folder, name)
                z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._millrace_sent = True
