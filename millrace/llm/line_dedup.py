"""Line dedup over levelled sorted runs of line hashes, with DataFrame operations only.

A run is a table of line hashes, bucketed and sorted by hash, with the number of documents that hold the
line and the largest id among them. Documents come in batches by a hash of their id, so a document is
in one batch only. A batch is reduced to a row for each line, in the same buckets, and merge-anti-joined
with the runs that are there, bucket by bucket and without a shuffle: what is new becomes the batch's
own run of level 0, what is there already is set aside with its counts. When a level is full, its runs
are merged into one of the next level, again bucket by bucket for two runs; a third one meets their joined
rows, which Spark deals out anew. In the end the few runs left and the
lines set aside give the counts of every line in the corpus.

The number of buckets follows from the number of lines, so a bucket stays of one size however large the
corpus is. It is a multiple of the shuffle partitions: rows dealt by their hash to that many tasks hold
whole buckets in each, so a run is written without another shuffle and each bucket by one task.

A line's key is the line without blanks ``[ \\t-\\r]`` at both ends and with A-Z in lower case; it is
known by two 64-bit hashes with different seeds. Keys of at least ``min_chars`` code points that
``min_docs`` documents or more hold lose all their lines, except in the document of largest id.

Null or empty text is one empty line and stays. Very long texts and lines are taken whole; the work on a
text is linear in its lines. Rows that repeat an id count as one document, each row keeps its own text.
Rows without an id hold no line that counts, and keep all their lines. Extra columns stay, but those
named like a count are replaced; names that begin with ``__line`` are taken.
"""

from __future__ import annotations

import itertools
import math
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import new_folder, remove

MIN_CHARS, MIN_DOCS = 40, 5
#: Documents in a batch, and batches at least.
BATCH_DOCS, LEAST_BATCHES = 50_000_000, 4
#: Lines in a bucket over all runs, about; 16 bytes of hashes and some counts each, read as a sorted stream.
BUCKET_LINES = 20_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def hashes(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit("line"), key).alias("h2"))


def long_keys(text: Column, min_chars: int) -> Column:
    """Hashes and places of a text's lines whose keys are long enough."""
    placed = F.transform(lines_of(text), lambda x, i: F.struct(line_key(x).alias("key"), i.alias("at")))
    return F.transform(F.filter(placed, lambda p: F.char_length(p.key) >= min_chars), lambda p: F.struct(hashes(p.key).alias("h"), p.at.alias("at")))


def bucket_count(spark: SparkSession, n_lines: int, bucket_lines: int = BUCKET_LINES) -> int:
    """The least multiple of the shuffle partitions that keeps buckets to ``bucket_lines``, within Spark's
    limit of buckets (beyond it buckets are larger, with the same result)."""
    tasks, most = (int(spark.conf.get(f"spark.sql.{name}")) for name in ("shuffle.partitions", "sources.bucketing.maxBuckets"))
    return tasks * max(1, min(math.ceil(n_lines / (tasks * bucket_lines)), most // tasks))


class LineRuns:
    """Levels of sorted runs in a shared folder. ``fanout`` runs of a level make one of the next.

    Runs hold different lines: a batch is merge-anti-joined with all runs, and only what is new makes
    its own run. What the runs already hold is set aside as recurrences, with its counts."""

    def __init__(self, spark: SparkSession, fanout: int = 3, n_lines: int = 0, bucket_lines: int = BUCKET_LINES):
        """``n_lines``: lines that will be added in all, about."""
        self.spark, self.fanout = spark, fanout
        self.buckets = bucket_count(spark, n_lines, bucket_lines)
        self.folder, self.name = new_folder(spark, "line-runs"), f"line_runs_{uuid.uuid4().hex}"
        self.levels: list[list[str]] = []
        self.again: list[list[str]] = []  # levels of recurrences
        self.made: list[str] = []

    def _write(self, run: DataFrame) -> str:
        """A sorted run; ``run`` is dealt by (h1, h2) already, so each bucket is written by one task."""
        name = f"{self.name}_{len(self.made)}"
        self.made.append(name)
        run.write.format("parquet").bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{self.folder}/{name}").saveAsTable(name)
        return name

    def _remove(self, name: str) -> None:
        self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, f"{self.folder}/{name}")

    def add(self, batch: DataFrame) -> None:
        """Add a batch (h1, h2, n_docs, max_doc; each line once), then compact full levels."""
        there = [name for level in self.levels for name in level]
        name = self._write(batch)
        if there:
            whole = self.spark.table(name)
            new = self._write(reduce(lambda rows, run: rows.join(self.spark.table(run).select("h1", "h2"), ["h1", "h2"], "left_anti"), there, whole))
            self._push(self.again, self._write(whole.join(self.spark.table(new).select("h1", "h2"), ["h1", "h2"], "left_anti")))
            self._remove(name)
            name = new
        self._push(self.levels, name)

    def _push(self, levels: list[list[str]], name: str) -> None:
        for level in itertools.count():
            if len(levels) <= level:
                levels.append([])
            levels[level].append(name)
            if len(levels[level]) < self.fanout:
                return
            runs, levels[level] = levels[level], []
            name = self._write(self._merged(runs))
            for run in runs:
                self._remove(run)

    def _merged(self, names: list[str]) -> DataFrame:
        """Runs in one, by full joins of their buckets; the counts of a line are added up."""

        def two(left: DataFrame, right: DataFrame) -> DataFrame:
            n = F.coalesce(left["n_docs"], F.lit(0)) + F.coalesce(right["n_docs"], F.lit(0))
            return left.join(right, ["h1", "h2"], "full").select("h1", "h2", n.alias("n_docs"), F.greatest(left["max_doc"], right["max_doc"]).alias("max_doc"))

        return reduce(two, map(self.spark.table, names))

    def counted(self) -> DataFrame:
        """Every line once, with its documents over all batches."""
        return self._merged([name for level in [*self.levels, *self.again] for name in level])

    def drop(self) -> None:
        for name in self.made:
            self.spark.sql(f"drop table if exists {name}")
        remove(self.spark, self.folder)


def batch_run(lines: DataFrame) -> DataFrame:
    """(doc, h1, h2) to a run. Rows that repeat an id count once; the second step adds up in each task
    before its shuffle, so a line that a third of all documents hold is no hot key."""
    once = lines.select("h1", "h2", "doc").distinct()
    return once.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc").alias("max_doc"))


def lost_lines(docs: DataFrame, id_col: str, text_col: str, min_chars: int, min_docs: int, batches: int, fanout: int, bucket_lines: int = BUCKET_LINES) -> DataFrame:
    """Per document and text that loses lines: (doc, text_hash, lost), the places of those lines."""
    spark, id_type = docs.sparkSession, docs.schema[id_col].dataType.simpleString()
    text = F.col(f"`{text_col}`")
    held = docs.select(F.col(f"`{id_col}`").alias("doc"), F.xxhash64(text).alias("text_hash"), F.explode(long_keys(text, min_chars)).alias("k"))
    batch = F.pmod(F.xxhash64("doc"), F.lit(batches)).cast("int").alias("batch")
    path = new_folder(spark, "lines")
    held.select("doc", "text_hash", "k.at", "k.h.h1", "k.h.h2", batch).write.partitionBy("batch").parquet(path)
    lines = spark.read.schema(f"doc {id_type}, text_hash long, at int, h1 long, h2 long, batch int").parquet(path)
    runs = LineRuns(spark, fanout, lines.count(), bucket_lines)  # the count comes from the files' footers
    for k in range(batches):
        runs.add(batch_run(lines.filter(F.col("batch") == k)))
    found = new_folder(spark, "common-lines")
    runs.counted().filter(F.col("n_docs") >= min_docs).select("h1", "h2", "max_doc").write.parquet(found)
    runs.drop()
    common = spark.read.schema(f"h1 long, h2 long, max_doc {id_type}").parquet(found)
    dropped = lines.join(common, ["h1", "h2"]).filter(F.col("doc") < F.col("max_doc"))
    return dropped.groupBy("doc", "text_hash").agg(F.collect_set("at").alias("lost"))


def dedup_lines(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS,
    batches: int | None = None, fanout: int = 3, n_lines: str = "n_lines", n_dropped: str = "n_dropped", bucket_lines: int = BUCKET_LINES,
) -> DataFrame:
    """The documents with their common lines removed from ``text_col``, and two counts per document.

    ``batches`` (by default as many as ``BATCH_DOCS`` asks for) bounds what one batch sorts at a time,
    ``bucket_lines`` what a bucket of all runs holds."""
    source = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c not in (n_lines, n_dropped)])
    known, unknown = source.filter(F.col(f"`{id_col}`").isNotNull()), source.filter(F.col(f"`{id_col}`").isNull())
    if batches is None:
        batches = max(LEAST_BATCHES, math.ceil(known.count() / BATCH_DOCS))
    lost = lost_lines(known.select(id_col, text_col), id_col, text_col, min_chars, min_docs, batches, fanout, bucket_lines)
    lost = lost.select(F.col("doc").alias("__line_doc"), F.col("text_hash").alias("__line_text"), F.col("lost").alias("__line_lost"))
    text = F.col(f"`{text_col}`")
    joined = known.join(lost, (F.col(f"`{id_col}`") == F.col("__line_doc")) & (F.xxhash64(text) == F.col("__line_text")), "left")
    # the lines are a column of their own, used more than once, so that Spark splits a text once and not for each line
    joined = joined.withColumn("__line_lines", lines_of(text))
    lines, lost_here = F.col("__line_lines"), F.col("__line_lost")
    # places that stay, by a hash set: linear in the lines
    stay = F.array_except(F.sequence(F.lit(0), F.size(lines) - 1), lost_here)
    kept = F.when(lost_here.isNull(), text).otherwise(F.array_join(F.transform(stay, lambda i: F.get(lines, i)), "\n"))
    dropped = F.coalesce(F.when(lost_here.isNotNull(), F.size(lost_here)), F.lit(0)).cast("long")
    counts = lambda all_lines, lost: [F.size(all_lines).cast("long").alias(n_lines), lost.alias(n_dropped)]
    out = joined.select(*[kept.alias(c) if c == text_col else F.col(f"`{c}`") for c in source.columns], *counts(lines, dropped))
    # rows without an id lose nothing and never meet
    return out.unionAll(unknown.select(*[F.col(f"`{c}`") for c in source.columns], *counts(lines_of(text), F.lit(0).cast("long"))))
