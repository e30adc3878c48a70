"""Tables that a stream appends to exactly once.

A micro-batch writes a folder of its own number and is published by a mark in the manifest: an empty file
of that number, whose creation is atomic. A micro-batch that is repeated after a failure finds its mark and
adds nothing; one that failed before its mark writes its folder anew. Readers take the folders that the
manifest names, so they never see a part of a micro-batch. Many small micro-batches can be merged into one
folder, again by one mark. A table belongs to one stream and its checkpoint.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..scratch import remove

MANIFEST, BATCH = "_manifest", "batch"


Span = tuple[int, int]


class Published:
    def __init__(self, spark: SparkSession, root: str, fmt: str = "parquet"):
        self.spark, self.root, self.fmt = spark, root.rstrip("/"), fmt

    def _at(self, *parts: str):
        path = self.spark._jvm.org.apache.hadoop.fs.Path("/".join((self.root, *parts)))
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    @staticmethod
    def _name(span: Span) -> str:
        return str(span[0]) if span[0] == span[1] else f"{span[0]}-{span[1]}"

    def folder(self, n: int | Span) -> str:
        return f"{self.root}/{BATCH}={self._name((n, n) if isinstance(n, int) else n)}"

    def _marks(self) -> list[Span]:
        """All marks, (first, last micro-batch), in order; of those that begin together the widest first."""
        fs, marks = self._at(MANIFEST)
        names = [s.getPath().getName() for s in fs.listStatus(marks)] if fs.exists(marks) else []
        spans = [tuple(map(int, n.split("-"))) for n in names if n[0] != "."]
        return sorted(((s[0], s[-1]) for s in spans), key=lambda s: (s[0], -s[1]))

    def spans(self) -> list[Span]:
        """The marks that count: those inside of a wider one say nothing more."""
        out: list[Span] = []
        for span in self._marks():
            if not out or span[1] > out[-1][1]:
                out.append(span)
        return out

    def has(self, n: int) -> bool:
        fs, mark = self._at(MANIFEST, str(n))
        return fs.exists(mark) or any(a <= n <= b for a, b in self.spans())

    def batches(self) -> list[int]:
        """Numbers of the published micro-batches, in order."""
        return [n for a, b in self.spans() for n in range(a, b + 1)]

    def _publish(self, span: Span, rows: DataFrame, partition_by: Sequence[str]) -> bool:
        rows.write.mode("overwrite").format(self.fmt).partitionBy(*partition_by).save(self.folder(span))
        fs, mark = self._at(MANIFEST, self._name(span))
        return bool(fs.createNewFile(mark))

    def append(self, n: int, rows: DataFrame, partition_by: Sequence[str] = ()) -> bool:
        """Write and publish the rows of micro-batch ``n``; False if it was published before."""
        return not self.has(n) and self._publish((n, n), rows, partition_by)

    def read(self, schema: T.StructType | str, batches: Sequence[int] | None = None) -> DataFrame:
        """Rows of the published micro-batches (or of these among them; ValueError if one of them was merged with others)."""
        nothing = self.spark.createDataFrame([], schema)
        wanted = [s for s in self.spans() if batches is None or any(s[0] <= n <= s[1] for n in batches)]
        if batches is not None and not {n for a, b in wanted for n in range(a, b + 1)} <= set(batches):
            raise ValueError("some of these micro-batches were merged with others")
        if not wanted:
            return nothing
        # columns of folders come last, so the order is the schema's
        read = self.spark.read.schema(schema).option("basePath", self.root).format(self.fmt)
        return read.load([self.folder(s) for s in wanted]).select(*nothing.columns)

    def compact(self, schema: T.StructType | str, files: int = 1, partition_by: Sequence[str] = ()) -> list[Span]:
        """Merge neighbouring micro-batches, of which a stream makes many small ones, into one folder of ``files`` files
        (for each folder of ``partition_by``). The one mark of the merged folder takes the place of theirs at once, so
        readers see each row once at any time. Gives what was merged; :meth:`vacuum` removes what it was made of."""
        runs: list[list[Span]] = []
        for span in self.spans():
            if runs and span[0] == runs[-1][-1][1] + 1:
                runs[-1].append(span)
            else:
                runs.append([span])
        merged = [(run[0][0], run[-1][1]) for run in runs if len(run) > 1]
        for a, b in merged:
            self._publish((a, b), self.read(schema, range(a, b + 1)).coalesce(files), partition_by)
        return merged

    def vacuum(self) -> list[Span]:
        """Remove the marks and folders that a merged one has replaced. Not while a reader that began before is at work."""
        counting = set(self.spans())
        gone = [s for s in self._marks() if s not in counting]
        for span in gone:
            fs, mark = self._at(MANIFEST, self._name(span))
            fs.delete(mark, False)
            remove(self.spark, self.folder(span))
        return gone


def run_through(batch: DataFrame) -> None:
    """Compute a micro-batch whose rows are not wanted: a stream with state must commit it again."""
    batch.write.format("noop").mode("overwrite").save()


def append_stream(stream: DataFrame, root: str, checkpoint: str, partition_by: Sequence[str] = (), fmt: str = "parquet") -> StreamingQuery:
    """Append what is there now to the table at ``root``."""

    def each(batch: DataFrame, n: int) -> None:
        if not Published(batch.sparkSession, root, fmt).append(n, batch, partition_by):
            run_through(batch)

    return stream.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(each).start()
