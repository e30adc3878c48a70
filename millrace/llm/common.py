"""What the text operators share: Arrow batches in, Arrow batches out, and bounded memos."""

from __future__ import annotations

import ctypes
import gc
import os
import tempfile
import zipfile
from collections.abc import Callable, Hashable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

#: Entries that a memo of one Python worker may hold; beyond it the memo starts afresh.
MEMO_ENTRIES = 400_000
#: Bytes of text that are worked on at a time; a longer single text is taken alone.
GROUP_BYTES = 8 << 20


def ship(spark: SparkSession) -> None:
    """Send this library to the executors, once in a session, so that their Python can import it."""
    sc = spark.sparkContext
    package = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    if getattr(sc, "_millrace_sent", False) or not os.path.isdir(package):
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="spark-"), "millrace.zip")
    with zipfile.ZipFile(archive, "w") as z:
        for folder, _, names in os.walk(package):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    z.write(path, os.path.relpath(path, os.path.dirname(package)))
    sc.addPyFile(archive)
    sc._millrace_sent = True


_held: tuple[Hashable, object] | None = None


def tool(key: Hashable, make: Callable[[], object]):
    """What ``make`` builds (a tokenizer with its memo, say), kept in this Python worker from task to task
    until an operator asks for another one. So the tools of earlier stages never add up."""
    global _held
    if _held is None or _held[0] != key:
        _held = None
        release()
        _held = (key, make())
    return _held[1]


def release() -> None:
    """Give memory that is free back to the system: Spark keeps its Python workers for later stages."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        pass


class Memo(dict):
    """``memo[key]`` computes what is missing; keys of over ``longest`` characters are not remembered.
    Call :meth:`trim` now and then: it bounds the memory."""

    def __init__(self, compute: Callable, entries: int = MEMO_ENTRIES, longest: int = 64):
        super().__init__()
        self.compute, self.entries, self.longest = compute, entries, longest

    def __missing__(self, key):
        value = self.compute(key)
        if len(key) <= self.longest:
            self[key] = value
        return value

    def trim(self) -> None:
        if len(self) > self.entries:
            self.clear()


def map_texts(
    df: DataFrame, make: Callable[[], Callable[[list[str | None]], dict[str, Sequence]]], schema: str, text_col: str = "text", keep: Sequence[str] | None = None
) -> DataFrame:
    """Add the columns of ``schema``, computed from ``text_col`` batch by batch.

    ``make()`` runs once in each task and returns the function from a list of texts (None for null) to
    the new columns. ``keep`` lists the input columns that stay (default: all); where a kept column has
    the name of a new one, the new one replaces it.
    """
    ship(df.sparkSession)
    new = T._parse_datatype_string(schema)
    kept = [c for c in (df.columns if keep is None else keep) if c not in new.names]
    out_schema = T.StructType([*[df.schema[c] for c in kept], *new.fields])
    fields = to_arrow_schema(out_schema)
    # positions, since the input may repeat a name
    source = df.select(*[F.col(f"`{c}`") for c in kept], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compute = make()
        for whole in batches:
            for batch in pieces(whole, len(kept)):
                added = compute(batch.column(len(kept)).to_pylist())
                columns = [batch.column(i).cast(fields.field(i).type) for i in range(len(kept))]
                columns += [x if isinstance(x := added[f.name], pa.Array) else pa.array(x, type=fields.field(f.name).type) for f in new.fields]
                yield pa.RecordBatch.from_arrays(columns, schema=fields)
                del added, columns
        del compute
        release()

    return source.mapInArrow(run, out_schema)


def pieces(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about GROUP_BYTES of the text column each."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
    group = np.cumsum(sizes, dtype=np.int64) // GROUP_BYTES
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        yield batch.slice(lo, hi - lo)


def remainder(doc_id: str, modulus: int):
    """crc32 of the id as text, modulo: the fixed split of the held-out rows. Null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % modulus
