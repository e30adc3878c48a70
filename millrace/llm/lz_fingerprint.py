"""Lempel-Ziv phrase fingerprints of documents.

A text is parsed into phrases: each is the shortest stretch of code points, from the end of the one before,
that is not yet in the text's dictionary, and enters it. A phrase is known by a 64-bit hash of its code
points. The fingerprint is the minimum-hash signature of the phrase set: its ``SIZE`` smallest hashes (all of
them, if there are fewer), written as 16 hex digits each, in order. Two texts are as alike as their phrase
sets: the share of the smallest hashes of both together that both hold. Like compression, that sees what one
text could reuse of the other.

:func:`fingerprint` needs no shuffle. :func:`beside_next` compares each document with the document that
follows it by id, and with its own text after an edit that brings in the beginning of that one. For it,
texts are dealt out once, by ranges of the id whose bounds are read from the ids alone; the first document
of a range also goes to the range before (the very first one to the last range), so every document meets its
follower in one task, which reads a range as a sorted stream and holds two documents at a time. The dictionary
of a text is built once for both versions: up to the edit they are the same. The bounds, one for a range, are
all that the driver sees; there are at most ``MOST_RANGES``.

Null texts are empty texts: an empty fingerprint, which is like another empty one only. Very long texts are
parsed whole, in time linear in their length. Ties: documents of one id follow each other by a hash of their
text; those without an id come last. Rows that repeat id and text follow each other, in one task. Extra
columns don't matter. An empty table gives no row.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..scratch import remove_tables, written
from .common import map_texts, pieces, release, ship
from .order_minhash import mix

#: Hashes in a fingerprint.
SIZE = 128
#: Bytes of text in a range, and ranges at most.
RANGE_BYTES, MOST_RANGES = 24 << 20, 20_000
FACTOR, MASK = 0x9E3779B97F4A7C15, (1 << 64) - 1


def grow(seen: set[int], codes: Sequence[int], node: int) -> tuple[list[int], int]:
    """Parse on from the unfinished phrase ``node``: the phrases that enter the dictionary, and the unfinished one."""
    new = []
    for c in codes:
        key = (node * FACTOR + c + 1) & MASK
        if key in seen:
            node = key
        else:
            seen.add(key)
            new.append(key)
            node = 0
    return new, node


def codes_of(text: str) -> memoryview:
    return memoryview(text.encode("utf-32-le")).cast("I")


def least(*parts: np.ndarray) -> np.ndarray:
    """The smallest hashes of phrase sets that share none, in order."""
    every = np.concatenate(parts)
    return np.sort(every if len(every) <= SIZE else np.partition(every, SIZE)[:SIZE])


def spread(phrases: list[int]) -> np.ndarray:
    return mix(np.array(phrases, np.uint64))


def written_out(signature: np.ndarray) -> str:
    return signature.astype(">u8").tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Estimated share of common phrases; exact for texts of few phrases."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    low = np.union1d(a, b)[:SIZE]
    return float((np.isin(low, a, assume_unique=True) & np.isin(low, b, assume_unique=True)).mean())


def alike(a: Column, b: Column) -> Column:
    """:func:`likeness` of two fingerprint columns."""
    left, right = (F.regexp_extract_all(c, F.lit("[0-9a-f]{16}"), F.lit(0)) for c in (a, b))
    low = lambda x, y: F.slice(F.array_sort(F.array_union(x, y)), 1, SIZE)
    both = lambda x, y: F.size(F.array_intersect(F.array_intersect(low(x, y), x), y)) / F.size(low(x, y))
    pair = F.array(F.struct(left.alias("x"), right.alias("y")))
    return F.when((a == "") | (b == ""), (a == b).cast("double")).otherwise(F.element_at(F.transform(pair, lambda p: both(p.x, p.y)), 1))


def signature(text: str | None) -> np.ndarray:
    return least(spread(grow(set(), codes_of(text or ""), 0)[0]))


def fingerprint(docs: DataFrame, text_col: str = "text", keep: Sequence[str] | None = None) -> DataFrame:
    """Add the fingerprint of each text."""
    return map_texts(docs, lambda: lambda texts: {"fingerprint": [written_out(signature(t)) for t in texts]}, "fingerprint string", text_col, keep)


class Parsed:
    """A text whose end may be replaced: parsed once up to there, then once for each ending."""

    def __init__(self, text: str | None):
        self.text = text or ""
        codes = codes_of(self.text)
        self.cut = len(codes) - len(codes) // 4
        self.seen: set[int] = set()
        start, self.node = grow(self.seen, codes[: self.cut], 0)
        end, _ = grow(self.seen, codes[self.cut :], self.node)
        self.seen.difference_update(end)
        self.start = least(spread(start))
        self.signature = least(self.start, spread(end))

    def edited(self, after: str) -> tuple[str, np.ndarray]:
        """The text with its last quarter replaced by as much of the beginning of ``after``, and its signature."""
        end = after[: len(self.text) - self.cut]
        new, _ = grow(self.seen, codes_of(end), self.node)
        self.seen.difference_update(new)
        return self.text[: self.cut] + end, least(self.start, spread(new))


def _order(id_col: str, text_col: str) -> list[Column]:
    one = F.col(f"`{id_col}`")
    return [one.isNull().alias("none"), one.alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("hash")]


def _ranges(docs: DataFrame, id_col: str, text_col: str, range_bytes: int) -> list[tuple]:
    """The least (none, id, hash) of each range, in order; all ranges have rows."""
    size = F.coalesce(F.octet_length(F.col(f"`{text_col}`")), F.lit(0)) + 64
    keys = written(docs.select(*_order(id_col, text_col), size.alias("size")), "ids")
    total = keys.agg(F.sum("size")).first()[0] or 0
    ranges = max(1, min(MOST_RANGES, -(-total // range_bytes)))
    dealt = keys.repartitionByRange(ranges, "none", "id", "hash")
    firsts = dealt.groupBy(F.spark_partition_id()).agg(F.min(F.struct("none", "id", "hash")).alias("k")).select("k.*").collect()
    remove_tables(keys)
    return sorted({tuple(r) for r in firsts}, key=_sortable)


def _sortable(key: tuple) -> tuple:
    none, one, hashed = key
    return (none, hashed) if none else (none, one, hashed)


def _with_follower(docs: DataFrame, id_col: str, text_col: str, firsts: list[tuple]) -> DataFrame:
    """Rows (part, guest, none, id, hash, text): every document in its range, and as a guest the first
    document of the range that follows."""
    source = docs.select(*_order(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = T.StructType([T.StructField("part", T.IntegerType()), T.StructField("guest", T.BooleanType()), *source.schema.fields])
    fields, bounds = to_arrow_schema(schema), [_sortable(k) for k in firsts]

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in pieces(whole, 3):
                keys = [_sortable(k) for k in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True)]
                parts = [bisect_right(bounds, k) - 1 for k in keys]
                guests = [i for i, (k, p) in enumerate(zip(keys, parts, strict=True)) if bounds[p] == k]
                taken = batch.take(pa.array([*range(len(keys)), *guests], pa.int64()))
                part = pa.array([*parts, *((parts[i] - 1) % len(bounds) for i in guests)], pa.int32())
                guest = pa.array([False] * len(keys) + [True] * len(guests))
                columns = [c.cast(f.type) for c, f in zip(taken.columns, list(fields)[2:], strict=True)]
                yield pa.RecordBatch.from_arrays([part, guest, *columns], schema=fields)

    dealt = source.mapInArrow(route, schema).repartitionById(len(firsts), F.col("part"))  # a task for each range
    return dealt.sortWithinPartitions("part", "guest", "none", "id", "hash")


def beside_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", range_bytes: int = RANGE_BYTES) -> DataFrame:
    """For every document: id, ``n_chars``, the text after the edit, both fingerprints, and how like the
    document's fingerprint is to that of its edited text and to that of the document that follows it."""
    ship(docs.sparkSession)
    schema = T.StructType([docs.schema[id_col], *T._parse_datatype_string("n_chars long, edited string, fingerprint string, edited_fingerprint string, near_edited double, near_next double").fields])
    firsts, fields = _ranges(docs, id_col, text_col, range_bytes), to_arrow_schema(schema)
    if not firsts:
        return docs.sparkSession.createDataFrame([], schema)

    def finish(one, before: Parsed, after: Parsed) -> tuple:
        text, new = before.edited(after.text)
        old = before.signature
        return one, len(before.text), text, written_out(old), written_out(new), likeness(old, new), likeness(old, after.signature)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: tuple | None = None  # part, id, parsed text
        for whole in batches:
            for batch in pieces(whole, 5):
                rows = []
                parts, guests, ids, texts = (batch.column(i).to_pylist() for i in (0, 1, 3, 5))
                for part, guest, one, text in zip(parts, guests, ids, texts, strict=True):
                    if guest and waiting is None:  # a repeat of the guest
                        continue
                    parsed = Parsed(text)
                    if waiting is not None:
                        rows.append(finish(waiting[1], waiting[2], parsed))
                    waiting = None if guest else (part, one, parsed)
                columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)
        release()

    return _with_follower(docs.select(id_col, text_col), id_col, text_col, firsts).mapInArrow(compare, schema)


def edit_digest(compared: DataFrame) -> DataFrame:
    """The digest of the edited text in place of the text."""
    edited = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return compared.select(*[edited if c == "edited" else F.col(f"`{c}`") for c in compared.columns])
