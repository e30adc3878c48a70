"""A user's own aggregates and row reducers, in Python, without bringing a group together.

An :class:`Accumulator` says how a state begins, takes a value, takes another state and gives its result.
Each task folds its rows into one state for each key and sends the states on (a task with very many keys
sends them in parts); states of a key are merged in ``FAN`` tasks first, then in one. So a key that a third of
all rows have costs one state a task. Merging reads states sorted by key, one key at a time.

``merge`` must not care about order, as the order of rows is not known. A row reducer is such an
accumulator, whose state is a bounded list of rows. A null is a key like any other.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator, Sequence
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..ship import ship
from .maps import project
from .reducers import RANK

#: Keys that a task folds before it sends their states on, states in a batch, and tasks that merge a key's states first.
MOST_KEYS, STATES, FAN = 100_000, 10_000, 32


class Accumulator:
    """A user's aggregate; ``out`` is the type of its result."""

    out = "double"

    def new(self):
        raise NotImplementedError

    def add(self, state, value):
        """The state with one more value (null is None)."""
        raise NotImplementedError

    def merge(self, state, other):
        raise NotImplementedError

    def result(self, state):
        return state


ACCUMULATORS: dict[str, Accumulator] = {}
ROW_ORDERS: dict[str, Callable[[dict], object]] = {}


def register_accumulator(name: str, accumulator: Accumulator) -> None:
    ACCUMULATORS[name] = accumulator


def register_row_order(name: str, order: Callable[[dict], object]) -> None:
    """An order of rows for :func:`least_rows`: from a row (a dict) to something that compares."""
    ROW_ORDERS[name] = order


class LeastRows(Accumulator):
    """The k least rows by a user's order, in order; equal ones by their values as text."""

    def __init__(self, order: Callable[[dict], object], k: int, row: T.StructType):
        self.order, self.k, self.out = order, k, T.ArrayType(row)

    def _cut(self, state: list) -> list:
        return sorted(state, key=lambda r: (r[0], r[1]))[: self.k]

    def new(self) -> list:
        return []

    def add(self, state: list, value: dict) -> list:
        state.append((self.order(value), repr(sorted(value.items())), value))
        return state if len(state) < 2 * self.k + 16 else self._cut(state)

    def merge(self, state: list, other: list) -> list:
        return self._cut(state + other)

    def result(self, state: list) -> list[dict]:
        return [value for _, _, value in self._cut(state)]


def _folded(df: DataFrame, keys: Sequence[str], columns: Sequence[str], accumulators: list[Accumulator]) -> DataFrame:
    """(keys, results) by partial states, merged in two steps."""
    ship(df.sparkSession)
    key_fields = [T.StructField(f"k{i}", df.schema[k].dataType) for i, k in enumerate(keys)]
    names = [f.name for f in key_fields]
    states = T.StructType([*key_fields, T.StructField("salt", T.IntegerType()), T.StructField("state", T.BinaryType())])
    results = T.StructType([*key_fields, *[T.StructField(f"r{i}", T._parse_datatype_string(a.out) if isinstance(a.out, str) else a.out) for i, a in enumerate(accumulators)]])
    state_fields, result_fields, n = to_arrow_schema(states), to_arrow_schema(results), len(keys)

    def batch(rows: list[tuple], fields: pa.Schema) -> pa.RecordBatch:
        columns = zip(*rows, strict=True) if rows else [[]] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, fields, strict=True)], schema=fields)

    def sent(rows: Iterator[tuple], fields: pa.Schema) -> Iterator[pa.RecordBatch]:
        part: list[tuple] = []
        for row in rows:
            part.append(row)
            if len(part) == STATES:
                yield batch(part, fields)
                part = []
        yield batch(part, fields)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            yield from sent(((*key, 0, pickle.dumps(state)) for key, state in held.items()), state_fields)
            held.clear()

        for b in batches:
            lists = [b.column(i).to_pylist() for i in range(b.num_columns)]
            for row in zip(*lists, strict=True):
                state = held.get(row[:n])
                if state is None:
                    state = held[row[:n]] = [a.new() for a in accumulators]
                for i, a in enumerate(accumulators):
                    state[i] = a.add(state[i], row[n + i])
            if len(held) > MOST_KEYS:
                yield from flush()
        yield from flush()

    def merge(batches: Iterator[pa.RecordBatch], last: bool) -> Iterator[pa.RecordBatch]:
        rows = (row for b in batches for row in zip(*[b.column(i).to_pylist() for i in range(b.num_columns)], strict=True))

        def merged() -> Iterator[tuple]:
            for key, same in groupby(rows, key=lambda row: row[:n]):
                total = None
                for row in same:
                    state = pickle.loads(row[-1])
                    total = state if total is None else [a.merge(x, y) for a, x, y in zip(accumulators, total, state, strict=True)]
                yield (*key, *[a.result(s) for a, s in zip(accumulators, total, strict=True)]) if last else (*key, 0, pickle.dumps(total))

        yield from sent(merged(), result_fields if last else state_fields)

    source = df.select(*[F.col(f"`{k}`").alias(m) for k, m in zip(keys, names, strict=True)], *columns)
    # a task's states of a key share a salt, another task's have another one
    partial = source.mapInArrow(fold, states).withColumn("salt", F.pmod(F.spark_partition_id(), F.lit(FAN)))
    some = partial.repartition(*names, "salt").sortWithinPartitions(*names, "salt").mapInArrow(lambda b: merge(b, False), states)
    whole = some.repartition(*names) if names else some.coalesce(1)
    out = whole.sortWithinPartitions(*names).mapInArrow(lambda b: merge(b, True), results) if names else whole.mapInArrow(lambda b: merge(b, True), results)
    return out.toDF(*keys, *[f"r{i}" for i in range(len(accumulators))])


def accumulate(df: DataFrame, keys: Sequence[str], aggs: Sequence[Sequence[str]], out: Sequence[str] | None = None) -> DataFrame:
    """One row per key, by registered accumulators: ``[name, in_col, out_col]``, as in ``group_by``."""
    for name, col, *_ in aggs:
        if name not in ACCUMULATORS:
            raise ValueError(f"unknown accumulator {name!r}; known: {', '.join(sorted(ACCUMULATORS))}")
        if col not in df.columns:
            raise ValueError(f"unknown column {col!r}")
    columns = [F.col(f"`{col}`").alias(f"v{i}") for i, (_, col, *_) in enumerate(aggs)]
    folded = _folded(df, keys, columns, [ACCUMULATORS[name] for name, *_ in aggs])
    return project(folded.toDF(*keys, *[a[-1] for a in aggs]), out)


def least_rows(df: DataFrame, keys: Sequence[str], order: str, limit: int, out: Sequence[str] | None = None, rank: bool = False) -> DataFrame:
    """The ``limit`` least rows of each group by a registered order; ``rank`` adds the position."""
    if order not in ROW_ORDERS:
        raise ValueError(f"unknown order {order!r}; known: {', '.join(sorted(ROW_ORDERS))}")
    kept = LeastRows(ROW_ORDERS[order], limit, df.schema)
    rows = _folded(df, keys, [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")], [kept]).select(F.posexplode("r0").alias("at", "row"))
    cols = list(out) if out is not None else df.columns
    return rows.select(*[F.col(f"row.`{c}`") for c in cols], *([(F.col("at") + 1).alias(RANK)] if rank else []))
