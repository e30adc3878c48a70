"""Completion by count: a session's rows are released when as many messages have arrived as its end
marker announced. The end marker may come first; nothing is ever late. A negative announcement
aborts the session: its rows are dropped and none is released. Of a session that was released or aborted
only a mark is kept, so that what comes after it is dropped.

Messages have the columns ``session_id string, expected long, n_messages long`` and one payload
column. A data message has ``expected`` null and ``n_messages`` its weight (a batch that was filtered
away still counts: its payload is null). An end marker has ``expected`` set and weight 0.

The streaming form keeps state, so the session needs the RocksDB state store provider
(``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


#: Rows that are released at a time.
SLICE = 10_000
#: Rows that a group holds before they go into state.
HELD = 50_000
#: Rows of a session in one message between tasks, and in one entry of the state.
PACK, ENTRY = 100, 1_000
#: Messages of a task that are folded together.
PIECE = 100_000
#: In place of the number expected, once a session is over.
OVER = -(2**62)


def _packs(rows: pa.Table, payload: str) -> tuple[pa.Array, pa.Array]:
    """The payloads by session, in lists of at most PACK, and the session of each list."""
    sessions = rows["session_id"].combine_chunks().dictionary_encode()
    code = sessions.indices.to_numpy()
    order = np.argsort(code, kind="stable")
    code, at = code[order], np.arange(len(order))
    first = np.maximum.accumulate(np.where(np.r_[True, code[1:] != code[:-1]][: len(code)], at, 0))
    starts = np.flatnonzero((at - first) % PACK == 0)
    offsets = pa.array(np.r_[starts, len(order)], pa.int32())
    return sessions.dictionary.take(pa.array(code[starts])), pa.ListArray.from_arrays(offsets, rows[payload].combine_chunks().take(pa.array(order)))


def _fold(payload: str) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The messages of a piece by session, so that few of a session meet: its counts, and its payloads in packs."""

    def folded(piece: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, t = ["session_id", "expected", "n_messages", payload], pa.Table.from_batches(piece)
        counts = t.group_by("session_id").aggregate([("expected", "min"), ("n_messages", "sum")])
        of = pa.list_(t.schema.field(payload).type)
        yield from pa.table([counts["session_id"], counts["expected_min"], counts["n_messages_sum"], pa.nulls(len(counts), of)], names).to_batches()
        rows = t.filter(t[payload].is_valid())
        if len(rows):
            sessions, packs = _packs(rows, payload)
            none = pa.nulls(len(sessions), pa.int64())
            yield from pa.table([sessions, none, none, packs.cast(of)], names).to_batches()

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        piece: list[pa.RecordBatch] = []
        for batch in batches:
            piece.append(batch)
            if sum(b.num_rows for b in piece) >= PIECE:
                yield from folded(piece)
                piece = []
        if piece:
            yield from folded(piece)

    return fold


class _Gate(StatefulProcessor):
    """A group holds one session or several; state is by session."""

    def __init__(self, payload: str, ttl_ms: int | None):
        self.payload, self.ttl_ms = payload, ttl_ms
        self.slice, self.held, self.entry = SLICE, HELD, ENTRY

    def init(self, handle: StatefulProcessorHandle) -> None:
        session = "session_id string"
        self.progress = handle.getMapState("progress", session, "received long, expected long, entries long", ttlDurationMs=self.ttl_ms)
        self.rows = handle.getMapState("rows", f"{session}, entry long", f"{self.payload} array<string>", ttlDurationMs=self.ttl_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        now: dict[str, list] = {}  # received, expected and entries of the sessions that have messages in this micro-batch
        held: dict[str, list[str]] = defaultdict(list)
        n_held = 0
        for pdf in rows:
            for session, expected, n, payloads in zip(*[pdf[c].tolist() for c in ("session_id", "expected", "n_messages", self.payload)], strict=True):
                state = now.get(session)
                if state is None:
                    state = now[session] = list(self.progress.getValue((session,)) or (0, None, 0))
                if state[1] == OVER:
                    continue
                if not pd.isna(n):
                    state[0] += int(n)
                if not pd.isna(expected):
                    state[1] = int(expected) if state[1] is None else min(state[1], int(expected))
                if payloads is not None:
                    held[session].extend(payloads)
                    n_held += len(payloads)
            if n_held >= self.held:
                for session, part in held.items():
                    self._store(session, now[session], part)
                held.clear()
                n_held = 0
        out: list[tuple[str, str]] = []
        for session, state in now.items():
            received, expected, entries = state
            if expected == OVER:
                continue
            if expected is not None and (expected < 0 or received >= expected):
                for part in self._taken(session, entries, held.pop(session, []), expected >= 0):
                    out.extend((session, v) for v in part)
                    while len(out) >= self.slice:
                        yield pd.DataFrame(out[: self.slice], columns=["session_id", self.payload])
                        out = out[self.slice :]
                state = (0, OVER, 0)
            elif session in held:
                self._store(session, state, held.pop(session))
            self.progress.updateValue((session,), tuple(state))
        if out:
            yield pd.DataFrame(out, columns=["session_id", self.payload])

    def _store(self, session: str, state: list, part: list[str]) -> None:
        for k in range(0, len(part), self.entry):
            self.rows.updateValue((session, state[2]), (part[k : k + self.entry],))
            state[2] += 1

    def _taken(self, session: str, entries: int, held: list[str], wanted: bool) -> Iterator[list[str]]:
        """The session's rows, which leave the state; none if they are not wanted."""
        for k in range(entries):
            if wanted and (entry := self.rows.getValue((session, k))):  # none if its time was up
                yield entry[0]
            self.rows.removeKey((session, k))
        if wanted:
            yield held

    def close(self) -> None:
        pass


def completion_gate(messages: DataFrame, payload: str = "payload", ttl_ms: int | None = None, groups: int | None = None) -> DataFrame:
    """Streaming form: releases each session's payloads once, when it is complete, and frees its rows.
    ``ttl_ms`` bounds how long a session, or its mark, is remembered (never forgotten by default). As in the batch
    form, messages without a session are never released.

    Messages are folded by session in their tasks before they meet. Handing a group to Python costs some
    milliseconds, so with many small sessions let them share ``groups`` groups, by a hash; by default each session
    is one. The number is part of the checkpoint and can't be changed later."""
    folded = messages.filter("session_id is not null").select("session_id", "expected", "n_messages", payload).mapInArrow(
        _fold(payload), f"session_id string, expected long, n_messages long, `{payload}` array<string>"
    )
    if groups:
        folded = folded.withColumn("_group", F.pmod(F.xxhash64("session_id"), F.lit(groups)))
    return folded.groupBy("_group" if groups else "session_id").transformWithStateInPandas(
        _Gate(payload, ttl_ms), outputStructType=f"session_id string, {payload} string", outputMode="Append", timeMode="ProcessingTime" if ttl_ms else "None"
    )


def completed_rows(messages: DataFrame, payload: str = "payload") -> DataFrame:
    """Batch form of the same rule."""
    progress = messages.groupBy("session_id").agg(F.sum("n_messages").alias("_received"), F.min("expected").alias("_expected"))
    done = progress.filter((F.col("_expected") >= 0) & (F.col("_received") >= F.col("_expected"))).select("session_id")
    return messages.filter(F.col(payload).isNotNull()).join(done, "session_id").select("session_id", payload)
