"""Grouped aggregates chosen by name. An aggregate is ``[op, in_col, out_col]``; ``out_col`` defaults to
``in_col``, and for ``count`` the second item is the output name. Sums and averages are those of doubles,
of any size. ``money_sum`` is for amounts of up to four decimals and 20 digits before them: it runs in
decimal, so it does not depend on the order of the rows. A value that is no number fails the job under
ANSI casts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .maps import project

EXACT = "decimal(24,4)"


AGGREGATES: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.sum(c.cast("double")),
    "money_sum": lambda c: F.sum(c.cast(EXACT)).cast("double"),
    "max": lambda c: F.max(c.cast("double")),
    "avg": lambda c: F.avg(c.cast("double")),
    "count": lambda _: F.count(F.lit(1)),
}


def register_aggregate(name: str, build: Callable[[Column], Column]) -> None:
    AGGREGATES[name] = build


def group_by(df: DataFrame, keys: Sequence[str], aggs: Sequence[Sequence[str]], out: Sequence[str] | None = None, session: str | None = None) -> DataFrame:
    """One row per key. With ``session`` that column leads the key, so sessions never mix."""
    cols = []
    for op, first, *rest in aggs:
        if op not in AGGREGATES:
            raise ValueError(f"unknown aggregate {op!r}; known: {', '.join(sorted(AGGREGATES))}")
        if op != "count" and first not in df.columns:
            raise ValueError(f"unknown column {first!r}")
        cols.append(AGGREGATES[op](F.lit(1) if op == "count" else F.col(f"`{first}`")).alias(rest[0] if rest else first))
    return project(df.groupBy(*([session] if session else []), *keys).agg(*cols), out)
