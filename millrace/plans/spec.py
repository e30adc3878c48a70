"""Specs: what to do, as data. ``compile_steps`` folds them over a DataFrame and leaves the rest to Catalyst."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from ..operators import equi_join, group_by, reduce_rows, select_rows


@dataclass(frozen=True)
class Select:
    filters: Sequence[Sequence] = ()
    maps: Sequence[Sequence] = ()
    out: Sequence[str] | None = None


@dataclass(frozen=True)
class Group:
    keys: Sequence[str]
    aggs: Sequence[Sequence[str]]
    out: Sequence[str] | None = None


@dataclass(frozen=True)
class Top:
    keys: Sequence[str]
    reducer: str
    params: dict = field(default_factory=dict)
    out: Sequence[str] | None = None


@dataclass(frozen=True)
class Join:
    """Join with a named dimension; the running DataFrame is the right side, the dimension the left."""

    dimension: str
    on: tuple[str, str]
    out: Sequence[str | tuple[str, str]] | None = None


@dataclass(frozen=True)
class Rename:
    names: dict


Step = Select | Group | Top | Join | Rename


def compile_steps(df: DataFrame, steps: Sequence[Step], dimensions: dict[str, DataFrame] | None = None, session: str | None = None) -> DataFrame:
    """Apply the steps in order. With ``session``, that column joins every grouping key and is kept."""
    lead = [session] if session else []
    keep = lambda out: None if out is None else [*lead, *out]
    for step in steps:
        match step:
            case Select(filters, maps, out):
                df = select_rows(df, filters, maps, keep(out))
            case Group(keys, aggs, out):
                df = group_by(df, keys, aggs, keep(out), session)
            case Top(keys, reducer, params, out):
                df = reduce_rows(df, [*lead, *keys], reducer, params, keep(out))
            case Join(dimension, on, out):
                df = equi_join((dimensions or {})[dimension], df, on, keep(out))
            case Rename(names):
                df = df.withColumnsRenamed(names)
            case _:
                raise ValueError(f"unknown step {step!r}")
    return df
