"""Row maps and projections. A map action is ``[name, {parameters}]``; actions run in order and see
each other's output columns."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import half_index, month_index
from .predicates import filter_rows

MapAction = Callable[..., DataFrame]


def _calendar(index: Callable) -> MapAction:
    def action(df: DataFrame, *, init_year: int, col_year: str = "year", col_month: str = "month", col_out: str = "month") -> DataFrame:
        return df.withColumn(col_out, index(F.col(col_year), F.col(col_month), init_year))

    return action


MAPS: dict[str, MapAction] = {
    "identity": lambda df: df,
    "map_month": _calendar(month_index),
    "map_semester": _calendar(half_index),
    "rename": lambda df, **names: df.withColumnsRenamed(names),
}


def register_map(name: str, action: MapAction) -> None:
    """Add an action; it should build column expressions, so that it stays inside code generation."""
    MAPS[name] = action


def apply_maps(df: DataFrame, actions: Sequence[Sequence]) -> DataFrame:
    for name, params in actions:
        if name not in MAPS:
            raise ValueError(f"unknown map {name!r}; known: {', '.join(sorted(MAPS))}")
        df = MAPS[name](df, **params)
    return df


def project(df: DataFrame, cols: Sequence[str | int] | None) -> DataFrame:
    """Columns by name or position, in the given order; None keeps all."""
    return df if cols is None else df.select(*[df.columns[c] if isinstance(c, int) else c for c in cols])


def name_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Give the first columns these names and leave out the rest; ValueError if there are too few."""
    if len(df.columns) < len(names):
        raise ValueError(f"{len(names)} names for {len(df.columns)} columns")
    return df.toDF(*names, *[f"__{i}" for i in range(len(names), len(df.columns))]).select(*names)  # the input may repeat a name


def pad_columns(df: DataFrame, names: Sequence[str], kind: str = "string") -> DataFrame:
    """Add the missing columns as nulls."""
    return df.withColumns({n: F.lit(None).cast(kind) for n in names if n not in df.columns})


def map_rows(df: DataFrame, actions: Sequence[Sequence] = (), out: Sequence[str | int] | None = None) -> DataFrame:
    return project(apply_maps(df, actions), out)


def select_rows(df: DataFrame, filters: Sequence[Sequence] = (), actions: Sequence[Sequence] = (), out: Sequence[str | int] | None = None) -> DataFrame:
    """Filter, then map, then project."""
    return map_rows(filter_rows(df, filters), actions, out)
