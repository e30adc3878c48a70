"""Row predicates as Catalyst columns, chosen by name from a registry.

A filter is ``[field, op, [constraints]]``; a list of filters is a conjunction and an empty list is
true. Numeric predicates on text use ``try_cast``: text that is no number fails the predicate. NaN
fails every numeric predicate. Numeric columns are compared as they are, so that the comparison
reaches the file scan.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Predicate = Callable[[Column, T.DataType, Sequence], Column]
#: Spellings of a missing value in text columns.
MISSING = ("", "None")


def _numeric(compare: Callable[[Column, Sequence], Column]) -> Predicate:
    def build(col: Column, kind: T.DataType, constraints: Sequence) -> Column:
        if isinstance(kind, T.IntegralType | T.DecimalType):
            return compare(col, constraints)
        value = col if isinstance(kind, T.DoubleType | T.FloatType) else col.try_cast("double")
        return compare(value, constraints) & ~F.isnan(value)

    return build


def _typed(kind: T.DataType, constraints: Sequence) -> list[Column]:
    return [F.lit(c).try_cast(kind) for c in constraints]


def _equals_any(col: Column, kind: T.DataType, constraints: Sequence) -> Column:
    return col.isin(*_typed(kind, constraints))


def _not_equals(col: Column, kind: T.DataType, constraints: Sequence) -> Column:
    """Different from all constraints. A null passes unless a spelling of a missing value is excluded."""
    if any(c is None or c in MISSING for c in constraints):
        rest = [c for c in constraints if c is not None and (isinstance(kind, T.StringType) or c not in MISSING)]
        return col.isNotNull() & ~_equals_any(col, kind, rest) if rest else col.isNotNull()
    return col.isNull() | ~_equals_any(col, kind, constraints)


PREDICATES: dict[str, Predicate] = {
    ">": _numeric(lambda v, c: v > c[0]),
    ">=": _numeric(lambda v, c: v >= c[0]),
    "<": _numeric(lambda v, c: v < c[0]),
    "<=": _numeric(lambda v, c: v <= c[0]),
    "between": _numeric(lambda v, c: v.between(c[0], c[1])),
    "equals_any": _equals_any,
    "not_equals": _not_equals,
}


def register_predicate(name: str, build: Predicate) -> None:
    PREDICATES[name] = build


def build_filter(df: DataFrame, conf: Sequence[Sequence]) -> Column:
    """The conjunction of ``conf`` as one column; ValueError for an unknown operator or field."""
    parts = []
    for field, op, constraints in conf:
        if op not in PREDICATES:
            raise ValueError(f"unknown predicate {op!r}; known: {', '.join(sorted(PREDICATES))}")
        name = df.columns[field] if isinstance(field, int) else field
        if name not in df.columns:
            raise ValueError(f"unknown column {name!r}")
        parts.append(PREDICATES[op](F.col(f"`{name}`"), df.schema[name].dataType, constraints))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def filter_rows(df: DataFrame, conf: Sequence[Sequence]) -> DataFrame:
    return df.filter(build_filter(df, conf)) if conf else df
