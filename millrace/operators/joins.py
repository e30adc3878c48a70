"""Inner equi-joins with their projections. Spark picks the physical join: a small side is
broadcast only under its size threshold, everything else is a sort-merge join that AQE can split."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEFT, RIGHT = "l", "r"
JOIN_KINDS: dict[str, Callable[[Column, Column], Column]] = {"inner_on_eq": lambda a, b: a == b}


def register_join(name: str, condition: Callable[[Column, Column], Column]) -> None:
    JOIN_KINDS[name] = condition


def equi_join(
    left: DataFrame, right: DataFrame, on: tuple[str, str], out: Sequence[str | tuple[str, str]] | None = None,
    kind: str = "inner_on_eq", keep_duplicates: bool = False, also: str | None = None,
) -> DataFrame:
    """Inner join on one column pair; every match is emitted and unmatched rows of both sides vanish.

    ``out`` lists columns in any order, a name (the left side wins a clash) or ``(side, name)`` with side
    "l" or "r". Without it: all left columns, then the right ones whose names are new (all of them with
    ``keep_duplicates``). ``also`` is a further condition in SQL, on columns of ``l`` and ``r``.
    """
    if kind not in JOIN_KINDS:
        raise ValueError(f"unknown join {kind!r}; known: {', '.join(sorted(JOIN_KINDS))}")
    for side, col in zip((left, right), on, strict=True):
        if col not in side.columns:
            raise ValueError(f"unknown join column {col!r}")
    match = JOIN_KINDS[kind](F.col(f"{LEFT}.{on[0]}"), F.col(f"{RIGHT}.{on[1]}"))
    joined = left.alias(LEFT).join(right.alias(RIGHT), match & F.expr(also) if also else match, "inner")
    if out is None:
        return joined.select(*[F.col(f"{LEFT}.{c}") for c in left.columns], *[F.col(f"{RIGHT}.{c}") for c in right.columns if keep_duplicates or c not in left.columns])
    sided = [c if isinstance(c, tuple) else (LEFT if c in left.columns else RIGHT, c) for c in out]
    return joined.select(*[F.col(f"{s}.{c}").alias(c) for s, c in sided])
