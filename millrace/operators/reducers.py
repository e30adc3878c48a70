"""Group-row reducers: keep all rows of a group, its top row, its k largest or smallest.

Each reducer ranks inside the group with an explicit tie-break, so a result never depends on the
order of arrival. ``row_number() <= k`` plans as a partial and a final group limit: a task keeps at
most k rows of a group before the shuffle, however large the group is. Ranks of all rows are found without
bringing a group together (:func:`ranked_all`).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..scratch import written
from .maps import project

RANK = "rank"
Order = Callable[..., tuple[list[Column], int | None]]


def _ties(ties: Sequence[str]) -> list[Column]:
    return [F.col(c).asc_nulls_last() for c in ties]


REDUCERS: dict[str, Order] = {
    "keep_all_rows": lambda *, ties=(): (_ties(ties), None),
    "keep_top_row": lambda comp_key, *, ties=(): ([F.col(comp_key).desc_nulls_last(), *_ties(ties)], 1),
    "keep_top_k": lambda comp_key, limit, *, ties=(): ([F.col(comp_key).desc_nulls_last(), *_ties(ties)], limit),
    "keep_least_k": lambda comp_key, limit, *, ties=(): ([F.col(comp_key).asc_nulls_last(), *_ties(ties)], limit),
    "keep_asc_desc": lambda comp_key, comp_key2, limit, *, ties=(): ([F.col(comp_key).desc_nulls_last(), F.col(comp_key2).asc_nulls_last(), *_ties(ties)], limit),
}


def register_reducer(name: str, order: Order) -> None:
    REDUCERS[name] = order


def reduce_rows(df: DataFrame, keys: Sequence[str], reducer: str, params: dict | None = None, out: Sequence[str] | None = None, rank: bool = False) -> DataFrame:
    """Apply a reducer to each group of ``keys``; ``rank`` adds the 1-based position in the group."""
    if reducer not in REDUCERS:
        raise ValueError(f"unknown reducer {reducer!r}; known: {', '.join(sorted(REDUCERS))}")
    order, limit = REDUCERS[reducer](**(params or {}))
    if limit is None and not rank:
        return project(df, out)
    cols = list(out) if out is not None else df.columns
    if limit is None:
        return ranked_all(df, keys, order).select(*cols, RANK)
    ranked = df.withColumn(RANK, F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or [F.lit(1)])))).filter(F.col(RANK) <= limit)
    return ranked.select(*cols, *([RANK] if rank else []))


def ranked_all(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """Every row with its rank in its group, for groups of any size.

    Rows are dealt out by ranges of key and order, so a large group is spread over many tasks, and written
    with the number of their range. Ranks are counted inside a range; the rows of the group in ranges before
    it, a sum over a small table of counts, are added. No window holds more of a group than one range."""
    part, before, at, own = "__part", "__before", "__at", "__own"
    order = [*order, F.col(own)]  # ties of any number are spread as well
    dealt = df.withColumn(own, F.monotonically_increasing_id()).repartitionByRange(*[F.col(f"`{k}`") for k in keys], *order)
    dealt = written(dealt.withColumn(part, F.spark_partition_id()), "ranked")
    inside = Window.partitionBy(part, *keys)
    sizes = written(dealt.groupBy(part, *keys).agg(F.count(F.lit(1)).alias("n")), "ranked-sizes")
    earlier = Window.partitionBy(*keys).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(part, *keys, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    ranked = dealt.withColumn(at, F.row_number().over(inside.orderBy(*order))).alias("r")
    offsets = offsets.alias("o")
    same = F.col(f"r.{part}") == F.col(f"o.{part}")
    for k in keys:
        same = same & F.col(f"r.`{k}`").eqNullSafe(F.col(f"o.`{k}`"))
    rank = F.col(f"r.{at}") + F.col(f"o.{before}")
    return ranked.join(offsets, same).select(*[F.col(f"r.`{c}`") for c in df.columns], rank.alias(RANK))


def top_rows(df: DataFrame, keys: Sequence[str], by: dict[str, str], ties: Sequence[str]) -> DataFrame:
    """The top row of each group by several numeric columns at once, in one aggregation and without a sort:
    ``query`` (the name given in ``by``), the keys, the ties and ``value``. Of equal values the row of
    smallest ties wins. A null never wins; a group without a value has no row for it."""
    first = lambda c: F.min(F.when(F.col(c).isNotNull(), F.struct((-F.col(c)).alias("less"), *ties)))
    tops = df.groupBy(*keys).agg(*[first(c).alias(f"__top_{i}") for i, c in enumerate(by.values())])
    rows = [F.struct(F.lit(name).alias("query"), *[F.col(f"__top_{i}.{t}").alias(t) for t in ties], (-F.col(f"__top_{i}.less")).cast("double").alias("value")) for i, name in enumerate(by)]
    told = tops.select(*keys, F.explode(F.array(*[F.when(F.col(f"__top_{i}").isNotNull(), r) for i, r in enumerate(rows)])).alias("r")).filter("r is not null")
    return told.select("r.query", *keys, *[f"r.{t}" for t in ties], "r.value")
