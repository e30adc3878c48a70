"""The declarative operator kit: predicates, maps, aggregates, group-row reducers, joins, fan-out."""

from .accumulators import ACCUMULATORS, ROW_ORDERS, Accumulator, accumulate, least_rows, register_accumulator, register_row_order
from .aggregates import AGGREGATES, group_by, register_aggregate
from .fanout import fan_out, tagged_union, union_all
from .joins import JOIN_KINDS, equi_join, register_join
from .maps import MAPS, apply_maps, map_rows, name_columns, pad_columns, register_map, select_rows
from .predicates import PREDICATES, build_filter, filter_rows, register_predicate
from .reducers import REDUCERS, reduce_rows, register_reducer, top_rows
from .validate import compared, multiset_diff, same_rows, summary, totals

__all__ = [
    "ACCUMULATORS", "AGGREGATES", "Accumulator", "JOIN_KINDS", "MAPS", "PREDICATES", "REDUCERS", "ROW_ORDERS", "accumulate", "apply_maps",
    "build_filter", "compared", "equi_join", "fan_out", "filter_rows", "group_by", "least_rows", "map_rows", "multiset_diff", "name_columns", "pad_columns", "reduce_rows",
    "register_accumulator", "register_aggregate", "register_join", "register_map", "register_predicate", "register_reducer", "register_row_order", "same_rows",
    "select_rows", "summary", "tagged_union", "top_rows", "totals", "union_all",
]
