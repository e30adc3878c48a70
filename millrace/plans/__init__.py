"""Declarative specs compiled to DataFrames, and the five reports written as specs."""

from .reports import Sources, best_selling, most_profit, payment_volume, retail_sources, run_all, top_buyers, transactions_filter
from .spec import Group, Join, Rename, Select, Top, compile_steps

__all__ = [
    "Group", "Join", "Rename", "Select", "Sources", "Top", "best_selling", "compile_steps", "most_profit", "payment_volume",
    "retail_sources", "run_all", "top_buyers", "transactions_filter",
]
