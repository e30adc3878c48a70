"""Scalar helpers: calendar arithmetic on plain columns (all JVM-side)."""

from __future__ import annotations

import uuid

from pyspark.sql import Column
from pyspark.sql import functions as F


def month_index(year: Column, month: Column, init_year: int) -> Column:
    """Months since ``init_year``; January of that year is 1."""
    return (year - F.lit(init_year)) * 12 + month


def half_index(year: Column, month: Column, init_year: int) -> Column:
    """Half-years since ``init_year``; its first half is 0."""
    return ((year - F.lit(init_year)) * 2 + F.floor((month - 1) / 6)).cast("int")


def decode_month(index: Column, init_year: int) -> Column:
    """``yyyy-MM`` of a month index. December stays in its own year."""
    year = F.floor((index - 1) / 12).cast("int") + F.lit(init_year)
    month = F.pmod(index - 1, F.lit(12)).cast("int") + 1
    return F.date_format(F.make_date(year, month, F.lit(1)), "yyyy-MM")


def decode_half(index: Column, init_year: int) -> Column:
    """``yyyy-H1`` or ``yyyy-H2`` of a half-year index."""
    year = F.floor(index / 2).cast("int") + F.lit(init_year)
    half = F.when(F.pmod(index, F.lit(2)) == 0, "H1").otherwise("H2")
    return F.concat_ws("-", year.cast("string"), half)


def whole_number(text: Column) -> Column:
    """``"13060.0"`` as 13060; empty and non-numeric text as null."""
    return F.trim(text.cast("string")).try_cast("double").try_cast("long")


def new_session_id() -> str:
    return str(uuid.uuid4())
