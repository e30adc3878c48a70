"""The five retail reports, each a list of steps over typed sources.

Ties are always broken by the key, and only reduced rows meet a dimension: the joins after a top-k or
a group-by read a few rows on that side, so Spark can broadcast them under its threshold and never
has to move a large dimension.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import sources as S
from ..functions import decode_half, decode_month, new_session_id
from ..operators import fan_out
from .spec import Group, Join, Rename, Select, Step, Top, compile_steps


@dataclass(frozen=True)
class Sources:
    transactions: DataFrame
    items: DataFrame
    menu: DataFrame
    stores: DataFrame
    users: DataFrame
    years: tuple[int, ...] = (2024, 2025)
    init_year: int = 2024
    hours: tuple[int, int] = (6, 23)
    min_amount: float = 75.0

    @property
    def dimensions(self) -> dict[str, DataFrame]:
        return {"menu": self.menu, "stores": self.stores, "users": self.users}


def retail_sources(spark: SparkSession, root: str, mode: str = "FAILFAST", years: tuple[int, ...] = (2024, 2025)) -> Sources:
    """The five CSV datasets under ``root``, one folder each. The reports' years are ranges of ``created_at``, so that
    the scan itself drops rows of other years."""

    def read(name: str) -> DataFrame:
        rows = S.read_dataset(spark, f"{root}/{name}", name, mode)
        return getattr(S, name)(S.in_years(rows, "created_at", years) if name.startswith("transaction") else rows)

    return Sources(*[read(n) for n in ("transactions", "transaction_items", "menu_items", "stores", "users")], years=years)


def _in_years(s: Sources) -> list:
    return ["year", "equals_any", s.years]


def q1_steps(s: Sources) -> list[Step]:
    filters = [_in_years(s), ["hour", "between", s.hours], ["final_amount", ">=", [s.min_amount]]]
    return [Select(filters, out=["transaction_id", "final_amount"])]


def monthly_products_steps(s: Sources) -> list[Step]:
    """Shared by both product reports: revenue and quantity per product and month."""
    months = [["map_month", {"init_year": s.init_year}]]
    return [
        Select([_in_years(s)], months, ["item_id", "month", "subtotal", "quantity"]),
        Group(["item_id", "month"], [["money_sum", "subtotal", "revenue"], ["money_sum", "quantity", "quantity_sold"]]),
    ]


def top_product_steps(by: str) -> list[Step]:
    return [
        Top(["month"], "keep_top_row", {"comp_key": by, "ties": ["item_id"]}, ["item_id", "month", by]),
        Join("menu", ("item_id", "item_id"), ["month", "item_name", by]),
    ]


def q3_steps(s: Sources) -> list[Step]:
    halves = [["map_semester", {"init_year": s.init_year, "col_out": "half"}]]
    return [
        Select([_in_years(s), ["hour", "between", s.hours]], halves, ["store_id", "half", "final_amount"]),
        Group(["store_id", "half"], [["money_sum", "final_amount", "tpv"]]),
        Join("stores", ("store_id", "store_id"), ["half", "store_name", "tpv"]),
    ]


def q4_steps(s: Sources, k: int = 3) -> list[Step]:
    return [
        Select([_in_years(s), ["user_id", "not_equals", ["", "None"]]], out=["store_id", "user_id"]),
        Group(["store_id", "user_id"], [["count", "purchases"]]),
        Top(["store_id"], "keep_asc_desc", {"comp_key": "purchases", "comp_key2": "user_id", "limit": k}, ["store_id", "user_id"]),
        Rename({"user_id": "top_user_id"}),
        Join("users", ("user_id", "top_user_id"), ["store_id", "birthdate"]),
        Join("stores", ("store_id", "store_id"), ["store_name", "birthdate"]),
    ]


def _lead(session: str | None) -> list[str]:
    return [session] if session else []


def transactions_filter(s: Sources, session: str | None = None) -> DataFrame:
    return compile_steps(s.transactions, q1_steps(s), session=session)


def monthly_products(s: Sources, session: str | None = None) -> DataFrame:
    return compile_steps(s.items, monthly_products_steps(s), session=session)


def best_selling(s: Sources, grouped: DataFrame | None = None, session: str | None = None) -> DataFrame:
    top = compile_steps(grouped if grouped is not None else monthly_products(s, session), top_product_steps("quantity_sold"), s.dimensions, session)
    return top.select(*_lead(session), decode_month(F.col("month"), s.init_year).alias("year_month"), "item_name", F.col("quantity_sold").cast("long").alias("sellings_qty"))


def most_profit(s: Sources, grouped: DataFrame | None = None, session: str | None = None) -> DataFrame:
    top = compile_steps(grouped if grouped is not None else monthly_products(s, session), top_product_steps("revenue"), s.dimensions, session)
    return top.select(*_lead(session), decode_month(F.col("month"), s.init_year).alias("year_month"), F.col("revenue").alias("profit_sum"), "item_name")


def payment_volume(s: Sources, session: str | None = None) -> DataFrame:
    out = compile_steps(s.transactions, q3_steps(s), s.dimensions, session)
    return out.select(*_lead(session), decode_half(F.col("half"), s.init_year).alias("year_half"), "store_name", "tpv")


def top_buyers(s: Sources, k: int = 3, session: str | None = None) -> DataFrame:
    return compile_steps(s.transactions, q4_steps(s, k), s.dimensions, session)


#: Result file of each report, in the order in which they are published.
REPORTS: Sequence[str] = ("query_1", "query_2_best_selling", "query_2_most_profits", "query_3", "query_4")


def run_all(s: Sources, out_dir: str, session_id: str | None = None) -> dict[str, str]:
    """Write all five reports of one session (a new one by default); returns when every one is committed, with
    the path of each. The transactions are scanned once for three reports, and the monthly sums are made once
    for two. Amounts are summed with four decimals; what lies below the fifth is rounded away row by row."""
    from ..sinks import write_result

    session_id = session_id or new_session_id()

    columns = ["transaction_id", "year", "store_id", "user_id", "month", "hour", "final_amount"]
    with_tx = lambda tx: Sources(tx, *list(vars(s).values())[1:])
    paths = {}
    with fan_out(s.transactions, {"query_1": lambda t: transactions_filter(with_tx(t)), "query_3": lambda t: payment_volume(with_tx(t)), "query_4": lambda t: top_buyers(with_tx(t))}, columns) as by_tx:
        paths |= {name: write_result(df, out_dir, session_id, name) for name, df in by_tx.items()}
    with fan_out(monthly_products(s), {"query_2_best_selling": lambda g: best_selling(s, g), "query_2_most_profits": lambda g: most_profit(s, g)}) as by_month:
        paths |= {name: write_result(df, out_dir, session_id, name) for name, df in by_month.items()}
    return {name: paths[name] for name in REPORTS}
