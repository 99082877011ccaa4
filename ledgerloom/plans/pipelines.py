"""The four queries end to end, on typed tables with the columns of ``schemas``."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..operators.aggregates import aggregate
from ..operators.joins import first_wins, items_with_menu, last_wins, top_users_with_details, transactions_with_stores
from ..operators.ranking import top_items, top_users
from ..schemas import TRANSACTIONS

PLACE = ("file_path", "line")


def _once(dim: DataFrame, key: str, by: Sequence[str], pick) -> DataFrame:
    """One row per key of a dimension; by place in the input where it is known."""
    place = [c for c in PLACE if c in dim.columns]
    return pick(dim, [*by, key], place).drop(*place) if place else dim


def filtered_transactions(transactions: DataFrame, years: Iterable[int] = P.YEARS, hours: tuple[int, int] = P.HOURS, least: float = P.LEAST_AMOUNT) -> DataFrame:
    """Q1: by year, hour and amount; one stage, no shuffle."""
    return transactions.where(P.in_years(F.col("created_at"), years)).where(P.in_hours(F.col("created_at"), *hours)).where(P.at_least(F.col("final_amount"), least))


def grouped_items(items: DataFrame, years: Iterable[int] = P.YEARS, by: Sequence[str] = ()) -> DataFrame:
    rows = P.required(items, 2).where(P.in_years(F.col("created_at"), years))
    return aggregate(rows.withColumn("year", F.year("created_at")).withColumn("month", F.month("created_at")), 2, by)


def best_items(items: DataFrame, menu: DataFrame, years: Iterable[int] = P.YEARS, by: Sequence[str] = (), keep_both: bool = False) -> DataFrame:
    """Q2: per month the best-selling and the most profitable item. Ranked before the join, which sees two rows a month."""
    top = top_items(grouped_items(items, years, by), by, keep_both)
    named = items_with_menu(top, _once(menu, "item_id", by, last_wins), by)
    return named.select(*by, "year", "month", "item_id", "quantity", "subtotal", "category", "item_name", "coffee_category", "price", "is_seasonal")


def grouped_stores(transactions: DataFrame, years: Iterable[int] = P.YEARS, hours: tuple[int, int] | None = P.HOURS, by: Sequence[str] = ()) -> DataFrame:
    rows = P.required(transactions, 3).where(P.in_years(F.col("created_at"), years))
    rows = rows.where(P.in_hours(F.col("created_at"), *hours)) if hours else rows
    rows = rows.where(~F.isnan(F.col("final_amount").cast("double")))
    return aggregate(rows.withColumn("year", F.year("created_at")).withColumn("semester", C.semester(F.col("created_at"))), 3, by)


def volume_by_store(transactions: DataFrame, stores: DataFrame, years: Iterable[int] = P.YEARS, hours: tuple[int, int] | None = P.HOURS, by: Sequence[str] = ()) -> DataFrame:
    """Q3: payment volume per store and half-year."""
    return transactions_with_stores(grouped_stores(transactions, years, hours, by), _once(stores, "store_id", by, last_wins), by)


def top_customers(transactions: DataFrame, users: DataFrame, years: Iterable[int] = P.YEARS, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Q4: the customers with the most purchases in each store, with their details."""
    rows = P.required(transactions, 4).where(P.in_years(F.col("created_at"), years))
    return top_users_with_details(top_users(aggregate(rows, 4, by), by, k), _once(users, "user_id", by, first_wins), by)


def all_queries(tables: dict[str, DataFrame], years: Iterable[int] = P.YEARS, by: Sequence[str] = ()) -> dict[str, DataFrame]:
    """All four queries over the tables by kind (TR, TI, MN, ST, US), for every client at once with ``by=["client_id"]``."""
    columns = [*by, *(c for c in TRANSACTIONS.names if c not in by)]
    return {
        "Q1": filtered_transactions(tables["TR"], years).select(columns),
        "Q2": best_items(tables["TI"], tables["MN"], years, by),
        "Q3": volume_by_store(tables["TR"], tables["ST"], years, by=by),
        "Q4": top_customers(tables["TR"], tables["US"], years, by),
    }
