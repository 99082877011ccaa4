"""Row predicates as Columns; chains of them are merged by the optimizer and reach the scan where they can."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

YEARS = (2024, 2025)
HOURS = (6, 23)
LEAST_AMOUNT = 75
FACTS = ("TR", "TI")
DIMENSIONS = ("MN", "ST", "US", "PM", "VC")
#: Where a table kind keeps its timestamp.
TIME_COLUMN = {"TR": "created_at", "TI": "created_at", "US": "registered_at"}
REQUIRED = {
    2: ("transaction_id", "item_id", "quantity", "subtotal"),
    3: ("transaction_id", "store_id", "final_amount"),
    4: ("user_id", "store_id"),
}

Predicate = Callable[[], Column] | Column


def in_years(ts: Column, years: Iterable[int] = YEARS) -> Column:
    """As ranges of time, one for each run of years, so that the scan can skip by them; ``ts`` has no time zone."""
    wanted = sorted(set(years))
    firsts = [y for y in wanted if y - 1 not in wanted]
    lasts = [y for y in wanted if y + 1 not in wanted]
    begin = lambda y: F.expr(f"TIMESTAMP_NTZ '{y:04d}-01-01 00:00:00'")
    ranges = [(ts >= begin(a)) & (ts < begin(b + 1)) for a, b in zip(firsts, lasts)]
    return reduce(lambda a, b: a | b, ranges, F.lit(False)) if len(ranges) != 1 else ranges[0]


def rows_in_years(df: DataFrame, kind: str, years: Iterable[int] = YEARS) -> DataFrame:
    """Rows of a table kind whose own timestamp column lies in ``years``; kinds without one pass whole."""
    return df.where(in_years(F.col(TIME_COLUMN[kind]), years)) if kind in TIME_COLUMN else df


def in_hours(ts: Column, first: int = HOURS[0], last: int = HOURS[1]) -> Column:
    return F.hour(ts).between(first, last)


def at_least(amount: Column, least: float = LEAST_AMOUNT) -> Column:
    """Inclusive; NaN, which Spark holds to be the largest number, does not pass."""
    return (amount >= least) & ~F.isnan(amount.cast("double"))


def chain(*conditions: Column) -> Callable[[DataFrame], DataFrame]:
    """A transform that keeps rows for which all of ``conditions`` hold: any Column is a filter stage."""
    return lambda df: df.where(reduce(lambda a, b: a & b, conditions))


def required(df: DataFrame, query: int) -> DataFrame:
    return df.dropna(subset=list(REQUIRED[query]))


def is_number(parsed: Column) -> Column:
    return parsed.isNotNull()


def is_fact(kind: Column) -> Column:
    return kind.isin(*FACTS)


def is_dimension(kind: Column) -> Column:
    return kind.isin(*DIMENSIONS)


def is_users(kind: Column) -> Column:
    return kind == "US"
