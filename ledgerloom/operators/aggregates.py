"""Group-bys of the queries. Spark combines on the map side, so only one row per key and task is shuffled."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def amount_sum(column: str) -> Column:
    """Sums as decimals, so the result doesn't depend on the order of rows."""
    return F.sum(F.col(column).cast("decimal(18,2)")).cast("double")




def aggregate_spec(query: int) -> tuple[tuple[str, ...], list[Column]]:
    """Keys and aggregates by query number; ``count`` counts raw rows."""
    rows = F.count(F.lit(1)).alias("count")
    specs = {
        2: (("year", "month", "item_id"), [F.sum("quantity").cast("bigint").alias("quantity"), amount_sum("subtotal").alias("subtotal"), rows]),
        3: (("year", "semester", "store_id"), [amount_sum("final_amount").alias("total_final_amount"), rows]),
        4: (("user_id", "store_id"), [rows]),
    }
    return specs[query]


def aggregate(df: DataFrame, query: int, by: Sequence[str] = ()) -> DataFrame:
    """Group by the query's keys; ``by`` puts further keys in front, such as client_id."""
    keys, columns = aggregate_spec(query)
    return df.groupBy(*by, *keys).agg(*columns)


def sorted_by_keys(df: DataFrame, query: int, by: Sequence[str] = ()) -> DataFrame:
    return df.orderBy(*by, *aggregate_spec(query)[0])


def with_counters(df: DataFrame, name: str, **conditions: Column) -> tuple[DataFrame, Observation]:
    """``df`` with counters that are filled by the first action: all rows, and rows for which each condition holds."""
    seen = Observation(name)
    counters = [F.count_if(c).alias(k) for k, c in conditions.items()]
    return df.observe(seen, F.count(F.lit(1)).alias("rows"), *counters), seen
