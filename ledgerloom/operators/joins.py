"""Joins with dimension tables, and what decides between rows of one key.

Whether a dimension is broadcast is left to Spark, which knows sizes at run time; ``broadcast_below`` counts it first.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from ..functions.columns import normalise_user_id


def broadcast_below(dim: DataFrame, rows: int = 200_000, max_bytes: int = 32 << 20) -> DataFrame:
    """``dim`` with a broadcast hint if it has no more than ``rows`` rows (read up to that many) and ``max_bytes`` bytes, else as it is.

    Bytes are those of its texts and 16 for each column of a row.
    """
    texts = [F.coalesce(F.octet_length(c), F.lit(0)) for c, t in dim.dtypes if t in ("string", "binary")]
    width = sum(texts, F.lit(16 * len(dim.columns)))
    n, held = dim.limit(rows + 1).agg(F.count("*"), F.sum(width)).first()
    return F.broadcast(dim) if n <= rows and (held or 0) <= max_bytes else dim


def with_dimension(facts: DataFrame, dim: DataFrame, key: str, by: Sequence[str] = ()) -> DataFrame:
    """Left join; facts without a match keep null dimension columns."""
    return facts.join(dim, [*by, key], "left")


def items_with_menu(items: DataFrame, menu: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_dimension(items, menu.select(*by, "item_id", "item_name", "coffee_category", "price", "is_seasonal"), "item_id", by)


def transactions_with_stores(rows: DataFrame, stores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return with_dimension(rows, stores, "store_id", by)


def top_users_with_details(top: DataFrame, users: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Inner join on the normalised user id: users that are not known are dropped."""
    if dict(users.dtypes)["user_id"] == "string":
        users = users.withColumn("user_id", normalise_user_id(F.col("user_id")))
    return top.join(users.where("user_id IS NOT NULL"), [*by, "user_id"], "inner")


def unmatched_users(top: DataFrame, users: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return top.join(users, [*by, "user_id"], "left_anti")


def _pick(dim: DataFrame, keys: Sequence[str], order: Sequence[str], last: bool) -> DataFrame:
    """One row per key by aggregation: tasks keep one row of each key before anything is shuffled, so a hot key is no hot task.

    Nulls come first in the order, as in a sort. Rows that tie on all of ``order`` are told apart by their other columns, as far as
    these can be compared.
    """
    rest = [c for c in dim.columns if c not in keys]
    if not rest:
        return dim.distinct()
    kinds = {f.name: f.dataType for f in dim.schema.fields}
    ties = [c for c in rest if c not in order and not isinstance(kinds[c], (MapType, VariantType))]
    place = F.struct(*(x for c in [*order, *ties] for x in (F.col(c).isNotNull().alias(f"has_{c}"), F.col(c))))
    best = (F.max_by if last else F.min_by)(F.struct(*rest), place)
    return dim.groupBy(*keys).agg(best.alias("_row")).select(*(F.col(c) if c in keys else F.col(f"_row.`{c}`") for c in dim.columns))


def last_wins(dim: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the last by ``order``: menu items and stores."""
    return _pick(dim, keys, order, True)


def first_wins(dim: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Of rows with equal keys the first by ``order``: users."""
    return _pick(dim, keys, order, False)


def write_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> DataFrame:
    """Store a table dealt and sorted by ``key``, so that joins and groupings by it read it as it lies; each bucket is written by one task."""
    df.repartition(buckets, key).write.mode("overwrite").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)
    return df.sparkSession.table(table)


def co_partitioned_join(left: DataFrame, right: DataFrame, key: str, how: str = "inner", strategy: str | None = None) -> DataFrame:
    """A join by ``key`` after which further joins and groupings by the key need no new shuffle.

    Spark deals both sides by the key, or neither if both come from ``write_bucketed`` with as many buckets, broadcasts a side that turns out
    small and splits keys that turn out too large. ``strategy`` ("merge", "shuffle_hash") forbids the broadcast.
    """
    return (left.hint(strategy) if strategy else left).join(right, key, how)


def one_input_many_queries(rows: DataFrame, conditions: dict[str, object]) -> dict[str, DataFrame]:
    """Views of one input by query; persisted by the caller only where parsing it is the costly part."""
    return {name: rows.where(c) for name, c in conditions.items()}
