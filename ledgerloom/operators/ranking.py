"""Top items and top users. Ties go to the smaller id, so results are the same in every run."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .joins import last_wins


def top_k(df: DataFrame, partition: Sequence[str], measure: str, tie: str, k: int = 1, rank: str = "rank") -> DataFrame:
    """The ``k`` rows of each partition with the largest measure; the window's limit is pushed below the shuffle."""
    w = Window.partitionBy(*partition).orderBy(F.col(measure).desc(), F.col(tie))
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def top_items(grouped: DataFrame, by: Sequence[str] = (), keep_both: bool = False) -> DataFrame:
    """Per month the item with the largest quantity (category 1) and with the largest subtotal (category 2).

    If one item is both, only its category 1 row is given, unless ``keep_both``. Two limited rankings are united, so each
    keeps its limit below the shuffle; the second join touches a row per month.
    """
    keys = [*by, "year", "month"]
    by_quantity = top_k(grouped, keys, "quantity", "item_id").drop("rank").withColumn("category", F.lit(1))
    by_subtotal = top_k(grouped, keys, "subtotal", "item_id").drop("rank").withColumn("category", F.lit(2))
    both = by_quantity.unionByName(by_subtotal)
    if keep_both:
        return both
    w = Window.partitionBy(*keys, "item_id").orderBy("category")
    return both.withColumn("_nth", F.row_number().over(w)).where("_nth = 1").drop("_nth")


def top_users(counts: DataFrame, by: Sequence[str] = (), k: int = 3) -> DataFrame:
    """Per store the ``k`` users with the most purchases, ranked from 1."""
    best = top_k(counts, [*by, "store_id"], "count", "user_id", k)
    return best.select(*by, "user_id", "store_id", F.col("count").alias("purchase_count"), "rank")


def latest(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """The last row of each key by ``order``: how an update replaces what arrived before, ahead of a ranking."""
    return last_wins(df, keys, [order])
