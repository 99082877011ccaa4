"""Comparison of result sets. Rows are compared as multisets by Spark; only counts are reported."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.columns import half_label, hash_bucket, month_key, whole_units

REPORT = "client_id string, query string, expected bigint, actual bigint, missing bigint, extra bigint, status string"


def _counts(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """One row: how many rows of each side there are, and how many have no partner on the other, repeats counted.

    One grouping over both sides; exceptAll would need two.
    """
    columns = expected.columns
    both = expected.withColumn("_e", F.lit(1)).withColumn("_a", F.lit(0)).unionByName(actual.select(columns).withColumn("_e", F.lit(0)).withColumn("_a", F.lit(1)))
    per = both.groupBy(columns).agg(F.sum("_e").alias("_ours"), F.sum("_a").alias("_theirs"))
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return per.agg(
        total("_ours").alias("expected"), total("_theirs").alias("actual"),
        total(F.greatest(F.col("_ours") - F.col("_theirs"), F.lit(0))).alias("missing"), total(F.greatest(F.col("_theirs") - F.col("_ours"), F.lit(0))).alias("extra"),
    )


def compare_exact(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    """PASS if both have the same rows, as often, in ``columns``."""
    found = _counts(expected.select(*columns), actual.select(*columns))
    return found.withColumn("status", F.when((F.col("missing") == 0) & (F.col("extra") == 0), "PASS").otherwise("FAIL"))


def coverage(expected: DataFrame, actual: DataFrame, columns: Sequence[str], partial: float = 0.9) -> DataFrame:
    """PASS if every expected row occurs, PARTIAL from 90 %, else FAIL; rows beyond the expected ones don't matter."""
    found = _counts(expected.select(*columns), actual.select(*columns))
    share = F.when(F.col("expected") > 0, (F.col("expected") - F.col("missing")) / F.col("expected")).otherwise(F.lit(1.0))
    found = found.withColumn("coverage", share)
    return found.withColumn("status", F.when(F.col("missing") == 0, "PASS").when(F.col("coverage") >= partial, "PARTIAL").otherwise("FAIL"))


def missing_rows(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    return expected.select(*columns).exceptAll(actual.select(*columns))


def common_rows(expected: DataFrame, actual: DataFrame, columns: Sequence[str]) -> DataFrame:
    return expected.select(*columns).intersectAll(actual.select(*columns))


def q1_form(result: DataFrame) -> DataFrame:
    return result.select("transaction_id", "final_amount")


def q2_form(result: DataFrame, category: int) -> DataFrame:
    """(YYYY-MM, item_name, value) of one category: quantity, or profit in whole units."""
    value = F.col("quantity").cast("bigint") if category == 1 else whole_units(F.col("subtotal"))
    return result.where(F.col("category") == category).select(month_key(F.col("year"), F.col("month")).alias("year_month"), "item_name", value.alias("value"))


def q3_form(result: DataFrame) -> DataFrame:
    return result.select(half_label(F.col("year"), F.col("semester")).alias("year_half"), "store_name", whole_units(F.col("total_final_amount")).alias("tpv"))


def q4_form(result: DataFrame) -> DataFrame:
    return result.select("store_id", "birthdate", F.col("purchase_count").alias("purchases_qty"))


def report_row(found: DataFrame, client_id: str, query: str) -> DataFrame:
    return found.select(F.lit(client_id).alias("client_id"), F.lit(query).alias("query"), "expected", "actual", "missing", "extra", "status")


def compare_client(client_id: str, expected: dict[str, DataFrame], actual: dict[str, DataFrame]) -> DataFrame:
    """One report row per comparison of a client; SKIPPED where either side is missing.

    ``expected`` has frames in comparison form by name (Q1, Q2_selling, Q2_profit, Q3, Q4), ``actual`` results by query (Q1 to Q4).
    """
    spark = next(iter([*expected.values(), *actual.values()])).sparkSession
    forms = {
        "Q1": ("Q1", q1_form), "Q2_selling": ("Q2", lambda r: q2_form(r, 1)), "Q2_profit": ("Q2", lambda r: q2_form(r, 2)), "Q3": ("Q3", q3_form), "Q4": ("Q4", q4_form),
    }
    rows = []
    for name, (query, form) in forms.items():
        if name not in expected or query not in actual:
            rows.append(spark.range(1).selectExpr(f"'{client_id}' client_id", f"'{name}' query", *(f"cast(null as bigint) {c}" for c in ("expected", "actual", "missing", "extra")), "'SKIPPED' status"))
            continue
        want, got = expected[name], form(actual[query])
        found = (coverage if name == "Q4" else compare_exact)(want, got, got.columns)
        rows.append(report_row(found, client_id, name))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    """Parts of one table as one; columns by name."""
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def misplaced_rows(rows: DataFrame, stored: DataFrame, bucket: str, key: str, buckets: int) -> DataFrame:
    """Rows of the input that are not stored in the bucket where their key belongs."""
    wanted = rows.withColumn(bucket, hash_bucket(buckets, F.col(key)))
    return wanted.join(stored.select(*rows.columns, bucket), [*rows.columns, bucket], "left_anti")
