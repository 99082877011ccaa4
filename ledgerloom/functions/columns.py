"""Derived columns: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TIMESTAMP = r"^[0-9]{4}-[0-9]{2}-[0-9]{2} [0-9]{1,2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,6})?$"
DATE_FORMATS = (TIMESTAMP, r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$", r"^[0-9]{4}/[0-9]{2}/[0-9]{2} [0-9]{2}:[0-9]{2}:[0-9]{2}$", r"^[0-9]{4}/[0-9]{2}/[0-9]{2}$")
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"


def month_text(ts: Column) -> Column:
    return F.date_format(ts, "MM")


def semester(ts: Column) -> Column:
    return F.when(F.month(ts) >= 7, 2).otherwise(1)


def month_key(y: Column, m: Column) -> Column:
    return F.format_string("%04d-%02d", y, m)


def half_label(y: Column, s: Column) -> Column:
    return F.format_string("%d-H%d", y, s)


def _as_time(text: Column, *forms: str) -> Column:
    """A time without zone, straight from the text, so that no session's zone moves it or leaves an hour out."""
    fits = F.trim(text).rlike("|".join(forms))
    return F.when(fits, F.replace(F.trim(text), F.lit("/"), F.lit("-")).try_cast("timestamp_ntz"))


def parse_timestamp(text: Column) -> Column:
    """``yyyy-MM-dd HH:mm:ss`` with a fraction or a one-digit hour allowed; anything else is null."""
    return _as_time(text, TIMESTAMP)


def parse_date(text: Column) -> Column:
    """Any of the accepted layouts, else null."""
    return _as_time(text, *DATE_FORMATS)


def lenient_int(text: Column) -> Column:
    """A whole number with an optional sign; ``5.0`` and the empty string are null."""
    return F.when(F.trim(text).rlike(r"^[+-]?[0-9]+$"), F.trim(text).try_cast("bigint"))


def lenient_double(text: Column) -> Column:
    """A plain decimal number; suffixes that Spark's cast would take (``75d``), words and the empty string are null."""
    return F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("double"))


def money(text: Column) -> Column:
    return F.when(F.trim(text).rlike(NUMBER), F.trim(text).try_cast("decimal(18,2)"))


def normalise_user_id(text: Column) -> Column:
    """``123`` and ``123.0`` are user 123; anything else that is no whole number is null."""
    return F.regexp_replace(F.trim(text), r"\.0$", "").try_cast("bigint")


def money_text(amount: Column) -> Column:
    return amount.cast("decimal(18,2)").cast("string")


def whole_units(amount: Column) -> Column:
    return F.when(amount >= 0, F.floor(amount)).otherwise(F.ceil(amount)).cast("bigint")


def text_key(*keys: Column) -> Column:
    return F.concat_ws("|", *keys)


def hash_bucket(buckets: int, *keys: Column) -> Column:
    """A bucket from a composite key; its number is stable but has no meaning of its own."""
    return F.pmod(F.xxhash64(*keys), F.lit(buckets)).cast("int")


def modulo_bucket(user_id: Column, buckets: int) -> Column:
    return (user_id % buckets).cast("int")


def half_year_bucket(ts: Column, first_year: int) -> Column:
    """0 for the first half of ``first_year``, then one more each half year; earlier dates are null."""
    n = (F.year(ts) - first_year) * 2 + semester(ts) - 1
    return F.when(n >= 0, n).cast("int")


def empty_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def query_tag(number: int) -> Column:
    return F.lit(number)
