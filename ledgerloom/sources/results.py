"""Result files: lines of text per client and query, and CSV tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .csv_tables import parsed
from .records import read_records

#: The name of null in folders.
NO_VALUE = "__HIVE_DEFAULT_PARTITION__"


def _quoted(text: Column) -> Column:
    """Quotes around a field that holds a comma, a quote or a line break; quotes within are doubled."""
    return F.when(text.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))).otherwise(text)


def _head(owner: Column, query: int) -> Column:
    """What a line of a client and query begins with; a null client is an empty one."""
    return F.concat(F.coalesce(owner.cast("string"), F.lit("")), F.lit(f" | Q{query} | "))


def result_lines(df: DataFrame, query: int, client_id: str | None = None) -> DataFrame:
    """client_id and line, ``CLIENT | Qn | a,b,c``; null fields are empty, doubles have two decimals, and fields are quoted where they must be."""
    owner = F.lit(client_id) if client_id is not None else F.col("client_id")
    fields = [c for c in df.columns if c != "client_id"]
    text = [F.coalesce(_quoted((F.col(c).cast("decimal(18,2)") if t == "double" else F.col(c)).cast("string")), F.lit("")) for c, t in df.dtypes if c in fields]
    return df.select(owner.alias("client_id"), F.concat(_head(owner, query), F.concat_ws(",", *text)).alias("line"))


def write_result_files(lines: DataFrame, path: str, mode: str = "overwrite") -> None:
    """A folder of text files per client."""
    lines.select("client_id", "line").write.mode(mode).partitionBy("client_id").text(path)


def read_result_files(spark: SparkSession, path: str, query: int, columns: Sequence[str]) -> DataFrame:
    """The rows of one query: prefix and header lines are stripped and fields split, all as text; an empty field is null.

    Clients are those of the folders, as text whatever they look like; an empty client's folder is that of null. Quoted fields may
    hold commas, quotes and line breaks, for records are read and not lines. Client ids hold no quotes and no line breaks.
    """
    records = read_records(spark, path, "*.txt").select("value", F.regexp_extract(F.url_decode(F.replace("file_path", F.lit("+"), F.lit("%2B"))), r"/client_id=([^/]*)/[^/]*$", 1).alias("_folder"))
    owner = F.when(F.col("_folder") != NO_VALUE, F.url_decode(F.replace("_folder", F.lit("+"), F.lit("%2B"))))
    head = _head(owner, query)
    rows = records.where(F.startswith("value", head)).select(owner.alias("client_id"), parsed(F.substring("value", F.char_length(head) + 1, F.char_length("value")), columns).alias("_f"))
    return rows.where(~F.coalesce(F.lower(F.col(f"_f.{columns[0]}")) == columns[0].lower(), F.lit(False))).select("client_id", *(F.col(f"_f.{c}") for c in columns))


def write_csv(df: DataFrame, path: str, columns: Sequence[str], mode: str = "overwrite") -> None:
    """CSV with a header and a fixed order of columns; null is empty."""
    df.select(*columns).write.mode(mode).option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)
