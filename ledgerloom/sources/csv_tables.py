"""CSV sources: folders of files, their kinds, headers and malformed rows."""

from __future__ import annotations

import csv
import io
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.columns import empty_to_null, lenient_double, lenient_int, money, normalise_user_id, parse_timestamp
from ..schemas import BY_KIND, FOLDERS
from .records import read_records

BAD = "_bad"


def classify(path: Column) -> Column:
    """The kind of a file by the names in its path; null for others."""
    kind = F.lit(None).cast("string")
    for folder, code in reversed(FOLDERS.items()):
        kind = F.when(F.contains(F.lower(path), F.lit(folder)), F.lit(code)).otherwise(kind)
    return kind


def list_files(spark: SparkSession, folder: str) -> DataFrame:
    """path, kind and file_id (code and two-digit number, by path, within the kind) of every CSV file below ``folder``."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path", "length")
    return with_file_ids(files.withColumn("kind", classify(F.col("path"))))


def with_file_ids(files: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    n = F.dense_rank().over(Window.partitionBy("kind").orderBy("path"))
    return files.withColumn("file_id", F.format_string("%s%02d", F.col("kind"), n))


def parsed(record: Column, names: Sequence[str]) -> Column:
    """Fields of a CSV record as text under ``names``, and ``_bad``, the record itself where their number is another."""
    ddl = ", ".join(f"`{n}` string" for n in [*names, BAD])
    return F.from_csv(record, F.lit(ddl), {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD, "escape": '"', "maxCharsPerColumn": "-1"})


def read_raw(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.csv") -> DataFrame:
    """All records of the CSV files below ``folder`` as text, malformed ones also in ``_bad``, with file_path and line.

    ``line`` is the number of a record's first line in its file, the same in every read, however files are split. Quoted fields
    may hold commas, doubled quotes and line breaks (see ``read_records``).
    """
    # Generated rows, for conditions on a plain column are moved below it, with a parse of the record in place of each field they name.
    return read_records(spark, folder, glob).select(F.inline(F.array(parsed(F.col("value"), schema.names))), "file_path", "line")


def places(rows: DataFrame) -> DataFrame:
    """file_path, its rows (n) and in how many lines they begin (places).

    Lines are bits, 64 of them a group, so a task holds a sixty-fourth of what a set of its rows' places would take.
    """
    blocks = rows.groupBy("file_path", F.shiftright("line", 6).alias("block")).agg(F.count("*").alias("n"), F.expr("bit_or(shiftleft(1L, CAST(line % 64 AS INT)))").alias("seen"))
    return blocks.groupBy("file_path").agg(F.sum("n").alias("n"), F.sum(F.bit_count("seen")).alias("places"))


def is_header(schema: T.StructType) -> Column:
    """Header rows, wherever they stand: the first column holds its own name."""
    return F.contains(F.lower(F.trim(F.col(schema.names[0]))), F.lit(schema.names[0].lower()))


def split_good_bad(raw: DataFrame, schema: T.StructType) -> tuple[DataFrame, DataFrame]:
    """(rows, quarantine). Headers and blank lines go. Rows with too few fields are set aside; longer ones are kept."""
    blank = reduce(lambda x, y: x & y, (F.coalesce(F.trim(F.col(c)), F.lit("")) == "" for c in schema.names))
    bare = F.regexp_replace(F.col(BAD), r'"[^"]*+(?:"|\z)', "")  # commas inside quotes separate nothing; a doubled quote ends one run and begins the next
    short = F.col(BAD).isNotNull() & (F.size(F.split(bare, ",")) < len(schema.names))
    rows = raw.where(~F.coalesce(is_header(schema), F.lit(False)) & ~(blank & F.col(BAD).isNull()))
    return rows.where(~F.coalesce(short, F.lit(False)) & ~blank).drop(BAD), rows.where(F.coalesce(short, F.lit(False)) | blank).select(F.col(BAD).alias("line_text"), "file_path", "line")


def header_matches(spark: SparkSession, folder: str, schema: T.StructType, glob: str = "*.csv") -> DataFrame:
    """file_path and whether its first record names the schema's columns in order; names may be quoted."""
    first = read_records(spark, folder, glob).where("line = 1").select("file_path", parsed(F.col("value"), schema.names).alias("h"))
    names = [F.lower(F.trim(F.col(f"h.{n}"))) == F.lit(n.lower()) for n in schema.names]
    fits = reduce(lambda x, y: x & y, names, F.col(f"h.{BAD}").isNull())
    return first.select("file_path", F.coalesce(fits, F.lit(False)).alias("matches"))


def typed(rows: DataFrame, kind: str) -> DataFrame:
    """Columns that operators compute with, parsed; ids and descriptive columns stay text, empty text becomes null."""
    parse = {
        "quantity": lenient_int, "original_amount": money, "discount_applied": money, "final_amount": lenient_double, "unit_price": money,
        "subtotal": money, "created_at": parse_timestamp, "user_id": normalise_user_id,
    }
    return rows.withColumns({c: parse.get(c, empty_to_null)(F.col(c)) for c in BY_KIND[kind].names})


def read_table(spark: SparkSession, folder: str, kind: str) -> DataFrame:
    """Good rows of a kind, typed, with file_path and line."""
    return typed(split_good_bad(read_raw(spark, folder, BY_KIND[kind]), BY_KIND[kind])[0], kind)


def read_grouped(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Saved aggregates or top users as input; the header must fit."""
    return spark.read.schema(schema).option("header", True).option("enforceSchema", False).csv(folder)


def is_grouped(df: DataFrame, *names: str) -> bool:
    """Whether a table is an aggregate already: it has all of ``names``."""
    return set(names) <= set(df.columns)


def read_unknown(spark: SparkSession, folder: str) -> DataFrame:
    """CSV files of one header that no schema is known for: its columns as text, file_path and line.

    The header is the first record of the first file by path; records equal to it go. Of columns of one name all but the first get
    a number, so do empty names. Records with fewer fields have nulls, and further fields are dropped.
    """
    records = read_records(spark, folder)
    first = records.where("line = 1").orderBy("file_path").select("value").head()
    if first is None:
        return records.drop("value")
    fields = next(csv.reader(io.StringIO(first.value, newline=""), doublequote=True))
    names: list[str] = []
    for i, name in enumerate(fields):
        clash = not name.strip() or name.lower() in {n.lower() for n in [*names, "file_path", "line", BAD]}
        names.append(f"{name.strip().replace('`', '')}_{i + 1}" if clash else name.replace("`", ""))
    rows = records.where(F.col("value") != first.value).select(parsed(F.col("value"), names).alias("_row"), "file_path", "line")
    return rows.select(*(F.col(f"_row.`{n}`") for n in names), "file_path", "line")


def made_id(prefix: str, digits: int = 6, cycle: int | None = None) -> Column:
    """An id from a row's place: prefix, file name and line, or with ``cycle`` the line in that cycle. Never cut, so longer numbers have more digits."""
    if cycle:
        return F.format_string(f"{prefix}_%0{digits}d", (F.col("line") - 2) % cycle + 1)
    return F.format_string(f"{prefix}_%s_%0{digits}d", F.element_at(F.split("file_path", "/"), -1), F.col("line") - 1)


Pattern = str | Sequence[str]


def _fits(pattern: Pattern, name: str) -> bool:
    """All words of a pattern are in a name, and none that it has with ``!``."""
    words = (pattern,) if isinstance(pattern, str) else pattern
    return all((w[1:] not in name) if w.startswith("!") else (w in name) for w in words)


def map_columns(df: DataFrame, wanted: dict[str, tuple[Sequence[Pattern], str, object]]) -> DataFrame:
    """A table of unknown header as a known one.

    ``wanted`` has for each column the patterns of names that may supply it, its type and a default, a value or a Column such as
    ``made_id``. A pattern is a word that the name holds, or several that it holds all, or doesn't where ``!`` stands in front. A column
    goes to the first of ``wanted`` that it fits; of several columns the last that has a value supplies it. Empty values, and values
    that don't fit the type, take the default.
    """
    supply: dict[str, list[str]] = {name: [] for name in wanted}
    for c in df.columns:
        if target := next((n for n, (patterns, _, _) in wanted.items() if any(_fits(p, c.lower()) for p in patterns)), None):
            supply[target].insert(0, c)
    chosen = []
    for name, (_, kind, default) in wanted.items():
        values = [empty_to_null(F.col(f"`{c}`").cast("string")).try_cast(kind) for c in supply[name]]
        other = default if isinstance(default, Column) else F.lit(default)
        chosen.append(F.coalesce(*values, other.cast(kind)).alias(name))
    return df.select(chosen)


def simulated_transactions(spark: SparkSession, n: int, start: str = "2024-01-01 00:00:00") -> DataFrame:
    """Transactions with values that repeat in cycles, for load tests."""
    i = F.col("id")
    price = F.lit(2.5) + (i % 20) * 0.25
    quantity = i % 5 + 1
    ts = (F.lit(start).cast("timestamp") - F.make_interval(mins=i.cast("int"))).cast("timestamp_ntz")
    return spark.range(n).select(
        F.format_string("TXN_%06d", i).alias("transaction_id"), ts.alias("created_at"), F.format_string("CUST_%05d", i % 1000).alias("user_id"),
        F.format_string("PROD_%03d", i % 10 + 1).alias("item_id"), quantity.alias("quantity"), price.alias("unit_price"),
        (price * quantity).alias("final_amount"), F.format_string("STORE_%02d", i % 10 + 1).alias("store_id"),
    )


def simulated_users(spark: SparkSession, n: int, first: int = 70_000) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        (i + first).alias("user_id"), F.when(i % 2 == 0, "male").otherwise("female").alias("gender"),
        F.format_string("19%02d-%02d-%02d", i % 50 + 50, i % 12 + 1, i % 28 + 1).alias("birthdate"),
        F.format_string("2024-04-%02d 10:00:00", i % 28 + 1).alias("registered_at"),
    )


def simulated_top_users(spark: SparkSession, n: int, first: int = 70_000) -> DataFrame:
    i = F.col("id")
    return spark.range(n).select(
        (i + first).alias("user_id"), F.format_string("STORE%03d", i % 50 + 1).alias("store_id"), (i % 100 + 1).alias("purchase_count"), (i % 10 + 1).cast("int").alias("rank")
    )
