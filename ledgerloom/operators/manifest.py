"""Ingestion completeness: which chunks, files, clients and queries are complete, from a manifest table."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..sources.scratch import scratch_path


def number_chunks(rows: DataFrame, file_keys: Sequence[str], order: Sequence[str], size: int = 1000) -> DataFrame:
    """``rows`` with row_number and chunk_number (from 1) in each file, by ``order``, which should tell all rows of a file apart.

    Rows are dealt to ranges of that order and written once; a range is numbered by itself and begins where the counts of those
    before it end, so a file of any size is spread over tasks.
    """
    spark = rows.sparkSession
    path = scratch_path(spark, "ranges")
    dealt = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), *file_keys, *order)
    dealt.withColumn("_range", F.spark_partition_id()).write.parquet(path)
    dealt = spark.read.schema(T.StructType([*rows.schema.fields, T.StructField("_range", T.IntegerType())])).parquet(path)
    before = Window.partitionBy(*file_keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = dealt.groupBy(*file_keys, "_range").agg(F.count("*").alias("_n"))
    firsts = counts.select(*(F.col(k).alias(f"_{k}") for k in file_keys), F.col("_range").alias("_r"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in file_keys), F.col("_range") == F.col("_r"))
    w = Window.partitionBy(*file_keys, "_range").orderBy(*order)
    numbered = dealt.withColumn("_i", F.row_number().over(w)).join(firsts, same).withColumn("row_number", (F.col("_i") + F.col("_before")).cast("int"))
    numbered = numbered.select(*rows.columns, "row_number")
    return numbered.withColumn("chunk_number", F.ceil(F.col("row_number") / size).cast("int"))


def chunk_manifest(numbered: DataFrame, file_keys: Sequence[str]) -> DataFrame:
    """One row per chunk: rows, and whether it is the last of its file."""
    chunks = numbered.groupBy(*file_keys, "chunk_number").agg(F.count("*").alias("n_rows"))
    w = Window.partitionBy(*file_keys)
    return chunks.withColumn("is_last_chunk", F.col("chunk_number") == F.max("chunk_number").over(w))


def manifest_of(rows: DataFrame, file_keys: Sequence[str], size: int = 1000) -> DataFrame:
    """The same table from counts alone, as ``number_chunks`` would deal the rows: they are grouped once and never numbered."""
    per = rows.groupBy(*file_keys).agg(F.count("*").alias("_n"))
    chunks = F.explode(F.sequence(F.lit(1), F.ceil(F.col("_n") / size).cast("int"))).alias("chunk_number")
    last = F.col("chunk_number") * size >= F.col("_n")
    found = per.select(*file_keys, "_n", chunks)
    return found.select(*file_keys, "chunk_number", F.when(last, F.col("_n") - (F.col("chunk_number") - 1) * size).otherwise(F.lit(size)).cast("bigint").alias("n_rows"), last.alias("is_last_chunk"))


#: The number in a file id: the digits at its end, after the code.
FILE_NUMBER = "try_cast(regexp_extract(file_id, '([0-9]+)$', 1) AS INT)"


#: Chunk numbers of a file that are looked at together.
BLOCK = 4096


def file_completeness(manifest: DataFrame, first: int = 1) -> DataFrame:
    """A file is complete when its last chunk was seen and every number from ``first`` up to it. Repeated notices count once, and
    numbers outside the range not at all; ``received`` counts those inside, or all as long as the last isn't known."""
    keys = ["client_id", "file_id", "table_id"]
    once = manifest.groupBy(*keys, "chunk_number").agg(F.max("is_last_chunk").alias("last"), F.max("is_last_from_table").alias("last_file"))
    # Numbers beyond the last are a fault of the sender. Distinct numbers are counted by blocks of them, so that one pass tells, once the
    # last is known, how many lie below it: those of lower blocks, and those of its own block, whose numbers are at hand.
    number = F.col("chunk_number")
    blocks = once.withColumn("_block", F.floor(number / BLOCK)).groupBy(*keys, "_block").agg(
        F.max(F.when(F.col("last"), number)).alias("last_chunk"), F.max(F.when(F.col("last_file"), F.expr(FILE_NUMBER))).alias("files_named"), F.collect_list(F.when(number >= first, number)).alias("numbers")
    )
    # Of the numbers themselves only those of the block that holds the last are kept.
    mine = F.max_by(F.when(F.col("last_chunk").isNotNull(), F.col("numbers")), F.coalesce("last_chunk", F.lit(-1)))
    per = blocks.groupBy(*keys).agg(F.max("last_chunk").alias("last_chunk"), F.max("files_named").alias("files_named"), F.collect_list(F.struct("_block", F.size("numbers").alias("n"))).alias("sizes"), mine.alias("mine"))
    lower = F.aggregate(F.filter("sizes", lambda b: F.coalesce(b["_block"] < F.floor(F.col("last_chunk") / BLOCK), F.lit(True))), F.lit(0), lambda a, b: a + b["n"])
    inside = F.when(F.col("last_chunk").isNotNull(), F.size(F.filter("mine", lambda c: c <= F.col("last_chunk")))).otherwise(F.lit(0))
    found = per.withColumn("received", (lower + inside).cast("bigint"))
    complete = F.coalesce(F.col("received") == F.col("last_chunk") - first + 1, F.lit(False))
    return found.select(*keys, "received", "last_chunk", "files_named", complete.alias("complete"))


def expected_files(manifest: DataFrame) -> DataFrame:
    """Files that a client sends of each table: the number in the name of the one flagged last, else 1."""
    named = F.max(F.when(F.col("is_last_from_table"), F.expr(FILE_NUMBER)))
    return manifest.groupBy("client_id", "table_id").agg(F.coalesce(named, F.lit(1)).alias("expected_files"))


def client_completeness(manifest: DataFrame, first: int = 1) -> DataFrame:
    """Per client and table: complete files against expected ones."""
    done = file_completeness(manifest, first).groupBy("client_id", "table_id").agg(
        F.count_if("complete").alias("complete_files"), F.coalesce(F.max("files_named"), F.lit(1)).alias("expected_files")
    )
    return done.withColumn("complete", F.col("complete_files") >= F.col("expected_files"))


def query_completeness(done: DataFrame, queries: int = 4) -> DataFrame:
    """``done`` has client_id, query, complete; a client is complete when all its queries are."""
    per = done.groupBy("client_id").agg(F.count_distinct(F.when(F.col("complete"), F.col("query"))).alias("complete_queries"))
    return per.withColumn("complete", F.col("complete_queries") >= queries)


def missing_partitions(received: DataFrame, partitions: int, column: str = "partition") -> DataFrame:
    """Numbers below ``partitions`` that ``received`` doesn't have."""
    spark: SparkSession = received.sparkSession
    return spark.range(partitions).select(F.col("id").cast("int").alias(column)).join(received.select(F.col(column).cast("int").alias(column)), column, "left_anti")
