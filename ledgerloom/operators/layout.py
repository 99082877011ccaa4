"""How rows are dealt to buckets and partitions, in memory and on disk."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..functions.columns import hash_bucket

#: How this module writes and reads CSV.
_CSV = {"header": True, "escape": '"', "nullValue": "", "emptyValue": '""'}


def bucket_owner(df: DataFrame, bucket: str, workers: int) -> DataFrame:
    return df.withColumn("worker", F.col(bucket) % workers)


def bucket_balance(df: DataFrame, buckets: int, *keys: str) -> DataFrame:
    """Rows per bucket of a composite key."""
    return df.groupBy(hash_bucket(buckets, *(F.col(k) for k in keys)).alias("bucket")).agg(F.count("*").alias("n_rows"))


def write_buckets(df: DataFrame, path: str, key: str, buckets: int, by: Sequence[str] = ("client_id",), mode: str = "overwrite", fmt: str = "csv") -> None:
    """One folder per client and bucket of ``key``; rows are dealt first, so that a bucket is written by one task."""
    placed = df.withColumn("bucket", hash_bucket(buckets, F.col(key)))
    placed.repartition(*by, "bucket").write.mode(mode).options(**_CSV if fmt == "csv" else {}).partitionBy(*by, "bucket").format(fmt).save(path)


def read_stored(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", partition_by: Sequence[str] = ()) -> DataFrame:
    """A stored table under the types of ``schema``, those of its folders' values too, so that an id such as ``01`` stays what it is.

    No rows if nothing is stored yet. In the names of folders an empty text and null are one, so an empty id comes back as null.
    """
    try:
        return spark.read.schema(schema).format(fmt).options(**_CSV if fmt == "csv" else {}).load(path).select(schema.names)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def _empty_as_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Folders can't tell an empty text from null, so keys that name folders don't either."""
    kinds = dict(df.dtypes)
    return df.withColumns({c: F.nullif(F.col(c), F.lit("")) for c in columns if kinds[c] == "string"}) if columns else df


def append_missing(new: DataFrame, path: str, keys: Sequence[str] = ("chunk_id", "row_number"), fmt: str = "parquet", partition_by: str | Sequence[str] = ()) -> int:
    """Append the rows of ``new`` whose keys aren't stored yet; returns how many. Delivering a batch again adds nothing.

    Null keys are equal to null keys. With ``partition_by``, one or more of the keys, the table has a folder for each of their
    values, and only the folders of the batch's values are read; an empty text there is stored as null. Stored values come back under
    the types of ``new``, whatever they look like.
    """
    spark, folders = new.sparkSession, [partition_by] if isinstance(partition_by, str) else list(partition_by)
    fresh = _empty_as_null(new, folders).dropDuplicates(list(keys))
    stored = read_stored(spark, path, new.schema, fmt).select(*(F.col(k).alias(f"_{k}") for k in keys))
    if folders:
        here = fresh.select(*(F.col(k).alias(f"_here_{k}") for k in folders)).distinct()
        stored = stored.join(here, reduce(lambda a, b: a & b, (F.col(f"_{k}").eqNullSafe(F.col(f"_here_{k}")) for k in folders)), "left_semi")
    fresh = fresh.join(stored, reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys)), "left_anti")
    fresh = fresh.persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").partitionBy(*folders).options(**_CSV if fmt == "csv" else {}).format(fmt).save(path)
        return n
    finally:
        fresh.unpersist()


def replace_partitions(new: DataFrame, path: str, partition_by: Sequence[str], fmt: str = "parquet") -> None:
    """Store the batch in place of what its folders hold; folders that it has no rows for stay as they are.

    For chunks that are always delivered whole: sent again, a chunk replaces itself, and nothing stored has to be read. The
    folders change when the job commits, so a batch that fails leaves the former rows.
    """
    rows = _empty_as_null(new, partition_by)
    rows.repartition(*partition_by).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*partition_by).options(**_CSV if fmt == "csv" else {}).format(fmt).save(path)


def drop_client(path: str, spark: SparkSession, client_id: str | None, schema: StructType, column: str = "client_id", fmt: str = "parquet", partition_by: Sequence[str] = ()) -> int:
    """Remove a finished client's rows from a stored table whose first folders are those of clients; returns how many rows went.

    The client's partition is overwritten with no rows, through Spark's own writer, so it works wherever Spark can open the path;
    ``schema`` says what ids are, so ``01`` isn't ``1``. Null removes the rows without client. A client without rows removes nothing.
    """
    folders = list(partition_by) or [column]
    gone = read_stored(spark, path, schema, fmt).where(F.col(column).eqNullSafe(F.lit(client_id).cast(schema[column].dataType))).count()
    if not gone:
        return 0
    table, view = f"stored_{uuid.uuid4().hex}", f"nothing_{uuid.uuid4().hex}"
    columns = [*(f for f in schema.fields if f.name not in folders), *(schema[c] for c in folders)]
    named = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in columns)
    spark.sql(f"CREATE TABLE {table} ({named}) USING {fmt} PARTITIONED BY ({', '.join(f'`{c}`' for c in folders)}) LOCATION :path", {"path": path})
    try:
        spark.createDataFrame([], StructType([f for f in columns if f.name != column])).createOrReplaceTempView(view)
        rest = "".join(f", `{c}`" for c in folders[1:])
        spark.sql(f"INSERT OVERWRITE TABLE {table} PARTITION (`{column}` = :client{rest}) SELECT * FROM {view}", {"client": client_id})
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {table}")  # the rows are not the table's own and stay
        spark.catalog.dropTempView(view)
        spark.catalog.refreshByPath(path)
    return gone
