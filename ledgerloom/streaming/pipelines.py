"""Structured Streaming versions: duplicates, filters, aggregates, rankings, joins and late data.

Aggregates run in complete mode and are published whole, a version for each batch, so running a batch again after a
failure leaves the same result and readers never see half of one. Aggregates that are given once per client are in ``clients``. With the ``availableNow`` trigger a query ends with the answer at the end of the input.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.types import StructType

from ..operators.aggregates import aggregate
from ..operators.ranking import top_users
from ..sources.scratch import remove, scratch_path

#: Versions of a published table that stay.
KEPT_VERSIONS = 3


def file_stream(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt)
    return (reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader).load(path)


def drop_redelivered(stream: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Each key once, however often it arrives. State grows with the keys; use ``drop_redelivered_within`` where time bounds it."""
    return stream.dropDuplicates(list(keys))


def drop_redelivered_within(stream: DataFrame, keys: Sequence[str], ts: str, delay: str = "1 hour") -> DataFrame:
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark(list(keys))


def streaming_aggregate(stream: DataFrame, query: int, by: Sequence[str] = ()) -> DataFrame:
    return aggregate(stream, query, by)


def running_sum(stream: DataFrame, keys: Sequence[str], client: str, value: str, expected: int) -> DataFrame:
    """Sum per client over distinct chunks, given once ``expected`` of them have arrived."""
    once = drop_redelivered(stream.select(*dict.fromkeys([*keys, client, value])), keys)
    return once.groupBy(client).agg(F.sum(value).alias("total"), F.count("*").alias("chunks")).where(F.col("chunks") >= expected)


def with_static(stream: DataFrame, dim: DataFrame, key: str, how: str = "left") -> DataFrame:
    return stream.join(dim, key, how)


def without_finished(batch: DataFrame, finished: DataFrame, client: str = "client_id") -> DataFrame:
    """Drop rows of clients that are finished; for use inside foreachBatch, where the table of finished clients is current."""
    return batch.join(finished.select(client), client, "left_anti")


def append_run(stream: DataFrame, out: str, checkpoint: str, per_batch: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run to the end of what is there, appending to ``out``. Each batch has a folder, so a repeated batch replaces itself."""

    def store(batch: DataFrame, number: int) -> None:
        (per_batch(batch) if per_batch else batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def publish(rows: DataFrame, out: str, version: int) -> None:
    """Write ``rows`` as a version of the table at ``out`` and then, in a row of its own, that it is there.

    Nothing that a reader may be at is touched: until the second write commits, and if it never does, ``read_published`` gives the
    version before. Writing a version again replaces it.
    """
    rows.write.mode("overwrite").parquet(f"{out}/versions/v{version}")
    pointer = rows.sparkSession.createDataFrame([(version,)], "version bigint")
    pointer.coalesce(1).write.mode("overwrite").parquet(f"{out}/published/v{version}")
    # The version before stays for its readers; those further back go as far as can be.
    remove(f"{out}/versions/v{version - KEPT_VERSIONS}")


def read_published(spark: SparkSession, out: str) -> DataFrame:
    """The newest whole version."""
    newest = spark.read.schema("version bigint").option("recursiveFileLookup", True).parquet(f"{out}/published").agg(F.max("version")).first()[0]
    if newest is None:
        raise ValueError(f"nothing is published in {out}")
    return spark.read.parquet(f"{out}/versions/v{newest}")


def complete_run(aggregated: DataFrame, out: str, checkpoint: str, per_batch: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Run to the end of what is there; ``read_published(out)`` has the whole aggregate as of the last batch, ranked or joined by ``per_batch``."""

    def store(batch: DataFrame, number: int) -> None:
        publish(per_batch(batch) if per_batch else batch, out, number)

    aggregated.writeStream.outputMode("complete").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


class CounterTable(StreamingQueryListener):
    """Counters of a stream, from ``observe``, as a table: query, batch, step, counter and value, a folder for each batch of a query.

    A batch that is run again replaces its folder, so sums are right after a restart. Use it as a context around the runs.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.running = spark, path, 0
        self.ended = threading.Condition()

    def __enter__(self) -> CounterTable:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *error) -> None:
        """Wait for what the streams that have ended still report."""
        with self.ended:
            self.ended.wait_for(lambda: self.running == 0, timeout=60)
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        with self.ended:
            self.running += 1

    def onQueryProgress(self, event) -> None:
        p = event.progress
        rows = [(str(p.id), p.batchId, step, name, int(value)) for step, seen in p.observedMetrics.items() for name, value in seen.asDict().items() if value is not None]
        if rows:
            table = self.spark.createDataFrame(rows, "query string, batch bigint, step string, counter string, value bigint")
            table.coalesce(1).write.mode("overwrite").parquet(f"{self.path}/{p.id}-{p.batchId}")

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.ended:
            self.running -= 1
            self.ended.notify_all()

    def read(self) -> DataFrame:
        return self.spark.read.schema("query string, batch bigint, step string, counter string, value bigint").option("recursiveFileLookup", True).parquet(self.path)


def with_stream_counters(stream: DataFrame, step: str, **conditions: Column) -> DataFrame:
    """A stream that counts its rows, and those for which each condition holds, in each batch."""
    return stream.observe(step, F.count(F.lit(1)).alias("rows"), *(F.count_if(c).alias(k) for k, c in conditions.items()))


def upsert_run(aggregated: DataFrame, keys: Sequence[str], out: str, checkpoint: str) -> None:
    """Update mode: each batch has the groups that changed; batch folders are kept and ``read_upserted`` takes the newest row."""

    def store(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/from_batch={number}")

    aggregated.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def read_upserted(spark: SparkSession, out: str, keys: Sequence[str]) -> DataFrame:
    rows = spark.read.parquet(out).drop("from_batch")
    values = [c for c in rows.columns if c not in keys]
    newest = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("v"))
    return newest.select(*keys, *(F.col(f"v.{c}").alias(c) for c in values if c != "_batch"))


def run_and_read(stream: DataFrame, mode: str = "append", per_batch: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Run a stream over what is there and return its result as a table."""
    spark = stream.sparkSession
    out, checkpoint = scratch_path(spark, "stream-out"), scratch_path(spark, "stream-checkpoint")
    (append_run if mode == "append" else complete_run)(stream, out, checkpoint, per_batch)
    return spark.read.parquet(out).drop("batch") if mode == "append" else read_published(spark, out)


def rank_batch(k: int = 3) -> Callable[[DataFrame], DataFrame]:
    """For foreachBatch on complete counts: a ranking can't be a window on a stream."""
    return lambda counts: top_users(counts, k=k)
