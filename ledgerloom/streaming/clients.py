"""State per client: aggregates that are given once, when all of a client's chunks are there, and state that is freed then; bounded rankings.

State lives in RocksDB (``stateful`` sets the provider), so it isn't bounded by memory.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.columns import hash_bucket
from ..sources.scratch import ship_package

#: Chunk numbers of a file that one entry of state remembers, a bit for each.
BITS = 4096
LINEAGE = ("client_id", "file_id", "chunk_number", "is_last_chunk", "is_last_from_table")
NO_NUMBER = -1


def stateful(spark: SparkSession) -> None:
    """Before a stream of this module starts: state goes to RocksDB, and tasks can import this package."""
    ship_package(spark)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class ClientAggregates(StatefulProcessor):
    """One share of a client's groups. All shares get all of its chunks' notices, so each knows by itself when the client is whole."""

    def __init__(self, keys: Sequence[str], first: int, remember_ms: int | None):
        self.keys, self.first, self.remember_ms = list(keys), first, remember_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ", ".join(f"`{k}` string" for k in self.keys)
        self.groups = handle.getMapState("groups", names, "total double, count bigint")
        self.chunks = handle.getMapState("chunks", "file_id string, block bigint", "seen binary")
        self.files = handle.getMapState("files", "file_id string", "received bigint, last bigint, named bigint")
        # All that is left of a finished client, so that late chunks begin nothing anew.
        self.done = handle.getValueState("done", "finished boolean", self.remember_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        if self.done.exists():
            for _ in rows:
                pass
            return
        batch = pd.concat(list(rows), ignore_index=True)
        fresh = self._new_chunks(batch)
        # Of a chunk that was delivered twice at once, one delivery counts.
        part = batch.merge(fresh, on=["file_id", "chunk_number", "delivery"])
        part = part[~part["notice"]]
        if len(part):
            sums = part.groupby(self.keys, dropna=False, sort=False).agg(total=("total", "sum"), count=("count", "sum"))
            for name, row in sums.iterrows():
                group = tuple(None if pd.isna(v) else v for v in (name if isinstance(name, tuple) else (name,)))
                old = self.groups.getValue(group) if self.groups.containsKey(group) else (0.0, 0)
                self.groups.updateValue(group, (float(old[0] + row["total"]), int(old[1] + row["count"])))
        if self._whole():
            out = [(*k, v[0], v[1]) for k, v in self.groups.iterator()]
            for state in (self.groups, self.chunks, self.files):
                state.clear()
            self.done.update((True,))
            if out:
                yield pd.DataFrame(out, columns=[*self.keys, "total", "count"]).assign(client_id=key[0])[["client_id", *self.keys, "total", "count"]]

    def _new_chunks(self, batch: pd.DataFrame) -> pd.DataFrame:
        """file_id, chunk_number and delivery of the chunks that weren't seen before, which are so now."""
        heads = batch.sort_values("delivery").groupby(["file_id", "chunk_number"], as_index=False).agg(delivery=("delivery", "first"), last=("is_last_chunk", "max"), named=("is_last_from_table", "max"))
        out = []
        for file_id, mine in heads.groupby("file_id"):
            received, last, named = self.files.getValue((file_id,)) if self.files.containsKey((file_id,)) else (0, NO_NUMBER, NO_NUMBER)
            for block, some in mine.groupby(mine["chunk_number"] // BITS):
                place = (file_id, int(block))
                seen = bytearray(self.chunks.getValue(place)[0]) if self.chunks.containsKey(place) else bytearray(BITS // 8)
                for i, r in some.iterrows():
                    n = int(r["chunk_number"]) % BITS
                    if not seen[n // 8] >> n % 8 & 1:
                        seen[n // 8] |= 1 << n % 8
                        received += 1
                        out.append(i)
                self.chunks.updateValue(place, (bytes(seen),))
            if mine["last"].any():
                last = int(mine.loc[mine["last"], "chunk_number"].max())
            if mine["named"].any():
                digits = file_id[len(file_id.rstrip("0123456789")) :]
                named = int(digits) if digits else 1
            self.files.updateValue((file_id,), (received, last, named))
        return heads.loc[out, ["file_id", "chunk_number", "delivery"]]

    def _whole(self) -> bool:
        """All files have all chunks up to their last, and there are as many as the file flagged last says."""
        files = [v for _, v in self.files.iterator()]
        complete = sum(last != NO_NUMBER and received >= last - self.first + 1 for received, last, _ in files)
        named = max((n for _, _, n in files), default=NO_NUMBER)
        return named != NO_NUMBER and complete >= named

    def close(self) -> None:
        pass


def _partial(keys: Sequence[str], value: str):
    """Sums of what a task has of each chunk and group, so that a client with very many rows sends few."""
    by = [*LINEAGE, "delivery", "bucket", *keys]

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                yield batch.groupby(by, dropna=False, sort=False, as_index=False).agg(total=(value, "sum"), count=(value, "size"))

    return add


def client_aggregates(stream: DataFrame, keys: Sequence[str], value: str, buckets: int = 8, first: int = 1, remember: str | None = None) -> DataFrame:
    """client_id, ``keys``, total and count of each client, once, in the batch in which its last missing chunk arrives.

    Rows carry ``LINEAGE`` and come from files, each chunk in one file. A chunk that arrives again adds nothing, in the same batch or
    later; a finished client's state is freed but for a mark in each share, and what comes for it after that is discarded. With
    ``remember`` ("1 day") the marks go as well after that time; streams that are to end by themselves can't have it, for Spark then
    keeps running batches for the clock. Chunks count from ``first``; rows without client, file or chunk number are dropped. Groups are shared out to ``buckets`` tasks, so a client of
    any size is no hot task; notices of chunks, one for each, go to all of them.
    """
    stateful(stream.sparkSession)
    texts = [F.col(k).cast("string").alias(k) for k in keys]
    flags = [F.coalesce(F.col(c), F.lit(False)).alias(c) for c in LINEAGE[3:]]
    rows = stream.where("client_id IS NOT NULL AND file_id IS NOT NULL AND chunk_number IS NOT NULL").select(
        F.col("client_id").cast("string"), F.col("file_id").cast("string"), F.col("chunk_number").cast("bigint"), *flags, F.col("_metadata.file_path").alias("delivery"),
        hash_bucket(buckets, *texts).alias("bucket"), *texts, F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_value"),
    )
    schema = ", ".join(["client_id string", "file_id string", "chunk_number bigint", "is_last_chunk boolean", "is_last_from_table boolean", "delivery string", "bucket int", *(f"`{k}` string" for k in keys), "total double", "count bigint"])
    sums = rows.mapInPandas(_partial(keys, "_value"), schema)
    # A sum is a row for its own share and a notice for all shares.
    shares = F.array(*(F.struct(F.lit(i).alias("share"), (F.col("bucket") != i).alias("notice")) for i in range(buckets)))
    told = sums.withColumn("_to", F.explode(shares)).select("*", F.col("_to.share").alias("share"), F.col("_to.notice").alias("notice")).drop("_to", "bucket")
    own = [F.when(F.col("notice"), F.lit(None)).otherwise(F.col(k)).alias(k) for k in keys]
    told = told.select(*(c for c in told.columns if c not in keys), *own)
    ms = int(pd.Timedelta(remember).total_seconds() * 1000) if remember else None
    out = "client_id string, " + ", ".join(f"`{k}` string" for k in keys) + ", total double, count bigint"
    return told.groupBy("client_id", "share").transformWithStateInPandas(ClientAggregates(keys, first, ms), out, "Append", "ProcessingTime" if ms else "None")


TOP = ["store_id", "user_id", "count"]
#: Stores are dealt to so many keys of state, for each key costs a call of Python and of the state's server in every batch.
SHARES = 256
#: Rows that a task holds before it ranks them.
HELD_ROWS = 1 << 19


class TopUsers(StatefulProcessor):
    """The ``k`` users with the most purchases so far in each store of a share, and nothing else of it."""

    def __init__(self, k: int, store: str):
        self.k, self.store = k, store

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.best = handle.getListState("best", f"store_id {self.store}, user_id bigint, count bigint")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.best.get()) if self.best.exists() else []
        old = pd.DataFrame([tuple(r) for r in held], columns=TOP) if held else None
        # Ranking again before all is there keeps no more than a few rows a store.
        new = _ranked(_folded((b[TOP] for b in rows), self.k, old))
        if old is not None:
            now = new.merge(_ranked(old), how="left", on=[*TOP, "rank"], indicator=True)
            changed = new["store_id"].isin(now.loc[now["_merge"] == "left_only", "store_id"])
        else:
            changed = pd.Series(True, index=new.index)
        if changed.any():
            self.best.put(list(new[TOP].itertuples(index=False, name=None)))
            yield new[changed].rename(columns={"count": "purchase_count"})[["store_id", "user_id", "purchase_count", "rank"]]

    def close(self) -> None:
        pass


def _best(counts: pd.DataFrame, k: int) -> pd.DataFrame:
    """In each store the ``k`` users with the largest counts, each once, in order."""
    ordered = counts.sort_values(["store_id", "count", "user_id"], ascending=[True, False, True])
    return ordered.drop_duplicates(["store_id", "user_id"]).groupby("store_id", sort=False).head(k)


def _ranked(best: pd.DataFrame) -> pd.DataFrame:
    return best.assign(rank=(best.groupby("store_id", sort=False).cumcount() + 1).astype("int32"))


def _folded(batches: Iterator[pd.DataFrame], k: int, first: pd.DataFrame | None = None) -> pd.DataFrame:
    """The best of all batches, which are ranked whenever ``HELD_ROWS`` have come."""
    held, n = ([] if first is None else [first]), 0
    for batch in batches:
        held.append(batch)
        n += len(batch)
        if n >= HELD_ROWS:
            held, n = [_best(pd.concat(held, ignore_index=True), k)], 0
    return _best(pd.concat(held, ignore_index=True), k)


def streaming_top_users(counts: DataFrame, k: int = 3) -> DataFrame:
    """The users with the most purchases in each store as far as ``counts`` (user_id, store_id, count) have come, ranked from 1; stores
    whose ranking changed, in update mode.

    A user may come again with another count; the largest counts, so counts that grow are right, and none that is lowered. State
    is ``k`` rows a store, whatever has arrived, and stores share ``SHARES`` keys of it. A task sends ``k`` users of a store at most for
    each ``HELD_ROWS`` rows that it has read.
    """
    stateful(counts.sparkSession)
    store = counts.schema["store_id"].dataType.simpleString()

    def ahead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += len(batch)
            if n >= HELD_ROWS:
                best = _best(pd.concat(held, ignore_index=True), k)
                if len(best) > HELD_ROWS // 2:  # too many stores for a task to wait for more of each
                    yield best
                    best = best.head(0)
                held, n = [best], len(best)
        if n:
            yield _best(pd.concat(held, ignore_index=True), k)

    rows = counts.where("store_id IS NOT NULL AND user_id IS NOT NULL AND count IS NOT NULL")
    rows = rows.select("store_id", F.col("user_id").cast("bigint"), F.col("count").cast("bigint")).mapInPandas(ahead, f"store_id {store}, user_id bigint, count bigint")
    dealt = rows.withColumn("share", hash_bucket(SHARES, F.col("store_id"))).groupBy("share")
    best = dealt.transformWithStateInPandas(TopUsers(k, store), f"store_id {store}, user_id bigint, purchase_count bigint, rank int", "Update", "None")
    return best.withColumn("store_id", F.col("store_id").cast("string"))
