"""Streams: duplicates, restarts, upserts, finished clients."""

from pyspark.sql import functions as F

from support import DATA
from ledgerloom.operators.aggregates import aggregate
from ledgerloom.streaming import pipelines as S

KEYS = ["user_id", "event_type"]


def rows(df):
    return sorted(map(tuple, df.collect()))


def counts(df):
    return df.groupBy(*KEYS).agg(F.count("*").alias("n"))


def test_restart_continues_with_the_same_answer(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck"))
    events.where("event_id % 2 = 0").repartition(3).write.parquet(f"{src}/a")

    def run():
        stream = S.file_stream(spark, f"{src}/*", events.schema, files_per_trigger=1)
        S.complete_run(counts(S.drop_redelivered(stream, ["event_id"])), out, ck)

    run()
    assert rows(S.read_published(spark, out)) == rows(counts(events.where("event_id % 2 = 0")))
    events.where("event_id % 2 = 1 OR event_id % 10 = 0").repartition(2).write.parquet(f"{src}/b")  # some of them again
    run()
    assert rows(S.read_published(spark, out)) == rows(counts(events))


def test_update_mode_needs_an_upsert(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck"))
    events.repartition(4).write.parquet(src)
    S.upsert_run(counts(S.file_stream(spark, src, events.schema, files_per_trigger=1)), KEYS, out, ck)
    assert spark.read.parquet(out).count() > counts(events).count()
    assert rows(S.read_upserted(spark, out, KEYS).select(*KEYS, "n")) == rows(counts(events))


def test_bounded_duplicate_removal(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    twice = events.unionByName(events.where("event_id % 3 = 0"))
    twice.coalesce(1).write.parquet(f"file://{tmp_path}/src")
    stream = S.drop_redelivered_within(S.file_stream(spark, f"file://{tmp_path}/src", events.schema).withColumn("ts", F.col("ts").cast("timestamp")), ["event_id"], "ts", "60 days")
    assert rows(S.run_and_read(stream.select("event_id"))) == rows(events.select("event_id"))


def test_running_sum_waits_for_all_chunks(spark, tmp_path):
    data = [("CLI1", n, 10) for n in (1, 2, 3, 3)] + [("CLI2", n, 20) for n in (1, 1)]
    df = spark.createDataFrame(data, "client_id string, chunk_number int, value long")
    df.repartition(3).write.parquet(f"file://{tmp_path}/src")
    found = S.run_and_read(S.running_sum(S.file_stream(spark, f"file://{tmp_path}/src", df.schema), ["client_id", "chunk_number"], "client_id", "value", 3), "complete")
    assert rows(found) == [("CLI1", 30, 3)]


def test_streaming_aggregate_equals_batch(spark):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet").withColumn("store_id", F.col("event_type"))
    stream = S.file_stream(spark, f"{DATA}/sf0.001/event[s].parquet", events.drop("store_id").schema).withColumn("store_id", F.col("event_type"))
    assert rows(S.run_and_read(S.streaming_aggregate(stream, 4), "complete")) == rows(aggregate(events, 4))


LINEAGE = "client_id string, file_id string, chunk_number int, is_last_chunk boolean, is_last_from_table boolean, store_id string, amount double"


def chunk_rows(client, file, chunk, last=False, named=False, rows=((None, 1.0),)):
    return [(client, file, chunk, last, named, s, a) for s, a in rows]


def test_one_answer_per_client_when_it_is_whole(spark, tmp_path):
    """Late, repeated and doubled chunks; clients that end in different batches; state that is freed."""
    from ledgerloom.streaming.clients import client_aggregates

    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck"))
    n = 0

    def run(*chunks):
        nonlocal n
        for c in chunks:
            n += 1
            spark.createDataFrame(c, LINEAGE).coalesce(1).write.parquet(f"{src}/f{n}")
        stream = S.file_stream(spark, f"{src}/*", spark.createDataFrame([], LINEAGE).schema)
        q = client_aggregates(stream, ["store_id"], "amount", buckets=3).writeStream.outputMode("append").format("parquet").option("path", out).option("checkpointLocation", ck).trigger(availableNow=True).start()
        q.awaitTermination()
        progress = [p for p in q.recentProgress if p.stateOperators]
        return progress[-1].stateOperators[0].numRowsTotal if progress else None

    def answers():
        try:
            return sorted(tuple(r) for r in spark.read.schema("client_id string, store_id string, total double, count bigint").parquet(out).collect())
        except Exception:  # nothing written yet
            return []

    a1, a2 = chunk_rows("01", "TR01", 1, rows=[("x", 1.0), ("y", 2.0)]), chunk_rows("01", "TR01", 2, True, rows=[("x", 3.0)])
    a3, b1 = chunk_rows("01", "TR02", 1, True, True, rows=[("z", 5.0), ("x", 1.0)]), chunk_rows("1", "TR01", 1, True, True, rows=[("x", 9.0)])
    held = run(a1, a1, a3)
    assert answers() == [] and held > 3
    run(b1, a1)
    assert answers() == [("1", "x", 9.0, 1)]
    run(a2)
    assert answers() == [("01", "x", 5.0, 3), ("01", "y", 2.0, 1), ("01", "z", 5.0, 1), ("1", "x", 9.0, 1)]
    run(a2, a3, b1)  # late
    assert len(answers()) == 4
    assert run(chunk_rows("1", "TR07", 1)) == 6 and len(answers()) == 4  # a mark for each client and share


def test_ranking_state_is_bounded(spark, tmp_path):
    from ledgerloom.streaming.clients import streaming_top_users

    src, out, ck = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck"))
    full = spark.range(600).selectExpr("concat('s', id % 4) AS store_id", "id * 7919 % 97 AS user_id", "id * 31 % 50 + 1 AS count")
    for i in range(3):
        full.where(f"count % 3 = {i}").coalesce(1).write.parquet(f"{src}/f{i}")
    S.upsert_run(streaming_top_users(S.file_stream(spark, f"{src}/*", full.schema, files_per_trigger=1)), ["store_id", "rank"], out, ck)
    most = full.groupBy("store_id", "user_id").agg(F.max("count").alias("count"))
    from ledgerloom.operators.ranking import top_users

    want = top_users(most).select("store_id", "user_id", "purchase_count", "rank")
    assert rows(S.read_upserted(spark, out, ["store_id", "rank"]).select(want.columns)) == rows(want)


def test_readers_see_the_version_before_until_the_next_is_whole(spark, tmp_path):
    import pytest

    out = f"file://{tmp_path}/out"
    S.publish(spark.range(3), out, 0)
    broken = spark.range(5).selectExpr("IF(id = 4, raise_error('stop'), id) AS id")
    with pytest.raises(Exception):
        S.publish(broken, out, 1)
    assert S.read_published(spark, out).count() == 3
    spark.range(9).write.parquet(f"{out}/versions/v1", mode="overwrite")  # written, but the run was ended before it said so
    assert S.read_published(spark, out).count() == 3
    S.publish(spark.range(4), out, 1)
    assert S.read_published(spark, out).count() == 4
    for v in range(2, 6):
        S.publish(spark.range(v), out, v)
    assert S.read_published(spark, out).count() == 5 and sorted(p.name for p in (tmp_path / "out/versions").iterdir()) == ["v3", "v4", "v5"]


def test_stream_counters_are_those_of_the_batch(spark, tmp_path):
    events = spark.read.parquet(f"{DATA}/sf0.001/events.parquet")
    src, out, ck, table = (f"file://{tmp_path}/{n}" for n in ("src", "out", "ck", "counters"))
    with S.CounterTable(spark, table) as counters:
        for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")):
            part.repartition(2).write.mode("append").parquet(src)
            stream = S.with_stream_counters(S.file_stream(spark, src, events.schema, files_per_trigger=1), "in", large=F.col("value") >= 75)
            S.append_run(stream, out, ck)
    found = {r.counter: r.v for r in counters.read().groupBy("counter").agg(F.sum("value").alias("v")).collect()}
    assert found == {"rows": events.count(), "large": events.where("value >= 75").count()} and counters.read().select("batch").distinct().count() >= 4


def test_many_stores_are_few_keys_of_state(spark, tmp_path):
    from ledgerloom.operators.ranking import top_users
    from ledgerloom.streaming import clients

    src, ck, got = f"file://{tmp_path}/src", f"file://{tmp_path}/ck", []
    full = spark.range(9000).selectExpr("id % 1500 AS store_id", "id * 7919 % 97 AS user_id", "id * 31 % 50 + 1 AS count")
    for i in range(2):
        full.where(f"count % 2 = {i}").coalesce(1).write.mode("append").parquet(src)
    stream = clients.streaming_top_users(S.file_stream(spark, src, full.schema, files_per_trigger=1))

    def store(batch, number):
        got.append({(r.store_id, r["rank"]): (r.user_id, r.purchase_count) for r in batch.collect()})

    run = stream.writeStream.outputMode("update").foreachBatch(store).option("checkpointLocation", ck).trigger(availableNow=True).start()
    run.awaitTermination()
    best = top_users(full.groupBy("store_id", "user_id").agg(F.max("count").alias("count")))
    assert {k: v for g in got for k, v in g.items()} == {(str(r.store_id), r["rank"]): (r.user_id, r.purchase_count) for r in best.collect()}
    assert run.lastProgress["stateOperators"][0]["numRowsTotal"] <= 2 * clients.SHARES
