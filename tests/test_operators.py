"""Operators one by one: parsing, predicates, counters, manifests, layouts, comparison, plans."""

import contextlib
import io

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from support import DATA
from ledgerloom.functions import columns as C
from ledgerloom.functions import predicates as P
from ledgerloom.operators import compare as CMP
from ledgerloom.operators import layout as L
from ledgerloom.operators import manifest as M
from ledgerloom.operators.aggregates import aggregate, sorted_by_keys, with_counters
from ledgerloom.operators.joins import broadcast_below, co_partitioned_join, first_wins, last_wins, one_input_many_queries
from ledgerloom.plans.queries import QUERIES


def plan(df):
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("formatted")
    return out.getvalue()


def values(spark, texts, f):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", f(F.col("t")).alias("v"))
    return [r.v for r in df.orderBy("i").collect()]


def test_numbers(spark):
    assert values(spark, ["5", "+5", "5.0", "", " 7 ", "abc", None], C.lenient_int) == [5, 5, None, None, 7, None, None]
    assert values(spark, ["75", "75d", "NaN", "1e2", ".5", "", "x"], C.lenient_double) == [75.0, None, None, 100.0, 0.5, None, None]
    assert values(spark, ["123", "123.0", " 7.0", "7.5", ""], C.normalise_user_id) == [123, 123, 7, None, None]


def test_times(spark):
    ok = values(spark, ["2024-01-01 06:00:00", "2024-01-01 6:00:00", "2024-01-01 06:00:00.5", "2024-01-01", "x"], C.parse_timestamp)
    assert [v is not None for v in ok] == [True, True, True, False, False]
    ok = values(spark, ["2024-01-01 06:00:00", "2024-01-02", "2024/01/03 06:00:00", "2024/01/04", "05.01.2024"], C.parse_date)
    assert [v and v.day for v in ok] == [1, 2, 3, 4, None]


def test_times_are_those_of_the_text_in_any_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "Europe/Berlin")
    try:
        df = spark.createDataFrame([("2024-03-31 02:30:00", "2024/03/31 02:30:00")], "a string, b string")
        assert [str(v) for v in df.select(C.parse_timestamp(F.col("a")).cast("string"), C.parse_date(F.col("b")).cast("string")).first()] == ["2024-03-31 02:30:00"] * 2
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_rows_of_a_key_are_picked_without_a_sort(spark):
    df = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, None, "z"), (2, None, "n"), (None, 1, "x"), (None, 3, "y")], "k int, pos int, v string")
    assert {(r.k, r.v) for r in last_wins(df, ["k"], ["pos"]).collect()} == {(1, "b"), (2, "n"), (None, "y")}
    assert {(r.k, r.v) for r in first_wins(df, ["k"], ["pos"]).collect()} == {(1, "z"), (2, "n"), (None, "x")}
    text = plan(last_wins(df, ["k"], ["pos"]))
    assert "Window" not in text and text.split("\n\n")[0].count("Exchange (") == 1


def test_nan_does_not_pass(spark):
    df = spark.createDataFrame([(75.0,), (74.99,), (float("nan"),), (None,)], "a double")
    assert [r.a for r in df.where(P.at_least(F.col("a"))).collect()] == [75.0]


def test_kinds(spark):
    df = spark.createDataFrame([("TR",), ("US",), ("MN",)], "k string")
    assert df.where(P.is_fact(F.col("k"))).count() == 1 and df.where(P.is_dimension(F.col("k"))).count() == 2 and df.where(P.is_users(F.col("k"))).count() == 1


def test_buckets(spark):
    df = spark.range(-10, 1000).select(C.hash_bucket(7, F.col("id")).alias("b"), C.modulo_bucket(F.col("id"), 100).alias("m"))
    assert {r.b for r in df.select("b").distinct().collect()} == set(range(7))
    assert df.where("m = -1").count() == 1


def test_counters(spark):
    df, seen = with_counters(spark.range(10), "step", even=F.col("id") % 2 == 0)
    assert df.count() == 10 and seen.get == {"rows": 10, "even": 5}


def test_sorted_output(spark):
    df = spark.createDataFrame([(2, "b"), (1, "a"), (1, "a")], "user_id int, store_id string")
    assert [(r.user_id, r["count"]) for r in sorted_by_keys(aggregate(df, 4), 4).collect()] == [(1, 2), (2, 1)]


def test_completeness_needs_every_number(spark):
    lost = [("x", "TR120", 1, n, n == 3, n == 3) for n in (0, 1, 3)]
    m = spark.createDataFrame(lost, "client_id string, file_id string, table_id int, chunk_number int, is_last_chunk boolean, is_last_from_table boolean")
    assert not M.file_completeness(m, 0).first().complete and M.file_completeness(m.unionByName(m.limit(1).withColumn("chunk_number", F.lit(2))), 0).first().complete
    assert M.expected_files(m).first().expected_files == 120
    beyond = m.where("chunk_number <> 0").unionByName(m.limit(1).withColumn("chunk_number", F.lit(7)))
    assert [M.file_completeness(beyond, f).first().received for f in (0, 1)] == [2, 2] and not M.file_completeness(beyond, 1).first().complete
    rows = [("c", "TR01", 1, n, n == 3, n == 3) for n in (1, 3, 3)] + [("d", "TR01", 1, n, n == 2, False) for n in (1, 2)] + [("e", "TR01", 1, 1, False, False)]
    m = spark.createDataFrame(rows, "client_id string, file_id string, table_id int, chunk_number int, is_last_chunk boolean, is_last_from_table boolean")
    assert {r.client_id: r.complete for r in M.file_completeness(m).collect()} == {"c": False, "d": True, "e": False}
    assert {r.client_id: r.complete for r in M.client_completeness(m).collect()} == {"c": False, "d": True, "e": False}


def test_append_is_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("a", 2, 6)], "chunk_id string, row_number int, v int")
    path = f"file://{tmp_path}/t"
    assert [L.append_missing(rows, path), L.append_missing(rows, path)] == [2, 0]
    assert L.append_missing(rows.unionByName(rows.withColumn("row_number", F.col("row_number") + 2)), path) == 2
    assert spark.read.parquet(path).count() == 4
    odd = spark.createDataFrame([("a", None, 5), (None, 1, 6), (None, None, 7)], "chunk_id string, row_number int, v int")
    assert [L.append_missing(odd, path), L.append_missing(odd, path)] == [3, 0] and spark.read.parquet(path).count() == 7


def test_append_reads_only_the_batchs_chunks(spark, tmp_path):
    rows = spark.createDataFrame([("a", 1, 5), ("b", 1, 6), (None, 1, 7)], "chunk_id string, row_number int, v int")
    path = f"file://{tmp_path}/t"
    assert [L.append_missing(rows.limit(1), path, partition_by="chunk_id"), L.append_missing(rows, path, partition_by="chunk_id"), L.append_missing(rows, path, partition_by="chunk_id")] == [1, 2, 0]


def test_bucket_files_and_finished_clients(spark, tmp_path):
    rows = spark.range(100).select(F.concat(F.lit("CLI"), F.col("id") % 2).alias("client_id"), F.col("id").alias("user_id"))
    path = f"file://{tmp_path}/b"
    L.write_buckets(rows, path, "user_id", 8, fmt="parquet")
    stored = spark.read.parquet(path)
    assert CMP.misplaced_rows(rows, stored, "bucket", "user_id", 8).count() == 0
    moved = stored.withColumn("bucket", F.when(F.col("user_id") == 5, (F.col("bucket") + 1) % 8).otherwise(F.col("bucket")))
    assert [r.user_id for r in CMP.misplaced_rows(rows, moved, "bucket", "user_id", 8).collect()] == [5]
    assert L.drop_client(path, spark, "CLI0", stored.schema, partition_by=["client_id", "bucket"]) == 50
    assert {r.client_id for r in spark.read.parquet(path).select("client_id").distinct().collect()} == {"CLI1"}
    odd = ["a b/c:1", "../b", "x%2Fy", "plain", "é=?"]
    path = f"file://{tmp_path}/odd"
    spark.createDataFrame([(c, i) for i, c in enumerate(odd)], "client_id string, n int").write.partitionBy("client_id").parquet(path)
    for i, c in enumerate(odd[:3]):
        assert L.drop_client(path, spark, c, StructType.fromDDL("client_id string, n int")) == 1
        assert {r.client_id for r in spark.read.parquet(path).collect()} == set(odd[i + 1 :])


ODD_IDS = ["01", "1", "1e3", "2024-01-01", "a b/c:1", "it's", None]


def test_ids_stay_text(spark, tmp_path):
    rows = spark.createDataFrame([(c, n, 7) for c in ODD_IDS for n in (1, 2)], "client_id string, row_number int, v int")
    path = f"file://{tmp_path}/t"
    assert [L.append_missing(rows, path, ("client_id", "row_number"), partition_by="client_id") for _ in range(3)] == [14, 0, 0]
    more = rows.withColumn("row_number", F.col("row_number") + 1)
    assert L.append_missing(more, path, ("client_id", "row_number"), partition_by="client_id") == 7
    assert L.drop_client(path, spark, "nobody", rows.schema) == 0
    for i, c in enumerate(ODD_IDS):
        assert L.drop_client(path, spark, c, rows.schema) == 3
        assert {r.client_id for r in L.read_stored(spark, path, rows.schema).collect()} == set(ODD_IDS[i + 1 :])
    assert spark.catalog.listTables() == []


def test_chunks_replace_themselves(spark, tmp_path):
    rows = spark.createDataFrame([(c, k, n) for c in ODD_IDS for k in ("01", "1") for n in (1, 2)], "client_id string, chunk_id string, v int")
    path = f"file://{tmp_path}/t"
    L.replace_partitions(rows, path, ["client_id", "chunk_id"])
    L.replace_partitions(rows.where("client_id = '01' AND chunk_id = '01'").limit(1), path, ["client_id", "chunk_id"])
    stored = L.read_stored(spark, path, rows.schema)
    assert stored.count() == 27 and stored.where("client_id = '01' AND chunk_id = '01'").count() == 1 and stored.where("client_id = '1' AND chunk_id = '01'").count() == 2
    assert L.drop_client(path, spark, "01", rows.schema, partition_by=["client_id", "chunk_id"]) == 3
    assert L.read_stored(spark, path, rows.schema).count() == 24
    assert L.read_stored(spark, f"{path}-none", rows.schema).count() == 0


def test_chunk_numbers_are_those_of_one_sort(spark):
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, "a").otherwise(F.lit(None)).alias("f"), (F.col("id") * 7919 % 5000).alias("k"))
    found = M.number_chunks(rows, ["f"], ["k"], 100).collect()
    for f in ("a", None):
        mine = sorted((r for r in found if r.f == f), key=lambda r: r.k)
        assert [r.row_number for r in mine] == list(range(1, len(mine) + 1)) and all(r.chunk_number == -(-r.row_number // 100) for r in mine)



def test_coverage_levels(spark):
    full = spark.range(100).select(F.col("id").alias("a"))
    status = lambda n: CMP.coverage(full, full.where(F.col("a") < n), ["a"]).first().status
    assert [status(100), status(95), status(50)] == ["PASS", "PARTIAL", "FAIL"]


def test_small_dimension_is_broadcast_only_when_small(spark):
    a, b = spark.range(1000), spark.range(1000)
    assert "BroadcastHashJoin" in plan(a.join(broadcast_below(b, 1000), "id"))
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert "SortMergeJoin" in plan(a.join(broadcast_below(b, 999), "id"))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_one_input_feeds_many(spark):
    views = one_input_many_queries(spark.range(10), {"low": F.col("id") < 3, "high": F.col("id") >= 3})
    assert {k: v.count() for k, v in views.items()} == {"low": 3, "high": 7}


@pytest.mark.parametrize("name", ["q1_filtered_transactions", "filter_amount"])
def test_filters_reach_the_scan(spark, name):
    text = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
    assert "GreaterThanOrEqual(value,75.0)" in text and "Exchange" not in text and "props" not in text.split("ReadSchema")[1].splitlines()[0]


def test_rankings_are_limited_below_the_shuffle(spark):
    for name in ("top3_users", "q4_top_customers_by_store", "q2_top_items_by_month"):
        assert "WindowGroupLimit" in plan(QUERIES[name](spark, f"{DATA}/sf0.001"))


def test_no_python_in_plans(spark):
    for name in ("q1_filtered_transactions", "q2_top_items_by_month", "q3_tpv_by_semester_store", "q4_top_customers_by_store"):
        text = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
        assert "Python" not in text and "Arrow" not in text


def test_co_partitioned_join_shuffles_each_side_once(spark):
    a, b = spark.range(1000), spark.range(0, 1000, 3)
    joined = co_partitioned_join(a, b, "id", strategy="merge").groupBy("id").count()
    assert plan(joined).split("\n\n")[0].count("Exchange (") == 2
    assert plan(QUERIES["co_partitioned_join"](spark, f"{DATA}/sf0.001")).split("\n\n")[0].count("Exchange (") <= 3


def test_year_ranges_reach_the_scan(spark):
    for name in ("filter_year", "q3_tpv_by_semester_store", "q1_filtered_transactions"):
        text = plan(QUERIES[name](spark, f"{DATA}/sf0.001"))
        assert "GreaterThanOrEqual(o_orderdate" in text or "GreaterThanOrEqual(ts" in text
    df = spark.createDataFrame([("1995-12-31 23:59:59",), ("1996-01-01 00:00:00",), ("1999-12-31 23:59:59.9",), ("2000-01-01 00:00:00",), (None,)], "t string")
    df = df.select(F.col("t").cast("timestamp_ntz").alias("t"))
    assert [df.where(P.in_years(F.col("t"), y)).count() for y in ((1996,), (1995, 1996), (1995, 1999), (), (1995, 1996, 1999, 2000))] == [1, 2, 2, 0, 4]


def test_wide_dimension_is_not_broadcast(spark):
    wide = spark.range(100).select("id", F.repeat(F.lit("x"), 1000).alias("t"))
    assert "ResolvedHint" not in broadcast_below(wide, 1000, 10_000)._jdf.queryExecution().analyzed().toString()
