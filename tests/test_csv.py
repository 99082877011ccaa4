"""CSV folders with every kind of malformed row, and the four queries over them."""

from pyspark.sql import functions as F

import pytest

from ledgerloom.operators.joins import unmatched_users
from ledgerloom.plans.pipelines import all_queries, best_items, top_customers
from ledgerloom.schemas import MENU_ITEMS, TRANSACTION_ITEMS, TRANSACTIONS
from ledgerloom.sources import csv_tables as T
from ledgerloom.sources.results import read_result_files, result_lines, write_csv, write_result_files

TX = """transaction_id,store_id,payment_method_id,voucher_id,user_id,original_amount,discount_applied,final_amount,created_at
t1,1,1,,7,80,0,75,2024-06-30 06:00:00
t2,1,1,,7.0,80,0,74.99,2024-07-01 23:59:59
t3,1,1,,8,80,0,100,2024-07-01 05:59:59
t4,1,1,,8,80,0,100,2024-07-01 00:00:00

,,,,,,,,
transaction_id,store_id,payment_method_id,voucher_id,user_id,original_amount,discount_applied,final_amount,created_at
t5,1,1,,,80,0,100,2023-12-31 12:00:00
t6,1,1,,9,80,0,NaN,2025-01-01 12:00:00
t7,1,1,,9,80,0,75d,2025-01-01 12:00:00
t8,1,1,,9,80,0,abc,2025-01-01 12:00:00
t9,,1,,9,80,0,100,2025-01-01 12:00:00
short,1,1
1,"a,b,c,d,e,f,g,h"
t10,2,1,,7,80,0,200,2025-07-01 7:05:00.250,extra
t11,2,1,,10,80,0,100,2026-01-01 12:00:00
t12,2,1,"a, b",,80,0,100,2025-01-01 12:00:00
t13,2,1,,11,80,0,100,not a time
"""
ITEMS = """transaction_id,item_id,quantity,unit_price,subtotal,created_at
t1,i1,5,2.5,12.5,2024-06-30 03:00:00
t1,i2,+5,9,45.0,2024-06-30 06:00:00
t2,i1,5.0,2.5,12.5,2024-07-01 06:00:00
t2,i1,,2.5,12.5,2024-07-01 06:00:00
t2,i3,1,2.5,99,2024-07-01 06:00:00
t2,i3,1,2.5,1,2024-07-02 06:00:00
t2,i4,1,2.5
t3,i9,2,1,2,2025-02-01 06:00:00
"""
MENU = """item_id,item_name,coffee_category,price,is_seasonal,available_from,available_to
i1,Old,c,2.5,False,,
i2,Latte,c,9,False,,
i1,Espresso,c,2.5,True,,
i3,"Mocha, big",c,2.5,False,,
"""
STORES = """store_id,store_name,street,postal_code,city,state,latitude,longitude
1,First,s,1,c,st,0,0
2,Second,s,1,c,st,0,0
"""
USERS = """user_id,gender,birthdate,registered_at
7.0,female,1990-01-01,2024-01-01 00:00:00
8,male,1991-01-01,2024-01-01 00:00:00
7,male,1999-01-01,2024-01-01 00:00:00
"""


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    root = tmp_path_factory.mktemp("csv")
    for name, text in {"transactions": TX, "transaction_items": ITEMS, "menu_items": MENU, "stores": STORES, "users": USERS, "vouchers": "a,b\n1,2\n", "payment_methods": "a\n1\n"}.items():
        (root / name).mkdir()
        (root / name / f"{name}_1.csv").write_text(text)
    (root / "transactions" / "transactions_2.csv").write_text(TX.splitlines()[0] + "\n")
    return f"file://{root}"


@pytest.fixture(scope="module")
def tables(spark, folder):
    names = {"TR": "transactions", "TI": "transaction_items", "MN": "menu_items", "ST": "stores", "US": "users"}
    return {k: T.read_table(spark, f"{folder}/{n}", k) for k, n in names.items()}


def test_files_have_kinds_and_numbers(spark, folder):
    found = {r.path.rpartition("/")[2]: (r.kind, r.file_id) for r in T.list_files(spark, folder).collect()}
    assert found["transactions_1.csv"] == ("TR", "TR01") and found["transactions_2.csv"] == ("TR", "TR02")
    assert found["transaction_items_1.csv"][0] == "TI" and found["payment_methods_1.csv"][0] == "PM" and found["vouchers_1.csv"][0] == "VC"


def test_headers_are_checked(spark, folder):
    assert all(r.matches for r in T.header_matches(spark, f"{folder}/transactions", TRANSACTIONS).collect())
    assert not any(r.matches for r in T.header_matches(spark, f"{folder}/menu_items", TRANSACTION_ITEMS).collect())


def test_short_rows_go_to_quarantine_and_long_ones_stay(spark, folder):
    good, bad = T.split_good_bad(T.read_raw(spark, f"{folder}/transactions", TRANSACTIONS), TRANSACTIONS)
    ids = {r.transaction_id for r in good.collect()}
    assert ids == {f"t{i}" for i in range(1, 14)}
    assert {"short,1,1", '1,"a,b,c,d,e,f,g,h"'} <= {r.line_text for r in bad.collect()}
    good, bad = T.split_good_bad(T.read_raw(spark, f"{folder}/transaction_items", TRANSACTION_ITEMS), TRANSACTION_ITEMS)
    assert good.count() == 7 and bad.count() == 1
    assert T.split_good_bad(T.read_raw(spark, f"{folder}/menu_items", MENU_ITEMS), MENU_ITEMS)[0].where("item_name = 'Mocha, big'").count() == 1


def test_four_queries(tables):
    found = all_queries(tables)
    assert {r.transaction_id for r in found["Q1"].collect()} == {"t1", "t9", "t10", "t12"}
    q2 = {(r.year, r.month, r.category): (r.item_id, r.quantity, r.subtotal, r.item_name) for r in found["Q2"].collect()}
    assert q2 == {
        (2024, 6, 1): ("i1", 5, 12.5, "Espresso"), (2024, 6, 2): ("i2", 5, 45.0, "Latte"),
        (2024, 7, 1): ("i3", 2, 100.0, "Mocha, big"), (2025, 2, 1): ("i9", 2, 2.0, None),
    }
    q3 = {(r.year, r.semester, r.store_id): (r.total_final_amount, r["count"], r.store_name) for r in found["Q3"].collect()}
    assert q3 == {(2024, 1, "1"): (75.0, 1, "First"), (2024, 2, "1"): (74.99, 1, "First"), (2025, 2, "2"): (200.0, 1, "Second"), (2025, 1, "2"): (100.0, 1, "Second")}
    q4 = {(r.store_id, r["rank"]): (r.user_id, r.purchase_count, r.birthdate) for r in found["Q4"].collect()}
    assert q4 == {("1", 2): (7, 2, "1990-01-01"), ("1", 3): (8, 2, "1991-01-01"), ("2", 1): (7, 1, "1990-01-01")}


def test_keep_both_and_unknown_users(tables):
    both = best_items(tables["TI"], tables["MN"], keep_both=True)
    assert both.where("year = 2024 AND month = 7").count() == 2
    top = tables["TR"].select("user_id").distinct().where("user_id IS NOT NULL")
    assert {r.user_id for r in unmatched_users(top, tables["US"]).collect()} == {9, 10, 11}


def test_clients_are_kept_apart(tables):
    twice = {k: t.withColumn("client_id", F.lit("A")).unionByName(t.withColumn("client_id", F.lit("B"))) for k, t in tables.items()}
    one, two = all_queries(tables), all_queries(twice, by=["client_id"])
    for q in one:
        assert two[q].where("client_id = 'A'").count() == one[q].count() == two[q].where("client_id = 'B'").count()


def test_tie_for_third_place_goes_to_smaller_id(spark):
    rows = [("s", u, "2024-01-01 10:00:00") for u in (5, 5, 4, 4, 9, 3, 2)]
    tx = spark.createDataFrame(rows, "store_id string, user_id long, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp_ntz"))
    users = spark.createDataFrame([(u, "g", "b", "r") for u in (2, 3, 4, 5, 9)], "user_id long, gender string, birthdate string, registered_at string")
    assert [(r.user_id, r["rank"]) for r in top_customers(tx, users).orderBy("rank").collect()] == [(4, 1), (5, 2), (2, 3)]


def test_result_files_round_trip(spark, tables, tmp_path):
    rows = all_queries(tables)["Q3"].select("year", "semester", "store_id", "total_final_amount", "count")
    lines = result_lines(rows, 3, "CLI1").unionByName(result_lines(rows, 3, "CLI2"))
    write_result_files(lines, f"file://{tmp_path}/results")
    back = read_result_files(spark, f"file://{tmp_path}/results", 3, rows.columns)
    assert back.where("client_id = 'CLI2'").count() == rows.count()
    assert {r.total_final_amount for r in back.collect()} == {"75.00", "74.99", "200.00", "100.00"}
    write_csv(rows, f"file://{tmp_path}/csv", ["store_id", "count"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").columns == ["store_id", "count"]


def test_grouped_input_and_unknown_headers(spark, tmp_path):
    from ledgerloom.schemas import STORES_GROUPED

    (tmp_path / "g.csv").write_text("year,semester,store_id,total_final_amount,count\n2024,1,5,7.5,2\n")
    grouped = T.read_grouped(spark, f"file://{tmp_path}/g.csv", STORES_GROUPED)
    assert T.is_grouped(grouped, "year", "semester") and grouped.first().total_final_amount == 7.5
    odd = spark.createDataFrame([("A", "3", "x", "f/g.csv", 2), (None, "4.5", "y", "f/g.csv", 1234569)], "TransactionId string, Total_Paid string, other string, file_path string, line long")
    wanted = {"transaction_id": (["transactionid"], "string", T.made_id("TXN")), "final_amount": (["total", "amount"], "double", 0.0), "store_id": (["store"], "string", "STORE_01")}
    out = {(r.final_amount, r.store_id): r.transaction_id for r in T.map_columns(odd, wanted).collect()}
    assert out[(3.0, "STORE_01")] == "A" and out[(4.5, "STORE_01")] == "TXN_g.csv_1234568"


def test_simulated_tables(spark):
    tx = T.simulated_transactions(spark, 50_000)
    assert tx.count() == 50_000 and tx.select("user_id").distinct().count() == 1000
    users, top = T.simulated_users(spark, 1000), T.simulated_top_users(spark, 1000)
    assert users.join(top, "user_id").count() == 1000 and top.select("store_id").distinct().count() == 50


QUOTED = """item_id,item_name,coffee_category,price,is_seasonal,available_from,available_to
1,"Latte ""XL"", hot",coffee,3.5,False,,
2,"line
break, and ""another""
",tea,2,False,,
3,plain,tea,1,False,,
4,"",tea,1,False,,
5,"ends with cr\r
",tea,"1,5",False,,\r
6,last,"a
b",1,False,,
"""


@pytest.fixture
def small_splits(spark):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")

    def at(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))

    yield at
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


@pytest.mark.parametrize("size", [41, 128 << 20])
def test_quoted_records_equal_another_reader(spark, tmp_path, small_splits, size):
    duckdb = pytest.importorskip("duckdb")
    small_splits(size)
    folder = tmp_path / "menu_items"
    folder.mkdir()
    body = QUOTED.split("\n", 1)[1].replace("\r\n6", "\n6")
    (folder / "a.csv").write_bytes((QUOTED.split("\n", 1)[0] + "\n" + body * 6).encode())
    (folder / "b.csv").write_bytes(b"item_id,item_name,coffee_category,price,is_seasonal,available_from,available_to\n9,no quotes,c,1,False,,\n")
    (folder / "empty.csv").write_bytes(b"")
    raw = T.read_raw(spark, f"file://{folder}", MENU_ITEMS)
    good, bad = T.split_good_bad(raw, MENU_ITEMS)
    ours = sorted((tuple(r) for r in good.select("item_id", "item_name", "coffee_category", "price").collect()), key=repr)
    theirs = []
    for name in ("a.csv", "b.csv"):
        theirs += duckdb.sql(f"""SELECT item_id, item_name, coffee_category, price FROM read_csv('{folder}/{name}', header = true, all_varchar = true, quote = '"', escape = '"', delim = ',')""").fetchall()
    empty = lambda rows: [tuple(v or None for v in r) for r in rows]
    assert sorted(empty(ours), key=repr) == sorted(empty(theirs), key=repr) and bad.count() == 0
    lines = [(r.file_path, r.line) for r in good.collect()]
    assert len(set(lines)) == len(lines) and {n for f, n in lines if f.endswith("a.csv")} == {2 + 10 * i + k for i in range(6) for k in (0, 1, 4, 5, 6, 8)}


def test_open_quote_at_the_end_is_quarantined(spark, tmp_path, small_splits):
    small_splits(50)
    (tmp_path / "x.csv").write_text(QUOTED + '7,"never closed\n8,a,b,c,d,e,f\n')
    good, bad = T.split_good_bad(T.read_raw(spark, f"file://{tmp_path}", MENU_ITEMS), MENU_ITEMS)
    assert {r.item_id for r in good.collect()} == set("123456") and [r.line_text for r in bad.collect()] == ['7,"never closed\n8,a,b,c,d,e,f']


def test_many_splits_are_joined_by_a_shuffle(spark, tmp_path, small_splits, monkeypatch):
    from ledgerloom.sources import records

    monkeypatch.setattr(records, "SPLIT_BYTES", 1)
    small_splits(30)
    (tmp_path / "x.csv").write_text(QUOTED)
    assert T.split_good_bad(T.read_raw(spark, f"file://{tmp_path}", MENU_ITEMS), MENU_ITEMS)[0].count() == 6


def test_other_splits_than_counted_are_an_error(spark, tmp_path, small_splits):
    from ledgerloom.sources.records import read_lines

    (tmp_path / "x.csv").write_text("a\nb\n" * 100)
    small_splits(200)
    lines = read_lines(spark, f"file://{tmp_path}")
    assert [(r.line, r.value) for r in lines.orderBy("line").limit(3).collect()] == [(1, "a"), (2, "b"), (3, "a")]
    lines = read_lines(spark, f"file://{tmp_path}")
    small_splits(130)
    with pytest.raises(Exception, match="files are split in another way"):
        lines.collect()


def test_quoted_headers_fit(spark, tmp_path):
    (tmp_path / "x.csv").write_text('"item_id","item_name", coffee_category ,price,is_seasonal,available_from,"available_to"\n')
    (tmp_path / "y.csv").write_text('"item_id,item_name",coffee_category,price,is_seasonal,available_from,available_to\n')
    assert {r.file_path[-5:]: r.matches for r in T.header_matches(spark, f"file://{tmp_path}", MENU_ITEMS).collect()} == {"x.csv": True, "y.csv": False}


def test_unknown_header_patterns(spark, tmp_path):
    (tmp_path / "x.csv").write_text('Transaction ID,Product ID,"Price, total",Price,Store Name,store id,x,x\n,P1,3,2,"A, b",7,1,2\nT2,,bad,,,,\n')
    raw = T.read_unknown(spark, f"file://{tmp_path}")
    assert raw.columns[6:8] == ["x", "x_8"]
    wanted = {
        "transaction_id": ([("transaction", "id")], "string", T.made_id("TXN")), "user_id": (["customer"], "string", T.made_id("CUST", cycle=1000)), "item_id": ([("product", "id")], "string", T.made_id("PROD", 3, 100)),
        "unit_price": ([("price", "!total")], "double", 10.0), "final_amount": (["total", "amount"], "double", 10.0), "store_id": ([("store", "id")], "string", "ST01"), "store_name": ([("store", "name")], "string", "Store"),
    }
    found = sorted(tuple(r) for r in T.map_columns(raw, wanted).collect())
    assert found == [("T2", "CUST_000002", "PROD_002", 10.0, 10.0, "ST01", "Store"), ("TXN_x.csv_000001", "CUST_000001", "P1", 2.0, 3.0, "7", "A, b")]


def test_result_lines_keep_odd_clients_and_fields(spark, tmp_path):
    rows = [("01", 'a,"b"\nc', "x"), ("1", None, "y"), ("a b/c:1", "p + q%2F", "z"), (None, "a", "w")]
    df = spark.createDataFrame(rows, "client_id string, f string, g string")
    write_result_files(result_lines(df, 2).unionByName(result_lines(df, 3)), f"file://{tmp_path}/r")
    assert sorted((tuple(r) for r in read_result_files(spark, f"file://{tmp_path}/r", 2, ["f", "g"]).collect()), key=repr) == sorted(rows, key=repr)


def test_many_small_splits_are_few_tasks(spark, tmp_path):
    """Splits stay small, so quotes run across them, but not each is a task that reports to the driver."""
    from ledgerloom.plans.queries import SPLIT_TASKS, _split_at
    from ledgerloom.sources.records import _scan, read_records

    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.maxPartitionNum", None)
    (tmp_path / "x.csv").write_text("".join(f'{i},"a\n""{i}"""\n' for i in range(2000)))
    with _split_at(spark, 10):
        scan = _scan(spark, f"file://{tmp_path}", "*.csv")
        assert scan.select("_block").distinct().count() > 4 * SPLIT_TASKS and scan.rdd.getNumPartitions() < 2 * SPLIT_TASKS
        found = read_records(spark, f"file://{tmp_path}")
        assert sorted((r.line, r.value) for r in found.collect()) == [(2 * i + 1, f'{i},"a\n""{i}"""') for i in range(2000)]
        assert not any(f.endswith(".csv") for f in found.inputFiles())  # no file is without such records, so none is read as lines again
    assert (spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.maxPartitionNum", None)) == before


def test_a_record_is_parsed_once(spark, folder):
    """Conditions on the fields must not bring a parse of their own each."""
    rows = T.read_table(spark, f"{folder}/transactions", "TR").select("transaction_id", "final_amount")
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_csv") == 1


def test_places_are_counted_by_blocks_of_lines(spark):
    """Lines that come twice count once, also the last bit of a block; what is shuffled is a row for 64 lines."""
    lines = spark.range(1, 6401).selectExpr("'f' AS file_path", "id AS line")
    rows = lines.unionByName(lines.where("line IN (63, 64, 127)")).unionByName(lines.where("line < 3").withColumn("file_path", F.lit("g"))).coalesce(1)
    assert sorted(map(tuple, T.places(rows).collect())) == [("f", 6403, 6400), ("g", 2, 2)]
    assert "distinct" not in T.places(rows)._jdf.queryExecution().optimizedPlan().toString()
