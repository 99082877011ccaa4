"""Queries by name over the driver's tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns as C
from ..functions import predicates as P
from ..operators import compare as CMP
from ..operators import joins as J
from ..operators import layout as L
from ..operators import manifest as M
from ..operators.aggregates import aggregate, sorted_by_keys, with_counters
from ..operators.ranking import latest, top_items, top_k, top_users
from ..schemas import MENU_ITEMS, STORES, STORES_GROUPED, TRANSACTIONS, USERS
from ..sources import csv_tables as T
from ..sources.results import read_result_files, result_lines, write_csv, write_result_files
from ..sources.scratch import scratch_path
from ..streaming import pipelines as S
from ..streaming.clients import client_aggregates, streaming_top_users
from . import adapters as A
from . import pipelines as Q

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
YEARS = (1997, 1998)
ALL_YEARS = tuple(range(1995, 2002))
CHUNK = 1000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# Parts of the SQL texts that several queries share.
TX = "SELECT o_orderkey AS transaction_id, o_custkey AS user_id, c_nationkey AS store_id, o_totalprice AS final_amount, o_orderdate AS created_at FROM orders LEFT JOIN customer ON o_custkey = c_custkey"
BUY = "SELECT o_custkey AS user_id, l_suppkey AS store_id, o_orderdate AS created_at FROM lineitem JOIN orders ON l_orderkey = o_orderkey"
ITEMS_MONTH = """SELECT year(l_shipdate)::INT AS year, month(l_shipdate)::INT AS month, l_partkey AS item_id, sum(l_quantity)::BIGINT AS quantity,
  sum(l_extendedprice::DECIMAL(18,2))::DOUBLE AS subtotal, count(*) AS count FROM lineitem WHERE year(l_shipdate) IN (1997, 1998) GROUP BY 1, 2, 3"""
TOP_ITEMS = f"""g AS ({ITEMS_MONTH}),
r AS (SELECT *, row_number() OVER (PARTITION BY year, month ORDER BY quantity DESC, item_id) AS rq,
             row_number() OVER (PARTITION BY year, month ORDER BY subtotal DESC, item_id) AS rr FROM g)"""
STORE_SEMESTER = f"""SELECT year(created_at)::INT AS year, CASE WHEN month(created_at) >= 7 THEN 2 ELSE 1 END::INT AS semester, store_id,
  sum(final_amount::DECIMAL(18,2))::DOUBLE AS total_final_amount, count(*) AS count FROM ({TX}) WHERE store_id IS NOT NULL GROUP BY 1, 2, 3"""
USER_STORE = f"SELECT user_id, store_id, count(*) AS count FROM ({BUY}) GROUP BY 1, 2"
TOP_USERS = f"""SELECT user_id, store_id, count AS purchase_count, rn::INT AS rank FROM (SELECT *, row_number() OVER
  (PARTITION BY store_id ORDER BY count DESC, user_id) AS rn FROM ({USER_STORE})) WHERE rn <= 3"""
EVENT_TX = "SELECT event_id AS transaction_id, event_type AS store_id, user_id, value AS final_amount, ts AS created_at FROM events"
Q1_SQL = f"SELECT * FROM ({EVENT_TX}) WHERE hour(created_at) BETWEEN 6 AND 23 AND final_amount >= 75 AND year(created_at) IN (2024, 2025)"


def _events(spark, d):
    return A.event_transactions(A.table(spark, d, "events"))


@query(Q1_SQL)
def q1_filtered_transactions(spark, d):
    return Q.filtered_transactions(_events(spark, d))


@query(f"""WITH {TOP_ITEMS},
t AS (SELECT year, month, item_id, quantity, subtotal, CASE WHEN rq = 1 THEN 1 ELSE 2 END::INT AS category FROM r WHERE rq = 1 OR rr = 1)
SELECT t.*, p_name AS item_name, p_type AS coffee_category, p_retailprice AS price, 'False' AS is_seasonal FROM t LEFT JOIN part ON item_id = p_partkey""")
def q2_top_items_by_month(spark, d):
    return Q.best_items(A.items(spark, d), A.menu(spark, d), YEARS)


@query(f"SELECT s.*, n_name AS store_name, n_regionkey AS city FROM ({STORE_SEMESTER}) s LEFT JOIN nation ON store_id = n_nationkey")
def q3_tpv_by_semester_store(spark, d):
    return Q.volume_by_store(A.order_transactions(spark, d), A.stores(spark, d), ALL_YEARS, hours=None)


@query(f"""SELECT t.*, c_mktsegment AS gender, c_name AS birthdate, c_acctbal AS registered_at FROM ({TOP_USERS}) t JOIN customer ON user_id = c_custkey""")
def q4_top_customers_by_store(spark, d):
    return Q.top_customers(A.purchases(spark, d), A.users(spark, d), ALL_YEARS)


@query(f"""SELECT year(created_at)::INT AS year, CASE WHEN month(created_at) >= 7 THEN 2 ELSE 1 END::INT AS semester, store_id,
  sum(final_amount::DECIMAL(18,2))::DOUBLE AS total_final_amount, count(*) AS count FROM ({EVENT_TX})
  WHERE hour(created_at) BETWEEN 6 AND 23 AND year(created_at) IN (2024, 2025) GROUP BY 1, 2, 3""")
def q3_tpv_hour_filtered(spark, d):
    return Q.grouped_stores(_events(spark, d))


@query(f"""WITH {TOP_ITEMS} SELECT year, month, item_id, quantity, subtotal, count, 1 AS category FROM r WHERE rq = 1
UNION ALL SELECT year, month, item_id, quantity, subtotal, count, 2 FROM r WHERE rr = 1""")
def q2_top_items_keep_both(spark, d):
    return top_items(Q.grouped_items(A.items(spark, d), YEARS), keep_both=True)


@query("SELECT o_orderkey, o_orderdate FROM orders WHERE year(o_orderdate) IN (1997, 1998)")
def filter_year(spark, d):
    return A.table(spark, d, "orders").where(P.in_years(F.col("o_orderdate"), YEARS)).select("o_orderkey", "o_orderdate")


@query("SELECT event_id, ts FROM events WHERE hour(ts) BETWEEN 6 AND 23")
def filter_hour(spark, d):
    return A.table(spark, d, "events").where(P.in_hours(F.col("ts"))).select("event_id", "ts")


@query("SELECT event_id, value FROM events WHERE value >= 75")
def filter_amount(spark, d):
    return A.table(spark, d, "events").where(P.at_least(F.col("value"))).select("event_id", "value")


@query("SELECT event_id, user_id FROM events WHERE hour(ts) >= 6 AND value >= 20 AND event_type <> 'error'")
def filter_chain(spark, d):
    """Any Column is a stage of a chain of filters."""
    stages = P.chain(F.hour("ts") >= 6, P.at_least(F.col("value"), 20), F.col("event_type") != "error")
    return A.table(spark, d, "events").transform(stages).select("event_id", "user_id")


@query(ITEMS_MONTH)
def agg_items_month(spark, d):
    return Q.grouped_items(A.items(spark, d), YEARS)


@query(STORE_SEMESTER)
def agg_store_semester(spark, d):
    return Q.grouped_stores(A.order_transactions(spark, d), ALL_YEARS, hours=None)


@query(USER_STORE)
def agg_user_store(spark, d):
    return aggregate(A.purchases(spark, d), 4)


@query(f"SELECT o_orderpriority AS client_id, user_id, store_id, count(*) AS count FROM ({BUY.replace('SELECT', 'SELECT o_orderpriority,')}) GROUP BY 1, 2, 3")
def agg_per_client(spark, d):
    """Grouping per client: order priorities stand for clients."""
    lines, orders = A.table(spark, d, "lineitem"), A.table(spark, d, "orders")
    rows = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    return aggregate(rows.select(F.col("o_orderpriority").alias("client_id"), F.col("o_custkey").alias("user_id"), F.col("l_suppkey").alias("store_id")), 4, ["client_id"])


@query(f"WITH {TOP_ITEMS} SELECT year, month, item_id, quantity, subtotal, count, 1 AS rank FROM r WHERE rq = 1")
def top1_by_quantity(spark, d):
    return top_k(Q.grouped_items(A.items(spark, d), YEARS), ["year", "month"], "quantity", "item_id")


@query(f"WITH {TOP_ITEMS} SELECT year, month, item_id, quantity, subtotal, count, 1 AS rank FROM r WHERE rr = 1")
def top1_by_revenue(spark, d):
    return top_k(Q.grouped_items(A.items(spark, d), YEARS), ["year", "month"], "subtotal", "item_id")


@query(TOP_USERS)
def top3_users(spark, d):
    return top_users(aggregate(A.purchases(spark, d), 4))


@query("""SELECT user_id, event_type AS store_id, value, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY event_id DESC) AS n FROM events) WHERE n = 1""")
def latest_per_user(spark, d):
    """An update replaces what arrived before."""
    rows = A.table(spark, d, "events").select("user_id", F.col("event_type").alias("store_id"), "value", "event_id")
    return latest(rows, ["user_id", "store_id"], "event_id")


@query("""SELECT l_orderkey AS transaction_id, l_partkey AS item_id, l_quantity::BIGINT AS quantity, l_extendedprice AS subtotal, l_shipdate AS created_at,
  p_name AS item_name, p_type AS coffee_category, p_retailprice AS price, 'False' AS is_seasonal FROM lineitem LEFT JOIN part ON l_partkey = p_partkey""")
def join_items_menu_raw(spark, d):
    return J.items_with_menu(A.items(spark, d), A.menu(spark, d))


@query(f"SELECT t.*, n_name AS store_name, n_regionkey AS city FROM ({TX}) t LEFT JOIN nation ON store_id = n_nationkey")
def join_transactions_store_raw(spark, d):
    return J.transactions_with_stores(A.order_transactions(spark, d), A.stores(spark, d))


@query("SELECT DISTINCT o_custkey AS user_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal >= 0)")
def unmatched_users(spark, d):
    known = A.table(spark, d, "customer").where("c_acctbal >= 0").select(F.col("c_custkey").alias("user_id"))
    return J.unmatched_users(A.table(spark, d, "orders").select(F.col("o_custkey").alias("user_id")).distinct(), known)


@query("SELECT l_suppkey AS store_id, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, max(s_nationkey)::INT AS nation FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def co_partitioned_join(spark, d):
    """The grouping after the join is by its key."""
    lines = A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("store_id"), "l_quantity")
    dims = A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"), "s_nationkey")
    joined = J.co_partitioned_join(lines, dims, "store_id")
    return joined.groupBy("store_id").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.max("s_nationkey").alias("nation"))


@query("SELECT l_suppkey AS store_id, count(*) AS n, sum(l_quantity)::BIGINT AS quantity, max(s_nationkey)::INT AS nation, 0 AS exchanges FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def bucketed_join(spark, d):
    """Both sides stored in buckets of the key: joined and grouped as they lie, without any exchange."""
    name = uuid.uuid4().hex
    lines = J.write_bucketed(A.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("store_id"), "l_quantity"), f"lines_{name}", "store_id", 8)
    dims = J.write_bucketed(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("store_id"), "s_nationkey"), f"dims_{name}", "store_id", 8)
    joined = J.co_partitioned_join(lines, dims, "store_id", strategy="merge")
    out = joined.groupBy("store_id").agg(F.count("*").alias("n"), F.sum("l_quantity").cast("bigint").alias("quantity"), F.max("s_nationkey").alias("nation"))
    exchanges = out._jdf.queryExecution().executedPlan().toString().count("Exchange ")
    found = _kept(out, "bucketed")
    for table in (f"lines_{name}", f"dims_{name}"):
        spark.sql(f"DROP TABLE {table}")
    return found.withColumn("exchanges", F.lit(exchanges))


_TWICE = "SELECT *, 0 AS pos FROM customer UNION ALL SELECT c_custkey, upper(c_name) || '#2', c_nationkey, c_acctbal + 1, c_mktsegment, 1 FROM customer WHERE c_custkey % 3 = 0"


def _twice(spark, d):
    first = A.table(spark, d, "customer")
    again = first.where("c_custkey % 3 = 0").select("c_custkey", F.concat(F.upper("c_name"), F.lit("#2")).alias("c_name"), "c_nationkey", (F.col("c_acctbal") + 1).alias("c_acctbal"), "c_mktsegment")
    return first.withColumn("pos", F.lit(0)).unionByName(again.withColumn("pos", F.lit(1)))


@query(f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pos DESC) AS n FROM ({_TWICE})) WHERE n = 1")
def dim_last_wins(spark, d):
    return J.last_wins(_twice(spark, d), ["c_custkey"], ["pos"])


@query(f"SELECT * EXCLUDE (n) FROM (SELECT *, row_number() OVER (PARTITION BY c_custkey ORDER BY pos) AS n FROM ({_TWICE})) WHERE n = 1")
def dim_first_wins(spark, d):
    return J.first_wins(_twice(spark, d), ["c_custkey"], ["pos"])


@query("""SELECT event_id, year(ts)::INT AS y, month(ts)::INT AS m, hour(ts)::INT AS h, strftime(ts, '%m') AS mm, CASE WHEN month(ts) >= 7 THEN 2 ELSE 1 END::INT AS s,
  strftime(ts, '%Y-%m') AS ym, year(ts)::VARCHAR || '-H' || CASE WHEN month(ts) >= 7 THEN '2' ELSE '1' END AS half FROM events""")
def derive_time_keys(spark, d):
    ts = F.col("ts")
    return A.table(spark, d, "events").select(
        "event_id", F.year(ts).alias("y"), F.month(ts).alias("m"), F.hour(ts).alias("h"), C.month_text(ts).alias("mm"), C.semester(ts).alias("s"),
        C.month_key(F.year(ts), F.month(ts)).alias("ym"), C.half_label(F.year(ts), C.semester(ts)).alias("half"),
    )


@query("""SELECT o_orderkey, CASE WHEN o_orderkey % 5 = 4 THEN NULL ELSE o_orderdate END AS parsed FROM orders""")
def parse_dates_multi(spark, d):
    """Dates written in four layouts, and one that is none of them."""
    k, ts = F.col("o_orderkey") % 5, F.col("o_orderdate")
    forms = ("yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyy/MM/dd HH:mm:ss", "yyyy/MM/dd", "dd.MM.yyyy")
    text = F.coalesce(*(F.when(k == i, F.date_format(ts, f)) for i, f in enumerate(forms)))
    return A.table(spark, d, "orders").select("o_orderkey", C.parse_date(text).alias("parsed"))


@query("""SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey ELSE NULL END AS as_int,
  CASE o_orderkey % 6 WHEN 0 THEN o_custkey WHEN 1 THEN o_custkey WHEN 2 THEN o_custkey + 0.5 END::DOUBLE AS as_double FROM orders""")
def lenient_numbers(spark, d):
    k, n = F.col("o_orderkey") % 6, F.col("o_custkey").cast("string")
    text = F.when(k == 0, n).when(k == 1, F.concat(F.lit(" +"), n)).when(k == 2, F.concat(n, F.lit(".5"))).when(k == 3, F.concat(n, F.lit("d"))).when(k == 4, F.lit("abc")).otherwise(F.lit(""))
    return A.table(spark, d, "orders").select("o_orderkey", C.lenient_int(text).alias("as_int"), C.lenient_double(text).alias("as_double"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 2 THEN NULL ELSE o_custkey END AS user_id FROM orders")
def normalise_user_id(spark, d):
    k, n = F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    text = F.when(k == 0, n).when(k == 1, F.concat(n, F.lit(".0"))).otherwise(F.concat(n, F.lit(".5")))
    return A.table(spark, d, "orders").select("o_orderkey", C.normalise_user_id(text).alias("user_id"))


@query("""SELECT o_orderkey, o_totalprice::DECIMAL(18,2)::VARCHAR AS money, trunc(o_totalprice)::BIGINT AS whole,
  o_custkey::VARCHAR || '|' || o_orderstatus AS key, 3::INT AS tag FROM orders""")
def money_and_keys(spark, d):
    o = A.table(spark, d, "orders")
    return o.select(
        "o_orderkey", C.money_text(F.col("o_totalprice")).alias("money"), C.whole_units(F.col("o_totalprice")).alias("whole"),
        C.text_key(F.col("o_custkey"), F.col("o_orderstatus")).alias("key"), C.query_tag(3).alias("tag"),
    )


@query("SELECT o_orderkey AS transaction_id FROM orders WHERE o_orderkey % 7 <> 0 AND o_orderkey % 11 <> 0")
def required_fields(spark, d):
    rows = A.order_transactions(spark, d)
    text = rows.withColumn("store_id", F.when(F.col("transaction_id") % 7 == 0, "  ").otherwise(F.col("store_id").cast("string")))
    text = text.withColumn("final_amount", F.when(F.col("transaction_id") % 11 != 0, F.col("final_amount")))
    return P.required(text.withColumn("store_id", C.empty_to_null(F.col("store_id"))), 3).select("transaction_id")


@query("SELECT o_orderkey, (o_custkey % 100)::INT AS bucket FROM orders")
def bucket_user_modulo(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", C.modulo_bucket(F.col("o_custkey"), 100).alias("bucket"))


@query("SELECT o_orderkey, CASE WHEN year(o_orderdate) >= 1996 THEN (year(o_orderdate) - 1996) * 2 + CASE WHEN month(o_orderdate) >= 7 THEN 1 ELSE 0 END END::INT AS bucket FROM orders")
def bucket_time(spark, d):
    return A.table(spark, d, "orders").select("o_orderkey", C.half_year_bucket(F.col("o_orderdate"), 1996).alias("bucket"))


@query("SELECT count(*) AS n_rows, least(100, count(DISTINCT (l_partkey, l_suppkey)))::BIGINT AS n_buckets, true AS balanced FROM lineitem")
def bucket_hash_balance(spark, d):
    """Every bucket has rows, and none twice its share."""
    per = L.bucket_balance(A.table(spark, d, "lineitem"), 100, "l_partkey", "l_suppkey")
    return per.agg(F.sum("n_rows").alias("n_rows"), F.count("*").alias("n_buckets"), (F.max("n_rows") < 2 * F.avg("n_rows") + 20).alias("balanced"))


@query("SELECT o_orderkey, (o_custkey % 100)::INT AS bucket, ((o_custkey % 100) % 5)::INT AS worker FROM orders")
def bucket_owner(spark, d):
    placed = A.table(spark, d, "orders").select("o_orderkey", C.modulo_bucket(F.col("o_custkey"), 100).alias("bucket"))
    return L.bucket_owner(placed, "bucket", 5)


@query(f"""SELECT 'CLI1' AS client_id, 'CLI1 | Q3 | ' || concat_ws(',', year, semester, store_id, total_final_amount::DECIMAL(18,2), count, coalesce(n_name, ''), coalesce(n_regionkey::VARCHAR, '')) AS line
  FROM ({STORE_SEMESTER}) LEFT JOIN nation ON store_id = n_nationkey""")
def result_lines_q3(spark, d):
    rows = q3_tpv_by_semester_store(spark, d)
    return result_lines(rows.select("year", "semester", "store_id", "total_final_amount", "count", "store_name", "city"), 3, "CLI1")


def _altered(df: DataFrame, key: str, column: str) -> DataFrame:
    """A copy with one row in 50 changed and one in 70 missing."""
    return df.where(F.col(key) % 70 != 1).withColumn(column, F.when(F.col(key) % 50 == 0, F.col(column) + 1).otherwise(F.col(column)))


_ALTERED_Q1 = f"SELECT transaction_id, CASE WHEN transaction_id % 50 = 0 THEN final_amount + 1 ELSE final_amount END AS final_amount FROM ({Q1_SQL}) WHERE transaction_id % 70 <> 1"


def _comparison(expected: str, actual: str) -> str:
    return f"""SELECT (SELECT count(*) FROM ({expected})) AS expected, (SELECT count(*) FROM ({actual})) AS actual,
  (SELECT count(*) FROM (({expected}) EXCEPT ALL ({actual}))) AS missing, (SELECT count(*) FROM (({actual}) EXCEPT ALL ({expected}))) AS extra"""


def _judged(expected: str, actual: str) -> str:
    return f"SELECT *, CASE WHEN missing = 0 AND extra = 0 THEN 'PASS' ELSE 'FAIL' END AS status FROM ({_comparison(expected, actual)})"


@query(_judged(f"SELECT transaction_id, final_amount FROM ({Q1_SQL})", _ALTERED_Q1))
def compare_exact(spark, d):
    result = CMP.q1_form(q1_filtered_transactions(spark, d))
    return CMP.compare_exact(result, _altered(result, "transaction_id", "final_amount"), result.columns)


_Q2 = SQL["q2_top_items_by_month"]
_Q2_FORM = "SELECT year::VARCHAR || '-' || lpad(month::VARCHAR, 2, '0') AS year_month, item_name, trunc(subtotal)::BIGINT AS value FROM ({}) WHERE category = 2"


@query(_judged(_Q2_FORM.format(_Q2), _Q2_FORM.format(f"SELECT * REPLACE (CASE WHEN month = 3 THEN subtotal + 1 ELSE subtotal END AS subtotal) FROM ({_Q2})")))
def compare_q2_norm(spark, d):
    result = q2_top_items_by_month(spark, d)
    other = result.withColumn("subtotal", F.when(F.col("month") == 3, F.col("subtotal") + 1).otherwise(F.col("subtotal")))
    form = CMP.q2_form(result, 2)
    return CMP.compare_exact(form, CMP.q2_form(other, 2), form.columns)


_Q3_FORM = f"SELECT year::VARCHAR || '-H' || semester::VARCHAR AS year_half, store_name, trunc(total_final_amount)::BIGINT AS tpv FROM ({SQL['q3_tpv_by_semester_store']})"


_OTHER_Q3 = f"SELECT * REPLACE (CASE WHEN store_id % 7 = 0 THEN total_final_amount + 5 ELSE total_final_amount END AS total_final_amount) FROM ({SQL['q3_tpv_by_semester_store']})"
_OTHER_Q3_FORM = f"SELECT year::VARCHAR || '-H' || semester::VARCHAR AS year_half, store_name, trunc(total_final_amount)::BIGINT AS tpv FROM ({_OTHER_Q3})"


def _other_q3(result: DataFrame) -> DataFrame:
    return result.withColumn("total_final_amount", F.when(F.col("store_id") % 7 == 0, F.col("total_final_amount") + 5).otherwise(F.col("total_final_amount")))


@query(_judged(_Q3_FORM, _OTHER_Q3_FORM))
def compare_q3_norm(spark, d):
    """Every seventh store differs by five."""
    result = q3_tpv_by_semester_store(spark, d)
    form = CMP.q3_form(result)
    return CMP.compare_exact(form, CMP.q3_form(_other_q3(result)), form.columns)


_Q4_FORM = f"SELECT store_id, birthdate, purchase_count AS purchases_qty FROM ({SQL['q4_top_customers_by_store']})"


@query(f"""WITH c AS ({_comparison(_Q4_FORM, f"SELECT * FROM ({_Q4_FORM}) WHERE store_id % 20 <> 3")}),
v AS (SELECT *, CASE WHEN expected > 0 THEN (expected - missing) / expected ELSE 1.0 END::DOUBLE AS coverage FROM c)
SELECT *, CASE WHEN missing = 0 THEN 'PASS' WHEN coverage >= 0.9 THEN 'PARTIAL' ELSE 'FAIL' END AS status FROM v""")
def compare_coverage(spark, d):
    form = CMP.q4_form(q4_top_customers_by_store(spark, d))
    return CMP.coverage(form, form.where("store_id % 20 <> 3"), form.columns)


@query(f"(SELECT transaction_id, final_amount FROM ({Q1_SQL})) EXCEPT ALL ({_ALTERED_Q1})")
def compare_missing_rows(spark, d):
    result = CMP.q1_form(q1_filtered_transactions(spark, d))
    return CMP.missing_rows(result, _altered(result, "transaction_id", "final_amount"), result.columns)


@query(f"(SELECT transaction_id, final_amount FROM ({Q1_SQL})) INTERSECT ALL ({_ALTERED_Q1})")
def compare_common_rows(spark, d):
    result = CMP.q1_form(q1_filtered_transactions(spark, d))
    return CMP.common_rows(result, _altered(result, "transaction_id", "final_amount"), result.columns)


_Q1_FORM, _Q2_SELLING = f"SELECT transaction_id, final_amount FROM ({Q1_SQL})", _Q2_FORM.replace("trunc(subtotal)::BIGINT", "quantity").replace("category = 2", "category = 1").format(_Q2)
_PAIRS = {"Q1": (_Q1_FORM, _ALTERED_Q1), "Q2_selling": (_Q2_SELLING, _Q2_SELLING), "Q3": (_Q3_FORM, _OTHER_Q3_FORM)}
_REPORT = " UNION ALL ".join(f"SELECT 'CLI1' AS client_id, '{n}' AS query, * FROM ({_judged(*pair)})" for n, pair in _PAIRS.items())


@query(f"""{_REPORT} UNION ALL SELECT 'CLI1', 'Q4', expected, actual, missing, extra, CASE WHEN missing = 0 THEN 'PASS' WHEN missing <= 0.1 * expected THEN 'PARTIAL' ELSE 'FAIL' END
FROM ({_comparison(_Q4_FORM, f"SELECT * FROM ({_Q4_FORM}) WHERE store_id % 20 <> 3")}) UNION ALL SELECT 'CLI1', 'Q2_profit', NULL, NULL, NULL, NULL, 'SKIPPED'""")
def comparison_report(spark, d):
    """All four queries in one report; results of Q1, Q3 and Q4 are altered, and one expected set is missing."""
    found = {"Q1": q1_filtered_transactions(spark, d), "Q2": q2_top_items_by_month(spark, d), "Q3": q3_tpv_by_semester_store(spark, d), "Q4": q4_top_customers_by_store(spark, d)}
    expected = {"Q1": CMP.q1_form(found["Q1"]), "Q2_selling": CMP.q2_form(found["Q2"], 1), "Q3": CMP.q3_form(found["Q3"]), "Q4": CMP.q4_form(found["Q4"])}
    altered = {"Q1": _altered(found["Q1"], "transaction_id", "final_amount"), "Q2": found["Q2"], "Q3": _other_q3(found["Q3"]), "Q4": found["Q4"].where("store_id % 20 <> 3")}
    return CMP.compare_client("CLI1", expected, altered)


@query("SELECT n_nationkey::BIGINT AS id, n_name AS name FROM nation UNION ALL SELECT s_suppkey, s_name FROM supplier")
def combine_tables(spark, d):
    a, b = A.table(spark, d, "nation"), A.table(spark, d, "supplier")
    return CMP.combine([a.select(F.col("n_nationkey").cast("bigint").alias("id"), F.col("n_name").alias("name")), b.select(F.col("s_name").alias("name"), F.col("s_suppkey").alias("id"))])


_NUMBERED = f"""SELECT o_orderpriority AS file_id, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS row_number FROM orders"""
_CHUNKED = f"SELECT file_id, o_orderkey, ceil(row_number / {CHUNK})::INT AS chunk_number FROM ({_NUMBERED})"


def _numbered(spark, d):
    rows = A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("file_id"), "o_orderkey")
    return M.number_chunks(rows, ["file_id"], ["o_orderkey"], CHUNK)


@query(f"""SELECT file_id, chunk_number, count(*) AS n_rows, chunk_number = max(chunk_number) OVER (PARTITION BY file_id) AS is_last_chunk FROM ({_CHUNKED}) GROUP BY 1, 2""")
def chunk_manifest(spark, d):
    """From the counts of files alone."""
    return M.manifest_of(A.table(spark, d, "orders").select(F.col("o_orderpriority").alias("file_id"), "o_orderkey"), ["file_id"], CHUNK)


@query(f"""SELECT file_id, chunk_number, count(*) AS n_rows, min(o_orderkey) AS first_key, max(o_orderkey) AS last_key FROM ({_CHUNKED}) GROUP BY 1, 2""")
def numbered_chunks(spark, d):
    """Rows dealt to chunks by their order in the file."""
    return _numbered(spark, d).groupBy("file_id", "chunk_number").agg(F.count("*").alias("n_rows"), F.min("o_orderkey").alias("first_key"), F.max("o_orderkey").alias("last_key"))


# Orders in chunks of 100 rows: clients are the numbers of nations of the customers mod 3, files two digits, some chunks lost.
_NOTICES = """SELECT 'CLI' || (o_custkey % 3) AS client_id, 'TR0' || (1 + o_custkey % 2) AS file_id, 1 AS table_id,
  (o_orderkey // 100)::INT AS chunk_number, o_orderkey // 100 = (SELECT max(o_orderkey) // 100 FROM orders) AS is_last_chunk,
  (o_orderkey // 100 = (SELECT max(o_orderkey) // 100 FROM orders)) AND o_custkey % 2 = 1 AS is_last_from_table
  FROM orders WHERE NOT (o_custkey % 3 = 2 AND o_orderkey // 100 = 5)"""


def _notices(spark, d):
    orders = A.table(spark, d, "orders")
    chunk = F.floor(F.col("o_orderkey") / 100).cast("int")
    last = orders.agg(F.floor(F.max("o_orderkey") / 100).cast("int").alias("last")).scalar()
    rows = orders.where(~((F.col("o_custkey") % 3 == 2) & (chunk == 5)))
    return rows.select(
        F.concat(F.lit("CLI"), F.col("o_custkey") % 3).alias("client_id"), F.concat(F.lit("TR0"), F.col("o_custkey") % 2 + 1).alias("file_id"), F.lit(1).alias("table_id"),
        chunk.alias("chunk_number"), (chunk == last).alias("is_last_chunk"), ((chunk == last) & (F.col("o_custkey") % 2 == 1)).alias("is_last_from_table"),
    )


# Every number from 0 to the last is looked for among those that came.
_FILES = f"""SELECT client_id, file_id, table_id, last_chunk, files_named, len(list_filter(chunks, lambda c: last_chunk IS NULL OR c <= last_chunk)) AS received,
  coalesce(len(list_filter(range(0, last_chunk + 1), lambda i: NOT list_contains(chunks, i))) = 0, false) AS complete
  FROM (SELECT client_id, file_id, table_id, max(CASE WHEN is_last_chunk THEN chunk_number END) AS last_chunk, list(DISTINCT chunk_number) AS chunks,
    max(CASE WHEN is_last_from_table THEN regexp_extract(file_id, '([0-9]+)$', 1)::INT END) AS files_named FROM ({_NOTICES}) GROUP BY 1, 2, 3)"""


@query(_FILES)
def file_completeness(spark, d):
    """Chunks count from 0 here."""
    return M.file_completeness(_notices(spark, d), 0)


@query("SELECT 'CLI' || (o_custkey % 3) AS client_id, 1 AS table_id, max(1 + o_custkey % 120)::INT AS expected_files FROM orders GROUP BY 1")
def expected_files(spark, d):
    """More than a hundred files, the last of each client flagged; ids have two digits at least."""
    orders = A.table(spark, d, "orders").select(F.concat(F.lit("CLI"), F.col("o_custkey") % 3).alias("client_id"), (F.col("o_custkey") % 120 + 1).cast("int").alias("n"), F.lit(1).alias("table_id"))
    last = orders.groupBy("client_id").agg(F.max("n").alias("most"))
    named = orders.join(last, "client_id").select("client_id", "table_id", F.format_string("TR%02d", "n").alias("file_id"), (F.col("n") == F.col("most")).alias("is_last_from_table"))
    return M.expected_files(named)


_CLIENTS = f"""SELECT client_id, table_id, count(*) FILTER (complete) AS complete_files, coalesce(max(files_named), 1)::INT AS expected_files,
  count(*) FILTER (complete) >= coalesce(max(files_named), 1) AS complete FROM ({_FILES}) GROUP BY 1, 2"""


@query(_CLIENTS)
def client_completeness(spark, d):
    return M.client_completeness(_notices(spark, d), 0)


@query("""SELECT 'CLI' || (c_custkey % 5) AS client_id, count(DISTINCT CASE WHEN c_acctbal > 9000 THEN c_nationkey % 4 END) AS complete_queries,
  count(DISTINCT CASE WHEN c_acctbal > 9000 THEN c_nationkey % 4 END) >= 4 AS complete FROM customer GROUP BY 1""")
def query_completeness(spark, d):
    done = A.table(spark, d, "customer").select(F.concat(F.lit("CLI"), F.col("c_custkey") % 5).alias("client_id"), (F.col("c_nationkey") % 4).alias("query"), (F.col("c_acctbal") > 9000).alias("complete"))
    return M.query_completeness(done)


@query("SELECT range::INT AS partition FROM range(100) WHERE range NOT IN (SELECT o_custkey % 100 FROM orders WHERE o_totalprice > 495000)")
def missing_partitions(spark, d):
    got = A.table(spark, d, "orders").where("o_totalprice > 495000").select((F.col("o_custkey") % 100).cast("int").alias("partition")).distinct()
    return M.missing_partitions(got, 100)


@query("SELECT event_id, user_id, value FROM events")
def dedup_redelivered(spark, d):
    """A fifth of the events arrives twice."""
    events = A.table(spark, d, "events").select("event_id", "user_id", "value")
    return events.unionByName(events.where("event_id % 5 = 0")).dropDuplicates(["event_id"])


@query("SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber = 3")
def misplaced_rows(spark, d):
    """Rows written by bucket and read back; third lines are then said to be in the next bucket."""
    rows = A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber").distinct()
    path = scratch_path(spark, "buckets")
    L.write_buckets(rows, path, "l_orderkey", 16, by=(), fmt="parquet")
    stored = spark.read.parquet(path).withColumn("bucket", F.when(F.col("l_linenumber") == 3, (F.col("bucket") + 1) % 16).otherwise(F.col("bucket")))
    return CMP.misplaced_rows(rows, stored, "bucket", "l_orderkey", 16).select("l_orderkey", "l_linenumber")


@query("SELECT count(*) AS n_rows, count(DISTINCT (l_partkey, l_suppkey)) AS n_keys, 1::BIGINT AS buckets_of_a_key, true AS in_range FROM lineitem")
def bucket_of_each_key(spark, d):
    """Rows dealt by a composite key: none is lost, and each key has one bucket."""
    rows = A.table(spark, d, "lineitem").select("l_partkey", "l_suppkey", C.hash_bucket(100, F.col("l_partkey"), F.col("l_suppkey")).alias("bucket"))
    per = rows.groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.count_distinct("bucket").alias("b"), F.min("bucket").alias("least"), F.max("bucket").alias("most"))
    return per.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), F.max("b").alias("buckets_of_a_key"), (F.min("least").between(0, 99) & F.max("most").between(0, 99)).alias("in_range"))


def _orders_as_csv(spark, d, short=False):
    """Orders as a folder of transaction files, with headers; ``short`` also writes lines that lack fields."""
    rows = A.order_transactions(spark, d).select(
        "transaction_id", "store_id", F.lit(1).alias("payment_method_id"), F.lit(None).cast("string").alias("voucher_id"), F.concat("user_id", F.lit(".0")).alias("user_id"),
        F.col("final_amount").cast("decimal(18,2)").alias("original_amount"), F.lit(0).alias("discount_applied"), F.col("final_amount").cast("decimal(18,2)").alias("final_amount"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("created_at"),
    )
    folder = scratch_path(spark, "csv")
    rows.write.option("header", True).csv(f"{folder}/transactions")
    if short:
        lines = rows.select(F.concat_ws(",", "transaction_id", F.coalesce(F.col("store_id").cast("string"), F.lit("")), "payment_method_id"))
        lines.coalesce(4).write.option("header", False).option("quote", "").csv(f"{folder}/transactions/short")
    return folder


@query(f"""SELECT transaction_id::VARCHAR AS transaction_id, store_id::VARCHAR AS store_id, user_id, final_amount::DECIMAL(18,2)::DOUBLE AS final_amount, created_at FROM ({TX})""")
def csv_transactions(spark, d):
    """Written as CSV and read back with a schema: headers dropped, columns parsed, user ids normalised."""
    rows = T.read_table(spark, f"{_orders_as_csv(spark, d)}/transactions", "TR")
    return rows.select("transaction_id", "store_id", "user_id", "final_amount", "created_at")


@query("SELECT count(*) AS good, count(*) AS short, 'TR' AS kind FROM orders")
def csv_quarantine(spark, d):
    """Lines with too few fields are set aside and counted, others pass."""
    folder = _orders_as_csv(spark, d, short=True)
    good, bad = T.split_good_bad(T.read_raw(spark, f"{folder}/transactions", TRANSACTIONS), TRANSACTIONS)
    both = good.select("file_path", F.lit(1).alias("good"), F.lit(0).alias("short")).unionByName(bad.select("file_path", F.lit(0).alias("good"), F.lit(1).alias("short")))
    return both.groupBy(T.classify(F.col("file_path")).alias("kind")).agg(F.sum("good").alias("good"), F.sum("short").alias("short"))


_LABEL = """'st, "' || store_id || '"' || chr(10) || 'x'"""
_CLIENT_LINES = f"SELECT '{{}}' AS client_id, year::VARCHAR AS year, semester::VARCHAR AS semester, {_LABEL} AS label, total_final_amount::DECIMAL(18,2)::VARCHAR AS tpv FROM ({STORE_SEMESTER})"


@query(" UNION ALL ".join(_CLIENT_LINES.format(c) for c in ("01", "1", "a b/c:1")))
def result_files(spark, d):
    """Result lines of clients whose ids look like numbers or paths, written and read back; a field holds commas, quotes and a line break."""
    label = F.concat(F.lit('st, "'), F.col("store_id").cast("string"), F.lit('"\nx'))
    rows = agg_store_semester(spark, d).select("year", "semester", label.alias("label"), F.col("total_final_amount").alias("tpv"))
    path = scratch_path(spark, "results")
    write_result_files(CMP.combine([result_lines(rows, 3, c) for c in ("01", "1", "a b/c:1")]), path)
    return read_result_files(spark, path, 3, rows.columns)


# Ids of clients and chunks that look like numbers, dates and paths, and none.
_ODD_ID = "CASE event_id % 7 WHEN 0 THEN '01' WHEN 1 THEN '1' WHEN 2 THEN '1e3' WHEN 3 THEN '2024-01-01' WHEN 4 THEN 'a b/c:1' WHEN 5 THEN '1.0' END"


def _odd_ids(spark, d):
    return A.table(spark, d, "events").select(F.expr(_ODD_ID).alias("client_id"), F.col("event_id").alias("row_number"), "value")


@query(f"SELECT {_ODD_ID} AS client_id, event_id AS row_number, value FROM events")
def idempotent_append(spark, d):
    """A batch delivered twice is stored once, in folders of ids such as 01 and 1."""
    rows, path = _odd_ids(spark, d), scratch_path(spark, "append")
    for batch in (rows.where("value < 50"), rows, rows):
        L.append_missing(batch, path, ("client_id", "row_number"), partition_by="client_id")
    return L.read_stored(spark, path, rows.schema)


@query(f"SELECT {_ODD_ID} AS client_id, event_type AS chunk_id, event_id AS row_number, value FROM events")
def replaced_chunks(spark, d):
    """Chunks that are delivered whole replace themselves: half of them come again, and nothing stored is read for it."""
    rows, path = _odd_ids(spark, d).join(A.table(spark, d, "events").select(F.col("event_id").alias("row_number"), F.col("event_type").alias("chunk_id")), "row_number"), scratch_path(spark, "chunks")
    for batch in (rows, rows.where("client_id IN ('01', 'a b/c:1') OR client_id IS NULL")):
        L.replace_partitions(batch, path, ["client_id", "chunk_id"])
    return L.read_stored(spark, path, rows.schema)


@query(f"SELECT * FROM (SELECT {_ODD_ID} AS client_id, event_id AS row_number, value FROM events) WHERE client_id IN ('1', '2024-01-01', '1.0')")
def drop_finished_client(spark, d):
    """Finished clients' partitions are removed, that of 01 but not of 1, and that of rows without client; the others stay."""
    rows, path = _odd_ids(spark, d), scratch_path(spark, "clients")
    rows.write.partitionBy("client_id").parquet(path)
    for client in ("01", "1e3", "a b/c:1", None, "nobody"):
        L.drop_client(path, spark, client, rows.schema)
    return L.read_stored(spark, path, rows.schema)


def _as_csv(spark, frames: dict[str, DataFrame]) -> str:
    """Tables as CSV files with headers, in a folder of the name of each."""
    folder = scratch_path(spark, "csv")
    for name, df in frames.items():
        df.write.option("header", True).option("escape", '"').option("timestampNTZFormat", "yyyy-MM-dd HH:mm:ss").csv(f"{folder}/{name}")
    return folder


def _item_file(spark, d):
    price = F.col("l_extendedprice").cast("decimal(18,2)")
    return A.table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("transaction_id"), F.col("l_partkey").alias("item_id"), F.col("l_quantity").cast("int").alias("quantity"), price.alias("unit_price"), price.alias("subtotal"),
        F.col("l_shipdate").alias("created_at"),
    )


def _menu_file(spark, d):
    none = [F.lit(None).cast("string").alias(c) for c in ("available_from", "available_to")]
    return A.menu(spark, d).select("item_id", "item_name", "coffee_category", F.col("price").cast("decimal(18,2)"), "is_seasonal", *none)


def _store_file(spark, d):
    none = [F.lit(None).cast("string").alias(c) for c in ("street", "postal_code", "state", "latitude", "longitude")]
    return A.stores(spark, d).withColumn("city", F.col("city").cast("string")).select("store_id", "store_name", *none).join(A.stores(spark, d).select("store_id", "city"), "store_id").select(STORES.names)


def _user_file(spark, d):
    return A.users(spark, d).select(F.concat("user_id", F.lit(".0")).alias("user_id"), "gender", "birthdate", F.col("registered_at").cast("decimal(18,2)"))


@query("""SELECT l_orderkey::VARCHAR AS transaction_id, l_partkey::VARCHAR AS item_id, l_quantity::BIGINT AS quantity, l_extendedprice::DECIMAL(18,2)::DOUBLE AS subtotal,
  l_shipdate AS created_at FROM lineitem""")
def csv_transaction_items(spark, d):
    rows = T.read_table(spark, f"{_as_csv(spark, {'transaction_items': _item_file(spark, d)})}/transaction_items", "TI")
    return rows.select("transaction_id", "item_id", "quantity", F.col("subtotal").cast("double").alias("subtotal"), "created_at")


@query("SELECT p_partkey::VARCHAR AS item_id, p_name AS item_name, p_type AS coffee_category, p_retailprice::DECIMAL(18,2)::VARCHAR AS price, 'False' AS is_seasonal, NULL::VARCHAR AS available_from FROM part")
def csv_menu_items(spark, d):
    rows = T.read_table(spark, f"{_as_csv(spark, {'menu_items': _menu_file(spark, d)})}/menu_items", "MN")
    return rows.select("item_id", "item_name", "coffee_category", "price", "is_seasonal", "available_from")


@query("SELECT n_nationkey::VARCHAR AS store_id, n_name AS store_name, NULL::VARCHAR AS street, n_regionkey::VARCHAR AS city FROM nation")
def csv_stores(spark, d):
    rows = T.read_table(spark, f"{_as_csv(spark, {'stores': _store_file(spark, d)})}/stores", "ST")
    return rows.select("store_id", "store_name", "street", "city")


@query("SELECT c_custkey AS user_id, c_mktsegment AS gender, c_name AS birthdate, c_acctbal::DECIMAL(18,2)::VARCHAR AS registered_at FROM customer")
def csv_users(spark, d):
    """Ids such as 123.0 become numbers."""
    rows = T.read_table(spark, f"{_as_csv(spark, {'users': _user_file(spark, d)})}/users", "US")
    return rows.select("user_id", "gender", "birthdate", "registered_at")


@query("""SELECT kind, count(*) AS n_rows, count(*) AS n_places, true AS in_one_file FROM (SELECT 'TI' AS kind FROM lineitem UNION ALL SELECT 'MN' FROM part UNION ALL SELECT 'US' FROM customer) GROUP BY 1""")
def csv_lineage(spark, d):
    """Every row read has a place of its own, in a file that is listed under its kind with a number."""
    folder = _as_csv(spark, {"transaction_items": _item_file(spark, d), "menu_items": _menu_file(spark, d), "users": _user_file(spark, d)})
    files = T.list_files(spark, folder).select(F.col("path").alias("file_path"), "kind", "file_id")
    rows = None
    for name, kind in (("transaction_items", "TI"), ("menu_items", "MN"), ("users", "US")):
        part = T.read_table(spark, f"{folder}/{name}", kind).select("file_path", "line")
        rows = part if rows is None else rows.unionByName(part)
    per = T.places(rows).join(files, "file_path")
    ids = F.count_distinct("file_id") == F.count("*")
    return per.groupBy("kind").agg(F.sum("n").alias("n_rows"), F.sum("places").alias("n_places"), (ids & F.every(F.startswith("file_id", "kind"))).alias("in_one_file"))


@query("SELECT 'MN' AS kind, true AS matches, count(*) AS n_rows FROM part UNION ALL SELECT 'US', false, count(*) FROM customer")
def csv_headers(spark, d):
    """Files whose header fits their kind's columns and files whose header does not (columns in another order), with their rows."""
    folder = _as_csv(spark, {"menu_items": _menu_file(spark, d), "users": _user_file(spark, d).select("gender", "user_id", "birthdate", "registered_at")})
    found = T.header_matches(spark, f"{folder}/menu_items", MENU_ITEMS).unionByName(T.header_matches(spark, f"{folder}/users", USERS))
    lines = spark.read.option("recursiveFileLookup", True).csv(folder, header=True).select(F.col("_metadata.file_path").alias("file_path"))
    return lines.join(found, "file_path").groupBy(T.classify(F.col("file_path")).alias("kind"), "matches").agg(F.count("*").alias("n_rows"))


@query("""SELECT o_orderkey % 3 = 0 AS made, 1::BIGINT AS rows_of_id, CASE WHEN o_orderkey % 3 = 0 THEN NULL ELSE 'TXN_old' || o_orderkey END AS old_id, o_custkey::VARCHAR AS user_id,
  CASE WHEN o_orderkey % 4 = 0 THEN 0.0 ELSE o_totalprice::DECIMAL(18,2)::DOUBLE END AS final_amount, 9.5::DOUBLE AS unit_price, 'S' || o_orderpriority AS store_id, 'Shop, ' || o_orderpriority AS store_name,
  'Nowhere' AS city FROM orders""")
def csv_unknown_header(spark, d):
    """A file with names of its own: columns found by patterns of several words, unreadable amounts and missing columns by default, missing ids made of
    file and line, each once."""
    k = F.col("o_orderkey")
    odd = A.table(spark, d, "orders").select(
        F.when(k % 3 != 0, F.concat(F.lit("TXN_old"), k)).alias("Transaction ID"), F.col("o_custkey").alias("Customer Number"),
        F.when(k % 4 == 0, F.lit("n/a")).otherwise(F.col("o_totalprice").cast("decimal(18,2)").cast("string")).alias("Total_Price"), F.lit("9.50").alias("Price, each"),
        F.concat(F.lit("Shop, "), "o_orderpriority").alias("Store Name"), F.concat(F.lit("S"), "o_orderpriority").alias("ID of store"),
    )
    raw = T.read_unknown(spark, f"{_as_csv(spark, {'unknown': odd})}/unknown")
    wanted = {
        "transaction_id": ([("transaction", "id")], "string", T.made_id("TXN")), "user_id": (["customer", "user"], "string", T.made_id("CUST", cycle=1000)), "unit_price": ([("price", "!total")], "double", 10.0),
        "final_amount": (["total", "amount"], "double", 0.0), "store_id": ([("store", "id")], "string", "ST01"), "store_name": ([("store", "name")], "string", "Store"), "city": (["city"], "string", "Nowhere"),
    }
    rows = T.map_columns(raw, wanted)
    per_id = F.count("*").over(Window.partitionBy("transaction_id"))
    old = F.startswith("transaction_id", F.lit("TXN_old"))
    return rows.select((~old).alias("made"), per_id.alias("rows_of_id"), F.when(old, F.col("transaction_id")).alias("old_id"), "user_id", "final_amount", "unit_price", "store_id", "store_name", "city")


#: Splits of a few thousand bytes are read by so many tasks, else each would be a task and report to the driver.
SPLIT_TASKS = 256


@contextmanager
def _split_at(spark, size: int):
    """Files are split at ``size`` bytes in here; a task reads several splits where there are more than ``SPLIT_TASKS``."""
    names = {"spark.sql.files.maxPartitionBytes": str(size), "spark.sql.files.maxPartitionNum": str(SPLIT_TASKS)}
    before = {n: spark.conf.get(n, None) for n in names}
    for n, value in names.items():
        spark.conf.set(n, value)
    try:
        yield
    finally:
        for n, value in before.items():
            if value is None:
                spark.conf.unset(n)
            else:
                spark.conf.set(n, value)


def _kept(df: DataFrame, tag: str) -> DataFrame:
    path = scratch_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@query("""SELECT p_partkey::VARCHAR AS item_id, CASE p_partkey % 3 WHEN 0 THEN p_name || ' "XL", ' || chr(10) || chr(10) || '"hot"' WHEN 1 THEN p_name || ',' ELSE p_name END AS item_name, p_type AS coffee_category,
  p_retailprice::DECIMAL(18,2)::VARCHAR AS price FROM part""")
def csv_quoted_records(spark, d):
    """Names with commas, doubled quotes and line breaks, in files that are split every two thousand bytes, within quotes too."""
    k, name = F.expr("CAST(item_id AS BIGINT)") % 3, F.col("item_name")
    odd = F.when(k == 0, F.concat(name, F.lit(' "XL", \n\n"hot"'))).when(k == 1, F.concat(name, F.lit(","))).otherwise(name)
    folder = _as_csv(spark, {"menu_items": _menu_file(spark, d).withColumn("item_name", odd)})
    with _split_at(spark, 2000):
        return _kept(T.read_table(spark, f"{folder}/menu_items", "MN").select("item_id", "item_name", "coffee_category", "price"), "quoted")


@query("SELECT o_orderkey::VARCHAR AS transaction_id, o_totalprice::DECIMAL(18,2)::DOUBLE AS final_amount, 2::BIGINT AS deliveries FROM orders")
def csv_delivered_twice(spark, d):
    """Files read twice, split in other places the second time: rows have the same numbers, so a second delivery adds nothing."""
    folder = f"{_orders_as_csv(spark, d)}/transactions"
    reads = []
    for size in (128 << 20, 20_000):
        with _split_at(spark, size):
            reads.append(_kept(T.read_table(spark, folder, "TR").select(F.xxhash64("file_path").alias("file"), "line", "transaction_id", "final_amount"), "delivery"))
    # Rows are shuffled under a number for their file's long path; two files of one number would still differ by the id.
    per = reads[0].unionByName(reads[1]).groupBy("file", "line", "transaction_id", "final_amount").agg(F.count("*").alias("deliveries"))
    return per.select("transaction_id", "final_amount", "deliveries")


@query("SELECT count(*) AS n_rows, (SELECT count(*) FROM orders) + count(DISTINCT o_orderpriority) AS last_lines, true AS in_order FROM orders")
def csv_line_numbers(spark, d):
    """Lines are numbered from 1 in the order of the file, header included: each file was written in the order of its keys."""
    rows = A.order_transactions(spark, d).join(A.table(spark, d, "orders").select(F.col("o_orderkey").alias("transaction_id"), "o_orderpriority"), "transaction_id")
    part = rows.select(F.col("transaction_id").cast("string").alias("transaction_id"), F.lpad(F.col("transaction_id").cast("string"), 12, "0").alias("store_id"), "o_orderpriority").repartition("o_orderpriority").sortWithinPartitions("o_orderpriority", "store_id")
    filled = part.select(*(F.col(c) if c in part.columns else F.lit(None).cast("string").alias(c) for c in TRANSACTIONS.names), "o_orderpriority")
    folder = scratch_path(spark, "csv")
    filled.write.option("header", True).partitionBy("o_orderpriority").csv(folder)
    with _split_at(spark, 30_000):
        read = _kept(T.split_good_bad(T.read_raw(spark, folder, TRANSACTIONS), TRANSACTIONS)[0].select("file_path", "line", "store_id"), "numbered")
    before = F.lag("store_id").over(Window.partitionBy("file_path").orderBy("line"))
    per = read.withColumn("up", F.coalesce(before < F.col("store_id"), F.lit(True))).groupBy("file_path").agg(F.count("*").alias("n"), F.max("line").alias("last"), F.every("up").alias("up"))
    return per.agg(F.sum("n").alias("n_rows"), F.sum("last").alias("last_lines"), (F.every("up") & F.every(F.col("last") == F.col("n") + 1)).alias("in_order"))


@query("SELECT n_nationkey::VARCHAR AS store_id, n_name AS store_name, true AS header_fits FROM nation")
def csv_blank_lines(spark, d):
    """Empty lines, lines of blanks and commas, and a header whose names are quoted, ended by carriage returns too."""
    stores = A.stores(spark, d).select(F.concat(F.lit('"'), "store_id", F.lit('","'), "store_name", F.lit('",,,,,,')).alias("line"))
    lines = stores.select(F.explode(F.array(F.lit('"store_id","store_name","street","postal_code","city","state","latitude","longitude"'), F.lit(""), F.lit("  "), F.lit(",,,,,,,"), "line")).alias("value"))
    folder = scratch_path(spark, "csv")
    lines.coalesce(1).write.option("lineSep", "\r\n").text(f"{folder}/stores")
    good = T.split_good_bad(T.read_raw(spark, f"{folder}/stores", STORES, glob="*.txt"), STORES)[0]
    fits = T.header_matches(spark, f"{folder}/stores", STORES, glob="*.txt")
    return good.join(fits, "file_path").select("store_id", "store_name", F.col("matches").alias("header_fits"))


@query(f"SELECT s.*, n_name AS store_name, n_regionkey::VARCHAR AS city FROM ({STORE_SEMESTER}) s LEFT JOIN nation ON store_id = n_nationkey")
def csv_grouped(spark, d):
    """Aggregates saved as CSV and read again: recognised as grouped by their header, they go straight to the join."""
    saved = scratch_path(spark, "grouped")
    write_csv(agg_store_semester(spark, d), saved, STORES_GROUPED.names)
    grouped = T.read_grouped(spark, saved, STORES_GROUPED)
    if not T.is_grouped(grouped, "year", "semester"):
        grouped = aggregate(grouped, 3)
    stores = T.read_table(spark, f"{_as_csv(spark, {'stores': _store_file(spark, d)})}/stores", "ST").select("store_id", "store_name", "city")
    return J.transactions_with_stores(grouped, stores).withColumn("store_id", F.col("store_id").cast("int"))


@query(f"SELECT user_id::VARCHAR AS user_id, store_id::VARCHAR AS store_id, count::VARCHAR AS count FROM ({USER_STORE})")
def csv_result(spark, d):
    """A result as CSV with a header and a fixed order of columns."""
    path = scratch_path(spark, "result")
    write_csv(agg_user_store(spark, d), path, ["store_id", "user_id", "count"])
    found = spark.read.option("header", True).csv(path)
    return found.select("user_id", "store_id", "count") if found.columns == ["store_id", "user_id", "count"] else found


@query("""SELECT count(*) AS n_rows, count(DISTINCT o_orderkey % 1000) AS users, count(DISTINCT o_orderkey % 10) AS stores, round(sum((2.5 + (o_orderkey % 20) * 0.25) * (o_orderkey % 5 + 1))::DOUBLE, 2) AS total
  FROM (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS o_orderkey FROM orders)""")
def simulated_load(spark, d):
    """Simulated transactions, one for each order there is."""
    tx = T.simulated_transactions(spark, A.table(spark, d, "orders").count())
    return tx.agg(F.count("*").alias("n_rows"), F.count_distinct("user_id").alias("users"), F.count_distinct("store_id").alias("stores"), F.round(F.sum("final_amount"), 2).alias("total"))


@query("SELECT count(*) AS n_rows, count(*) AS n_joined, least(count(*), 50)::BIGINT AS n_stores, sum(i % 100 + 1)::BIGINT AS purchases FROM (SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS i FROM customer)")
def simulated_customers(spark, d):
    """Simulated users and top users, as many as there are customers."""
    n = A.table(spark, d, "customer").count()
    users, top = T.simulated_users(spark, n), T.simulated_top_users(spark, n)
    joined = top.join(users, "user_id")
    return joined.agg(F.count("*").alias("n_joined"), F.count_distinct("store_id").alias("n_stores"), F.sum("purchase_count").alias("purchases")).withColumn("n_rows", F.lit(n).cast("bigint"))


@query("SELECT 'TR' AS kind, count(*) AS n_rows FROM events WHERE year(ts) = 2024 UNION ALL SELECT 'TI', count(*) FROM lineitem WHERE year(l_shipdate) = 1997 UNION ALL SELECT 'MN', count(*) FROM part")
def filter_year_by_kind(spark, d):
    """Each kind of table by its own timestamp column; menu items have none and stay."""
    tables = {"TR": A.event_transactions(A.table(spark, d, "events")), "TI": A.items(spark, d), "MN": A.menu(spark, d)}
    years = {"TR": (2024,), "TI": (1997,), "MN": (1997,)}
    out = None
    for kind, df in tables.items():
        part = P.rows_in_years(df, kind, years[kind]).agg(F.count("*").alias("n_rows")).select(F.lit(kind).alias("kind"), "n_rows")
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT o_orderkey, o_totalprice AS amount FROM orders WHERE o_orderkey % 4 = 0")
def numeric_validity(spark, d):
    """Rows whose amount is no number are dropped."""
    k, text = F.col("o_orderkey"), F.col("o_totalprice").cast("string")
    amount = F.when(k % 4 == 0, text).when(k % 4 == 1, F.concat(text, F.lit("d"))).when(k % 4 == 2, F.lit("")).otherwise(F.lit("x1"))
    return A.table(spark, d, "orders").select("o_orderkey", C.lenient_double(amount).alias("amount")).where(P.is_number(F.col("amount")))


@query("""SELECT count(*) FILTER (kind IN ('TR', 'TI')) AS facts, count(*) FILTER (kind IN ('MN', 'ST', 'US')) AS dimensions, count(*) FILTER (kind = 'US') AS users FROM (SELECT 'TR' AS kind FROM orders
  UNION ALL SELECT 'TI' FROM lineitem UNION ALL SELECT 'MN' FROM part UNION ALL SELECT 'ST' FROM nation UNION ALL SELECT 'US' FROM customer)""")
def table_kinds(spark, d):
    """Rows by the kind of the folder they would be read from."""
    folders = {"orders": "transactions/a.csv", "lineitem": "Transaction_Items/b.csv", "part": "menu_items/c.csv", "nation": "stores/d.csv", "customer": "users/e.csv"}
    rows = None
    for name, path in folders.items():
        part = A.table(spark, d, name).select(T.classify(F.lit(f"/data/{path}")).alias("kind"))
        rows = part if rows is None else rows.unionByName(part)
    kind = F.col("kind")
    return rows.agg(F.count_if(P.is_fact(kind)).alias("facts"), F.count_if(P.is_dimension(kind)).alias("dimensions"), F.count_if(P.is_users(kind)).alias("users"))


@query(f"SELECT count(*) AS n_rows, 0::BIGINT AS out_of_order FROM ({USER_STORE})")
def sorted_result(spark, d):
    """A result written in the order of its keys; each row is compared with the one before it in the files."""
    path = scratch_path(spark, "sorted")
    sorted_by_keys(agg_user_store(spark, d), 4).write.csv(path, header=True)
    rows = spark.read.csv(path, header=True, schema="user_id bigint, store_id bigint, count bigint")
    placed = rows.select("*", F.col("_metadata.file_name").alias("file"), F.monotonically_increasing_id().alias("line"))
    key = F.struct("user_id", "store_id")
    edges = placed.groupBy("file").agg(F.min(key).alias("least"), F.max(key).alias("most"), F.min_by(key, "line").alias("first"), F.max_by(key, "line").alias("last"), F.count("*").alias("n"))
    before = F.lag("most").over(Window.orderBy("file"))  # a row for each file
    wrong = (F.col("least") != F.col("first")) | (F.col("most") != F.col("last")) | (F.col("least") <= F.col("before"))
    return edges.withColumn("before", before).agg(F.sum("n").alias("n_rows"), F.count_if(wrong).alias("out_of_order"))


@query(f"SELECT count(*) AS rows, count(*) FILTER (hour(created_at) BETWEEN 6 AND 23) AS in_hours, count(*) FILTER (final_amount >= 75) AS large FROM ({EVENT_TX})")
def step_counters(spark, d):
    """Counters of a step, filled while it runs."""
    rows, seen = with_counters(_events(spark, d), f"step-{uuid.uuid4().hex}", in_hours=P.in_hours(F.col("created_at")), large=P.at_least(F.col("final_amount")))
    rows.write.format("noop").mode("overwrite").save()
    return spark.createDataFrame([seen.get], "rows bigint, in_hours bigint, large bigint")


@query("SELECT l_orderkey, l_linenumber, s_name FROM lineitem LEFT JOIN supplier ON l_suppkey = s_suppkey")
def measured_broadcast_join(spark, d):
    """A dimension is counted and measured before it is broadcast."""
    dim = J.broadcast_below(A.table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name"))
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey").join(dim, "l_suppkey", "left").drop("l_suppkey")


@query(f"""SELECT 'Q1' AS query, count(*) AS n_rows FROM ({EVENT_TX}) WHERE hour(created_at) BETWEEN 6 AND 23 AND final_amount >= 75 UNION ALL
SELECT 'Q3', count(*) FROM ({EVENT_TX}) WHERE hour(created_at) BETWEEN 6 AND 23 UNION ALL SELECT 'Q4', count(*) FROM ({EVENT_TX}) WHERE user_id IS NOT NULL""")
def one_input_many_queries(spark, d):
    """One table feeds three queries."""
    hours = P.in_hours(F.col("created_at"))
    views = J.one_input_many_queries(_events(spark, d), {"Q1": hours & P.at_least(F.col("final_amount")), "Q3": hours, "Q4": F.col("user_id").isNotNull()})
    counts = [v.agg(F.count("*").alias("n_rows")).select(F.lit(q).alias("query"), "n_rows") for q, v in views.items()]
    return CMP.combine(counts)


_ALL = f"""SELECT 'Q1' AS query, transaction_id::VARCHAR AS a, NULL AS b, NULL AS c, final_amount::DECIMAL(18,2)::DOUBLE AS v FROM ({EVENT_TX})
  WHERE hour(created_at) BETWEEN 6 AND 23 AND final_amount::DECIMAL(18,2) >= 75
UNION ALL SELECT 'Q2', year || '-' || month, item_id::VARCHAR, item_name, subtotal FROM ({_Q2})
UNION ALL SELECT 'Q3', year || '-' || semester, store_id, NULL, total_final_amount FROM ({SQL["q3_tpv_hour_filtered"]})
UNION ALL SELECT 'Q4', store_id, user_id::VARCHAR, c_name, purchase_count FROM (SELECT user_id, store_id, count AS purchase_count, row_number() OVER (PARTITION BY store_id ORDER BY count DESC, user_id) AS rn
  FROM (SELECT user_id, store_id, count(*) AS count FROM ({EVENT_TX}) GROUP BY 1, 2)) JOIN customer ON user_id = c_custkey WHERE rn <= 3"""
_ALL = _ALL.replace("DESC, item_id)", "DESC, item_id::VARCHAR)")  # item ids are text in files, so ties go by text
_CLIENT = "SELECT 'CLI{}' AS client_id, * FROM ({})"


_ALL_2 = _ALL.replace("FROM events", "FROM (SELECT * FROM events WHERE user_id % 2 = 0)").replace("FROM lineitem", "FROM (SELECT * FROM lineitem WHERE l_partkey % 3 = 0)")


@query(f"{_CLIENT.format(1, _ALL)} UNION ALL {_CLIENT.format(2, _ALL_2)}")
def all_queries_csv(spark, d):
    """All four queries in one run over CSV tables of two clients, of whom the second sent fewer rows, under the same ids."""
    none = [F.lit(None).cast("string").alias(c) for c in ("payment_method_id", "voucher_id")]
    money = F.col("final_amount").cast("decimal(18,2)")
    tx = _events(spark, d).select("transaction_id", "store_id", *none, F.concat("user_id", F.lit(".0")).alias("user_id"), money.alias("original_amount"), F.lit(0).alias("discount_applied"), money.alias("final_amount"), "created_at")
    frames = {"transactions": tx, "transaction_items": _item_file(spark, d), "menu_items": _menu_file(spark, d), "stores": _store_file(spark, d), "users": _user_file(spark, d)}
    fewer = {"transactions": frames["transactions"].where("CAST(CAST(user_id AS DOUBLE) AS BIGINT) % 2 = 0"), "transaction_items": frames["transaction_items"].where("item_id % 3 = 0")}
    folders = [_as_csv(spark, frames), _as_csv(spark, frames | fewer)]
    kinds = {"TR": "transactions", "TI": "transaction_items", "MN": "menu_items", "ST": "stores", "US": "users"}
    tables = {k: CMP.combine([T.read_table(spark, f"{f}/{name}", k).withColumn("client_id", F.lit(f"CLI{i + 1}")) for i, f in enumerate(folders)]) for k, name in kinds.items()}
    tables["TR"] = _kept(tables["TR"], "transactions")  # three queries read them: parsed once
    found = Q.all_queries(tables, (*YEARS, 2024, 2025), by=["client_id"])
    none = F.lit(None).cast("string")
    shape = lambda q, a, b, c, v: found[q].select("client_id", F.lit(q).alias("query"), a.alias("a"), b.alias("b"), c.alias("c"), v.cast("double").alias("v"))
    text = lambda *names: F.concat_ws("-", *names) if len(names) > 1 else F.col(names[0]).cast("string")
    return CMP.combine([
        shape("Q1", text("transaction_id"), none, none, F.col("final_amount")), shape("Q2", text("year", "month"), text("item_id"), text("item_name"), F.col("subtotal")),
        shape("Q3", text("year", "semester"), text("store_id"), none, F.col("total_final_amount")), shape("Q4", text("store_id"), text("user_id"), text("birthdate"), F.col("purchase_count")),
    ])


def _event_stream(spark, d):
    return S.file_stream(spark, f"{d}/event[s].parquet", A.table(spark, d, "events").schema)


@query(Q1_SQL)
def stream_q1(spark, d):
    return S.run_and_read(Q.filtered_transactions(A.event_transactions(_event_stream(spark, d))))


@query("SELECT user_id, event_type AS store_id, count(*) AS count FROM events GROUP BY 1, 2")
def stream_agg_user_store(spark, d):
    return S.run_and_read(S.streaming_aggregate(A.event_transactions(S.drop_redelivered(_event_stream(spark, d), ["event_id"])), 4), "complete")


@query("""SELECT user_id, store_id, count AS purchase_count, rn::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY store_id ORDER BY count DESC, user_id) AS rn
  FROM (SELECT user_id, event_type AS store_id, count(*) AS count FROM events GROUP BY 1, 2)) WHERE rn <= 3""")
def stream_top3(spark, d):
    return S.run_and_read(S.streaming_aggregate(A.event_transactions(_event_stream(spark, d)), 4), "complete", S.rank_batch())


@query("SELECT event_id, c_custkey AS user_id, c_name FROM events LEFT JOIN customer ON user_id = c_custkey WHERE c_custkey IS NOT NULL UNION ALL SELECT event_id, user_id, NULL FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer)")
def stream_dim_join(spark, d):
    dim = A.table(spark, d, "customer").select(F.col("c_custkey").alias("user_id"), "c_name")
    return S.run_and_read(S.with_static(_event_stream(spark, d).select("event_id", "user_id"), dim, "user_id").select("event_id", "user_id", "c_name"))


@query("SELECT user_id, sum(event_id)::BIGINT AS total, count(*) AS chunks FROM events GROUP BY 1 HAVING count(*) >= 60")
def stream_running_sum(spark, d):
    """The sum per user, given once enough of its events have arrived."""
    return S.run_and_read(S.running_sum(_event_stream(spark, d), ["event_id"], "user_id", "event_id", 60), "complete")


@query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def stream_late_client(spark, d):
    """Events of finished clients are dropped in each batch."""
    finished = A.table(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return S.run_and_read(_event_stream(spark, d).select("event_id", "user_id"), per_batch=lambda b: S.without_finished(b, finished, "user_id"))


@query("SELECT user_id, event_type AS store_id, count(*) AS count FROM events GROUP BY 1, 2")
def stream_restart(spark, d):
    """A stream that ends after part of the files goes on from its checkpoint when more have come, some rows of them again."""
    events = A.table(spark, d, "events")
    src, out, checkpoint = (scratch_path(spark, n) for n in ("restart-src", "restart-out", "restart-checkpoint"))
    for part in (events.where("value < 50"), events.where("value >= 40 OR value IS NULL OR isnan(value)")):
        part.repartition(2).write.mode("append").parquet(src)
        stream = S.drop_redelivered(S.file_stream(spark, src, events.schema, files_per_trigger=1), ["event_id"])
        S.complete_run(S.streaming_aggregate(A.event_transactions(stream), 4), out, checkpoint)
    return S.read_published(spark, out)


@query("""SELECT CASE o_custkey % 3 WHEN 0 THEN '01' ELSE '1' END AS client_id, o_orderpriority AS store_id, round(sum(o_totalprice::DECIMAL(18,2)), 2)::DOUBLE AS total, count(*) AS count
  FROM orders WHERE o_custkey % 3 < 2 GROUP BY 1, 2""")
def stream_client_answers(spark, d):
    """Chunks of three clients, some of them twice, in two runs; one client lacks a chunk and has no answer, the others one each, given when they are whole."""
    orders = A.table(spark, d, "orders")
    client = F.when(F.col("o_custkey") % 3 == 0, "01").when(F.col("o_custkey") % 3 == 1, "1").otherwise("c")
    chunks = orders.select(
        client.alias("client_id"), F.concat(F.lit("TR0"), F.col("o_orderkey") % 2 + 1).alias("file_id"), (F.col("o_custkey") % 4).cast("int").alias("chunk_number"),
        (F.col("o_custkey") % 4 == 3).alias("is_last_chunk"), ((F.col("o_custkey") % 4 == 3) & (F.col("o_orderkey") % 2 == 1)).alias("is_last_from_table"), F.col("o_orderpriority").alias("store_id"), F.col("o_totalprice").alias("amount"),
    ).where("NOT (client_id = 'c' AND chunk_number = 2)")
    src, out, checkpoint = (scratch_path(spark, n) for n in ("clients-src", "clients-out", "clients-checkpoint"))
    by = ["client_id", "file_id", "chunk_number"]
    for i, part in enumerate((chunks.where("chunk_number < 3"), chunks.where("chunk_number = 1 AND client_id <> '1'"), chunks.where("chunk_number >= 2"))):
        part.repartition(*by).write.partitionBy(*by).parquet(f"{src}/delivery={i}")
        if i:
            stream = S.file_stream(spark, src, chunks.schema)
            S.append_run(client_aggregates(stream, ["store_id"], "amount", buckets=2, first=0), out, checkpoint)
    return spark.read.schema("client_id string, store_id string, total double, count bigint").parquet(out).drop("batch").withColumn("total", F.round("total", 2))


@query(TOP_USERS)
def stream_top_users(spark, d):
    """Rankings from counts that grow as batches arrive: three users a store are held, whatever has come."""
    counts = _kept(agg_user_store(spark, d), "counts")
    src, out, checkpoint = (scratch_path(spark, n) for n in ("top-src", "top-out", "top-checkpoint"))
    seen = 0
    for part in (counts.withColumn("count", F.lit(1).cast("bigint")), counts):
        part.write.mode("append").parquet(src)
        there = len(spark.read.schema(counts.schema).parquet(src).inputFiles())
        stream = S.file_stream(spark, src, counts.schema, files_per_trigger=-(-(there - seen) // 2))  # two batches a delivery
        seen = there
        S.upsert_run(streaming_top_users(stream), ["store_id", "rank"], out, checkpoint)
    return S.read_upserted(spark, out, ["store_id", "rank"]).select("user_id", F.col("store_id").cast("bigint").alias("store_id"), "purchase_count", "rank")


@query(f"SELECT 'events' AS step, count(*) AS n_rows, count(*) FILTER (hour(created_at) BETWEEN 6 AND 23) AS in_hours, count(*) FILTER (final_amount >= 75) AS large FROM ({EVENT_TX})")
def stream_counters(spark, d):
    """Counters of each batch of a stream that is stopped and started again, as a table."""
    events = A.table(spark, d, "events")
    src, out, checkpoint, table = (scratch_path(spark, n) for n in ("counted-src", "counted-out", "counted-checkpoint", "counters"))
    with S.CounterTable(spark, table) as counters:
        for part in (events.where("event_id % 2 = 0"), events.where("event_id % 2 = 1")):
            part.repartition(2).write.mode("append").parquet(src)
            rows = A.event_transactions(S.file_stream(spark, src, events.schema, files_per_trigger=1))
            S.append_run(S.with_stream_counters(rows, "events", in_hours=P.in_hours(F.col("created_at")), large=P.at_least(F.col("final_amount"))), out, checkpoint)
    return counters.read().groupBy("step").pivot("counter", ["rows", "in_hours", "large"]).agg(F.sum("value")).withColumnRenamed("rows", "n_rows")
