"""Registered queries over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector
from pyspark.sql import functions as F

from millrace.functions import numbers, text, times
from millrace.operators import rows, series
from millrace.plans import batch, classify, scd
from millrace.registry import QUERIES, SQL, Query, money, query, t
from millrace.scratch import Scratch, materialise
from millrace.sources import files
from millrace.streaming import windows

def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


# aggregates, top-k, joins


@query("SELECT o_custkey, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_amount FROM orders GROUP BY o_custkey ORDER BY total_amount DESC, o_custkey LIMIT 5")
def top5_customers(spark, sf):
    return rows.top_k(t(spark, sf, "orders").groupBy("o_custkey").agg(F.sum(money("o_totalprice")).cast("double").alias("total_amount")), "total_amount", 5, ["o_custkey"])


@query("SELECT n_name AS city, count(DISTINCT c_custkey) AS customer_count FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_acctbal > 0 GROUP BY n_name")
def customers_per_city(spark, sf):
    own = t(spark, sf, "customer").filter("c_acctbal > 0").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return own.groupBy(F.col("n_name").alias("city")).agg(F.countDistinct("c_custkey").alias("customer_count"))


@query("SELECT round(CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) / count(*), 4) AS average_transaction_value FROM orders")
def avg_transaction(spark, sf):
    return t(spark, sf, "orders").agg(F.round(F.sum(money("o_totalprice")).cast("double") / F.count("*"), 4).alias("average_transaction_value"))


@query("SELECT l_returnflag, l_linestatus, CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS DOUBLE) AS sum_qty, round(avg(l_quantity), 6) AS avg_qty, count(*) AS n FROM lineitem GROUP BY l_returnflag, l_linestatus")
def grouped_sums(spark, sf):
    return t(spark, sf, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(F.sum(money("l_quantity")).cast("double").alias("sum_qty"), F.round(F.avg("l_quantity"), 6).alias("avg_qty"), F.count("*").alias("n"))


_AGG = "SELECT o_custkey AS customer_id, c_name AS customer_name, n_name AS city, o_totalprice AS transaction_amount FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey"


def _aggregates(spark, sf, k=3):
    cust = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("customer_id"), F.col("c_name").alias("customer_name"), F.col("n_name").alias("city"))
    txn = t(spark, sf, "orders").select(F.col("o_custkey").alias("customer_id"), money("o_totalprice").alias("transaction_amount"))
    return batch.customer_aggregates(txn, cust, k)


def _plain(df):
    total = F.col("total_transaction_amount").cast("double").alias("total_transaction_amount")
    keep = [c for c in df.columns if c not in ("total_transaction_amount", "average_transaction_amount")]
    mean = [(F.col("total_transaction_amount").cast("double") / F.col("transaction_count")).alias("average_transaction_amount")] * ("average_transaction_amount" in df.columns)
    return df.select(*keep, total, *mean)


_CUSTOMER = f"SELECT customer_id, customer_name, count(transaction_amount) AS transaction_count, CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_transaction_amount, CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) AS DOUBLE) / count(transaction_amount) AS average_transaction_amount FROM ({_AGG}) GROUP BY customer_id, customer_name"


@query(_CUSTOMER)
def customer_agg(spark, sf):
    return _plain(_aggregates(spark, sf)["customer"])


@query(f"SELECT city, count(transaction_amount) AS transaction_count, CAST(sum(CAST(transaction_amount AS DECIMAL(18,2))) AS DOUBLE) AS total_transaction_amount FROM ({_AGG}) GROUP BY city")
def city_agg(spark, sf):
    return _plain(_aggregates(spark, sf)["city"])


@query(f"SELECT * FROM ({_CUSTOMER}) ORDER BY total_transaction_amount DESC, customer_id, customer_name LIMIT 3")
def top3_customers(spark, sf):
    return _plain(_aggregates(spark, sf)["top"])


@query("SELECT o_orderkey, o_custkey FROM orders ANTI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) k ON o_custkey = k.c_custkey")
def orphans(spark, sf):
    return rows.orphans(t(spark, sf, "orders"), t(spark, sf, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT o_orderkey, o_custkey FROM orders SEMI JOIN (SELECT c_custkey FROM customer WHERE c_acctbal > 0) k ON o_custkey = k.c_custkey")
def referenced(spark, sf):
    return rows.referenced(t(spark, sf, "orders"), t(spark, sf, "customer").filter("c_acctbal > 0"), "o_custkey", "c_custkey").select("o_orderkey", "o_custkey")


@query("SELECT r_name, count(c_custkey) AS customers FROM region LEFT JOIN nation ON r_regionkey = n_regionkey LEFT JOIN customer ON n_nationkey = c_nationkey AND c_acctbal > 9000 GROUP BY r_name")
def left_join_counts(spark, sf):
    own = t(spark, sf, "region").join(t(spark, sf, "nation"), F.col("r_regionkey") == F.col("n_regionkey"), "left")
    own = own.join(t(spark, sf, "customer").filter("c_acctbal > 9000"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    return own.groupBy("r_name").agg(F.count("c_custkey").alias("customers"))


# histograms

_BIN = "CASE WHEN hour(ts) < 6 THEN '0-6' WHEN hour(ts) < 12 THEN '6-12' WHEN hour(ts) < 18 THEN '12-18' WHEN hour(ts) < 24 THEN '18-24' ELSE 'unknown' END"
_BINS = "(VALUES ('0-6'), ('6-12'), ('12-18'), ('18-24')) b(bin)"


@query(f"SELECT b.bin AS bin, coalesce(n, 0) AS click_count FROM {_BINS} LEFT JOIN (SELECT {_BIN} AS bin, count(*) AS n FROM events GROUP BY 1) c ON b.bin = c.bin")
def hour_histogram(spark, sf):
    return batch.time_of_day_histogram(t(spark, sf, "events"), "ts")


@query(f"SELECT bin, CAST(sum(n) AS BIGINT) AS click_count FROM (SELECT {_BIN} AS bin, 1 AS n FROM (SELECT CASE WHEN event_id % 10 = 0 THEN NULL ELSE ts END AS ts FROM events) UNION ALL SELECT bin, 0 FROM {_BINS}) GROUP BY bin")
def hour_histogram_union(spark, sf):
    own = t(spark, sf, "events").select(F.when(F.col("event_id") % 10 != 0, F.col("ts")).alias("ts"))
    return batch.time_of_day_histogram(own, "ts", keep_unknown=True)


# cleansing: the tables made dirty by rules that SQL can repeat

_DIRTY_TXN = """SELECT CASE WHEN o_orderkey % 50 = 7 THEN '  ' ELSE CAST(o_orderkey AS VARCHAR) END AS transaction_id,
  CASE WHEN o_orderkey % 40 = 3 THEN NULL ELSE CAST(o_custkey AS VARCHAR) END AS customer_id,
  CASE o_orderkey % 6 WHEN 0 THEN ' ' || substr(p, 1, 2) || ',' || substr(p, 3) || ' ' WHEN 1 THEN 'abc' WHEN 2 THEN '-5' ELSE p END AS transaction_amount,
  CASE o_orderkey % 5 WHEN 0 THEN strftime(o_orderdate, '%Y/%m/%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') ELSE strftime(o_orderdate, '%Y-%m-%d') END AS transaction_date
  FROM (SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders
        UNION ALL SELECT *, CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS p FROM orders WHERE o_orderkey % 20 = 0)"""
_DIRTY_CUST = """SELECT CAST(c_custkey AS VARCHAR) AS customer_id, c_name AS customer_name,
  CASE c_custkey % 4 WHEN 0 THEN ' cochin ' WHEN 1 THEN 'HYD' WHEN 2 THEN lower(n_name) ELSE 'poona' END AS city,
  CASE WHEN c_custkey % 9 = 0 THEN ' ' ELSE 'active' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey"""


def _dirty(spark, sf):
    p = money("o_totalprice").cast("string")
    orders = t(spark, sf, "orders")
    orders = orders.unionByName(orders.filter("o_orderkey % 20 = 0")).withColumn("p", p)
    key = F.col("o_orderkey")
    six, five = key % 6, key % 5
    txn = orders.select(
        F.when(key % 50 == 7, "  ").otherwise(key.cast("string")).alias("transaction_id"),
        F.when(key % 40 == 3, None).otherwise(F.col("o_custkey").cast("string")).alias("customer_id"),
        F.when(six == 0, F.concat(F.lit(" "), F.substring("p", 1, 2), F.lit(","), F.expr("substring(p, 3)"), F.lit(" "))).when(six == 1, "abc").when(six == 2, "-5").otherwise(F.col("p")).alias("transaction_amount"),
        F.when(five == 0, F.date_format("o_orderdate", "yyyy/MM/dd")).when(five == 1, F.date_format("o_orderdate", "dd-MM-yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd")).alias("transaction_date"),
    )
    four = F.col("c_custkey") % 4
    cust = t(spark, sf, "customer").join(t(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("c_custkey").cast("string").alias(" customer_id "),
        F.col("c_name").alias("customer_name"),
        F.when(four == 0, " cochin ").when(four == 1, "HYD").when(four == 2, F.lower("n_name")).otherwise("poona").alias("city"),
        F.when(F.col("c_custkey") % 9 == 0, " ").otherwise("active").alias("status"),
    )
    return cust, txn


_TITLE = "array_to_string(list_transform(string_split(trim(city), ' '), lambda w: upper(substr(w, 1, 1)) || lower(substr(w, 2))), ' ')"
_CLEAN = f"""WITH cust AS (SELECT DISTINCT customer_id, customer_name, CASE x WHEN 'Cochin' THEN 'Kochi' WHEN 'Hyd' THEN 'Hyderabad' WHEN 'Poona' THEN 'Pune' ELSE x END AS city, trim(status) AS status FROM (SELECT *, {_TITLE} AS x FROM ({_DIRTY_CUST}))),
 good AS (SELECT * FROM cust WHERE status <> ''),
 typed AS (SELECT trim(transaction_id) AS transaction_id, customer_id, try_cast(replace(trim(transaction_amount), ',', '') AS DOUBLE) AS amount, trim(transaction_amount) AS raw, transaction_date, coalesce(try_strptime(transaction_date, '%Y-%m-%d'), try_strptime(transaction_date, '%Y/%m/%d')) AS parsed, count(*) AS copies FROM ({_DIRTY_TXN}) GROUP BY ALL),
 judged AS (SELECT *, (transaction_id = '' OR customer_id IS NULL OR amount IS NULL OR amount <= 0 OR parsed IS NULL) AS bad FROM typed)
"""


@query(_CLEAN + "SELECT customer_id, customer_name, city, status FROM good")
def cleansed_customers(spark, sf):
    return batch.cleanse(*_dirty(spark, sf)).customers.select("customer_id", "customer_name", "city", "status")


@query(_CLEAN + "SELECT transaction_id, customer_id, amount AS transaction_amount, CASE WHEN amount < 2500 THEN 'Low' WHEN amount <= 7500 THEN 'Medium' ELSE 'High' END AS amount_category, strftime(parsed, '%Y-%m-%d') AS transaction_date, month(parsed) AS transaction_month FROM judged SEMI JOIN good ON judged.customer_id = good.customer_id WHERE NOT bad")
def cleansed_transactions(spark, sf):
    own = batch.cleanse(*_dirty(spark, sf), cut=materialise).transactions
    return own.select("transaction_id", "customer_id", "transaction_amount", "amount_category", "transaction_date", F.col("transaction_month").cast("long").alias("transaction_month"))


@query(
    _CLEAN
    + """SELECT transaction_id, customer_id, raw AS transaction_amount_orig, transaction_date, 'duplicate' AS reason FROM judged, range(2, copies + 1)
 UNION ALL SELECT transaction_id, customer_id, raw, transaction_date, 'invalid' FROM judged WHERE bad
 UNION ALL SELECT transaction_id, customer_id, raw, transaction_date, 'orphan' FROM judged ANTI JOIN good ON judged.customer_id = good.customer_id WHERE NOT bad"""
)
def quarantined_transactions(spark, sf):
    return batch.cleanse(*_dirty(spark, sf), reasons=True, cut=materialise).invalid_transactions.select("transaction_id", "customer_id", "transaction_amount_orig", "transaction_date", "reason")


@query(_CLEAN + "SELECT customer_id, customer_name, city, 'invalid' AS reason FROM cust WHERE status = ''")
def quarantined_customers(spark, sf):
    return batch.cleanse(*_dirty(spark, sf), reasons=True, cut=materialise).invalid_customers.select("customer_id", "customer_name", "city", "reason")


@query("SELECT o_orderpriority, o_orderstatus FROM orders GROUP BY ALL")
def dedupe_exact(spark, sf):
    return rows.split_duplicates(t(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"))[0]


@query("SELECT o_orderpriority, o_orderstatus FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority, o_orderstatus) AS rn FROM orders) WHERE rn > 1")
def duplicates(spark, sf):
    return rows.split_duplicates(t(spark, sf, "orders").select("o_orderpriority", "o_orderstatus"))[1]


@query("SELECT CASE WHEN o_totalprice <= 0 THEN NULL WHEN o_totalprice < 2500 THEN 'Low' WHEN o_totalprice <= 7500 THEN 'Medium' ELSE 'High' END AS category, count(*) AS n FROM orders GROUP BY 1")
def amount_category(spark, sf):
    return t(spark, sf, "orders").groupBy(numbers.amount_category(F.col("o_totalprice")).alias("category")).agg(F.count("*").alias("n"))


@query(f"SELECT DISTINCT city AS raw, CASE x WHEN 'Cochin' THEN 'Kochi' WHEN 'Hyd' THEN 'Hyderabad' WHEN 'Poona' THEN 'Pune' ELSE x END AS city FROM (SELECT city, {_TITLE} AS x FROM ({_DIRTY_CUST}))")
def standardize_city(spark, sf):
    return _dirty(spark, sf)[0].select(F.col("city").alias("raw"), text.standard_name(F.col("city")).alias("city")).distinct()


# slowly changing dimensions

_MASTER = """SELECT c_custkey AS customer_id, c_name AS customer_name, CAST(c_nationkey AS VARCHAR) AS city, DATE '2020-01-01' AS effective_date, CAST(NULL AS DATE) AS expiry_date, 1 AS current_flag FROM customer
 UNION ALL SELECT c_custkey, c_name || '-old', CAST(c_nationkey AS VARCHAR), DATE '2015-01-01', DATE '2020-01-01', 0 FROM customer WHERE c_custkey % 5 = 0"""
_UPDATES = """SELECT c_custkey + CASE WHEN c_custkey % 30 = 0 THEN 1000000 ELSE 0 END AS customer_id, c_name || '-new' AS customer_name, 'moved' AS city, DATE '2024-06-01' AS change_date FROM customer WHERE c_custkey % 10 = 0"""


def _scd(spark, sf):
    c = t(spark, sf, "customer")
    key, name, city = F.col("c_custkey"), F.col("c_name"), F.col("c_nationkey").cast("string").alias("city")

    def day(text_: str):
        return F.lit(text_).cast("date")

    master = c.select(key.alias("customer_id"), name.alias("customer_name"), city, day("2020-01-01").alias("effective_date"), F.lit(None).cast("date").alias("expiry_date"), F.lit(1).alias("current_flag"))
    old = c.filter("c_custkey % 5 = 0").select(key.alias("customer_id"), F.concat(name, F.lit("-old")).alias("customer_name"), city, day("2015-01-01").alias("effective_date"), day("2020-01-01").alias("expiry_date"), F.lit(0).alias("current_flag"))
    updates = c.filter("c_custkey % 10 = 0").select((key + F.when(key % 30 == 0, 1000000).otherwise(0)).alias("customer_id"), F.concat(name, F.lit("-new")).alias("customer_name"), F.lit("moved").alias("city"), day("2024-06-01").alias("change_date"))
    return master.unionByName(old), updates


_WITH = f"WITH m AS ({_MASTER}), u AS ({_UPDATES}) "
_SCD2 = _WITH + """SELECT m.customer_id, m.customer_name, m.city, m.effective_date, u.change_date AS expiry_date, 0 AS current_flag FROM m JOIN u ON m.customer_id = u.customer_id WHERE current_flag = 1
 UNION ALL SELECT customer_id, customer_name, city, change_date, NULL, 1 FROM u UNION ALL SELECT m.* FROM m ANTI JOIN u ON m.customer_id = u.customer_id"""


@query(
    _WITH
    + """SELECT u.customer_id, u.customer_name, u.city, coalesce(m.effective_date, u.change_date) AS effective_date, m.expiry_date, coalesce(m.current_flag, 1) AS current_flag FROM u LEFT JOIN (SELECT * FROM m WHERE current_flag = 1) m ON m.customer_id = u.customer_id
 UNION ALL SELECT * FROM (SELECT * FROM m WHERE current_flag = 1) c ANTI JOIN u ON c.customer_id = u.customer_id"""
)
def scd1_final(spark, sf):
    return scd.scd1(*_scd(spark, sf))


@query(_SCD2)
def scd2_final(spark, sf):
    """The plain three-branch merge, which loses expired rows of updated keys."""
    return scd.scd2(*_scd(spark, sf), preserve_history=False)


@query(_SCD2 + " UNION ALL SELECT m.* FROM m SEMI JOIN u ON m.customer_id = u.customer_id WHERE current_flag <> 1")
def scd2_full_history(spark, sf):
    return scd.scd2(*_scd(spark, sf))


# statistics


_STATS = """SELECT l_shipmode AS grp, round(avg(v), 6) AS mean_v, round(stddev_samp(v), 6) AS std_v, round(quantile_cont(v, 0.5), 6) AS p50_v, round(quantile_cont(v, 0.95), 6) AS p95_v, round(quantile_cont(v, 0.99), 6) AS p99_v, round(sum(v), 6) AS total_v, count(v) AS n
 FROM (SELECT l_suppkey % 50 AS l_shipmode, CAST(l_quantity AS DOUBLE) AS v FROM lineitem) GROUP BY 1"""


def _stats(spark, sf):
    own = t(spark, sf, "lineitem").select((F.col("l_suppkey") % 50).alias("grp"), F.col("l_quantity").alias("v"))
    return batch.group_stats(own, "grp", "v")


@query(_STATS)
def group_stats(spark, sf):
    return _stats(spark, sf)


@query("SELECT p_brand, round(quantile_cont(p_size, 0.95), 6) AS p95 FROM part GROUP BY p_brand")
def percentile_manual(spark, sf):
    """The quantile over a sorted list; fit for groups that are small."""
    own = t(spark, sf, "part").groupBy("p_brand").agg(F.sort_array(F.collect_list(F.col("p_size").cast("double"))).alias("v"))
    return own.select("p_brand", F.round(numbers.percentile_expr(F.col("v"), F.size("v"), 0.95), 6).alias("p95"))


@query(f"SELECT grp, total_v FROM ({_STATS}) ORDER BY total_v DESC, grp LIMIT 1")
def argmax_total(spark, sf):
    return rows.argmax(_stats(spark, sf).select("grp", "total_v"), "grp", "total_v")


@query(
    """WITH best AS (SELECT user_id FROM events GROUP BY user_id ORDER BY round(sum(value), 4) DESC, user_id LIMIT 1),
 d AS (SELECT user_id, count(*) OVER (PARTITION BY user_id ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events SEMI JOIN best USING (user_id))
SELECT user_id, max(n) AS max_count FROM d GROUP BY user_id"""
)
def busiest_hour(spark, sf):
    return batch.busiest_trailing_window(t(spark, sf, "events").withColumn("value", F.col("value").cast("decimal(18,4)")), "user_id", "value", "ts")


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY date_trunc('second', ts) RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW) AS n FROM events")
def trailing_density(spark, sf):
    own = t(spark, sf, "events").select("event_id", "event_type", times.epoch(F.col("ts")).alias("at"))
    return series.trailing_count(own, "at", 3600, "n", "event_type").select("event_id", "n")


# series

_HOURLY = "SELECT user_id % 20 AS k, date_trunc('hour', ts) AS ts, CAST(max(CASE WHEN event_id % 3 = 0 THEN NULL ELSE event_id END) AS BIGINT) AS v, CAST(min(event_id) AS BIGINT) AS w FROM events GROUP BY 1, 2"


def _hourly(spark, sf):
    own = t(spark, sf, "events").select((F.col("user_id") % 20).alias("k"), F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "event_id")
    return own.groupBy("k", "ts").agg(F.max(F.when(F.col("event_id") % 3 != 0, F.col("event_id"))).alias("v"), F.min("event_id").alias("w"))


_GRID = f"h AS ({_HOURLY}), grid AS (SELECT k, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM h GROUP BY k)"


@query(f"WITH {_GRID} SELECT grid.k, grid.ts FROM grid ANTI JOIN h ON grid.k = h.k AND grid.ts = h.ts")
def missing_hours(spark, sf):
    return series.missing_hours(_hourly(spark, sf), "k", "ts")


@query(f"WITH {_GRID} SELECT grid.k, grid.ts, last_value(v IGNORE NULLS) OVER w AS v, last_value(w IGNORE NULLS) OVER w AS w FROM grid LEFT JOIN h ON grid.k = h.k AND grid.ts = h.ts WINDOW w AS (PARTITION BY grid.k ORDER BY grid.ts ROWS UNBOUNDED PRECEDING)")
def gap_filled_locf(spark, sf):
    return series.regularise(_hourly(spark, sf), "k", "ts", ["v", "w"])


@query("SELECT l_orderkey, l_linenumber, l_quantity / 1.88 AS no2, l_quantity / 2.62 AS so2, l_quantity / 2.0 AS o3, l_quantity * 1000 / 1.145 AS co, l_quantity AS pm25 FROM lineitem")
def unit_convert(spark, sf):
    return t(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", *(numbers.to_ppb(F.col("l_quantity"), g).alias(g) for g in ("no2", "so2", "o3", "co", "pm25")))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_roundtrip(spark, sf):
    own = t(spark, sf, "events").select("event_id", F.from_json("props", "k long").alias("p"))
    back = own.select(F.to_json(F.struct("event_id", "p.k")).alias("value"))
    return back.select(F.from_json("value", "event_id long, k long").alias("r")).select("r.*")


# text


@query(
    """WITH l AS (SELECT doc_id, unnest(list_transform(range(1, len(x) + 1), lambda i: {'n': i, 'line': x[i]})) AS r FROM (SELECT doc_id, string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n') AS x FROM documents WHERE text <> ''))
SELECT doc_id, CAST(r.n AS BIGINT) AS line_no, r.line AS line, CAST(length(r.line) AS BIGINT) AS line_length FROM l WHERE length(r.line) = (SELECT max(length(r.line)) FROM l)"""
)
def longest_lines(spark, sf):
    return batch.longest_lines_of(t(spark, sf, "documents"), "text", ["doc_id"])


@query(
    """WITH l AS (SELECT source, doc_id, unnest(string_split_regex(regexp_replace(text, '(\\r\\n|\\r|\\n)$', ''), '\\r\\n|\\r|\\n')) AS line FROM documents WHERE text <> '')
SELECT source, doc_id, line, CAST(length(line) AS BIGINT) AS line_length FROM l QUALIFY length(line) = max(length(line)) OVER (PARTITION BY source)"""
)
def longest_lines_by_source(spark, sf):
    own = batch.longest_lines_of(t(spark, sf, "documents").filter("source is not null"), "text", ["source", "doc_id"], ["source"])
    return own.select("source", "doc_id", "line", "line_length")


# streams: read the events file as a stream, run what is there, read the sink


def _stream(spark, sf):
    schema = t(spark, sf, "events").schema
    return files.file_stream(spark, sf, schema, "parquet", glob="events.parquet")


def _ran(spark, stream, mode, keys=()):
    """The stream's result after what is there, in a table."""
    scratch = Scratch(spark)
    path = scratch.path()
    run = windows.to_batches(stream, path, scratch.path(), mode)
    try:
        run.awaitTermination()
    finally:
        run.stop()
    return windows.from_batches(spark, path, mode, keys)


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS row_count FROM events GROUP BY 1, 2")
def tumbling_count(spark, sf):
    own = _ran(spark, windows.windowed_count(_stream(spark, sf), "ts", "1 hour"), "complete")
    return own.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "row_count")


_SLIDING = """SELECT s AS window_start, s + INTERVAL 8 HOUR AS window_end, event_type, max(event_id) AS v1, CAST(sum(user_id) AS BIGINT) AS v2
 FROM (SELECT *, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 7 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events) GROUP BY s, event_type"""


def _sliding(spark, sf, mode):
    own = _ran(spark, windows.sliding_totals(_stream(spark, sf), "ts", "event_type", "event_id", ["user_id"]), mode)
    return own.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), F.col("window_end").cast("timestamp_ntz").alias("window_end"), "event_type", "v1", "v2")


@query(_SLIDING)
def sliding_agg(spark, sf):
    return _sliding(spark, sf, "complete")


@query(f"SELECT * FROM ({_SLIDING}) WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 1 HOUR FROM events)")
def sliding_append(spark, sf):
    return _sliding(spark, sf, "append")


@query(f"SELECT window_start, event_type, v1, v2, row_number() OVER (PARTITION BY window_start ORDER BY v1 NULLS FIRST, v2 NULLS FIRST, event_type) AS rank FROM ({_SLIDING})")
def windowed_rank(spark, sf):
    own = batch.rank_in_window(_sliding(spark, sf, "complete"), "window_start", "v1", "v2", "event_type")
    return own.select("window_start", "event_type", "v1", "v2", F.col("rank").cast("long").alias("rank"))


# sampling and learning


@query()
def event_sample(spark, sf):
    return rows.sample_rows(t(spark, sf, "events"), 10)


@query()
def dt_train_predict(spark, sf):
    own = t(spark, sf, "embeddings").select(F.col("label").cast("double").alias("label"), array_to_vector(F.col("embedding").cast("array<double>")).alias("features"))
    return classify.predict(classify.train(own).model, own)


# the others register themselves
from millrace import catalog_files, catalog_streams  # noqa: E402, F401
