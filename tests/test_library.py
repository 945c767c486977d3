"""Edge cases of the library's operators and pipelines."""

import datetime as dt

from pyspark.sql import functions as F

from millrace import sinks
from millrace.functions import numbers, text, times
from millrace.operators import rows, series
from millrace.plans import batch, classify, scd
from millrace.sources import files
from millrace.streaming import windows


def values(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_bad_cells_become_null(spark):
    df = spark.createDataFrame([("1,234.50", "2024/01/02"), (" 2500 ", "2024-01-02"), ("abc", "31-12-2024"), (None, None)], "a string, d string")
    got = df.select(numbers.parse_amount(F.col("a")).alias("a"), times.parse_date(F.col("d")).alias("d")).collect()
    day = dt.date(2024, 1, 2)
    assert [tuple(r) for r in got] == [(1234.5, day), (2500.0, day), (None, None), (None, None)]


def test_category_bounds(spark):
    df = spark.createDataFrame([(v,) for v in (None, 0.0, -5.0, 2499.99, 2500.0, 7500.0, 7500.01)], "v double")
    assert [r[0] for r in df.select(numbers.amount_category(F.col("v"))).collect()] == [None, None, None, "Low", "Medium", "Medium", "High"]


def test_names(spark):
    df = spark.createDataFrame([(" cochin ",), ("HYD",), ("o'neil new-delhi",), (None,)], "c string")
    assert [r[0] for r in df.select(text.standard_name(F.col("c"))).collect()] == ["Kochi", "Hyderabad", "O'neil New-delhi", None]
    assert [r[0] for r in df.select(text.title_exact("c")).collect()][2] == "O'Neil New-Delhi"


def test_midnight(spark):
    df = spark.createDataFrame([("23:55:00", "00:05:00")], "a string, b string").select(*(F.try_to_timestamp(c, F.lit("HH:mm:ss")).alias(c) for c in "ab"))
    assert df.select(times.minutes_apart(F.col("a"), F.col("b")), times.minutes_apart(F.col("a"), F.col("b"), True)).first()[:] == (1430.0, 10.0)


def test_duplicates_partition_rows(spark):
    df = spark.createDataFrame([(1, None), (1, None), (1, None), (2, "x")], "a int, b string")
    one, more = rows.split_duplicates(df)
    assert (one.count(), more.count()) == (2, 2)
    ok, bad = rows.split_valid(df, F.col("b") == "x")
    assert (ok.count(), bad.count()) == (3, 1)


def test_cleansed_and_quarantined_are_all_rows(spark):
    cust = spark.createDataFrame([("1", "A", "hyd", "x"), ("1", "A", "hyd", "x"), ("2", "B", None, "x"), (None, "C", "poona", "x")], "customer_id string, customer_name string, city string, status string")
    txn = spark.createDataFrame([("t1", "1", "1,000", "2024-01-02"), ("t1", "1", "1000", "2024-01-02"), ("t2", "9", "5", "2024-01-02"), ("t3", "1", "NaNx", "2024-01-02"), ("t4", "1", "7", "bad")], "transaction_id string, customer_id string, transaction_amount string, transaction_date string")
    out = batch.cleanse(cust, txn, reasons=True)
    assert out.customers.count() + out.invalid_customers.count() == 4
    assert out.transactions.count() == 2  # the raw amounts differ, so they are no copies
    assert values(out.invalid_transactions.select("transaction_id", "reason")) == [("t2", "orphan"), ("t3", "invalid"), ("t4", "invalid")]


def test_scd2_keeps_or_loses_history(spark):
    master = spark.sql("SELECT 1 AS customer_id, 'a' AS city, DATE '2020-01-01' AS effective_date, CAST(NULL AS DATE) AS expiry_date, 1 AS current_flag UNION ALL SELECT 1, 'old', DATE '2010-01-01', DATE '2020-01-01', 0 UNION ALL SELECT 2, 'b', DATE '2020-01-01', NULL, 1")
    updates = spark.sql("SELECT 1 AS customer_id, 'new' AS city, DATE '2024-01-01' AS change_date")
    full, plain = scd.scd2(master, updates), scd.scd2(master, updates, preserve_history=False)
    assert (full.count(), plain.count()) == (4, 3)
    assert full.filter("current_flag = 1").groupBy("customer_id").count().filter("count > 1").count() == 0
    assert values(scd.scd1(master, updates).select("customer_id", "city")) == [(1, "new"), (2, "b")]


def test_percentile_forms_agree(spark):
    df = spark.createDataFrame([("a", float(v)) for v in (1, 2, 4, 10)] + [("b", 3.0)], "k string, v double")
    stats = {r["k"]: r for r in batch.group_stats(df, "k", "v").collect()}
    assert (stats["a"]["p95_v"], stats["b"]["std_v"]) == (9.1, None)
    manual = df.groupBy("k").agg(F.sort_array(F.collect_list("v")).alias("v")).select("k", numbers.percentile_expr(F.col("v"), F.size("v"), 0.95).alias("p"))
    assert {r["k"]: round(r["p"], 6) for r in manual.collect()} == {"a": 9.1, "b": 3.0}


def test_series_has_no_gaps(spark):
    hour = lambda h: dt.datetime(2024, 1, 1, h)
    df = spark.createDataFrame([("x", hour(0), None, 1), ("x", hour(1), 5, None), ("x", hour(4), None, 2), ("y", hour(2), 7, 7), ("x", hour(4), None, 2), (None, hour(1), 1, 1)], "k string, ts timestamp, a int, b int")
    got = values(series.regularise(df, "k", "ts", ["a", "b"]))
    assert [(r[0], r[1].hour, r[2], r[3]) for r in got] == [("x", 0, None, 1), ("x", 1, 5, 1), ("x", 2, 5, 1), ("x", 3, 5, 1), ("x", 4, 5, 2), ("y", 2, 7, 7)]


def test_trailing_window_is_inclusive(spark):
    df = spark.createDataFrame([("a", 1.0, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=s)) for s in (0, 3600, 3600, 3601)], "k string, v double, ts timestamp")
    assert batch.busiest_trailing_window(df, "k", "v", "ts").first()["max_count"] == 3


def test_longest_lines(spark):
    df = spark.createDataFrame([(1, "ab\r\ncd\re\n"), (2, ""), (3, "x")], "id int, t string")
    own = batch.lines_of(df, "t", ["id"])
    assert values(batch.longest_lines(own).select("id", "line_no", "line")) == [(1, 1, "ab"), (1, 2, "cd")]
    objects = df.select(F.concat(F.lit("in/"), "id", F.lit(".txt")).alias("name"), "t")
    found = batch.longest_reports(objects, "name", "t", prefix="s3://", least=-1).orderBy("name", "position").collect()
    assert [r["value"] for r in found if r["name"] == "in/1.txt"] == ["Source: s3://in/1.txt", "Max length (characters, excluding newline): 2", "Number of longest lines: 2", "", "Longest line(s):", "[Line 1] (2 chars): ab", "[Line 2] (2 chars): cd"]
    assert [r["value"] for r in found if r["name"] == "in/2.txt"][1:3] == ["Max length (characters, excluding newline): -1", "Number of longest lines: 0"]
    plain = batch.longest_reports(spark.createDataFrame([("a/b.txt", "x\u2028yy\x0czz\n\n"), ("c", None)], "name string, t string"), "name", "t", numbered=False).orderBy("name", "position").collect()
    assert [r["value"] for r in plain] == ["Input file: b.txt", "Maximum line length: 2", "Longest line(s):", "yy", "zz", "Input file: c", "Maximum line length: 0", "Longest line(s):"]
    blank = batch.lines_of(spark.createDataFrame([(1, "a\n\n")], "id int, t string"), "t", ["id"])
    assert values(blank.select("line_no", "line")) == [(1, "a"), (2, "")]


def test_argmax_ties_and_empty(spark):
    df = spark.createDataFrame([("b", 2.0), ("a", 2.0), ("c", None)], "l string, m double")
    assert values(rows.argmax(df, "l", "m")) == [("a", 2.0)]
    assert rows.argmax(df.limit(0), "l", "m").count() == 0
    assert rows.sample_rows(df, 5, exact=True).count() == 3
    assert rows.sample_rows(df.limit(0), 5).count() == 0


def test_files_and_sinks(spark, tmp_path):
    df = spark.createDataFrame([("1", "a"), ("x", None)], "id string, s string")
    sinks.write_csv(df, f"{tmp_path}/c", single=True)
    assert files.csv_strings(spark, f"{tmp_path}/c").count() == 2
    assert values(files.csv_typed(spark, f"{tmp_path}/c", "id int, s string")) == [(1, "a"), (None, None)]
    sinks.write_text(df, f"{tmp_path}/t")
    assert values(files.text_lines(spark, f"{tmp_path}/t")) == [("1,a",), ("x",)]
    assert [r["value"] for r in sinks.as_messages(df, "id").orderBy("key").collect()] == ['{"id":"1","s":"a"}', '{"id":"x"}']
    push = spark.createDataFrame([("eyJuYW1lIjogImEuY3N2In0=",), ("bad",)], "data string")
    assert [r["event"]["name"] if r["event"] else None for r in files.push_messages(push).collect()] == ["a.csv", None]
    assert files.product_events(spark, 7).count() == 7


def test_model_round_trip(spark, tmp_path):
    path = tmp_path / "d.txt"
    path.write_text("".join(f"{i % 2} 1:{i % 2} 2:{i}\n" for i in range(40)))
    df = files.libsvm(spark, str(path), 2)
    found = classify.train(df, depths=(2,), bins=(32,), instances=(1,))
    assert classify.accuracy(classify.predict(found.model, df)).first()[0] == 1.0
    assert '"maxDepth": 2' in found.to_json()


def test_producers_and_fan_out(spark, tmp_path):
    files.product_events(spark, 5).write.json(f"{tmp_path}/in")
    schema = "id int, product_name string"
    windows.publish(files.file_stream(spark, f"{tmp_path}/in", schema), "producer_1", "p1_", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)
    assert sorted(r["key"] for r in spark.read.json(f"{tmp_path}/out/messages").collect()) == [f"p1_{i}" for i in range(5)]
    seen = {}
    handlers = {n: lambda df, _, n=n: seen.__setitem__(n, df.count()) for n in ("a", "b")}
    for q in windows.fan_out(lambda: files.file_stream(spark, f"{tmp_path}/in", schema), handlers, f"{tmp_path}/fan").values():
        q.awaitTermination(120)
    assert seen == {"a": 5, "b": 5}
    events = spark.createDataFrame([("in/a.csv",), ("out/a.csv",), (None,), ("in/temporary.csv",)], "name string")
    assert values(windows.wanted(events, prefix="in/", suffix=".csv", without="temporary")) == [("in/a.csv",)]


def test_stream_of_the_wrong_field_is_empty(spark):
    df = spark.createDataFrame([('{"event_hour": "2024-01-01"}',)], "value string")
    assert df.select(F.from_json("value", "event_time timestamp").alias("r")).select("r.*").dropna().count() == 0
