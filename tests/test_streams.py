"""Streams: producers after a restart, loops, failing handlers, state, strict texts, time ranges."""

import logging

import pytest
from pyspark.sql import functions as F

from millrace.operators import rows, series
from millrace.plans import batch
from millrace.scratch import Scratch
from millrace.sources import files
from millrace.streaming import windows


def keys(spark, path):
    return sorted((r["key"] for r in spark.read.json(f"{path}/messages").collect()), key=lambda k: int(k[3:]))


def test_numbers_run_on_over_batches_restarts_and_replays(spark, tmp_path):
    schema, source = "id int, s string", f"{tmp_path}/in"

    def write(*ids):
        spark.createDataFrame([(i, "x") for i in ids], schema).coalesce(1).write.mode("append").json(source)

    def run():
        stream = files.file_stream(spark, source, schema, per_trigger=1)
        windows.publish(stream, "producer_1", "p1_", f"{tmp_path}/out", f"{tmp_path}/ck").awaitTermination(120)

    write(3, 1, 2)
    write(5, 4)
    run()
    assert keys(spark, f"{tmp_path}/out") == [f"p1_{i}" for i in range(5)]
    write(9, 8, 7)
    run()
    assert keys(spark, f"{tmp_path}/out") == [f"p1_{i}" for i in range(8)]
    assert windows.progress(spark, f"{tmp_path}/out") == {"records_sent": 8, "completed": False, "batches": 3}
    # what a batch was numbered from doesn't depend on what came after it
    assert windows.progress(spark, f"{tmp_path}/out", 1)["records_sent"] == 3
    assert windows.progress(spark, f"{tmp_path}/none") == {"records_sent": 0, "completed": False, "batches": 0}


def test_rows_begin_again(spark):
    own = spark.createDataFrame([(i, f"r{i}") for i in range(3)], "record_number long, s string")
    got = sorted((r["record_number"], r["s"]) for r in windows.looped(own, 3, 2, 9).collect())
    assert got == [(i, f"r{i % 3}") for i in range(2, 9)]
    assert windows.looped(own, 3, 0, 2).count() == 2


def test_a_failed_call_is_made_again(spark, tmp_path, monkeypatch):
    with Scratch(spark) as scratch:
        own = scratch.write(windows.numbered(spark.createDataFrame([(i,) for i in (2, 0, 1)], "id int"), "id", scratch))
        note = windows._note
        monkeypatch.setattr(windows, "_note", lambda *a: (_ for _ in ()).throw(OSError("no place")))
        with pytest.raises(OSError):
            windows.produce_next(own, 3, "producer_2", "p2_", f"{tmp_path}/out", 2, 4)
        monkeypatch.setattr(windows, "_note", note)
        assert windows.call_until(lambda: windows.produce_next(own, 3, "producer_2", "p2_", f"{tmp_path}/out", 2, 4)) == 2
        assert windows.produce_next(own, 3, "producer_2", "p2_", f"{tmp_path}/out", 2, 4)["completed"]
    assert keys(spark, f"{tmp_path}/out") == [f"p2_{i}" for i in range(4)]


def test_a_failing_handler_is_not_acknowledged(spark, tmp_path, caplog):
    spark.createDataFrame([("in/a.csv",)], "name string").write.json(f"{tmp_path}/in")
    seen = []

    def flaky(df, batch_id):
        seen.append(batch_id)
        if len(seen) == 1:
            raise ValueError("not now")
        df.collect()

    def run():
        return windows.fan_out(lambda: files.file_stream(spark, f"{tmp_path}/in", files.ENVELOPE), {"flaky": flaky, "fine": lambda df, _: df.count()}, f"{tmp_path}/ck")

    with caplog.at_level(logging.ERROR):
        first = run()
        first["fine"].awaitTermination(120)
        with pytest.raises(Exception, match="not now"):
            first["flaky"].awaitTermination(120)
    run()["flaky"].awaitTermination(120)
    assert seen == [0, 0] and "handler flaky failed in batch 0" in caplog.text


def test_console_and_empty_batches(spark, tmp_path, caplog):
    schema = "ts timestamp, k string, v long"
    spark.createDataFrame([], schema).coalesce(1).write.json(f"{tmp_path}/in")
    spark.sql("SELECT timestamp'2024-01-01 00:00:01' AS ts, 'a' AS k, 1L AS v").write.mode("append").json(f"{tmp_path}/in")
    stream = files.file_stream(spark, f"{tmp_path}/in", schema, per_trigger=1)
    windows.start(windows.windowed_count(stream, "ts"), "shown", f"{tmp_path}/c1", "complete", "console").awaitTermination(120)
    with caplog.at_level(logging.INFO, "millrace.streaming.windows"):
        windows.to_batches(stream.filter("v > 5"), f"{tmp_path}/out", f"{tmp_path}/c2", "append").awaitTermination(120)
    assert "is empty" in caplog.text and not (tmp_path / "out").exists()


def test_strict_texts(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff")
    assert files.whole_texts(spark, str(tmp_path)).first()["value"] == "ok �"
    with pytest.raises(Exception, match="UTF"):
        files.whole_texts(spark, str(tmp_path), strict=True).collect()


def test_trailing_counts_by_stretches(spark):
    at = [0, 0, 5, 9, 10, 11, 19, 20, 21, 40, -3, None]
    df = spark.createDataFrame([(i, None if i % 4 == 3 else "k", x) for i, x in enumerate(at)], "i int, k string, at long")
    for seconds in (1, 10, 1000):
        got = {r["i"]: r["n"] for r in series.trailing_count(df, "at", seconds, "n", "k").collect()}
        key = [None if i % 4 == 3 else "k" for i in range(len(at))]
        want = {i: None if x is None else sum(k == key[i] and y is not None and x - seconds <= y <= x for k, y in zip(key, at, strict=True)) for i, x in enumerate(at)}
        assert got == want
    assert series.trailing_count(df, "at", 10, "n").filter("at = 10").first()["n"] == 5


def test_raw_clicks(spark):
    lines = ["user_id,timestamp", "u,2024-01-01 9:00:00", "u", "u, 2024-01-01 23:59:59 ", "u,24:00", "u,x y", "u,2024-01-01 30:00:00", None, ""]
    got = [(r["hour"], r["ts"] is not None) for r in batch.clicks_from_lines(spark.createDataFrame([(x,) for x in lines], "value string")).collect()]
    assert got == [(9, True), (23, True), (30, False)]


def test_merge_and_counts(spark):
    a = spark.createDataFrame([(1, "x", 2)], "k int, v string, w int")
    out = rows.merge(a, a.withColumn("u", F.lit(1)), ["k"], ("_txn", "_cust"))
    assert out.columns == ["k", "v_txn", "w_txn", "v_cust", "w_cust", "u"]
    assert rows.describe(a.limit(0), ["k"]).first()["n"] == 0
