"""Registered queries over streams, producers and fan-out: each runs to the end of what is there and returns what was written."""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from millrace import catalog, catalog_files, sinks
from millrace.functions import text
from millrace.plans import batch, classify
from millrace.registry import query, t
from millrace.scratch import Scratch
from millrace.sources import files
from millrace.streaming import windows

place = catalog_files.place


def feed(df, path, *conditions):
    """A file for each condition, one after the other; a stream with one file a batch reads them in this order."""
    for c in conditions:
        df.filter(c).coalesce(1).write.mode("append").parquet(path)
    return path


def ran(run):
    try:
        run.awaitTermination()
    finally:
        run.stop()


def plain(df, *columns):
    """Times without a zone, as the oracle has them."""
    return df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in columns})


_PARTS = "user_id AS p1, event_id AS p2, CASE WHEN event_type > 'd' THEN event_id END AS p3, user_id + 1 AS p4, CASE WHEN event_id % 2 = 0 THEN 5 END AS p5, 7 AS p6"


def _six(total):
    return f"""SELECT s AS window_start, event_type, max(event_id) AS v1, CAST({total} AS BIGINT) AS v2
 FROM (SELECT event_type, event_id, {_PARTS}, unnest(generate_series(date_trunc('hour', ts) - INTERVAL 7 HOUR, date_trunc('hour', ts), INTERVAL 1 HOUR)) AS s FROM events) GROUP BY s, event_type"""


def _six_parts(spark, sf, missing_as_zero):
    k = F.col("event_id")
    stream = catalog._stream(spark, sf).select("ts", "event_type", "event_id", F.col("user_id").alias("p1"), k.alias("p2"), F.when(F.col("event_type") > "d", k).alias("p3"), (F.col("user_id") + 1).alias("p4"), F.when(k % 2 == 0, 5).alias("p5"), F.lit(7).alias("p6"))
    found = windows.sliding_totals(stream, "ts", "event_type", "event_id", [f"p{i}" for i in range(1, 7)], missing_as_zero=missing_as_zero)
    return plain(catalog._ran(spark, found, "complete"), "window_start").select("window_start", "event_type", "v1", "v2")


@query(_six(" + ".join(f"sum(p{i})" for i in range(1, 7))))
def six_parts(spark, sf):
    """Six sums, null where one part has no value at all in a window."""
    return _six_parts(spark, sf, False)


@query(_six(" + ".join(f"coalesce(sum(p{i}), 0)" for i in range(1, 7))))
def six_parts_missing_as_zero(spark, sf):
    return _six_parts(spark, sf, True)


@query(catalog.oracle_sql()["windowed_rank"])
def ranking_stream(spark, sf):
    """The ranking as it is written by the stream itself, read back."""
    path = place(spark)
    totals = windows.sliding_totals(catalog._stream(spark, sf), "ts", "event_type", "event_id", ["user_id"])
    ran(windows.ranking_batches(totals, "event_type", path, place(spark)))
    schema = "window_start timestamp, window_end timestamp, event_type string, v1 long, v2 long, rank long"
    return plain(windows.from_batches(spark, path, "complete", schema=schema, fmt="csv"), "window_start").select("window_start", "event_type", "v1", "v2", "rank")


_DAYS = ("ts < '2024-01-10'", "ts >= '2024-01-10' AND ts < '2024-01-20'", "ts >= '2024-01-20'")


def _fed(spark, sf, *more):
    """The events in three files by time, as a stream of a file a batch."""
    events = t(spark, sf, "events")
    path = feed(events, place(spark), *_DAYS, *more)
    return files.file_stream(spark, path, events.schema, "parquet", per_trigger=1)


@query(catalog._SLIDING)
def update_totals(spark, sf):
    """Update mode over several batches: the last row of each window and key is the total."""
    path = place(spark)
    ran(windows.to_batches(windows.sliding_totals(_fed(spark, sf), "ts", "event_type", "event_id", ["user_id"]), path, place(spark), "update"))
    return plain(windows.from_batches(spark, path, "update", ["window_start", "event_type"]), "window_start", "window_end")


_HOURS = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, time_bucket(INTERVAL 1 HOUR, ts) + INTERVAL 1 HOUR AS window_end, count(*) AS row_count FROM events GROUP BY 1, 2"


@query(f"SELECT * FROM ({_HOURS}) WHERE window_end <= (SELECT date_trunc('millisecond', max(ts)) - INTERVAL 10 MINUTE FROM events)")
def tumbling_append(spark, sf):
    """Append mode: windows leave when the watermark has passed them."""
    own = catalog._ran(spark, windows.windowed_count(catalog._stream(spark, sf), "ts", "1 hour", "10 minutes"), "append")
    return plain(own, "window_start", "window_end")


@query(_HOURS)
def late_rows(spark, sf):
    """Rows of the first days that come again after the last ones are behind the watermark and don't count."""
    path = place(spark)
    ran(windows.to_batches(windows.windowed_count(_fed(spark, sf, "ts < '2024-01-05'"), "ts", "1 hour", "1 hour"), path, place(spark), "update"))
    return plain(windows.from_batches(spark, path, "update", ["window_start"]), "window_start", "window_end")


@query(_HOURS)
def processing_time(spark, sf):
    """A query with a processing-time trigger, stopped when all is processed."""
    path = place(spark)
    run = windows.to_batches(windows.windowed_count(_fed(spark, sf), "ts", "1 hour"), path, place(spark), "complete", {"processingTime": "1 second"})
    try:
        run.processAllAvailable()
    finally:
        run.stop()
    return plain(windows.from_batches(spark, path, "complete"), "window_start", "window_end")


@query("SELECT CAST(3 AS BIGINT) AS partitions")
def state_partitions(spark, sf):
    """The number of partitions that a checkpoint keeps for a query's state."""
    checkpoint = place(spark)
    run = windows.to_batches(windows.windowed_count(catalog._stream(spark, sf), "ts", "1 hour"), place(spark), checkpoint, "complete", state_partitions=3)
    ran(run)
    return spark.read.format("state-metadata").load(checkpoint).select(F.col("numPartitions").cast("long").alias("partitions")).distinct()


# messages


@query("SELECT count(*) AS earliest, CAST(0 AS BIGINT) AS latest FROM events")
def replayed(spark, sf):
    """A stream of messages from the beginning has all; one from now on has none of what was written before."""
    path = place(spark)
    sinks.write_messages(sinks.as_messages(t(spark, sf, "events"), "event_id"), path)
    found = {}
    for starting in ("earliest", "latest"):
        out = place(spark)
        ran(windows.start(files.message_stream(spark, path, starting), f"replayed_{starting}", place(spark), sink="parquet", path=out))
        found[starting] = spark.read.schema("key binary").parquet(out).agg(F.count("*").alias(starting))
    return found["earliest"].crossJoin(found["latest"])


_MESSAGE = "id string, event_type string, producer_id string, record_number long, send_timestamp double"


def _messages(spark, path):
    own = spark.read.schema("key string, value string").json(f"{path}/messages/*")
    return own.select("key", F.from_json("value", _MESSAGE).alias("r")).select("key", "r.*").withColumn("id", F.col("id").cast("long"))


@query("SELECT 'p1_' || n AS key, event_id AS id, event_type, 'producer_1' AS producer_id, n AS record_number, true AS stamped FROM (SELECT *, row_number() OVER (ORDER BY event_id) - 1 AS n FROM events)")
def published(spark, sf):
    """Numbers run on from batch to batch, and after a restart."""
    source, path, checkpoint = place(spark), place(spark), place(spark)
    events = t(spark, sf, "events").select(F.col("event_id").alias("id"), "event_type")
    a, b = events.agg(F.percentile("id", F.array(F.lit(0.3), F.lit(0.6)))).first()[0]
    for conditions in ((F.col("id") < a, (F.col("id") >= a) & (F.col("id") < b)), (F.col("id") >= b,)):
        feed(events, source, *conditions)
        ran(windows.publish(files.file_stream(spark, source, events.schema, "parquet", per_trigger=1), "producer_1", "p1_", path, checkpoint))
    return _messages(spark, path).withColumn("stamped", F.col("send_timestamp") > 1.7e9).drop("send_timestamp")


@query("SELECT 'p2_' || i AS key, CAST(i % 25 AS BIGINT) AS id, n_name AS event_type, 'producer_2' AS producer_id, i AS record_number, CAST(12 AS BIGINT) AS calls FROM range(60) r(i) JOIN nation ON n_nationkey = i % 25")
def produced_by_calls(spark, sf):
    """A producer that sends five records a call and keeps its progress; its rows begin again at their end."""
    path = place(spark)
    own = t(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("event_type"))
    with Scratch(spark) as scratch:
        own = scratch.write(windows.numbered(own, "id", scratch))
        size = own.count()
        calls = windows.call_until(lambda: windows.produce_next(own, size, "producer_2", "p2_", path, 5, 60))
    return _messages(spark, path).drop("send_timestamp").withColumn("calls", F.lit(calls).cast("long"))


# uploads


@query("SELECT 'inbox' AS bucket, 'report=' || n_name AS folder, true AS sized FROM nation")
def uploads(spark, sf):
    """An envelope for each new file of a folder."""
    path, out = place(spark), place(spark)
    names = t(spark, sf, "nation").select(F.col("n_name").alias("name"), F.lit(1).alias("position"), F.col("n_name").alias("value"))
    batch.write_reports(names, path)
    ran(windows.to_batches(windows.wanted(files.upload_events(spark, path, "inbox"), prefix="report=", suffix=".txt", without="temporary"), out, place(spark), "append"))
    own = windows.from_batches(spark, out, "append")
    return own.select("bucket", F.substring_index("name", "/", 1).alias("folder"), ((F.col("size").cast("long") > 0) & F.col("timeCreated").isNotNull()).alias("sized"))


_HANDLERS = ("local", "vm", "cloudfunc")


@query(f"SELECT 'out/' || replace(replace(name, 'uploads/', ''), '.txt', '') || '_' || h || '_longest.txt' AS report, position, value FROM ({catalog_files.PLAIN}), (VALUES ('local'), ('vm'), ('cloudfunc')) x(h)")
def fan_out_reports(spark, sf):
    """Three handlers over one stream of uploads; each writes the longest lines' report of every object that passes the guards."""
    source, out = place(spark), place(spark)
    objects = catalog_files.objects(spark, sf)
    events = objects.select(F.lit("b").alias("bucket"), "name")
    noise = events.limit(3).select("bucket", F.explode(F.array(F.lit("out/x.txt"), F.lit(None).cast("string"), F.lit("uploads/x.csv"))).alias("name"))
    events.unionByName(noise).write.json(source)

    def handler(name):
        def run(frame, batch_id):
            own = windows.wanted(frame, prefix="uploads/", suffix=".txt").select("name").join(objects, "name")
            found = batch.longest_reports(own, "name", "value", numbered=False)
            found.select(text.report_name(F.col("name"), f"_{name}_longest.txt", "out/").alias("report"), "position", "value").write.mode("overwrite").parquet(f"{out}/{name}/batch={batch_id}")

        return run

    runs = windows.fan_out(lambda: files.file_stream(spark, source, files.ENVELOPE), {n: handler(n) for n in _HANDLERS}, place(spark))
    for run in runs.values():
        ran(run)
    found = None
    for name in _HANDLERS:
        own = spark.read.parquet(f"{out}/{name}").drop("batch")
        found = own if found is None else found.unionByName(own)
    return found


@query("SELECT CAST(label AS DOUBLE) AS label, count(*) AS n, true AS predicted FROM embeddings GROUP BY 1")
def predicted_on_upload(spark, sf):
    """An uploaded LibSVM file sets off a job that writes a saved model's predictions beside it; other names do nothing."""
    inbox, work, out = place(spark), place(spark), place(spark)
    own = catalog_files.digits(spark, sf)
    classify.save(classify.train(own, (5,), (32,), (1,)), work, spark)
    size = own.select(F.size(vector_to_array("features"))).first()[0]
    sinks.write_libsvm(own, f"{inbox}/digits", single=True)
    sinks.write_libsvm(own.limit(3), f"{inbox}/temporary", single=True)

    def submit(frame, batch_id):
        for name in sorted({r["name"].split("/")[0] for r in windows.wanted(frame, without="temporary").filter(~F.col("name").contains("/_")).collect()}):
            classify.predict_job(spark, work, f"{inbox}/{name}", f"{out}/{name}", size)

    for run in windows.fan_out(lambda: files.upload_events(spark, inbox, "inbox", "part-*"), {"predict": submit}, place(spark)).values():
        ran(run)
    found = files.csv_typed(spark, f"{out}/*", "label double, prediction double, probability_str string")
    return found.groupBy("label").agg(F.count("*").alias("n"), F.bool_and(F.col("prediction").isNotNull() & F.col("probability_str").startswith("[")).alias("predicted"))
