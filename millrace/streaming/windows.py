"""Streaming: windowed counts and rankings, sinks, producers, fan-out. Checkpoints and triggers are arguments; nothing blocks."""

from __future__ import annotations

import logging
import time
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from millrace.operators.rows import latest_per_key
from millrace.plans.batch import rank_in_window
from millrace.scratch import Scratch

log = logging.getLogger(__name__)
#: A query without a trigger handles what is there and ends.
NOW = {"availableNow": True}


def windowed_count(stream: DataFrame, ts: str, size: str = "10 seconds", watermark: str | None = None) -> DataFrame:
    """(window_start, window_end, row_count) of tumbling windows."""
    own = stream.select(F.col(ts).cast("timestamp").alias("ts")).withWatermark("ts", watermark or size)
    return own.groupBy(F.window("ts", size)).agg(F.count(F.lit(1)).alias("row_count")).select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "row_count")


def sliding_totals(stream: DataFrame, ts: str, key: str, peak: str, parts: list[str], size: str = "8 hours", slide: str = "1 hour", watermark: str = "1 hour", missing_as_zero: bool = False) -> DataFrame:
    """(window_start, window_end, key, v1, v2): the largest peak, and the sum of the parts' sums, which is null if a part has no
    value at all, unless missing_as_zero."""
    own = stream.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", watermark)
    total = None
    for part in parts:
        s = F.coalesce(F.sum(part), F.lit(0)) if missing_as_zero else F.sum(part)
        total = s if total is None else total + s
    found = own.groupBy(F.window("__ts", size, slide), key).agg(F.max(peak).alias("v1"), total.alias("v2"))
    return found.select(F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), key, "v1", "v2")


def start(stream: DataFrame, name: str, checkpoint: str, mode: str = "append", sink: str = "memory", path: str | None = None, trigger: dict | None = None, state_partitions: int | None = None) -> StreamingQuery:
    """A named query. state_partitions is the number of partitions of its state, which a checkpoint keeps; the session's own
    number stays."""
    writer = stream.writeStream.queryName(name).outputMode(mode).format(sink).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW))
    return _with_partitions(stream.sparkSession, state_partitions, lambda: writer.start(path) if path else writer.start())


def _with_partitions(spark: SparkSession, n: int | None, run: Callable[[], StreamingQuery]) -> StreamingQuery:
    key = "spark.sql.shuffle.partitions"
    before = spark.conf.get(key)
    if n:
        spark.conf.set(key, str(n))
    try:
        return run()  # a query has its own copy of the settings from here on
    finally:
        spark.conf.set(key, before)


def to_batches(stream: DataFrame, path: str, checkpoint: str, mode: str, trigger: dict | None = None, change: Callable[[DataFrame], DataFrame] | None = None, fmt: str = "parquet", state_partitions: int | None = None) -> StreamingQuery:
    """Each micro-batch as path/batch=<id>, changed by a function if one is given. A batch that runs again overwrites its own folder, so that
    a replay changes nothing; an empty one writes nothing; one that fails isn't acknowledged."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            log.info("batch %d is empty", batch_id)
            return
        out = change(batch) if change else batch
        out.write.mode("overwrite").option("header", True).format(fmt).save(f"{path}/batch={batch_id}")
        log.info("batch %d is written to %s", batch_id, path)

    writer = stream.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW))
    return _with_partitions(stream.sparkSession, state_partitions, writer.start)


def from_batches(spark: SparkSession, path: str, mode: str, keys: Sequence[str] = (), schema: str | None = None, fmt: str = "parquet") -> DataFrame:
    """What to_batches() has written so far: all rows in append mode, the last batch's in complete mode, the last row of each key in
    update mode."""
    reader = spark.read.option("header", True).format(fmt)
    every = (reader.schema(schema + ", batch long") if schema else reader).load(path)
    if mode == "append":
        return every.drop("batch")
    if mode == "complete":
        last = every.agg(F.max("batch").alias("__last"))
        return every.join(F.broadcast(last), F.col("batch") == F.col("__last"), "left_semi").drop("batch")
    return latest_per_key(every, keys, [F.desc("batch")]).drop("batch")


def ranking_batches(stream: DataFrame, key: str, path: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """sliding_totals() in complete mode: each batch ranks all windows and writes them as CSV. (In update mode a batch would rank only
    what changed.)"""
    return to_batches(stream, path, checkpoint, "complete", trigger, lambda batch: rank_in_window(batch, "window_start", "v1", "v2", key), "csv")


def numbered(df: DataFrame, order: str, scratch: Scratch) -> DataFrame:
    """df with a column record_number: rows from 0 in the order of a column, without gaps.

    Rows are sorted in ranges and counted in their partitions; the partitions' first numbers are sums of a count for each
    partition.
    """
    ranged = df.repartitionByRange(order).sortWithinPartitions(order, *(c for c in df.columns if c != order))
    # a task's numbers begin anew in the lower 33 bits
    own = scratch.write(ranged.withColumn("__part", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)))
    sizes = sorted((r["__part"], r["count"]) for r in own.groupBy("__part").count().collect())
    first, at = [], 0
    for part, n in sizes:
        first.append((part, at))
        at += n
    firsts = df.sparkSession.createDataFrame(first, "__part int, __first long")
    return own.join(F.broadcast(firsts), "__part").select(*df.columns, (F.col("__first") + F.col("__i")).alias("record_number"))


def messages(rows: DataFrame, producer: str, prefix: str) -> DataFrame:
    """(key, value) for rows with a record_number: the columns as text, with producer_id, record_number and send_timestamp, as JSON."""
    own = rows.select(*(F.col(c).cast("string").alias(c) for c in rows.columns if c != "record_number"), F.lit(producer).alias("producer_id"), "record_number", (F.unix_micros(F.current_timestamp()) / 1e6).alias("send_timestamp"))
    return own.select(F.concat(F.lit(prefix), "record_number").alias("key"), F.to_json(F.struct(*own.columns)).alias("value"))


def looped(rows: DataFrame, size: int, first: int, last: int) -> DataFrame:
    """The records first to last (exclusive) of `size` numbered rows that begin again at their end."""
    place = F.col("record_number")
    begin = F.ceil((F.lit(first) - place) / size)
    rounds = F.sequence(F.greatest(begin, F.lit(0)), F.floor((F.lit(last - 1) - place) / size))
    return rows.filter(place + F.greatest(begin, F.lit(0)) * size < last).withColumn("__round", F.explode(rounds)).withColumn("record_number", (place + F.col("__round") * size).cast("long")).drop("__round")


def publish(stream: DataFrame, producer: str, prefix: str, path: str, checkpoint: str, order: str = "id", trigger: dict | None = None) -> StreamingQuery:
    """Each micro-batch as messages under path/messages/batch=<id>, numbered on from the batch before. What has been written is noted under
    path/progress after the messages, so that a batch that runs again has the same numbers, also after a restart."""
    spark = stream.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        before = progress(spark, path, batch_id)
        first = before["records_sent"]
        with Scratch(spark) as scratch:
            own = scratch.write(numbered(batch, order, scratch).withColumn("record_number", F.col("record_number") + first))
            messages(own, producer, prefix).write.mode("overwrite").json(f"{path}/messages/batch={batch_id}")
            _note(spark, path, batch_id, first + own.count(), False)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or NOW)).start()


_PROGRESS = "records_sent long, completed boolean, batch long"


def _note(spark: SparkSession, path: str, batch: int, sent: int, completed: bool) -> None:
    spark.createDataFrame([(sent, completed)], "records_sent long, completed boolean").coalesce(1).write.mode("overwrite").json(f"{path}/progress/batch={batch}")
    log.info("%d records are sent to %s", sent, path)


def progress(spark: SparkSession, path: str, before: int | None = None) -> dict:
    """What a producer has noted (in batches before the given one): records_sent, completed, batches."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/progress")
    if not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place):
        return {"records_sent": 0, "completed": False, "batches": 0}
    found = spark.read.schema(_PROGRESS).json(f"{path}/progress")
    found = found if before is None else found.filter(F.col("batch") < before)
    r = found.agg(F.max("records_sent").alias("sent"), F.max("completed").alias("completed"), F.max("batch").alias("last")).first()
    return {"records_sent": r["sent"] or 0, "completed": bool(r["completed"]), "batches": 0 if r["last"] is None else r["last"] + 1}


def produce_next(rows: DataFrame, size: int, producer: str, prefix: str, path: str, batch: int = 5, total: int = 1000) -> dict:
    """One call of a producer that keeps its progress: the next `batch` of `total` records of `size` numbered rows as messages, then the note of
    it. A call that fails notes nothing and is made again; after the last record calls do nothing. The progress."""
    spark = rows.sparkSession
    state = progress(spark, path)
    if state["completed"]:
        return state
    last = min(state["records_sent"] + batch, total)
    messages(looped(rows, size, state["records_sent"], last), producer, prefix).write.mode("overwrite").json(f"{path}/messages/batch={state['batches']}")
    _note(spark, path, state["batches"], last, last >= total)
    return progress(spark, path)


def call_until(step: Callable[[], dict], most: int = 200, pause: float = 0.0) -> int:
    """Call step, with a pause in between, until it says completed; the number of calls."""
    for i in range(most):
        if step()["completed"]:
            return i + 1
        time.sleep(pause)
    return most


def wanted(events: DataFrame, prefix: str | None = None, not_prefix: str | None = None, suffix: str | None = None, without: str | None = None) -> DataFrame:
    """Events (name) that have a name and pass the given tests."""
    ok = F.col("name").isNotNull()
    for value, test in ((prefix, F.col("name").startswith), (suffix, F.col("name").endswith)):
        ok = ok & test(value) if value else ok
    for value, test in ((not_prefix, F.col("name").startswith), (without, F.col("name").contains)):
        ok = ok & ~test(value) if value else ok
    return events.filter(ok)


def fan_out(stream: Callable[[], DataFrame], handlers: dict[str, Callable[[DataFrame, int], None]], checkpoint: str, trigger: dict | None = None) -> dict[str, StreamingQuery]:
    """One query for each handler over the same source, each with a checkpoint of its own; a failing batch isn't acknowledged."""

    def logged(name: str, f: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        def run(batch: DataFrame, batch_id: int) -> None:
            try:
                f(batch, batch_id)
            except Exception:
                log.exception("handler %s failed in batch %d, which will run again", name, batch_id)
                raise

        return run

    return {name: stream().writeStream.foreachBatch(logged(name, f)).option("checkpointLocation", f"{checkpoint}/{name}").trigger(**(trigger or NOW)).start() for name, f in handlers.items()}
