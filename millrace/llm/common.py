"""Helpers shared by the corpus operators: fresh column names, Arrow batches; scratch tables come from the library."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.scratch import Scratch, materialise, scratch_root

__all__ = ["Scratch", "materialise", "scratch_root"]

#: Lower-cases A-Z only, as the text contracts ask for.
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


#: Bounds of an Arrow batch; the default of 10,000 rows is a lot of memory where texts are long.
BATCH_ROWS, BATCH_BYTES = 1_000, 2 << 20


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have yet (names compare without case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def give_back() -> None:
    """Return free memory to the system: Python workers outlive their tasks, and what one operator used would add to the next one's."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # not every C library has it
    if trim:
        trim(0)


def bound_batches(spark: SparkSession) -> None:
    """Lower the session's bounds of Arrow batches to ours; lower ones stay."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key, None)
        # zero and less mean no bound; a size may have a unit, then it's the user's own
        if now is None or now.lstrip("-").isdigit() and not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def map_batches(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str, done: Callable[[], None] | None = None) -> DataFrame:
    """Run make() once a task, and what it returns on every Arrow batch; done() at the end, before memory is given back."""
    bound_batches(df.sparkSession)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = make()
        try:
            for batch in batches:
                if batch.num_rows:
                    out = step(batch)
                    if out.num_rows:
                        yield out
        finally:
            step = batch = out = None
            if done:
                done()
            give_back()

    return df.mapInArrow(run, schema)


def key_texts(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Only the two columns that an operator needs, so that others can't clash."""
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
