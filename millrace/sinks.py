"""Sinks. One part file only where it is asked for: a single task then makes the last stage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").option("header", True).csv(path)


def write_text(df: DataFrame, path: str, separator: str = ",", single: bool = False) -> None:
    """Each row as its columns' text, joined."""
    out = df.select(F.concat_ws(separator, *(F.col(c).cast("string") for c in df.columns)).alias("value"))
    (out.coalesce(1) if single else out).write.mode("overwrite").text(path)


def write_libsvm(df: DataFrame, path: str, single: bool = False) -> None:
    (df.coalesce(1) if single else df).write.mode("overwrite").format("libsvm").save(path)


def preview(df: DataFrame, n: int = 20) -> DataFrame:
    """The first n rows; what is shown to people. Nothing is printed here."""
    return df.limit(n)


def write_messages(messages: DataFrame, path: str) -> None:
    """(key, value) messages as JSON files: what write_kafka() sends, without a broker; message_stream() reads them."""
    messages.write.mode("append").json(path)


def as_messages(df: DataFrame, key: str) -> DataFrame:
    """(key, value): value is the row as JSON without its null fields."""
    return df.select(F.col(key).cast("string").alias("key"), F.to_json(F.struct(*df.columns)).alias("value"))


def write_kafka(df: DataFrame, servers: str, topic: str) -> None:
    """(key, value) to a topic; needs Spark's Kafka package."""
    df.write.format("kafka").option("kafka.bootstrap.servers", servers).option("topic", topic).save()
