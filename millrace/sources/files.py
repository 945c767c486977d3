"""Sources: CSV, text, LibSVM, event envelopes, generated rows; and an adapter for Kafka."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Choices of the generated product events.
CATEGORIES = ("Electronics", "Clothing", "Food", "Books", "Toys", "Sports")
REGIONS = ("North", "South", "East", "West", "Central")

ENVELOPE = T.StructType([T.StructField(n, T.StringType()) for n in ("bucket", "name", "timeCreated", "size")])


def csv_strings(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header; every column is text."""
    return spark.read.option("header", True).option("inferSchema", False).csv(path)


def csv_typed(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header and a declared schema; a cell that doesn't fit is null and its row stays."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def csv_inferred(spark: SparkSession, path: str) -> DataFrame:
    """A CSV with a header and types taken from its values, which costs a pass over the file."""
    return spark.read.csv(path, header=True, inferSchema=True)


def smoke_count(spark: SparkSession, n: int = 4) -> DataFrame:
    """(n): a count of n rows that are made on the cluster."""
    return spark.range(1, n + 1).agg(F.count(F.lit(1)).alias("n"))


def text_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value) for each line; order isn't kept, see whole_texts() for numbered lines."""
    return spark.read.text(path)


def whole_texts(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, value): each file as one text, bad UTF-8 replaced; strict: an error where a file isn't UTF-8."""
    raw = spark.read.format("binaryFile").load(path).select("path", F.col("content").cast("string").alias("value"))
    return raw.select("path", (F.validate_utf8("value") if strict else F.make_valid_utf8("value")).alias("value"))


def libsvm(spark: SparkSession, path: str, n_features: int | None = None) -> DataFrame:
    """(label, features); give n_features so that training and test sets agree."""
    reader = spark.read.format("libsvm")
    return (reader.option("numFeatures", n_features) if n_features else reader).load(path)


def push_messages(df: DataFrame, column: str = "data") -> DataFrame:
    """(event: struct) from base64 JSON envelopes; what doesn't parse has null fields."""
    raw = F.try_to_binary(F.col(column), F.lit("base64")).cast("string")
    return df.withColumn("event", F.from_json(raw, ENVELOPE))


def product_events(spark: SparkSession, n: int, first_id: int = 0, seed: int = 42) -> DataFrame:
    """n generated rows, one second apart."""

    def choice(values: tuple[str, ...], s: int):
        return F.element_at(F.array(*map(F.lit, values)), (F.floor(F.rand(s) * len(values)) + 1).cast("int"))

    return spark.range(first_id, first_id + n).select(
        F.col("id").cast("int"),
        F.concat(F.lit("Product_"), "id").alias("product_name"),
        choice(CATEGORIES, seed).alias("category"),
        F.round(10 + F.rand(seed + 1) * 989.99, 2).alias("price"),
        (F.floor(F.rand(seed + 2) * 100) + 1).cast("int").alias("quantity"),
        choice(REGIONS, seed + 3).alias("region"),
        F.date_format(F.timestamp_seconds(F.lit(1704067200) + F.col("id") - first_id), "yyyy-MM-dd'T'HH:mm:ss").alias("timestamp"),
        F.round(1 + F.rand(seed + 4) * 4, 2).alias("score"),
    )


def upload_events(spark: SparkSession, path: str, bucket: str, glob: str | None = None) -> DataFrame:
    """A stream of envelopes (bucket, name, timeCreated, size), one for each new file of a folder; name is its place in it."""
    reader = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("recursiveFileLookup", True)
    files = (reader.option("pathGlobFilter", glob) if glob else reader).load(path)
    name = F.substring_index("path", path.rstrip("/").split("/")[-1] + "/", -1)
    return files.select(F.lit(bucket).alias("bucket"), name.alias("name"), F.col("modificationTime").cast("string").alias("timeCreated"), F.col("length").cast("string").alias("size"))


def message_stream(spark: SparkSession, path: str, starting: str = "earliest", per_trigger: int | None = None) -> DataFrame:
    """(key, value, timestamp) from folders of JSON messages: what kafka_stream() gives, without a broker. latest: only files that are
    written after the call; earliest: all. The folder must exist."""
    own = file_stream(spark, path, "key string, value string", "json", per_trigger)
    own = own.select(F.col("key").cast("binary").alias("key"), F.col("value").cast("binary").alias("value"), F.col("_metadata.file_modification_time").alias("timestamp"))
    if starting == "latest":
        now = spark.range(1).select(F.current_timestamp().cast("double")).first()[0]
        own = own.filter(F.col("timestamp").cast("double") > now)
    return own


def file_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", per_trigger: int | None = None, glob: str | None = None) -> DataFrame:
    """New files of a folder as a stream; per_trigger bounds the rate."""
    reader = spark.readStream.schema(schema).format(fmt)
    for key, value in (("maxFilesPerTrigger", per_trigger), ("pathGlobFilter", glob)):
        reader = reader.option(key, value) if value else reader
    return reader.load(path)


def kafka_stream(spark: SparkSession, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """(key, value, timestamp) of a topic; needs Spark's Kafka package, without which load() says so."""
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", starting).option("failOnDataLoss", "false").load()
