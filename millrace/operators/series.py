"""Operators on time series: gaps, filling, carrying forward, trailing counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def missing_hours(df: DataFrame, key: str, ts: str) -> DataFrame:
    """(key, ts) for each hour that lies between two neighbouring rows of a key and has none. ts must be whole hours."""
    before = F.lag(ts).over(Window.partitionBy(key).orderBy(ts))
    gaps = df.select(key, F.col(ts).alias("__to"), before.alias("__from")).filter(F.col("__to") > F.col("__from") + F.expr("INTERVAL 1 HOUR"))
    hours = F.sequence(F.col("__from") + F.expr("INTERVAL 1 HOUR"), F.col("__to") - F.expr("INTERVAL 1 HOUR"), F.expr("INTERVAL 1 HOUR"))
    return gaps.select(key, F.explode(hours).alias(ts))


def carry_forward(df: DataFrame, key: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """Nulls of columns become the last value before them of the same key; leading nulls stay."""
    rows = Window.partitionBy(key).orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(rows) for c in columns})


def regularise(df: DataFrame, key: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """One row for each key and hour from its first to its last. Times are cut to hours; rows without time or key go; of several
    rows in an hour the one with the least values stays, nulls last; hours without a row carry the last values forward."""
    own = df.select(key, F.date_trunc("hour", ts).cast(df.schema[ts].dataType).alias(ts), *columns).dropna(subset=[key, ts])
    least = Window.partitionBy(key, ts).orderBy(*(F.asc_nulls_last(c) for c in columns))
    own = own.withColumn("__rank", F.row_number().over(least)).filter("__rank = 1").drop("__rank")
    full = own.unionByName(missing_hours(own, key, ts), allowMissingColumns=True)
    return carry_forward(full, key, ts, columns)


def trailing_sum(df: DataFrame, seconds_col: str, seconds: int, value: str, name: str, key: str) -> DataFrame:
    """(key, seconds_col, name): for each time of a key the sum of value over the last `seconds` up to it, both ends included.

    Sums by second come first. Then time is cut into stretches of `seconds`; a window reaches at most into the stretch before, so each
    stretch is summed with a copy of that one, and no key and no time is more than two stretches of work. Rows without a time go.
    """
    sums = df.filter(F.col(seconds_col).isNotNull()).groupBy(key, seconds_col).agg(F.sum(value).alias("__n"))
    both = sums.withColumn("__home", F.floor(F.col(seconds_col) / seconds)).withColumn("__at", F.explode(F.array(F.col("__home"), F.col("__home") + 1)))
    rows = Window.partitionBy(key, "__at").orderBy(seconds_col).rangeBetween(-seconds, 0)
    return both.withColumn(name, F.sum("__n").over(rows)).filter("__at = __home").select(key, seconds_col, name)


def trailing_count(df: DataFrame, seconds_col: str, seconds: int, name: str, key: str | None = None) -> DataFrame:
    """How many rows (of the same key) lie in the last `seconds` up to each row, both ends and equal times included; null without a time."""
    own = df.withColumn("__key", F.col(key) if key else F.lit(0))
    found = trailing_sum(own.withColumn("__one", F.lit(1)), seconds_col, seconds, "__one", "__found", "__key")
    found = found.select(F.col("__key").alias("__k"), F.col(seconds_col).alias("__s"), "__found")
    match = F.col("__key").eqNullSafe(F.col("__k")) & (F.col(seconds_col) == F.col("__s"))
    return own.join(found, match, "left").select(*df.columns, F.col("__found").alias(name))
