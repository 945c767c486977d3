"""Operators on whole rows: duplicates, validity, integrity, ranking, sampling."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def split_duplicates(df: DataFrame, cut: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(one of each row, the further copies). Nulls are equal to each other. cut is applied to the counted rows, from which both come;
    give materialise() where both are used.

    Copies are counted by partial aggregation, so that a row with very many copies isn't gathered in one task; the further copies
    are made from the count.
    """
    counted = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n"))
    counted = cut(counted) if cut else counted
    more = counted.filter(F.col("__n") > 1).withColumn("__i", F.explode(F.sequence(F.lit(2), F.col("__n")))).select(*df.columns)
    return counted.select(*df.columns), more


def split_valid(df: DataFrame, invalid: Column) -> tuple[DataFrame, DataFrame]:
    """(rows where the condition is false or null, rows where it holds)."""
    bad = F.coalesce(invalid, F.lit(False))
    return df.filter(~bad), df.filter(bad)


def referenced(df: DataFrame, keys: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is among keys' ones; no fan-out."""
    return df.join(keys.select(F.col(other or key).alias("__key")), F.col(key) == F.col("__key"), "left_semi")


def orphans(df: DataFrame, keys: DataFrame, key: str, other: str | None = None) -> DataFrame:
    """Rows whose key is null or not among keys' ones."""
    return df.join(keys.select(F.col(other or key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")


def top_k(df: DataFrame, by: str, k: int, ties: Sequence[str]) -> DataFrame:
    """The k rows with the largest values, nulls last; ties go by further columns, ascending."""
    return df.orderBy(F.desc_nulls_last(by), *ties).limit(k)


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """One row of each key, the first in an order that should leave no ties."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).filter("__rank = 1").drop("__rank")


def argmax(df: DataFrame, label: str, metric: str) -> DataFrame:
    """The label with the largest metric (of equal ones the least label) and the metric; no row if all are null."""
    return top_k(df.filter(F.col(metric).isNotNull()).select(label, metric), metric, 1, [label])


def merge(left: DataFrame, right: DataFrame, on: Sequence[str], suffixes: tuple[str, str] = ("_x", "_y"), how: str = "inner") -> DataFrame:
    """A join on columns that both sides have; other columns that clash get the side's suffix."""
    clash = {c for c in left.columns if c not in on} & set(right.columns)
    a = left.withColumnsRenamed({c: c + suffixes[0] for c in clash})
    return a.join(right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), list(on), how)


def row_counts(**frames: DataFrame) -> DataFrame:
    """(name, n): the number of rows of each frame, in one job."""
    out = None
    for name, df in frames.items():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("name"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, n, mean, std, min, p25, p50, p75, max) of numeric columns, quantiles by interpolation, in one aggregation."""
    parts = []
    for c in columns:
        v = F.col(c).cast("double")
        q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
        parts.append(F.struct(F.lit(c).alias("column"), F.count(v).alias("n"), F.mean(v).alias("mean"), F.stddev_samp(v).alias("std"), F.min(v).alias("min"), q[0].alias("p25"), q[1].alias("p50"), q[2].alias("p75"), F.max(v).alias("max")))
    return df.agg(F.array(*parts).alias("all")).select(F.inline("all"))


def sample_rows(df: DataFrame, n: int, seed: int = 42, exact: bool = False) -> DataFrame:
    """n rows at random: by a fraction of the count, which may give fewer, or exactly by the least of random numbers."""
    if exact:
        return df.orderBy(F.rand(seed)).limit(n)
    total = df.count()
    return df.sample(False, min(1.0, n / total), seed).limit(n) if total else df.limit(0)
