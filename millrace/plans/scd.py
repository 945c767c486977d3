"""Slowly changing dimensions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_DATES = ("effective_date", "expiry_date", "current_flag")


def _attributes(master: DataFrame, key: str) -> list[str]:
    return [c for c in master.columns if c != key and c not in _DATES]


def scd1(master: DataFrame, updates: DataFrame, key: str = "customer_id") -> DataFrame:
    """Current rows only, attributes overwritten: an updated key takes the update's attributes and keeps its dates; a new one
    becomes effective on its change_date. Several updates of a key give several rows. Keys of null stay."""
    own = _attributes(master, key)
    current = master.filter("current_flag = 1")
    dates = current.select(F.col(key).alias("__key"), *_DATES)
    changed = updates.join(dates, F.col(key) == F.col("__key"), "left").select(
        key, *own, F.coalesce("effective_date", "change_date").alias("effective_date"), "expiry_date", F.coalesce("current_flag", F.lit(1)).alias("current_flag")
    )
    same = current.join(updates.select(F.col(key).alias("__key")), F.col(key) == F.col("__key"), "left_anti")
    return changed.unionByName(same.select(*changed.columns))


def scd2(master: DataFrame, updates: DataFrame, key: str = "customer_id", preserve_history: bool = True) -> DataFrame:
    """A new version for each update: the current row expires on the change_date, the update becomes current then. Without
    preserve_history, rows of updated keys that had expired before are lost, as a plain three-branch merge loses them."""
    own = _attributes(master, key)
    change = updates.select(F.col(key).alias("__key"), F.col("change_date").alias("__date"))
    match = F.col(key) == F.col("__key")
    expired = master.filter("current_flag = 1").join(change, match).select(key, *own, "effective_date", F.col("__date").alias("expiry_date"), F.lit(0).alias("current_flag"))
    columns = expired.columns
    new = updates.select(key, *own, F.col("change_date").alias("effective_date"), F.lit(None).cast(master.schema["expiry_date"].dataType).alias("expiry_date"), F.lit(1).alias("current_flag"))
    out = [expired, new, master.join(change, match, "left_anti")]
    if preserve_history:
        out.append(master.filter("current_flag <> 1 OR current_flag IS NULL").join(change, match, "left_semi"))
    result = out[0]
    for part in out[1:]:
        result = result.unionByName(part.select(*columns))
    return result


#: Types of the raw tables' columns; the others are text.
TYPES = {"transaction_amount": "double", "effective_date": "date", "expiry_date": "date", "change_date": "date", "current_flag": "int"}


def typed(raw: DataFrame) -> DataFrame:
    """A raw table (all text) with the columns named in TYPES typed; what doesn't fit is null."""
    return raw.select(*(F.col(c).try_cast(TYPES[c]).alias(c) if c in TYPES else F.col(c) for c in raw.columns))


def run_sql(text: str, **tables: DataFrame) -> DataFrame:
    """The result of SQL text in which {name} stands for a frame. The frames become views of this call's own, so that nothing of
    the session's is replaced."""
    return next(iter(tables.values())).sparkSession.sql(text, **tables)
