"""Column expressions for amounts, units, percentiles and JSON. Bad text becomes null, never an error."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divisors from micrograms a cubic metre to parts per billion; carbon monoxide is in milligrams.
PPB = {"no2": 1.88, "so2": 2.62, "o3": 2.0, "co": 1.145}


def parse_amount(c: Column) -> Column:
    """Text with blanks and thousands separators as a double."""
    return F.regexp_replace(F.trim(c), ",", "").try_cast("double")


def amount_category(c: Column, low: float = 2500.0, high: float = 7500.0) -> Column:
    """Low, Medium (both bounds inclusive) or High; null for null and for what isn't positive."""
    return F.when(c.isNull() | (c <= 0), F.lit(None)).when(c < low, "Low").when(c <= high, "Medium").otherwise("High")


def to_ppb(c: Column, gas: str) -> Column:
    """Concentration as parts per billion; particles stay as they are."""
    return c * 1000 / PPB["co"] if gas == "co" else c / PPB[gas] if gas in PPB else c


def percentile_expr(values: Column, n: Column, p: float) -> Column:
    """The p-quantile of a sorted array of n values by linear interpolation at p * (n - 1); null if it is empty."""
    at = F.lit(p) * (n - 1)
    low = F.floor(at).cast("int")
    a, b = F.try_element_at(values, low + 1), F.try_element_at(values, F.ceil(at).cast("int") + 1)
    return F.when(n > 0, a + (b - a) * (at - low))


def percentiles(c: Column, ps: Sequence[float]) -> Column:
    """The same quantiles as one aggregate, which keeps a count of distinct values and not a list of all."""
    return F.percentile(c, F.array(*(F.lit(p) for p in ps)))
