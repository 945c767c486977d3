"""Column expressions for text cells."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: City names that stand for others.
CITY_ALIASES = {"Cochin": "Kochi", "Cmbt": "Coimbatore", "Hyd": "Hyderabad", "Trivandrm": "Trivandrum", "Poona": "Pune"}


def standard_name(c: Column, aliases: dict[str, str] = CITY_ALIASES) -> Column:
    """Trimmed, each blank-separated word capitalised, aliases replaced; null stays null. `o'neil` becomes `O'neil` here;
    title_exact() capitalises after every mark."""
    name = F.initcap(F.trim(c))
    pairs = [F.lit(x) for pair in aliases.items() for x in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), name), name) if pairs else name


def _title(s: pd.Series) -> pd.Series:
    return s.str.strip().str.title()


def title_exact(c: Column | str) -> Column:
    """Python's title(): a capital after every character that is no letter. Runs in Python, in batches."""
    return F.pandas_udf(_title, "string")(c)


def trim_strings(df: DataFrame) -> DataFrame:
    """All string columns without blanks at their ends."""
    return df.select(*(F.trim(c).alias(c) if t == "string" else F.col(c) for c, t in df.dtypes))


def strip_names(df: DataFrame) -> DataFrame:
    """Column names without blanks at their ends."""
    return df.toDF(*(c.strip() for c in df.columns))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def stem(name: Column) -> Column:
    """A path's last part without its extension."""
    return F.regexp_replace(F.substring_index(name, "/", -1), r"(?<=.)\.[^.]*$", "")


def report_name(name: Column, suffix: str = "_longest_lines.txt", folder: str | None = None) -> Column:
    """Where an object's report goes: beside it (its extension replaced), or in a folder under its last part's name."""
    if folder is None:
        return F.concat(F.regexp_replace(name, r"(?<=[^/])\.[^./]*$", ""), F.lit(suffix))
    return F.concat(F.lit(folder), stem(name), F.lit(suffix))
