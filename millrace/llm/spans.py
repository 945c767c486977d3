"""Places of pattern matches, in SQL functions only.

The engine gives a pattern's matches and the pieces between them; starts are running sums of their lengths in code
points. The sums are made in blocks, so that a text with very many matches takes no quadratic time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BLOCK = 256


def literal(pattern: str) -> str:
    """A pattern as a raw SQL string."""
    return 'r"' + pattern.replace('"', "\\x22") + '"'


def match_columns(text: str, pattern: str, when: str) -> tuple[Column, Column]:
    """(matches, pieces between them) of a text column; both empty where the cheap condition `when` is false."""
    p = literal(pattern)
    return (
        F.expr(f"CASE WHEN {when} THEN regexp_extract_all({text}, {p}, 0) ELSE cast(array() AS array<string>) END"),
        F.expr(f"CASE WHEN {when} THEN split({text}, {p}, -1) ELSE cast(array() AS array<string>) END"),
    )


def places(matches: str, pieces: str) -> str:
    """SQL: array of (s, e, t): start, end (exclusive), text of each match, in order."""
    blocks = f"transform(sequence(0, (size({matches}) - 1) div {BLOCK}), b -> zip_with(slice({matches}, b * {BLOCK} + 1, {BLOCK}), slice(slice({pieces}, 1, size({matches})), b * {BLOCK} + 1, {BLOCK}), (m, p) -> named_struct('g', length(p), 'l', length(m), 't', m)))"
    total = "aggregate(k, 0, (a, x) -> a + x.g + x.l)"
    kind = "array<struct<s: int, e: int, t: string>>"
    inner = f"aggregate(k, named_struct('at', base[i], 'out', cast(array() AS {kind})), (a, x) -> named_struct('at', a.at + x.g + x.l, 'out', concat(a.out, array(named_struct('s', a.at + x.g, 'e', a.at + x.g + x.l, 't', x.t)))), a -> a.out)"
    bases = f"aggregate(transform(all, k -> {total}), array(0), (a, x) -> concat(a, array(element_at(a, -1) + x)))"
    return f"CASE WHEN size({matches}) = 0 THEN cast(array() AS {kind}) ELSE flatten(transform(array({blocks}), all -> flatten(transform(array({bases}), base -> flatten(transform(all, (k, i) -> {inner})))))) END"


def with_spans(df: DataFrame, text: str, patterns: dict[str, tuple[str, str]]) -> DataFrame:
    """Add a column of places for each name: (pattern, condition)."""
    made = {}
    for name, (pattern, when) in patterns.items():
        made[f"{name}_m"], made[f"{name}_p"] = match_columns(text, pattern, when)
    df = df.withColumns(made)
    df = df.withColumns({name: F.expr(places(f"{name}_m", f"{name}_p")) for name in patterns})
    return df.drop(*made)
