"""Personal data: generators propose overlapping spans, boosted trees score them, calibrated thresholds select.

Everything from the text to the redacted text is SQL functions. The base rules' spans always stay; the trees decide on the other
candidates: addresses in disguise, numbers that look like telephone, card or social security numbers without
meeting the base rules. The trees are fitted to labelled candidates that labelled() makes from a seed, with the features
that the same SQL gives for them.
"""

from __future__ import annotations

import functools
import random
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import trees
from millrace.llm.spans import with_spans

#: Kinds in their order.
KINDS = ("email", "ip", "card", "phone", "ssn")
#: The base patterns, without backtracking and, where runs could be scanned again from each start, only from a run's start.
BASE = {
    "email": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++", "contains(txt, '@')"),
    "ip": (r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}", "has_digit AND contains(txt, '.')"),
    "card": (r"[0-9](?:[\x20-]?+[0-9])++", "has_digit"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", "has_digit AND contains(txt, '+')"),
}
#: Generators of further candidates.
OTHER = {
    "disguised": (r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++(?:\x20?+[(\[](?:at|AT)[)\]]\x20?+|\x20(?:at|AT)\x20)[A-Za-z0-9-]++(?:(?:\.|\x20?+[(\[](?:dot|DOT)[)\]]\x20?+|\x20(?:dot|DOT)\x20)[A-Za-z0-9-]++)++", "txt RLIKE '(?i)[(\\\\[ ]at[)\\\\] ]'"),
    "grouped": (r"(?<![0-9A-Za-z.+])\(?[0-9](?:[\x20().-]{0,2}[0-9]){6,18}(?![0-9A-Za-z])", "has_digit"),
}
_DIGITS = "regexp_replace(x.t, '[^0-9]', '')"


def _luhn(digits: str) -> str:
    """SQL: the sum of the digits, every second one from the right doubled; digits has at most 19."""
    at = [f"substr(lpad({digits}, 19, '0'), {i}, 1)" for i in range(1, 20)]
    return "(" + " + ".join(f"(locate({d}, '0516273849') - 1)" if i % 2 else f"cast({d} AS int)" for i, d in enumerate(at)) + ") % 10 = 0"


#: What a base match must meet.
VALID = {
    "email": "true",
    "ip": "x.t RLIKE '^0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])([.]0*(25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])){3}$'",
    "card": f"length({_DIGITS}) BETWEEN 14 AND 19 AND {_luhn(_DIGITS)}",
    "phone": f"length({_DIGITS}) BETWEEN 10 AND 15",
}
_BEFORE = "lower(substring(txt, greatest(1, x.s - 31), least(x.s, 32)))"
_WORDS = {"phone": "phone|tel|call|mobile|fax|cell|contact|sms|ring", "card": "card|visa|mastercard|amex|credit|debit", "ssn": "ssn|social|security", "email": "mail|contact|write|reach|send", "other": "order|invoice|isbn|ref|version|serial|id|no|part|page|date|sku|item|lot|tracking"}
#: What the digits of payment cards begin with, by length, and common top-level domains.
ISSUERS = "^(4[0-9]{12}([0-9]{3})?|5[1-5][0-9]{14}|2[2-7][0-9]{14}|3[47][0-9]{13}|6(011|5[0-9]{2})[0-9]{12})$"
DOMAINS = "com|org|net|edu|gov|info|io|co|de|fr|es|it|nl|uk|us|eu"


def features(p: str) -> dict[str, str]:
    """SQL of a candidate's features as numbers, so that trees can cut them; p stands before the names of its fields."""
    t, shape, before = f"{p}t", f"{p}shape", f"{p}before"

    def count(mark: str) -> str:
        return f"cast(length({t}) - length(replace({t}, '{mark}', '')) AS double)"

    def fits(what: str, pattern: str) -> str:
        return f"cast({what} RLIKE '{pattern}' AS double)"

    return {
        "length": f"cast({p}e - {p}s AS double)",
        "digits": f"cast({p}nd AS double)",
        "groups": f"cast(size(split({shape}, '[^9]+')) AS double)",
        "dashes": count("-"),
        "dots": count("."),
        "spaces": count(" "),
        "parens": f"cast(contains({t}, '(') AS double)",
        "ssn_shape": f"cast({shape} = '999-99-9999' AS double)",
        "phone_shape": fits(shape, "^[(]?999[)]?[-. ]{0,2}999[-. ]9999$"),
        "card_shape": fits(shape, "^9999([- ]?)9999\\\\1?9999\\\\1?9999$"),
        "issuer": fits(f"regexp_replace({t}, '[^0-9]', '')", ISSUERS),
        "at": fits(t, "(?i)[(\\\\[]at[)\\\\]]"),
        "dot": fits(t, "(?i)[(\\\\[]dot[)\\\\]]|[.][A-Za-z]{2,6}$"),
        "spelt": fits(t, "(?i) dot "),
        "domain": fits(t, f"(?i)[^a-z]({DOMAINS})$"),
        "date": fits(t, "^(19|20)[0-9]{2}[-. ][0-9]{1,2}[-. ][0-9]{1,2}"),
        "decimal": fits(t, "^[0-9]+[.][0-9]+$"),
        **{f"near_{k}": fits(before, f"(^|[^a-z])({w})[^a-z]*([a-z]+[^a-z]+)?$") for k, w in _WORDS.items()},
        "money": fits(before, "[$€£] ?$"),
    }


SEED, SAMPLES, PRECISION = 11, 4000, 0.995


def candidates(docs: DataFrame, generators: dict = OTHER) -> DataFrame:
    """Add to docs (txt): a column of valid places for each base kind, and one (others) of the generators' candidates with
    what the features need."""
    df = docs.withColumn("has_digit", F.expr("txt RLIKE '[0-9]'"))
    df = with_spans(df, "txt", BASE | generators)
    df = df.withColumns({k: F.expr(f"filter({k}, x -> {VALID[k]})") for k in BASE})
    kind = "CASE WHEN g = 'disguised' THEN 0 WHEN {shape} = '999-99-9999' THEN 4 WHEN length({digits}) BETWEEN 13 AND 19 THEN 2 ELSE 3 END"
    parts = []
    for g in generators:
        shape = "regexp_replace(x.t, '[0-9]', '9')"
        k = kind.replace("g =", f"'{g}' =").format(shape=shape, digits=_DIGITS)
        parts.append(f"transform({g}, x -> named_struct('s', x.s, 'e', x.e, 't', x.t, 'k', {k}, 'nd', length({_DIGITS}), 'shape', {shape}, 'before', {_BEFORE}))")
    return df.withColumn("others", F.expr(f"concat({', '.join(parts)})")).drop("has_digit", *generators)


def labelled(seed: int = SEED, n: int = SAMPLES) -> list[tuple[str, int]]:
    """Texts with one candidate each, and whether it is personal data."""
    r = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(r.choice("0123456789") for _ in range(k))

    fill = "the a of report shows that people went home and later we saw it near house value team list for this".split()

    def words(k: int) -> str:
        return " ".join(r.choice(fill) for _ in range(k))

    def name() -> str:
        return "".join(r.choice("abcdefghijklmnoprstuvwz") for _ in range(r.randint(3, 9)))

    def card() -> str:
        start = r.choice(["4", "51", "55", "2221", "2669", "34", "37", "6011", "65"])
        return start + digits((15 if start in ("34", "37") else 16) - len(start))

    def number(low: int, high: int) -> str:
        while re.match(ISSUERS, found := digits(r.randint(low, high))):
            pass
        return found

    true = [
        lambda: r.choice(["call", "phone", "tel:", "mobile", "fax", "contact"]) + " " + r.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(digits(3), digits(3), digits(4)),
        lambda: "({}) {}-{}".format(digits(3), digits(3), digits(4)),
        lambda: r.choice(["ssn", "social security number", "SSN:"]) + f" {digits(3)}-{digits(2)}-{digits(4)}",
        lambda: r.choice(["card", "visa", "credit card"]) + " " + r.choice(["4{} {} {} {}", "5{}-{}-{}-{}"]).format(digits(3), digits(4), digits(4), digits(4)),
        lambda: f"{r.choice(['', 'paid by card ', words(1) + ' '])}{card()}",
        lambda: f"{name()}{r.choice(['(at)', ' (at) ', '[at]', ' [at] '])}{name()}{r.choice(['.', ' (dot) ', '[dot]', '(dot)'])}{r.choice(['com', 'org', 'net'])}",
        lambda: f"{r.choice(['mail', 'write to', 'reach me', 'reach me ' + words(1)])} {name()} {r.choice(['at', 'AT'])} {name()} {r.choice(['dot', 'DOT'])} {r.choice(['com', 'org', 'net', 'de', 'io'])}",
    ]
    false = [
        lambda: r.choice(["order", "invoice", "ref", "serial", "part no", "tracking"]) + " " + digits(r.randint(7, 19)),
        lambda: f"{r.choice(['on', 'date', 'since'])} {r.randint(1900, 2030)}-{r.randint(10, 12)}-{r.randint(10, 28)}",
        lambda: r.choice(["$", "€ ", "£"]) + digits(r.randint(7, 9)),
        lambda: f"{digits(r.randint(1, 5))}.{digits(r.randint(6, 12))}",
        lambda: f"isbn {digits(3)}-{digits(1)}-{digits(4)}-{digits(4)}-{digits(1)}",
        lambda: f"{words(2)} {number(7, 18)}",
        lambda: f"{r.choice(['order', 'invoice', 'tracking', 'serial'])} {card()}",
        lambda: f"version {digits(2)}.{digits(2)}.{digits(4)}",
        lambda: f"{digits(4)} {digits(4)} {digits(4)}",
        lambda: f"look at {r.choice(fill)}.{r.choice(fill).title()}",
        lambda: f"{r.choice(fill)} at {r.choice(fill)} dot {r.choice(fill)}",
        lambda: " ".join(digits(r.randint(1, 3)) for _ in range(r.randint(4, 7))),
    ]
    out = []
    for _ in range(n):
        good = r.random() < 0.5
        out.append((f"{words(r.randint(0, 5))} {r.choice(true if good else false)()} {words(r.randint(0, 4))}".strip(), int(good)))
    return out


@functools.lru_cache(maxsize=2)
def model(spark: SparkSession, seed: int = SEED, n: int = SAMPLES) -> tuple[trees.Ensemble, tuple[float, ...]]:
    """The trees, and for each kind the score that reaches PRECISION on the third of the rows kept back."""
    rows = spark.createDataFrame(labelled(seed, n), "txt string, y int")
    own = features("")
    found = candidates(rows).select("txt", "y", F.explode("others").alias("c")).select("y", "txt", "c.*").select("y", "k", "s", "txt", *(F.expr(v).alias(k) for k, v in own.items())).orderBy("txt", "s", "k").collect()
    x = np.array([[r[f] for f in own] for r in found], float)
    y, k = np.array([r["y"] for r in found], float), np.array([r["k"] for r in found])
    kept_back = np.arange(len(y)) % 3 == 0
    fitted = trees.boost(x[~kept_back], y[~kept_back])
    score = fitted.predict(x)
    cuts = tuple(max(0.5, trees.threshold(score[kept_back & (k == i)], y[kept_back & (k == i)], PRECISION)) if (kept_back & (k == i)).any() else 2.0 for i in range(len(KINDS)))
    return fitted, cuts


def find(docs: DataFrame) -> DataFrame:
    """Add base and spans to docs (row, txt): arrays of (s, k, e), sorted: start, place of the kind in KINDS, end (exclusive), in code
    points. Other columns go.

    base has what the base rules find; spans also the candidates that the trees select and that overlap no base
    span. An empty text has none.
    """
    fitted, cuts = model(docs.sparkSession)
    df = candidates(docs.select("row", "txt"))
    base = ", ".join(f"transform({k}, x -> named_struct('s', x.s, 'k', {KINDS.index(k)}, 'e', x.e))" for k in BASE)
    df = df.withColumn("base", F.expr(f"array_sort(concat({base}))")).drop(*BASE)
    own = features("y.")
    named = ", ".join(f"'{k}', transform(array(c), y -> {v})[0]" for k, v in own.items())
    cut = "CASE z.c.k " + " ".join(f"WHEN {i} THEN {c:.6f}D" for i, c in enumerate(cuts)) + " END"
    df = df.withColumn("scored", F.expr(f"transform(others, c -> named_struct('c', c, 'f', named_struct({named})))"))
    score = fitted.sql([f"z.f.{k}" for k in own])
    chosen = f"filter(scored, z -> ({score}) >= {cut} AND NOT exists(base, b -> b.s < z.c.e AND b.e > z.c.s))"
    df = df.withColumn("spans", F.expr(f"array_sort(array_distinct(concat(base, transform({chosen}, z -> named_struct('s', z.c.s, 'k', z.c.k, 'e', z.c.e)))))"))
    return df.select("row", "txt", "base", "spans")


def _rows(docs: DataFrame, text: str) -> DataFrame:
    """(row, txt): all columns in one, so that none can clash with those made here, and the text."""
    return docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("txt"))


def joined(spans: str) -> str:
    """SQL: kind:start:end, comma-joined."""
    return f"array_join(transform({spans}, x -> concat(element_at(array({', '.join(map(repr, KINDS))}), x.k + 1), ':', x.s, ':', x.e)), ',')"


def digests(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) for each row of docs (doc_id, text). A null or empty text has no
    spans: zeros, the hash of nothing, an empty string. Rows that repeat are repeated, no rows give none, other columns don't matter."""
    df = find(_rows(docs.select("doc_id", "text"), "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.k = {i})) AS long)").alias(f"n_{k}") for i, k in enumerate(KINDS[:4])]
    return df.select("row.doc_id", *counts, F.sha2(F.expr(joined("base")).cast("binary"), 256).alias("base_sha256"), F.expr(joined("spans")).alias("spans"))


def redact(docs: DataFrame, length: str | None = "n_chars") -> DataFrame:
    """docs with each span of text replaced by its kind, overlapping spans by the first one's; the column named length
    gets the new text's length where the text changed. All rows and other columns stay, whatever they are called, repeated rows and
    those with a null or empty text as they are; no rows give none."""
    df = find(_rows(docs, "text"))
    kind = "array<struct<s: int, k: int, e: int>>"
    merge = f"aggregate(spans, cast(array() AS {kind}), (a, x) -> CASE WHEN size(a) > 0 AND element_at(a, -1).e > x.s THEN concat(slice(a, 1, size(a) - 1), array(named_struct('s', element_at(a, -1).s, 'k', element_at(a, -1).k, 'e', greatest(element_at(a, -1).e, x.e)))) ELSE concat(a, array(x)) END)"
    df = df.select("row", "txt", F.expr(merge).alias("cut"))
    names = ", ".join(f"'<{k.upper()}>'" for k in KINDS)
    pieces = f"transform(cut, (x, i) -> concat(substring(txt, CASE WHEN i = 0 THEN 1 ELSE cut[i - 1].e + 1 END, x.s - CASE WHEN i = 0 THEN 0 ELSE cut[i - 1].e END), element_at(array({names}), x.k + 1)))"
    df = df.withColumn("txt", F.expr(f"CASE WHEN size(cut) = 0 THEN txt ELSE concat(array_join({pieces}, ''), substring(txt, element_at(cut, -1).e + 1)) END"))
    out = []
    for field in docs.schema:
        old = F.col("row").getField(field.name)
        new = F.col("txt") if field.name == "text" else F.length("txt").cast(field.dataType) if field.name == length else None
        out.append((old if new is None else F.when(F.size("cut") == 0, old).otherwise(new)).alias(field.name))
    return df.select(*out)
