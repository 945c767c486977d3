"""Secret scanning: patterns propose candidates, a random forest removes false positives.

The forest sees a candidate's length, its character transitions, how much of it dictionary words cover, the file's path and the
neighbouring words. It is fitted to labelled findings that labelled() makes from a seed, with the features that the
same SQL gives for them, and becomes a SQL expression; the whole scan is SQL functions.
"""

from __future__ import annotations

import functools
import hashlib
import random

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import trees
from millrace.llm.spans import with_spans

#: Patterns of candidates, and a cheap condition on a text txt without which there is none.
PATTERNS = {
    "assigned": (r"(?i)(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth|credential)s?[\x22']?+\s?+(?:=|:|:=|=>)\s?+[\x22']?+[^\s\x22'<>;,]{8,}+", "txt RLIKE '[=:]'"),
    "prefixed": (r"(?<![A-Za-z0-9])(?:AKIA|ASIA|ghp_|gho_|glpat-|sk-|sk_live_|xox[abp]-|AIza)[A-Za-z0-9_-]{12,}+", "txt RLIKE 'AKIA|ASIA|gh[po]_|glpat-|sk[-_]|xox|AIza'"),
    "random": (r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-]{24,}+={0,2}+(?![A-Za-z0-9+/_=-])", "txt RLIKE '[0-9]' AND txt RLIKE '[A-Za-z0-9+/_-]{24}'"),
}
#: Words that a secret made at random doesn't hold.
DICTIONARY = "the and for with that this example test sample token secret password user name admin value default change your here null none true false data file path http https www com org net html index image class style color button function return import version release build commit branch module package request response server client error message content header footer container element"
FEATURES = {
    "length": "cast(length(v) AS double)",
    "digits": "cast(regexp_count(v, '[0-9]') AS double) / greatest(1, length(v))",
    "upper": "cast(regexp_count(v, '[A-Z]') AS double) / greatest(1, length(v))",
    "transitions": "cast(regexp_count(v, '(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])') AS double) / greatest(1, length(v))",
    "vowels": "cast(regexp_count(v, '(?i)[aeiou]') AS double) / greatest(1, length(v))",
    "covered": f"1D - cast(length(regexp_replace(v, '(?i)({'|'.join(sorted(set(DICTIONARY.split()), key=lambda w: (-len(w), w)))})', '')) AS double) / greatest(1, length(v))",
    "distinct": "cast(size(array_distinct(split(v, ''))) AS double)",
    "hex": "cast(v RLIKE '^(?i)[0-9a-f]+$' AS double)",
    "uuid": "cast(v RLIKE '^(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$' AS double)",
    "place": "cast(v RLIKE '(?i)^[$%{(]|[})]$|x{5}|\\\\*{4}|1234|your|example|changeme' AS double)",
    "key_word": "cast(concat(before, t) RLIKE '(?i)(token|secret|passw|pwd|api[_-]?key|access[_-]?key|credential|auth)' AS double)",
    "hash_word": "cast(before RLIKE '(?i)(commit|sha1|sha256|md5|checksum|digest|hash|integrity|revision|etag|uuid|guid)[^a-z]*([a-z]+[^a-z]+)?$' AS double)",
    "path_test": "cast(coalesce(path, '') RLIKE '(?i)(test|example|sample|mock|fixture|doc)' AS double)",
    "path_conf": "cast(coalesce(path, '') RLIKE '(?i)(conf|env|secret|deploy|cred|settings)' AS double)",
    "prefixed": "cast(rule = 'prefixed' AS double)",
    "assigned": "cast(rule = 'assigned' AS double)",
}
SEED, SAMPLES, PRECISION = 5, 3600, 0.98


def candidates(files: DataFrame) -> DataFrame:
    """A row (rule, s, e, t, v, before) for each candidate of files (txt, path and others): v is the value without its name. Matches of
    one rule don't overlap; a match that overlaps one of an earlier rule goes."""
    df = with_spans(files, "txt", PATTERNS)
    earlier: list[str] = []
    parts = []
    for rule in PATTERNS:
        inside = " OR ".join(f"exists({r}, y -> y.s < x.e AND y.e > x.s)" for r in earlier) or "false"
        parts.append(f"transform(filter({rule}, x -> NOT ({inside})), x -> named_struct('rule', '{rule}', 's', x.s, 'e', x.e, 't', x.t, 'before', substring(txt, greatest(1, x.s - 39), least(x.s, 40))))")
        earlier.append(rule)
    keep = [c for c in files.columns if c != "txt"]
    df = df.select(*keep, F.explode(F.expr(f"concat({', '.join(parts)})")).alias("c")).select(*keep, "c.*")
    value = F.expr("CASE WHEN rule = 'assigned' THEN regexp_extract(t, r\"(?i)(?:=>|:=|=|:)\\s?['\\x22]?([^\\s'\\x22<>;,]+)$\", 1) ELSE t END")
    return df.withColumn("v", value)


def labelled(seed: int = SEED, n: int = SAMPLES) -> list[tuple[str, str, int]]:
    """(text, path, whether its candidate is a secret)."""
    r = random.Random(seed)
    words = DICTIONARY.split()

    def chars(alphabet: str, k: int) -> str:
        return "".join(r.choice(alphabet) for _ in range(k))

    hexa, mixed = "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    key = ["token", "password", "secret", "api_key", "apikey", "access_key", "auth"]
    assign = ["{} = \"{}\"", "{}={}", "{}: {}", "{}: '{}'", "{} := \"{}\""]
    true = [
        lambda: r.choice(assign).format(r.choice(key), chars(hexa, r.choice([18, 32, 40, 64]))),
        lambda: r.choice(assign).format(r.choice(key), chars(mixed, r.randint(12, 48))),
        lambda: r.choice(["AKIA", "ghp_", "sk_live_", "AIza"]) + chars(mixed, r.randint(16, 36)),
        lambda: f"{r.choice(['secret', 'token', 'credential'])} {chars(mixed, r.randint(28, 60))}",
        lambda: f"auth: eyJ{chars(mixed, r.randint(20, 40))}.{chars(mixed, r.randint(30, 80))}.{chars(mixed, 43)}",
    ]
    false = [
        lambda: r.choice(assign).format(r.choice(key), r.choice(["changeme1234", "your-token-here", "${SECRET_VALUE}", "xxxxxxxxxxxx", "********", "example_password", "<your_api_key>"])),
        lambda: r.choice(assign).format(r.choice(key), "_".join(r.choice(words) for _ in range(r.randint(2, 4)))),
        lambda: f"{r.choice(['commit', 'sha1', 'sha256', 'md5', 'checksum', 'integrity'])} {chars(hexa, r.choice([32, 40, 64]))}",
        lambda: f"{r.choice(['id', 'uuid', 'request'])} {chars(hexa, 8)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 4)}-{chars(hexa, 12)}",
        lambda: "/".join(r.choice(words) for _ in range(5)) + f"/v{r.randint(1, 9)}_{r.choice(words)}",
        lambda: "-".join(r.choice(words) for _ in range(6)) + str(r.randint(1, 99)),
        lambda: chars("0123456789", r.randint(24, 40)),
        lambda: f"{r.choice(key)}_path = /{'/'.join(r.choice(words) for _ in range(r.randint(2, 5)))}",
        lambda: f"{r.choice(key)}s: {r.choice(words)}.{r.choice(words)}_{r.choice(words)}()",
        lambda: f"{r.choice(key)} of {r.choice(words)} in {r.choice(['commit', 'revision', 'digest'])} {chars(hexa, 40)}",
        lambda: f"{r.choice(['integrity', 'checksum'])} sha512-{chars(mixed, 86)}==",
    ]
    out = []
    for _ in range(n):
        good = r.random() < 0.5
        path = r.choice(["src/app.py", "config/prod.env", "deploy/secret.yml", "lib/core.js", "src7"] if good or r.random() < 0.5 else ["tests/test_a.py", "docs/example.md", "src/app.py", "src12"])
        out.append((f"{r.choice(words)} {r.choice(words)} {r.choice(true if good else false)()} {r.choice(words)}", path, int(good)))
    return out


@functools.lru_cache(maxsize=2)
def model(spark: SparkSession, seed: int = SEED, n: int = SAMPLES) -> tuple[trees.Ensemble, float]:
    """The forest, and the score that reaches PRECISION on the third of the findings kept back."""
    rows = spark.createDataFrame(labelled(seed, n), "txt string, path string, y int")
    found = candidates(rows).select("y", "s", "t", "path", *(F.expr(v).alias(k) for k, v in FEATURES.items())).orderBy("t", "path", "s").collect()
    x, y = np.array([[r[f] for f in FEATURES] for r in found], float), np.array([r["y"] for r in found], float)
    back = np.arange(len(y)) % 3 == 0
    fitted = trees.forest(x[~back], y[~back])
    return fitted, max(0.5, trees.threshold(fitted.predict(x)[back], y[back], PRECISION))


def scan(files: DataFrame, key: str = "doc_id", text: str = "text", path: str = "source") -> DataFrame:
    """(doc_id, rule, start, end, value_sha256, score) for each finding in files: code points, end exclusive; the
    secret itself isn't repeated. Findings of a text don't overlap (see candidates()). A null or empty text has none; a null path is an
    empty one; values may be of any length; repeated rows give repeated findings; no rows give none; other columns don't matter."""
    fitted, cut = model(files.sparkSession)
    own = files.select(F.col(key).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("txt"), F.col(path).cast("string").alias("path"))
    features = F.struct(*(F.expr(v).alias(k) for k, v in FEATURES.items())).alias("f")
    df = candidates(own).select("doc_id", "rule", F.col("s").alias("start"), F.col("e").alias("end"), F.sha2(F.col("v").cast("binary"), 256).alias("value_sha256"), features)
    # in a lambda the forest is evaluated as a tree of expressions; as generated code it would outgrow a method
    score = F.expr(f"transform(array(f), f -> {fitted.sql([f'f.{k}' for k in FEATURES])})[0]")
    return df.withColumn("score", score).filter(F.col("score") >= cut).select("doc_id", "rule", "start", "end", "value_sha256", "score")


def value_hash(value: str) -> str:
    """What scan() gives for a value, to look one up."""
    return hashlib.sha256(value.encode()).hexdigest()
