"""Chat roles and secrets: accuracy on what wasn't trained on, and independent renditions of paths and candidates."""

import random
import re

import numpy as np
from pyspark.sql import functions as F

from millrace.llm import chat, secrets
from tests.conftest import DATA

LARGE = DATA.replace("sf0.001", "sf0.1")


def test_roles_of_held_out_conversations(spark):
    got = chat.recover(spark.read.parquet(f"{LARGE}/conversations.parquet")).filter("held_out").groupBy("role").agg(F.count("*").alias("n"), F.sum((F.col("role") == F.col("role_pred")).cast("int")).alias("right")).collect()
    share = {r["role"]: r["right"] / r["n"] for r in got}
    assert set(share) == set(chat.ROLES) and min(share.values()) > 0.93 and sum(r["n"] for r in got) > 1000, share


def best_path(model, observed):
    """Viterbi in plain Python: every state's best score and path, step by step."""
    paths = {s: (float(model.start[s] + observed[0][s]), (s,)) for s in range(chat.STATES)}
    for e in observed[1:]:
        paths = {s: max((score + float(model.step[path[-1], s]) + float(e[s]), path + (s,)) for score, path in paths.values()) for s in range(chat.STATES)}
    return max(paths.values())


def test_paths_of_long_conversations(spark):
    r = random.Random(2)
    turns = spark.read.parquet(f"{DATA}/conversations.parquet").collect()
    one = [(1, i, x["role"], x["text"]) for i, x in enumerate(turns)]  # one conversation over all partitions
    rows = one + [(2, 0, "user", "word " * 100_000), (2, 1, "assistant", "a\n" * 300), (2, 1, "assistant", "a\n" * 300), (None, 0, None, None), (3, 0, "user", "")]
    r.shuffle(rows)
    df = spark.createDataFrame([(*x, 1, "y") for x in rows], "conv_id long, turn long, role string, text string, part int, states string").repartition(4)
    model = chat.train(chat.ordered(spark.read.parquet(f"{DATA}/conversations.parquet")))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = {(x["conv_id"], x["turn"]): x["role_pred"] for x in chat.recover(df, model).collect()}
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    observed, firsts = [], []
    for x in sorted(one, key=lambda x: x[1]):
        own = chat.lines(x[3])
        firsts.append(len(observed))
        observed += [model.emission(line, i == 0, len(own), len(x[3])) for i, line in enumerate(own)]
    score, path = best_path(model, observed)
    found = [got[1, x[1]] for x in one]
    assert found == [chat.ROLES[path[i] // 2] for i in firsts] and np.isfinite(score)
    assert len(got) == len(one) + 4


# secrets


def brute_candidates(text):
    out = []
    for rule, (pattern, _) in secrets.PATTERNS.items():
        found = [(rule, m.start(), m.end(), m[0]) for m in re.finditer(pattern, text or "", re.ASCII)]
        out += [c for c in found if not any(c[1] < e and s < c[2] for _, s, e, _ in out)]
    return sorted(out)


def test_candidates_are_those_of_brute_force(spark):
    r = random.Random(7)
    pool = ["token", "password = ", "api_key: '", "secret=", "AKIA", "ghp_", "sk-", "=", ":", "'", '"', " ", "\n", "é", "😀", "a1B2c3D4e5F6", "ABCDEFGHIJKLMNOPQRSTUVWXYZ012345", "/usr/lib/", "deadbeef" * 5, ";", "<", "-", "_"]
    texts = [(i, "".join(r.choice(pool) for _ in range(r.randint(0, 14)))) for i in range(1500)] + [(9000, None), (9001, ""), (9002, "token=" + "x1" * 30_000), (9003, "a1" * 30_000), (9004, "secret = abcdefgh1 " * 700)]
    df = spark.createDataFrame([(i, t or "", "p") for i, t in texts], "doc_id long, txt string, path string")
    got = {}
    for c in secrets.candidates(df).collect():
        got.setdefault(c["doc_id"], []).append((c["rule"], c["s"], c["e"], c["t"]))
    assert {i: sorted(c) for i, c in got.items()} == {i: c for i, t in texts if (c := brute_candidates(t))}


def test_unseen_findings(spark):
    rows = [(i, *x) for i, x in enumerate(secrets.labelled(77, 2000))]
    assert not {x[1] for x in rows if len(x[1]) > 40} & {x[0] for x in secrets.labelled()}
    df = spark.createDataFrame([x[:3] for x in rows], "doc_id long, text string, source string")
    found = {x["doc_id"] for x in secrets.scan(df).collect()}
    true, false = [x[0] for x in rows if x[3]], [x[0] for x in rows if not x[3]]
    caught, wrong = sum(i in found for i in true) / len(true), sum(i in found for i in false) / len(false)
    print(caught, wrong)
    assert caught > 0.95 and wrong < 0.03
    assert secrets.scan(df.limit(0)).count() == 0
    planted = spark.read.parquet(f"{DATA}/documents.parquet").filter(r"text RLIKE 'token = \"[0-9a-f]{40}\"'")
    assert {x["doc_id"] for x in planted.collect()} <= {x["doc_id"] for x in secrets.scan(planted).collect()}
