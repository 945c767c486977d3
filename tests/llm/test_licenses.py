"""The method's own part of license scans against brute force: weights, postings, votes by place, phrases."""

import math
import random
import re

from millrace.llm import licenses
from tests.conftest import DATA
from tests.llm.test_operators import base_licenses


def words_of(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute(texts):
    """{id: (labels, score)}: every template at every place."""
    words = {i: words_of(t) for i, t in texts}
    held = {i: set(w) for i, w in words.items()}
    idf = {w: math.log((1 + len(texts)) / (1 + sum(w in h for h in held.values()))) + 0.001 for _, t, _ in licenses.TEMPLATES for w in t.split()}
    out = {}
    for i, own in words.items():
        base = [x for x in base_licenses(dict(texts)[i])[4].split(",") if x]
        labels, score = set(base), 0.0
        for label, text, phrase in licenses.TEMPLATES:
            parts, key = text.split(), phrase.split()
            rare = sorted(dict.fromkeys(parts), key=lambda w: -idf[w])[: licenses.RARE]
            total = sum(idf[w] for w in rare)
            at = next(q for q in range(len(parts)) if parts[q : q + len(key)] == key)
            for begin in range(-len(parts), len(own)):
                s = sum(idf[w] for w in rare if 0 <= begin + parts.index(w) < len(own) and own[begin + parts.index(w)] == w)
                if s / total >= licenses.SHARE - 1e-12 and begin + at >= 0 and own[begin + at : begin + at + len(key)] == key:
                    labels.add(label)
                    score = max(score, min(1.0, s / total))
        out[i] = (",".join(sorted(labels)), score if score or not base else 1.0)
    return out


def cases(spark):
    r = random.Random(3)
    texts = [(0, None), (1, ""), (2, "mit license " * 300), (3, "MIT License. apache license")]
    for k, (_, text, _) in enumerate(licenses.TEMPLATES):
        own = text.split()
        texts.append((100 + k, "Some code here. " + text.title() + ". And more of it."))
        changed = [w if r.random() > 0.1 else "other" for w in own]
        texts.append((200 + k, "x " * r.randint(0, 3) + " ".join(changed)))
        texts.append((300 + k, " ".join(own[r.randint(0, 3) :][: max(4, len(own) // 2)])))
        mixed = list(own)
        r.shuffle(mixed)
        texts.append((400 + k, " ".join(mixed)))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    return texts + [(1000 + x["doc_id"], x["text"]) for x in docs if len(x["text"] or "") < 4000][:80]


def test_labels_and_scores_are_those_of_brute_force(spark):
    texts = cases(spark)
    want = brute(texts)
    got = {r["doc_id"]: (r["labels"], r["score"]) for r in licenses.scan(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert {i: x[0] for i, x in got.items()} == {i: x[0] for i, x in want.items()}
    assert {i: round(x[1], 9) for i, x in got.items()} == {i: round(x[1], 9) for i, x in want.items()}
    # whole texts are found, in any case and with words around them; words in another order are not
    assert [(k, got[100 + k]) for k in range(len(licenses.TEMPLATES)) if licenses.TEMPLATES[k][0] not in got[100 + k][0].split(",")] == []
    assert sum(licenses.TEMPLATES[k][0] in got[400 + k][0].split(",") for k in range(len(licenses.TEMPLATES))) <= 2


def test_empty_and_clashing_tables(spark):
    df = spark.createDataFrame([(1, "Licensed under CC BY-SA 4.0", "x", 1), (1, "Licensed under CC BY-SA 4.0", "x", 1), (None, None, "x", 1)], "doc_id long, text string, norm string, word int")
    assert sorted((r["labels"], r["n_words"]) for r in licenses.scan(df).collect()) == [("", 0), ("cc-by-sa", 7), ("cc-by-sa", 7)]
    assert licenses.scan(df.limit(0)).count() == 0
