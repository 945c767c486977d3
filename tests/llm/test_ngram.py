"""The n-gram Jaccard join against a brute force of its own, over sizes around every bound, and the pipeline on awkward tables."""

import random

import corpus_pipeline
import pytest

from millrace.llm import ngram_join


def words_of(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        low = low.replace(c, " ")
    return [w for w in low.split(" ") if w]


def shingles(text, width):
    own = words_of(text)
    return {tuple(own[i : i + width]) for i in range(max(1, len(own) - width + 1))} if own else set()


def brute(rows, width, percent):
    sets = [shingles(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        return i if parent[i] == i else root(parent[i])

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and rows[i][0] is not None and rows[j][0] is not None and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (doc_id, _) in enumerate(rows):
        if doc_id is not None:
            least[root(i)] = min(least.get(root(i), doc_id), doc_id)
    return sorted(((d, len(sets[i]), None if d is None else least[root(i)]) for i, (d, _) in enumerate(rows)), key=str)


def made(seed):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(5000)]
    common = [r.choice(vocabulary) for _ in range(60)]
    rows = [(None, "no id"), (900, None), (901, ""), (902, "one"), (903, "ONE"), (904, "one two"), (905, "\tone\x0btwo\x0c"), (906, "x " * 9000)]
    for base in range(24):
        words = [r.choice(vocabulary) for _ in range(r.choice([4, 5, 9, 20, 38, 41, 44, 50, 53, 90, 300]))]
        if base % 3 == 0:
            words += common  # a passage that many share
        for _ in range(r.choice([2, 6, 25])):
            own = list(words)
            for _ in range(r.choice([0, 0, 1, 1, 2, 3, 5, 8])):
                k = r.randrange(len(own))
                own[k : k + r.choice([0, 1, 1, 2])] = [r.choice(vocabulary)] * r.choice([0, 1, 1])
                own = own or ["w"]
            rows.append((len(rows) + 1000, " ".join(own)))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize(("seed", "width", "percent"), [(1, 3, 90), (2, 5, 80), (3, 1, 50)])
def test_same_as_brute_force(spark, monkeypatch, seed, width, percent):
    rows = made(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = brute(rows, width, percent)
    assert sorted(map(tuple, ngram_join.jaccard_components(df, width, percent).collect()), key=str) == want
    if percent != 80:
        return
    # many chunks, buckets and groups; both sides of joins shuffled; hot labels
    for name, value in {"CHUNK": 300, "BUCKET": 500, "BLOCK_DOCS": 3, "BROADCAST_ROWS": 0, "HOT_COPIES": 1, "CACHE": 7}.items():
        monkeypatch.setattr(ngram_join, name, value)
    assert sorted(map(tuple, ngram_join.jaccard_components(df, width, percent).collect()), key=str) == want


def test_no_text_of_its_own_is_lost(spark):
    long = " ".join(f"w{i}" for i in range(100))
    near, own = long.replace("w50", "x"), "a text of its own with some words more"
    rows = [(1, long), (5, near), (5, own), (5, own), (6, own + " and others that make it another text"), (2, near), (2, long + " y"), (3, None), (3, None), (None, long)]
    df = spark.createDataFrame([(*x, "a", 1) for x in rows], "doc_id long, text string, digest_of string, class int")
    got = ngram_join.keep_representatives(df, 5, 80)
    assert got.columns == df.columns
    assert sorted(((x["doc_id"], x["text"]) for x in got.collect()), key=str) == sorted([(1, long), (5, own), (6, rows[4][1]), (3, None), (None, long)], key=str)
    twice = spark.createDataFrame([(4, long), (4, near), (9, near + " z")], "doc_id long, text string")
    assert len(ngram_join.keep_representatives(twice, 5, 80).collect()) == 1


def test_pipeline_takes_awkward_tables(spark, tmp_path):
    bench = spark.createDataFrame([(1, "this sentence of a benchmark has more than thirteen words and so it counts as one"), (None, None), (2, "")], "item_id long, text string")
    bench.write.parquet(f"{tmp_path}/a/benchmark.parquet")
    bench.limit(0).write.parquet(f"{tmp_path}/b/benchmark.parquet")
    rows = [(1, None), (2, ""), (3, "12 !?"), (4, "x"), (4, "x"), (None, "no id here"), (5, "word " * 30_000), (6, "mail a@b.cd now please"), (6, "mail a@b.cd now please"), (7, "It says this sentence of a benchmark has more than thirteen words and so it counts as one.")]
    names = "doc_id long, text string, lang string, source string, n_chars long, kept int, row int, email_m int, class int, `a.b` int"
    df = spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, 2, 3, 4, 5) for i, t in rows], names)
    df.write.parquet(f"{tmp_path}/a/documents.parquet")
    df.limit(0).write.parquet(f"{tmp_path}/b/documents.parquet")
    kept = spark.read.parquet(f"{tmp_path}/a/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, f"{tmp_path}/a")
        assert out.columns == df.columns, name
        kept = ngram_join.materialise(out)
    assert sorted(((x["doc_id"], x["text"]) for x in kept.collect()), key=str) == sorted([(None, "no id here"), (4, "x"), (5, "word " * 30_000), (6, "mail <EMAIL> now please")], key=str)
    assert corpus_pipeline.run(spark, f"{tmp_path}/a").count() == 4 and corpus_pipeline.run(spark, f"{tmp_path}/b").count() == 0
