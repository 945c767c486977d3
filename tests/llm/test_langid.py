"""Language identification: what training takes, and texts of no learned language."""

import corpus_pipeline
import numpy as np
import pytest

from millrace.llm import langid
from tests.conftest import DATA

FOREIGN = ["в этом городе живут мои друзья и родные люди", "漢字で書かれた文章はここにあります日本語です", "zxqj kkkv wwq ppz vvkx qqzj xkcd wqpz", "ლაშა და მისი მეგობარი სახლში არიან დღეს"]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{DATA}/documents.parquet")


def test_the_model_decides_what_the_stage_keeps(spark, docs):
    own = docs.select("doc_id", "text", "lang").unionByName(spark.createDataFrame([(10_000 + i, t, None) for i, t in enumerate(FOREIGN)], "doc_id long, text string, lang string"))
    kept = {r["doc_id"] for r in corpus_pipeline.language(spark, own, DATA).collect()}
    assert not {i for i in kept if i >= 10_000}
    assert len(kept) == docs.filter(r"text RLIKE '\\p{L}'").count()
    model = langid.train(docs)
    some = langid.keep_identified(docs, model, {"de", "fr"}).collect()
    assert some and all(model.predict(r["text"])[0] in ("de", "fr") for r in some)


def test_many_languages_and_texts_without_letters(spark):
    rows = [(i, "123 456 !", "xx") for i in range(2000)] + [(3000 + i, f"wort haus baum nummer {i}", "xx") for i in range(5)] + [(4000 + i, f"mot maison arbre le {i}", f"l{i}") for i in range(300)] + [(3000, "wort haus baum nummer 0", "xx")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_language=3)
    learned = {f"l{i}" for i in range(300) if __import__("zlib").crc32(str(4000 + i).encode()) % 4 != 2}
    assert set(model.languages) == learned | {"xx"}


def test_total_bounds_the_sample(spark, monkeypatch):
    monkeypatch.setattr(langid, "TOTAL_ROWS", 4)
    rows = [(i, f"abc def {i}", "aa" if i % 2 else "bb") for i in range(400)]
    taken = []
    monkeypatch.setattr(langid, "fit_svm", lambda x, y, **k: taken.append(len(x)) or np.zeros(langid.DIM + 1))
    langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert max(taken) == 4


def test_awkward_tables_pass_the_stage(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (2, "", "en", 1), (None, "ü" * 40, "en", 2), (4, "ü" * 30_000, "de", 3), (4, "ü" * 30_000, "de", 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, kept int")
    got = corpus_pipeline.language(spark, df, DATA)
    assert got.columns == df.columns and sorted((r["doc_id"] or 0) for r in got.collect()) == [0, 4, 4]
    assert corpus_pipeline.language(spark, df.limit(0), DATA).count() == 0
