"""Plans of the corpus operators: what is native stays native, nothing is joined by all pairs, scratch tables go."""

import os

import pytest

from millrace.llm import components, licenses, ngram_join, pii, secrets
from millrace.llm.common import Scratch, scratch_root
from tests.conftest import DATA


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("run", [pii.digests, pii.redact, secrets.scan, licenses.scan])
def test_native_operators_run_no_python(spark, run):
    shown = plan(run(spark.read.parquet(f"{DATA}/documents.parquet")))
    assert not any(word in shown for word in ("Python", "MapInArrow", "MapInPandas", "ArrowEval", "Scan ExistingRDD"))


def test_scratch_tables_are_deleted(spark):
    root = f"{scratch_root(spark)}/millrace".removeprefix("file://")
    with Scratch(spark) as scratch:
        own = scratch.write(spark.range(3).toDF("u"))
        assert own.count() == 3 and os.listdir(root)
        place = scratch.paths[0].removeprefix("file://")
        assert os.path.exists(place)
    assert not os.path.exists(place)


def test_components_keep_only_their_last_round(spark):
    with Scratch(spark) as scratch:
        found = components.components(spark.createDataFrame([(i, i + 1) for i in range(50)], "u long, v long"), scratch=scratch)
        assert found.count() == 51 and len(scratch.paths) == 1


def test_a_large_group_of_near_copies_makes_few_queries(spark, monkeypatch):
    """Copies with edits of their own: nothing is compared again across blocks once it's connected."""
    monkeypatch.setattr(ngram_join, "BLOCK_DOCS", 40)
    words = [f"w{i}" for i in range(200)]
    rows = [(k, " ".join("x" if i == k % 200 else w for i, w in enumerate(words))) for k in range(400)]
    seen = []
    write = Scratch.write

    def counted(self, df):
        out = write(self, df)
        if set(df.columns) == {"class", "n", "group"}:
            seen.append(out.count())
        return out

    monkeypatch.setattr(Scratch, "write", counted)
    got = ngram_join.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()
    assert {r["component_id"] for r in got} == {0} and seen == [0]


def test_scratch_needs_a_shared_folder_on_a_cluster():
    class Cluster:
        class conf:
            get = staticmethod(lambda key, default=None: default)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_root(Cluster())
