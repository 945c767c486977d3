"""Every query that has SQL gives the same rows as DuckDB."""

import pytest

import __spark_entry__ as entry
from tests.conftest import DATA


def shown(v):
    return repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_same_rows(spark, duck, name):
    got = entry.queries()[name](spark, DATA)
    columns = sorted(got.columns)
    expected = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in expected.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in expected.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in got.collect()) == want


@pytest.mark.parametrize("name", ["event_sample", "dt_train_predict"])
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, DATA).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 5
