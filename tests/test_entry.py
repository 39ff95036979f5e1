import duckdb
import pytest

import __spark_entry__
from sedge.plans import registry
from sedge.plans.tables import NAMES

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for n in NAMES:
        c.sql(f"CREATE VIEW {n} AS SELECT * FROM '{SMALL}/{n}.parquet'")
    return c


def plain(rows):
    def one(v):
        return round(v, 6) if isinstance(v, float) else v.replace(tzinfo=None).isoformat() if hasattr(v, "isoformat") else int(v) if isinstance(v, bool) else v

    return sorted((tuple(one(v) for v in r) for r in rows), key=str)


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_the_oracle(spark, duck, name):
    got = registry.queries()[name](spark, SMALL)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    order = [want.columns.index(c) for c in got.columns]
    assert plain(map(tuple, got.collect())) == plain(tuple(r[i] for i in order) for r in want.fetchall())


def test_without_the_training_data_operators(monkeypatch):
    """Their folders may be deleted, with the pipeline's file left or not."""
    import importlib.util
    import sys

    found = importlib.util.find_spec
    for gone in ({"sedge.llm"}, {"sedge.llm", "corpus_pipeline"}):
        monkeypatch.setattr(importlib.util, "find_spec", lambda n, *a, gone=gone: None if n in gone else found(n, *a))
        for n in [m for m in sys.modules if m.startswith("sedge.llm") or m == "corpus_pipeline"]:
            monkeypatch.setitem(sys.modules, n, None)
        assert set(__spark_entry__.queries()) == set(registry.queries()) and set(__spark_entry__.oracle_sql()) == set(registry.oracle_sql())
