"""Every query against its SQL, over the whole tables of the smallest scale."""

import importlib
import sys

import pytest

import __spark_entry__ as entry
from oracle_check import compare, oracle
from threadlake.plans.oracle import ORACLE
from threadlake.plans.queries import QUERIES


@pytest.fixture(scope="module")
def con(small):
    return oracle(small)


def test_every_query_has_sql():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(entry.queries()) and set(ORACLE) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, small, name):
    assert compare(spark, con, name, small) == ""


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("missing", ["threadlake.llm.registry", "threadlake.llm", "corpus_pipeline"])
def test_works_without_the_training_data_operators(monkeypatch, missing):
    for name in [m for m in sys.modules if m.startswith("threadlake.llm") or m == "corpus_pipeline"]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.setitem(sys.modules, missing, None)
    try:
        alone = importlib.reload(entry)
        assert alone.queries() == QUERIES and alone.oracle_sql() == ORACLE
    finally:
        monkeypatch.undo()
        importlib.reload(entry)
