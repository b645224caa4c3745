"""Every registered query against its DuckDB oracle, and the derived relations."""

import pytest

import __spark_entry__ as E
from conftest import SMALL
from disputelens.oracle.compare import compare
from disputelens.oracle.fixtures_sql import with_relations
from disputelens.oracle.queries_sql import oracle_sql
from disputelens.plans.registry import queries
from disputelens.sources.fixtures import RELATIONS, Fixtures, relation

KEYS = sorted(queries())


def test_every_query_has_an_oracle():
    assert set(KEYS) == set(oracle_sql())
    assert set(KEYS) <= set(E.queries())
    assert len(KEYS) >= 60


@pytest.mark.parametrize("key", KEYS)
def test_query_matches_oracle(spark, duck_small, key):
    df = E.queries()[key](spark, SMALL)
    ok, msg = compare(df, duck_small, E.oracle_sql()[key])
    assert ok, msg


@pytest.mark.parametrize("name", RELATIONS)
def test_relation_matches_sql_twin(spark, duck_small, name):
    fx = Fixtures(spark, SMALL, reuse_base=False)
    ok, msg = compare(relation(fx, name), duck_small, with_relations(f"SELECT * FROM {name}", [name]))
    assert ok, msg


def test_entry_runs(spark):
    from disputelens.plans.dispute_wow import SUMMARY_KEYS

    df = E.entry(spark)
    rows = df.collect()
    assert df.columns == [*SUMMARY_KEYS, "settled_amt_sum", "dispute_amt_sum"]
    assert len(rows) == 45
