import pytest

import __spark_entry__ as entry
from constella import queries

NAMES = [n for n in queries.QUERIES if not n.startswith("grouped_") or n in ("grouped_q_2_1", "grouped_q_4_2")]


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, small, oracle, answer, name):
    assert name in queries.SQL
    assert answer(queries.QUERIES[name](spark, small)) == oracle(queries.SQL[name])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def test_names_are_registered():
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert set(queries.QUERIES) <= set(entry.queries())
