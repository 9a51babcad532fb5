"""The queries that SQL can express equal their SQL."""

import pytest

from metergrid.llm.oracle import oracle_sql
from metergrid.llm.queries import queries
from tests.llm.test_search import _duck


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, sf_dir, name):
    found = queries()[name](spark, sf_dir)
    columns = sorted(found.columns)
    con = _duck(sf_dir)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted((tuple(r[c] for c in columns) for r in found.collect()), key=repr) == sorted(want, key=repr)
