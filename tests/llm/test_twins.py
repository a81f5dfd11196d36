"""Every registered query of the subpackage that has a SQL twin gives the twin's rows."""

import os

import duckdb
import pytest

from vigil.llm import queries
from vigil.llm.oracles import ORACLES


@pytest.fixture(scope="module")
def con(sf):
    c = duckdb.connect()
    for file in os.listdir(sf):
        c.execute(f"CREATE VIEW {file.split('.')[0]} AS SELECT * FROM '{sf}/{file}'")
    return c


def plain(value):
    return round(value, 6) if isinstance(value, float) else value


@pytest.mark.parametrize("name", sorted(set(ORACLES) & set(queries.QUERIES)))
def test_twin(spark, sf, con, name):
    found = queries.QUERIES[name](spark, sf)
    twin = con.execute(ORACLES[name])
    names = [d[0] for d in twin.description]
    assert sorted(names) == sorted(found.columns)
    want = [tuple(map(plain, row)) for row in twin.fetchall()]
    got = [tuple(plain(r[n]) for n in names) for r in found.collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr) and got
