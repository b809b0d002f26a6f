"""Registered queries of the training-data operators against their oracle SQL."""

import math

import duckdb
import pytest

from comanda.llm.oracle import ORACLE_SQL
from comanda.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def plain(rows, columns):
    at = [columns.index(c) for c in sorted(columns)]
    value = lambda v: None if v is None or isinstance(v, float) and math.isnan(v) else round(v, 4) if isinstance(v, float) else v
    return sorted((tuple(value(r[k]) for k in at) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_oracle(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "pages", "embeddings"):
        duck.execute(f"create view {t} as select * from '{FOLDER}/{t}.parquet'")
    want = duck.execute(ORACLE_SQL[name])
    columns = [d[0] for d in want.description]
    got = QUERIES[name](spark, FOLDER)
    assert sorted(got.columns) == sorted(columns)
    assert plain(got.collect(), got.columns) == plain(want.fetchall(), columns)
