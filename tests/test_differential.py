"""Every registered query against its SQL, run by another engine on the same tables."""

import math
import os
from datetime import date, datetime

import duckdb
import pytest

from folioquery import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def sql():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def shown(v):
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return str(v) if isinstance(v, (date, datetime)) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, sql, name):
    if not os.path.isdir(SF):
        pytest.skip("no test data here")
    out = registry.queries()[name](spark, SF)
    columns = sorted(out.columns)
    rows = [tuple(shown(r[c]) for c in columns) for r in out.collect()]
    got = sql.execute(registry.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == columns
    want = [tuple(shown(r[names.index(c)]) for c in columns) for r in got.fetchall()]
    assert sorted(rows, key=repr) == sorted(want, key=repr)


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
