"""Every registered query outside llm against its DuckDB SQL on the smallest tables."""

import glob
import math
import os

import duckdb
import pytest
from conftest import SMALL

from octofold.jobs import registry


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(rows, order):
    def value(v):
        return round(v, 9) + 0.0 if isinstance(v, float) and not math.isnan(v) else v

    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_sql(spark, duck, name):
    df = registry.queries()[name](spark, SMALL)
    got = [tuple(r) for r in df.collect()]
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert got
        return
    want = duck.execute(sql)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(df.columns)
    cols = sorted(names)
    assert plain(got, [df.columns.index(c) for c in cols]) == plain(want.fetchall(), [names.index(c) for c in cols])


def test_entry_counts_voxels(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(registry.oracle_sql()) <= set(registry.queries())
