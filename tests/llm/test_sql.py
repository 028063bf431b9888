import math
import os

import duckdb
import pytest

from webgauge.llm import registry

TABLES = "documents embeddings pages benchmark labels conversations".split()
SQL = registry.oracle_sql()


def shown(value):
    return ("nan" if math.isnan(value) else f"{value:.6g}") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{tiny}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = registry.queries()[name](spark, tiny)
    columns = sorted(df.columns)
    rows = con.sql(SQL[name])
    names = [d[0] for d in rows.description]
    assert sorted(names) == columns
    want = sorted(tuple(shown(r[names.index(c)]) for c in columns) for r in rows.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want
