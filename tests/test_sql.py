import math
import os

import duckdb
import pytest

from webgauge.plans import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def shown(value):
    return ("nan" if math.isnan(value) else f"{value:.6g}") if isinstance(value, float) else str(value)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_its_sql(spark, tiny, name):
    con = duckdb.connect()
    for t in TABLES:
        if os.path.exists(f"{tiny}/{t}.parquet"):
            con.sql(f"create view {t} as select * from '{tiny}/{t}.parquet'")
    df = queries.QUERIES[name](spark, tiny)
    columns = sorted(df.columns)
    rows = con.sql(queries.SQL[name])
    assert sorted(d[0] for d in rows.description) == columns
    order = [[d[0] for d in rows.description].index(c) for c in columns]
    want = sorted(tuple(shown(r[k]) for k in order) for r in rows.fetchall())
    assert sorted(tuple(shown(r[c]) for c in columns) for r in df.collect()) == want
