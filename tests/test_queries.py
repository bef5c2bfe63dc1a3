import duckdb
import pytest

import __spark_entry__ as entry
from quillspark.queries import ORACLES, QUERIES


def rows(names, data):
    at = sorted(range(len(names)), key=names.__getitem__)
    value = lambda v: None if v is None or v != v else round(v, 6) if isinstance(v, float) else v
    return [names[i] for i in at], sorted((tuple(value(r[i]) for i in at) for r in data), key=str)


@pytest.mark.parametrize("name", list(ORACLES))
def test_sql_agrees(spark, name):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "conversations", "customer", "events", "pages", "labels", "benchmark"):
        con.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    df, sql = QUERIES[name](spark, sf), con.execute(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows([d[0] for d in sql.description], sql.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())
