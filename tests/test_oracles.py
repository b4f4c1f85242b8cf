"""Every query of the catalogue against DuckDB on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from quillmill.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(value):
    if isinstance(value, (float, decimal.Decimal)):
        return round(float(value), 6)
    return value.isoformat() if isinstance(value, (datetime.date, datetime.datetime)) else value


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_oracle(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    cursor = duck.execute(catalogue.ORACLES[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in cursor.fetchall()), key=str)


def test_lda_invariants(spark):
    scores = catalogue.lda_topics(spark, SF)
    rows = scores.groupBy("doc_id").agg({"probability": "sum", "is_dominant": "max", "topic_id": "count"}).collect()
    assert rows
    for r in rows:
        assert abs(r["sum(probability)"] - 1) < 1e-6 and r["max(is_dominant)"] and r["count(topic_id)"] == 4


def test_entry(spark):
    import __spark_entry__

    rows = {r["filter"]: r for r in __spark_entry__.entry(spark).collect()}
    assert set(rows) == {"energy", "marked", "rated", "final_status"}
    assert len({r["included"] + r["excluded"] + r["unavailable"] for r in rows.values()}) == 1
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
