"""Every registered query of the engine against DuckDB on the smallest driver tables."""

import os

import duckdb
import pytest

from corpusloom import life_queries, queries, table_queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
DIR = os.environ.get("QUERY_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for t in TABLES:
        connection.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    return connection


def plain(rows, names):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(repr([round(r[i], 9) if isinstance(r[i], float) else r[i] for i in order]) for r in rows)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    assert table_queries.register is life_queries.register is queries.register
    df = queries.QUERIES[name](spark, DIR)
    rows = [tuple(r) for r in df.collect()]
    if name not in queries.ORACLE_SQL:
        assert rows
        return
    found = duck.sql(queries.ORACLE_SQL[name])
    assert sorted(found.columns) == sorted(df.columns)
    assert plain(rows, df.columns) == plain(found.fetchall(), found.columns)


def test_partitions_do_not_matter(spark):
    name = "history_collapse"
    results = set()
    for n in ("1", "4", "7"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        results.add(repr(sorted(map(tuple, queries.QUERIES[name](spark, DIR).collect()))))
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    assert len(results) == 1
