"""Registered queries against their SQL on DuckDB, on whole tables."""

import functools
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry_point
from ticketloom.plans import queries

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if type(value).__name__ == "Decimal":
        return round(float(value), 6)
    return value


def ordered(columns, rows):
    places = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(row[i]) for i in places) for row in rows), key=str)


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


@pytest.fixture(scope="module", autouse=True)
def shared_fits():
    """The article index and the classifier are fitted once for all queries."""
    with pytest.MonkeyPatch.context() as patch:
        for name in ("support_index", "topic_classifier"):
            patch.setattr(queries, name, functools.cache(getattr(queries, name)))
        yield


@pytest.mark.parametrize("name", sorted(entry_point.oracle_sql()))
def test_query_equals_sql(spark, duck, sf_dir, name):
    got = entry_point.queries()[name](spark, sf_dir)
    cursor = duck.execute(entry_point.oracle_sql()[name])
    columns = [part[0] for part in cursor.description]
    assert sorted(got.columns) == sorted(columns)
    assert ordered(got.columns, got.collect()) == ordered(columns, cursor.fetchall())


def test_every_query_is_named_and_entry_runs(spark):
    assert set(entry_point.oracle_sql()) <= set(entry_point.queries())
    assert entry_point.entry(spark).count() == 1
