"""Queries against their SQL, on the smallest test data."""

import math

import duckdb
import pytest

SF = "/root/testdata/sf0.001"

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SAMPLE = ("who_calls", "all_callees", "call_chain", "dead_code", "find_full_text", "find_related_ranked", "variable_scope", "watch_debounce", "cookbook_33_overriding_methods")


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", SAMPLE)
def test_query_equals_sql(spark, duck, name):
    import __spark_entry__ as entry

    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    theirs = [tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()]
    ours = [tuple(plain(r[c]) for c in order) for r in df.collect()]
    assert sorted(ours, key=repr) == sorted(theirs, key=repr)


def test_every_oracle_has_a_query():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
