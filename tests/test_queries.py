"""Every query that has SQL gives the SQL's rows on the smallest tables; the others run."""

import collections
import os

import duckdb
import pytest

import __spark_entry__ as entry

CORE = [n for n in entry.queries() if not (n[0] == "p" and n[1].isdigit()) or n == "p2_found"]


def canon(v):
    if isinstance(v, float):
        return round(v, 6)
    if isinstance(v, list):
        return tuple(canon(x) for x in v)
    return v


def rows_of(rows, names):
    cols = sorted(names)
    return collections.Counter(tuple(canon(r[names.index(c)]) for c in cols) for r in rows)


@pytest.fixture(scope="module")
def oracle(small):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for f in os.listdir(small):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, oracle, name):
    df = entry.queries()[name](spark, small)
    got = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    sql = entry.oracle_sql().get(name)
    if sql:
        r = oracle.execute(sql)
        names = [d[0] for d in r.description]
        assert sorted(names) == sorted(df.columns)
        assert rows_of(got, df.columns) == rows_of(r.fetchall(), names)


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_nothing_needs_llm():
    """No module of the core imports the subpackage llm."""
    import turnwise

    root = os.path.dirname(turnwise.__file__)
    for folder, _, files in os.walk(root):
        if os.sep + "llm" in folder:
            continue
        for f in files:
            if f.endswith(".py"):
                assert "turnwise.llm" not in open(os.path.join(folder, f), encoding="utf-8").read().replace("importlib", "")
