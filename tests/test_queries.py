"""Every query against its SQL, on the smallest tables."""

from __future__ import annotations

import duckdb
import pytest

import __spark_entry__ as entry
from tidebook.plans import accounts, adhoc, market, rich, tier2

SF = "/root/testdata/sf0.001"
NAMES = sorted(market.QUERIES | rich.QUERIES | adhoc.QUERIES | tier2.QUERIES | accounts.QUERIES)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events embeddings conversations".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    return round(float(v), 6) if hasattr(v, "as_tuple") or isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    ours = sorted([tuple(plain(r[c]) for c in columns) for r in df.collect()], key=str)
    if name not in entry.oracle_sql():
        assert ours
        return
    found = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    theirs = sorted([tuple(plain(r[names.index(c)]) for c in columns) for r in found.fetchall()], key=str)
    assert ours == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
