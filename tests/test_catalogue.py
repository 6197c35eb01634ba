"""Every registered journal query against its SQL, on the smallest tables."""

import datetime
import decimal
import os

import duckdb
import pytest

from rillway.plans import registry as catalogue

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the generated tables")


@pytest.fixture(scope="module")
def check():
    c = duckdb.connect()
    for t in ("customer", "nation", "orders", "supplier", "lineitem", "events", "conversations"):
        p = f"{SF}/{t}.parquet"
        c.sql(f"create view {t} as select * from '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return c


def plain(v):
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    return v.isoformat() if isinstance(v, datetime.datetime) else str(v)


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_same_rows(spark, check, name):
    df = catalogue.QUERIES[name](spark, SF)
    want = check.sql(catalogue.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(want.columns)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    at = [want.columns.index(c) for c in cols]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in want.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL)))
def test_runs(spark, name):
    assert catalogue.QUERIES[name](spark, SF).count() > 0


@pytest.fixture(scope="module")
def long_journal(spark, tmp_path_factory):
    """Tables with more events than two levels of a tree of digests come to one node for."""
    path = str(tmp_path_factory.mktemp("long"))
    spark.range(0, 263_000, numPartitions=4).selectExpr("id as event_id", "timestamp_millis(1704067200000 + (id * 7919) % 263000) as ts", "id % 50 as user_id", "element_at(array('signup', 'error', 'purchase', 'view'), cast(1 + id % 4 as int)) as event_type", "double(id % 100) as value", "'{}' as props").write.parquet(f"{path}/events.parquet")
    return path


def same_as_sql(spark, path, name):
    c = duckdb.connect()
    c.sql(f"create view events as select * from '{path}/events.parquet/*.parquet'")
    df, want = catalogue.QUERIES[name](spark, path), c.sql(catalogue.ORACLE_SQL[name])
    got = sorted(tuple(plain(r[x]) for x in want.columns) for r in df.collect())
    rows = sorted(tuple(plain(x) for x in r) for r in want.fetchall())
    return got == rows and bool(rows)


@pytest.mark.parametrize("name", ["journal_merkle", "journal_root"])
def test_digests_of_a_long_journal(spark, long_journal, name):
    assert same_as_sql(spark, long_journal, name)


def test_parting_of_long_journals(spark, long_journal):
    assert same_as_sql(spark, long_journal, "journal_parting")
