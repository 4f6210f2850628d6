"""Driver contract: entry() smoke, every query has an oracle, parity on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E
from conftest import SF_SMALL

TABLES = "region nation customer supplier part orders lineitem events".split()


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() > 0
    assert "MATCH" in df.columns


def test_every_query_has_oracle():
    from ledgerlens.plans.queries import QUERIES

    assert set(QUERIES) <= set(E.queries())
    assert set(QUERIES) <= set(E.oracle_sql()) <= set(E.queries())


def _norm(v):
    if isinstance(v, float):
        return round(v, 9)
    if hasattr(v, "isoformat"):
        return v.isoformat()
    return v


@pytest.mark.parametrize("name", [
    "purchases", "purchase_rollup", "blocked_vendors", "three_way_match_full", "multi_tax",
    "hygiene_prod_code", "audit_vendor_buckets", "upload_accounting", "loan_diff_hits", "hr_dup_bank",
    "itc_failed_logins", "remarks", "observations_upsert",
])
def test_parity_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df = E.queries()[name](spark, SF_SMALL)
    cols = sorted(df.columns)
    s_rows = sorted(tuple(repr(_norm(r[c])) for c in cols) for r in df.collect())
    res = con.execute(E.oracle_sql()[name])
    d_cols = [d[0] for d in res.description]
    assert sorted(d_cols) == cols
    idx = [d_cols.index(c) for c in cols]
    d_rows = sorted(tuple(repr(_norm(r[i])) for i in idx) for r in res.fetchall())
    assert s_rows == d_rows
