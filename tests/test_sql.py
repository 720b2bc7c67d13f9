"""Every query that has SQL gives the SQL's rows on the small tables."""

import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from granary.plans import agro, cleaning, documents, flows, market, messages, misc, pages, quality, registry, texts
from granary.sources.tables import TABLES
from tests.helpers import SF_TINY

PLANS = {}
for c in (market.C, messages.C, documents.C, agro.C, quality.C, misc.C, flows.C, texts.C, pages.C, registry.C):
    PLANS |= {k: (c.queries[k], q) for k, q in c.sql.items()}
PLANS |= {k: (cleaning.QUERIES[k], q) for k, q in cleaning.SQL.items()}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("set timezone = 'UTC'")
    for t in TABLES:
        if os.path.exists(f"{SF_TINY}/{t}.parquet"):
            c.execute(f"create view {t} as select * from '{SF_TINY}/{t}.parquet'")
    return c


def plain(v):
    if v is None or (isinstance(v, float) and math.isnan(v)) or str(v) in ("NaT", "<NA>"):
        return None
    if isinstance(v, bool) or type(v).__name__ == "bool":
        return str(bool(v))
    if hasattr(v, "__len__"):
        return str(list(v)) if not isinstance(v, str) else v
    try:
        return f"{float(v):.8g}"
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    names = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False, name=None)), key=str)


@pytest.mark.parametrize("name", sorted(PLANS))
def test_matches_sql(spark, con, name):
    query, sql = PLANS[name]
    got, want = query(spark, SF_TINY).toPandas(), con.execute(sql).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_entry(spark):
    assert entry.entry(spark).columns[0] == "p_partkey"
    assert set(entry.oracle_sql()) <= set(entry.queries())
