"""Every query with SQL against DuckDB on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from foliary.plans import books, more, nested  # noqa: F401  (they add their queries)
from foliary.plans import queries as plans

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(frame):
    def cell(v):
        if v is None or v is pd.NaT or isinstance(v, float) and v != v or v is pd.NA:
            return "none"
        if isinstance(v, float):
            return repr(round(v, 6) if v % 1 else int(v))
        return str(v)

    return sorted(tuple(cell(v) for v in r) for r in frame[sorted(frame.columns)].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(plans.ORACLE_SQL))
def test_same_as_sql(spark, duck, name):
    ours, theirs = plans.QUERIES[name](spark, SF).toPandas(), duck.execute(plans.ORACLE_SQL[name]).df()
    assert sorted(ours.columns) == sorted(theirs.columns)
    assert plain(ours) == plain(theirs)
    assert len(ours)
