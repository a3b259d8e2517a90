import math
import os

import pytest

import __spark_entry__ as entry
from conftest import SMALL

duckdb = pytest.importorskip("duckdb")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SMALL), reason="no test tables here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SMALL}/{t}.parquet')")
    return c


def rows(df):
    def plain(v):
        return None if v is None or (isinstance(v, float) and math.isnan(v)) else v
    names = sorted(df.columns)
    return sorted((tuple(plain(v) for v in r) for r in df[names].itertuples(index=False, name=None)), key=str)


# Each of these starts a stream or many files; the others cover the same operators here.
SLOW = {"anchored_batches_split", "stream_index", "stream_inbox", "text_source"}


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SLOW))
def test_query_matches_its_sql(spark, con, name):
    got = entry.queries()[name](spark, SMALL).toPandas()
    want = con.execute(entry.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got) == rows(want)


def test_flagship(spark):
    df = entry.entry(spark)
    assert df.columns and df.count() > 0


def test_every_check_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
