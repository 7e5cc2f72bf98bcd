"""Every registered query of the library against its SQL in DuckDB, on the smallest tables."""

import math
import os

import pytest

from newsloom.plans import catalogue

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else float(f"{v:.10g}")
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    import duckdb

    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_query_equals_sql(spark, duck, name):
    df = catalogue.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = duck.sql(catalogue.ORACLES[name])
    assert sorted(want.columns) == cols
    at = [list(want.columns).index(c) for c in cols]
    key = lambda r: tuple((v is None, str(v)) for v in r)
    got = sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=key)
    assert got == sorted((tuple(plain(r[i]) for i in at) for r in want.fetchall()), key=key)


def test_without_oracle_are_few():
    assert set(catalogue.QUERIES) - set(catalogue.ORACLES) == {"clean_html", "news_feed_top60"}


def test_feed_is_ordered_and_whole(spark):
    import __spark_entry__

    rows = __spark_entry__.entry(spark).collect()
    keys = [(r.published, r.hotness, r.reliability) for r in rows]
    assert len(rows) == 60 and keys == sorted(keys, reverse=True)
    assert all(len(r.key_points) <= 3 and len(r.summary) <= 420 for r in rows)
