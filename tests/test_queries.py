"""Every matrix query against its SQL on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from rasterloom.plans import queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, int | float | decimal.Decimal):
        v = float(v)
        return "nan" if math.isnan(v) else "%.9g" % (v + 0.0)
    return repr(v)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in cols) for r in df.collect())
    answer = duck.execute(queries.SQL[name])
    names = [x[0] for x in answer.description]
    assert sorted(names) == cols
    want = sorted(tuple(plain(r[names.index(c)]) for c in cols) for r in answer.fetchall())
    assert got == want


LIGHT = ["stream_tracks", "hough_lines_p", "hough_circles", "solve_poly", "randn", "kmeans"]


@pytest.mark.parametrize("name", LIGHT)
def test_runs(spark, name):
    assert queries.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).columns == ["query_idx", "train_idx", "distance"]
