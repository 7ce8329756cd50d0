"""The pivot index against plain search."""

import numpy as np
import pytest

from rasterloom.operators import matching, metric


def clustered(rng, rows, groups, size, spread=0.05):
    centres = rng.normal(size=(groups, size)) * 4
    return centres[rng.integers(0, groups, rows)] + rng.normal(size=(rows, size)) * spread


def table(spark, x, ids=None):
    ids = range(len(x)) if ids is None else ids
    return spark.createDataFrame([(int(i), [float(v) for v in row]) for i, row in zip(ids, x)], "idx long, descriptor array<double>").repartition(4)


def answers(df):
    return sorted((r["query_idx"], r["rank"], r["train_idx"], round(r["distance"], 9)) for r in df.collect())


def both(q, t, k, **more):
    return [answers(matching.knn_match(q, t, k, index=way, **more)) for way in (False, True)]


@pytest.mark.parametrize("norm", ["l2", "hamming"])
@pytest.mark.parametrize("apart", [False, True])
def test_index_equals_plain_search_with_ties(spark, norm, apart):
    rng = np.random.default_rng(3)
    df = table(spark, rng.integers(0, 3, (400, 4)))
    plain, indexed = both(df.where("idx % 7 = 0"), df, 3, norm=norm, apart=apart)
    assert plain == indexed and len(plain) == 58 * 3


def test_parts_of_a_hot_ring(spark, monkeypatch):
    monkeypatch.setattr(metric, "TRAIN_PART", 40)
    monkeypatch.setattr(metric, "QUERY_PART", 15)
    rng = np.random.default_rng(4)
    x = np.concatenate([np.ones((200, 6)), clustered(rng, 300, 5, 6)])  # 200 copies of one row
    plain, indexed = both(table(spark, x).where("idx % 5 = 0"), table(spark, x), 4, apart=True)
    assert plain == indexed and len(plain) == 400


def test_clusters_need_a_tenth_of_the_distances(spark):
    rng = np.random.default_rng(5)
    x = clustered(rng, 4000, 40, 16)
    df = table(spark, x)
    counted = spark.sparkContext.accumulator(0)
    q = df.where("idx % 20 = 0")
    found = metric.best(q, df, 2, "l2", True, counted)
    got = {(r["query_idx"], r["rank"]): r["train_idx"] for r in found.collect()}
    for i in range(0, 4000, 20):
        d = ((x - x[i]) ** 2).sum(1)
        d[i] = np.inf
        assert [got[i, 1], got[i, 2]] == np.argsort(d, kind="stable")[:2].tolist()
    assert 0 < counted.value < 200 * 4000 / 10


def test_no_rows_no_descriptors_and_fewer_rows_than_asked(spark):
    df = table(spark, np.arange(12.0).reshape(4, 3))
    assert both(df, df.where("false"), 2) == [[], []]
    assert both(df.where("false"), df, 2) == [[], []]
    plain, indexed = both(df, df, 9, apart=True)
    assert plain == indexed and len(plain) == 12
    odd = df.unionByName(spark.createDataFrame([(10, None), (None, [1.0, 1.0, 2.0]), (11, [float("nan"), 1.0, 2.0]), (12, [float("inf"), 1.0, 2.0])], df.schema))
    plain, indexed = both(odd, odd, 2)
    assert plain == indexed and {r[0] for r in plain} == {0, 1, 2, 3}


def test_repeated_ids(spark):
    x = np.random.default_rng(6).integers(0, 4, (60, 3))
    df = table(spark, x, [i // 2 for i in range(60)])
    plain, indexed = both(df.where("idx % 3 = 0"), df, 3)
    assert plain == indexed
