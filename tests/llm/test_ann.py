"""Recall of the posting lists against brute force on plain and hard inputs."""

import math

import numpy as np
import pytest

from textquarry.llm.ann import LIST, Lists, nearest

rng = np.random.default_rng(11)


def clustered(n, dim, clusters):
    return rng.standard_normal((clusters, dim))[rng.integers(0, clusters, n)] + 0.2 * rng.standard_normal((n, dim))


SETS = {
    "random, 32 dimensions": lambda: rng.standard_normal((3000, 32)),
    "random, 128 dimensions": lambda: rng.standard_normal((2000, 128)),
    "clusters": lambda: clustered(4000, 32, 60),
    "one common vector": lambda: np.concatenate([np.repeat(rng.standard_normal((1, 16)), 5001, 0), rng.standard_normal((1500, 16))]),
    "far from the origin": lambda: 1e6 + rng.standard_normal((1500, 16)),
    "two places far apart": lambda: np.concatenate([1e6 + rng.standard_normal((700, 8)), -1e6 + rng.standard_normal((700, 8))]),
    "a single list": lambda: 1e6 + rng.standard_normal((100, 16)),
    "one vector alone": lambda: np.ones((40, 4)),
}


def brute(x, q, k=10):
    d = np.sqrt(((x - x[q]) ** 2).sum(1))
    d[q] = np.inf
    at = np.lexsort((np.arange(len(x)), d))[:k]
    return at, d[at]


@pytest.mark.parametrize("name", SETS)
def test_recall(spark, name):
    x = SETS[name]()
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    asked = range(0, len(x), 20)
    got = {}
    for r in nearest(df, df.where("vec_id % 20 = 0")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    hits = 0
    for q in asked:
        at, d = brute(x, q)
        assert len(got[q]) == 10 and all(s == np.sqrt(((x[i] - x[q]) ** 2).sum()) for i, s in got[q])
        hits += sum(s <= d[-1] for _, s in got[q]) if name != "one common vector" else len({i for i, _ in got[q]} & set(at.tolist()))
    assert hits >= 0.93 * 10 * len(asked)


def test_lists_prune_and_balance():
    x = clustered(40_000, 32, 300)
    n = round(2 * math.sqrt(len(x)))
    assert n < len(x) // LIST
    lists = Lists(x[:20_000], n, 10)
    row, at = lists.posted(x - lists.mean)
    assert len(lists.centroids) == n and len(np.unique(row)) == len(x) and len(row) < 3 * len(x)
    share = np.mean([len(lists.opened(q)) for q in (x - lists.mean)[::400]]) / n
    assert share < 0.1
    assert np.bincount(at, minlength=n).max() < 20 * len(row) / n


@pytest.mark.parametrize(("dim", "most"), [(8, 0.2), (16, 0.5), (32, 0.8), (128, 1.0)])
def test_no_more_than_a_scan(dim, most):
    """What a query meets, copies included, is never more than all vectors, and far less where there are few dimensions."""
    x = np.random.default_rng(dim).standard_normal((12_000, dim))
    lists = Lists(x, 187, 10)
    row, at = lists.posted(x - lists.mean)
    rows = np.bincount(at, minlength=len(lists.centroids))
    met = np.mean([rows[lists.opened(q)].sum() for q in (x - lists.mean)[::60]]) / len(x)
    assert len(np.unique(row)) == len(x) and met <= most
    assert len(lists.centroids) == 1 or len(row) > len(x)  # boundary vectors stand in two lists


def test_query_groups(spark, monkeypatch):
    """A block's queries pass in several groups."""
    monkeypatch.setattr("textquarry.llm.ann.QUERIES", 3)
    x = rng.standard_normal((300, 6))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {}
    for r in nearest(df, df.where("vec_id % 7 = 0"), k=5).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert sum(len(set(got[q]) & set(brute(x, q, 5)[0].tolist())) for q in range(0, 300, 7)) >= 0.93 * 5 * 43
