"""The metric index: exact neighbours, few distances on clustered rows, hot cells split."""

from __future__ import annotations

import numpy as np
import pytest

from txnlens.plans import neighbors as N


def brute(ids, v, k):
    out = []
    for i in range(len(ids)):
        d = np.sqrt(((v - v[i]) ** 2).sum(-1))
        order = [j for j in np.lexsort((ids, d)) if j != i][:k]
        out += [(int(ids[i]), r, int(ids[j]), round(float(d[j]), 9)) for r, j in enumerate(order, 1)]
    return sorted(out)


def frame(spark, ids, v):
    cols = [f"f{c}" for c in range(v.shape[1])]
    rows = [(int(i), *map(float, x)) for i, x in zip(ids, v, strict=True)]
    return spark.createDataFrame(rows, "id long, " + ", ".join(f"{c} double" for c in cols)), cols


def found(df):
    return sorted((r.id, r.nn_rank, r.nn_id, round(r.dist, 9)) for r in df.collect())


def clustered(n, clusters, seed, hot=0):
    rng = np.random.default_rng(seed)
    centres = rng.normal(0, 100, (clusters, 6))
    at = rng.integers(0, clusters, n)
    at[:hot] = 0
    return rng.permutation(n * 3)[:n], centres[at] + rng.normal(0, 1, (n, 6))


@pytest.mark.parametrize("hot", [0, 400])
def test_clustered_rows_need_few_distances(spark, hot):
    ids, v = clustered(900, 12, 3, hot)
    df, cols = frame(spark, ids, v)
    top, stats = N.knn_with_stats(df, "id", cols, 4, bucket_rows=32)
    assert found(top) == brute(ids, v, 4)
    s = stats.first()
    assert s.pairs == 900 * 899 and s.computed < s.pairs / 2


def test_ties_copies_and_tiny_classes(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([np.zeros((40, 3)), rng.integers(0, 3, (60, 3)).astype(float)])
    ids = rng.permutation(100)
    df, cols = frame(spark, ids, v)
    assert found(N.exact_knn(df, "id", cols, 5, bucket_rows=8)) == brute(ids, v, 5)
    few, cols = frame(spark, ids[:3], v[60:63])
    assert found(N.exact_knn(few, "id", cols, 5)) == brute(ids[:3], v[60:63], 5)
    assert N.exact_knn(few.where("id < 0"), "id", cols, 5).count() == 0
