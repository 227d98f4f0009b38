"""SMOTE on a class of many clusters and copies: neighbours are found in few blocks, and vectors move once a pair."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tests.test_neighbors import brute, found, frame
from txnlens.operators import resample as RS
from txnlens.plans import neighbors as N
from txnlens.spec import TxnSpec


def test_clusters_beyond_the_pivots_need_few_distances(spark):
    rng = np.random.default_rng(7)
    n = 3000
    centres = rng.normal(0, 1, (60, 12))
    v = np.column_stack([centres[rng.integers(0, 60, n)], rng.normal(0, 0.3, n), rng.normal(0, 0.3, n)])
    v[:20, -1] += rng.normal(0, 20, 20)  # far from all others, so their own search is wide
    ids = rng.permutation(n * 2)[:n]
    df, cols = frame(spark, ids, v)
    top, stats = N.knn_with_stats(df, "id", cols, 4, bucket_rows=100)
    assert found(top) == brute(ids, v, 4)
    s = stats.first()
    assert s.rows == n and s.pairs == n * (n - 1) and s.computed < s.pairs / 8


def test_copies_of_one_vector_are_searched_once(spark):
    rng = np.random.default_rng(8)
    v = np.concatenate([np.repeat(rng.normal(0, 1, (3, 4)), [700, 5, 6], axis=0), rng.normal(0, 1, (90, 4)), np.zeros((3, 4))])
    v[-1, 0] = -0.0
    ids = rng.permutation(2000)[: len(v)]
    df, cols = frame(spark, ids, v)
    top, stats = N.knn_with_stats(df, "id", cols, 5, bucket_rows=16)
    assert found(top) == brute(ids, v, 5)
    assert stats.first().computed < len(v) * (len(v) - 1) / 20


def test_rows_without_a_finite_distance_are_left_out(spark):
    rng = np.random.default_rng(9)
    v = rng.normal(0, 1, (60, 3))
    v[0, 1], v[1, 2], v[2, 0] = np.nan, np.inf, 1e200
    ids = np.arange(60)
    df, cols = frame(spark, ids, v)
    got = found(N.exact_knn(df, "id", cols, 2, bucket_rows=8))
    assert got == brute(ids[3:], v[3:], 2)


def _nodes(plan):
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))


def test_synthetic_rows_are_not_moved_with_their_vectors_nor_vectors_broadcast(spark):
    rng = np.random.default_rng(10)
    rows = [(i, int(i < 40), *map(float, rng.normal(0, 1, 3))) for i in range(400)]
    df = spark.createDataFrame(rows, "txn_id long, Class int, V1 double, V2 double, V3 double")
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    for most in ("10m", "-1"):
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)
        try:
            out = RS.smote(df, ["V1", "V2", "V3"], TxnSpec(), k=5, bucket_rows=8)
            plan = out._jdf.queryExecution().executedPlan().initialPlan()
            nodes = [(n.nodeName(), n.output().mkString(",")) for n in _nodes(plan)]
            assert out.groupBy("Class", "synthetic").count().where(F.col("count") == 320).count() == 1
        finally:
            spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        moved = [m for name, m in nodes if name == "Exchange"]
        assert not [m for name, m in nodes if name == "BroadcastExchange" and ("_x#" in m or "_y#" in m)]
        assert any("_u#" in m for m in moved)
        assert not [m for m in moved if "_x#" in m and ("_u#" in m or "_y#" in m)]
        assert not [m for m in moved if "_u#" in m and "_y#" in m]


def test_vectors_are_not_broadcast_to_their_rows(spark):
    df, cols = frame(spark, np.arange(50), np.random.default_rng(11).normal(0, 1, (50, 3)))
    plan = N.exact_knn(df, "id", cols, 2)._jdf.queryExecution().executedPlan().initialPlan()
    assert not [n for n in _nodes(plan) if n.nodeName() == "BroadcastExchange" and "_v#" in n.output().mkString(",")]
