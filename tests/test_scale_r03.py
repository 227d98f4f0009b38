"""Steps that grew too fast: whole rows shuffled for duplicates, states by entity, neighbours by block, long methods."""

from __future__ import annotations

import datetime as dt
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.test_live import feed
from tests.test_neighbors import brute, found, frame
from txnlens.operators import clean as C
from txnlens.plans import neighbors as N
from txnlens.streaming import jobs as J
from txnlens.streaming.replay import run_arrivals

ROWS = [(1, 0.0, "a"), (1, -0.0, "a"), (1, None, "a"), (1, None, "a"), (None, 1.0, None), (None, None, None), (2, float("nan"), "b"), (2, float("nan"), "b"), (3, 1.0, "c")]


@pytest.mark.parametrize("most", [0, 100])
def test_duplicates_are_dropped_whatever_their_number(spark, most):
    df = spark.createDataFrame(ROWS, "k int, v double, s string")
    got = C.dedupe(df, max_repeated=most)
    assert got.columns == df.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, df.dropDuplicates().collect()))


def test_rows_without_a_duplicate_are_not_shuffled(spark):
    df = C.dedupe(spark.range(1000).select("id", *[(F.col("id") * i).cast("double").alias(f"v{i}") for i in range(5)]))
    df.write.format("noop").mode("overwrite").save()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "LeftAnti" in plan and "SortMergeJoin" not in plan
    assert df.count() == 1000


def _plan(spark, df):
    old = spark.conf.get("spark.sql.debug.maxToStringFields")
    spark.conf.set("spark.sql.debug.maxToStringFields", "1000")
    try:
        return df._jdf.queryExecution().optimizedPlan().toString()
    finally:
        spark.conf.set("spark.sql.debug.maxToStringFields", old)


def test_row_statistics_write_each_member_once(spark):
    from txnlens.operators.features import add_row_stats

    cols = [f"V{i}" for i in range(1, 29)]
    df = spark.range(3).select(*[F.rand(i).alias(c) for i, c in enumerate(cols)])
    assert len(re.findall("nanvl", _plan(spark, add_row_stats(df, cols)))) <= len(cols)


def test_vectors_are_rounded_once_each_not_by_event(spark):
    from txnlens.sources.fixture import build_transactions

    emb = spark.createDataFrame([(0, [0.12345678] * 30, 0), (1, [-0.5] * 30, 1)], "vec_id long, embedding array<float>, label int")
    ev = spark.createDataFrame([(i, dt.datetime(2024, 1, 1), "click", 2.0) for i in range(4)], "event_id long, ts timestamp_ntz, event_type string, value double")
    got = build_transactions(ev, emb)
    assert sorted((r.txn_id, r.V1, r.V28) for r in got.collect()) == [(0, 0.123457, 0.123457), (1, -0.5, -0.5), (2, 0.123457, 0.123457), (3, -0.5, -0.5)]
    assert len(re.findall(r"round\(", _plan(spark, got))) <= 2  # the vectors' members, and the amount


def test_entities_share_a_bounded_number_of_states(spark):
    rng = np.random.default_rng(5)
    rows = [(int(s), int(u), round(float(m), 3)) for s, u, m in zip(np.sort(rng.integers(0, 3, 300)), rng.integers(0, 12, 300), rng.uniform(0, 240, 300), strict=True)]
    rows.append((3, 999, 10_000.0))
    df = feed(spark, rows).withColumn("user_id", F.when(F.col("user_id") != 7, F.col("user_id") + (1 << 60)))
    got, progress = run_arrivals(df, 4, lambda s: J.velocity_transform(s, "user_id", 2, 300, "10 hours", groups=4), "velocity_groups")
    from txnlens.operators.timing import velocity_flags

    want = velocity_flags(df.select("user_id", F.col("ts").cast("timestamp").alias("ts")), "user_id", "ts", 2, 300)
    take = lambda x: sorted((str(r.user_id), r.ts) for r in x.select("user_id", "ts").collect())
    assert take(got) == take(want) and len(take(got)) > 5
    assert max(int(s["numRowsTotal"]) for p in progress for s in p["stateOperators"]) <= 5


def test_neighbours_over_tiles_of_blocks(spark):
    rng = np.random.default_rng(2)
    v = np.concatenate([rng.normal(0, 1, (150, 20)), rng.integers(0, 2, (50, 20)).astype(float)])
    ids = rng.permutation(500)[:200]
    df, cols = frame(spark, ids, v)
    assert found(N.exact_knn(df, "id", cols, 3, bucket_rows=16, tile_blocks=3)) == brute(ids, v, 3)


@pytest.mark.parametrize("far", [0.0, 1e200])  # beyond the range of a square every distance is computed
def test_bounds_leave_no_neighbour_out(far):
    rng = np.random.default_rng(4)
    v = np.concatenate([rng.normal(1e6, 1e-3, (200, 8)), rng.normal(0, 1, (200, 8))])
    v[0, 0] += far
    ids = rng.permutation(400)
    got = N._nearest(v, ids, v, ids, 4).to_pylist()
    assert sorted((r["a_id"], r["b_id"], r["_d"]) for r in got) == sorted(
        (int(ids[i]), int(ids[j]), float(np.sqrt(((v[i] - v[j]) ** 2).sum(-1))))
        for i in range(400)
        for j in [x for x in np.lexsort((ids, np.sqrt(((v - v[i]) ** 2).sum(-1)))) if x != i][:4]
        if np.isfinite(((v[i] - v[j]) ** 2).sum())
    )


def test_saved_parts_come_from_one_written_table(spark, monkeypatch):
    import txnlens.queries as Q
    from tests.conftest import SF_SMALL
    from txnlens.sources import io as IO

    plans, real = [], IO.write_table
    monkeypatch.setattr(IO, "write_table", lambda df, *a, **k: (plans.append(_plan(spark, df)), real(df, *a, **k))[1])
    Q.registry()["saved_splits"](spark, SF_SMALL)
    assert len(plans) == 3 and not any("nanvl" in p for p in plans)
