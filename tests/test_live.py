"""Streams run slot by slot through their sinks: sessions, late rows, duplicates, restarts."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from txnlens.streaming import jobs as J
from txnlens.streaming.replay import late_rows, run_arrivals

T0 = dt.datetime(2024, 1, 1, 12)
FEED = "event_id long, ts timestamp_ntz, user_id long, slot int"


def feed(spark, rows):
    """Rows of (slot, user, minutes after T0)."""
    return spark.createDataFrame([(k, T0 + dt.timedelta(minutes=m), u, s) for k, (s, u, m) in enumerate(rows)], FEED)


def at(minutes):
    return T0 + dt.timedelta(minutes=minutes)


def test_sessions_merge_across_slots_and_disorder(spark):
    rows = [(0, 1, 0), (0, 1, 4), (0, 2, 0), (1, 1, 12), (1, 2, 10), (2, 1, 8), (2, 2, 5), (2, 3, 20), (3, 9, 500)]
    job = lambda s: J.burst_transform(s, "user_id", "5 minutes", 1, "30 minutes")
    got, _ = run_arrivals(feed(spark, rows), 4, job, "sessions")
    found = sorted((r.user_id, r.first_ts, r.last_ts, r.n_events) for r in got.collect())
    # user 1: 0, 4, 8, 12; user 2: gaps of exactly five minutes belong together
    assert found == [(1, at(0), at(12), 4), (2, at(0), at(10), 3)]
    batch = J.burst_transform(feed(spark, rows).drop("slot"), "user_id", "5 minutes", 1)
    assert sorted((r.user_id, r.n_events) for r in batch.collect()) == [(1, 4), (2, 3)]


def test_rows_behind_the_watermark_are_dropped_from_their_session(spark):
    rows = [(0, 1, 0), (0, 1, 2), (1, 5, 300), (2, 1, 3), (3, 5, 900)]
    job = lambda s: J.burst_transform(s, "user_id", "5 minutes", 0, "10 minutes")
    got, progress = run_arrivals(feed(spark, rows), 4, job, "late_sessions")
    assert sorted((r.user_id, r.n_events) for r in got.collect()) == [(1, 2), (5, 1)]
    assert late_rows(progress) == 1


def test_copies_across_slots_come_through_once(spark):
    base = feed(spark, [(0, 1, 0), (0, 1, 1), (1, 2, 5)])
    again = base.where("event_id < 2").withColumn("slot", F.lit(2))
    same_slot = base.where("event_id = 2")
    rows = base.unionByName(again).unionByName(same_slot)
    got, _ = run_arrivals(rows, 3, lambda s: J.dedup_transform(s, ["event_id"], "1 hour"), "dedup")
    assert sorted(r.event_id for r in got.collect()) == [0, 1, 2]
    assert J.dedup_transform(rows.drop("slot"), ["event_id"]).count() == 3


def test_an_empty_slot_changes_nothing(spark):
    rows = feed(spark, [(0, 1, 0), (2, 1, 1)])
    got, _ = run_arrivals(rows, 3, lambda s: s.withColumn("twice", F.col("event_id") * 2), "plain")
    assert sorted(r.twice for r in got.collect()) == [0, 2]
