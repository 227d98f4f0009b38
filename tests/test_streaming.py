"""Structured Streaming jobs equal their batch twins on the same events."""

from __future__ import annotations

import datetime as dt
import os
import tempfile

import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from txnlens.operators import timing as TM
from txnlens.sources.fixture import table
from txnlens.streaming import jobs as J


@pytest.fixture(scope="module")
def events_dir(spark):
    """The sf0.001 events written as 4 time-ordered parquet files (a replayable stream)."""
    d = tempfile.mkdtemp(prefix="txnlens-events-")
    ev = table(spark, SF_SMALL, "events").orderBy("ts")
    pdf = ev.toPandas()
    n = len(pdf)
    for i in range(4):
        part = pdf.iloc[i * n // 4 : (i + 1) * n // 4]
        spark.createDataFrame(part, ev.schema).coalesce(1).write.parquet(os.path.join(d, f"part{i}"))
    # the stream reads a flat folder of files
    flat = tempfile.mkdtemp(prefix="txnlens-events-flat-")
    k = 0
    for i in range(4):
        sub = os.path.join(d, f"part{i}")
        for f in sorted(os.listdir(sub)):
            if f.endswith(".parquet"):
                os.link(os.path.join(sub, f), os.path.join(flat, f"{k:03d}.parquet"))
                k += 1
    return flat


def _run(df, name, mode):
    q = J.start_memory(df, name, mode)
    q.awaitTermination(300)
    return df.sparkSession.sql(f"SELECT * FROM {name}")


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.collect())


def test_score_stream_equals_batch(spark, events_dir):
    p = J.frozen_params(spark, SF_SMALL)
    got = _run(J.score_stream(spark, SF_SMALL, events_dir, p), "score_s", "append")
    want = J.score_batch(spark, SF_SMALL)
    cols = ["txn_id", "Class", "flagged"]
    assert _rows(got, cols) == _rows(want, cols)
    g = {r["txn_id"]: r["fraud_score"] for r in got.collect()}
    w = {r["txn_id"]: r["fraud_score"] for r in want.collect()}
    assert all(abs(g[k] - w[k]) < 1e-12 for k in w)


def test_hourly_rate_stream_complete_equals_batch(spark, events_dir):
    got = _run(J.hourly_rate_stream(spark, SF_SMALL, events_dir), "hourly_c", "complete")
    want = J.hourly_rate_batch(spark, SF_SMALL)
    cols = ["window_start", "total", "positives"]
    assert _rows(got, cols) == _rows(want, cols)


def test_hourly_rate_stream_append_emits_only_closed_windows(spark, events_dir):
    got = _run(J.hourly_rate_stream(spark, SF_SMALL, events_dir), "hourly_a", "append")
    want = {r["window_start"]: r["total"] for r in J.hourly_rate_batch(spark, SF_SMALL).collect()}
    rows = got.collect()
    assert rows, "closed windows must be emitted"
    assert all(want[r["window_start"]] == r["total"] for r in rows)
    assert len(rows) < len(want)  # the windows still open at the watermark are held back


EVENTS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
T0 = dt.datetime(2024, 1, 1, 12)


def _arrivals(spark, batches) -> str:
    """One file per batch of ``(user, minutes after T0)``, in arrival order."""
    flat = tempfile.mkdtemp(prefix="txnlens-arrivals-")
    for i, batch in enumerate(batches):
        rows = [(k, T0 + dt.timedelta(minutes=m), u, "click", 1.0, "{}") for k, (u, m) in enumerate(batch)]
        sub = os.path.join(tempfile.mkdtemp(prefix="txnlens-batch-"), "b")
        spark.createDataFrame(rows, EVENTS).coalesce(1).write.parquet(sub)
        name = next(f for f in os.listdir(sub) if f.endswith(".parquet"))
        target = os.path.join(flat, f"{i:03d}.parquet")
        os.link(os.path.join(sub, name), target)
        os.utime(target, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))
    return flat


def _velocity(spark, flat, name, **rule):
    got = _run(J.velocity_stream(spark, flat, files_per_batch=1, **rule), name, "append")
    ev = spark.read.schema(EVENTS).parquet(flat).select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    n, within = rule.get("max_events", 2), rule.get("within_seconds", 300)
    want = TM.velocity_flags(ev, "user_id", "ts", n, within)
    return _rows(got, ["user_id", "ts"]), _rows(want, ["user_id", "ts"])


#: an event of nobody, so late that everything before it is due
LAST = [(-1, 100_000.0)]


def test_velocity_stream_equals_batch_rule(spark, events_dir):
    ev = spark.read.schema(EVENTS).parquet(events_dir).orderBy("ts").collect()
    minutes = [(r.user_id, (r.ts - T0).total_seconds() / 60) for r in ev]
    n = len(minutes)
    got, want = _velocity(spark, _arrivals(spark, [minutes[: n // 3], minutes[n // 3 : n // 2], minutes[n // 2 :], LAST]), "velocity_s")
    assert got == want


def test_velocity_stream_over_batches_gaps_and_disorder(spark):
    """Idle history outlives micro-batches, and events that arrive late but in time are judged in order."""
    batches = [[(1, 0.0), (1, 0.0), (3, 0.0), (3, 0.0)], [(2, 1.0), (3, -5.0)], [(1, 2.0)], [(4, 20.0)], [(4, 18.0), (4, 19.0)], LAST]
    got, want = _velocity(spark, _arrivals(spark, batches), "velocity_gaps")
    assert got == want and (1, T0 + dt.timedelta(minutes=2)) in got and (4, T0 + dt.timedelta(minutes=20)) in got
    assert (3, T0 - dt.timedelta(minutes=5)) not in got


def test_velocity_stream_with_another_rule(spark):
    batches = [[(7, 0.0), (7, 0.5)], [(7, 1.0), (8, 1.0), (7, 9.0)], [(7, 1.5), (8, 2.0)], LAST]
    got, want = _velocity(spark, _arrivals(spark, batches), "velocity_three", max_events=3, within_seconds=120)
    assert got == want == [(7, T0 + dt.timedelta(minutes=1.5))]
    df = spark.readStream.schema(EVENTS).parquet(_arrivals(spark, [[(1, 0.0)]])).withColumnRenamed("event_type", "card")
    assert J.velocity_transform(df, "card").schema["card"].dataType.simpleString() == "string"


def test_hourly_rate_stream_drops_rows_behind_the_watermark(spark):
    """Arrivals 08:00-09:50, 10:00-11:50, 12:00, then a row at 08:05.

    A row is late when its window end is at or before the watermark used for
    late rows (the previous micro-batch's, 10:50 when the last file arrives).
    The 08:00 window was emitted with 6 rows and the late row is dropped, not
    emitted as a second 08:00 window.
    """
    t0 = dt.datetime(2024, 1, 1, 8, 0)
    schema = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"
    rows = [(i, t0 + dt.timedelta(minutes=10 * i), 1, "view", 1.0, "{}") for i in range(24)]
    arrivals = (
        rows[:12],
        rows[12:],
        [(999, t0 + dt.timedelta(hours=4), 1, "view", 1.0, "{}")],
        [(1000, t0 + dt.timedelta(minutes=5), 1, "view", 1.0, "{}")],
    )
    d = tempfile.mkdtemp(prefix="txnlens-late-")
    flat = tempfile.mkdtemp(prefix="txnlens-late-flat-")
    for i, part in enumerate(arrivals):
        sub = os.path.join(d, str(i))
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(sub)
        for f in os.listdir(sub):
            if f.endswith(".parquet"):
                target = os.path.join(flat, f"{i}.parquet")
                os.link(os.path.join(sub, f), target)
                os.utime(target, (1_700_000_000 + 100 * i, 1_700_000_000 + 100 * i))  # arrival order
    reader = spark.readStream.schema(J.EVENT_COLS).option("maxFilesPerTrigger", 1).parquet(flat)
    agg = J.hourly_rate_transform(reader, J.embeddings_dim(spark, SF_SMALL), streaming=True)
    q = J.start_memory(agg, "late_rows", "append")
    q.awaitTermination(300)
    dropped = sum(p["stateOperators"][0].get("numRowsDroppedByWatermark", 0) for p in q.recentProgress if p["stateOperators"])
    out = spark.sql("SELECT * FROM late_rows").collect()
    got = {r["window_start"]: r["total"] for r in out}
    assert dropped == 1
    assert got[dt.datetime(2024, 1, 1, 8, 0)] == 6
    assert sum(1 for r in out if r["window_start"] == dt.datetime(2024, 1, 1, 8, 0)) == 1
    assert dt.datetime(2024, 1, 1, 11, 0) not in got  # still open at the end of the input
