"""Structured Streaming jobs (ST-1..3) and their batch twins.

The reference only reloads a static file; these jobs carry its monitoring
ideas to a stream of events:

* ST-1 :func:`score_stream` - stateless scoring with normalisers *frozen* from a
  batch fit (a maximum over an unbounded stream is not defined).
* ST-2 :func:`hourly_rate_stream` - positive rate per tumbling event-time hour,
  with a watermark so late rows are dropped and state is bounded.
* ST-3 :func:`velocity_stream` - "more than N events per entity within T"
  with ``applyInPandasWithState``: events are judged in event-time order once
  the watermark has passed them.

* :func:`burst_transform` - bursts as session windows that merge across micro-batches.
* :func:`dedup_transform` - duplicate rows removed within the watermark.

Each has a batch twin built from the same transform functions. The registered
``live_*`` queries run the streams themselves over arrivals in slots
(:mod:`txnlens.streaming.replay`), with state, late rows and restarts, and return
what their sinks hold.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from txnlens.operators import clean as C
from txnlens.operators import scoring as S
from txnlens.session import checkpoint_subdir
from txnlens.sources.fixture import build_transactions, embeddings_dim, table
from txnlens.spec import TxnSpec

SPEC = TxnSpec()
EVENT_COLS = "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string"


# ------------------------------------------------------------------ fitted state
def frozen_params(spark: SparkSession, sf_dir: str, cleaned: DataFrame | None = None) -> dict[str, float]:
    """Capping fences and score normalisers fitted on the cleaned batch table.

    One aggregate row each, collected once: the only driver round trip, bounded.
    ``cleaned`` may be passed when the cleaned table is already materialised.
    """
    from txnlens.sources.fixture import transactions

    cl = cleaned if cleaned is not None else C.clean(transactions(spark, sf_dir), SPEC)
    # the capped amount was clipped at the fences fitted on the de-duplicated table
    f = C.iqr_fences(cl, SPEC.amount).select("lower", "upper")
    p = S.score_params(cl).first().asDict()
    p.update(f.first().asDict())
    return p


def _score_with(df: DataFrame, p: dict[str, float]) -> DataFrame:
    amt = F.col(SPEC.amount).cast("double")
    lo = max(float(p["lower"]), 0.0)
    capped = F.when(amt.isNotNull(), F.least(F.greatest(amt, F.lit(lo)), F.lit(float(p["upper"]))))
    x = df.withColumn("Amount_log", F.log1p(capped))
    params = {f"m{i}": float(p[f"m{i}"]) for i in range(len(S.SCORE_TERMS))}
    x = x.withColumn("_sp", F.struct(*[F.lit(v).alias(k) for k, v in params.items()]))
    return x.withColumn("fraud_score", S.score_expr("_sp")).drop("_sp")


def score_transform(df: DataFrame, p: dict[str, float], threshold: float = 0.60) -> DataFrame:
    """Transaction rows -> (txn_id, Class, Amount, fraud_score, flagged)."""
    x = _score_with(df, p)
    return x.select(
        SPEC.key,
        SPEC.label,
        SPEC.amount,
        "fraud_score",
        (F.col("fraud_score") >= F.lit(threshold)).alias("flagged"),
    )


def score_batch(spark: SparkSession, sf_dir: str, cleaned: DataFrame | None = None) -> DataFrame:
    ev = table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    txn = build_transactions(ev, embeddings_dim(spark, sf_dir))
    return score_transform(txn, frozen_params(spark, sf_dir, cleaned))


def score_stream(spark: SparkSession, sf_dir: str, events_path: str, p: dict[str, float] | None = None) -> DataFrame:
    """ST-1: streaming scores of events arriving as parquet files under ``events_path``."""
    p = p or frozen_params(spark, sf_dir)
    ev = spark.readStream.schema(EVENT_COLS).parquet(events_path).select("event_id", "ts", "event_type", "value")
    # stream-static join; the planner broadcasts the static side only below its size threshold
    txn = build_transactions(ev, embeddings_dim(spark, sf_dir))
    return score_transform(txn, p)


# ------------------------------------------------------------------ hourly rate
def hourly_rate_transform(ev: DataFrame, emb: DataFrame, streaming: bool = False) -> DataFrame:
    """Events -> per tumbling hour: total, positives, rate %, exposure."""
    e = ev.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    j = build_transactions(e, emb, keep=("ts",))
    if streaming:
        j = j.withWatermark("ts", "1 hour")
    positive = F.col(SPEC.label) == 1
    amt = F.col(SPEC.amount)
    g = j.groupBy(F.window("ts", "1 hour")).agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(positive).alias("positives"),
        F.coalesce(F.sum(F.when(positive, amt)), F.lit(0.0)).alias("exposure"),
    )
    return g.select(
        F.col("window.start").cast("timestamp_ntz").alias("window_start"),
        F.col("window.end").cast("timestamp_ntz").alias("window_end"),
        "total",
        "positives",
        (F.col("positives") / F.col("total") * 100).alias("rate_pct"),
        "exposure",
    )


def hourly_rate_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    return hourly_rate_transform(ev, embeddings_dim(spark, sf_dir))


def hourly_rate_stream(spark: SparkSession, sf_dir: str, events_path: str) -> DataFrame:
    ev = spark.readStream.schema(EVENT_COLS).parquet(events_path)
    return hourly_rate_transform(ev, embeddings_dim(spark, sf_dir), streaming=True)


# ------------------------------------------------------------------ bursts
def burst_transform(events: DataFrame, entity: str, gap: str = "5 minutes", more_than: int = 2, delay: str = "10 minutes") -> DataFrame:
    """Bursts: runs of more than ``more_than`` events of one entity with at most ``gap`` between neighbours.

    Session windows, merged across micro-batches while they are open; a burst is
    given out once the watermark (``delay`` behind the latest event) has passed
    its end. Rows whose own session the watermark has passed are dropped.
    """
    e = events.select(F.col(entity), F.col("ts").cast("timestamp").alias("ts"))
    if events.isStreaming:
        e = e.withWatermark("ts", delay)
    runs = e.groupBy(F.session_window("ts", gap).alias("run"), F.col(entity)).agg(
        F.count(F.lit(1)).alias("n_events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")
    )
    naive = lambda c: F.col(c).cast("timestamp_ntz").alias(c)
    return runs.where(F.col("n_events") > more_than).select(entity, naive("first_ts"), naive("last_ts"), "n_events")


# ------------------------------------------------------------------ duplicates
def dedup_transform(events: DataFrame, key: list[str], delay: str = "10 minutes") -> DataFrame:
    """SO-4 on a stream: one row for each ``key``, copies within ``delay`` of event time removed.

    The state holds a key until the watermark has passed its event time by
    ``delay``; a copy that comes later than that is behind the watermark itself
    and dropped as late, so no copy comes through. On a batch it is
    ``dropDuplicates``.
    """
    e = events.withColumn("ts", F.col("ts").cast("timestamp"))
    if not events.isStreaming:
        return e.dropDuplicates(key)
    return e.withWatermark("ts", delay).dropDuplicatesWithinWatermark(key)


# ------------------------------------------------------------------ velocity
VELOCITY_GROUPS = 4096
#: entities as text; of each event the entity's place there (int32), its time (int64 microseconds) and whether it is judged
VELOCITY_STATE = "held array<string>, who binary, at binary, judged binary"


def velocity_step(
    who: np.ndarray, at: np.ndarray, judged: np.ndarray, watermark: int, max_events: int, within_seconds: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Events of several entities (by code; times in microseconds; judged ones in their order) at a watermark.

    Returns the order that puts each entity's judged events first, then the others by
    time, and in that order: which events are due now and break the rule, and which
    still matter: those that wait, and each entity's last ``max_events`` judged ones
    until ``within_seconds`` after the last, if none of its events waits.
    """
    order = np.lexsort((np.where(judged, np.arange(len(at)), at), ~judged, who))
    who, at, judged = who[order], at[order], judged[order]
    due = judged | (at <= watermark)  # an entity's due events come first
    breaks = np.zeros(len(at), dtype=bool)
    i = np.arange(max_events, len(at))
    back = i - max_events
    breaks[i] = due[i] & ~judged[i] & (who[i] == who[back]) & (at[i] - at[back] < within_seconds * 1_000_000)
    starts = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else np.zeros(0, dtype=np.int64)
    run = np.repeat(np.arange(len(starts)), np.diff(np.r_[starts, len(who)]))
    n_due = np.bincount(run, weights=due, minlength=len(starts)).astype(np.int64)
    last = starts + n_due - 1  # of the due ones of each run
    idle = (starts + n_due == np.r_[starts[1:], len(who)]) & (at[last] + within_seconds * 1_000_000 <= watermark)
    keep = ~due | ((np.arange(len(at)) > last[run] - max_events) & ~idle[run])
    return order, breaks, keep


def velocity_transform(
    events: DataFrame,
    entity: str,
    max_events: int = 2,
    within_seconds: int = 300,
    delay: str = "10 minutes",
    groups: int = VELOCITY_GROUPS,
) -> DataFrame:
    """ST-3 on streaming ``events`` with columns ``entity`` and ``ts``.

    Events wait in the state until the watermark has passed them and are then
    judged in time order, so neither the arrival order within the delay nor the
    cut into micro-batches changes the result. The state holds the waiting
    times and the last ``max_events`` judged ones; an entity is forgotten
    ``within_seconds`` after its last event, when it can no longer matter.
    Entities share ``groups`` states by their hash, so that a micro-batch costs
    calls by groups, not by entities; those of a state are judged at once.
    """
    kind = events.schema[entity].dataType.simpleString()
    # entities go as text: pandas would make whole numbers doubles beside missing rows
    key = F.hex(entity) if kind == "binary" else F.col(entity).cast("string")
    group = F.when(F.col(entity).isNull(), F.lit(-1)).otherwise(F.pmod(F.xxhash64(entity), F.lit(groups)).cast("int"))
    e = events.select(group.alias("_group"), key.alias("_who"), F.col("ts").cast("timestamp").alias("ts"))
    e = e.withWatermark("ts", delay)

    def step(key, pdfs: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, who, at, judged = state.get if state.exists else ([], b"", b"", b"")
        held = list(held)
        who = np.frombuffer(bytes(who), dtype=np.int32)
        at = np.frombuffer(bytes(at), dtype=np.int64)
        judged = np.frombuffer(bytes(judged), dtype=bool)
        if not state.hasTimedOut:
            new = [p for p in pdfs if len(p)]
            names = [x for p in new for x in ([None] * len(p) if key[0] < 0 else p["_who"].tolist())]
            codes = {x: i for i, x in enumerate(held)}
            who = np.concatenate([who, np.array([codes.setdefault(x, len(codes)) for x in names], dtype=np.int32)])
            held = list(codes)
            at = np.concatenate([at, *[p["ts"].to_numpy().astype("datetime64[us]").astype(np.int64) for p in new]])
            judged = np.concatenate([judged, np.zeros(len(names), dtype=bool)])
        watermark = state.getCurrentWatermarkMs() * 1000
        order, breaks, keep = velocity_step(who, at, judged, watermark, max_events, within_seconds)
        who, at, judged = who[order], at[order], (judged | (at <= watermark))[order]
        flagged, times = who[breaks], at[breaks]
        who, at, judged = who[keep], at[keep], judged[keep]
        if len(at):
            # next call: when the first waiting event is due, or an idle entity's history has no effect any more
            ends = np.flatnonzero(np.r_[who[1:] != who[:-1], True])
            idle = at[ends[judged[ends]]] + within_seconds * 1_000_000
            wake = np.concatenate([at[~judged], idle]).min()
            used, who_now = np.unique(who, return_inverse=True)
            state.update(([held[i] for i in used], who_now.astype(np.int32).tobytes(), at.tobytes(), judged.tobytes()))
            state.setTimeoutTimestamp(int(max(wake, watermark) // 1000 + 1))
        elif state.exists:
            state.remove()
        if len(flagged):
            names = pd.Series([held[i] for i in flagged], dtype=object)
            yield pd.DataFrame({"_who": names, "ts": pd.to_datetime(times, unit="us"), "n_recent": max_events + 1})

    found = e.groupBy("_group").applyInPandasWithState(
        step,
        "_who string, ts timestamp, n_recent int",
        VELOCITY_STATE,
        "append",
        GroupStateTimeout.EventTimeTimeout,
    )
    back = F.unhex("_who") if kind == "binary" else F.col("_who").cast(kind)
    return found.select(back.alias(entity), "ts", "n_recent")


def velocity_stream(
    spark: SparkSession,
    events_path: str,
    entity: str = "user_id",
    max_events: int = 2,
    within_seconds: int = 300,
    files_per_batch: int | None = None,
) -> DataFrame:
    """ST-3: flag an event when it is the (max_events+1)-th of its entity within ``within_seconds``."""
    reader = spark.readStream.schema(EVENT_COLS)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return velocity_transform(reader.parquet(events_path), entity, max_events, within_seconds)


def start_memory(df: DataFrame, name: str, mode: str = "append", spark: SparkSession | None = None, available_now: bool = True):
    """Start a streaming query into an in-memory table; checkpoint under the shared folder."""
    spark = spark or df.sparkSession
    w = df.writeStream.format("memory").queryName(name).outputMode(mode).option(
        "checkpointLocation", checkpoint_subdir(spark, f"stream-{name}")
    )
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()
