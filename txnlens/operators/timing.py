"""Event velocity and arrival (WN-1..3, AG-30, ST-3 batch twin).

Global time order is never materialised in one partition: gaps, arrival ranks
and quantiles go through the two-level plans of :mod:`txnlens.plans.ordered`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from txnlens.functions.columns import clip
from txnlens.plans.ordered import prefix_rank, previous_k, previous_value, quantiles_wide
from txnlens.plans.small import with_params
from txnlens.plans.stage import write_table
from txnlens.spec import TxnSpec


def positive_gaps(
    df: DataFrame,
    spec: TxnSpec = TxnSpec(),
    clip_upper: float | None = None,
    partition_by: Sequence[str] = (),
    positives_only: bool = True,
) -> DataFrame:
    """Minutes between consecutive positive events, in time order.

    The first event (per partition) has no gap and is dropped. ``clip_upper``
    caps gaps (the interactive view caps at 200 minutes before summarising).
    ``partition_by`` gives per-entity velocity.
    """
    x = df.where(F.col(spec.label) == 1) if positives_only else df
    cols = [*partition_by, spec.time] + ([spec.key] if spec.key else [])
    x = x.select(*[F.col(c) for c in dict.fromkeys(cols)])
    x = previous_value(x, spec.time, partition_by, out="_prev")
    gap = (F.col(spec.time).cast("double") - F.col("_prev")) / 60.0
    if clip_upper is not None:
        gap = clip(gap, upper=clip_upper)
    return x.where(F.col("_prev").isNotNull()).select(*[F.col(c) for c in dict.fromkeys(cols)], gap.alias("gap_min"))


def gap_quantiles(df: DataFrame, spec: TxnSpec = TxnSpec(), clip_upper: float | None = None) -> DataFrame:
    """10th percentile, median and count of the positive-event gaps (exact).

    The gap table (positives only) is read by several quantile branches; it is
    written once to the shared checkpoint folder instead of being re-derived.
    """
    g = write_table(positive_gaps(df, spec, clip_upper).select("gap_min"), "gaps")
    q = quantiles_wide(g, "gap_min", [0.1, 0.5], ["p10_min", "median_min"])
    n = g.agg(F.count(F.lit(1)).alias("n_gaps"))
    return with_params(n, q, "_q").select("n_gaps", F.col("_q.p10_min").alias("p10_min"), F.col("_q.median_min").alias("median_min"))


def cumulative_arrival(df: DataFrame, spec: TxnSpec = TxnSpec(), zero_based: bool = False) -> DataFrame:
    """Per label, each event's cumulative share (%) in time order.

    ``zero_based=False``: i/n*100 for the i-th event (1-based).
    ``zero_based=True``: (i-1)/(n-1)*100, 0 when n == 1 (evenly spaced 0..100).
    Equal times are numbered individually, like the reference's sort-then-count.
    """
    x = df.select(spec.label, F.col(spec.time).cast("double").alias("_t"))
    r = prefix_rank(x, "_t", [spec.label], rank_col="_i", total_col="_n")
    if zero_based:
        share = F.when(F.col("_n") > 1, (F.col("_i") - 1) / (F.col("_n") - 1) * 100).otherwise(F.lit(0.0))
    else:
        share = F.col("_i") / F.col("_n") * 100
    return r.select(
        spec.label,
        F.col("_t").alias(spec.time),
        (F.col("_t") / 3600).alias("hours"),
        F.col("_i").alias("seq"),
        share.alias("cum_pct"),
    )


def velocity_flags(
    df: DataFrame,
    entity: str,
    ts: str,
    max_events: int = 2,
    within_seconds: int = 300,
) -> DataFrame:
    """Batch twin of the streaming velocity rule: events that are at least the
    (max_events+1)-th within ``within_seconds`` for the same entity.

    Exact ``lag(ts, max_events)`` in each entity's time order, computed
    two-level (:func:`txnlens.plans.ordered.previous_k`) so that an entity with
    a large share of all events is spread over many tasks.
    """
    x = df.withColumn("_t", F.col(ts).cast("timestamp").cast("double"))
    x = previous_k(x, "_t", [entity], max_events, out="_prev_k")
    return x.where(F.col("_prev_k").isNotNull() & (F.col("_t") - F.col("_prev_k") < within_seconds)).drop("_t", "_prev_k")
