"""Positive rate and money exposure by hour, day and amount band (AG-12..21, JN-1/2, FL-3).

Every breakdown is a single ``groupBy`` with conditional aggregates (partial
aggregation map-side, a shuffle of at most #groups rows per partition). Key
domains are tiny and fixed (24 hours, 7 bands, 2 labels, a few days), so the
windows that compute shares or reference levels run over small results only.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlens.plans.small import with_params
from txnlens.spec import TxnSpec


def _lbl(spec: TxnSpec):
    return F.col(spec.label)


def rate_by(df: DataFrame, keys: Sequence[str], spec: TxnSpec = TxnSpec()) -> DataFrame:
    """positives, total, negatives and positive rate (%) per group of ``keys``."""
    lbl = _lbl(spec)
    g = df.groupBy(*keys).agg(
        F.count_if(lbl == 1).alias("positives"),
        F.count(F.lit(1)).alias("total"),
    )
    return g.select(
        *keys,
        "positives",
        "total",
        (F.col("total") - F.col("positives")).alias("negatives"),
        (F.col("positives") / F.col("total") * 100).alias("rate_pct"),
    )


def rate_by_hour(df: DataFrame, spec: TxnSpec = TxnSpec(), hour: str = "Hour") -> DataFrame:
    return rate_by(df, [hour], spec)


def peak(rates: DataFrame, key: str = "Hour", rate: str = "rate_pct") -> DataFrame:
    """Group with the highest rate; ties go to the smallest key (argmax order)."""
    return rates.orderBy(F.col(rate).desc_nulls_last(), F.col(key).asc()).limit(1).select(key, rate)


def volume_by_hour(df: DataFrame, spec: TxnSpec = TxnSpec(), hour: str = "Hour", parity: bool = False) -> DataFrame:
    """Negatives and positives per hour.

    Default: one ``groupBy`` (hours with only positives are kept). ``parity=True``
    reproduces the left join from the negatives' hours (those hours are lost).
    """
    lbl = _lbl(spec)
    if not parity:
        return df.groupBy(hour).agg(
            F.count_if(lbl == 0).alias("negatives"), F.count_if(lbl == 1).alias("positives")
        )
    neg = df.where(lbl == 0).groupBy(hour).agg(F.count(F.lit(1)).alias("negatives"))
    pos = df.where(lbl == 1).groupBy(hour).agg(F.count(F.lit(1)).alias("positives"))
    # both sides have at most 24 rows (hour of day)
    return neg.join(F.broadcast(pos), hour, "left").fillna(0, subset=["positives"])


def hour_spine(spark: SparkSession, df: DataFrame, spec: TxnSpec = TxnSpec(), hour: str = "Hour") -> DataFrame:
    """All 24 hours with zeros filled, plus above-mean / above-median flags.

    The mean is over all 24 hours (missing hours count as 0); the median is
    over the hours that have rows, as in the reference's two charts.
    """
    r = rate_by(df, [hour], spec)
    spine = spark.range(24).select(F.col("id").cast("int").alias(hour))
    j = spine.join(F.broadcast(r), hour, "left").fillna(0)
    j = with_params(j, r.agg(F.median("rate_pct").alias("m")), "_med")  # median over <= 24 rows
    allw = Window.partitionBy()  # over the 24-row spine only
    return j.select(
        hour,
        "positives",
        "total",
        "negatives",
        "rate_pct",
        (F.col("rate_pct") > F.avg("rate_pct").over(allw)).alias("above_mean"),
        (F.col("rate_pct") > F.col("_med.m")).alias("above_median"),
    )


def rate_by_band(df: DataFrame, spec: TxnSpec = TxnSpec(), ord_col: str = "Amount_band_ord", name_col: str = "Amount_band") -> DataFrame:
    """Per observed band: positives, total, rate %, exposure of positives, above-mean flag."""
    lbl = _lbl(spec)
    amt = F.col(spec.amount).cast("double")
    g = df.where(F.col(ord_col).isNotNull()).groupBy(ord_col, name_col).agg(
        F.count_if(lbl == 1).alias("positives"),
        F.count(F.lit(1)).alias("total"),
        F.coalesce(F.sum(F.when(lbl == 1, amt)), F.lit(0.0)).alias("exposure"),
    )
    g = g.withColumn("rate_pct", F.col("positives") / F.col("total") * 100)
    return g.select(
        ord_col,
        name_col,
        "positives",
        "total",
        "rate_pct",
        "exposure",
        # <= 7 rows: the reference level is the unweighted mean of band rates
        (F.col("rate_pct") > F.avg("rate_pct").over(Window.partitionBy())).alias("above_mean"),
    )


def exposure_by_band(df: DataFrame, spec: TxnSpec = TxnSpec(), ord_col: str = "Amount_band_ord", name_col: str = "Amount_band") -> DataFrame:
    """Positives only, per band: exposure (sum), cases, average amount."""
    amt = F.col(spec.amount).cast("double")
    return (
        df.where((_lbl(spec) == 1) & F.col(ord_col).isNotNull())
        .groupBy(ord_col, name_col)
        .agg(F.sum(amt).alias("exposure"), F.count(F.lit(1)).alias("cases"), F.avg(amt).alias("avg_amount"))
    )


def band_composition(df: DataFrame, spec: TxnSpec = TxnSpec(), ord_col: str = "Amount_band_ord") -> DataFrame:
    """(band, label) count and amount total with band and grand totals (ROLLUP)."""
    amt = F.col(spec.amount).cast("double")
    x = df.where(F.col(ord_col).isNotNull())
    r = x.rollup(ord_col, spec.label).agg(
        F.count(F.lit(1)).alias("count"),
        F.sum(amt).alias("amount_total"),
        F.grouping_id().alias("level"),
    )
    return r


def day_crosstab(df: DataFrame, spec: TxnSpec = TxnSpec(), day: str = "Day_label") -> DataFrame:
    """Per day: negatives, positives, rate % (explicit label values, NULL day dropped)."""
    p = df.where(F.col(day).isNotNull()).groupBy(day).pivot(spec.label, [0, 1]).count().fillna(0)
    return p.select(
        day,
        F.col("0").alias("negatives"),
        F.col("1").alias("positives"),
        (F.col("1") / (F.col("0") + F.col("1")) * 100).alias("rate_pct"),
    )


def range_exposure(df: DataFrame, lo: float, hi: float, spec: TxnSpec = TxnSpec()) -> DataFrame:
    """Positives with lo <= amount <= hi (inclusive, unlike the right-closed bands): count and exposure."""
    amt = F.col(spec.amount).cast("double")
    sel = (_lbl(spec) == 1) & amt.between(float(lo), float(hi))
    return df.agg(
        F.count_if(sel).alias("positives"),
        F.coalesce(F.sum(F.when(sel, amt)), F.lit(0.0)).alias("exposure"),
    ).select(F.lit(float(lo)).alias("lo"), F.lit(float(hi)).alias("hi"), "positives", "exposure")


def exposure_summary(df: DataFrame, spec: TxnSpec = TxnSpec()) -> DataFrame:
    """Total, mean and max amount of positives and of negatives (empty sums are 0)."""
    lbl, amt = _lbl(spec), F.col(spec.amount).cast("double")
    p, n = lbl == 1, lbl == 0
    return df.agg(
        F.count_if(p).alias("pos_count"),
        F.coalesce(F.sum(F.when(p, amt)), F.lit(0.0)).alias("pos_total"),
        F.avg(F.when(p, amt)).alias("pos_mean"),
        F.max(F.when(p, amt)).alias("pos_max"),
        F.count_if(n).alias("neg_count"),
        F.coalesce(F.sum(F.when(n, amt)), F.lit(0.0)).alias("neg_total"),
        F.avg(F.when(n, amt)).alias("neg_mean"),
        F.max(F.when(n, amt)).alias("neg_max"),
    )


def day_night_split(df: DataFrame, spec: TxnSpec = TxnSpec(), hour: str = "Hour", start: int = 8, end: int = 19) -> DataFrame:
    """Positives in daytime (start <= hour <= end, inclusive) and at night, counts and %."""
    p = _lbl(spec) == 1
    day = F.col(hour).between(start, end)
    g = df.agg(
        F.count_if(p).alias("positives"),
        F.count_if(p & day).alias("day_positives"),
        F.count_if(p & ~day).alias("night_positives"),
        F.count_if(day).alias("day_total"),
        F.count_if(~day).alias("night_total"),
    )
    return g.select(
        "positives",
        "day_positives",
        "night_positives",
        F.try_divide(F.col("day_positives") * 100.0, F.col("positives").cast("double")).alias("day_pct"),
        F.try_divide(F.col("night_positives") * 100.0, F.col("positives").cast("double")).alias("night_pct"),
        "day_total",
        "night_total",
    )


SCORECARD_METRICS = (
    "total_transactions",
    "positives",
    "positive_rate_pct",
    "imbalance_ratio",
    "total_exposure",
    "avg_positive_amount",
    "avg_negative_amount",
    "max_positive_amount",
    "zero_amount_positives",
    "peak_hour",
    "peak_hour_rate_pct",
    "day_positives",
    "night_positives",
)


def scorecard(df: DataFrame, spec: TxnSpec = TxnSpec(), hour: str = "Hour", peak_from: DataFrame | None = None) -> DataFrame:
    """KPI table (metric, value DOUBLE) in a fixed metric order.

    ``peak_from`` is the frame the peak hour is taken from (the interactive
    report uses the unfiltered table while the other KPIs are filtered).
    """
    lbl, amt = _lbl(spec), F.col(spec.amount).cast("double")
    p, n = lbl == 1, lbl == 0
    day = F.col(hour).between(8, 19)
    # an ungrouped aggregate is one row also when there are no hours; ties take the first hour
    by_hour = rate_by(peak_from if peak_from is not None else df, [hour], spec)
    best = F.max(F.struct(F.col("rate_pct").alias("r"), (-F.col(hour)).alias("h")))
    pk1 = by_hour.agg(best.alias("b")).select((-F.col("b.h")).cast("double").alias("h"), F.col("b.r").alias("r"))
    g = df.agg(
        F.count(F.lit(1)).cast("double").alias("total_transactions"),
        F.count_if(p).cast("double").alias("positives"),
        (F.try_divide(F.count_if(p), F.count(F.lit(1))) * 100).alias("positive_rate_pct"),
        F.try_divide(F.count_if(n).cast("double"), F.count_if(p).cast("double")).alias("imbalance_ratio"),
        F.coalesce(F.sum(F.when(p, amt)), F.lit(0.0)).alias("total_exposure"),
        F.avg(F.when(p, amt)).alias("avg_positive_amount"),
        F.avg(F.when(n, amt)).alias("avg_negative_amount"),
        F.max(F.when(p, amt)).alias("max_positive_amount"),
        F.count_if(p & (amt == 0)).cast("double").alias("zero_amount_positives"),
        F.count_if(p & day).cast("double").alias("day_positives"),
        F.count_if(p & ~day).cast("double").alias("night_positives"),
    )
    return _scorecard_rows(g, pk1)


def scorecard_of(measures: DataFrame, peak_from: DataFrame, spec: TxnSpec = TxnSpec(), hour: str = "Hour") -> DataFrame:
    """:func:`scorecard` from measures by hour and label (``n``, ``n_amount``, ``total``, ``most``, ``zeros``)."""
    lbl = _lbl(spec)
    p, n = lbl == 1, lbl == 0
    day = F.col(hour).between(8, 19)
    total = lambda c, when=None: F.coalesce(F.sum(F.col(c) if when is None else F.when(when, F.col(c))), F.lit(0))
    by_hour = peak_from.groupBy(hour).agg(total("n").alias("n"), total("n", p).alias("positives"))
    rate = F.col("positives") / F.col("n") * 100
    best = by_hour.agg(F.max(F.struct(rate.alias("r"), (-F.col(hour)).alias("h"))).alias("b"))
    pk1 = best.select((-F.col("b.h")).cast("double").alias("h"), F.col("b.r").alias("r"))
    mean = lambda when: F.try_divide(F.sum(F.when(when, F.col("total"))), total("n_amount", when).cast("double"))
    g = measures.agg(
        total("n").cast("double").alias("total_transactions"),
        total("n", p).cast("double").alias("positives"),
        (F.try_divide(total("n", p), total("n")) * 100).alias("positive_rate_pct"),
        F.try_divide(total("n", n).cast("double"), total("n", p).cast("double")).alias("imbalance_ratio"),
        F.coalesce(F.sum(F.when(p, F.col("total"))), F.lit(0.0)).alias("total_exposure"),
        mean(p).alias("avg_positive_amount"),
        mean(n).alias("avg_negative_amount"),
        F.max(F.when(p, F.col("most"))).alias("max_positive_amount"),
        total("zeros", p).cast("double").alias("zero_amount_positives"),
        total("n", p & day).cast("double").alias("day_positives"),
        total("n", p & ~day).cast("double").alias("night_positives"),
    )
    return _scorecard_rows(g, pk1)


def _scorecard_rows(g: DataFrame, pk1: DataFrame) -> DataFrame:
    """The one-row metrics and peak as ``(ord, metric, value)``."""
    # no rows, or no positives: zeros, as in the interactive report; a ratio or mean over no rows stays NULL
    undefined = ("imbalance_ratio", "avg_negative_amount")
    zero = lambda c: F.col(c) if c in undefined else F.coalesce(F.col(c), F.lit(0.0))
    g = with_params(g, pk1, "_pk").select(
        *[zero(c).alias(c) for c in SCORECARD_METRICS if c not in ("peak_hour", "peak_hour_rate_pct")],
        zero("_pk.h").alias("peak_hour"),
        zero("_pk.r").alias("peak_hour_rate_pct"),
    )
    order = F.create_map(*[x for i, m in enumerate(SCORECARD_METRICS) for x in (F.lit(m), F.lit(i))])
    return g.unpivot([], list(SCORECARD_METRICS), "metric", "value").select(
        F.element_at(order, F.col("metric")).alias("ord"), "metric", "value"
    )


@dataclass(frozen=True)
class TxnFilter:
    """Interactive filter: day labels, inclusive hour range, maximum amount.

    ``max_amount=None`` means the column maximum (no amount restriction).
    """

    days: tuple[str, ...] = ("Day 1", "Day 2")
    hours: tuple[int, int] = (0, 23)
    max_amount: float | None = None
    day_col: str = "Day_label"
    hour_col: str = "Hour"
    amount_col: str = "Amount"

    def predicate(self):
        cond = F.col(self.day_col).isin(*self.days) & F.col(self.hour_col).between(*self.hours)
        if self.max_amount is not None:
            cond = cond & (F.col(self.amount_col) <= F.lit(float(self.max_amount)))
        else:
            cond = cond & F.col(self.amount_col).isNotNull()
        return cond

    def apply(self, df: DataFrame) -> DataFrame:
        return df.where(self.predicate())
