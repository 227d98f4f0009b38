"""Profiling report of a raw table (IO-4/5, AG-1..11, AG-22, SO-1/2).

Per-column statistics are computed in *long* form: the columns are unpivoted
to ``(column, value)`` and aggregated by ``column``. That is one scan, partial
aggregation on the map side, a shuffle of (#columns) rows, and it keeps
whole-stage codegen regardless of how wide the table is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from txnlens.functions.columns import nan_to_null, pct, pearson, sample_kurt, sample_skew
from txnlens.plans.ordered import exact_quantiles, quantiles_wide  # noqa: F401
from txnlens.plans.small import with_params
from txnlens.spec import TxnSpec


def _q(c: str):
    return F.col(f"`{c}`")


def to_long(df: DataFrame, cols: Sequence[str], label: str | None = None) -> DataFrame:
    """Unpivot ``cols`` (cast to double, NaN -> NULL) to ``(column, value, col_idx)``; ``label`` is kept as ``_lbl``."""
    carry = [] if label is None else [_q(label).alias("_lbl")]
    wide = df.select(*carry, *[nan_to_null(_q(c).cast("double")).alias(c) for c in cols])
    long = wide.unpivot(["_lbl"] if carry else [], list(cols), "column", "value")
    order = F.element_at(F.create_map(*[F.lit(x) for i, c in enumerate(cols) for x in (c, i)]), F.col("column"))
    return long.withColumn("col_idx", order)


def shape(df: DataFrame) -> DataFrame:
    """(rows, columns) of a table."""
    return df.agg(F.count(F.lit(1)).alias("rows")).withColumn("columns", F.lit(len(df.columns)))


def dtype_counts(spark: SparkSession, df: DataFrame) -> DataFrame:
    """Number of columns per data type (schema metadata only, no data pass)."""
    counts: dict[str, int] = {}
    for _, t in df.dtypes:
        counts[t] = counts.get(t, 0) + 1
    return spark.createDataFrame(sorted(counts.items()), "dtype string, n_columns long")


def missing_report(df: DataFrame, cols: Sequence[str] | None = None, keep_zero: bool = False) -> DataFrame:
    """Missing (NULL or NaN) count and percent per column, in one aggregate."""
    cols = list(cols or df.columns)
    aggs = [F.count(F.lit(1)).alias("_n")]
    for c in cols:
        miss = _q(c).isNull()
        if isinstance(df.schema[c].dataType, (DoubleType, FloatType)):
            miss = miss | F.isnan(_q(c))
        aggs.append(F.count_if(miss).alias(c))
    wide = df.agg(*aggs)
    long = wide.unpivot(["_n"], cols, "column", "missing_count")
    out = long.select(
        "column",
        "missing_count",
        pct(F.col("missing_count"), F.col("_n")).alias("missing_pct"),
    )
    return out if keep_zero else out.where(F.col("missing_count") > 0)


def duplicate_report(df: DataFrame) -> DataFrame:
    """Rows, distinct rows, duplicate rows (all columns compared; NULL equals NULL).

    One grouping over all columns; the map-side partial aggregate collapses
    copies before the shuffle, so a heavily duplicated row costs one record.
    """
    g = df.groupBy(*[_q(c) for c in df.columns]).agg(F.count(F.lit(1)).alias("_c"))
    return g.agg(
        F.sum("_c").cast("long").alias("rows"),
        F.count(F.lit(1)).cast("long").alias("distinct_rows"),
    ).select(
        "rows",
        "distinct_rows",
        (F.col("rows") - F.col("distinct_rows")).alias("duplicates"),
        pct(F.col("rows") - F.col("distinct_rows"), F.col("rows")).alias("duplicate_pct"),
    )


def label_distribution(df: DataFrame, label: str = "Class") -> DataFrame:
    """Count and percent per label value, ordered by label."""
    g = df.groupBy(label).agg(F.count(F.lit(1)).alias("count"))
    # at most a handful of label values: the share window runs over a tiny result
    return g.select(
        label, "count", pct(F.col("count"), F.sum("count").over(Window.partitionBy())).alias("percent")
    ).orderBy(label)


def imbalance_ratio(df: DataFrame, label: str = "Class") -> DataFrame:
    """Negatives, positives and the negatives-per-positive ratio."""
    lbl = F.col(label)
    return df.agg(
        F.count_if(lbl == 0).alias("negatives"), F.count_if(lbl == 1).alias("positives")
    ).select(
        "negatives",
        "positives",
        F.try_divide(F.col("negatives").cast("double"), F.col("positives").cast("double")).alias("ratio"),
    )


def describe_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """count, mean, std (ddof=1), min, quartiles (exact), max, range, cv% per column."""
    long = to_long(df, cols)
    base = long.groupBy("column", "col_idx").agg(
        F.count("value").alias("count"),
        F.avg("value").alias("mean"),
        F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"),
        F.max("value").alias("max"),
    )
    qs = quantiles_wide(long, "value", [0.25, 0.5, 0.75], ["q25", "q50", "q75"], by=["column"], max_groups=len(cols))
    out = base.join(qs, "column", "left")
    return out.select(
        "column",
        "col_idx",
        "count",
        "mean",
        "std",
        "min",
        "q25",
        "q50",
        "q75",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        F.when(F.col("mean") != 0, F.col("std") / F.col("mean") * 100).alias("cv_pct"),
    )


def column_profile(df: DataFrame, col: str) -> DataFrame:
    """n, mean, median (exact), std, min, max, sample skewness of one column."""
    x = df.select(nan_to_null(F.col(col).cast("double")).alias("v"))
    med = quantiles_wide(x, "v", [0.5], ["median"])
    base = x.agg(
        F.count("v").alias("n"),
        F.avg("v").alias("mean"),
        F.stddev_samp("v").alias("std"),
        F.min("v").alias("min"),
        F.max("v").alias("max"),
        F.skewness("v").alias("_g1"),
    )
    return with_params(base, med, "_m").select(
        "n", "mean", F.col("_m.median").alias("median"), "std", "min", "max", sample_skew(F.col("_g1"), F.col("n")).alias("skew")
    )


def time_span(df: DataFrame, time: str = "Time") -> DataFrame:
    """Min / max of the event time in seconds and hours, span in days."""
    return df.agg(F.min(time).cast("double").alias("min_s"), F.max(time).cast("double").alias("max_s")).select(
        "min_s",
        "max_s",
        (F.col("min_s") / 3600).alias("min_h"),
        (F.col("max_s") / 3600).alias("max_h"),
        (F.col("max_s") / 3600 / 24).alias("span_days"),
    )


def amount_by_label(df: DataFrame, amount: str = "Amount", label: str = "Class") -> DataFrame:
    """mean, median (exact), max, std of the amount per label."""
    v = nan_to_null(F.col(amount).cast("double"))
    x = df.select(F.col(label), v.alias("v"))
    base = x.groupBy(label).agg(
        F.avg("v").alias("mean"), F.max("v").alias("max"), F.stddev_samp("v").alias("std")
    )
    med = quantiles_wide(x, "v", [0.5], ["median"], by=[label])
    return base.join(med, label, "left").select(label, "mean", "median", "max", "std")


def skew_before_after(df: DataFrame, before: str = "Amount", after: str = "Amount_log") -> DataFrame:
    """Sample skewness of the raw column and of its capped and logged form, in one aggregate."""
    both = [nan_to_null(_q(c).cast("double")) for c in (before, after)]
    x = df.select(both[0].alias("a"), both[1].alias("b")).agg(
        F.skewness("a").alias("ga"), F.count("a").alias("na"), F.skewness("b").alias("gb"), F.count("b").alias("nb")
    )
    return x.select(
        sample_skew(F.col("ga"), F.col("na")).alias("skew_before"),
        sample_skew(F.col("gb"), F.col("nb")).alias("skew_after"),
    )


def zero_amount_report(df: DataFrame, amount: str = "Amount", label: str = "Class") -> DataFrame:
    """Zero-amount rows: count, percent of all rows, positives among them."""
    z = F.col(amount) == 0
    return df.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(z).alias("zero_count"),
        F.coalesce(F.sum(F.when(z, F.col(label))), F.lit(0)).cast("long").alias("zero_positives"),
    ).select("zero_count", pct(F.col("zero_count"), F.col("_n")).alias("zero_pct"), "zero_positives")


def moments(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Sample-adjusted skewness and excess kurtosis per column (pandas ``skew``/``kurt``)."""
    long = to_long(df, cols)
    g = long.groupBy("column", "col_idx").agg(
        F.count("value").alias("n"), F.skewness("value").alias("_g1"), F.kurtosis("value").alias("_g2")
    )
    return g.select(
        "column",
        "col_idx",
        sample_skew(F.col("_g1"), F.col("n")).alias("skewness"),
        sample_kurt(F.col("_g2"), F.col("n")).alias("kurtosis"),
    )


def moments_topk(df: DataFrame, cols: Sequence[str], k: int = 10, decimals: int = 4) -> DataFrame:
    """Top-k columns by |skewness| (values rounded first, ties in column order)."""
    m = moments(df, cols).select(
        "column",
        "col_idx",
        F.bround("skewness", decimals).alias("skewness"),
        F.bround("kurtosis", decimals).alias("kurtosis"),
    )
    return m.orderBy(F.abs("skewness").desc_nulls_last(), "col_idx").limit(k)


def label_correlations(df: DataFrame, cols: Sequence[str], label: str = "Class") -> DataFrame:
    """Pearson correlation of each column with the label (pairwise complete) and its sign flag."""
    corr = to_long(df, cols, label).groupBy("column", "col_idx").agg(pearson("value", "_lbl").alias("corr"))
    return corr.withColumn("negative", F.col("corr") < 0)


def correlation_topk(df: DataFrame, cols: Sequence[str], label: str = "Class", k: int = 10) -> DataFrame:
    """Top-k correlations with the label by absolute value (signed values kept)."""
    c = label_correlations(df, cols, label).drop("negative")
    return c.orderBy(F.abs("corr").desc_nulls_last(), "col_idx").limit(k)


def iqr_outliers(df: DataFrame, cols: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartiles, 1.5-IQR fences and counts strictly outside them, per column."""
    long = to_long(df, cols)
    qs = quantiles_wide(long, "value", [0.25, 0.75], ["q1", "q3"], by=["column"], max_groups=len(cols)).select(
        "column",
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"),
    )
    # one row per column: bounded by the table width
    j = long.join(F.broadcast(qs), "column")
    counts = j.groupBy("column", "col_idx", "q1", "q3", "iqr", "lower", "upper").agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(F.col("value") < F.col("lower")).alias("n_low"),
        F.count_if(F.col("value") > F.col("upper")).alias("n_high"),
    )
    return counts.select(
        "column",
        "col_idx",
        "q1",
        "q3",
        "iqr",
        "lower",
        "upper",
        "n_low",
        "n_high",
        (F.col("n_low") + F.col("n_high")).alias("n_outliers"),
        pct(F.col("n_low") + F.col("n_high"), F.col("_n")).alias("outlier_pct"),
    )


__all__ = [
    "amount_by_label",
    "column_profile",
    "correlation_topk",
    "describe_columns",
    "dtype_counts",
    "duplicate_report",
    "exact_quantiles",
    "imbalance_ratio",
    "iqr_outliers",
    "label_correlations",
    "label_distribution",
    "missing_report",
    "moments",
    "moments_topk",
    "shape",
    "skew_before_after",
    "time_span",
    "to_long",
    "zero_amount_report",
    "TxnSpec",
]
