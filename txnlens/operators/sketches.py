"""Mergeable quantile sketches: the approximate form of AG-5, AG-9, AG-10, AG-29 and AG-30.

Spark's KLL sketches are built once per group and part of the data, stored, and
merged; quantiles of any probability come from the merged sketch without a scan.
A sketch of ``k`` returns a value whose rank differs from the asked one by at most
``rank_error(k)`` of the rows, with about 99 % confidence for each probability.
Its size does not grow with the rows (some 3 k values).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from txnlens.functions.columns import nan_to_null

K = 2048


def rank_error(k: int = K) -> float:
    """The published rank error of a KLL sketch (a fit to its measured 99 % quantile)."""
    return 2.296 / k**0.9021


def sketch_columns(df: DataFrame, cols: Sequence[str], by: Sequence[str] = (), k: int = K) -> DataFrame:
    """``(*by, column, n, min, max, mean, m2, sketch)``: one wide pass, one row a group and column.

    ``m2`` is the sum of squared deviations, so that means and variances merge too.
    """
    # a group column may be one of the sketched ones
    values = [nan_to_null(F.col(f"`{c}`").cast("double")).alias(f"_v{i}") for i, c in enumerate(cols)]
    x = df.select(*[F.col(c) for c in by], *values)
    held = lambda c, v: F.struct(
        F.lit(c).alias("column"),
        F.count(v).alias("n"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        (F.var_pop(v) * F.count(v)).alias("m2"),
        F.kll_sketch_agg_double(v, k).alias("sketch"),
    )
    wide = x.groupBy(*by).agg(F.array(*[held(c, f"_v{i}") for i, c in enumerate(cols)]).alias("_all"))
    return wide.select(*by, F.inline("_all")).where("n > 0")


def merge_sketches(parts: DataFrame, by: Sequence[str] = (), k: int = K) -> DataFrame:
    """The sketches of all parts of each group and column as one."""
    n = F.col("n").cast("double")
    own = Window.partitionBy(*by, "column")  # a row a part
    mean = F.sum(n * F.col("mean")).over(own) / F.sum(n).over(own)
    return (
        parts.withColumn("_mean", mean)
        .groupBy(*by, "column")
        .agg(
            F.sum("n").alias("n"),
            F.min("min").alias("min"),
            F.max("max").alias("max"),
            F.first("_mean").alias("mean"),
            # within the parts, and of their means around the whole mean
            F.sum(F.col("m2") + n * F.pow(F.col("mean") - F.col("_mean"), 2)).alias("m2"),
            F.kll_merge_agg_double("sketch", k).alias("sketch"),
        )
    )


def sketch_quantiles(sketches: DataFrame, probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The sketch rows with a column for every probability."""
    at = lambda p: F.kll_sketch_get_quantile_double("sketch", F.lit(float(p)))
    return sketches.select("*", *[at(p).alias(n) for p, n in zip(probs, names, strict=True)])


def describe_sketched(sketches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """AG-5 from stored sketches: exact count, mean, std, min and max, quartiles within :func:`rank_error`."""
    q = sketch_quantiles(sketches, [0.25, 0.5, 0.75], ["q25", "q50", "q75"])
    std = F.when(F.col("n") > 1, F.sqrt(F.col("m2") / (F.col("n") - 1)))
    return q.select(*by, "column", F.col("n").alias("count"), "mean", std.alias("std"), "min", "q25", "q50", "q75", "max")


def with_rank_check(long: DataFrame, described: DataFrame, bound: float) -> DataFrame:
    """``described`` without its quartiles, and whether each lies within ``bound`` of its rank in the rows ``long``."""
    q = ("q25", "q50", "q75")
    # one described row a column
    j = long.join(F.broadcast(described.select("column", *q)), "column")
    ranks = j.groupBy("column").agg(
        F.count("value").alias("_n"),
        *[F.count_if(F.col("value") < F.col(c)).alias(f"_lt_{c}") for c in q],
        *[F.count_if(F.col("value") <= F.col(c)).alias(f"_le_{c}") for c in q],
    )
    within = F.lit(True)
    for c, p in zip(q, (0.25, 0.5, 0.75), strict=True):
        within = within & (F.col(f"_lt_{c}") <= (p + bound) * F.col("_n")) & (F.col(f"_le_{c}") >= (p - bound) * F.col("_n"))
    checked = ranks.select("column", within.alias("within_bound"))
    return described.drop(*q).join(checked, "column")
