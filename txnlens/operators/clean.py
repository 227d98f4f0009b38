"""Cleaning (SO-4, PR-4..6, AG-9, RS-1): dedup, zero flag, IQR capping, log, scaling.

Fitted values (fences, mean/std) are one-row aggregates, packed into a struct
and joined to every row (see txnlens.plans.small.with_params).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from txnlens.functions.columns import clip, nans_to_nulls
from txnlens.plans.ordered import quantiles_wide
from txnlens.plans.small import with_params
from txnlens.plans.stage import write_table
from txnlens.spec import TxnSpec


MAX_REPEATED = 2_000_000


def dedupe(df: DataFrame, max_repeated: int = MAX_REPEATED) -> DataFrame:
    """Drop exact duplicate rows (all columns); equal rows are interchangeable.

    Only hashes of the rows are shuffled: a row whose hash occurs once has no
    duplicate and stays where it is, and the rows of the other hashes are grouped
    by all columns. Beyond ``max_repeated`` such hashes (written and counted before
    they are broadcast) every row is grouped.
    """
    # -0.0 becomes 0.0, as grouping has it
    x = df.select(
        *[
            (F.col(f"`{f.name}`") + F.lit(0.0)).cast(f.dataType).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )
    h = F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])
    again = x.select(h.alias("_row_hash")).groupBy("_row_hash").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1")
    again = write_table(again.select("_row_hash"), "dedup-hashes")
    if again.count() > max_repeated:
        return df.dropDuplicates()
    x, again = x.withColumn("_row_hash", h), F.broadcast(again)
    once = x.join(again, "_row_hash", "left_anti").drop("_row_hash")
    return once.unionByName(x.join(again, "_row_hash", "left_semi").drop("_row_hash").dropDuplicates())


def iqr_fences(df: DataFrame, col: str, k: float = 1.5) -> DataFrame:
    """One row: q1, q3, iqr, lower, upper fences of ``col`` (exact quartiles)."""
    q = quantiles_wide(df.select(F.col(col).cast("double").alias("v")), "v", [0.25, 0.75], ["q1", "q3"])
    return q.select(
        "q1",
        "q3",
        (F.col("q3") - F.col("q1")).alias("iqr"),
        (F.col("q1") - k * (F.col("q3") - F.col("q1"))).alias("lower"),
        (F.col("q3") + k * (F.col("q3") - F.col("q1"))).alias("upper"),
    )


def capping_report(df: DataFrame, col: str = "Amount", k: float = 1.5) -> DataFrame:
    """Fences plus the number of rows below / above them."""
    f = iqr_fences(df, col, k)
    x = with_params(df.select(F.col(col).cast("double").alias("v")), f)
    return x.agg(
        F.first("_p.q1").alias("q1"),
        F.first("_p.q3").alias("q3"),
        F.first("_p.iqr").alias("iqr"),
        F.first("_p.lower").alias("lower"),
        F.first("_p.upper").alias("upper"),
        F.count_if(F.col("v") < F.col("_p.lower")).alias("n_low"),
        F.count_if(F.col("v") > F.col("_p.upper")).alias("n_high"),
    )


def standard_params(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Scaler parameters (one row per column): mean and population std.

    A zero or undefined std is replaced by 1, so constant columns are only
    centred (the convention of the common scikit-style scaler).
    """
    from txnlens.operators.profile import to_long

    long = to_long(df, cols)
    g = long.groupBy("column").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("_sd"))
    return g.select(
        "column",
        "mean",
        F.when(F.col("_sd").isNull() | (F.col("_sd") == 0), F.lit(1.0)).otherwise(F.col("_sd")).alias("scale"),
    )


def apply_standard(df: DataFrame, params: DataFrame, cols: Sequence[str], suffix: str = "") -> DataFrame:
    """Apply scaler parameters from :func:`standard_params` (fitted on any frame).

    The parameter table has one row per scaled column (bounded by the schema);
    it is folded into one struct and joined as one broadcast row.
    """
    packed = params.agg(
        *[
            F.max(F.when(F.col("column") == c, F.struct(F.col("mean").alias("m"), F.col("scale").alias("s")))).alias(
                f"c{i}"
            )
            for i, c in enumerate(cols)
        ]
    )
    x = with_params(df, packed, "_sc")
    out = []
    for name in df.columns:
        if name in cols:
            i = list(cols).index(name)
            v = (F.col(f"`{name}`").cast("double") - F.col(f"_sc.c{i}.m")) / F.col(f"_sc.c{i}.s")
            out.append(v.alias(name + suffix) if suffix else v.alias(name))
            if suffix:
                out.append(F.col(f"`{name}`"))
        else:
            out.append(F.col(f"`{name}`"))
    return x.select(*out)


def clean(
    df: DataFrame, spec: TxnSpec = TxnSpec(), k: float = 1.5, nan_to_null: bool = True, materialize_dedup: bool = True
) -> DataFrame:
    """Raw table -> cleaned table.

    Adds ``is_zero_amount``, ``Amount_capped`` (clipped to [max(lower, 0), upper]),
    ``Amount_log`` = log1p(capped) and ``Time_scaled`` (standardised over the
    cleaned table, population std), after removing exact duplicate rows.
    """
    a, t = spec.amount, spec.time
    x = nans_to_nulls(df) if nan_to_null else df
    # The de-duplicated table feeds the fences, the time statistics and the
    # output. Column pruning makes those branches' plans differ, so Spark would
    # run the all-column dedup shuffle once per branch; writing it once to the
    # shared checkpoint folder runs it exactly once and cuts the lineage.
    x = write_table(dedupe(x), "dedup") if materialize_dedup else dedupe(x)
    fences = iqr_fences(x, a, k)
    tstats = x.agg(F.avg(F.col(t).cast("double")).alias("t_mean"), F.stddev_pop(F.col(t).cast("double")).alias("t_sd"))
    x = with_params(x, fences.select("lower", "upper"), "_f")
    x = with_params(x, tstats, "_t")
    amt = F.col(a).cast("double")
    capped = clip(amt, F.greatest(F.col("_f.lower"), F.lit(0.0)), F.col("_f.upper"))
    sd = F.col("_t.t_sd")
    scale = F.when(sd.isNull() | (sd == 0), F.lit(1.0)).otherwise(sd)
    return x.select(
        *[F.col(f"`{c}`") for c in df.columns],
        F.coalesce((F.col(a) == 0).cast("int"), F.lit(0)).alias("is_zero_amount"),
        capped.alias("Amount_capped"),
        F.log1p(capped).alias("Amount_log"),
        ((F.col(t).cast("double") - F.col("_t.t_mean")) / scale).alias("Time_scaled"),
    )
