"""How strongly each feature separates the labels (AG-22..29, E-5).

Features are handled in long form ``(column, value)`` so one job covers all
of them. The KS statistic needs each feature's empirical CDF in value order:
values are first collapsed to ``(column, value) -> (n0, n1)`` and the running
sums come from :func:`txnlens.plans.ordered.prefix_sums` (range buckets,
no single-partition window).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from txnlens.functions.columns import clip, nan_to_null, pearson
from txnlens.functions.kolmogorov import p_value
from txnlens.operators.profile import to_long
from txnlens.plans.ordered import prefix_sums, quantiles_wide
from txnlens.plans.small import fits, join_small
from txnlens.plans.stage import write_table
from txnlens.spec import TxnSpec

# Fixed values that must equal the reference: density grid size and bandwidth factor.
KDE_POINTS = 300
KDE_BW = 0.3
# beyond 40 bandwidths exp(-x^2/2) underflows to exactly 0.0 in float64, so
# restricting each value to grid points within that band is exact
KDE_CUTOFF = 40.0
# values are collapsed to cells of this many bandwidths, with moments up to this order
KDE_CELL = 0.25
KDE_ORDER = 12


def kolmogorov_sf(z: Column, terms: int = 20) -> Column:
    """Q_KS(z) = P(K > z) of the Kolmogorov distribution (two-sided limit).

    Uses the alternating series for z >= 1 and the Jacobi-theta form for z < 1,
    both with ``terms`` terms (far beyond double precision in their ranges).
    """
    big = sum(
        (F.lit(2.0 * (1 if k % 2 else -1)) * F.exp(F.lit(-2.0 * k * k) * z * z) for k in range(1, terms + 1)),
        F.lit(0.0),
    )
    small_sum = sum(
        (F.exp(F.lit(-((2 * k - 1) ** 2) * math.pi**2 / 8.0) / (z * z)) for k in range(1, terms + 1)),
        F.lit(0.0),
    )
    small = F.lit(1.0) - F.lit(math.sqrt(2 * math.pi)) / z * small_sum
    q = F.when(z <= 0, F.lit(1.0)).when(z < 1, small).otherwise(big)
    return F.least(F.greatest(q, F.lit(0.0)), F.lit(1.0))


@F.pandas_udf(DoubleType())
def finite_p_value(ks: pd.Series, n_neg: pd.Series, n_pos: pd.Series) -> pd.Series:
    """The p-value for finite samples; one row a feature comes here, never data rows."""
    rows = zip(ks, n_neg, n_pos, strict=True)
    return pd.Series([p_value(float(d), int(m), int(n)) for d, m, n in rows], dtype="float64")


def feature_ks(df: DataFrame, cols: Sequence[str], spec: TxnSpec = TxnSpec(), finite: bool = False) -> DataFrame:
    """Two-sample KS statistic (negatives vs positives) and p-value per feature.

    The p-value is that of the limit law or, with ``finite``, exact while both
    samples have at most ``kolmogorov.EXACT_MAX`` values and that of the finite
    two-sided law beyond.
    """
    long = to_long(df, cols, spec.label).where(F.col("value").isNotNull())
    counts = long.groupBy("column", "col_idx", "value").agg(
        F.count_if(F.col("_lbl") == 0).alias("n0"), F.count_if(F.col("_lbl") == 1).alias("n1")
    )
    # the (feature, value) count table feeds four branches (splits, bucket totals,
    # totals, ranked scan); column pruning makes their plans differ, so Spark
    # would recompute the shuffle for each - write it once instead
    counts = write_table(counts, "ks-counts")
    tot = counts.groupBy("column").agg(F.sum("n0").alias("tot0"), F.sum("n1").alias("tot1"))
    cum = prefix_sums(counts, "value", ["n0", "n1"], part_cols=["column"])
    cum = join_small(cum, tot, "column", "inner", bound=len(cols))  # one row per feature
    d = F.abs(F.col("n0_cum") / F.col("tot0") - F.col("n1_cum") / F.col("tot1"))
    ks = cum.groupBy("column", "col_idx", "tot0", "tot1").agg(F.max(d).alias("ks"))
    # in double: the product of two counts does not fit a bigint at scale
    n0, n1 = F.col("tot0").cast("double"), F.col("tot1").cast("double")
    en = n0 * n1 / (n0 + n1)
    return ks.select(
        "column",
        "col_idx",
        "ks",
        (finite_p_value("ks", "tot0", "tot1") if finite else kolmogorov_sf(F.sqrt(en) * F.col("ks"))).alias("p_value"),
        F.col("tot0").alias("n_neg"),
        F.col("tot1").alias("n_pos"),
    ).where((F.col("n_neg") > 0) & (F.col("n_pos") > 0))


def label_means(df: DataFrame, cols: Sequence[str], spec: TxnSpec = TxnSpec()) -> DataFrame:
    """Per feature: mean and sample std for negatives and positives, and correlation."""
    long = to_long(df, cols, spec.label)
    lbl = F.col("_lbl")
    return long.groupBy("column", "col_idx").agg(
        F.avg(F.when(lbl == 1, F.col("value"))).alias("pos_mean"),
        F.avg(F.when(lbl == 0, F.col("value"))).alias("neg_mean"),
        F.stddev_samp(F.when(lbl == 1, F.col("value"))).alias("pos_std"),
        F.stddev_samp(F.when(lbl == 0, F.col("value"))).alias("neg_std"),
        pearson(F.col("value"), lbl).alias("corr"),
    )


# Fixed values that must equal the reference: the radar chart's features, in order.
RADAR_FEATURES = ("V17", "V14", "V12", "V10", "V16", "V3", "V7", "V11", "V4", "V18")


def radar_profile(df: DataFrame, features: Sequence[str] = RADAR_FEATURES, spec: TxnSpec = TxnSpec()) -> DataFrame:
    """Label means min-max normalised per feature (a zero span divides by 1)."""
    m = label_means(df, features, spec)
    lo = F.least("pos_mean", "neg_mean")
    hi = F.greatest("pos_mean", "neg_mean")
    den = F.when((hi - lo) == 0, F.lit(1.0)).otherwise(hi - lo)
    return m.select(
        "column",
        "col_idx",
        "pos_mean",
        "neg_mean",
        ((F.col("pos_mean") - lo) / den).alias("pos_norm"),
        ((F.col("neg_mean") - lo) / den).alias("neg_norm"),
    )


def feature_detail(df: DataFrame, column: str, cols: Sequence[str], spec: TxnSpec = TxnSpec()) -> DataFrame:
    """JN-5: the ranking's row of one feature, computed from that column alone (``rank`` is left to the ranking)."""
    if column not in cols:
        raise ValueError(f"{column} is not one of the features")
    at = list(cols).index(column)
    return feature_ranking(df, [column], spec).withColumn("col_idx", F.lit(at))


def feature_ranking(df: DataFrame, cols: Sequence[str], spec: TxnSpec = TxnSpec()) -> DataFrame:
    """KS, p-value, correlation, label means and stds per feature, strongest first."""
    ks = feature_ks(df, cols, spec)
    m = label_means(df, cols, spec)
    return ks.join(m.drop("col_idx"), "column", "inner").orderBy(F.col("ks").desc(), "col_idx")


def _value(df: DataFrame, col: str, clip_lo: float | None, clip_hi: float | None) -> Column:
    v = nan_to_null(F.col(col).cast("double"))
    return clip(v, clip_lo, clip_hi) if (clip_lo is not None or clip_hi is not None) else v


MAX_LABELS = 10_000


def _with_label_params(df: DataFrame, params: DataFrame) -> DataFrame:
    """Attach one fitted row per label to the rows of ``df`` without moving them by label.

    The parameter table has one row per label; it is written once, its row count
    is checked, and it is broadcast, so a label with most rows is never one task.
    """
    params = write_table(params, "label-params")
    if not fits(params, MAX_LABELS):
        raise ValueError(f"more than {MAX_LABELS} labels: not a classification label")
    return df.join(F.broadcast(params), "_lbl")


def histogram_by_label(
    df: DataFrame,
    col: str,
    bins: int = 60,
    spec: TxnSpec = TxnSpec(),
    clip_lo: float | None = None,
    clip_hi: float | None = None,
) -> DataFrame:
    """Equal-width histogram per label over that label's own [min, max].

    Bins are [e_i, e_i+1) with the top edge in the last bin; all ``bins``
    rows are returned (empty bins count 0). ``density`` = count / (n * width).
    A single distinct value uses the range [v - 0.5, v + 0.5].
    """
    x = df.select(F.col(spec.label).alias("_lbl"), _value(df, col, clip_lo, clip_hi).alias("v")).where(
        F.col("v").isNotNull()
    )
    st = x.groupBy("_lbl").agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("_mn"), F.max("v").alias("_mx"))
    st = st.select(
        "_lbl",
        "n",
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mn") - 0.5).otherwise(F.col("_mn")).alias("lo"),
        F.when(F.col("_mn") == F.col("_mx"), F.col("_mx") + 0.5).otherwise(F.col("_mx")).alias("hi"),
    )
    j = _with_label_params(x, st)
    idx = F.floor((F.col("v") - F.col("lo")) * (F.lit(float(bins)) / (F.col("hi") - F.col("lo")))).cast("int")
    idx = F.least(F.greatest(idx, F.lit(0)), F.lit(bins - 1))
    counts = j.groupBy("_lbl", idx.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = st.select("_lbl", "n", "lo", "hi", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = spine.join(counts, ["_lbl", "bin"], "left").fillna(0, subset=["count"])
    width = (F.col("hi") - F.col("lo")) / bins
    return out.select(
        F.col("_lbl").alias(spec.label),
        "bin",
        (F.col("lo") + F.col("bin") * width).alias("bin_lo"),
        (F.col("lo") + (F.col("bin") + 1) * width).alias("bin_hi"),
        "count",
        (F.col("count") / (F.col("n") * width)).alias("density"),
    )


def series_error(cell: float = KDE_CELL, order: int = KDE_ORDER) -> float:
    """Bound on what the Hermite series leaves out, in units of a kernel's height.

    Cramer's inequality gives ``|He_k(u)| exp(-u^2 / 4) <= 1.0865 sqrt(k!)``, and
    ``|t| <= cell / 2``.
    """
    return 1.0865 * sum((cell / 2) ** k / math.sqrt(math.factorial(k)) for k in range(order + 1, order + 60))


def _hermite_sum(u: Column, moments: Column) -> Column:
    """``exp(-u^2 / 2) * sum_k He_k(u) m_k`` by the recurrence of the Hermite polynomials."""
    start = F.struct(
        F.lit(0.0).alias("before"), F.lit(1.0).alias("he"), F.lit(0.0).alias("k"), F.lit(0.0).alias("total")
    )

    def step(acc: Column, m: Column) -> Column:
        return F.struct(
            acc["he"].alias("before"),
            (u * acc["he"] - acc["k"] * acc["before"]).alias("he"),
            (acc["k"] + 1.0).alias("k"),
            (acc["total"] + acc["he"] * m).alias("total"),
        )

    return F.exp(F.lit(-0.5) * u * u) * F.aggregate(moments, start, step, lambda acc: acc["total"])


def density_by_label(
    df: DataFrame,
    col: str,
    spec: TxnSpec = TxnSpec(),
    grid_lo: float | None = None,
    grid_hi: float | None = None,
    clip_lo: float | None = None,
    clip_hi: float | None = None,
    points: int = KDE_POINTS,
    bw: float | None = KDE_BW,
) -> DataFrame:
    """Gaussian kernel density per label on an evenly spaced grid.

    Bandwidth = ``bw`` x sample std of the (clipped) values; ``bw=None`` is
    Scott's rule, n^(-1/5) x std. The grid is
    [grid_lo, grid_hi], or the label's own [min, max] when not given. A label with
    fewer than two rows or zero spread gets no rows.

    Values are collapsed to cells of ``KDE_CELL`` bandwidths with their moments
    about the cell's middle (one partial aggregation), and a cell's kernels are
    summed by their Hermite series: with ``u`` the distance of grid point and
    middle and ``t`` that of value and middle, in bandwidths,
    ``exp(-(u - t)^2 / 2) = exp(-u^2 / 2) * sum_k He_k(u) t^k / k!``. What is left out
    is at most :func:`series_error` of a kernel's height, so the work depends on
    the range in bandwidths, not on the number of values. A cell contributes only
    to grid points within ``KDE_CUTOFF`` bandwidths (all others are 0).
    """
    x = df.select(F.col(spec.label).alias("_lbl"), _value(df, col, clip_lo, clip_hi).alias("v")).where(
        F.col("v").isNotNull()
    )
    st = x.groupBy("_lbl").agg(
        F.count(F.lit(1)).alias("n"),
        F.stddev_samp("v").alias("_sd"),
        F.min("v").alias("_mn"),
        F.max("v").alias("_mx"),
    )
    lo = F.lit(float(grid_lo)) if grid_lo is not None else F.col("_mn")
    hi = F.lit(float(grid_hi)) if grid_hi is not None else F.col("_mx")
    factor = F.lit(bw) if bw is not None else F.pow(F.col("n").cast("double"), F.lit(-0.2))
    st = st.where((F.col("n") > 1) & (F.col("_sd") > 0)).select(
        "_lbl", "n", (F.col("_sd") * factor).alias("h"), lo.alias("lo"), hi.alias("hi")
    ).withColumn("step", (F.col("hi") - F.col("lo")) / F.lit(float(points - 1)))
    j = _with_label_params(x, st)
    middle = lambda cell: F.col("lo") + (cell + F.lit(0.5)) * F.col("h") * KDE_CELL
    j = j.withColumn("_cell", F.floor((F.col("v") - F.col("lo")) / (F.col("h") * KDE_CELL)))
    t = (F.col("v") - middle(F.col("_cell"))) / F.col("h")
    powers, term = [], F.lit(1.0)
    for k in range(KDE_ORDER + 1):
        powers.append(F.sum(term).alias(f"_m{k}"))
        term = term * t / F.lit(float(k + 1))
    keys = ["_lbl", "n", "h", "lo", "step", "hi", "_cell"]
    cells = j.groupBy(*keys).agg(*powers).withColumn("_c", middle(F.col("_cell")))
    reach = F.col("h") * KDE_CUTOFF
    j_lo = F.greatest(F.ceil((F.col("_c") - reach - F.col("lo")) / F.col("step")), F.lit(0)).cast("int")
    j_hi = F.least(F.floor((F.col("_c") + reach - F.col("lo")) / F.col("step")), F.lit(points - 1)).cast("int")
    e = cells.where(j_lo <= j_hi).select("*", F.explode(F.sequence(j_lo, j_hi)).alias("j"))
    gx = F.when(F.col("j") == points - 1, F.col("hi")).otherwise(F.col("j") * F.col("step") + F.col("lo"))
    e = e.withColumn("x", gx).withColumn("_u", (F.col("x") - F.col("_c")) / F.col("h"))
    moments = F.array(*[F.col(f"_m{k}") for k in range(KDE_ORDER + 1)])
    dens = e.select("_lbl", "j", "x", "n", "h", _hermite_sum(F.col("_u"), moments).alias("_k"))
    dens = dens.groupBy("_lbl", "j", "x", "n", "h").agg(F.sum("_k").alias("_s"))
    # grid points that no value reaches have density 0
    spine = st.select("_lbl", "n", "h", "lo", "step", "hi", F.explode(F.sequence(F.lit(0), F.lit(points - 1))).alias("j"))
    spine = spine.withColumn("x", gx)
    out = spine.join(dens.select("_lbl", "j", "_s"), ["_lbl", "j"], "left").fillna(0.0, subset=["_s"])
    return out.select(
        F.col("_lbl").alias(spec.label),
        F.col("j").alias("point"),
        "x",
        (F.col("_s") / (F.col("n") * F.col("h") * F.lit(math.sqrt(2 * math.pi)))).alias("density"),
    )


def box_stats(
    df: DataFrame,
    col: str,
    spec: TxnSpec = TxnSpec(),
    clip_lo: float | None = None,
    clip_hi: float | None = None,
    whis: float = 1.5,
) -> DataFrame:
    """Per label: quartiles (exact), whiskers at 1.5 IQR, mean, notch, outlier count."""
    x = df.select(F.col(spec.label).alias("_lbl"), _value(df, col, clip_lo, clip_hi).alias("v")).where(
        F.col("v").isNotNull()
    )
    q = quantiles_wide(x, "v", [0.25, 0.5, 0.75], ["q1", "median", "q3"], by=["_lbl"])
    j = _with_label_params(x, q)
    iqr = F.col("q3") - F.col("q1")
    lo_f, hi_f = F.col("q1") - whis * iqr, F.col("q3") + whis * iqr
    g = j.groupBy("_lbl", "q1", "median", "q3").agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("v").alias("mean"),
        F.min(F.when(F.col("v") >= lo_f, F.col("v"))).alias("whisker_lo"),
        F.max(F.when(F.col("v") <= hi_f, F.col("v"))).alias("whisker_hi"),
        F.count_if((F.col("v") < lo_f) | (F.col("v") > hi_f)).alias("n_outliers"),
    )
    iq = F.col("q3") - F.col("q1")
    return g.select(
        F.col("_lbl").alias(spec.label),
        "n",
        "q1",
        "median",
        "q3",
        iq.alias("iqr"),
        "whisker_lo",
        "whisker_hi",
        "mean",
        (F.col("median") - 1.57 * iq / F.sqrt(F.col("n"))).alias("notch_lo"),
        (F.col("median") + 1.57 * iq / F.sqrt(F.col("n"))).alias("notch_hi"),
        "n_outliers",
    )
