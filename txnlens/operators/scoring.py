"""Rule score, threshold evaluation and flagged-row listing (PR-17, E-1..5, SO-3, SO-5)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from txnlens.functions.columns import DISPLAY_BANDS, Bands, day_index, day_label, hour_of_day
from txnlens.plans.small import with_params
from txnlens.spec import TxnSpec

# Fixed values that must equal the reference: the rule score's terms in
# summation order as (column, weight, use absolute value).
SCORE_TERMS = (
    ("V17", 0.30, True),
    ("V14", 0.25, True),
    ("V12", 0.20, True),
    ("Amount_log", 0.15, False),
    ("V10", 0.10, True),
)
SCORE_EPS = 1e-9
# Fixed values that must equal the reference: default threshold, its grid step
# and the listing sizes offered by the monitor.
DEFAULT_THRESHOLD = 0.60
THRESHOLD_STEPS = 100
TOP_N_CHOICES = (25, 50, 100, 250, 500)
SAMPLE_ROWS = 5000


def _term_input(c: str, use_abs: bool) -> Column:
    x = F.col(c).cast("double")
    return F.abs(x) if use_abs else x


def score_params(df: DataFrame, terms=SCORE_TERMS) -> DataFrame:
    """One row: the normaliser (maximum of each term's input) over ``df``."""
    return df.agg(*[F.max(_term_input(c, a)).alias(f"m{i}") for i, (c, _, a) in enumerate(terms)])


def score_expr(params_col: str = "_sp", terms=SCORE_TERMS) -> Column:
    total = None
    for i, (c, w, a) in enumerate(terms):
        t = F.lit(w) * _term_input(c, a) / (F.col(f"{params_col}.m{i}") + F.lit(SCORE_EPS))
        total = t if total is None else total + t
    return F.least(F.greatest(total, F.lit(0.0)), F.lit(1.0))


def add_score(df: DataFrame, params: DataFrame | None = None, out: str = "fraud_score", terms=SCORE_TERMS) -> DataFrame:
    """Append the rule score in [0, 1].

    Normalisers default to maxima over the *whole* ``df`` (before any filter);
    pass ``params`` (from :func:`score_params`) to freeze them, e.g. for a stream.
    """
    p = score_params(df, terms) if params is None else params
    x = with_params(df, p, "_sp")
    return x.withColumn(out, score_expr("_sp", terms)).drop("_sp")


def analysis_view(
    df: DataFrame,
    spec: TxnSpec = TxnSpec(),
    bands: Bands = DISPLAY_BANDS,
    with_score: bool = True,
    params: DataFrame | None = None,
) -> DataFrame:
    """Cleaned table + Hour, Day, Day_label, Amount_band(_ord) and the rule score (by stored ``params``, if given)."""
    x = df.select(
        "*",
        hour_of_day(spec.time).alias("Hour"),
        day_index(spec.time).alias("Day"),
    )
    x = x.select(
        "*",
        day_label("Day").alias("Day_label"),
        bands.ordinal(spec.amount).alias("Amount_band_ord"),
    ).withColumn("Amount_band", bands.name("Amount_band_ord"))
    return add_score(x, params) if with_score else x


def threshold_metrics(df: DataFrame, threshold: float = DEFAULT_THRESHOLD, score: str = "fraud_score", spec: TxnSpec = TxnSpec()) -> DataFrame:
    """Flagged, true/false positives, recall %, precision %, exposure caught / missed."""
    lbl, amt = F.col(spec.label), F.col(spec.amount).cast("double")
    flag = F.coalesce(F.col(score) >= F.lit(float(threshold)), F.lit(False))
    pos = lbl == 1
    g = df.agg(
        F.count_if(flag).alias("flagged"),
        F.count_if(flag & pos).alias("true_pos"),
        F.count_if(flag & (lbl == 0)).alias("false_pos"),
        F.count_if(pos).alias("positives"),
        F.coalesce(F.sum(F.when(flag & pos, amt)), F.lit(0.0)).alias("exposure_caught"),
        F.coalesce(F.sum(F.when(~flag & pos, amt)), F.lit(0.0)).alias("exposure_missed"),
    )
    return g.select(
        F.lit(float(threshold)).alias("threshold"),
        "flagged",
        "true_pos",
        "false_pos",
        "positives",
        (F.col("true_pos") / F.greatest(F.col("positives"), F.lit(1)) * 100).alias("recall_pct"),
        (F.col("true_pos") / F.greatest(F.col("flagged"), F.lit(1)) * 100).alias("precision_pct"),
        "exposure_caught",
        "exposure_missed",
    )


def threshold_sweep(spark: SparkSession, df: DataFrame, steps: int = THRESHOLD_STEPS, score: str = "fraud_score", spec: TxnSpec = TxnSpec()) -> DataFrame:
    """:func:`threshold_metrics` for every threshold k/steps, k = 0..steps, in one pass.

    Each row is put in the bucket of the highest grid threshold it reaches
    (same ``>=`` rule as a single threshold); suffix sums over the
    ``steps + 1`` bucket rows give every threshold's counts.
    """
    s = F.col(score)
    b0 = F.floor(s * steps).cast("int")
    up = (b0 + 1).cast("double") / F.lit(float(steps))
    here = b0.cast("double") / F.lit(float(steps))
    b = (
        F.when(s.isNull(), F.lit(-1))
        .when((b0 + 1 <= steps) & (up <= s), b0 + 1)
        .when(here > s, b0 - 1)
        .otherwise(b0)
    )
    b = F.least(F.greatest(b, F.lit(-1)), F.lit(steps))
    lbl, amt = F.col(spec.label), F.col(spec.amount).cast("double")
    per = df.select(b.alias("k"), lbl.alias("_l"), amt.alias("_a")).groupBy("k").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("_l") == 1).alias("tp"),
        F.count_if(F.col("_l") == 0).alias("fp"),
        F.coalesce(F.sum(F.when(F.col("_l") == 1, F.col("_a"))), F.lit(0.0)).alias("amt_pos"),
    )
    tot = per.agg(
        F.coalesce(F.sum("tp"), F.lit(0)).alias("positives"),
        F.coalesce(F.sum("amt_pos"), F.lit(0.0)).alias("exposure"),
    )
    spine = spark.range(0, steps + 1).select(F.col("id").cast("int").alias("k"))
    # at most steps + 2 rows on both sides: the suffix-sum window is tiny
    j = spine.join(F.broadcast(per), "k", "left").fillna(0)
    w = Window.orderBy(F.col("k").desc()).rowsBetween(Window.unboundedPreceding, 0)
    j = j.select(
        "k",
        F.sum("n").over(w).alias("flagged"),
        F.sum("tp").over(w).alias("true_pos"),
        F.sum("fp").over(w).alias("false_pos"),
        F.sum("amt_pos").over(w).alias("exposure_caught"),
    )
    j = with_params(j, tot, "_t")
    return j.select(
        (F.col("k").cast("double") / F.lit(float(steps))).alias("threshold"),
        "flagged",
        "true_pos",
        "false_pos",
        F.col("_t.positives").alias("positives"),
        (F.col("true_pos") / F.greatest(F.col("_t.positives"), F.lit(1)) * 100).alias("recall_pct"),
        (F.col("true_pos") / F.greatest(F.col("flagged"), F.lit(1)) * 100).alias("precision_pct"),
        "exposure_caught",
        (F.col("_t.exposure") - F.col("exposure_caught")).alias("exposure_missed"),
    )


def top_flagged(
    df: DataFrame,
    threshold: float = DEFAULT_THRESHOLD,
    n: int = TOP_N_CHOICES[1],
    mode: str = "flagged",
    score: str = "fraud_score",
    spec: TxnSpec = TxnSpec(),
    decimals: int = 4,
) -> DataFrame:
    """Top-n rows by score (mode: 'flagged' | 'all' | 'negative'), key as tie-break.

    ``orderBy(...).limit(n)`` plans as TakeOrderedAndProject: a per-partition
    top-n followed by a merge of n x #partitions rows.
    """
    x = df
    if mode == "flagged":
        x = x.where(F.col(score) >= F.lit(float(threshold)))
    elif mode == "negative":
        x = x.where(F.col(spec.label) == 0)
    elif mode != "all":
        raise ValueError(f"unknown mode {mode!r}")
    order = [F.col(score).desc_nulls_last()] + ([F.col(spec.key).asc()] if spec.key else [])
    cols = ([spec.key] if spec.key else []) + [spec.time, spec.amount, "Hour", "Day_label", "Amount_band"]
    return x.orderBy(*order).limit(n).select(
        *cols,
        F.round(F.col(score), decimals).alias(score),
        F.when(F.col(spec.label) == 0, F.lit("LEGIT")).when(F.col(spec.label) == 1, F.lit("FRAUD")).alias("Class_label"),
    )


def sample_rows(df: DataFrame, k: int = SAMPLE_ROWS, seed: int = 42, key: str = "txn_id") -> DataFrame:
    """Exactly min(k, n) rows chosen by a seeded hash of the key (reproducible).

    Ordering by the hash and taking k is a distributed top-k; unlike
    ``sample(fraction)`` the size is exact.
    """
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return df.withColumn("_h", h).orderBy("_h", key).limit(k).drop("_h")
