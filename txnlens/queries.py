"""Registered queries: one callable ``(spark, sf_dir) -> DataFrame`` per operator.

All queries read the driver's tables through the ``transactions`` fixture
(:mod:`txnlens.sources.fixture`), so their work grows with the tables. Double
columns are rounded (6 decimals unless stated) so that results can be compared
with the DuckDB twins in :mod:`txnlens.oracle`, which round identically.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from txnlens.functions.columns import DEFAULT_BANDS, hour_of_day
from txnlens.operators import clean as C
from txnlens.operators import cube as CU
from txnlens.operators import features as FE
from txnlens.operators import profile as P
from txnlens.operators import rates as R
from txnlens.operators import resample as RS
from txnlens.operators import scoring as S
from txnlens.operators import separation as SP
from txnlens.operators import sketches as SK
from txnlens.operators import timing as TM
from txnlens.plans.refresh import KeptStage
from txnlens.plans.stage import input_version, materialize, write_table
from txnlens.session import checkpoint_subdir
from txnlens.sources import infer as INF
from txnlens.sources import io as IO
from txnlens.sources.fixture import ARRIVAL_SLOTS, arrivals, build_transactions, embeddings_dim, stream_events, table, transactions
from txnlens.spec import TxnSpec

SPEC = TxnSpec()
DIGITS: dict[str, int] = {}
Query = Callable[[SparkSession, str], DataFrame]
_REGISTRY: dict[str, Query] = {}


def _rounded(c: str, digits: int):
    # A tiny negative value may round to -0.0 in one engine and 0.0 in another;
    # adding +0.0 turns -0.0 into 0.0 (IEEE) and references the column once, so
    # the projection still collapses into the operator's own (a top-n keeps its
    # TakeOrderedAndProject plan instead of becoming a global sort).
    return F.round(F.col(f"`{c}`"), digits) + F.lit(0.0)


def round_doubles(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(
        *[
            _rounded(f.name, digits).alias(f.name)
            if isinstance(f.dataType, (DoubleType, FloatType))
            else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def query(name: str, digits: int = 6):
    def deco(fn: Callable[[SparkSession, str], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return round_doubles(fn(spark, sf_dir), digits)

        run.__name__ = name
        run.__doc__ = fn.__doc__
        DIGITS[name] = digits
        _REGISTRY[name] = run
        return run

    return deco


def registry() -> dict[str, Query]:
    return dict(_REGISTRY)


# ---------------------------------------------------------------- inputs
def raw(spark: SparkSession, sf: str, variant: str = "base") -> DataFrame:
    """The raw transaction table (the reference's input file), derived from the
    driver's events + embeddings and written once per session."""
    version = _version(spark, sf)
    return materialize(lambda: transactions(spark, sf, variant), f"raw:{variant}:{sf}:{version}", spark)


def _version(spark: SparkSession, sf: str) -> str:
    return input_version(table(spark, sf, "events"), table(spark, sf, "embeddings"))


def cleaned(spark: SparkSession, sf: str) -> DataFrame:
    """The cleaned table, written once per session (stage boundary, see plans.stage)."""
    return materialize(lambda: C.clean(raw(spark, sf), SPEC), f"cleaned:{sf}:{_version(spark, sf)}", spark)


def view(spark: SparkSession, sf: str) -> DataFrame:
    """Cleaned table + hour/day/band columns and the rule score (projected from the cleaned stage)."""
    return S.analysis_view(cleaned(spark, sf), SPEC, params=score_maxima(spark, sf))


def score_maxima(spark: SparkSession, sf: str) -> DataFrame:
    """The score's normalisers, one row written beside the cleaned stage, so that no view scans the table for them."""
    return materialize(lambda: S.score_params(cleaned(spark, sf)), f"maxima:{sf}:{_version(spark, sf)}", spark)


def plain_view(spark: SparkSession, sf: str) -> DataFrame:
    """The view without the score, whose maxima would take a second scan."""
    return S.analysis_view(cleaned(spark, sf), SPEC, with_score=False)


def view_rare(spark: SparkSession, sf: str) -> DataFrame:
    """Analysis view of the rare-positive variant (positives further thinned)."""
    return materialize(
        lambda: S.analysis_view(C.clean(raw(spark, sf, "rare"), SPEC), SPEC), f"view:rare:{sf}:{_version(spark, sf)}", spark
    )


def wrangled(spark: SparkSession, sf: str) -> DataFrame:
    """The wrangled feature table (projected from the cleaned stage)."""
    return FE.wrangle(cleaned(spark, sf), SPEC)


def numeric_cols(df: DataFrame) -> list[str]:
    return SPEC.numeric(df)


V = [f"V{i}" for i in range(1, 29)]

# ---------------------------------------------------------------- profile
@query("table_shape")
def q_table_shape(spark, sf):
    """IO-4: rows and columns of the raw table."""
    return P.shape(raw(spark, sf))


@query("missing_report")
def q_missing_report(spark, sf):
    """AG-1 on the variant with NULL / NaN features."""
    return P.missing_report(raw(spark, sf, "nulls"))


@query("duplicate_report")
def q_duplicate_report(spark, sf):
    """AG-2."""
    return P.duplicate_report(raw(spark, sf))


@query("label_distribution")
def q_label_distribution(spark, sf):
    """AG-3."""
    return P.label_distribution(raw(spark, sf), SPEC.label)


@query("imbalance_ratio")
def q_imbalance_ratio(spark, sf):
    """AG-4."""
    return P.imbalance_ratio(raw(spark, sf), SPEC.label)


@query("describe_columns")
def q_describe_columns(spark, sf):
    """AG-5 over every numeric column (exact quartiles)."""
    df = raw(spark, sf)
    return P.describe_columns(df, numeric_cols(df))


@query("zero_amount_report")
def q_zero_amount_report(spark, sf):
    """AG-11."""
    return P.zero_amount_report(raw(spark, sf), SPEC.amount, SPEC.label)


@query("amount_profile")
def q_amount_profile(spark, sf):
    """AG-6/AG-7 on the amount."""
    return P.column_profile(raw(spark, sf), SPEC.amount)


@query("time_profile")
def q_time_profile(spark, sf):
    """AG-6 on the event time."""
    return P.time_span(raw(spark, sf), SPEC.time)


@query("amount_by_label")
def q_amount_by_label(spark, sf):
    """AG-10."""
    return P.amount_by_label(raw(spark, sf), SPEC.amount, SPEC.label)


@query("moments_topk")
def q_moments_topk(spark, sf):
    """AG-7/AG-8 + SO-1."""
    df = raw(spark, sf)
    return P.moments_topk(df, SPEC.features(df), 10)


@query("label_correlation_topk")
def q_label_correlation_topk(spark, sf):
    """AG-22 + SO-2."""
    df = raw(spark, sf)
    return P.correlation_topk(df, SPEC.numeric(df, include_label=False), SPEC.label, 10)


@query("label_correlations")
def q_label_correlations(spark, sf):
    """AG-22 + PR-20: signed correlation of every analysis column with the label, with the sign flag."""
    v = plain_view(spark, sf)
    cols = [*numeric_cols(cleaned(spark, sf).drop(SPEC.label)), "Hour", "Day"]
    return P.label_correlations(v, cols, SPEC.label)


@query("skew_before_after")
def q_skew_before_after(spark, sf):
    """AG-7: skewness of the amount before and after capping and log."""
    return P.skew_before_after(cleaned(spark, sf), SPEC.amount, "Amount_log")


@query("csv_round_trip")
def q_csv_round_trip(spark, sf):
    """IO-1 / IO-2: the raw table written as CSV with a header and read back with its schema."""
    df = raw(spark, sf)
    path = checkpoint_subdir(spark, f"tables/csv-{uuid.uuid4().hex[:12]}")
    IO.write_table(df, path, "csv")
    return IO.read_transactions(spark, path, "csv", schema=df.schema)


BROKEN_MOD, UNREADABLE_MOD = 89, 83


def _csv_lines(spark, sf):
    """The raw table as text lines under a header: some rows once more cut short, some once more with a word as amount."""
    df = raw(spark, sf)
    cols = df.columns
    line = lambda amount, upto: F.concat_ws(
        ",", *[F.lit(amount) if c == SPEC.amount and amount else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in cols[:upto]]
    )
    good = df.select(line("", None).alias("value"))
    short = df.where(F.col(SPEC.key) % BROKEN_MOD == 0).select(line("", -2).alias("value"))
    word = df.where(F.col(SPEC.key) % UNREADABLE_MOD == 5).select(line("n.k.", None).alias("value"))
    path = checkpoint_subdir(spark, f"tables/lines-{uuid.uuid4().hex[:12]}")
    IO.write_lines(good.unionByName(short).unionByName(word), ",".join(cols), path)
    return path


@query("csv_inferred_types")
def q_csv_inferred_types(spark, sf):
    """IO-1 without a schema: the inferred types of the CSV's columns, and what is missing in them."""
    return INF.read_csv(spark, _csv_lines(spark, sf), tolerance=0.1).types


@query("csv_quarantine")
def q_csv_quarantine(spark, sf):
    """IO-1: rows read with inferred types, and the malformed ones by their reason."""
    got = INF.read_csv(spark, _csv_lines(spark, sf), tolerance=0.1)
    amount = F.sum(SPEC.amount).alias("amount")
    good = got.rows.agg(F.lit("read").alias("reason"), F.count(F.lit(1)).alias("n"), amount)
    bad = got.bad.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.lit(None).cast("double").alias("amount"))
    return good.unionByName(bad)


@query("iqr_outliers")
def q_iqr_outliers(spark, sf):
    """AG-9 / FL-5 on amount and time."""
    return P.iqr_outliers(raw(spark, sf), [SPEC.amount, SPEC.time])


@query("describe_sketched")
def q_describe_sketched(spark, sf):
    """AG-5 (approximate): sketches stored by hour and label, merged; are the quartiles' ranks within the bound?"""
    df = raw(spark, sf)
    cols = numeric_cols(df)
    parts = df.withColumn("Hour", hour_of_day(SPEC.time))
    stored = write_table(SK.sketch_columns(parts, cols, ["Hour", SPEC.label]), "sketches")
    table_ = write_table(SK.describe_sketched(SK.merge_sketches(stored)), "sketched")
    return SK.with_rank_check(P.to_long(df, cols), table_, 2 * SK.rank_error())


# ---------------------------------------------------------------- cleaning / features
@query("clean_transactions")
def q_clean_transactions(spark, sf):
    """SO-4, PR-4..6, RS-1 (time scaling)."""
    return cleaned(spark, sf)


@query("capping_report")
def q_capping_report(spark, sf):
    """AG-9 fences and capped counts on the de-duplicated table."""
    return C.capping_report(cleaned(spark, sf), SPEC.amount)


@query("amount_bands")
def q_amount_bands(spark, sf):
    """PR-12/PR-13: band ordinal, name and one-hot columns."""
    df = raw(spark, sf)
    o = DEFAULT_BANDS.ordinal(SPEC.amount)
    return df.select(
        SPEC.key, SPEC.amount, o.alias("Amount_bin_ord"), DEFAULT_BANDS.name(o).alias("Amount_bin"), *DEFAULT_BANDS.onehot(o)
    )


@query("engineered_features")
def q_engineered_features(spark, sf):
    """PR-7..16: the wrangled table (50 features + label + key)."""
    return wrangled(spark, sf)


# ---------------------------------------------------------------- modelling prep
def split_stage(spark, sf):
    """Where each label is cut into test and train (one row a label, written once)."""
    return materialize(
        lambda: RS.split_cuts(cleaned(spark, sf), SPEC, 0.2, 42), f"cuts:{sf}:{_version(spark, sf)}", spark
    )


def _split(spark, sf):
    """The wrangled table with its train/test assignment, projected from the cleaned stage."""
    return RS.assign_split(wrangled(spark, sf), split_stage(spark, sf), SPEC, 42)


def _split_stored(spark, sf):
    """:func:`_split` written once per session, for queries that read it several times."""
    return materialize(lambda: _split(spark, sf), f"split:{sf}:{_version(spark, sf)}", spark)


def _split_labels(spark, sf):
    """Key, label and split alone."""
    return RS.assign_split(cleaned(spark, sf).select(SPEC.key, SPEC.label), split_stage(spark, sf), SPEC, 42)


@query("stratified_split")
def q_stratified_split(spark, sf):
    """RS-2: exact per-label 80:20 split by seeded hash rank."""
    return _split_labels(spark, sf).select(SPEC.key, SPEC.label, "split")


@query("saved_splits")
def q_saved_splits(spark, sf):
    """RS-6: the wrangled table, the train and the test split saved and read back."""
    df = _split_stored(spark, sf)
    parts = (df.drop("split"), df.where("split = 'train'").drop("split"), df.where("split = 'test'").drop("split"))
    paths = IO.save_splits(*parts, checkpoint_subdir(spark, f"tables/splits-{uuid.uuid4().hex[:12]}"))
    back = [
        spark.read.parquet(path).select(F.lit(name).alias("saved"), SPEC.key, SPEC.label, "Amount_log")
        for name, path in paths.items()
    ]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("saved_balanced")
def q_saved_balanced(spark, sf):
    """RS-6 as the reference saves: the unscaled table, the balanced scaled train and the scaled test part, read back."""
    df = _split_stored(spark, sf)
    train, feats = _smote_input(spark, sf)
    balanced = RS.smote(train, feats, SPEC, k=5, seed=42)
    test = RS.scale_by_split(df, FE.scale_columns(df, SPEC)).where("split = 'test'").drop("split")
    paths = IO.save_splits(df.drop("split"), balanced, test, checkpoint_subdir(spark, f"tables/balanced-{uuid.uuid4().hex[:12]}"))
    back = [
        spark.read.parquet(path).select(F.lit(name).alias("saved"), SPEC.key, SPEC.label, "Amount_log", "V14", "Time_hour")
        for name, path in paths.items()
    ]
    return back[0].unionByName(back[1]).unionByName(back[2])


@query("split_report")
def q_split_report(spark, sf):
    """RS-5."""
    return RS.split_report(_split_labels(spark, sf), SPEC)


@query("scaled_train")
def q_scaled_train(spark, sf):
    """RS-1/RS-1b: standardise continuous features, fitted on the train split."""
    df = _split(spark, sf)
    return RS.scale_by_split(df, FE.scale_columns(df, SPEC))


@query("class_weights")
def q_class_weights(spark, sf):
    """RS-4: balanced class weights of the train split."""
    return RS.class_weights(_split_labels(spark, sf).where(F.col("split") == "train"), SPEC)


# ---------------------------------------------------------------- rates
@query("rate_by_hour")
def q_rate_by_hour(spark, sf):
    """AG-12."""
    return R.rate_by_hour(plain_view(spark, sf), SPEC)


@query("peak_hour")
def q_peak_hour(spark, sf):
    """AG-14."""
    return R.peak(R.rate_by_hour(plain_view(spark, sf), SPEC), "Hour")


@query("volume_by_hour")
def q_volume_by_hour(spark, sf):
    """AG-13 (single groupBy form of JN-1)."""
    return R.volume_by_hour(plain_view(spark, sf), SPEC)


@query("volume_by_hour_parity")
def q_volume_by_hour_parity(spark, sf):
    """JN-1: hourly negatives left-joined with hourly positives (reference parity form)."""
    return R.volume_by_hour(plain_view(spark, sf), SPEC, parity=True)


@query("hour_spine")
def q_hour_spine(spark, sf):
    """JN-2 + PR-20 + WN-4."""
    return R.hour_spine(spark, plain_view(spark, sf), SPEC)


@query("rate_by_band")
def q_rate_by_band(spark, sf):
    """AG-15 (+ AG-16 exposure and PR-20 flag)."""
    return R.rate_by_band(plain_view(spark, sf), SPEC)


@query("rate_by_band_rare")
def q_rate_by_band_rare(spark, sf):
    """AG-15/16 on the rare variant: bands without positives keep rate 0 and exposure 0."""
    return R.rate_by_band(view_rare(spark, sf), SPEC)


@query("exposure_by_band_rare")
def q_exposure_by_band_rare(spark, sf):
    """AG-16 on the rare variant: bands without positives are absent (observed groups only)."""
    return R.exposure_by_band(view_rare(spark, sf), SPEC)


@query("scorecard_rare")
def q_scorecard_rare(spark, sf):
    """AG-21 on the rare variant."""
    return R.scorecard(view_rare(spark, sf), SPEC)


@query("exposure_by_band")
def q_exposure_by_band(spark, sf):
    """AG-16."""
    return R.exposure_by_band(plain_view(spark, sf), SPEC)


@query("peak_band")
def q_peak_band(spark, sf):
    """AG-14 on AG-15: the band with the highest positive rate (lowest band on ties)."""
    return R.peak(R.rate_by_band(plain_view(spark, sf), SPEC), "Amount_band_ord")


@query("range_exposure")
def q_range_exposure(spark, sf):
    """FL-4: positives and exposure with 100 <= amount <= 500 (inclusive range)."""
    return R.range_exposure(plain_view(spark, sf), 100.0, 500.0, SPEC)


@query("band_composition")
def q_band_composition(spark, sf):
    """AG-17 with rollup totals."""
    return R.band_composition(plain_view(spark, sf), SPEC)


@query("day_crosstab")
def q_day_crosstab(spark, sf):
    """AG-18."""
    return R.day_crosstab(plain_view(spark, sf), SPEC)


@query("exposure_summary")
def q_exposure_summary(spark, sf):
    """AG-19."""
    return R.exposure_summary(plain_view(spark, sf), SPEC)


@query("day_night_split")
def q_day_night_split(spark, sf):
    """AG-20."""
    return R.day_night_split(plain_view(spark, sf), SPEC)


@query("scorecard")
def q_scorecard(spark, sf):
    """AG-21."""
    return R.scorecard(plain_view(spark, sf), SPEC)


FILTER = R.TxnFilter(days=("Day 2",), hours=(2, 20), max_amount=500.0)


@query("filtered_view")
def q_filtered_view(spark, sf):
    """FL-3: day / hour / amount filter of the analysis view."""
    v = FILTER.apply(view(spark, sf))
    return v.select(SPEC.key, SPEC.time, SPEC.amount, SPEC.label, "Hour", "Day_label", "Amount_band", "fraud_score")


@query("filtered_scorecard")
def q_filtered_scorecard(spark, sf):
    """AG-21 on the filtered view, peak hour from the unfiltered view (Q-8)."""
    v = plain_view(spark, sf)
    return R.scorecard(FILTER.apply(v), SPEC, peak_from=v)


EMPTY_FILTER = R.TxnFilter(days=("Day 9",))


@query("scorecard_empty_filter")
def q_scorecard_empty_filter(spark, sf):
    """AG-21 on a filter that no row passes: all metrics, zeros."""
    v = plain_view(spark, sf)
    return R.scorecard(EMPTY_FILTER.apply(v), SPEC, peak_from=v)


def _cube(spark, sf):
    """The stored cube of the analysis view (built once per session and input)."""
    key = (spark.sparkContext.applicationId, sf, _version(spark, sf))
    if key not in _CUBES:
        _CUBES[key] = CU.build_cube(plain_view(spark, sf), SPEC)
    return _CUBES[key]


_CUBES: dict = {}


@query("cube_scorecard")
def q_cube_scorecard(spark, sf):
    """FL-3 + AG-21 from the stored cube: a scorecard for each of several filters, boundary cells from their rows."""
    cube = _cube(spark, sf)
    out = None
    for i, f in enumerate(CUBE_FILTERS):
        card = CU.cube_scorecard(cube, f).withColumn("filter", F.lit(i))
        out = card if out is None else out.unionByName(card)
    return out


CUBE_FILTERS = (
    R.TxnFilter(),
    FILTER,
    EMPTY_FILTER,
    R.TxnFilter(days=("Day 1",), hours=(0, 11), max_amount=37.5),
    R.TxnFilter(hours=(8, 19), max_amount=0.0),
)


# ---------------------------------------------------------------- timing
@query("positive_gaps")
def q_positive_gaps(spark, sf):
    """WN-1: minutes between consecutive positives."""
    return TM.positive_gaps(cleaned(spark, sf), SPEC).select(SPEC.time, "gap_min")


@query("gap_quantiles")
def q_gap_quantiles(spark, sf):
    """AG-30: 10th percentile and median gap."""
    return TM.gap_quantiles(cleaned(spark, sf), SPEC)


@query("gap_quantiles_clipped")
def q_gap_quantiles_clipped(spark, sf):
    """AG-30 with gaps capped at 200 minutes (interactive view)."""
    return TM.gap_quantiles(cleaned(spark, sf), SPEC, clip_upper=200.0)


@query("cumulative_arrival")
def q_cumulative_arrival(spark, sf):
    """WN-2: i/n*100 per label in time order."""
    return TM.cumulative_arrival(cleaned(spark, sf), SPEC)


@query("cumulative_arrival_even")
def q_cumulative_arrival_even(spark, sf):
    """WN-3: (i-1)/(n-1)*100 per label in time order."""
    return TM.cumulative_arrival(cleaned(spark, sf), SPEC, zero_based=True)


# ---------------------------------------------------------------- separation
@query("feature_ks")
def q_feature_ks(spark, sf):
    """AG-25: two-sample KS per feature."""
    return SP.feature_ks(cleaned(spark, sf), V, SPEC)


@query("feature_ks_finite", digits=12)
def q_feature_ks_finite(spark, sf):
    """AG-25 with the p-value for finite samples (lattice paths, or the finite two-sided law)."""
    return SP.feature_ks(cleaned(spark, sf), V, SPEC, finite=True)


@query("feature_detail")
def q_feature_detail(spark, sf):
    """JN-5: the row of one feature, from its column alone."""
    return SP.feature_detail(cleaned(spark, sf), "V14", V, SPEC)


@query("label_means")
def q_label_means(spark, sf):
    """AG-23 (+ AG-22 correlation)."""
    return SP.label_means(cleaned(spark, sf), V, SPEC)


@query("radar_profile")
def q_radar_profile(spark, sf):
    """AG-24."""
    return SP.radar_profile(cleaned(spark, sf), SP.RADAR_FEATURES, SPEC)


@query("feature_ranking")
def q_feature_ranking(spark, sf):
    """AG-26."""
    return SP.feature_ranking(cleaned(spark, sf), V, SPEC)


@query("histogram_by_label")
def q_histogram_by_label(spark, sf):
    """AG-27: 60-bin histogram of the log amount per label."""
    return SP.histogram_by_label(cleaned(spark, sf), "Amount_log", 60, SPEC)


@query("score_histogram")
def q_score_histogram(spark, sf):
    """E-5: score distribution per label (50 bins)."""
    return SP.histogram_by_label(view(spark, sf), "fraud_score", 50, SPEC)


@query("density_by_label", digits=9)
def q_density_by_label(spark, sf):
    """AG-28: Gaussian KDE of the amount clipped at 500 on [0, 500]."""
    return SP.density_by_label(cleaned(spark, sf), SPEC.amount, SPEC, grid_lo=0.0, grid_hi=500.0, clip_hi=500.0)


@query("density_scott", digits=9)
def q_density_scott(spark, sf):
    """AG-28 with the default bandwidth rule (Scott): amount clipped at 500 on [0, 500]."""
    return SP.density_by_label(cleaned(spark, sf), SPEC.amount, SPEC, grid_lo=0.0, grid_hi=500.0, clip_hi=500.0, bw=None)


@query("density_log_amount", digits=9)
def q_density_log_amount(spark, sf):
    """AG-28: KDE of the log amount on each label's own [min, max]."""
    return SP.density_by_label(cleaned(spark, sf), "Amount_log", SPEC)


@query("density_feature", digits=9)
def q_density_feature(spark, sf):
    """AG-28: KDE of a feature clipped to +-10 on the grid [-10, 10]."""
    return SP.density_by_label(cleaned(spark, sf), "V17", SPEC, grid_lo=-10.0, grid_hi=10.0, clip_lo=-10.0, clip_hi=10.0)


@query("box_stats_feature")
def q_box_stats_feature(spark, sf):
    """AG-29: box statistics of a feature clipped to +-10."""
    return SP.box_stats(cleaned(spark, sf), "V14", SPEC, clip_lo=-10.0, clip_hi=10.0)


@query("gap_histogram")
def q_gap_histogram(spark, sf):
    """AG-27 on WN-1: 60-bin histogram of positive gaps capped at 200 minutes."""
    g = write_table(TM.positive_gaps(cleaned(spark, sf), SPEC, clip_upper=200.0), "gaps").withColumn(SPEC.label, F.lit(1))
    return SP.histogram_by_label(g, "gap_min", 60, SPEC)


@query("box_stats")
def q_box_stats(spark, sf):
    """AG-29: box statistics of the amount clipped at 500."""
    return SP.box_stats(cleaned(spark, sf), SPEC.amount, SPEC, clip_hi=500.0)


# ---------------------------------------------------------------- scoring
@query("scored")
def q_scored(spark, sf):
    """PR-17: rule score of every transaction."""
    return view(spark, sf).select(SPEC.key, SPEC.label, "fraud_score")


@query("threshold_metrics")
def q_threshold_metrics(spark, sf):
    """E-1..E-3 at the default threshold 0.60."""
    return S.threshold_metrics(view(spark, sf), 0.60, spec=SPEC)


@query("threshold_sweep")
def q_threshold_sweep(spark, sf):
    """E-4: metrics for thresholds 0.00..1.00 in steps of 0.01."""
    return S.threshold_sweep(spark, view(spark, sf), 100, spec=SPEC)


@query("top_flagged")
def q_top_flagged(spark, sf):
    """SO-3: top 50 rows by score (all rows mode)."""
    return S.top_flagged(view(spark, sf), 0.60, 50, "all", spec=SPEC)


@query("top_flagged_only")
def q_top_flagged_only(spark, sf):
    """SO-3 / FL-7: top 50 rows at or above the threshold (the interactive view's first mode)."""
    return S.top_flagged(view(spark, sf), 0.30, 50, "flagged", spec=SPEC)


@query("top_flagged_negative")
def q_top_flagged_negative(spark, sf):
    """SO-3 / FL-7: top 25 negatives by score."""
    return S.top_flagged(view(spark, sf), 0.60, 25, "negative", spec=SPEC)


@query("sample_rows")
def q_sample_rows(spark, sf):
    """SO-5: reproducible sample of min(5000, n) rows."""
    v = view(spark, sf).select(SPEC.key, SPEC.amount, "fraud_score", SPEC.label, "Hour", "Day_label", "Amount_band")
    return S.sample_rows(v, 5000, 42, SPEC.key)


# ---------------------------------------------------------------- streaming twins
@query("stream_hourly_rate")
def q_stream_hourly_rate(spark, sf):
    """ST-2 batch twin: positive rate per tumbling hour of the event stream."""
    from txnlens.streaming.jobs import hourly_rate_batch

    return hourly_rate_batch(spark, sf)


@query("stream_velocity")
def q_stream_velocity(spark, sf):
    """ST-3 batch twin: events that are the 3rd+ within 5 minutes for the same user."""
    ev = stream_events(spark, sf)
    return TM.velocity_flags(ev, "user_id", "ts", 2, 300).select("user_id", F.col("ts").cast("timestamp_ntz").alias("ts"))


@query("stream_score")
def q_stream_score(spark, sf):
    """ST-1 batch twin: score transactions with normalisers frozen from the cleaned table."""
    from txnlens.streaming.jobs import score_batch

    return score_batch(spark, sf, cleaned(spark, sf))


# ---------------------------------------------------------------- kept stages
@query("incremental_rates")
def q_incremental_rates(spark, sf):
    """IO-3 + AG-12: hourly rates kept over a growing folder; files appended later are read alone and merged."""
    feed = write_table(arrivals(spark, sf), "appended")
    source = checkpoint_subdir(spark, f"tables/appended-{uuid.uuid4().hex[:12]}")
    emb = embeddings_dim(spark, sf)
    sums = [F.sum(c).alias(c) for c in ("total", "positives", "exposure")]
    positive = F.col(SPEC.label) == 1
    kept = KeptStage(
        spark,
        source,
        f"rates-{uuid.uuid4().hex[:12]}",
        transform=lambda e: build_transactions(e, emb).withColumn("Hour", hour_of_day(SPEC.time)),
        partial=lambda t: t.groupBy("Hour").agg(
            F.count(F.lit(1)).alias("total"),
            F.count_if(positive).alias("positives"),
            F.coalesce(F.sum(F.when(positive, F.col(SPEC.amount))), F.lit(0.0)).alias("exposure"),
        ),
        merge=lambda p: p.groupBy("Hour").agg(*sums),
    )
    for slots in ((0, 1, 2), (3,), (4,)):
        feed.where(F.col("slot").isin(*slots)).drop("slot").write.mode("append").parquet(source)
        kept.refresh()
    rate = F.col("positives") / F.col("total") * 100
    return kept.result().select("Hour", "total", "positives", rate.alias("rate_pct"), "exposure")


# ---------------------------------------------------------------- streams, run live
def _live(spark, sf, job, name, again=False):
    """What ``job`` writes to its sink when the events arrive slot by slot, some of them late."""
    from txnlens.streaming.replay import run_arrivals

    return run_arrivals(arrivals(spark, sf, again), ARRIVAL_SLOTS, job, name)[0]


def _naive(df):
    return df.withColumn("ts", F.col("ts").cast("timestamp_ntz"))


@query("live_score")
def q_live_score(spark, sf):
    """ST-1 as a stream: every arriving transaction scored and flagged with frozen normalisers."""
    from txnlens.streaming.jobs import frozen_params, score_transform

    p, emb = frozen_params(spark, sf, cleaned(spark, sf)), embeddings_dim(spark, sf)
    events = lambda s: s.select("event_id", "ts", "event_type", "value")
    return _live(spark, sf, lambda s: score_transform(build_transactions(events(s), emb), p), "score")


@query("live_hourly_rate")
def q_live_hourly_rate(spark, sf):
    """ST-2 as a stream: the hours that the watermark closed, without rows that came after their hour's close."""
    from txnlens.streaming.jobs import hourly_rate_transform

    emb = embeddings_dim(spark, sf)
    return _live(spark, sf, lambda s: hourly_rate_transform(s, emb, streaming=True), "hourly")


#: the feed's latest rows come 26 hours after their time
LIVE_DELAY = "27 hours"


@query("live_velocity")
def q_live_velocity(spark, sf):
    """ST-3 as a stream: third or later events of a user within 5 minutes, among those the watermark has passed."""
    from txnlens.streaming.jobs import velocity_transform

    got = _live(spark, sf, lambda s: velocity_transform(s, "user_id", 2, 300, LIVE_DELAY), "velocity")
    return _naive(got.select("user_id", "ts"))


@query("live_bursts")
def q_live_bursts(spark, sf):
    """ST-3 with session windows: bursts of more than 2 events of a user, at most 2 hours apart, that have ended."""
    from txnlens.streaming.jobs import burst_transform

    return _live(spark, sf, lambda s: burst_transform(s, "user_id", "2 hours", 2, LIVE_DELAY), "bursts")


@query("live_dedup")
def q_live_dedup(spark, sf):
    """SO-4 as a stream: events delivered twice, in one slot or in two, come through once."""
    from txnlens.streaming.jobs import dedup_transform

    return _naive(_live(spark, sf, lambda s: dedup_transform(s, ["event_id"], "28 hours"), "dedup", again=True))


# ---------------------------------------------------------------- oversampling
def _smote_input(spark, sf):
    def build():
        df = _split_stored(spark, sf)
        df = RS.scale_by_split(df, FE.scale_columns(df, SPEC))
        return df.where(F.col("split") == "train").drop("split")

    # the scaled training split is a pipeline output (written once per session)
    train = materialize(build, f"train_scaled:{sf}:{_version(spark, sf)}", spark)
    feats = [c for c in train.columns if c not in (SPEC.key, SPEC.label)]
    return train, feats


@query("smote_balanced")
def q_smote_balanced(spark, sf):
    """RS-3: SMOTE-balanced training split; draws and ids come from seeded md5, so SQL can follow them."""
    train, feats = _smote_input(spark, sf)
    return RS.smote(train, feats, SPEC, k=5, seed=42)


@query("smote_summary")
def q_smote_summary(spark, sf):
    """RS-3 / RS-5: per label, training rows before and after oversampling."""
    train, feats = _smote_input(spark, sf)
    before = train.groupBy(SPEC.label).agg(F.count(F.lit(1)).alias("before"))
    after = RS.smote(train, feats, SPEC, k=5, seed=42).groupBy(SPEC.label).agg(F.count(F.lit(1)).alias("after"))
    return before.join(after, SPEC.label)  # one row per label on both sides
