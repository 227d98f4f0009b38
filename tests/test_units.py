"""Edge cases and properties of the operators on hand-made frames."""

from __future__ import annotations

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from txnlens.functions import columns as C
from txnlens.operators import profile as P
from txnlens.operators import rates as R
from txnlens.operators import resample as RS
from txnlens.operators import scoring as S
from txnlens.operators import separation as SP
from txnlens.operators import timing as TM
from txnlens.plans import ordered as O
from txnlens.spec import TxnSpec

NAN = float("nan")


def rows(df, *cols):
    return [tuple(r[c] for c in cols) for r in df.collect()]


def test_band_edges_are_right_closed(spark):
    vals = [-1.0, -0.01, -0.005, 0.0, 0.005, 10.0, 10.01, 50.0, 100.0, 500.0, 1000.0, 1000.5, None, NAN]
    df = spark.createDataFrame([(v,) for v in vals], "a double")
    got = rows(df.select(C.DEFAULT_BANDS.ordinal("a").alias("o")), "o")
    assert [g[0] for g in got] == [None, None, 0, 0, 1, 1, 2, 2, 3, 4, 5, 6, None, None]
    oh = df.select(*C.DEFAULT_BANDS.onehot(C.DEFAULT_BANDS.ordinal("a"))).collect()
    assert all(sum(r) in (0, 1) for r in oh)
    assert sum(oh[-1]) == 0 and sum(oh[-2]) == 0


def test_time_parts_follow_floor_semantics(spark):
    df = spark.createDataFrame([(-1.0,), (0.0,), (3599.9,), (86399.0,), (86400.0,), (172799.0,)], "t double")
    got = rows(df.select(C.hour_of_day("t").alias("h"), C.day_index("t").alias("d"), C.day_label(C.day_index("t")).alias("l")), "h", "d", "l")
    assert got == [(23, -1, None), (0, 0, "Day 1"), (0, 0, "Day 1"), (23, 0, "Day 1"), (0, 1, "Day 2"), (23, 1, "Day 2")]


def test_clip_keeps_null(spark):
    df = spark.createDataFrame([(None,), (5.0,), (-5.0,)], "x double")
    assert [r[0] for r in df.select(C.clip("x", 0.0, 1.0)).collect()] == [None, 1.0, 0.0]


def test_moments_match_pandas_and_constant_column(spark):
    rng = np.random.default_rng(1)
    x = rng.lognormal(size=200)
    pdf = pd.DataFrame({"x": x, "c": 3.0})
    df = spark.createDataFrame(pdf)
    m = {r["column"]: r for r in P.moments(df, ["x", "c"]).collect()}
    assert m["x"]["skewness"] == pytest.approx(pdf["x"].skew(), rel=1e-9)
    assert m["x"]["kurtosis"] == pytest.approx(pdf["x"].kurt(), rel=1e-9)
    assert m["c"]["skewness"] == 0.0 and m["c"]["kurtosis"] == 0.0


def test_pearson_constant_column_is_null_not_error(spark):
    df = spark.createDataFrame([(1.0, 0), (1.0, 1), (1.0, 0)], "x double, y int")
    assert df.select(C.pearson("x", "y")).first()[0] is None


@pytest.mark.parametrize("margin", [None, -0.3])
def test_exact_quantiles_equal_numpy(spark, margin):
    """Margin -0.3 makes every bracket miss, so the wider ones are taken."""
    random.seed(7)
    data = []
    for g, n in (("a", 1), ("b", 2), ("c", 501), ("d", 2000)):
        for _ in range(n):
            data.append((g, float(random.choice([1, 2, 2, 3, 7, 7, 7, 100])) if g == "c" else random.gauss(0, 1)))
    df = spark.createDataFrame(data + [("d", None)], "g string, v double")
    probs = [0.0, 0.1, 0.25, 0.5, 0.75, 1.0]
    q = O.exact_quantiles(df, "v", probs, by=["g"], margin=margin)
    got = {(r["g"], r["prob"]): r["quantile"] for r in q.collect()}
    pdf = pd.DataFrame(data, columns=["g", "v"])
    for g, sub in pdf.groupby("g"):
        for p in probs:
            assert got[(g, p)] == pytest.approx(float(np.percentile(sub["v"], p * 100)), rel=1e-12, abs=1e-12)


def test_prefix_rank_and_previous_value_equal_single_partition_windows(spark):
    random.seed(3)
    times = [float(random.randint(0, 3000)) for _ in range(3000)] + [float(48000 + i) for i in range(20)]
    data = [(i % 3, t) for i, t in enumerate(times)]
    df = spark.createDataFrame(data, "p int, t double")
    two = O.prefix_rank(df, "t", ["p"], n_buckets=16)
    naive = df.withColumn("_rn", F.row_number().over(Window.partitionBy("p").orderBy("t")))
    assert sorted(rows(two, "p", "t", "_rn")) == sorted(rows(naive, "p", "t", "_rn"))
    prev = O.previous_value(df, "t", ["p"], n_buckets=16)
    naive_prev = df.withColumn("_prev", F.lag("t").over(Window.partitionBy("p").orderBy("t")))
    assert sorted(rows(prev, "p", "t", "_prev"), key=str) == sorted(rows(naive_prev, "p", "t", "_prev"), key=str)


def test_prefix_sums_equal_naive(spark):
    random.seed(5)
    data = [("f1" if i % 2 else "f2", float(i % 97), 1, i % 5) for i in range(2000)]
    df = spark.createDataFrame(data, "f string, v double, a int, b int").groupBy("f", "v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    two = O.prefix_sums(df, "v", ["a", "b"], ["f"], n_buckets=8)
    w = Window.partitionBy("f").orderBy("v").rowsBetween(Window.unboundedPreceding, 0)
    naive = df.withColumn("a_cum", F.sum("a").over(w)).withColumn("b_cum", F.sum("b").over(w))
    assert sorted(rows(two, "f", "v", "a_cum", "b_cum")) == sorted(rows(naive, "f", "v", "a_cum", "b_cum"))


def test_stratified_split_is_exact_and_complete(spark):
    data = [(i, 1 if i % 37 == 0 else 0) for i in range(5000)]
    df = spark.createDataFrame(data, "txn_id long, Class int")
    spec = TxnSpec()
    out = RS.stratified_split(df, spec, 0.2, 42, bucket_digits=2)
    got = out.groupBy("Class", "split").count().collect()
    counts = {(r["Class"], r["split"]): r["count"] for r in got}
    n1 = sum(1 for _, c in data if c == 1)
    n0 = len(data) - n1
    assert counts[(1, "test")] == math.ceil(n1 / 5) and counts[(0, "test")] == math.ceil(n0 / 5)
    assert out.count() == len(data) and out.select("txn_id").distinct().count() == len(data)
    again = RS.stratified_split(df, spec, 0.2, 42, bucket_digits=3)
    assert sorted(rows(out, "txn_id", "split")) == sorted(rows(again, "txn_id", "split"))


def _scored_frame(spark, n=3000):
    rng = np.random.default_rng(11)
    pdf = pd.DataFrame({
        "txn_id": np.arange(n),
        "Class": (rng.random(n) < 0.05).astype("int32"),
        "Amount": np.round(rng.lognormal(3, 1.5, n), 2),
        "fraud_score": np.clip(rng.random(n), 0, 1),
    })
    pdf.loc[::50, "fraud_score"] = np.round(pdf.loc[::50, "fraud_score"], 2)  # exact grid hits
    return spark.createDataFrame(pdf)


def test_threshold_sweep_matches_single_thresholds(spark):
    df = _scored_frame(spark)
    sweep = {round(r["threshold"], 2): r for r in S.threshold_sweep(spark, df).collect()}
    for t in (0.0, 0.13, 0.6, 1.0):
        one = S.threshold_metrics(df, t).first()
        row = sweep[t]
        for c in ("flagged", "true_pos", "false_pos", "positives"):
            assert row[c] == one[c], (t, c)
        assert row["exposure_caught"] == pytest.approx(one["exposure_caught"])
        assert row["exposure_caught"] + row["exposure_missed"] == pytest.approx(one["exposure_caught"] + one["exposure_missed"])


def test_histogram_counts_sum_to_n_and_single_value(spark):
    df = _scored_frame(spark)
    h = SP.histogram_by_label(df, "Amount", 30)
    tot = {r["Class"]: r["s"] for r in h.groupBy("Class").agg(F.sum("count").alias("s")).collect()}
    n = {r["Class"]: r["count"] for r in df.groupBy("Class").count().collect()}
    assert tot == n
    one = spark.createDataFrame([(0, 5.0), (0, 5.0)], "Class int, x double")
    h1 = SP.histogram_by_label(one, "x", 10).collect()
    assert sum(r["count"] for r in h1) == 2 and min(r["bin_lo"] for r in h1) == 4.5


def test_kde_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=400)
    df = spark.createDataFrame(pd.DataFrame({"Class": 0, "x": x}))
    d = SP.density_by_label(df, "x", grid_lo=-3.0, grid_hi=3.0).orderBy("point").toPandas()
    h = 0.3 * x.std(ddof=1)
    grid = np.linspace(-3, 3, 300)
    ref = np.exp(-0.5 * ((grid[:, None] - x[None, :]) / h) ** 2).sum(axis=1) / (len(x) * h * math.sqrt(2 * math.pi))
    assert np.allclose(d["density"].to_numpy(), ref, rtol=1e-9, atol=1e-15)
    const = spark.createDataFrame([(0, 1.0), (0, 1.0)], "Class int, x double")
    assert SP.density_by_label(const, "x").count() == 0


def test_ks_equals_brute_force(spark):
    rng = np.random.default_rng(4)
    neg = np.round(rng.normal(0, 1, 900), 2)
    pos = np.round(rng.normal(0.7, 1.2, 80), 2)
    pdf = pd.DataFrame({"Class": [0] * len(neg) + [1] * len(pos), "V1": np.concatenate([neg, pos])})
    ks = SP.feature_ks(spark.createDataFrame(pdf), ["V1"]).first()
    allv = np.sort(np.unique(pdf["V1"]))
    cdf0 = np.searchsorted(np.sort(neg), allv, side="right") / len(neg)
    cdf1 = np.searchsorted(np.sort(pos), allv, side="right") / len(pos)
    assert ks["ks"] == pytest.approx(np.abs(cdf0 - cdf1).max(), rel=1e-12)
    assert 0.0 <= ks["p_value"] <= 1.0


def test_kolmogorov_sf_is_continuous_and_monotone(spark):
    zs = [0.05, 0.3, 0.9, 1.0 - 1e-9, 1.0, 1.0 + 1e-9, 1.5, 3.0]
    df = spark.createDataFrame([(z,) for z in zs], "z double")
    q = [r[0] for r in df.select(SP.kolmogorov_sf(F.col("z"))).collect()]
    assert all(a >= b for a, b in zip(q, q[1:]))
    assert q[3] == pytest.approx(q[5], abs=1e-8)
    assert q[4] == pytest.approx(0.26999967167735456, rel=1e-9)


def test_cumulative_arrival_ends_at_100(spark):
    df = _scored_frame(spark).withColumn("Time", (F.col("txn_id") % 97).cast("double"))
    c = TM.cumulative_arrival(df)
    mx = {r["Class"]: r["m"] for r in c.groupBy("Class").agg(F.max("cum_pct").alias("m")).collect()}
    assert all(v == pytest.approx(100.0) for v in mx.values())
    even = TM.cumulative_arrival(df, zero_based=True)
    mn = {r["Class"]: r["m"] for r in even.groupBy("Class").agg(F.min("cum_pct").alias("m")).collect()}
    assert all(v == 0.0 for v in mn.values())


def test_peak_ties_take_first_key(spark):
    df = spark.createDataFrame([(3, 1.0), (1, 2.0), (2, 2.0)], "Hour int, rate_pct double")
    assert R.peak(df).first()["Hour"] == 1


def test_missing_and_duplicates_count_nan(spark):
    df = spark.createDataFrame([(1.0, None), (NAN, 2.0), (NAN, 2.0), (1.0, None)], "a double, b double")
    m = {r["column"]: r["missing_count"] for r in P.missing_report(df).collect()}
    assert m == {"a": 2, "b": 2}
    d = P.duplicate_report(df).first()
    assert (d["rows"], d["distinct_rows"], d["duplicates"]) == (4, 2, 2)


def test_row_stats_skip_missing_members(spark):
    from txnlens.operators.features import add_row_stats

    pdf = pd.DataFrame({"V1": [1.0, None, 2.0], "V2": [3.0, 4.0, None], "V3": [-1.0, 5.0, None]})
    out = add_row_stats(spark.createDataFrame(pdf), ["V1", "V2", "V3"]).toPandas()
    v = pdf[["V1", "V2", "V3"]]
    assert np.allclose(out["V_mean"], v.mean(axis=1))
    assert np.allclose(out["V_std"].astype(float), v.std(axis=1), equal_nan=True)
    assert list(out["V_pos_ct"]) == list((v > 0).sum(axis=1))


def test_empty_frame_rates(spark):
    df = spark.createDataFrame([], "Hour int, Class int")
    assert R.rate_by(df, ["Hour"]).count() == 0


def test_filter_defaults_to_non_null_amount(spark):
    df = spark.createDataFrame([("Day 1", 3, 10.0), ("Day 2", 3, None), ("Day 3", 3, 1.0)], "Day_label string, Hour int, Amount double")
    assert R.TxnFilter().apply(df).count() == 1


def test_exact_knn_and_smote(spark):
    from txnlens.plans.neighbors import exact_knn

    rng = np.random.default_rng(0)
    n1, n0, d = 120, 500, 5
    X = np.vstack([rng.normal(0, 1, (n0, d)), rng.normal(1, 1, (n1, d))]).round(4)
    pdf = pd.DataFrame(X, columns=[f"f{i}" for i in range(d)])
    pdf["Class"] = np.r_[np.zeros(n0, "int32"), np.ones(n1, "int32")]
    pdf["txn_id"] = np.arange(len(pdf))
    pdf["cnt"] = (X[:, 0] > 0).astype("int32")
    df = spark.createDataFrame(pdf)
    feats = [f"f{i}" for i in range(d)]
    knn = exact_knn(df.where("Class = 1"), "txn_id", feats, 5, bucket_rows=8).toPandas()
    P = pdf[pdf.Class == 1]
    A, ids = P[feats].to_numpy(), P.txn_id.to_numpy()
    D = np.sqrt(((A[:, None, :] - A[None, :, :]) ** 2).sum(-1))
    np.fill_diagonal(D, np.inf)
    for i, a in enumerate(ids):
        want = set(ids[np.argsort(D[i], kind="stable")[:5]])
        assert set(knn[knn.txn_id == a].nn_txn_id) == want
    out = RS.smote(df, feats + ["cnt"], TxnSpec(), k=5, bucket_rows=8)
    counts = {(r["Class"], r["synthetic"]): r["count"] for r in out.groupBy("Class", "synthetic").count().collect()}
    assert counts == {(0, False): n0, (1, False): n1, (1, True): n0 - n1}
    syn = out.where("synthetic").toPandas()
    assert syn["txn_id"].isna().all() and set(syn["cnt"].unique()) <= {0, 1}
    # every synthetic point lies inside the bounding box of the minority class
    lo, hi = A.min(axis=0), A.max(axis=0)
    assert ((syn[feats].to_numpy() >= lo - 1e-9) & (syn[feats].to_numpy() <= hi + 1e-9)).all()
    again = RS.smote(df, feats + ["cnt"], TxnSpec(), k=5, bucket_rows=8).where("synthetic").toPandas()
    assert np.allclose(np.sort(syn[feats].to_numpy(), axis=0), np.sort(again[feats].to_numpy(), axis=0))


def test_previous_k_equals_lag_with_a_hot_entity(spark):
    random.seed(9)
    data = [(0, float(random.randint(0, 5000))) for _ in range(3000)]  # hot entity
    data += [(0, 77.0)] * 2000  # and a hot tie inside it
    data += [(e, float(random.randint(0, 5000))) for e in range(1, 40) for _ in range(random.randint(0, 6))]
    df = spark.createDataFrame(data, "e int, t double")
    got = O.previous_k(df, "t", ["e"], 2, n_buckets=16)
    want = df.withColumn("_prev_k", F.lag("t", 2).over(Window.partitionBy("e").orderBy("t")))
    assert sorted(rows(got, "e", "t", "_prev_k"), key=str) == sorted(rows(want, "e", "t", "_prev_k"), key=str)


def test_velocity_flags_rule(spark):
    import datetime as dt

    t0 = dt.datetime(2024, 1, 1)
    ev = [(1, t0), (1, t0 + dt.timedelta(minutes=1)), (1, t0 + dt.timedelta(minutes=2)),  # 3rd within 5 min
          (1, t0 + dt.timedelta(minutes=30)), (2, t0), (2, t0 + dt.timedelta(minutes=4)),
          (2, t0 + dt.timedelta(minutes=9))]
    df = spark.createDataFrame(ev, "user_id long, ts timestamp")
    got = TM.velocity_flags(df, "user_id", "ts", 2, 300).collect()
    assert [(r["user_id"], r["ts"]) for r in got] == [(1, t0 + dt.timedelta(minutes=2))]


def test_csv_round_trip_with_schema_and_nan(spark, tmp_path):
    from txnlens.sources import io as IO

    schema = IO.transaction_schema(n_features=2)
    p = tmp_path / "raw.csv"
    p.write_text("Time,V1,V2,Amount,Class\n0,1.5,NaN,10.0,0\n86400,,2.0,0,1\n")
    df = IO.read_transactions(spark, str(p), "csv", schema)
    assert df.dtypes == [("Time", "double"), ("V1", "double"), ("V2", "double"), ("Amount", "double"), ("Class", "int")]
    got = df.collect()
    assert got[0]["V2"] is None and got[1]["V1"] is None
    out = tmp_path / "out"
    IO.write_table(df, str(out), "parquet", partition_by=["Class"])
    back = spark.read.parquet(str(out))
    assert back.count() == 2 and sorted(back.columns) == sorted(df.columns)


def test_hot_value_holding_a_third_of_rows(spark):
    """A single value with a third of all rows: quantiles, ranks and running sums stay exact."""
    random.seed(21)
    # + 0.0 turns -0.0 into 0.0 (Spark groups and joins them as one value)
    vals = [0.0] * 3000 + [round(random.uniform(-50, 50), 2) + 0.0 for _ in range(6000)]
    df = spark.createDataFrame([(i % 2, v) for i, v in enumerate(vals)], "Class int, v double")
    q = O.exact_quantiles(df, "v", [0.1, 0.25, 0.5, 0.75, 0.9], by=["Class"], accuracy=200)
    got = {(r["Class"], r["prob"]): r["quantile"] for r in q.collect()}
    pdf = pd.DataFrame({"Class": [i % 2 for i in range(len(vals))], "v": vals})
    for c, sub in pdf.groupby("Class"):
        for p in (0.1, 0.25, 0.5, 0.75, 0.9):
            assert got[(c, p)] == pytest.approx(float(np.percentile(sub["v"], p * 100)), abs=1e-12)
    r = O.prefix_rank(df, "v", ["Class"], n_buckets=32)
    assert r.groupBy("Class").agg(F.max("_rn").alias("m"), F.countDistinct("_rn").alias("d")).where("m != d").count() == 0
    naive_rank = df.withColumn("_rn", F.row_number().over(Window.partitionBy("Class").orderBy("v")))
    assert sorted(rows(r, "Class", "v", "_rn")) == sorted(rows(naive_rank, "Class", "v", "_rn"))
    prev = O.previous_value(df, "v", ["Class"], n_buckets=32)
    naive_prev = df.withColumn("_prev", F.lag("v").over(Window.partitionBy("Class").orderBy("v")))
    assert sorted(rows(prev, "Class", "v", "_prev"), key=str) == sorted(rows(naive_prev, "Class", "v", "_prev"), key=str)
    ks = SP.feature_ks(df.withColumnRenamed("v", "V1"), ["V1"]).first()
    neg, pos = pdf[pdf.Class == 0]["v"].to_numpy(), pdf[pdf.Class == 1]["v"].to_numpy()
    allv = np.unique(pdf["v"])
    d = np.abs(np.searchsorted(np.sort(neg), allv, "right") / len(neg) - np.searchsorted(np.sort(pos), allv, "right") / len(pos)).max()
    assert ks["ks"] == pytest.approx(d, rel=1e-12)


def test_one_label_input_and_missing_pivot_label(spark):
    df = spark.createDataFrame([(0, 5.0, 3, "Day 1"), (0, 0.0, 4, "Day 2"), (0, 7.0, 9, "Day 1")], "Class int, Amount double, Hour int, Day_label string")
    dist = P.label_distribution(df).collect()
    assert [(r["Class"], r["count"], r["percent"]) for r in dist] == [(0, 3, 100.0)]
    assert P.imbalance_ratio(df).first()["ratio"] is None
    ct = {r["Day_label"]: (r["negatives"], r["positives"], r["rate_pct"]) for r in R.day_crosstab(df).collect()}
    assert ct == {"Day 1": (2, 0, 0.0), "Day 2": (1, 0, 0.0)}
    ex = R.exposure_summary(df).first()
    assert ex["pos_total"] == 0.0 and ex["pos_mean"] is None and ex["pos_count"] == 0
    sc = {r["metric"]: r["value"] for r in R.scorecard(df).collect()}
    assert sc["positives"] == 0.0 and sc["imbalance_ratio"] is None and sc["total_exposure"] == 0.0


def test_threshold_metrics_without_positives_or_scores(spark):
    df = spark.createDataFrame([(0, 1.0, None), (0, 2.0, 0.9)], "Class int, Amount double, fraud_score double")
    m = S.threshold_metrics(df, 0.6).first()
    assert (m["flagged"], m["true_pos"], m["recall_pct"], m["precision_pct"]) == (1, 0, 0.0, 0.0)
    assert m["exposure_caught"] == 0.0 and m["exposure_missed"] == 0.0


def test_single_row_and_empty_frames(spark):
    one = spark.createDataFrame([(1, 3.5)], "Class int, v double")
    q = O.exact_quantiles(one, "v", [0.0, 0.5, 1.0]).collect()
    assert sorted(r["quantile"] for r in q) == [3.5, 3.5, 3.5]
    empty = spark.createDataFrame([], "Class int, v double")
    assert O.exact_quantiles(empty, "v", [0.5]).count() == 0
    assert SP.histogram_by_label(empty, "v", 10).count() == 0
    assert SP.density_by_label(one, "v").count() == 0
    m = P.moments(one, ["v"]).first()
    assert m["skewness"] is None and m["kurtosis"] is None


def test_range_buckets_hold_no_more_than_twice_the_target(spark):
    random.seed(17)
    data = [(i % 3, 7.0 if i % 3 == 0 else random.gauss(0, 5), i) for i in range(30_000)]  # a third of the rows share a value
    df = spark.createDataFrame(data, "g int, v double, salt int")
    out = O.with_range_buckets(df, ["v", "salt"], "b", 30)
    sizes = [r["count"] for r in out.groupBy("b").count().collect()]
    assert sum(sizes) == 30_000 and max(sizes) <= 2 * 1000
    ends = out.groupBy("b").agg(F.min(F.struct("v", "salt")).alias("lo"), F.max(F.struct("v", "salt")).alias("hi")).orderBy("b")
    ends = [(tuple(r["lo"]), tuple(r["hi"])) for r in ends.collect()]
    assert all(x[1] < y[0] for x, y in zip(ends, ends[1:]))
    assert O.auto_buckets(10**11) == 10**5 and O.auto_salts(10**12) == 10**6


def test_user_columns_named_like_internal_ones_survive(spark):
    df = spark.createDataFrame([(float(i % 5), i, "x") for i in range(40)], "t double, _h long, _s string")
    out = O.prefix_rank(df, "t", n_buckets=4)
    assert {"_h", "_s"} <= set(out.columns) and sorted(r["_h"] for r in out.collect()) == list(range(40))


def test_scorecard_on_an_empty_filter(spark):
    df = spark.createDataFrame([(0, 5.0, 3), (1, 2.0, 4)], "Class int, Amount double, Hour int")
    for peak_from in (None, df):
        sc = {r["metric"]: r["value"] for r in R.scorecard(df.where("Hour > 20"), peak_from=peak_from).collect()}
        assert set(sc) == set(R.SCORECARD_METRICS)
        assert sc["total_transactions"] == sc["positive_rate_pct"] == sc["avg_positive_amount"] == sc["max_positive_amount"] == 0.0
        assert sc["peak_hour"] == (4.0 if peak_from is not None else 0.0)


def test_ks_p_value_with_counts_beyond_bigint_products(spark, monkeypatch):
    big = spark.createDataFrame([("V1", 0, 1.0, 10**11, 0), ("V1", 0, 2.0, 0, 10**9)], "column string, col_idx int, value double, n0 long, n1 long")
    monkeypatch.setattr(SP, "write_table", lambda df, name: big if name == "ks-counts" else df)
    row = SP.feature_ks(spark.createDataFrame([(0, 1.0), (1, 2.0)], "Class int, V1 double"), ["V1"]).first()
    assert row["ks"] == 1.0 and row["p_value"] == 0.0 and row["n_neg"] == 10**11


def test_a_cluster_without_a_shared_folder_is_refused():
    from types import SimpleNamespace

    from txnlens.session import ensure_checkpoint_dir

    def session(master):
        context = SimpleNamespace(getCheckpointDir=lambda: None, setCheckpointDir=lambda d: None, master=master)
        return SimpleNamespace(sparkContext=context, conf=SimpleNamespace(get=lambda key, default: None))

    for master in ("yarn", "spark://h:7077", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError):
            ensure_checkpoint_dir(session(master))
    assert ensure_checkpoint_dir(session("local[4]")) and ensure_checkpoint_dir(session("local"))


def test_every_embedding_occurs_in_the_fixture(spark):
    from txnlens.sources.fixture import embeddings_dim, modulus, transactions

    sf = "/root/testdata/sf0.1"
    emb = embeddings_dim(spark, sf)
    n = modulus(emb)
    used = transactions(spark, sf).select((F.col("txn_id") % n).alias("k")).distinct().count()
    assert used == emb.count() == n == 2000


def test_stage_is_rebuilt_for_rewritten_input(spark, tmp_path):
    from txnlens.plans.stage import input_version

    path = str(tmp_path / "t")
    spark.range(3).write.parquet(path)
    one = input_version(spark.read.parquet(path))
    assert one == input_version(spark.read.parquet(path))
    spark.range(4).write.mode("overwrite").parquet(path)
    assert one != input_version(spark.read.parquet(path))


def test_dtype_counts_and_shape(spark):
    df = spark.createDataFrame([(1.0, 2.0, 1, "a")], "x double, y double, c int, s string")
    got = {r["dtype"]: r["n_columns"] for r in P.dtype_counts(spark, df).collect()}
    assert got == {"double": 2, "int": 1, "string": 1}
    sh = P.shape(df).first()
    assert (sh["rows"], sh["columns"]) == (1, 4)


def test_save_splits_writes_three_tables(spark, tmp_path):
    from txnlens.sources import io as IO

    df = spark.createDataFrame([(i, i % 2) for i in range(20)], "txn_id long, Class int")
    split = RS.stratified_split(df, TxnSpec(), 0.2, 42, bucket_digits=1)
    paths = IO.save_splits(split.drop("split"), split.where("split = 'train'"), split.where("split = 'test'"), str(tmp_path))
    counts = {k: spark.read.parquet(v).count() for k, v in paths.items()}
    assert counts == {"wrangled": 20, "train": 16, "test": 4}
